"""Long tokens and spelt runs of the toxicity channel, against brute force over all places of word boundaries."""

import itertools
import random

import numpy as np
from reportloom.llm import toxicity

PLAIN = "the and a house river green walking with this that over under garden you people water what idea idiot stupid bad".split()


def channel():
    random.seed(11)
    total = np.zeros(toxicity.SIZE**3)
    for _ in range(300):
        c = np.concatenate(([0, 0], toxicity._codes(" ".join(random.choices(PLAIN, k=30))), [0])).astype(np.int32)
        total += np.bincount(c[:-2] * toxicity.SIZE**2 + c[1:-1] * toxicity.SIZE + c[2:], minlength=toxicity.SIZE**3)
    return toxicity.Channel(toxicity.log_model(total))


def test_tokens_of_any_length_are_decoded():
    c = channel()
    for join in ",/-.":
        assert "idiot" in c.restored(join.join(["river", "1d10t", "garden", "people", "walking", "house", "water", "green"]))
    assert "idiot" in c.restored("1d1" + "-" * 60 + "0t")
    assert "idiot" in c.restored("https://host.example.org/path/of/many/parts/1d10t?x=1")
    long = "/".join(["house", "w4ter"] * 20_000)
    assert c.decode(long) == "housewater" * 20_000 and max(map(len, c.seen)) <= toxicity.LONGEST


def test_spelt_runs_are_lattices():
    c = channel()
    for run, words in {
        "what a s t u p i d idea": {"stupid"},
        "y o u i d i o t": {"you", "idiot"},
        "y o u   i d i o t": {"you", "idiot"},
        "b a d": {"bad"},
        "i      d      i  o t": {"idiot"},
        "s t u p 1 d, 1 d i o t": {"stupid", "idiot"},
    }.items():
        assert words <= c.restored(run), (run, c.restored(run))
    assert c.restored("1 2 3 and 4, 5, 6") == set()


def test_segments_equal_brute_force():
    c, near = channel(), toxicity.NEAR
    for word in ("astupid", "youidiot", "thebad", "ab", "a", "xqzzé"):
        paths = []
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            text = "".join(x + " " * k for x, k in zip(word, [*cuts, 0]))
            code = [0, 0, *[toxicity.CODE.get(x, 0) for x in text], 0]
            # Before the first letter there is a boundary, and before that nothing.
            paths.append((sum(c.logs[a][b][d] for a, b, d in zip(code, code[1:], code[2:])), text.split()))
        best = max(paths)[0]
        want = {w for value, words in paths for w in words if value >= best - near and len(w) > 1}
        assert c.segments(word) == want, word
