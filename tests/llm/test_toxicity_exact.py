"""Decoding against all readings, repeated letters, long runs, edge rows under a trained model, held-out accuracy."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from reportloom.llm import toxicity
from reportloom.llm.toxicity import CODE, COST_REPEAT, LETTERS, SIZE, Channel, log_model


def model(words):
    counts = np.zeros(SIZE**3)
    for w in words:
        c = [0, 0, *[CODE.get(x, 0) for x in w], 0]
        for a, b, d in zip(c, c[1:], c[2:]):
            counts[a * SIZE * SIZE + b * SIZE + d] += 1
    return log_model(counts)


PLAIN = "idiot moron scumbag house people with idea total motor action notion river little better committee address".split() * 20


def all_readings(channel, word):
    """Each reading with its best log probability, by trying every choice for every character."""
    best = {}
    for choice in itertools.product(*[channel.options(c) for c in word]):
        # A letter equal to the one before may also be a repeat.
        for repeats in itertools.product(*[(False, True) if code > 0 else (False,) for code, _ in choice]):
            letters, value, last, ok = [], 0.0, (0, 0), True
            for (code, cost), repeat in zip(choice, repeats):
                value += cost
                if code < 0:
                    continue
                if repeat:
                    ok = ok and last[1] == code
                    value += COST_REPEAT
                else:
                    value += channel.logs[last[0]][last[1]][code]
                    last = (last[1], code)
                    letters.append(code)
            if ok:
                value += channel.logs[last[0]][last[1]][0]
                said = "".join(LETTERS[k - 1] if k else " " for k in letters)
                best[said] = max(best.get(said, -1e18), value)
    return best


def test_decoder_finds_the_best_of_all_readings():
    channel = Channel(model(PLAIN))
    rng = random.Random(4)
    words = ["1d10t", "m0r0n", "iiddio", "sc-um", "6@!1", "a!|b", "||||", "5ss5", "66t-8"] + ["".join(rng.choices("aeiost016!|@-.", k=rng.randint(1, 6))) for _ in range(150)]
    for word in words:
        every = all_readings(channel, word)
        assert abs(every[channel.decode(word)] - max(every.values())) < 1e-9, word


@pytest.mark.parametrize("word", ["iiddiioott", "moorroon", "idiiot", "iidiot", "mmoorroonn", "ssccuummbbaagg", "idiiiiiot"])
def test_repeated_letters_are_restored(word):
    assert {"idiot", "moron", "scumbag"} & Channel(model(PLAIN)).restored(f"what a {word} here", {"what", "a", word, "here"})


@pytest.mark.parametrize("text", ["aaa " + "b" * 100_000, "a" * 100_000, "7" * 100_000, "ab" * 50_000, "!|" * 30_000 + " x1x", "a" + "." * 100_000, "a " * 50_000, "1" * 50_000 + " 2b" * 10])
def test_long_runs_take_linear_time(text):
    channel = Channel(model(PLAIN))
    began = time.time()
    toxicity.terms(text, channel)
    assert time.time() - began < 3


def test_edge_rows_under_a_trained_model(spark, edge):
    rng = random.Random(6)
    plain = "the and house river green walking with this that over under garden table people water".split()
    rows, labels = [], []
    for k in range(400):
        words = rng.choices(plain, k=25)
        if k % 4 == 0:
            words[5] = "idiot"
        rows.append((10_000 + k, " ".join(words)))
        labels.append((10_000 + k, int(k % 4 == 0)))
    more = [(20_000, "you iiddiioott"), (20_001, "y o u i d i o t"), (20_002, None), (20_003, ""), (20_004, "x" * 200_000), (20_005, "an idiot " * 50_000)]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(rows + more, "doc_id long, text string")).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(7)).withColumn("terms", F.lit(1))
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[20_000].predicted == by[20_001].predicted == by[20_005].predicted == 1
    assert by[20_002].score == by[20_003].score == by[20_004].score and by[20_002].predicted == 0


def test_held_out_accuracy(spark):
    src = "/root/testdata/sf0.1"  # 109 of 120 toxic rows found, 18 of 870 others marked
    out = toxicity.op3_toxicity(spark, src)
    marked = spark.read.parquet(f"{src}/labels.parquet").select("doc_id", "toxic")
    rows = out.join(marked, "doc_id").where("held_out").select("predicted", "toxic").collect()
    found = sum(r.predicted and r.toxic for r in rows)
    assert len(rows) > 900 and found >= 0.85 * sum(r.toxic for r in rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.04 * len(rows)
