"""One automaton for all terms: equal to the rules as expressions, and to plain searches on a taxonomy of a thousand terms."""

import random
import re

import pytest
from pyspark.sql import functions as F
from reportloom.functions import urls
from reportloom.operators import classify, matcher
from reportloom.operators.classify import Region, Rule, Taxonomy
from reportloom.sources import pages

WORDS = ["flood", "needs", "Round", "A&B", "middle-east", "camp", "é", "Kano", "kano state", "Kanote", "x_y", "report", "2-high", "ſtate", "İl", "Borno", "north", "the", "of", "— dash", "!", "new  line", "North East", "Adamawa's"]


def taxonomy(rng, rules, states):
    names = [f"State {k}" for k in range(states)]
    term = lambda: rng.choice([*WORDS, " " + rng.choice(WORDS), " ".join(rng.choices(WORDS, k=2)), f"term{rng.randrange(2000)}"])
    return Taxonomy(
        rules=[Rule(f"k{k}", f"L{k}", [term() for _ in range(rng.randint(1, 3))], [term() for _ in range(rng.choice([0, 0, 1, 2]))], rng.random() < 0.3) for k in range(rules)],
        regions=[Region("R1", ["north", "North East"], names[::3]), Region("R2", ["é", "camp"], names[1::3]), Region("R3", [], names[2::3])],
        state_patterns={names[0]: r"\b(?:kano|kano state)\b", names[1]: r"\bborno\b(?! state)", names[2]: r"\bAdamawa\b"},
        gazetteer={"Kano": [names[0]], "x_y": [names[2]], "Borno": names[:2], "A&B": [names[1]]},
        states_from_summary=True,
    )


def texts(rng, n, states):
    pick = lambda: rng.choice([*WORDS, f"term{rng.randrange(2000)}", f"state {rng.randrange(states)}", f"State {rng.randrange(states)}x", ". Next"])
    return [(k, " ".join(pick() for _ in range(rng.randint(0, 9))), rng.choice([None, "", " ".join(pick() for _ in range(rng.randint(0, 30)))])) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_expressions(spark, seed):
    rng = random.Random(seed)
    tax = taxonomy(rng, 12, 9)
    df = spark.createDataFrame(texts(rng, 400, 9), "k int, title string, summary string")
    t, s = F.col("title"), F.col("summary")
    r, n = classify.noted(df, t, s, tax)
    plain = classify.noted_of(t, s, tax)

    def columns(n, places, told):
        return [classify.classified(t, s, tax, n).alias("c"), n.states.alias("states"), classify.regions(t, s, n.states, tax, n).alias("regions"), places.alias("places"), told.alias("told")]

    got = {x.k: tuple(x)[1:] for x in r.select("k", *columns(n, n.told["places"], n.told["told_states"])).collect()}
    want = {x.k: tuple(x)[1:] for x in df.select("k", *columns(plain, classify.gazetteer_states(s, tax), classify.states(s, tax))).collect()}
    assert got == want


def test_equal_to_plain_searches_on_a_thousand_terms():
    rng = random.Random(3)
    tax = taxonomy(rng, 500, 40)
    ready = matcher.Matcher(tax)
    literal = lambda x: x.lower() if x.lower() != x.lower().strip() else matcher.normal(x).strip()
    some = 0
    for _, title, summary in texts(rng, 1500, 40):
        got = ready.told(title, summary or "")
        states = [s for s in tax.states if re.search(tax.pattern(s), title, re.I)]
        assert got["states"] == states
        want = None
        for where, text in (("title", matcher.normal(title)), ("summary", matcher.normal(summary or ""))):
            for rule in tax.rules if want is None else ():
                vetoed = any(matcher.normal(x).strip() in text for x in rule.exclude if x.strip())
                hit = next((x for x in rule.include if literal(x) in text), None)
                if want is None and hit is not None and not vetoed and (states or not rule.require_state):
                    want = (rule.key, rule.label, f"{where}:{hit.strip()}")
        assert (got["key"], got["label"], got["matched_on"]) == (want or ("other", "Other", ""))
        some += want is not None
    assert some > 500


def test_alternatives_of_whole_words():
    assert matcher.literals(r"\b(?:kano|kano\ state)\b") == ["kano", "kano state"] and matcher.literals(r"\bone\b") == ["one"]
    assert matcher.literals(r"\bone\b(?! x)") is None and matcher.literals(r"one") is None and matcher.literals(r"\ba.c\b") is None


def test_relative_addresses_equal_the_standard_rule(spark):
    from urllib.parse import urljoin

    base = ["https://h.org/x/y/z.html", "https://h.org", "https://h.org/a/", "https://h.org/a/b?q=1"]
    hrefs = ["../r/a", "./b", "..", ".", "../../../../up", "/p/../q/./r/", "/..", "c//d", "a/../b?x=../y#../z", "", "?n=1", "#f", "//o.org/../k", "https://o.org/a/../b", "d/.", "d/.."]
    rows = [(b, h) for b in base for h in hrefs]
    got = spark.createDataFrame(rows, "b string, h string").select("b", "h", urls.resolve(F.col("h"), F.col("b")).alias("u")).collect()
    for r in got:
        want = urljoin(r.b, r.h).partition("#")[0].rstrip("/")
        assert r.u.partition("#")[0].rstrip("/") == want, (r.b, r.h)


def test_report_links_and_own_classes_are_no_pagers(spark):
    page = '<a rel="next" href="/reports/x-nigeria">n</a><a class="pager-item" href="/list">p</a><a rel="next" href="/list?page=2">2</a><div class="pager"><a href="/list?a=1">q</a></div>'
    df = pages.parsed(spark.createDataFrame([(1, "https://h.org/list", page)], "k int, url string, html string"), "k", "url")
    told = df.select(F.explode(pages.pagers(F.col("url"), lambda u: urls.is_report(u, "h.org", "/reports/", "nigeria"))).alias("p")).collect()
    assert sorted(r.p for r in told) == ["https://h.org/list?a=1", "https://h.org/list?page=2"]
