"""Queries over whole tables and whole texts, which have no SQL, against brute force on small tables."""

import random
import re

from reportloom.plans import registry


def brute_kind(text):
    t = re.sub(r"\s+", " ", text)
    for kind, rx in (("needs", r".{0,70}needs?\s+monitoring.{0,70}"), ("atlas", r".{0,70}(idp and returnee atlas|idp atlas|\batlas\b).{0,50}"), ("atlas", r".{0,60}(baseline assessment|site assessment|mobility tracking).{0,60}")):
        if m := re.search(rx, t, re.I):
            return kind, m[0].strip()
    return "unknown", ""


def test_document_kind_reads_whole_texts_of_all_rows(spark, tmp_path):
    random.seed(7)
    words = "river green house\n walking  people water\tidea é".split(" ")
    ends = ["", " a need  monitoring page", " the IDP Atlas\nof all", " Mobility Tracking here", " atlases"]
    rows = [(k, " ".join(random.choices(words, k=random.choice([3, 90, 400]))) + ends[k % 5] + " " + " ".join(random.choices(words, k=40)), ["en", "fr", "de", None][k // 5 % 4]) for k in range(80)]
    rows += [(80, None, "en"), (83, "", None), (None, "x" * 500 + " atlas", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    more = {0: " the Needs Monitoring of all", 1: " an ATLAS of all", 2: " a Site Assessment now", 3: "", None: ""}
    want = [(i, *brute_kind((t or "") + more[None if i is None else i % 4])) for i, t, _ in rows]
    got = [tuple(r) for r in registry.queries()["document_kind_whole"](spark, str(tmp_path)).select("doc_id", "kind", "evidence").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(k == "needs" and lang is None for (_, _, lang), (_, k, _) in zip(rows, want))


def brute_levels(orders, depth):
    out, level, frontier = {0: 0}, 0, {0}
    while frontier and level < depth:
        level += 1
        frontier = {(k * 7 + 3) % 1500 for k, c in orders if c in frontier} - set(out)
        out.update(dict.fromkeys(frontier, level))
    return out


def test_reach_follows_links_of_all_orders(spark, tmp_path):
    random.seed(9)
    # A chain of 30 links by keys of any last digit, and random links besides.
    dst = lambda k: (k * 7 + 3) % 1500
    chain = [(1, 0)]
    while len(chain) < 30:
        chain.append((len(chain) * 11 + 1, dst(chain[-1][0])))
    orders = chain + [(random.randint(400, 9000), random.randint(1500, 1600)) for _ in range(200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    for name, depth in (("bfs_reach_whole", 10_000), ("bfs_capped_whole", 2)):
        got = {r.node: r.level for r in registry.queries()[name](spark, str(tmp_path)).collect()}
        assert got == brute_levels(orders, depth)
    assert len(brute_levels(orders, 10_000)) > 20 > 12


def brute_body(text, title):
    t, cite = title.strip(), text.find("Example Press (EP),")
    head = text.rfind(t, 0, cite) if t and cite > 0 else text.find(t) if t else -1
    body = text[head + len(t) : cite if cite > head else None] if head >= 0 else ""
    return re.sub(r"\s+", " ", body).strip()[:6000]


def test_body_slice_gives_every_row_a_result(spark):
    sf = "/root/testdata/sf0.001"
    pages = registry.from_template(spark, sf).select("key", "p.text", "p.h1", "p.title").collect()
    got = {r.key: r.body for r in registry.queries()["body_slice_whole"](spark, sf).collect()}
    want = {r.key: brute_body(r.text, r.h1 or r.title.split("|")[0]) for r in pages}
    assert got == want and {k % 10 for k in got} == set(range(10))
