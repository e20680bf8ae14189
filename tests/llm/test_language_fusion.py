"""The fusion of evidence against a plain Python version; labels of many scripts; clashing names; long texts."""

import math
import random

import pytest
from pyspark.sql import functions as F
from reportloom.llm import common, language

WORDS = {"en": "the and of house river green walk with this that", "de": "der und die nicht haus fluss grün schön ist mit", "fr": "le la et maison été rivière vert avec cette être"}


def brute(rows, languages):
    """(lang, probability) of each row (host, suffix, domain, declared, loglik), counts made without the row itself."""
    n = len(languages)

    def softmax_top(logs):
        return 1 / sum(math.exp(x - max(logs)) for x in logs)

    told = [r["loglik"].index(max(r["loglik"])) if r["loglik"] and softmax_top(r["loglik"]) >= language.SURE and r["loglik"].index(max(r["loglik"])) < n - 1 else None for r in rows]
    values = {c: len({r[c] or "" for r, t in zip(rows, told) if t is not None}) for c in ("declared", "suffix")}
    out = []
    for i, r in enumerate(rows):
        others = [(x, t) for j, (x, t) in enumerate(zip(rows, told)) if j != i and t is not None]
        total = []
        for k in range(n - 1):
            mine = [x for x, t in others if t == k]
            p = (len(mine) + language.SMOOTH) / (len(others) + language.SMOOTH * (n - 1))
            for c in ("domain", "host"):
                here = sum((x[c] or "") == (r[c] or "") for x, _ in others)
                p = (sum((x[c] or "") == (r[c] or "") for x in mine) + language.PRIOR_WEIGHT * p) / (here + language.PRIOR_WEIGHT)
            s = (r["loglik"][k] if r["loglik"] else 0) + math.log(p) + math.log(1 - language.UNKNOWN_PRIOR)
            for c in ("declared", "suffix"):
                s += math.log((sum((x[c] or "") == (r[c] or "") for x in mine) + language.SMOOTH) / (len(mine) + language.SMOOTH * (values[c] + 1)))
            total.append(s)
        total.append(math.log(language.UNKNOWN_PRIOR) + (r["loglik"][n - 1] - math.log(values["declared"] + 1) - math.log(values["suffix"] + 1) if r["loglik"] else 0))
        best = total.index(max(total))
        known = r["loglik"] is not None or r["declared"] in languages[:-1]
        out.append((languages[best] if known else language.UNKNOWN, round(softmax_top(total), 6)))
    return out


@pytest.mark.parametrize("hot", [200_000, 3])
def test_fusion_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "SPLITS", 3)
    random.seed(5)
    docs = spark.createDataFrame([(k, " ".join(random.choices(WORDS[x].split(), k=30)), x, "s") for k, x in enumerate(list(WORDS) * 30)], "doc_id long, text string, lang string, source string")
    model = language.train(docs)
    pages = []
    for k in range(90):
        x = random.choice(list(WORDS))
        said = " ".join(random.choices(WORDS[x].split() + WORDS["en"].split()[:2], k=random.choice([0, 1, 2, 5, 30])))
        url = random.choice([f"https://a.example.{x}/", "https://www.big.example.org/x/", f"http://{x}.example.org/", None, "https://localhost/"])
        pages.append((k, url, random.choice([f'<html lang="{x}">', '<html lang="en">', "<html>"]) + f"<p>{said}</p>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    host = language.host_of(F.col("url"))
    rows = df.select("page_id", "url", host.alias("host"), language.suffix_of(host).alias("suffix"), language.domain_of(host).alias("domain"), "html")
    logs = [r.asDict() for r in language.likelihoods(rows, model, None, "html").orderBy("page_id").collect()]
    got = [(r.lang, r.probability) for r in language.identify_pages(df, docs).orderBy("page_id").collect()]
    for (a, p), (b, q) in zip(got, brute(logs, model.languages), strict=True):
        assert a == b and abs(p - q) < 2e-6


def test_clashing_columns_and_long_texts(spark):
    random.seed(6)
    rows = [(k, " ".join(random.choices(WORDS[x].split(), k=30)), x, "s", k, "a", 1, "b") for k, x in enumerate(list(WORDS) * 20)]
    rows += [(900, " ".join(random.choices(WORDS["de"].split(), k=200_000)), "de", "s", 0, "a", 1, "b"), (901, "x" * 300_000, "en", None, 0, "a", 1, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _id long, _h string, host int, told string")
    out = language.keep(df)
    assert out.columns == df.columns and {r.doc_id for r in out.select("doc_id").collect()} - {901} == {r[0] for r in rows} - {901}


def test_settings_are_restored(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    common.restored_batches(spark)
    before = spark.conf.get(name)
    df = spark.createDataFrame([(1, "the house", "en", "s")], "doc_id long, text string, lang string, source string")
    language.keep(df)
    assert spark.conf.get(name) == before
