"""Likeness of texts with very many equal word pairs."""

from pyspark.sql import functions as F
from reportloom.llm import fingerprints


def test_many_equal_pairs_do_not_wrap(spark):
    # 100,000 equal pairs, of which a third are replaced by other words.
    rows = [(1, "a " * 100_000), (2, "a " * 66_000 + " ".join(f"w{k}" for k in range(33_000)))]
    v = {r.doc_id: r.v for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one = spark.createDataFrame([(v[1], v[2])], "a array<long>, b array<long>")
    got = one.select(fingerprints.likeness(F.col("a"), F.col("b"))).first()[0]
    # One pair counts 100,000 and 66,000 times, the others hardly at all.
    assert abs(got - (1 - 34_000**2 / (100_000**2 + 66_000**2))) < 0.03
