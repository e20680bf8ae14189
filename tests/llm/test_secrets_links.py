"""Weak keys that only an endpoint links."""

from reportloom.llm import secrets

KEY = "wJalrXUtnFEMI7K3MDENGbPxRfiCYEXAMPLEKEY1"


def test_endpoints_link_weak_keys(spark):
    assert len(KEY) == 40
    texts = [f"s3://bucket/x {KEY} end", f"endpoint: host.example.org\n{KEY}", f"{KEY} " + "word " * 100 + "https://a.example.org", f"https://a.example.org\n\n{KEY}", f"no link {KEY}: here"]
    found = [[k for _, _, k in secrets.scan_text(t)[1]] for t in texts]
    assert found == [["weak_key"], ["weak_key"], [], [], []]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[0] == "s3://bucket/x [weak_key] end" and KEY not in clean[1] and all(clean[k] == texts[k] for k in (2, 3, 4))


def test_endpoint_inside_another_part_is_no_complement():
    # A key inside an address is part of it, not next to it.
    assert secrets.scan_text(f"https://a.example.org/?k={KEY}")[1] == []
