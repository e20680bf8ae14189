"""Large JSON in ranges of any size: equal to a whole-file read."""

import json
import random

import pytest
from reportloom.sources import bigjson


def odd(rng, depth=0):
    kinds = ["text", "number", "none", "bool"] + (["list", "map"] if depth < 3 else [])
    kind = rng.choice(kinds)
    if kind == "text":
        return "".join(rng.choices(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "a", "\n", "features", '\\"', "\U0001f600"], k=rng.randint(0, 6)))
    if kind == "number":
        return rng.choice([0, -1.5, 10**20, 1e-7])
    if kind in ("none", "bool"):
        return None if kind == "none" else rng.random() < 0.5
    if kind == "list":
        return [odd(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{j}" + rng.choice(["", '"', "\\", "{,"]): odd(rng, depth + 1) for j in range(rng.randint(0, 3))}


@pytest.mark.parametrize(("seed", "size"), [(1, 7), (2, 64), (3, 1), (4, 100_000), (5, 33)])
def test_map_equals_whole_read(spark, tmp_path, monkeypatch, seed, size):
    monkeypatch.setattr(bigjson, "MORE_BYTES", 5)
    rng = random.Random(seed)
    doc = {f"key {j}" + rng.choice(["", '"', "\\\\", "ü"]): odd(rng) for j in range(12 if size > 1 else 3)}
    text = json.dumps(doc, ensure_ascii=seed % 2 == 0, indent=[None, 1, "\t"][seed % 3])
    (tmp_path / "m.json").write_text(text, encoding="utf-8")
    got = [(r.key, json.loads(r.value)) for r in bigjson.entries(spark, str(tmp_path / "m.json"), range_bytes=size).collect()]
    assert sorted(got, key=str) == sorted(doc.items(), key=str)


@pytest.mark.parametrize("size", [11, 50, 100_000])
def test_named_list_equals_whole_read(spark, tmp_path, size):
    rng = random.Random(size)
    for k, items in enumerate([[odd(rng) for _ in range(15)], [], [[1], {"features": [2]}]]):
        doc = {"type": "features", "crs": {"features": [1, 2]}, "n": [1, [2]], "features": items, "after": {"a": [3]}}
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=k), encoding="utf-8")
        got = [json.loads(r.value) for r in bigjson.entries(spark, str(tmp_path / f"{k}.json"), "features", size).collect()]
        assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, items))


def test_edges(spark, tmp_path):
    for k, (text, rows) in enumerate([("{}", []), (" [ ] ", []), ("", []), ("3", []), ('{"a": 1}', [("a", "1")]), ('[1, "x"]', [(None, "1"), (None, '"x"')]), ('{"a":1,"a":2}', [("a", "1"), ("a", "2")])]):
        (tmp_path / f"{k}.json").write_text(text)
        got = [tuple(r) for r in bigjson.entries(spark, str(tmp_path / f"{k}.json"), range_bytes=2).collect()]
        assert sorted(got, key=str) == sorted(rows, key=str), text
    (tmp_path / "bad.json").write_text('{"a": [1}')
    (tmp_path / "cut.json").write_text('{"a": "1')
    assert bigjson.entries(spark, str(tmp_path / "0.json"), "nothing").collect() == []
    with pytest.raises(ValueError, match="close"):
        bigjson.entries(spark, str(tmp_path / "cut.json"), range_bytes=3)
