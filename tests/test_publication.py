"""Published forms of three runs: order, carried lists, documents and their pointer."""

import json

from pyspark.sql import functions as F
from reportloom.plans.run import run
from reportloom.sources import files
from test_catalogue import PAGES, ROUNDS, TAX, made


def whole(folder):
    (part,) = [p for p in folder.iterdir() if p.name.startswith("part-")]
    return part.read_text(encoding="utf-8")


def test_three_runs(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert files.current(spark, root) is None
    more = [*PAGES, ("/10", "New report </script>", "", "2020-07-01", None, None, None)]
    days = ["2020-12-31", "2021-01-01", "2021-01-02"]
    last, runs = None, []
    for day, rows in zip(days, (PAGES, more, more)):
        out = f"{root}/{day}"
        runs.append(run(made(spark, rows), TAX, ROUNDS, "2020-12-31", f"{day}T00:00:00Z", out, last=last, root=root))
        last = files.current(spark, root)
        assert last == out
    shown = [[tuple(r) for r in x.additions.collect()] for x in runs]
    new = [("New report </script>", "/10", "2020-07-01", "2021-01-01")]
    assert shown == [[], new, new] and [x.changed for x in runs] == [True, True, False]
    assert [x.status.first()["new_this_run"] for x in runs] == [0, 1, 0]
    # The list in the order of ranks, counts by component, years from the data.
    lines = whole(tmp_path / days[1] / "reports_csv").splitlines()
    assert lines[0].startswith("﻿id,year,date") and [x.split(",")[0] for x in lines[1:]] == [str(k) for k in range(1, len(lines))]
    counts = whole(tmp_path / days[1] / "counts_csv").splitlines()
    years = sorted({r.year for r in runs[1].reports.collect() if r.year})
    assert counts[0] == "﻿component," + ",".join(map(str, years)) + ",total" and counts[1:] == sorted(counts[1:])
    told = json.loads(whole(tmp_path / days[1] / "reports_json_file"))
    assert told["count"] == len(told["reports"]) == len(lines) - 1 and [r["id"] for r in told["reports"]] == list(range(1, len(lines)))
    assert told["latest_additions"] == [dict(zip(("title", "url", "date", "added"), new[0]))] and told["regions"] == {"East": ["Borno"], "West": ["Sokoto"]}
    assert told["components"][-1] == {"key": "other", "label": "Other"} and told["generated_at"] == "2021-01-01T00:00:00Z"
    script = whole(tmp_path / days[1] / "reports_json_script")
    assert script.startswith("window.REPORT_DATA = {") and "</" not in script and script.rstrip().endswith("]};")
    assert json.loads(script[len("window.REPORT_DATA = ") :].strip()[:-1].replace("<\\/", "</")) == told
    facts = json.loads(whole(tmp_path / days[2] / "facts_file"))
    assert facts["pages"] == 9 and facts["pdf_read"] == 0 and list(facts["reports"]) == ["/1"]
    assert [f["label"] for f in facts["reports"]["/1"]["f"]] == [r.label for r in runs[2].figures.orderBy("ord").collect()]
    assert not (tmp_path / days[2] / "reports").exists()


def test_documents_of_no_rows_and_many(spark, tmp_path):
    for n in (0, 1, 25_000):
        df = spark.range(n).selectExpr("id", "concat('a</b>', id) AS t")
        files.write_script(df, f"file://{tmp_path}/{n}", "X", [F.col("id").desc()])
        text = whole(tmp_path / str(n))
        rows = json.loads(text[len("X = ") :].strip()[:-1].replace("<\\/", "</"))
        assert [r["id"] for r in rows] == list(range(n))[::-1] and "</" not in text
    files.write_json_lines(spark.range(3), f"file://{tmp_path}/lines")
    assert spark.read.json(f"file://{tmp_path}/lines").count() == 3


def test_digests_tell_what_changed(spark):
    from reportloom.operators import publish

    rows = [(f"/{k % 400}", None if k % 7 == 0 else f"t{k % 50}", k % 3) for k in range(3000)]
    columns = ["url", "t", "n"]
    frame = lambda r: spark.createDataFrame(r, "url string, t string, n int")
    old = frame(rows)
    prints = publish.digests(old, columns)
    assert publish.changed_buckets(prints, publish.digests(frame(rows[::-1]).repartition(7), columns)).count() == 0
    assert publish.changed_rows_of(old, frame(rows[::-1]), columns, prints, prints).collect() == []
    for new in (rows[1:], [*rows, rows[0]], [("/1", None, 1), *rows[1:]], [("/5", rows[0][2], rows[0][1] and 0), *rows], [], [(None, None, None), *rows]):
        df = frame([(a, None if b is None else str(b), c) for a, b, c in new])
        got = publish.changed_rows_of(old, df, columns, prints, publish.digests(df, columns))
        assert sorted(map(str, got.collect())) == sorted(map(str, publish.changed_rows(old, df, columns).collect())) and got.count() > 0
    # A null and its neighbour's value don't trade places unseen.
    a, b = frame([("/1", None, 1), ("/1", "1", None)]), frame([("/1", "1", 1), ("/1", None, None)])
    assert publish.changed_buckets(publish.digests(a, columns), publish.digests(b, columns)).count() == 1
