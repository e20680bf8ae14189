"""Templates that look at all turns so far, in conversations of more than one piece."""

from reportloom.llm import chat


def run(spark, template, n):
    rows = [(1, k, ["user", "assistant"][k % 2], f"said {k}") for k in range(n)]
    return rows, chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template).orderBy("piece").collect()


def test_history_is_the_whole_conversation(spark):
    numbering = lambda ts: "".join(f"Turn {k}: {t}\n" for k, (_, t) in enumerate(ts))
    rows, got = run(spark, numbering, 150)
    assert "".join(r.formatted for r in got) == numbering([(r[2], r[3]) for r in rows]) and not any(r.rewritten for r in got)
    assert [r.formatted[a:b] for r in got for _, _, a, b in r.spans] == [r[3] for r in rows]
    last = lambda ts: "".join(f"{t}\n" for _, t in ts[-100:])
    assert any(r.rewritten for r in run(spark, last, 150)[1]) and not any(r.rewritten for r in run(spark, last, 90)[1])
    assert len(run(spark, chat.default_template, 150)[1]) == 3
