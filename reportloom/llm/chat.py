"""Chat formatting: a template is a black box from turns to text; the spans of turns are found by rendering.

Successive prefixes of a conversation are rendered and consecutive outputs compared: what a turn adds is its span. A
template whose output for a prefix is not a prefix of its next output rewrites history, and is told so instead of
giving wrong spans. Where the text lies inside a span is found by rendering the same turn with two probe texts.

Every prefix of the whole conversation is rendered, so that a template may look at all turns so far; this is quadratic in the
turns. A template that declares itself local (attribute local: what a turn adds depends on it and the one before alone) costs
linear work: conversations are cut into pieces of PIECE turns, each rendered with the turn before it as its context, so that
pieces are rendered apart and only joined at the end.

The default template marks turns as "### role: text </turn>" and escapes, in roles and texts, every character that
could begin a mark by a backslash, and the backslash itself; so the output can be read back.

Defined results: rows of a conversation are ordered by turn, null turns first, then by role and text; a null role is
the empty role, a null text the empty text; turns without a number are ordered in one task a conversation; a null conv_id is a conversation of its own; equal rows are turns of
their own; an empty table gives only what is added to it; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Turns that are rendered together.
PIECE = 64
PROBES = ("\ue000", "\ue001")
LEARNT = ("assistant",)
_CONTROL = re.compile(r"[\\#<:\n]")
_TEXT_CONTROL = re.compile(r"[\\#<]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\#<:\n]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.S)


def default_template(turns: list[Turn]) -> str:
    return "".join([f"### {_CONTROL.sub(_slash, role)}: {_TEXT_CONTROL.sub(_slash, text)} </turn>\n" for role, text in turns])


default_template.local = True


def _slash(m: re.Match) -> str:
    return "\\" + m[0]


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def rewrites(template: Template, turns: list[Turn]) -> bool:
    """Does the output of some prefix not begin the next one's?"""
    last = template([])
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(last):
            return True
        last = now
    return False


def located(template: Template, turns: list[Turn], context: list[Turn] = []) -> tuple[str, list[tuple[int, int, int, int]], bool]:  # noqa: B006
    """(output of turns after the context, for each turn the span's start and end and its text's start and end, whether history was rewritten)."""
    start = last = template(context)
    spans, rewritten = [], False
    for k, (role, text) in enumerate(turns):
        so_far = context + turns[:k]
        now = template(so_far + [(role, text)])
        rewritten |= not now.startswith(last)
        a, b = len(last) - len(start), len(now) - len(start)
        # Two probes differ where the text is, and there alone, whatever marks or characters stand around it.
        probe, other = (template(so_far + [(role, x)])[len(last) :] for x in PROBES)
        at = next((i for i, (x, y) in enumerate(zip(probe, other)) if x != y), -1)
        spans.append((a, b, a + at, b - (len(probe) - at - 1)) if at >= 0 else (a, b, b, b))
        last = now
    return last[len(start) :], spans, rewritten


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text and n, the turn's place in its conversation, from 0, in two levels: counts of ranges of turn
    numbers of a conversation, then the place in the range; so a long conversation is dealt over many tasks."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("range", F.floor(F.coalesce(F.col("turn").cast("double"), F.lit(-1e18)) / PIECE))
    sums = rows.groupBy("conv_id", "range").agg(F.count("*").alias("count"))
    before = F.coalesce(F.sum("count").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), before.alias("before"))
    place = F.row_number().over(W.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    placed = rows.withColumn("place", place)
    return placed.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).select("conv_id", "role", "text", (F.col("before") + F.col("place")).alias("n"))


def formatted(conversations: DataFrame, template: Template = default_template) -> DataFrame:
    """One row for each piece of PIECE turns, or for each conversation if the template isn't local: conv_id, piece, formatted, roles, spans, rewritten. spans hold, for each turn, start and end of its span
    and of its text, in code points of the piece's output; the outputs of a conversation's pieces joined in order are its output."""
    bounded_batches(conversations.sparkSession, 64)
    rows = numbered(conversations)
    local = getattr(template, "local", False)
    piece = F.floor(F.col("n") / PIECE) if local else F.lit(0).cast("long")
    turn = F.struct("n", "role", "text")
    # The last turn of a piece is also the context of the next.
    own = rows.select("conv_id", piece.alias("piece"), turn.alias("t"))
    lent = rows.where(F.col("n") % PIECE == PIECE - 1).select("conv_id", (piece + 1).alias("piece"), turn.alias("t"))
    pieces = (own.unionByName(lent) if local else own).groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    kind = pa.list_(pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for conv, k, turns in zip(*[batch.column(j).to_pylist() for j in range(3)]):
                context = [(t["role"], t["text"]) for t in turns if t["n"] < k * PIECE]
                mine = [(t["role"], t["text"]) for t in turns if t["n"] >= k * PIECE]
                if not mine:
                    continue
                text, spans, rewritten = located(template, mine, context)
                for to, x in zip(out, (conv, k, text, [r for r, _ in mine], [list(s) for s in spans], rewritten)):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.string())), pa.array(out[4], kind), pa.array(out[5], pa.bool_())], ["conv_id", "piece", "formatted", "roles", "spans", "rewritten"])

    kind_of = pieces.schema["conv_id"].dataType.simpleString()
    return pieces.mapInArrow(run, f"conv_id {kind_of}, piece long, formatted string, roles array<string>, spans array<array<long>>, rewritten boolean")


def read_back(output: str) -> list[Turn]:
    """The turns of an output of the default template."""
    turns, at = [], 0
    while at < len(output):
        m = _TURN.match(output, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation, from the formatted pieces, which stream through in order: no conversation is
    held whole, only the running digests of the one at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def put() -> None:
            if now:
                conv, turns, chars, size, a, b = now
                done.append((conv, turns, a.hexdigest(), chars, b.hexdigest(), size))

        def rows() -> pa.RecordBatch:
            columns = list(zip(*done))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        first, kind = True, pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, text, roles, spans, rewritten in zip(*[batch.column(j).to_pylist() for j in (0, 2, 3, 4, 5)]):
                if rewritten:
                    raise ValueError(f"the template rewrites history in conversation {conv}")
                if first or now[0] != conv:
                    put()
                    now, first = [conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()], False
                turns = read_back(text)
                now[1] += len(turns)
                now[3] += len(text)
                for role, said in turns:
                    now[4].update(f"{role}\n{said}\n".encode())
                for role, (_, _, a, b) in zip(roles, spans):
                    if role in LEARNT:
                        said = unescape(text[a:b])
                        now[2] += len(said)
                        now[5].update(said.encode())
            if len(done) >= 1000:
                yield rows()
                done = []
        put()
        if done:
            yield rows()

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    kind_of = pieces.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"conv_id {kind_of}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Fixed values of the query: a conversation whose texts look like marks.
ADDED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(formatted(rows.unionByName(spark.createDataFrame(ADDED, rows.schema))))
