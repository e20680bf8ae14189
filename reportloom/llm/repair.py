"""Conversation structure repair: the cheapest edits after which the roles follow the grammar (s?(ua)+)?.

Rows are dealt by the hash of their conversation and sorted; a task takes batches of whole conversations, and a recursive DuckDB query goes
over all conversations of a batch at once: each recursion advances one turn and keeps, for each conversation and grammar state, the
least (cost, audit). Equal costs are told apart by the audit. The same edits give the same state and cost, so of two unlike audits of one
state and cost none begins with the other, and the lesser one stays so whatever follows.

A conversation of more than LONG turns or CHARS characters is no group of one task: its rows are dealt by ranges of the order of turns
and cut into pieces; the query runs over each piece from every grammar state, and the pieces' cheapest ways from state to state are
folded in order, which needs a few letters a turn and no texts. Repeats are then found by the first turn of each (conversation,
role, text), joined with hot texts dealt over tasks. Only its digest, whose order is fixed, streams through one task, without being held.

Defined results: null role, text, and in the hashed key null conv_id and turn, are one space; a null conv_id is a conversation of its own;
null turns come first; rows of one turn are ordered by role, then text, by code points; repeated rows count each and are duplicates; a
row with an empty role has no initial, so that it can't be kept; gaps beyond 64 bits are null; an empty table gives an empty table; further columns aren't
read; long texts are read whole. All counts are of rows after damage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, split_join, table, written

#: Conversations up to these go through the query whole.
LONG = 256
CHARS = 8 << 20
#: Rows and bytes of what goes through the query at once, and rows of a piece of a long conversation.
ROWS = 4096
BYTES = 32 << 20
PIECE = 256
#: Order of texts inside a turn is dealt by this many characters of them.
LEAD = 64

#: Fixed values of the query: what edits cost, the grammar's steps from state to state ("-" is the start) and where it may end.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
CUT_OFF = 5
STEPS = {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
STATES, ENDS = "-sua", "-a"
ROLES = {"u": "user", "a": "assistant"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def inserted() -> list[tuple[str, str, str]]:
    """(state, state, letters) of no, one and two inserts; three never cost less than one."""
    out = [(q, q, "") for q in STATES]
    for _ in range(2):
        out += [(q, STEPS[t, x], e + "I") for q, t, e in out if len(e) == max(len(y[2]) for y in out) for x in ROLES if (t, x) in STEPS]
    return list(dict.fromkeys(out))


def moves() -> list[tuple[str, str, str, int, str, str]]:
    """(from, to, letters, cost, kind, initial that a kept row must have) of inserts and one row's edit."""
    out = []
    for q, t, e in inserted():
        paid = COST["I"] * len(e)
        out += [(q, STEPS[t, x], e + "K", paid + COST["K"], "K", x) for x in "sua" if (t, x) in STEPS]
        out += [(q, STEPS[t, x], e + "R", paid + COST["R"], "R", "") for x in ROLES if (t, x) in STEPS]
        out.append((q, t, e + "D", paid + COST["D"], "D", ""))
    return out


def endings() -> list[tuple[str, str, int]]:
    return [(q, e, COST["I"] * len(e)) for q, t, e in inserted() if t in ENDS]


def _values(rows: list[tuple]) -> str:
    return ", ".join(str(r) if len(r) > 1 else f"({r[0]!r})" for r in rows)


#: The rows of a batch by place, with their faults.
PLACED = r"""
CREATE OR REPLACE TEMP TABLE placed AS
WITH each AS (SELECT g, o, turn, role, text, earlier, unnest(range(n)) AS j FROM own),
seen AS (
  SELECT g, turn, text, left(role, 1) AS initial, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS before,
    earlier OR row_number() OVER (PARTITION BY g, role, text ORDER BY o, j) > 1 AS again
  FROM each WINDOW w AS (PARTITION BY g ORDER BY o, j))
SELECT g, turn, pos, initial, before, CASE
  WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
FROM seen
"""

#: Each recursion takes all conversations g, from each start, one turn on: for each state the least cost and audit.
BEST = f"""
WITH RECURSIVE best(g, start, state, pos, cost, audit) USING KEY (g, start, state) AS (
  SELECT g, start, start, 0::BIGINT, 0::BIGINT, '' FROM (SELECT DISTINCT g FROM placed), (SELECT unnest(?) AS start)
  UNION
  SELECT g, start, t, pos, least.cost, least.audit FROM (
    SELECT b.g, b.start, m.t, p.pos, min({{'cost': b.cost + m.cost + CASE WHEN p.fault = 'truncated' AND m.kind <> 'D' THEN {CUT_OFF} ELSE 0 END, 'audit': b.audit || m.letters}}) AS least
    FROM best b JOIN placed p ON p.g = b.g AND p.pos = b.pos + 1
    JOIN moves m ON m.f = b.state AND (m.kind = 'D' OR p.fault NOT IN ('blank', 'duplicate') AND (m.kind = 'R' OR m.initial = p.initial))
    GROUP BY b.g, b.start, m.t, p.pos))
SELECT g, start, state, cost, audit FROM best JOIN (SELECT g, max(pos) AS pos FROM placed GROUP BY g) USING (g, pos)
"""

#: What a batch tells of each conversation besides.
TOLD = """
SELECT g, coalesce(try_cast(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn) AS BIGINT), CASE WHEN count(turn) = 0 THEN 0 END) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, arg_min(initial, pos) AS head, arg_max(initial, pos) AS tail
FROM placed GROUP BY g
"""


class Query:
    """The DuckDB session of a task."""

    def __init__(self) -> None:
        import duckdb

        # In memory alone: what doesn't fit raises an error, nothing goes to the machine's folders.
        self.con = duckdb.connect(config={"threads": "1", "temp_directory": "", "memory_limit": "700MB"})
        self.con.execute("CREATE TABLE moves (f VARCHAR, t VARCHAR, letters VARCHAR, cost BIGINT, kind VARCHAR, initial VARCHAR)")
        self.con.execute(f"INSERT INTO moves VALUES {_values(moves())}")

    def over(self, rows: pa.Table, starts: str) -> tuple[dict[int, dict], dict[int, list[tuple]]]:
        """By conversation (or piece) g: what TOLD tells, and (start, state, cost, audit) of each pair that can be. rows: g, o, turn, role, text, n, earlier."""
        self.con.register("own", rows)
        self.con.execute(PLACED)
        told = self.con.execute(TOLD)
        names = [d[0] for d in told.description]
        facts = {r[0]: dict(zip(names, r)) for r in told.fetchall()}
        ways: dict[int, list[tuple]] = {}
        for g, *way in self.con.execute(BEST, [list(starts)]).fetchall():
            ways.setdefault(g, []).append(tuple(way))
        self.con.unregister("own")
        return facts, ways


def ended(ways: list[tuple[str, int, str]]) -> tuple[int, str]:
    """Least (cost, audit) over (state, cost, audit) with what must be inserted at the end."""
    return min((cost + paid, audit + letters) for state, cost, audit in ways for q, letters, paid in endings() if q == state)


class Repaired:
    """The digest of the repaired rows, from an audit and the rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.some = audit, 0, "-", hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True

    def _other(self) -> str:
        self.state = "a" if self.state == "u" else "u"
        return ROLES[self.state]

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(self._other(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._put(self._other(), text)
        elif edit == "K":
            self.state = role[:1]
            self._put(role, text)

    def hexdigest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


def _said(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: each row with the damage that its key's hash chooses, n times (0: dropped)."""
    d = F.crc32(F.concat(_said(F.col("conv_id")), F.lit(":"), _said(F.col("turn"))).cast("binary")) % 20
    role, text = _said(F.col("role")), _said(F.col("text"))
    changed = F.when(d <= 1, "").when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(d == 4, "user").otherwise(role).alias("role"), changed.alias("text"), F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("n"))


def _table(rows: pa.Table, groups: list[int], earlier: list[bool] | None = None) -> pa.Table:
    """What the query reads of rows (conv_id, turn, role, text, n)."""
    size = len(rows)
    return pa.table({"g": pa.array(groups, pa.int64()), "o": pa.array(range(size), pa.int64()), **{c: rows.column(c) for c in ("turn", "role", "text", "n")}, "earlier": pa.array(earlier or [False] * size)})


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations, of about ROWS rows or BYTES bytes."""
    held, size, load = [], 0, 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size, load = size + len(batch), load + batch.nbytes
        if size >= ROWS or load >= BYTES:
            rows = pa.concat_tables(held).combine_chunks()
            convs = rows.column(0).to_pylist()
            cut = next((k + 1 for k in range(size - 2, -1, -1) if convs[k] != convs[-1]), 0)
            if cut:
                yield rows.slice(0, cut)
            held, size = [rows.slice(cut)], size - cut
            load = load * size // (cut + size)
    if size:
        yield pa.concat_tables(held).combine_chunks()


def _schema(conv: str) -> str:
    return f"conv_id {conv}, " + ", ".join(f"{c} long" for c in COUNTS) + ", cost long, audit string, repaired_sha256 string"


def _output(kind: pa.DataType, out: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)


def short(rows: DataFrame) -> DataFrame:
    """The result for conversations that fit a batch: those of a hash partition go through the query many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = Query()
        for rows in _whole(batches):
            convs, times = rows.column(0).to_pylist(), rows.column(4).to_pylist()
            groups, bounds = [], []
            for k, c in enumerate(convs):
                if not k or c != convs[k - 1]:
                    bounds.append(k)
                groups.append(len(bounds) - 1)
            facts, ways = query.over(_table(rows, groups), "-")
            roles, said = rows.column(2).to_pylist(), rows.column(3).to_pylist()
            out = []
            for g, (a, b) in enumerate(zip(bounds, [*bounds[1:], len(convs)])):
                cost, audit = ended([w[1:] for w in ways[g]]) if g in ways else (0, "")
                made = Repaired(audit)
                for k in range(a, b):
                    for _ in range(times[k]):
                        made.row(roles[k], said[k])
                out.append((convs[a], *((facts[g][c] for c in COUNTS) if g in facts else [0] * len(COUNTS)), cost, audit, made.hexdigest()))
            yield _output(rows.schema.field(0).type, out)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, _schema(rows.schema["conv_id"].dataType.simpleString()))


def pieces(rows: DataFrame) -> DataFrame:
    """conv_id, part, piece (their order), counts, head, tail, ways: each piece of long conversations. rows: also earlier."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    way = pa.list_(pa.struct([("start", pa.string()), ("state", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, part, number, before = Query(), TaskContext.get().partitionId(), 0, None
        for batch in batches:
            # Arrow batches are small, so a piece ends with its batch; all of a batch's pieces go through the query together.
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            earlier, groups, firsts = batch.column(5).to_pylist(), [], []
            for k, key in enumerate(keys):
                if not firsts or key[0] != keys[k - 1][0] or k - firsts[-1] >= PIECE:
                    firsts.append(k)
                groups.append(len(firsts) - 1)
                earlier[k] = bool(earlier[k]) or key == before
                before = key
            facts, ways = query.over(_table(pa.Table.from_batches([batch]), groups, earlier), STATES)
            own = [g for g in range(len(firsts)) if g in facts]
            names = ["conv_id", "part", "piece", *COUNTS[1:], "head", "tail", "ways"]
            columns = [batch.column(0).take(pa.array([firsts[g] for g in own], pa.int64())), pa.array([part] * len(own), pa.int64()), pa.array([number + g for g in own], pa.int64())]
            columns += [pa.array([facts[g][c] for g in own], pa.string() if c in ("head", "tail") else pa.int64()) for c in names[3:-1]]
            columns.append(pa.array([[dict(zip(("start", "state", "cost", "audit"), w)) for w in ways[g]] for g in own], way))
            number += len(firsts)
            yield pa.RecordBatch.from_arrays(columns, names)

    # Ranges of texts are bounded by their first characters, so that sampling brings no long texts to the driver.
    lead = [F.substring(c, 1, LEAD) for c in ("role", "text")]
    dealt = rows.repartitionByRange("conv_id", "turn", *lead).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text", "n", "earlier")
    counts = ", ".join(f"{c} long" for c in COUNTS[1:])
    return dealt.mapInArrow(run, f"conv_id {conv}, part long, piece long, {counts}, head string, tail string, ways array<struct<start:string,state:string,cost:long,audit:string>>")


def folded(parts: DataFrame) -> DataFrame:
    """conv_id, counts without gaps, cost, audit of each conversation, from its pieces in order. What the ways of all
    states have in common is put aside, so that a fold costs the length of what they differ in."""
    conv = parts.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *COUNTS[1:], "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, done, tail, ways, kind, out = None, [0] * 4, [], None, {}, pa.int64(), []

        def put() -> None:
            cost, audit = ended([(q, *w) for q, w in ways.items()])
            out.append((now[0], *counts, cost, "".join(done) + audit))

        for batch in batches:
            kind = batch.schema.field(0).type
            for r in batch.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now is not None:
                        put()
                    now, counts, done, tail, ways = (r["conv_id"],), [0] * 4, [], None, {"-": (0, "")}
                counts = [a + r[c] for a, c in zip(counts, COUNTS[1:])]
                counts[3] += tail is not None and tail + r["head"] not in ("su", "ua", "au")
                tail, after = r["tail"], {}
                for w in r["ways"]:
                    if w["start"] in ways:
                        cost, audit = ways[w["start"]]
                        way = (cost + w["cost"], audit + w["audit"])
                        after[w["state"]] = min(after.get(w["state"], way), way)
                same = commonprefix([a for _, a in after.values()])
                done.append(same)
                ways = {q: (c, a[len(same) :]) for q, (c, a) in after.items()}
        if now is not None:
            put()
        if out:
            kinds = [kind, *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return dealt.mapInArrow(run, f"conv_id {conv}, " + ", ".join(f"{c} long" for c in COUNTS[1:]) + ", cost long, audit string")


def long(rows: DataFrame) -> DataFrame:
    """The result for conversations that are too long for a batch."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.where("n > 0")
    key = F.md5(F.concat_ws("\0", _said(F.col("conv_id")), F.col("conv_id").isNull().cast("string"), "role", "text").cast("binary"))
    keyed = rows.withColumn("key", key)
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    firsts = written(keyed.groupBy(F.col("key").alias("k")).agg(F.min(place).alias("first"), F.count("*").alias("rows")), "first-turns")
    marked = split_join(keyed, "key", firsts, "k", "rows", "turn")
    marked = written(marked.withColumn("earlier", place > F.col("first")).drop("key", "k", "first"), "long-turns")
    told = written(folded(written(pieces(marked), "pieces")), "audits")
    # A turn is counted once however often it occurs, first by turn, then by conversation.
    turns = marked.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("least"), F.count("turn").alias("some"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = F.when(F.col("some") == 0, F.lit(0).cast("long")).otherwise((wide("last") - wide("least") + 1 - wide("some")).try_cast("long"))
    told = told.join(turns.select(F.col("conv_id").alias("c"), gaps.alias("gaps")), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    # The audit stands before the conversation's rows and both stream by.
    first = told.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("n"), F.array(*COUNTS, "cost").alias("counts"))
    stream = first.unionByName(marked.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n", F.lit(None).cast("array<long>").alias("counts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, kind = None, [], pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for c, of, _, role, text, n, counts in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if of == 0:
                    if now:
                        out.append((now[0], *now[1], now[2].audit, now[2].hexdigest()))
                    now = (c, counts, Repaired(text))
                    continue
                for _ in range(n):
                    now[2].row(role, text)
        if now:
            out.append((now[0], *now[1], now[2].audit, now[2].hexdigest()))
        if out:
            yield _output(kind, out)

    dealt = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return dealt.mapInArrow(run, _schema(conv))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, counts, cost, audit, repaired_sha256 of each conversation. rows: conv_id, turn, role, text, n (times the row stands; 0: only its conversation counts)."""
    spark = rows.sparkSession
    bounded_batches(spark, PIECE * 4)
    sizes = rows.groupBy("conv_id").agg(F.sum("n").alias("many"), F.sum(F.length("text").cast("long")).alias("chars"))
    many = written(sizes.where((F.col("many") > LONG) | (F.col("chars") > CHARS)).select(F.col("conv_id").alias("c"), F.lit(True).alias("is_long")), "long-conversations")
    if many.isEmpty():
        return short(rows)
    told = rows.join(many, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return short(told.where("is_long IS NULL").drop("is_long")).unionByName(long(told.where("is_long").drop("is_long")))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


#: The same over whole tables, with crc32 by its polynomial.
OP13_SQL = rf"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: list_reduce(range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295::BIGINT)) % 20 AS d
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS j
  FROM hashed),
convs AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
seen AS (
  SELECT g, turn, role, text, left(role, 1) AS initial, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS before, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, j) > 1 AS again
  FROM hurt JOIN convs ON hurt.conv_id IS NOT DISTINCT FROM convs.conv_id WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, j)),
placed AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM seen),
inserted AS (FROM (VALUES {_values(inserted())}) v(f, t, letters)),
moves AS (FROM (VALUES {_values(moves())}) v(f, t, letters, cost, kind, initial)),
best(g, state, pos, cost, audit) AS (
  SELECT DISTINCT g, '-', 0::BIGINT, 0::BIGINT, '' FROM placed
  UNION ALL
  SELECT g, t, pos, least.cost, least.audit FROM (
    SELECT b.g, m.t, p.pos, min({{'cost': b.cost + m.cost + CASE WHEN p.fault = 'truncated' AND m.kind <> 'D' THEN {CUT_OFF} ELSE 0 END, 'audit': b.audit || m.letters}}) AS least
    FROM best b JOIN placed p ON p.g = b.g AND p.pos = b.pos + 1
    JOIN moves m ON m.f = b.state AND (m.kind = 'D' OR p.fault NOT IN ('blank', 'duplicate') AND (m.kind = 'R' OR m.initial = p.initial))
    GROUP BY b.g, m.t, p.pos)),
told AS (
  SELECT g, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS pos
  FROM placed GROUP BY g),
chosen AS (
  SELECT g, min({{'cost': b.cost + 5 * length(e.letters), 'audit': b.audit || e.letters}}) AS least
  FROM best b JOIN told USING (g, pos) JOIN inserted e ON e.f = b.state AND e.t IN ('-', 'a') GROUP BY g),
edits AS (SELECT g, unnest(range(1, length(least.audit) + 1)) AS k, least.audit AS audit FROM chosen),
letters AS (SELECT g, k, audit[k] AS edit, CAST(sum((audit[k] <> 'I')::INT) OVER (PARTITION BY g ORDER BY k) AS BIGINT) AS pos FROM edits),
lines AS (
  SELECT l.g, k, edit, CASE WHEN edit = 'K' THEN p.role END AS kept, CASE WHEN edit = 'I' THEN '' ELSE p.text END AS text, row_number() OVER (PARTITION BY l.g ORDER BY k) AS r
  FROM letters l LEFT JOIN placed p ON p.g = l.g AND p.pos = l.pos WHERE edit <> 'D'),
system AS (SELECT g, coalesce(max((kept[1] = 's')::INT), 0) AS s FROM lines GROUP BY g),
text AS (
  SELECT g, string_agg(coalesce(kept, CASE WHEN (r - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY k) AS text FROM lines JOIN system USING (g) GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(least.cost, 0) AS cost, coalesce(least.audit, '') AS audit, sha256(coalesce(text.text, '')) AS repaired_sha256
FROM convs LEFT JOIN told USING (g) LEFT JOIN chosen USING (g) LEFT JOIN text USING (g)
"""
