"""Numbers stated in reports, each with its sentence."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import LABEL_SUBJECTS, METRICS, NUMBER, SUBJECTS, local_subject, number, subject, subject_place
from .spread import spread

#: Sentences of a report, by the rule that the source after a full one still adds its first new sentence.
SENTENCES = 45
#: Reports that a task reads at a time, and sentences of which it keeps what it found.
ROWS = 1000
KEPT = 20_000
SOURCES = ("page", "summary", "pdf")


def clean_page(text: Column, activities: list[str], place: str) -> Column:
    """Text without the block of page details before it and the closing "Cite as": what follows "Activity" and any
    activity names, else what follows the period or place line."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*Cite as\s*$", ""))
    head = F.substring(t, 1, 700)
    lead = F.regexp_extract(head, r"(?s)^(.*?\bActivity\s+)", 1)
    rest = F.substring(t, F.length(lead) + 1, F.length(t))
    longest = "|".join(sorted(activities, key=len, reverse=True))
    peeled = F.regexp_replace(rest, f"^(?:(?:{longest}) )+", "")
    other = F.regexp_extract(head, rf"(?s)^(.*?(?:Period Covered\s+\w{{3}} \d{{1,2}} \d{{4}}(?:\s+\w{{3}} \d{{1,2}} \d{{4}})?\s*|{place}\s*))", 1)
    details = F.substring(t, 1, 120).contains("View all bookmarks") | t.startswith("Share")
    return F.when(~details, t).when(lead != "", F.trim(peeled)).otherwise(F.trim(F.substring(t, F.length(other) + 1, F.length(t))))


def sentence_rows(df: DataFrame, keys: list[str], limit: int = SENTENCES) -> DataFrame:
    """keys, idx, text, source: distinct sentences of columns page, summary, pdf, in that order of trust. A source
    takes at most limit less what those before it took, but at least one."""
    return read(df, keys, limit, None).select(*keys, F.explode("s").alias("s")).select(*keys, F.col("s.idx").alias("idx"), F.col("s.text").alias("text"), F.col("s.source").alias("source"))


def figure_rows(df: DataFrame, keys: list[str], limit: int = SENTENCES, metrics: list[tuple[str, str]] = METRICS) -> DataFrame:
    """keys, ord, label, value, idx, subject, source: each (label, value, subject) of a report once, where it comes first, as figures()
    finds it in sentence_rows(), but in one pass and without a shuffle: a row of df is a report."""
    names = ("ord", "label", "value", "idx", "subject", "source")
    return read(df, keys, limit, metrics).select(*keys, F.explode("f").alias("f")).select(*keys, *[F.col(f"f.{x}").alias(x) for x in names])


_READ = "s array<struct<idx:int,text:string,source:string>>, f array<struct<ord:int,label:string,value:bigint,idx:int,subject:string,source:string>>"
_MATCHED = "m array<struct<idx:int,ord:int,label:string,pos:int,num:string,counts:boolean,who:string>>"


def _nested(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """An array of lists of structs from tuples, made column by column: a Python object for each struct costs more than its fields."""
    offsets, fields = [0], kind.value_type
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    columns = list(zip(*(x for r in rows for x in r))) or [()] * len(fields)
    parts = [pa.array(c, f.type) for c, f in zip(columns, fields)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(fields)), type=kind)


def _passed(df: DataFrame, keys: list[str], told: str, of: Callable[[list[tuple[str, str]]], tuple], limit: int, metrics: list[tuple[str, str]]) -> DataFrame:
    """keys and the columns told of each row, made by of(search, sentences) in one Arrow pass."""
    kinds = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(told).fields)
    arrow = [to_arrow_type(f.dataType) for f in kinds.fields[len(keys) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searched(metrics)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [of(search, distinct_sentences(texts, limit)) for texts in zip(*(batch.column(len(keys) + k).to_pylist() for k in range(len(SOURCES))))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[_nested(list(c), kind) for c, kind in zip(zip(*found), arrow)]], kinds.names)

    return spread(df.select(*keys, *SOURCES)).mapInArrow(run, kinds)


def read(df: DataFrame, keys: list[str], limit: int = SENTENCES, metrics: list[tuple[str, str]] | None = METRICS) -> DataFrame:
    """keys, s (sentences) and f (figures; empty without metrics) of each row, which has columns page, summary, pdf: every text is read once,
    by one Arrow pass with patterns compiled once a task. Null texts have no sentences."""

    def of(search: Searched, own: list[tuple[str, str]]) -> tuple:
        return [(k, t, x) for k, (t, x) in enumerate(own)], search.figures(own) if metrics else []

    return _passed(df, keys, _READ, of, limit, metrics or [])


def match_rows(df: DataFrame, keys: list[str], limit: int = SENTENCES, metrics: list[tuple[str, str]] = METRICS) -> DataFrame:
    """keys, idx, ord, label, pos, num, counts, who of each number before a metric's noun: what metric_matches() finds in sentence_rows(),
    is_count() and local_subject() say of it, from one reading of the texts; sentences are not sent through a second pass."""

    def of(search: Searched, own: list[tuple[str, str]]) -> tuple:
        return ([(idx, k, label, pos, num, counts, who) for idx, (text, _) in enumerate(own) for k, label, pos, num, counts, who in search.told(text)],)

    found = _passed(df, keys, _MATCHED, of, limit, metrics).select(*keys, F.explode("m").alias("m"))
    return found.select(*keys, "m.*")


_SIGNS = re.compile("[\ufffd\x00-\x08\x0b\x0c\x0e-\x1f\ue000-\uf8ff]")
#: The white space is one space by then; the pattern begins with it, so that a search leaps from space to space.
_ENDS = re.compile(r" (?<=[.;!?] )(?=[A-Z0-9(])")
_DIGIT = re.compile("[0-9]")
_NO_WORD = re.compile(r"\W+")
#: Bytes are translated many times faster than texts.
_DROPPED = bytes(k for k in range(128) if not (chr(k).isalnum() or chr(k) == "_"))


def distinct_sentences(texts: tuple[str | None, ...], limit: int) -> list[tuple[str, str]]:
    """(sentence, source) of a report, as sentences() cuts them and sentence_rows() chooses."""
    out: list[tuple[str, str]] = []
    seen: set[str] = set()
    for source, text in zip(SOURCES, texts):
        room, own = max(1, limit - len(out)) if out or source != SOURCES[0] else limit, {}
        if text and not (text.isascii() and text.isprintable()):
            text = _SIGNS.sub("", text)
        for t in _ENDS.split(" ".join((text or "").split())):
            t = t.strip(" ")
            if 25 <= len(t) <= 450 and _DIGIT.search(t):
                low = t.lower()
                own.setdefault((low.encode().translate(None, _DROPPED).decode() if low.isascii() else _NO_WORD.sub("", low))[:160], t)
        new = [(k, t) for k, t in own.items() if k not in seen][:room]
        seen.update(k for k, _ in new)
        out += [(t, source) for _, t in new]
    return out


#: NUMBER before white space, with a digit first, to which a search leaps.
_NUMBER = re.compile(r"\d(?:\d{0,2}(?:[ ,]\d{3})+|\d*(?:\.\d+)?)(?=\s)")
#: Where a number that is begun further right may end further right.
_ODD = re.compile(r"\d\d{3} \d{3}|\.\d+ \d{3}")
_MASKED = bytes.maketrans(b"123456789", b"000000000")


class Searched:
    """The patterns of a list of metrics, compiled for a task.

    A sentence's numbers are found once, not once a metric, and each metric's noun is tried where a number ends. What a sentence tells
    doesn't depend on which digits its numbers have (but for years and fractions, see told()), so the places found in one are kept for
    those that differ from it in digits alone; a noun pattern that names a digit ends that."""

    def __init__(self, metrics: list[tuple[str, str]]):
        self.patterns = [(k, label, stems(noun), re.compile(rf"({NUMBER})(\s+(?:\w+\s+){{0,2}}?(?:{noun})\b)", re.I)) for k, (label, noun) in enumerate(metrics)]
        self.nouns = [re.compile(rf"\s+(?:\w+\s+){{0,2}}?(?:{noun})\b", re.I) for _, noun in metrics]
        self.subjects = [(w, s) for w, s in SUBJECTS]
        self.masks = not any(_DIGIT.search(noun) for _, noun in metrics)
        self.kept: dict[bytes, list[tuple]] = {}

    def spans(self, text: str) -> list[tuple]:
        """(ord, label, pos, start, end of the number, end of the match) of each number before a metric's noun, by metric."""
        # The long s is the one letter that matches a stem's and that lower() leaves.
        low = text.lower().replace("\u017f", "s")
        wanted = [p for p in self.patterns if any(x in low for x in p[2])]
        if not wanted:
            return []
        if _ODD.search(text):
            return [(k, label, pos, m.start(), m.end(1), m.end()) for k, label, _, rx in wanted for pos, m in enumerate(rx.finditer(text))]
        numbers = [m.span() for m in _NUMBER.finditer(text)]
        out = []
        for k, label, _, _ in wanted:
            noun, free, pos = self.nouns[k].match, 0, 0
            for a, b in numbers:
                if a >= free and (m := noun(text, b)):
                    free = m.end()
                    out.append((k, label, pos, a, b, free))
                    pos += 1
                elif a < free < b:  # a match ends inside this number: what is left of it may begin another
                    return [(k, label, pos, m.start(), m.end(1), m.end()) for k, label, _, rx in wanted for pos, m in enumerate(rx.finditer(text))]
        return out

    def matches(self, text: str | None) -> Iterator[tuple]:
        """(ord, label, pos, before, num, noun, after) of each number before a metric's noun, by metric."""
        for k, label, pos, a, b, e in self.spans(text) if text else ():
            yield k, label, pos, text[max(0, a - 60) : a], text[a:b], text[b:e], text[e : e + 30]

    def judged(self, text: str) -> list[tuple]:
        """(ord, label, pos, start, end of the number, may it count, whom it is about) of each match, and last whom the sentence is about."""
        key = text.encode(errors="surrogatepass").translate(_MASKED) if self.masks else None
        if (found := self.kept.get(key)) is not None:
            return found
        found, about = [], None
        for k, label, pos, a, b, e in self.spans(text):
            before, after = text[max(0, a - 60) : a], text[e : e + 30]
            counts = not (_SHARE.search(text[a : e + 3]) or _AVERAGED.search(before[-22:].lower()))
            who = self.about(before, after, label)
            if about is None:
                about = subject_of(text)
            found.append((k, label, pos, a, b, counts, who, who or about))
        if key is not None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[key] = found
        return found

    def told(self, text: str) -> Iterator[tuple]:
        """(ord, label, pos, num, is_count(), local_subject()) of each match."""
        for k, label, pos, a, b, counts, who, _ in self.judged(text):
            num = text[a:b]
            yield k, label, pos, num, counts and num.isascii() and whole(num) is not None, who  # is_count() reads ASCII digits

    def figures(self, sents: list[tuple[str, str]]) -> list[tuple]:
        """(ord, label, value, idx, subject, source) of each (label, value, subject) once, where it comes first."""
        found: dict[tuple, tuple] = {}
        for idx, (text, source) in enumerate(sents):
            for _, label, _, a, b, counts, _, who in self.judged(text):
                if counts and (value := whole(text[a:b])) is not None and (label, value, who) not in found:
                    found[label, value, who] = (len(found), label, value, idx, who, source)
        return list(found.values())

    def about(self, before: str, after: str, label: str) -> str:
        """local_subject() of a match."""
        if label in LABEL_SUBJECTS:
            return LABEL_SUBJECTS[label]
        low, at, who = before.lower(), -1, ""
        for w, s in self.subjects:
            if (place := low.rfind(w)) > at:
                at, who = place, s
        if at >= 0:
            return "IDPs" if who == "displaced" and "internally displaced" in low[max(0, at - 12) : at + 25] else who
        tail = _DIGIT.split(after, maxsplit=1)[0].lower()
        return next((s for w, s in self.subjects if w in tail), "")


_SHARE = re.compile(r"\d\s*%|per ?cent", re.I)
_AVERAGED = re.compile(r"average|size of|\bper\b|ratio|rate of")


def whole(num: str) -> int | None:
    """A number that is no year and no fraction, else None."""
    if num.isdecimal():
        value = int(num)
        return None if 1900 <= value <= 2035 else int(float(value))
    value = float(num.replace(" ", "").replace(",", ""))
    return None if value != int(value) or 1900 <= value <= 2035 and "," not in num else int(value)


def subject_of(sentence: str) -> str:
    """subject() of a text."""
    t = sentence.lower()
    back, idp = "returnee" in t or "returned" in t, "idp" in t or "internally displaced" in t
    if back or idp:
        return "" if back and idp else "returnees" if back else "IDPs"
    return "displaced" if "displaced" in t or "fled" in t else "arrivals" if "arriv" in t else ""


def stems(noun: str) -> list[str]:
    """A literal beginning of each alternative of a noun pattern."""
    out = []
    for part in re.split(r"\|(?![^()]*\))", noun):
        literal = re.match(r"[A-Za-z -]*", part)[0]
        out.append((literal[:-1] if part[len(literal) :].startswith("?") else literal).lower())
    return out


def metric_matches(df: DataFrame, text: str = "text", metrics: list[tuple[str, str]] = METRICS) -> DataFrame:
    """The rows with ord (the metric's place), label, pos, before, num, noun, after of each number before a metric's noun.

    before is what stands in the 60 characters ahead of the number, after what follows the whole match. One pass over Arrow
    batches: the patterns are compiled once a task, and those without a stem in the sentence are skipped. As expressions, matches with
    their places take a plan of 22 nested searches that outgrows generated code. A null text has no matches."""
    at = df.columns.index(text)
    names = ["ord", "label", "pos", "before", "num", "noun", "after"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searched(metrics)
        for batch in batches:
            found = [(n, *m) for n, s in enumerate(batch.column(at).to_pylist()) for m in search.matches(s)]
            rows, *columns = list(zip(*found)) or [()] * (len(names) + 1)
            kept = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, t) for c, t in zip(columns, kinds)]], [*batch.schema.names, *names])

    told = T.StructType([*df.schema.fields, *[T.StructField(n, T.IntegerType() if n in ("ord", "pos") else T.StringType()) for n in names]])
    return df.mapInArrow(run, told)


def is_count(before: Column, num: Column, noun: Column, after: Column) -> Column:
    """Not a year, a share, an average, a rate or a fraction."""
    value = number(num)
    year = value.between(1900, 2035) & ~num.contains(",")
    percent = F.concat(num, noun, F.substring(after, 1, 3)).rlike(r"(?iuU)\d\s*%|per ?cent")
    averaged = F.lower(F.right(before, F.lit(22))).rlike(r"(?U)average|size of|\bper\b|ratio|rate of")
    return value.isNotNull() & ~year & ~percent & ~averaged & (value == F.floor(value))


def figures(sents: DataFrame, keys: list[str], metrics: list[tuple[str, str]] = METRICS) -> DataFrame:
    """keys, ord, label, value, idx, subject, source: each (label, value, subject) of a report once, where it comes first."""
    hits = metric_matches(sents, "text", metrics).where(is_count(F.col("before"), F.col("num"), F.col("noun"), F.col("after")))
    who = local_subject(F.col("before"), F.col("after"), F.col("label"), F.col("_best"))
    told = hits.select("*", subject_place(F.col("before")).alias("_best")).select("*", who.alias("_who")).withColumn("subject", F.when(F.col("_who") != "", F.col("_who")).otherwise(subject(F.col("text")))).withColumn("value", number(F.col("num")).cast("long"))
    first = told.groupBy(*keys, "label", "value", "subject").agg(F.min(F.struct("idx", "ord", "pos", "source")).alias("f"))
    order = F.row_number().over(W.partitionBy(*keys).orderBy("f.idx", "f.ord", "f.pos")) - 1
    return first.select(*keys, order.alias("ord"), "label", "value", F.col("f.idx").alias("idx"), "subject", F.col("f.source").alias("source"))


def index(df: DataFrame, keys: list[str], limit: int = SENTENCES, metrics: list[tuple[str, str]] = METRICS) -> DataFrame:
    """keys, s, f of each row that has sentences, in order, as indexed() gives them for reports: one pass, nothing is shuffled."""
    out = read(df, keys, limit, metrics).where(F.size("s") > 0)
    figure = lambda x: F.struct(*[x[n].alias(n) for n in ("label", "value", "idx", "subject", "source")])
    return out.select(*keys, F.transform("s", lambda x: x["text"]).alias("s"), F.when(F.size("f") > 0, F.transform("f", figure)).alias("f"))


def indexed(sents: DataFrame, figs: DataFrame, key: str = "url") -> DataFrame:
    """One row for each report that has sentences: s and f, in order."""
    s = sents.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("s"))
    f = figs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label", "value", "idx", "subject", "source"))), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"), x["idx"].alias("idx"), x["subject"].alias("subject"), x["source"].alias("source"))).alias("f"))
    return s.join(f, key, "left")
