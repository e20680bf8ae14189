"""Toxicity: noisy-channel deobfuscation by Viterbi decoding under a character language model, then scoring.

A word with digits or signs among its letters, with letters that are repeated, or spelt with gaps between
single letters, becomes a lattice: each written character may stand for letters (leetspeak), for nothing (a separator) or for a
repeat of the letter before. Viterbi decoding under a character trigram model, whose counts come from all texts,
gives the likeliest word: exactly, over all states, for words of any length in linear time. A word with doubled letters also
reads without them; other plain words are their own only reading and are not decoded. A run of spelt letters is decoded as one
word, and each of its gaps may be nothing or a word boundary: all words of the best path and of those at most NEAR below it
count, as such a model alone doesn't tell well where words end. The restored text is scored by
evidence: words and word beginnings that labelled texts show to be toxic, chosen by a test whose level allows for the
number of candidates, so that chance doesn't make evidence when candidates are many; and what extends such a beginning
and is known well enough, for or against. Each distinct word counts by its most specific term: its log odds of toxic
against those of all texts are added up, and the score is their logistic function.

The labelled rows are at most TRAIN_ROWS, of least hash of id. Evidence is a part of those rows' words and bounded by
them alone; it and the trigram counts, of fixed size, go to the workers.

Defined results: a null or empty text scores the smoothed share of toxic rows that show no evidence, as do
all texts without evidence; without labels that is 0; repeated rows score alike; a doc_id with several labels counts
as toxic if one of them is; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, removed, table, texts, written

#: Bounds: labelled rows that are learnt from, code points of a word whose readings are kept in the cache, words in it, and
#: terms that a task counts before it hands them on.
TRAIN_ROWS = 200_000
LONGEST = 40
CACHED = 50_000
HELD_TERMS = 200_000
#: Letters of the longest word that is sought inside a spelt run; the whole run is a reading whatever its length.
SPELT_WORD = 40
#: Share of toxic texts above which a term can be evidence.
EVIDENT = 0.7
#: Labelled texts that a term which extends a beginning must have.
KNOWN = 4
#: Lengths of word beginnings that are evidence besides whole words.
STARTS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

#: What a written character may stand for; separators inside a word.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c"}
GAPS = " .-_*~'`·•,/"
#: Log costs of the channel: a sign read as a letter, a separator or sign read as nothing, a repeat read as nothing.
COST_LEET, COST_GAP, COST_REPEAT = -0.7, -0.3, -0.5
#: Log probability below that of the best path, up to which words of a spelt run are readings.
NEAR = 8.0

LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáçèéêëíîïñóôöùúûüß"
CODE = {c: k + 1 for k, c in enumerate(LETTERS)}
SIZE = len(LETTERS) + 1  # 0: word boundary and all else

_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"(?=[^\s]*[^\W\d_])(?:[^\W_]|[@$!|+€£(<*.\-_~'`·•]){3,40}")
_SIGN_IN = re.compile(r"[^\W\d_][0-9@$!|+€£(<*.\-_~'`·•]+[^\W\d_]|(?<![0-9@$!|€£])[0-9@$!|€£]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$!|€£]+", re.U)
_TWICE = re.compile(r"([^\W\d_])\1")
_REPEATS = re.compile(r"(.)\1+")
_SPACING = r"[\s.\-_*~'`·•,/]+"
_ONE = r"(?:[^\W_]|[@$!|€£(<+])"
_SPELT = re.compile(rf"{_ONE}(?=[\s.\-_*~'`·•,/])(?<![^\W_].)(?:{_SPACING}{_ONE}){{2,}}(?![^\W_])")
_SPELT_HINT = re.compile(rf"{_SPACING[:-1]}{_ONE}{_SPACING}{_ONE}(?![^\W_])")  # the second and third of a run: tells fast where there is none
_SPACES = re.compile(_SPACING)
_LETTER = re.compile(r"[^\W\d_]")
_BETWEEN = re.compile(r"[^\w@$!|+€£(<]+|_+")
_SUSPECT = re.compile(r"[0-9@$!|+€£(<*\-_~`·•]")


_TABLE = {}


def _codes(text: str) -> np.ndarray:
    """Letter codes of a lower-case text."""
    if not _TABLE:
        full = np.zeros(0x10000, np.uint8)
        for c, k in CODE.items():
            full[ord(c)] = k
        _TABLE["codes"] = full
    points = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    return _TABLE["codes"][points]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all texts: one array of fixed size a task, summed by letter pair in Spark."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    c = np.concatenate(([0, 0], _codes(t.lower()), [0])).astype(np.int32)
                    total += np.bincount(c[:-2] * (SIZE * SIZE) + c[1:-1] * SIZE + c[2:], minlength=SIZE**3)
        held = np.nonzero(total)[0]
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["gram", "n"])

    sums = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE**3)
    got = sums.toPandas()  # at most SIZE ** 3 rows, whatever the input
    out[got["gram"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a letter after two others, smoothed by pairs and single letters."""
    cube = counts.reshape(SIZE, SIZE, SIZE)
    single = cube.sum((0, 1)) + 1.0
    single /= single.sum()
    pair = cube.sum(0) + 20 * single
    pair /= pair.sum(1, keepdims=True)
    cube = cube + 20 * pair[None]
    return np.log(cube / cube.sum(2, keepdims=True))


class Channel:
    """Decodes written words under a letter model."""

    def __init__(self, logs: np.ndarray):
        self.logs = logs.tolist()
        self.seen: dict[str, str] = {}
        self.tokens: dict[str, tuple[str, ...]] = {}

    def options(self, c: str) -> list[tuple[int, float]]:
        """(letter code, log cost) readings of a written character; code -1 is nothing."""
        if c in CODE:
            return [(CODE[c], 0.0)]
        out = [(CODE[x], COST_LEET) for x in LEET.get(c, "")]
        if c in GAPS or not c.isalnum():
            out.append((-1, COST_GAP if c in GAPS else 2 * COST_GAP))
        return out or [(0, 0.0)]

    def decode(self, word: str) -> str:
        """The likeliest word behind a written one (lower case)."""
        if word in self.seen:
            return self.seen[word]
        logs = self.logs
        # A state is the last two letters; its value the best log probability and its path: (path before, letter), so that
        # paths share what they have in common and a word of any length takes linear time and memory.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for c in word:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (value, so_far) in states.items():
                for code, cost in self.options(c):
                    if code < 0:
                        steps = [((a, b), value + cost, so_far)]
                    else:
                        steps = [((b, code), value + cost + logs[a][b][code], (so_far, code))]
                        if code == b and code:
                            steps.append(((a, b), value + cost + COST_REPEAT, so_far))
                    for key, v, path in steps:
                        if key not in new or v > new[key][0]:
                            new[key] = (v, path)
            states = new
        path = max(((v + logs[a][b][0], path) for (a, b), (v, path) in states.items()), key=lambda x: x[0])[1]
        codes = []
        while path:
            path, code = path
            codes.append(code)
        out = "".join(LETTERS[k - 1] if k else " " for k in reversed(codes))
        if len(word) <= LONGEST:
            if len(self.seen) >= CACHED:
                self.seen.clear()
            self.seen[word] = out
        return out

    def spelt(self, run: str) -> set[str]:
        """Words of a run of single characters with gaps between them; gaps wider than the least are boundaries as well."""
        plain = _SPACES.sub("", run)
        word = plain if plain.isalpha() else self.decode(plain)
        out = {word}.union(*[self.segments(x) for x in word.split()])
        widths = [len(x) for x in _SPACES.findall(run)]
        if min(widths) < max(widths):
            wide = re.compile(_SPACING[:-1] + f"{{{min(widths) + 1},}}")
            for part in wide.split(run):
                part = _SPACES.sub("", part)
                if len(part) > 1:
                    out.add(part if part.isalpha() else self.decode(part))
        return out

    def segments(self, word: str) -> set[str]:
        """Words into which letters fall if any place between two may be a boundary, on paths at most NEAR below the best."""
        logs, n = self.logs, len(word)
        c = [0, 0, *[CODE.get(x, 0) for x in word], 0]
        # A word [i, j) of two letters or more costs begin[i] + inner[j] + end[j]; what stands before a boundary is known.
        inner = [0.0]
        for i in range(n):
            inner.append(inner[-1] + logs[c[i]][c[i + 1]][c[i + 2]])
        begin = [logs[c[i + 1]][0][c[i + 2]] + logs[0][c[i + 2]][c[i + 3]] - inner[i + 2] for i in range(n - 1)]
        end = [logs[c[j]][c[j + 1]][0] for j in range(n + 1)]
        single = [logs[c[i + 1]][0][c[i + 2]] + logs[0][c[i + 2]][0] for i in range(n)]
        # Best values up to each boundary, from it on (last), and from inside a word on (ahead).
        first, best = [0.0], -math.inf
        for j in range(1, n + 1):
            if j > 1:
                best = max(best, first[j - 2] + begin[j - 2])
            first.append(max(first[j - 1] + single[j - 1], best + inner[j] + end[j]))
        last, ahead = [0.0] * (n + 1), [-math.inf] * (n + 2)
        for i in range(n, -1, -1):
            if i < n:
                last[i] = max(single[i] + last[i + 1], begin[i] + ahead[i + 2] if i + 1 < n else -math.inf)
            ahead[i] = max(ahead[i + 1], inner[i] + end[i] + last[i])
        least = first[n] - NEAR
        out = set()
        for i in range(n - 1):
            if first[i] + last[i] >= least:
                j = i + 2
                while j <= min(n, i + SPELT_WORD) and first[i] + begin[i] + ahead[j] >= least:
                    if first[i] + begin[i] + inner[j] + end[j] + last[j] >= least:
                        out.add(word[i:j])
                    j += 1
        return out

    def of_word(self, word: str) -> tuple[str, ...]:
        """Readings of a run of letters, some of which are repeated: the likeliest if several are or one is thrice, and that without any repeats."""
        once = _REPEATS.sub(r"\1", word)
        return (once, self.decode(word)) if len(word) - len(once) > 1 else (once,)

    def of_token(self, token: str) -> tuple[str, ...]:
        """Readings of what stands between white space and has signs or digits among its letters."""
        if (known := self.tokens.get(token)) is not None:
            return known
        bare = token.strip(".,;:!?\"'()[]{}*-_~")
        out = set(self.decode(bare).split())
        if bare != token:
            out.update(_WORD.findall(self.decode(token)))
        # A separator may also stand between words.
        pieces = _BETWEEN.split(token)
        if len(pieces) > 1:
            for piece in pieces:
                if _SUSPECT.search(piece) and _SIGN_IN.search(piece):
                    out.update(self.decode(piece).split())
        readings = tuple(out)
        if len(token) <= LONGEST:
            if len(self.tokens) >= CACHED:
                self.tokens.clear()
            self.tokens[token] = readings
        return readings

    def of_text(self, text: str) -> set[str]:
        """Readings of the suspicious tokens and spelt runs of a lower-case text."""
        out: set[str] = set()
        if _SUSPECT.search(text):
            for token in set(text.split()):
                if not token.isalpha() and _SUSPECT.search(token) and _SIGN_IN.search(token):
                    out.update(self.of_token(token))
        for m in _SPELT.finditer(text) if _SPELT_HINT.search(text) else ():
            if _LETTER.search(m[0]):
                out |= self.spelt(m[0])
        return out

    def restored(self, text: str, words: set[str] | None = None) -> set[str]:
        """Readings of the suspicious words of a lower-case text; words are its runs of letters."""
        out = self.of_text(text)
        for word in set(_WORD.findall(text)) if words is None else words:
            if _TWICE.search(word):
                out.update(self.of_word(word))
        return out


class Known:
    """The terms of a text that are among those given, the most specific one of each word or reading."""

    def __init__(self, channel: Channel, given: set[str] | dict[str, float]):
        self.channel, self.given = channel, given
        self.first = {x[: STARTS[0]] for x in given}
        self.begins: dict[str, bool] = {}
        self.cache: dict[str, tuple[str, ...]] = {}

    def may_begin(self, start: str) -> bool:
        """Can a run of letters that begins so, or a reading of it, be a given term? A reading drops repeats alone, so it begins alike
        unless there is one."""
        found = start in self.first or _TWICE.search(start) is not None
        if len(self.begins) >= CACHED:
            self.begins.clear()
        self.begins[start] = found
        return found

    def term(self, word: str) -> str | None:
        if word in self.given:
            return word
        for k in reversed(STARTS):
            if len(word) > k and (x := f"{word[:k]}*") in self.given:
                return x
        return None

    def terms(self, text: str) -> set[str]:
        text = text.lower()
        first, k, begins, told = self.first, STARTS[0], self.begins, self.may_begin
        words = [w for w in set(_WORD.findall(text)) if (told(w[:k]) if (b := begins.get(w[:k])) is None else b)]
        cache, out = self.cache, set()
        for w in words:
            if (got := cache.get(w)) is None:
                readings = (w, *self.channel.of_word(w)) if _TWICE.search(w) else (w,)
                got = tuple({x for r in readings if r[:k] in first and (x := self.term(r))})
                if len(w) <= LONGEST:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[w] = got
            if got:
                out.update(got)
        out.update([x for r in self.channel.of_text(text) if r[:k] in first and (x := self.term(r))])
        return out


def terms(text: str, channel: Channel) -> set[str]:
    """Words of the restored text and, marked by a star, their beginnings."""
    text = text.lower()
    words = set(_WORD.findall(text))
    words |= channel.restored(text, words)
    longer = [w for w in words if len(w) > STARTS[0]]
    for k in STARTS:
        words.update([w[:k] + "*" for w in longer if len(w) > k])
    return words


def counted(labelled: DataFrame, logs: np.ndarray) -> DataFrame:
    """term, n, t: texts and toxic texts of rows (text, toxic) that have it, summed in each task before the shuffle. The term "" has all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, held = Channel(logs), {}

        def put() -> pa.RecordBatch:
            n = list(held.values())
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x >> 32 for x in n], pa.int64()), pa.array([x & 0xFFFFFFFF for x in n], pa.int64())], ["term", "n", "t"])
            held.clear()
            return out

        for batch in batches:
            for text, toxic in zip(texts(batch, 0), batch.column(1).to_pylist()):
                one = (1 << 32) + (toxic or 0)
                for x in terms(text, channel):
                    held[x] = held.get(x, 0) + one
                held[""] = held.get("", 0) + one
                if len(held) > HELD_TERMS:
                    yield put()
        if held:
            yield put()

    bounded_batches(labelled.sparkSession)
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
    return rows.mapInArrow(run, "term string, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def without(labelled: DataFrame, logs: np.ndarray, known: set[str]) -> tuple[int, int]:
    """(texts, toxic texts) of rows (text, toxic) that have none of the known terms."""
    sent = labelled.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n, t = Known(Channel(logs), sent.value), 0, 0
        for batch in batches:
            for text, toxic in zip(texts(batch, 0), batch.column(1).to_pylist()):
                if not of.terms(text):
                    n, t = n + 1, t + (toxic or 0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([t], pa.int64())], ["n", "t"])

    bounded_batches(labelled.sparkSession)
    got = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "n long, t long").agg(F.sum("n"), F.sum("t")).first()
    return got[0] or 0, got[1] or 0


def evidence(labelled: DataFrame, logs: np.ndarray) -> tuple[dict[str, float], float, float]:
    """(weight of each term of the model, log odds of all texts, share of toxic texts without evidence), from rows of text and toxic."""
    counts = written(counted(labelled, logs).where("n >= 3 OR term = ''"), "tox-counts")
    total = counts.where("term = ''").first()
    if total is None or not total["t"]:
        return {}, -20.0, 0.0
    counts = counts.where("n >= 3 AND term <> ''")
    base = total["t"] / total["n"]
    candidates = counts.where("t >= 3").count()
    # Log likelihood ratio of the term's own rate against the base rate, above the number of candidates.
    rate = F.col("t") / F.col("n")
    gain = F.col("t") * F.log(rate / base) + F.when(F.col("n") > F.col("t"), (F.col("n") - F.col("t")) * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    best = counts.where("t >= 3").where(rate > EVIDENT).where(gain > math.log(max(candidates, 1)) + 3).collect()  # bounded by TRAIN_ROWS
    model = {r["term"]: (r["n"], r["t"]) for r in best}
    known = set(model)
    starts = {r["term"][:-1] for r in best if r["term"][-1] == "*"}
    if starts:
        # What extends a beginning that is evidence, whichever way it speaks.
        of = labelled.sparkSession.createDataFrame([(x,) for x in sorted(starts)], "start string")
        for k in STARTS:
            more = counts.where(F.col("n") >= KNOWN).join(of.where(F.length("start") == k), F.substring("term", 1, k) == F.col("start"))
            model |= {r["term"]: (r["n"], r["t"]) for r in more.collect()}  # bounded by TRAIN_ROWS
    odds = math.log(base / (1 - base)) if base < 1 else 20.0
    weights = {k: math.log((t + 0.5 * base) / (n - t + 0.5 * (1 - base) + 1e-9)) - odds for k, (n, t) in sorted(model.items())}
    n, t = without(labelled, logs, known) if known else (total["n"], total["t"])
    return weights, odds, (t + 0.5 * base) / (n + 0.5)


class Scorer:
    def __init__(self, logs: np.ndarray, weights: dict[str, float], odds: float, rest: float):
        self.known, self.weights, self.odds, self.rest = Known(Channel(logs), weights), weights, odds, rest

    def score(self, text: str) -> float:
        found = self.known.terms(text)
        if not found:
            return self.rest
        total = self.odds + sum(sorted(self.weights[x] for x in found))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, total))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels (doc_id, toxic) of rows not held out are learnt."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    least = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    labelled = written(docs.select("doc_id", "text").join(least, "doc_id").select("text", "toxic"), "tox-train")
    logs = log_model(trigram_counts(docs))
    sent = docs.sparkSession.sparkContext.broadcast((logs, *evidence(labelled, logs)))
    removed(labelled)

    def make():
        scorer = Scorer(*sent.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in texts(batch, 1)], pa.float64())], ["doc_id", "score"])

        return work

    rows = docs.select("doc_id", "text")
    out = map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
