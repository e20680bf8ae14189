"""Language ID: Bayesian fusion of a text's likelihoods with what its page declares, its address suffix and its host.

Texts: character trigrams of each language, learnt from at most TRAIN_ROWS labelled rows a language; the log
likelihood of a text is its mean a character times at most EFFECTIVE characters, so that long texts don't drown the
other evidence, though trigrams overlap. A further class, und, gives every symbol the same probability. Letters outside the Latin alphabet are classed by script
and hashed code point; those of a script that makes up less than RATE of a language's labelled letters speak against it, so that
scripts of no labelled language are und.
Declared language and suffix: P(value | language), smoothed, counted by grouped aggregation over the pages that their texts decide.
Host: a prior that is smoothed from all pages to domain, to host, each level by PRIOR_WEIGHT pages of the level above. A page's own
decision is taken out of all the counts that it is then judged by, and the suffix is evidence of its own, not a level of the prior.

Counts are sums by (level, key, language): a host with a third of all pages is summed in every task before the shuffle;
they are joined to rows of fixed size, never to texts. The model that is broadcast grows by 5 MB a labelled language.

Defined results: a text without letters (null or empty ones too) has no text evidence; if nothing else is known
either, its language is und. Without labelled rows all is und, and keep() keeps all. A null url, host or declaration is a value of its own. Equal rows give equal results; an
empty table gives an empty table; further columns are kept only by keep().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, restored_batches, split_join, table, texts, unused, written
from .html import extracted, host_of

#: Bounds and weights.
TRAIN_ROWS = 2_000
EFFECTIVE = 60
PRIOR_WEIGHT = 5.0
SMOOTH = 0.5
SURE = 0.95
UNKNOWN = "und"
#: Labels that are learnt, those with the most rows: each takes 9.5 MB on the driver and 4.8 MB of what is broadcast.
LABELS = 64
#: Share of texts in no known language, expected beforehand.
UNKNOWN_PRIOR = 0.01

LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëíîïìñóôöòõøœúûüùßÿ"
#: Scripts (code points from, up to) whose letters are classed apart; all other letters are one script more.
SCRIPTS = ((0x370, 0x400), (0x400, 0x530), (0x590, 0x900), (0x900, 0x1200), (0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7B0))
HASHED = 6
#: Share of a language's labelled letters from which a script is one of its own.
RATE = 0.05
DIGIT = len(LETTERS) + 1
OTHERS = len(LETTERS) + 2
SIZE = OTHERS + (len(SCRIPTS) + 1) * HASHED  # 0: space and signs, then the letters, digits, letters by script
#: Log probability of each symbol in no known language: the letters, signs, digits, and other letters as one.
FLAT = -float(np.log(len(LETTERS) + 3))
_CODE = np.zeros(0x10000, np.uint8)
for _c in range(0x10000):
    if chr(_c).isalpha():
        _s = next((k for k, (a, b) in enumerate(SCRIPTS) if a <= _c < b), len(SCRIPTS))
        _CODE[_c] = OTHERS + _s * HASHED + (_c * 2654435761 >> 16) % HASHED
    elif chr(_c).isdigit():
        _CODE[_c] = DIGIT
for _k, _x in enumerate(LETTERS):
    _CODE[ord(_x)] = _k + 1
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", re.I)
_META = re.compile(r"""<meta\b[^>]*?http-equiv\s*=\s*["']?content-language["']?[^>]*?content\s*=\s*["']?([A-Za-z]{2,3})""", re.I)


def grams(text: str) -> np.ndarray:
    """Trigram codes of a text, white space and signs squeezed into one symbol."""
    points = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), "<u2")
    c = _CODE[points].astype(np.int32)
    if len(c) > 1:
        c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    c = np.concatenate(([0], c, [0]))
    return c[:-2] * (SIZE * SIZE) + c[1:-1] * SIZE + c[2:] if len(c) > 2 else np.zeros(0, np.int32)


class Model:
    """Log probabilities of trigrams for each language, und last."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        logs = np.empty((SIZE**3, len(languages) + 1), np.float32)
        for k, c in enumerate(counts):
            cube = c.reshape(SIZE, SIZE, SIZE)
            single = cube.sum((0, 1)) + 0.5
            single /= single.sum()
            pair = cube.sum(0) + 5 * single
            pair /= pair.sum(1, keepdims=True)
            cube = cube + 5 * pair[None]
            logs[:, k] = np.log(cube / cube.sum(2, keepdims=True)).ravel()
            # Letters of a script that the labelled rows hardly use speak against the language.
            used = c.reshape(SIZE, SIZE, SIZE).sum((0, 2))
            letters = used[1:DIGIT].sum() + used[OTHERS:].sum()
            by = logs[:, k].reshape(SIZE, SIZE, SIZE)
            for at in range(OTHERS, SIZE, HASHED):
                if used[at : at + HASHED].sum() < RATE * letters or not letters:
                    by[:, :, at : at + HASHED] = np.minimum(by[:, :, at : at + HASHED], FLAT - 2)
        logs[:, -1] = FLAT
        self.logs = logs

    def likelihoods(self, text: str) -> list[float] | None:
        """Log likelihood of each class for at most EFFECTIVE characters, the best 0; None without letters."""
        g = grams(text)
        letters = (g // SIZE) % SIZE
        if not ((letters > 0) & (letters != DIGIT)).any():
            return None
        # Summed in pieces, in double precision, so that a very long text takes bounded memory.
        total = np.zeros(len(self.languages))
        for k in range(0, len(g), 100_000):
            total += self.logs[g[k : k + 100_000]].sum(axis=0, dtype=np.float64)
        total *= min(1.0, EFFECTIVE / len(g))
        return (total - total.max()).round(6).tolist()


def train(docs: DataFrame) -> Model:
    """A model from labelled rows (text, lang): for each of at most LABELS languages, those with the most rows, those of the least
    hashes of id, at most TRAIN_ROWS."""
    from pyspark.sql import Window as W

    bounded_batches(docs.sparkSession)
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h"), "lang", "text")
    # Buckets of the hash, whose counts tell how many of them hold enough rows, keep the window over few rows.
    sized = named.groupBy("lang", F.shiftrightunsigned("h", 54).alias("b")).count()
    most = [r["lang"] for r in sized.groupBy("lang").agg(F.sum("count").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LABELS).collect()]
    sized = sized.where(F.col("lang").isin(most))
    upto = sized.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("lang").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    wanted = upto.where(F.col("before") < TRAIN_ROWS).groupBy("lang").agg(F.max("b").alias("most"))
    few = named.join(F.broadcast(wanted.withColumnRenamed("lang", "l")), (F.col("lang") == F.col("l")) & (F.shiftrightunsigned("h", 54) <= F.col("most")))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 54), "h", "doc_id"))
    chosen = few.select("lang", "doc_id", "h").withColumn("place", place).where(F.col("place") <= TRAIN_ROWS).select(F.col("doc_id").alias("i"), F.col("lang").alias("k")).distinct()
    sample = few.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("k"))).select("lang", "text")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(SIZE**3, np.int64)
                held, n = np.unique(grams(text), return_counts=True)
                sums[lang][held] += n
        for lang, got in sums.items():
            held = np.nonzero(got)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held.astype(np.int32)), pa.array(got[held].astype(np.int64))], ["lang", "gram", "n"])

    rows = sample.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(rows["lang"]))
    counts = np.zeros((len(languages), SIZE**3))
    for k, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        counts[k, own["gram"].to_numpy(np.int64)] = own["n"].to_numpy(float)
    return Model(languages, counts)


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The last three labels of an address, or all if there are fewer: the unit between suffix and host."""
    return F.substring_index(F.regexp_replace(host, r"^(www|m|blog)\.", ""), ".", -3)


def fused(rows: DataFrame, languages: list[str]) -> DataFrame:
    """rows (key..., host, suffix, domain, declared, loglik) with lang and probability."""
    n = len(languages)
    known = languages[:-1]
    if not known:
        return rows.select("*", F.lit(n - 1).alias("text_lang"), F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("probability"))
    rows = written(rows.withColumn("text_lang", F.expr(_argmax("loglik", n))).withColumn("text_sure", F.expr(_softmax_top("loglik"))), "lang-rows")
    sure = rows.where((F.col("text_sure") >= SURE) & (F.col("text_lang") < n - 1))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.coalesce(F.col(c), F.lit("")).alias("value")) for k, c in enumerate(["declared", "suffix", "domain", "host"])])
    # All levels are counted at once; each row is one count of each level.
    counts = written(sure.select(F.explode(levels).alias("l"), "text_lang").groupBy("l.level", "l.value", "text_lang").agg(F.count("*").alias("n")), "lang-counts")
    wide = counts.groupBy("level", "value").agg(*[F.sum(F.when(F.col("text_lang") == k, F.col("n")).otherwise(0)).cast("double").alias(f"n{k}") for k in range(n - 1)])
    wide = wide.select("level", "value", F.array(*[f"n{k}" for k in range(n - 1)]).alias("n"))
    total = counts.where("level = 0").groupBy("text_lang").agg(F.sum("n").alias("n")).collect()  # a row a language
    by = {r["text_lang"]: float(r["n"]) for r in total}
    every = sum(by.values())
    out = rows
    for level, name in enumerate(["declared", "suffix", "domain", "host"]):
        key = F.coalesce(F.col(name), F.lit(""))
        # Rows of a hot host are dealt over tasks; a value that no sure page has keeps its rows by an empty count.
        counted = wide.where(F.col("level") == level).select("value", F.col("n").alias(f"{name}_n"))
        every_value = out.groupBy(key.alias("of")).agg(F.count("*").alias("rows")) if level > 1 else None
        if every_value is None:
            out = out.join(counted, key == F.col("value"), "left").drop("value")
        else:
            told = written(every_value.join(counted, F.col("of") == F.col("value"), "left").drop("value"), "lang-level")
            out = split_join(out.withColumn("key", key), "key", told, "of", "rows", rows.columns[0]).drop("key", "of")
    values = {level: counts.where(F.col("level") == level).select("value").distinct().count() for level in (0, 1)}
    # own is 1 where the row itself is one of the counts of language k.
    out = out.withColumn("told", F.expr(f"CASE WHEN text_sure >= {SURE}D AND text_lang < {n - 1} THEN text_lang ELSE -1 END"))
    any_own = "CAST(told >= 0 AS DOUBLE)"
    terms = []
    for k in range(n - 1):
        own = f"CAST(told = {k} AS DOUBLE)"
        at = lambda name: f"(coalesce({name}_n[{k}], 0D) - {own})"  # noqa: E731, B023
        size = lambda name: f"(coalesce(aggregate({name}_n, 0D, (a, x) -> a + x), 0D) - {any_own})"
        prior = f"(({by.get(k, 0.0)}D - {own} + {SMOOTH}D) / ({every}D - {any_own} + {SMOOTH * (n - 1)}D))"
        for name in ("domain", "host"):
            prior = f"(({at(name)} + {PRIOR_WEIGHT}D * {prior}) / ({size(name)} + {PRIOR_WEIGHT}D))"
        likely = lambda name, level: f"ln(({at(name)} + {SMOOTH}D) / ({by.get(k, 0.0)}D - {own} + {SMOOTH * (values[level] + 1)}D))"  # noqa: E731, B023
        terms.append(f"coalesce(loglik[{k}], 0D) + ln({prior}) + {likely('declared', 0)} + {likely('suffix', 1)} + ln({1 - UNKNOWN_PRIOR}D)")
    flat = " + ".join(f"ln(1D / {values[x] + 1})" for x in (0, 1))
    unknown = f"CASE WHEN loglik IS NULL THEN ln({UNKNOWN_PRIOR}D) ELSE loglik[{n - 1}] + ln({UNKNOWN_PRIOR}D) + {flat} END"
    out = out.withColumn("logp", F.expr(f"array({', '.join([*terms, unknown])})"))
    out = out.withColumn("best", F.expr(_argmax("logp", n))).withColumn("probability", F.round(F.expr(_softmax_top("logp")), 6))
    names = F.array(*[F.lit(x) for x in languages])
    known_any = F.col("loglik").isNotNull() | F.col("declared").isin(known)
    return out.withColumn("lang", F.when(known_any, F.element_at(names, F.col("best") + 1)).otherwise(F.lit(UNKNOWN)))


def _argmax(array: str, n: int) -> str:
    return f"coalesce(array_position({array}, array_max({array})) - 1, {n - 1}L)".replace("coalesce(array_position", "cast(coalesce(array_position") + " as int)"


def _softmax_top(array: str) -> str:
    """Probability of the best of an array of log values; 0 for none."""
    return f"coalesce(1D / aggregate({array}, 0D, (a, x) -> a + exp(x - array_max({array}))), 0D)"


def likelihoods(rows: DataFrame, model: Model, text: str | None, html: str | None) -> DataFrame:
    """The rows without text or html, with declared (from html) and loglik."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c not in (text, html)]
    at = rows.columns.index(html or text)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            told, logs = [], []
            for x in texts(batch, at):
                if html:
                    m = _LANG.search(x) or _META.search(x)
                    told.append(m[1].lower() if m else None)
                    x = extracted(x)
                logs.append(sent.value.likelihoods(x))
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            extra = [pa.array(told, pa.string())] if html else []
            return pa.RecordBatch.from_arrays([*columns, *extra, pa.array(logs, pa.list_(pa.float64()))], [*keep, *(["declared"] if html else []), "loglik"])

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return map_batches(rows, make, schema + (", declared string" if html else "") + ", loglik array<double>")


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, url, lang, probability, declared, text_lang for each page; docs (text, lang) are learnt from."""
    model = train(docs)
    host = host_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), suffix_of(host).alias("suffix"), domain_of(host).alias("domain"), "html")
    out = fused(likelihoods(rows, model, None, "html"), model.languages)
    name = F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.col("text_lang") + 1)
    return out.select("page_id", "url", "lang", "probability", "declared", name.alias("text_lang"))


def keep(docs: DataFrame, least: float = 0.5, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of docs (columns doc_id, text, lang, source) whose text is in some known language with at least this
    probability, summed over all of them, so that labels of one language ("en", "en-gb") don't stand in each other's way; columns
    as before. The column lang is what the row declares, its source what stands for its host. A row whose label isn't among those
    that were learnt (LABELS) is only rejected if it has no letters: nothing is known of its language."""
    model = train(learn_from if learn_from is not None else docs)
    if len(model.languages) == 1:
        restored_batches(docs.sparkSession)
        return docs
    source = F.coalesce(F.col("source"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), source.alias("host"), F.lit("").alias("suffix"), source.alias("domain"), F.lower("lang").alias("declared"), "text")
    found = fused(likelihoods(rows, model, "text", None), model.languages)
    i, h = unused(docs, "_id"), unused(docs, "_h")
    unknown = F.expr(f"exp(logp[{len(model.languages) - 1}] - array_max(logp)) / aggregate(logp, 0D, (a, x) -> a + exp(x - array_max(logp)))")
    learnt = F.col("declared").isNull() | F.col("declared").isin([x.lower() for x in model.languages[:-1]])
    out = found.where(F.col("loglik").isNull() | learnt & (1 - unknown < least)).select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    # Few rows are rejected: they are joined by what they are, and all others stay as they are.
    rejected = written(out, "lang-rejected")
    restored_batches(docs.sparkSession)
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left_anti")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
