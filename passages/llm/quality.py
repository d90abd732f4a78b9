"""Quality rules whose cut-offs come from the corpus itself.

Every text is measured; the measures of each language and source are gathered in quantile
sketches (counts per whole-number bucket, merged by adding), fences are read off the sketches,
and a join with the fences decides. A group with fewer than `least` documents uses the sketch of
its language, and a language with fewer uses that of all documents: both are sums of the same counts.

Cases: a null text counts as empty (no word: rejected); null languages and sources are groups of
their own; equal rows are judged alike; an empty table gives an empty table; other columns pass
through whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from passages.llm import text_arrays as ta
from passages.llm.storage import stored

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
REPEAT_WINDOW = 5
LEAST_GROUP = 50
#: Fences: the quartiles, `reach` times their distance beyond them, and a slack for groups whose
#: documents are all alike. Ratios count in thousandths, the mean word length in tenths.
REACH = 4
SLACK = {"symbols": 50, "repeated": 400, "length": 15}
BROADCAST_GROUPS = 20_000

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def measure_batch(column: pa.Array) -> np.ndarray:
    """MEASURES of every text, one row each."""
    out = np.zeros((len(column), len(MEASURES)), np.int64)
    with np.errstate(over="ignore"):
        hasher = _hasher()
        for first, end, data, offsets in ta.slices(column):
            start, stop, before = ta.words(data, offsets)
            n_words = np.diff(before)
            inside = ~ta.SPACE[data]
            prefix = hasher.prefix(data)
            hashes = hasher.between(prefix, start, stop)
            lines, repeated_lines = _lines(hasher, prefix, data, offsets, inside)
            out[first:end] = np.column_stack(
                [
                    n_words,
                    ta.count_of(inside & ta.code_points(data), offsets),
                    ta.count_of(SYMBOL[data], offsets),
                    lines,
                    repeated_lines,
                    _repeated_words(hashes, before),
                ]
            )
    return out


_CACHE: list = []


def _hasher() -> ta.Hasher:
    if not _CACHE:
        _CACHE.append(ta.Hasher(9))
    return _CACHE[0]


def _lines(hasher, prefix, data, offsets, inside) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them equal to an earlier one."""
    start, stop, before = ta.runs(data != 0x0A, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=marks[1:])
    full = marks[stop] > marks[start]
    start, stop, text = start[full], stop[full], text[full]
    lines = np.bincount(text, minlength=len(offsets) - 1)
    again = _seen(hasher.between(prefix, start, stop) + ta.mix((stop - start).astype(np.uint64)), text)
    return lines, np.bincount(text[again], minlength=len(offsets) - 1)


def _seen(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places in order of hash and text whose predecessor is equal: all but the first of each value."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    return order[1:][(h[1:] == h[:-1]) & (t[1:] == t[:-1])]


def _repeated_words(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Per text: words in windows of REPEAT_WINDOW words that occur at least twice in it."""
    counts = np.diff(before)
    windows, starts = ta.grams(hashes, before, REPEAT_WINDOW)
    if not len(windows):
        return np.zeros(len(counts), np.int64)
    text = np.repeat(np.arange(len(counts)), np.diff(starts))
    keys = ta.mix(windows ^ ta.mix(text.astype(np.uint64)))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = (np.arange(len(windows)) - starts[text] + before[text])[twice]
    change = np.zeros(len(hashes) + REPEAT_WINDOW + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + REPEAT_WINDOW, -1)
    covered = np.cumsum(change)[: len(hashes)] > 0
    total = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(covered, out=total[1:])
    return total[before[1:]] - total[before[:-1]]


def measure(docs: DataFrame) -> DataFrame:
    """row (all columns of the input), lang, source and MEASURES, without a shuffle."""
    narrow = docs.select(F.struct("*").alias("row"), *(F.col(c).cast("string") for c in ("lang", "source", "text")))
    return _measured(narrow)


def _measured(narrow: DataFrame) -> DataFrame:
    kept = [f for f in narrow.schema if f.name != "text"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure_batch(batch.column("text"))
            columns = [batch.column(c) for c in names] + [pa.array(found[:, k]) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *MEASURES])

    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in MEASURES)])
    return narrow.mapInArrow(run, schema)


def base_failed() -> Column:
    """The fixed rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def _ratios() -> dict[str, Column]:
    """Whole-number measures of a text that has a word."""
    at_least_one = lambda c: F.greatest(F.col(c), F.lit(1))
    return {
        "symbols": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
        "repeated": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "length": F.least(F.expr("10 * word_chars div greatest(n_words, 1)"), F.lit(1000)),
    }


def _group(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("null"))


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per language, source, measure and bucket, of the texts that pass the fixed rules."""
    ratios = _ratios()
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), v.cast("long").alias("bucket")) for k, v in ratios.items()))
    return (
        measured.where(~base_failed())
        .select(_group("lang").alias("lang_key"), _group("source").alias("source_key"), F.explode(pairs).alias("m"))
        .groupBy("lang_key", "source_key", "m.measure", "m.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(counts: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """One row per language and source with low_ and high_ of every measure."""
    levels = (
        counts.groupBy("measure", "bucket")
        .agg(F.sum("n").alias("n"))
        .select(F.lit("*").alias("lang_key"), F.lit("*").alias("source_key"), "measure", "bucket", "n")
        .unionByName(
            counts.groupBy("lang_key", "measure", "bucket")
            .agg(F.sum("n").alias("n"))
            .withColumn("source_key", F.lit("*"))
        )
        .unionByName(counts)
    )
    group = W.partitionBy("lang_key", "source_key", "measure")
    ranked = levels.select(
        "*",
        F.sum("n").over(group).alias("total"),
        F.sum("n").over(group.orderBy("bucket")).alias("upto"),
    )
    quartiles = ranked.groupBy("lang_key", "source_key", "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
    )
    reach = REACH * (F.col("q3") - F.col("q1"))
    slack = F.coalesce(*(F.when(F.col("measure") == k, F.lit(v)) for k, v in SLACK.items()))
    bounds = quartiles.select(
        "*", (F.col("q1") - reach - slack).alias("low"), (F.col("q3") + reach + slack).alias("high")
    )
    one = lambda side, k: F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{side}_{k}")
    wide = bounds.groupBy("lang_key", "source_key").agg(
        F.max("total").alias("total"), *(one(side, k) for k in SLACK for side in ("low", "high"))
    )
    # A small group takes the fences of its language, a small language those of all.
    ends = [f"{side}_{k}" for k in SLACK for side in ("low", "high")]
    own = F.struct("total", *ends)
    everything = wide.where("lang_key = '*'").select("total", *ends).first()
    of_all = F.struct(*(F.lit(everything[c] if everything else None).cast("long").alias(c) for c in ("total", *ends)))
    of_lang = wide.where("lang_key != '*' and source_key = '*'").select("lang_key", own.alias("of_lang"))
    of_both = wide.where("source_key != '*'").select("lang_key", "source_key", own.alias("of_both"))
    joined = of_both.join(of_lang, "lang_key")
    chosen = F.when(F.col("of_both.total") >= least, F.col("of_both")).otherwise(
        F.when(F.col("of_lang.total") >= least, F.col("of_lang")).otherwise(of_all)
    )
    return joined.select("lang_key", "source_key", chosen.alias("f")).select("lang_key", "source_key", "f.*").drop("total")


def judge(measured: DataFrame, found: DataFrame) -> DataFrame:
    """The measured rows with base_failed and kept."""
    few = found.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    keyed = measured.select("*", _group("lang").alias("lang_key"), _group("source").alias("source_key"))
    joined = keyed.join(F.broadcast(found) if few else found, ["lang_key", "source_key"], "left")
    ratios = _ratios()
    inside = (
        (ratios["symbols"] <= F.col("high_symbols"))
        & (ratios["repeated"] <= F.col("high_repeated"))
        & ratios["length"].between(F.col("low_length"), F.col("high_length"))
    )
    failed = base_failed()
    return joined.select(
        *(F.col(c) for c in measured.columns),
        failed.alias("base_failed"),
        (~failed & F.coalesce(inside, F.lit(True))).alias("kept"),
    )


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES, base_failed and kept of every document."""
    narrow = docs.select("doc_id", *(F.col(c).cast("string") for c in ("lang", "source", "text")))
    measured = stored(_measured(narrow))
    return judge(measured, stored(fences(sketches(measured)))).drop("lang", "source")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the fixed rules and the fences keep, with all their columns."""
    narrow = docs.select("lang", "source", "text")
    counts = sketches(_measured(narrow))
    found = stored(fences(counts))
    return judge(measure(docs), found).where("kept").select("row.*")
