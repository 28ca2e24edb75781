"""Quality rules with adaptive thresholds, in DataFrame operations alone.

Each document gets counts, as integers. For every (language, source) the rates of the
documents that pass the base rules go into a mergeable quantile sketch: a histogram whose
cells keep the leading seven bits of a rate, so any quantile is off by less than 1/64 of
its value, cells are bounded in number, and merging is adding. Outlier fences read from it
(a quantile plus a multiple of the spread between two) become that group's thresholds, in
place of fixed cutoffs, and are joined back to filter. A spread counts as no smaller than
what chance makes among a few dozen words or lines, so a group in which all documents
are alike does not lose the next one that differs a little.

Edge cases: a null text has no words and fails; null languages and sources form groups of
their own; texts of any length are counted whole; repeated rows count each, and stay or go
together; a group without a document that passes the base rules has no thresholds and
keeps none; an empty table gives an empty result; further columns are ignored under any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

@dataclass(frozen=True)
class Fence:
    """Rates above the upper of two quantiles (in hundredths) by more than ``times`` their spread are outliers; with ``below`` also those as far under the lower one."""

    low: int
    high: int
    times: int
    least_spread: int
    below: bool = False


#: Symbols and word lengths vary in every document; repeats are rare, so their spread is that of the upper half.
FENCES = {"symbol_rate": Fence(25, 75, 3, 30), "dup_line_rate": Fence(50, 95, 3, 100), "repeat_rate": Fence(50, 95, 6, 25), "word_length": Fence(25, 75, 3, 400, True)}
#: Distinct (language, source) groups up to which their thresholds may be broadcast.
BROADCAST_GROUPS = 10_000
#: Parts into which a group's rows are dealt where the thresholds are too many to broadcast.
SALT = 16


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every document.

    Repeated 3-word windows are found inside the row: windows as three 64-bit hashes of
    words and a position are sorted, equal neighbours mark their positions, and marked
    positions cover up to three words each.
    """
    words = F.filter(F.split("text", SPACES), lambda x: x != "")
    h, n = F.col("hashes"), F.size("hashes") - 2
    windows = F.arrays_zip(*[F.slice(h, F.lit(k), n).alias(c) for k, c in ((1, "a"), (2, "b"), (3, "c"))], F.sequence(F.lit(1), n).alias("i"))
    t, p = F.col("windows"), F.col("starts")

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    repeated = F.sort_array(F.transform(F.filter(t, lambda x, k: equal(x, F.get(t, k + 1)) | equal(x, F.get(t, k - 1))), lambda x: x["i"]))
    covered = F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    keys = ["doc_id", "text_hash", "lang", "source"]
    counts = (("n", "n_words"), ("chars", "word_chars"), ("symbols", "n_symbols"), ("lines", "n_lines"), ("dups", "n_dup_lines"))
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "lang", "source", text_or_empty().alias("text"))
        .select(*keys, "text", words.alias("words"), lines.alias("lines"))
        .select(*keys, F.size("words").alias("n"), F.length(F.array_join("words", "")).alias("chars"), F.regexp_count("text", F.lit(SYMBOLS)).alias("symbols"), F.size("lines").alias("lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dups"), F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"))
        .select(*keys, *[c for c, _ in counts], F.when(F.size("hashes") >= 3, F.sort_array(windows)).otherwise(F.array()).alias("windows"))
        .select(*keys, *[c for c, _ in counts], repeated.alias("starts"))
        .select(*keys, *(F.col(c).cast("bigint").alias(a) for c, a in counts), covered.cast("bigint").alias("n_repeat_words"))
    )


#: The rates, all whole numbers: per 1000 words or lines, and 1000ths of a character.
RATES = {
    "symbol_rate": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_line_rate": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeat_rate": "1000 * n_repeat_words div greatest(n_words, 1)",
    "word_length": "1000 * word_chars div greatest(n_words, 1)",
}
BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"


def sketch(counts: DataFrame) -> DataFrame:
    """(lang, source, rate, cell, n): the mergeable sketch of the documents that pass the base rules. Cells of two sketches merge by adding n."""
    # Not a filter on the counts: pushed into their expressions it would repeat them.
    stack = ", ".join(f"'{k}', CASE WHEN NOT {BASE_FAILED} THEN {v} END" for k, v in RATES.items())
    rates = counts.select("lang", "source", F.expr(f"stack({len(RATES)}, {stack}) AS (rate, x)")).filter("x IS NOT NULL")
    low = F.expr("greatest(length(bin(x)) - 7, 0)").alias("low")
    cells = rates.select("lang", "source", "rate", "x", low).select("lang", "source", "rate", F.expr("shiftleft(shiftright(x, low), low)").alias("cell"))
    return cells.groupBy("lang", "source", "rate", "cell").agg(F.count("*").alias("n"))


def thresholds(cells: DataFrame) -> DataFrame:
    """(lang, source, max_ and where there is one min_ of each rate): the fences read from a sketch."""
    group = Window.partitionBy("lang", "source", "rate")
    summed = cells.withColumn("upto", F.sum("n").over(group.orderBy("cell"))).withColumn("total", F.sum("n").over(group))

    def quantile(rate: str, k: int) -> Column:
        return F.min(F.when((F.col("rate") == rate) & (F.col("upto") * 100 >= F.col("total") * k), F.col("cell")))

    ends = summed.groupBy("lang", "source").agg(*[quantile(r, k).alias(f"{r}_{k}") for r, f in FENCES.items() for k in (f.low, f.high)])
    out = []
    for r, f in FENCES.items():
        low, high = F.col(f"{r}_{f.low}"), F.col(f"{r}_{f.high}")
        spread = f.times * F.greatest(high - low, F.lit(f.least_spread))
        out += [(high + spread).alias(f"max_{r}")] + [(low - spread).alias(f"min_{r}")] * f.below
    return ends.select("lang", "source", *out)


def judge(docs: DataFrame) -> DataFrame:
    """The counts of every document with base_failed, kept and the thresholds that it was held against."""
    counts = keep(word_counts(docs), "counts")
    limits = thresholds(sketch(counts)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    base = counts.withColumn("base_failed", F.expr(BASE_FAILED))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    limits = keep(limits, "thresholds")
    if limits.count() <= BROADCAST_GROUPS:
        joined = base.join(F.broadcast(limits), same, "left")
    else:
        salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = base.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALT)).cast("int")).join(salted, same & (F.col("salt") == F.col("_salt")), "left").drop("salt", "_salt")
    within = [F.expr(RATES[r]) <= F.col(f"max_{r}") for r in FENCES] + [F.expr(RATES[r]) >= F.col(f"min_{r}") for r, f in FENCES.items() if f.below]
    verdict = within[0]
    for x in within[1:]:
        verdict = verdict & x
    return joined.drop("_lang", "_source").withColumn("kept", ~F.col("base_failed") & F.coalesce(verdict, F.lit(False)))


def filter_quality(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    kept = judge(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(docs.text) == F.col("_hash")), "left_semi")
