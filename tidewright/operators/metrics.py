"""Metric logs, run summaries, audits, rank statistics and tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..scratch import keep

METRICS = ["loss", "wer", "cer"]
#: Parts into which a global order is dealt, so that no single task holds it.
RANK_PARTS = 64


def to_long(wide: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """One row for each value that is there."""
    return wide.unpivot(ids, values, "metric", "value").filter("value IS NOT NULL")


def aggregates(log: DataFrame) -> DataFrame:
    """Validation rows without an id: the aggregate ones. An empty id is a real row."""
    return log.filter((F.col("split") == "val") & F.col("utterance_id").isNull())


def final_epoch(log: DataFrame, by: str = "run_id") -> DataFrame:
    """Each run's last epoch with its metrics as columns."""
    rows = aggregates(log)
    last = rows.groupBy(by).agg(F.max("epoch").alias("epoch"))
    return rows.join(last, [by, "epoch"]).groupBy(by, "epoch").pivot("metric", METRICS).agg(F.max("value"))


def series(log: DataFrame) -> DataFrame:
    """(epoch, val/loss, val/wer, val/cer): the series that may be written back."""
    wide = aggregates(log).groupBy("epoch").pivot("metric", METRICS).agg(F.max("value"))
    return wide.select("epoch", *[F.col(m).alias(f"val/{m}") for m in METRICS])


def audit(index: DataFrame) -> DataFrame:
    """A row for each split: counts, groups, hours, mean and exact 95th percentile of duration."""
    return index.groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct(F.nullif("video_id", F.lit(""))).alias("n_videos"), F.round(F.sum("duration_s") / 3600, 3).alias("hours"), F.round(F.avg("duration_s"), 4).alias("mean_s"),
        F.round(F.percentile("duration_s", 0.95), 4).alias("p95_s"), F.count_if(F.length("text_norm") > 0).alias("with_text"), F.count_if("selectable").alias("selectable"))


def ranked(df: DataFrame, value: str, name: str = "rank", by: str | None = None) -> DataFrame:
    """``df`` with the average rank of ``value`` (ties share their mean); a missing value (null, NaN) has none.

    Ranks come from the distinct values: rows before each value, summed over ranges of
    the value, so no task sorts all rows. Rows and ranges are written tables: all of their
    readers see the same ones, also where a value is a sum whose last bits the order of its
    terms decides, so that another evaluation would not find its own ranks.
    """
    return _ranked(keep(df, "rows"), value, name, by)


def _ranked(df: DataFrame, value: str, name: str, by: str | None = None) -> DataFrame:
    """``ranked`` for rows that every evaluation gives alike."""
    keys = [by] if by else []
    there = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = there.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    parts = keep(counts.repartitionByRange(RANK_PARTS, value).withColumn("_p", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.groupBy("_p", *keys).agg(F.sum("_n").alias("_t"))
    before = totals.withColumn("_b", F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    placed = parts.withColumn("_u", F.sum("_n").over(inside)).join(F.broadcast(before) if not by else before, ["_p", *keys])
    rank = placed.select(*keys, value, (F.col("_b") + F.col("_u") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(rank, [*keys, value], "left")


def numbered(df: DataFrame, order: list[str], name: str = "row", by: str | None = None) -> DataFrame:
    """``df`` with row numbers from 0 in the given order, over all rows or inside each ``by``.

    Rows are dealt by ranges of the order; each range's start is the sum of the counts
    before it, so no task numbers more than its range.
    """
    keys = [by] if by else []
    dealt = keep(df.repartitionByRange(RANK_PARTS, *keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_p", *keys).agg(F.count("*").alias("_c"))
    start = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", *keys, F.coalesce(F.sum("_c").over(start), F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*order)) - 1
    return dealt.withColumn("_i", inside).join(starts, ["_p", *keys]).withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the Mann-Whitney AUC over rows with a score; a single class is an error."""
    r = ranked(df.filter(F.col(label).isNotNull()).select(score, label), score).filter("rank IS NOT NULL")
    n1, n0 = F.sum(label), F.count("*") - F.sum(label)
    both = F.when(F.coalesce(n1 * n0, F.lit(0)) > 0, n1 * n0).otherwise(F.raise_error(F.lit("a single class")).cast("double"))
    return r.agg(((F.sum(F.when(F.col(label) == 1, F.col("rank"))) - n1 * (n1 + 1) / 2) / both).alias("auc"), F.sqrt((n1 + n0 + 1) / (12 * both)).alias("null_se"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, rho, over the rows that have both values."""
    both = df.select(a, b).filter(~F.isnan(F.coalesce(F.col(a).cast("double"), F.lit("NaN").cast("double"))) & ~F.isnan(F.coalesce(F.col(b).cast("double"), F.lit("NaN").cast("double"))))
    return _ranked(_ranked(keep(both, "rows"), a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("rho"))


def kendall(ranks: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Kendall's tau of two rankings of a few conditions (one row each): all pairs of conditions, by key."""
    x, y = ranks.alias("x"), ranks.alias("y")
    pairs = x.join(y, F.col(f"x.{key}") < F.col(f"y.{key}"))
    return pairs.agg(F.avg(F.signum(F.col(f"x.{a}") - F.col(f"y.{a}")) * F.signum(F.col(f"x.{b}") - F.col(f"y.{b}"))).alias("tau"))


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v is not None and v == v else None)


def z_scores(results: DataFrame, floor: str = "random") -> DataFrame:
    """(condition, n, mean, delta, z) against the floor's runs, with the floor's population deviation."""
    base = results.filter(F.col("condition") == floor).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count("*").alias("_n"))
    each = results.filter(F.col("condition") != floor).groupBy("condition").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    delta = F.col("mean") - F.col("_m")
    return each.join(F.broadcast(base)).select("condition", "n", "mean", delta.alias("delta"), (delta / (F.col("_s") * F.sqrt(1 / F.col("n") + 1 / F.col("_n")))).alias("z"))


def holm(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Step-down decisions over a family of tests (one row each): ``reject`` is true up to the first that fails."""
    order = Window.orderBy(p, "condition")
    m = F.count("*").over(Window.partitionBy())
    ok = F.col(p) <= alpha / (m - F.row_number().over(order) + 1)
    return tests.withColumn("_ok", ok).withColumn("reject", F.min("_ok").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_ok")


def tost(delta: Column, se: Column, margin: float) -> tuple[Column, Column]:
    """z values of the two one-sided tests for equivalence within +-margin."""
    return (delta + margin) / se, (delta - margin) / se


def consistent_direction(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("condition").agg((F.count_distinct(F.signum("delta")) == 1).alias("consistent"))


def bootstrap(values: DataFrame, key: str, value: str, rounds: int, seed: str) -> DataFrame:
    """(round, mean): each row counts Poisson(1) times in a round, by a hash of seed, round and key; sums are all that is shuffled."""
    from ..functions.numeric import uniform

    drawn = values.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    u = uniform(seed, F.concat_ws("|", F.col("round").cast("string"), F.col(key).cast("string")))
    cut = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    times = F.lit(0)
    for c in cut:
        times = times + (u >= c).cast("int")
    return drawn.withColumn("_w", times).groupBy("round").agg((F.sum(F.col("_w") * F.col(value)) / F.nullif(F.sum("_w"), F.lit(0))).alias("mean"))
