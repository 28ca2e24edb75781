"""Selectors: pools, budgets, top-k, quotas, seeded and weighted samples, manifests.

A selector takes a score table and gives ids. Ties are broken by id everywhere. Limits
are the feature here: a subset of fixed size is what is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..scratch import keep

KEY = "utterance_id"


def universe(index: DataFrame) -> DataFrame:
    return index.filter((F.col("split") == "trainval") & F.col("selectable"))


def budget(n: int, fraction: float) -> int:
    """Rows of a subset: half up."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    return int(n * fraction + 0.5)


def top_k(scores: DataFrame, column: str, k: int, descending: bool = True) -> DataFrame:
    """The k best rows by a column, missing values last; a partial top-k for each partition, never a full sort."""
    if column not in scores.columns:
        raise ValueError(f"no column {column}")
    if k <= 0:
        raise ValueError("budget must be positive")
    value = numeric.no_nan(F.col(column).cast("double"))
    return scores.orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), KEY).limit(k).select(KEY)


def round_robin(assigned: DataFrame, k: int, seed: str) -> DataFrame:
    """k ids, one from each cluster in turn, in seeded order inside a cluster."""
    if "cluster_id" not in assigned.columns:
        raise ValueError("no column cluster_id")
    turn = F.row_number().over(Window.partitionBy("cluster_id").orderBy(numeric.uniform(seed, F.col(KEY)), KEY))
    # No cluster gives more than k: a task keeps the first k of each as it reads, before anything is shuffled.
    return assigned.withColumn("turn", turn).filter(F.col("turn") <= k).orderBy("turn", "cluster_id").limit(k).select(KEY)


def uniform_sample(pool: DataFrame, k: int, seed: str) -> DataFrame:
    return pool.orderBy(numeric.uniform(seed, F.col(KEY)), KEY).limit(k).select(KEY)


def exact_sample(ids: list[str], k: int, seed: int) -> list[str]:
    """The draw of NumPy's default generator from the sorted pool: for reproducing small published subsets on the driver."""
    import numpy as np

    pool = sorted(ids)
    if not 0 < k <= len(pool):
        raise ValueError("budget out of range")
    return sorted(pool[i] for i in np.random.default_rng(seed).choice(len(pool), k, replace=False))


def gumbel_sample(weights: DataFrame, k: int, seed: str, logit: str = "score_logit") -> DataFrame:
    """k ids without replacement with chances proportional to exp(logit)."""
    if logit not in weights.columns:
        raise ValueError(f"no column {logit}")
    u = F.greatest(numeric.uniform(seed, F.col(KEY)), F.lit(2.0**-53))
    return weights.orderBy((F.col(logit) - F.log(-F.log(u))).desc(), KEY).limit(k).select(KEY)


def group_split(index: DataFrame, seed: str, target: int) -> DataFrame:
    """(utterance_id, part): whole groups go to "val" in seeded order until it has ``target`` rows, the rest to "train".

    The running total is over groups, summed by ranges of the seeded order.
    """
    from .metrics import RANK_PARTS

    rows = universe(index)
    groups = rows.groupBy("video_id").agg(F.count("*").alias("n")).withColumn("_u", numeric.uniform(seed, F.col("video_id")))
    dealt = keep(groups.repartitionByRange(RANK_PARTS, "_u", "video_id").withColumn("_p", F.spark_partition_id()), "groups")
    start = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("_p").agg(F.sum("n").alias("_t")).select("_p", F.coalesce(F.sum("_t").over(start), F.lit(0)).alias("_s"))
    inside = Window.partitionBy("_p").orderBy("_u", "video_id").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_s") + F.sum("n").over(inside) - F.col("n")
    part = dealt.join(F.broadcast(starts), "_p").select("video_id", F.when(before < target, "val").otherwise("train").alias("part"))
    return rows.select(KEY, "video_id").join(part, "video_id").select(KEY, "part")


def first_n(df: DataFrame, n: int, by: str = "split") -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(KEY))).filter(F.col("_rn") <= n).drop("_rn")


def held_out(df: DataFrame, every: int, by: str) -> DataFrame:
    """``held`` marks every n-th row of each class by id; a class of any size is numbered by ranges of its ids."""
    from .metrics import numbered

    return numbered(df, [KEY], "_place", by).withColumn("held", F.col("_place") % every == 0).drop("_place")


def band_pick(df: DataFrame, column: str, n: int, seed: str) -> DataFrame:
    """One row from each of n equal-count bands, in seeded order (bands are those of ntile: a distributed variant of picking by quantile)."""
    from .metrics import numbered

    total = df.count()
    size, more = divmod(total, n)  # the first ``more`` bands have one row more
    placed = numbered(df, [column, KEY], "_row")
    band = F.expr(f"CASE WHEN _row < {more * (size + 1)} THEN _row div {size + 1} + 1 ELSE {more} + (_row - {more * (size + 1)}) div {max(size, 1)} + 1 END")
    banded = placed.select("*", band.alias("band"), numeric.uniform(seed, F.col(KEY)).alias("_u")).drop("_row")
    first = banded.groupBy("band").agg(F.min(F.struct("_u", KEY)).alias("_f"))
    return banded.join(F.broadcast(first), "band").filter((F.col("_u") == F.col("_f._u")) & (F.col(KEY) == F.col(f"_f.{KEY}"))).drop("_u", "_f")


def characterize(ids: DataFrame, index: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row: k, realized_hours, n_videos, mean_entropy (null without a statistics table)."""
    joined = ids.select(KEY).distinct().join(index.select(KEY, "duration_s", "video_id"), KEY)
    if stats is not None:
        joined = joined.join(stats.select(KEY, "codebook_entropy"), KEY, "left")
    entropy = F.round(F.avg(numeric.no_nan(F.col("codebook_entropy"))), 4) if stats is not None else F.lit(None).cast("double")
    return joined.agg(F.count("*").alias("k"), F.round(F.sum("duration_s") / 3600, 3).alias("realized_hours"), F.count_distinct("video_id").alias("n_videos"), entropy.alias("mean_entropy"))


@dataclass(frozen=True)
class Selector:
    select: Callable[..., DataFrame]
    stochastic: bool
    table: str


ROSTER: dict[str, Selector] = {
    "dnsmos": Selector(lambda s, k, seed: top_k(s, "ovr_mos", k), False, "dnsmos_scores"),
    "kmeans": Selector(round_robin, True, "kmeans_assignments"),
    "dsir": Selector(gumbel_sample, True, "dsir_weights"),
    "lossrank": Selector(lambda s, k, seed: top_k(s, "loss_mean", k, descending=False), False, "proxy_scores"),
    "anti": Selector(lambda s, k, seed: top_k(s, "loss_mean", k), False, "proxy_scores"),
    "el2n": Selector(lambda s, k, seed: top_k(s, "el2n_mean", k), False, "proxy_scores"),
    "less_ctc": Selector(lambda s, k, seed: top_k(s, "influence", k), True, "less_influence"),
}


def select(name: str, scores: DataFrame, k: int, seed: str | None) -> DataFrame:
    """Run a registered selector; seeds are for stochastic ones, and only for these."""
    chosen = ROSTER[name]
    if chosen.stochastic != (seed is not None):
        raise ValueError(f"{name}: " + ("a seed is required" if chosen.stochastic else "a seed is not accepted"))
    return chosen.select(scores, k, seed)
