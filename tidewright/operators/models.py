"""Importance weights, clusters and influence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.arrays import distance, dot
from ..scratch import keep
from ..session import ship


def vectors(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, features) from (key, idx, val) rows; an array is as long as its key has features."""
    return sparse(rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "val"))).alias("f")), key, size)


def sparse(lists: DataFrame, key: str, size: int) -> DataFrame:
    """(key, features) of each row from (key, f), f an ascending array of (idx, val)."""

    def run(batches):
        for b in batches:
            n, i, v = b.num_rows, b.column(1).cast(pa.list_(pa.int32())), b.column(2)
            form = pa.StructArray.from_arrays([pa.array([0] * n, pa.int8()), pa.array([size] * n, pa.int32()), i, v], names=["type", "size", "indices", "values"])
            yield pa.record_batch([b.column(0), form], names=[key, "features"])

    schema = StructType([lists.schema[key], StructField("features", VectorUDT())])
    return lists.select(key, F.col("f.idx").cast("array<int>").alias("i"), F.col("f.val").alias("v")).mapInArrow(run, schema)


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """``weight``: n / (2 n_class). Class counts are a table of two rows."""
    n = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = n.agg(F.sum("_c").alias("_n"))
    return df.join(F.broadcast(n), label).join(F.broadcast(total)).withColumn("weight", F.col("_n") / (2 * F.col("_c"))).drop("_c", "_n")


#: Rows of one packed block, and coefficients in one slice of a gradient.
BLOCK_ROWS, SLICE = 1000, 8192
#: A fit ends when its coefficients are within this part of their length from the best ones.
TOLERANCE = 1e-6
_BLOCK = "keys label held ends idx val size".split()


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(key, label, held, features) as blocks of sparse rows."""
    for at in range(0, batch.num_rows, BLOCK_ROWS):
        key, label, held, features = batch.slice(at, BLOCK_ROWS).columns
        kind, size, idx, val = features.flatten()
        val = [np.asarray(v.values, np.float64) for v in val]
        idx = [np.asarray(i.values, np.int32) if k == 0 else np.arange(len(v), dtype=np.int32) for k, i, v in zip(kind.to_pylist(), idx, val, strict=True)]
        size = max(n or len(v) for n, v in zip(size.to_pylist(), val, strict=True))
        cells = [key.to_pylist(), np.asarray(label, np.float64), np.asarray(held.cast(pa.uint8())), np.cumsum([len(v) for v in val], dtype=np.int64), np.concatenate(idx), np.concatenate(val), size]
        kinds = [pa.list_(key.type), *[pa.binary()] * 5, pa.int32()]
        yield pa.record_batch([pa.array([c.tobytes() if isinstance(c, np.ndarray) else c], t) for c, t in zip(cells, kinds, strict=True)], names=_BLOCK)


def packed(rows: DataFrame, key: str) -> DataFrame:
    """Rows of (key, label, held, features) as a written table of blocks, which each pass of a fit reads."""
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    return keep(rows.select(key, "label", "held", "features").mapInArrow(lambda batches: (x for b in batches for x in _blocks(b)), f"keys array<{kinds[key]}>, label binary, held binary, ends binary, idx binary, val binary, size int"), "blocks")


def _arrays(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: labels, held, and of each value its row, its feature and itself."""
    ends = np.frombuffer(block["ends"], np.int64)
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return np.frombuffer(block["label"], np.float64), np.frombuffer(block["held"], np.uint8).astype(bool), row, np.frombuffer(block["idx"], np.int32), np.frombuffer(block["val"], np.float64)


@dataclass(frozen=True)
class Fit:
    """A logistic fit without intercept over all rows, or over those not held out; each class weighs the same."""

    l2: float
    held_out: bool


def _descent(size: int, l2: float):
    """L-BFGS as a generator: yields coefficients, is sent the loss and its gradient there, returns the best coefficients.

    The penalty makes the loss l2-strongly convex: |gradient| / l2 bounds the way to the minimum.
    """
    x, past = np.zeros(size), []
    f, g = yield x
    while np.linalg.norm(g) > TOLERANCE * max(l2, 1e-9) * max(1.0, np.linalg.norm(x)):
        d, back = -g, []
        for s, y, r in reversed(past):
            back.append(r * (s @ d))
            d = d - back[-1] * y
        if past:
            s, y, _ = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(past, reversed(back), strict=True):
            d = d + (a - r * (y @ d)) * s
        step = 1.0 if past else 1.0 / max(np.linalg.norm(g), 1.0)
        while True:
            there = x + step * d
            f2, g2 = yield there
            if f2 <= f + 1e-4 * step * (g @ d) or np.linalg.norm(g2) < np.linalg.norm(g):
                break
            step /= 2
            if step < 1e-12:
                return x  # no better point in the precision of a double
        s, y = there - x, g2 - g
        if s @ y > 0:
            past = [*past[-9:], (s, y, 1 / (s @ y))]
        x, f, g = there, f2, g2
    return x


def fitted(blocks: DataFrame, fits: list[Fit]) -> list[np.ndarray]:
    """The coefficients of each fit. All fits share their passes: a pass is one job, which reads each block once and sums gradients slice by slice."""

    def count(batches):
        for b in batches:
            for x in b.to_pylist():
                label, held, *_ = _arrays(x)
                yield pa.record_batch([pa.array([v]) for v in (x["size"], *(int(((label == c) & (held == h)).sum()) for c in (0, 1) for h in (False, True)))], names=["size", *"abcd"])

    size, *n = blocks.mapInArrow(count, "size bigint, a bigint, b bigint, c bigint, d bigint").agg(F.max("size"), *[F.sum(c) for c in "abcd"]).first()
    if not size:
        raise ValueError("no rows to fit")
    mass = []  # of a row of each class, all rows together 1
    for f in fits:
        each = [n[2 * c] + (0 if f.held_out else n[2 * c + 1]) for c in (0, 1)]
        mass.append([1 / (c * np.count_nonzero(each)) if c else 0.0 for c in each])

    def evaluate(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        def run(batches):
            total = {k: [0.0, np.zeros(size)] for k in points}
            for b in batches:
                for x in b.to_pylist():
                    label, held, row, idx, val = _arrays(x)
                    for k, w in points.items():
                        weight = np.where(label == 1, mass[k][1], mass[k][0]) * ~(held & fits[k].held_out)
                        z = np.bincount(row, w[idx] * val, len(label))
                        total[k][0] += float(weight @ (np.logaddexp(0, z) - label * z))
                        total[k][1] += np.bincount(idx, (weight * (np.exp(-np.logaddexp(0, -z)) - label))[row] * val, size)
            for k, (loss, g) in total.items():
                for at in range(0, size, SLICE):
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([loss if at == 0 else 0.0]), pa.array([g[at : at + SLICE].tobytes()])], names=["fit", "at", "loss", "g"])

        def add(table):
            g = np.sum([np.frombuffer(x, np.float64) for x in table["g"].to_pylist()], axis=0)
            return pa.table({"fit": table["fit"][:1], "at": table["at"][:1], "loss": [float(np.sum(table["loss"].to_numpy()))], "g": [g.tobytes()]}, schema=pa.schema([("fit", pa.int32()), ("at", pa.int32()), ("loss", pa.float64()), ("g", pa.binary())]))

        shape = "fit int, at int, loss double, g binary"
        parts = sorted(blocks.select("label", "held", "ends", "idx", "val").mapInArrow(run, shape).groupBy("fit", "at").applyInArrow(add, shape).collect(), key=lambda r: (r.fit, r.at))
        out = {}
        for k, w in points.items():
            mine = [r for r in parts if r.fit == k]
            out[k] = sum(r.loss for r in mine) + fits[k].l2 / 2 * float(w @ w), np.concatenate([np.frombuffer(bytes(r.g), np.float64) for r in mine]) + fits[k].l2 * w
        return out

    ways, best = [_descent(size, f.l2) for f in fits], {}
    points = {k: next(w) for k, w in enumerate(ways)}
    while points:
        asked, points = evaluate(points), {}
        for k, (f, g) in asked.items():
            try:
                points[k] = ways[k].send((f, g))
            except StopIteration as end:
                best[k] = end.value
    return [best[k] for k in range(len(fits))]


def _logits(blocks: DataFrame, key: str, coefficients: list[np.ndarray]) -> DataFrame:
    """(key, label, held, z): an array of each fit's logits."""

    def run(batches):
        for b in batches:
            for keys, x in zip(b.column("keys"), b.drop_columns(["keys"]).to_pylist(), strict=True):
                label, held, row, idx, val = _arrays(x)
                z = np.stack([np.bincount(row, w[idx] * val, len(label)) for w in coefficients], axis=1)
                z = pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), z.ravel())
                yield pa.record_batch([keys.values, pa.array(label), pa.array(held), z], names=[key, "label", "held", "z"])

    return blocks.mapInArrow(run, f"`{key}` {blocks.schema['keys'].dataType.elementType.simpleString()}, label double, held boolean, z array<double>")


def _both(pool: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return pool.select(key, "features", F.lit(0.0).alias("label")).unionByName(target.select(key, "features", F.lit(1.0).alias("label")))


def importance(pool: DataFrame, target: DataFrame, l2: float, key: str = "utterance_id") -> DataFrame:
    """(key, score_logit, weight) of pool rows: how target-like each is. Columns: key, features."""
    blocks = packed(_both(pool, target, key).withColumn("held", F.lit(False)), key)
    logits = _logits(blocks, key, fitted(blocks, [Fit(l2, False)])).filter("label = 0").select(key, F.col("z")[0].alias("score_logit"))
    top = logits.agg(F.max("score_logit").alias("_m"))
    return logits.join(F.broadcast(top)).select(key, "score_logit", F.exp(F.col("score_logit") - F.col("_m")).alias("weight"))


def sweep(pool: DataFrame, target: DataFrame, every: int, penalties: list[float], key: str = "utterance_id") -> list[dict]:
    """For each penalty: fit without every n-th row of each class, AUC and log loss on those; and the spread (deviation over mean) of the pool's weights by a fit on all rows. Features are made once, and all fits share their passes."""
    from ..functions.numeric import softplus_loss
    from .metrics import auc, numbered

    both = numbered(keep(_both(pool, target, key), "features"), [key], "place", "label").withColumn("held", F.col("place") % every == 0)
    blocks = packed(both, key)
    found = keep(_logits(blocks, key, fitted(blocks, [Fit(l2, held_out) for l2 in penalties for held_out in (True, False)])), "logits")
    out = []
    for i, l2 in enumerate(penalties):
        held = balanced(found.filter("held").select("label", F.col("z")[2 * i].alias("z")))
        loss = held.agg(F.sum(F.col("weight") * softplus_loss(F.col("z"), F.col("label"))) / F.sum("weight")).first()[0]
        logits = found.filter("label = 0").select(F.col("z")[2 * i + 1].alias("z"))
        weights = logits.join(F.broadcast(logits.agg(F.max("z").alias("_m")))).select(F.exp(F.col("z") - F.col("_m")).alias("weight"))
        spread = weights.agg(F.stddev_pop("weight") / F.avg("weight")).first()[0]
        out.append({"l2": l2, "held_out_auc": auc(held, "z", "label").first().auc, "held_out_logloss": loss, "weight_spread": spread})
    return out


def cluster(rows: DataFrame, k: int, seed: int, key: str, column: str) -> DataFrame:
    """(key, cluster_id, dist, cluster_size): k-means with the distance to the row's own centre."""
    data = rows.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=50).fit(data)
    centres = [c.tolist() for c in model.clusterCenters()]
    placed = model.transform(data).select(key, F.col("prediction").alias("cluster_id"), vector_to_array("features").alias("x"))
    own = F.get(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("cluster_id"))
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    return placed.withColumn("dist", distance(F.col("x"), own)).join(F.broadcast(sizes), "cluster_id").select(key, "cluster_id", "dist", "cluster_size")


def lloyd_step(rows: DataFrame, centres: list[list[float]], key: str, column: str) -> DataFrame:
    """(key, cluster_id, dist): the nearest of given centres (few, so they are constants of the plan); the first of equal ones."""
    x = F.col(column)
    each = F.array(*[F.struct(F.round(distance(x, F.array(*map(F.lit, c))), 9).alias("dist"), F.lit(i).alias("cluster_id")) for i, c in enumerate(centres)])
    return rows.withColumn("_b", F.array_min(each)).select(key, F.col("_b.cluster_id").alias("cluster_id"), F.col("_b.dist").alias("dist"))


def mean_vector(rows: DataFrame, column: str) -> DataFrame:
    """One row: the elementwise mean; what is shuffled is one row for each position and task."""
    each = rows.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def influence(rows: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``influence``: the dot product with the reference's mean vector."""
    return rows.join(F.broadcast(mean_vector(reference, column))).withColumn("influence", dot(F.col(column).cast("array<double>"), F.col("mean"))).drop("mean")
