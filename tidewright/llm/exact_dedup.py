"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters over (leading bytes, digest,
id), so equal texts are neighbours and a group of any size spreads over as many partitions
as it needs. Each partition is sorted externally by (leading bytes, digest, whole bytes,
id) and scanned once, comparing whole neighbouring texts. Runs that touch a partition's
edge are settled in a second, small step: at most two of them for each partition.

Edge cases: a null text counts as empty; null ids sort before all others, so they stay
only if the group has no other id; of rows that repeat an id exactly one stays; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep as keep_table
from .common import mapped, partitions, text_or_empty

#: Leading bytes of the normalised text that the splitters see; the digest decides beyond.
LEADING = 24


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), pc.ascii_lower(b.column(1)).cast(pa.binary())], names=["id", "norm"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: its run in this partition, its place in the run, and what only the run's end knows.

    Of the open run only ids are held. The text itself goes along with one row of the
    first and of the last run of the partition.
    """
    part, run = TaskContext.get().partitionId(), 0
    ids: list = []
    last = digest = None

    def closed(end: bool) -> pa.RecordBatch:
        n, edge = len(ids), end or run == 0
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([run] * n, pa.int64()), pa.array(range(1, n + 1), pa.int64()), pa.array([n] * n, pa.int64()), pa.array([ids[-1]] * n, pa.int64()), pa.array([digest] * n, pa.binary()), pa.array([edge] * n), pa.array([None] * (n - 1) + [last if edge else None], pa.binary())],
            names=["id", "part", "run", "place", "size", "last_id", "sha", "edge", "edge_text"],
        )

    out: list[pa.RecordBatch] = []
    for b in batches:
        norm, new_ids, shas = b.column("norm"), b.column("id").to_pylist(), b.column("sha")
        if not len(norm):
            continue
        same = [last is not None and norm[0].as_py() == last, *pc.equal(norm[1:], norm[:-1]).to_pylist()]
        start = 0
        for i in [j for j, s in enumerate(same) if not s]:
            ids += new_ids[start:i]
            if ids:
                if i:
                    last = norm[i - 1].as_py() if start < i else last
                out.append(closed(False))
                run += 1
            ids, start, digest, last = [], i, shas[i].as_py(), None
        ids += new_ids[start:]
        last = norm[len(norm) - 1].as_py()
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            out = []
    if ids:
        yield closed(True)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stays: str = "min") -> DataFrame:
    """A row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only. ``stays``: "min" or
    "max", which id of a group stays.
    """
    if stays not in ("min", "max"):
        raise ValueError("stays is min or max")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    norm = mapped(rows, _normalise, "id bigint, norm binary").withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("lead", F.substring("norm", 1, LEADING))
    by_id = F.col("id").asc_nulls_first() if stays == "max" else F.col("id").desc_nulls_first()
    dealt = norm.repartitionByRange(partitions(spark), "lead", "sha", by_id).sortWithinPartitions("lead", "sha", "norm", by_id)
    runs = keep_table(mapped(dealt.select("id", "norm", "sha"), _runs, "id bigint, part int, run bigint, place bigint, size bigint, last_id bigint, sha binary, edge boolean, edge_text binary"), "runs")
    # At most two runs of each partition, so this side is small by construction. Of one group at most two texts are
    # held at a time: the least and the greatest, which are equal if all are.
    edges = runs.filter(F.col("edge_text").isNotNull())
    groups = edges.groupBy("sha").agg(F.sum("size").alias("all_size"), F.max(F.struct("part", "run", "last_id")).alias("end"), F.min("edge_text").alias("lo"), F.max("edge_text").alias("hi"))
    groups = groups.select("sha", F.when(F.col("lo") == F.col("hi"), F.col("all_size")).otherwise(F.raise_error(F.lit("unequal texts with one SHA-256")).cast("bigint")).alias("all_size"), "end")
    settled = edges.select("part", "run", "sha").join(groups, "sha").drop("sha")
    out = runs.drop("edge_text").join(F.broadcast(settled), ["part", "run"], "left")
    final = F.coalesce((F.col("end.part") == F.col("part")) & (F.col("end.run") == F.col("run")), F.lit(True))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("end").isNotNull(), F.col("end.last_id")).otherwise(F.col("last_id")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (final & (F.col("place") == F.col("size"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, stays: str = "min") -> DataFrame:
    """``docs`` without exact copies; of rows with one id and equal texts one stays."""
    verdict = exact_duplicates(docs, stays=stays).filter("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"))
    keyed = mapped(docs.select("doc_id", text_or_empty().alias("text"), F.struct("*").alias("row")), _keyed, f"_key bigint, _digest binary, row {docs.select(F.struct('*').alias('row')).dtypes[0][1]}")
    kept = keyed.join(verdict, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha")), "left_semi")
    return kept.dropDuplicates(["_key", "_digest"]).select("row.*")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        norm = pc.ascii_lower(b.column(1)).to_pylist()
        yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in norm], pa.binary()), b.column(2)], names=["_key", "_digest", "row"])
