"""WARC records, files, and a Merkle fixity audit of replicas.

Each file of a replica is a tree: sixteen records in order make a leaf, hashed over each
record's id, offset, length and SHA-256; sixteen nodes make the next level, up to the
file's root; sixteen files make a node above, up to the replica's root. An audit compares
roots and joins, level by level, only the children of nodes that differ, down to the
records of differing leaves. A lost record shifts its own file alone.

Edge cases: null urls and bodies count as empty; records with a null id are dealt by
their url to files of negative numbers; equal records are told apart by their place;
bodies of any length are hashed whole; an empty replica has no nodes, and everything in
the other is reported as missing or extra; further columns are ignored under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, mapped

FANOUT = 16
#: Records of a file, by id range.
FILE_RECORDS = 512
#: Files over which records without an id are dealt.
NULL_FILES = 4096
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def resource_record(url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as text, with its closing line breaks."""
    name = F.md5(F.concat_ws("|", url, F.sha2(body, 256)))
    uuid = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    head = [F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), url), F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), body, F.lit(CRLF * 2))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, record_id, record): ids are dealt to files by ranges of ``file_records``, records without one by url."""
    rec = resource_record(F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(body_col), F.lit("")))
    return pages.select(F.coalesce(F.expr(f"floor(`{id_col}` / {file_records})"), -1 - F.pmod(F.xxhash64(url_col), F.lit(NULL_FILES))).cast("bigint").alias("file"), F.col(id_col).cast("bigint").alias("record_id"), rec.alias("record"))


def write_warc(recs: DataFrame, path: str) -> None:
    """One WARC file for each ``file``, by Spark's text writer: a record's closing line breaks are the line separator."""
    body = F.expr("substring(record, 1, length(record) - 4)").alias("value")
    dealt = recs.repartition("file").sortWithinPartitions("file", "record_id")
    dealt.select("file", body).write.partitionBy("file").option("lineSep", CRLF * 2).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, headers, body) of every record of the files under ``path``; a file is parsed by its Content-Length fields and held by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, at = [], 0
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at)
                    lines = data[at:end].decode().split(CRLF)
                    if not lines[0].startswith("WARC/"):
                        raise ValueError(f"{name}: no record at byte {at}")
                    headers = [tuple(x.split(": ", 1)) for x in lines[1:]]
                    size = int(dict(headers)["Content-Length"])
                    rows.append((name, at, end + 8 + size - at, headers, data[end + 4 : end + 4 + size]))
                    at = end + 8 + size
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.record_batch([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.map_(pa.string(), pa.string())), pa.array(cols[4], pa.binary())], names=["path", "offset", "length", "headers", "body"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return mapped(files, run, "path string, offset bigint, length bigint, headers map<string,string>, body binary")


def manifest(recs: DataFrame) -> DataFrame:
    """(file, record_id, place, offset, length, sha256) of every record; a file's records follow each other by id."""
    light = recs.select("file", "record_id", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("sha256"))
    order = Window.partitionBy("file").orderBy("record_id", "sha256")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return light.select("file", "record_id", (F.row_number().over(order) - 1).cast("bigint").alias("place"), before.alias("offset"), "length", "sha256")


def _parents(nodes: DataFrame, file: Column, node: Column) -> DataFrame:
    each = F.sort_array(F.collect_list(F.struct("file", "node", "begin", "finish", "hash")))
    text = F.array_join(F.transform("kids", lambda k: F.concat_ws(",", k["file"], k["node"], k["begin"], k["finish"], k["hash"])), ";")
    up = nodes.groupBy(file.alias("_f"), node.alias("_n")).agg(each.alias("kids"), F.min("begin").alias("begin"), F.max("finish").alias("finish"))
    return up.select(F.col("_f").alias("file"), F.col("_n").alias("node"), "begin", "finish", F.sha2(text, 256).alias("hash"))


def merkle_levels(entries: DataFrame, file_levels: int) -> list[DataFrame]:
    """The tree over a manifest, leaves first: (file, node, begin, finish, hash) with begin and finish as bytes of the file. Two levels end at the file's root, ``file_levels`` more at the replica's."""
    group = F.expr(f"place div {FANOUT}")
    each = F.sort_array(F.collect_list(F.struct("place", "record_id", "offset", "length", "sha256")))
    text = F.array_join(F.transform("kids", lambda k: F.concat_ws(",", F.coalesce(k["record_id"].cast("string"), F.lit("-")), k["offset"], k["length"], k["sha256"])), ";")
    leaves = entries.groupBy("file", group.alias("node")).agg(each.alias("kids"), F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("finish")).select("file", "node", "begin", "finish", F.sha2(text, 256).alias("hash"))
    levels = [keep(leaves, "leaves")]
    levels.append(keep(_parents(levels[-1], F.col("file"), F.expr(f"node div {FANOUT}")), "nodes"))
    levels.append(keep(_parents(levels[-1], F.col("file"), F.lit(0).cast("bigint")), "files"))
    for _ in range(file_levels):
        levels.append(keep(_parents(levels[-1], F.expr(f"cast(floor(file / {FANOUT}) as bigint)"), F.lit(0).cast("bigint")), "above"))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select(F.col("file").alias("_file"), F.col("node").alias("_node"), F.col("hash").alias("_hash"))
    both = a.join(other, (F.col("file") == F.col("_file")) & (F.col("node") == F.col("_node")), "full_outer")
    return both.filter(~F.col("hash").eqNullSafe(F.col("_hash"))).select(F.coalesce("file", "_file").alias("file"), F.coalesce("node", "_node").alias("node"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, record_id, status, offset, length, expected_sha256, found_offset, found_sha256) of each record that differs.

    ``status``: altered, moved (equal bytes elsewhere in the file), missing or extra.
    Takes two tables of records, see ``records``.
    """
    entries = [keep(manifest(x), "manifest") for x in (primary, replica)]
    last = max(x.agg(F.coalesce(F.max(F.abs("file")), F.lit(0))).first()[0] for x in entries)
    above = 0
    while last > 0:
        last, above = last // FANOUT, above + 1
    a, b = (merkle_levels(x, above + 1) for x in entries)  # one level more: files without ids have negative numbers, and end at node -1
    wrong = keep(_differing(a[-1], b[-1]), "differing")
    for level in range(len(a) - 2, -1, -1):
        file, node = (F.expr(f"cast(floor(file / {FANOUT}) as bigint)"), F.lit(0).cast("bigint")) if level >= 2 else (F.col("file"), F.lit(0).cast("bigint") if level == 1 else F.expr(f"node div {FANOUT}"))
        up = wrong.select(F.col("file").alias("_f"), F.col("node").alias("_n"))
        below = [x[level].withColumns({"_pf": file, "_pn": node}).join(up, (F.col("_pf") == F.col("_f")) & (F.col("_pn") == F.col("_n")), "left_semi").drop("_pf", "_pn") for x in (a, b)]
        wrong = keep(_differing(*below), "differing")
    up = wrong.select(F.col("file").alias("_f"), F.col("node").alias("_n"))
    there, found = (x.join(up, (F.col("file") == F.col("_f")) & (F.expr(f"place div {FANOUT}") == F.col("_n")), "left_semi") for x in entries)
    same = Window.partitionBy("file", "record_id").orderBy("place")
    there, found = (x.withColumn("nth", F.row_number().over(same)) for x in (there, found))
    found = found.select(*[F.col(c).alias(f"b_{c}") for c in found.columns])
    both = there.join(found, (F.col("file") == F.col("b_file")) & F.col("record_id").eqNullSafe(F.col("b_record_id")) & (F.col("nth") == F.col("b_nth")), "full_outer")
    status = F.when(F.col("b_file").isNull(), "missing").when(F.col("file").isNull(), "extra").when(F.col("sha256") != F.col("b_sha256"), "altered").when(F.col("offset") != F.col("b_offset"), "moved")
    return both.withColumn("status", status).filter("status IS NOT NULL").select(F.coalesce("file", "b_file").alias("file"), F.coalesce("record_id", "b_record_id").alias("record_id"), "status", "offset", "length", F.col("sha256").alias("expected_sha256"), F.col("b_offset").alias("found_offset"), F.col("b_sha256").alias("found_sha256"))
