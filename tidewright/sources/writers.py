"""Writers: sorted tables, manifests, metric logs, rendered results."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, key: str = "utterance_id") -> None:
    """A table in key order; Spark's commit makes it appear whole or not at all."""
    df.orderBy(key).write.mode("overwrite").parquet(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_id_file(ids: DataFrame, path: str) -> None:
    """Sorted ids, one a line, in one file: a manifest is bounded by its budget."""
    ids.select("utterance_id").distinct().orderBy("utterance_id").coalesce(1).write.mode("overwrite").text(path)


def write_manifest(ids: DataFrame, facts: DataFrame, path: str, meta: dict) -> dict:
    """The id file and a description beside it: what was realised, and by what."""
    write_id_file(ids, f"{path}.ids")
    about = {k: v for k, v in facts.first().asDict().items() if v is not None} | meta
    spark = ids.sparkSession
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.json")
    return about


def digest(lines: DataFrame, order: list[str], column: str) -> DataFrame:
    """One row, sha256: of the lines in order, a line break after each, as the file of them has it. Rows are sorted in ranges; the hash, which is sequential, reads them range by range in one task and holds a batch at a time."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        h = hashlib.sha256()
        for b in batches:
            for line in b.column(0).to_pylist():
                h.update(f"{line}\n".encode())
        yield pa.record_batch([pa.array([h.hexdigest()])], names=["sha256"])

    return lines.orderBy(*order).select(column).coalesce(1).mapInArrow(run, "sha256 string")


def list_digest(ids: DataFrame) -> DataFrame:
    """One row: how many ids, and the digest of the sorted ids."""
    return ids.agg(F.count("*").alias("n")).join(F.broadcast(digest(ids, ["utterance_id"], "utterance_id")))


def shown(value: Column, kind: str) -> Column:
    """A table cell: four decimals, yes or NO, or nothing."""
    if kind == "boolean":
        text = F.when(value, "yes").otherwise("NO")
    elif kind in ("double", "float"):
        text = F.format_string("%.4f", value)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "").otherwise(text)


def render(df: DataFrame, markdown: bool = True) -> DataFrame:
    """(line) of each row: markdown or comma-separated cells."""
    cells = [shown(F.col(c), k) for c, k in df.dtypes]
    return df.select((F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")) if markdown else F.concat_ws(",", *cells)).alias("line"))


def write_matching(texts: DataFrame, ids: DataFrame, path: str, key: str = "utterance_id", text: str = "text") -> None:
    """The transcripts of the listed ids, as text under one folder for each id; others are not written."""
    found = texts.join(ids.select(key).distinct(), key, "left_semi")
    found.select(F.regexp_replace(key, "/", "_").alias("name"), F.concat(F.lit("Text:  "), text).alias("value")).write.partitionBy("name").mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_run_manifest(path: str | Path, config: dict, subset: str, train_seed: int, subset_seed: int | None = None, status: str = "running", **facts) -> dict:
    """What a run is made of, as JSON that appears whole or not at all: configuration and its hash, subset, seeds. The subset's seed is read from its name where none is given."""
    from .readers import config_hash

    if subset_seed is None and (found := re.search(r"seed(\d+)", subset)):
        subset_seed = int(found[1])
    about = {"config_hash": config_hash(config), "subset_manifest": subset, "subset_seed": subset_seed, "train_seed": train_seed, "status": status} | facts
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fresh = path.with_name(path.name + ".tmp")
    fresh.write_text(json.dumps(about, sort_keys=True, indent=2), encoding="utf-8")
    os.replace(fresh, path)
    return about
