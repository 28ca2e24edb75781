"""Readers: id lists, indexes, transcripts, file trees, bundles, plans, configurations."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Column names that mean an id or a text, in order of preference.
ID_NAMES = ["id", "utterance_id", "utt_id", "file", "name"]
TEXT_NAMES = ["text", "transcript", "sentence", "transcription", "label"]


def load_index(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split else df


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a table in any store that Spark reads; only their chunks are fetched."""
    return spark.read.parquet(path).select(*columns)


def id_list(lines: DataFrame) -> DataFrame:
    """Distinct ids of a text file's lines (column value); blank lines and comments are none."""
    line = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    return lines.select(line.alias("utterance_id")).filter((F.col("utterance_id") != "") & ~F.col("utterance_id").startswith("#")).distinct()


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return id_list(spark.read.text(path))


def pick_column(columns: list[str], candidates: list[str]) -> str:
    lower = {c.lower(): c for c in columns}
    for name in candidates:
        if name in lower:
            return lower[name]
    raise ValueError(f"none of {candidates} among {columns}")


def id_text(frames: list[DataFrame], ids: list[str] | None = None, texts: list[str] | None = None) -> DataFrame:
    """(id, text) of frames whose columns have different names."""
    parts = [f.select(F.col(pick_column(f.columns, ids or ID_NAMES)).cast("string").alias("id"), F.col(pick_column(f.columns, texts or TEXT_NAMES)).cast("string").alias("text")) for f in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, split, video_id, stem, suffix, length[, content]) of the files under ``root``: split/video/stem.suffix, or split/stem.suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # The files' paths begin with the root as the file system writes it.
    home = spark._jvm.org.apache.hadoop.fs.Path(root)
    start = len(home.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(home).toString()) + 2
    rel = F.expr(f"substring(path, {start})")
    parts, name = F.split(rel, "/"), F.element_at(F.split(rel, "/"), -1)
    return files.select("path", F.get(parts, F.lit(0)).alias("split"), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("").alias("video_id"), F.substring_index(name, ".", 1).alias("stem"), F.expr("substring(element_at(split(path, '/'), -1), length(substring_index(element_at(split(path, '/'), -1), '.', 1)) + 1)").alias("suffix"), "length", *(["content"] if content else []))


def orphans(files: DataFrame, have: str, need: str) -> DataFrame:
    """Stems with a file of suffix ``have`` and none of suffix ``need``."""
    key = ["split", "video_id", "stem"]
    return files.filter(F.col("suffix") == have).select(*key).join(files.filter(F.col("suffix") == need).select(*key), key, "left_anti")


def transcripts(files: DataFrame) -> DataFrame:
    """Transcript files (with content) as text_raw and conf; kind names what is wrong."""
    c = F.col("content").cast("string")
    raw = tx.transcript_text(c)
    kind = F.when(F.trim(c) == "", "empty_transcript").when(raw.isNull(), "unparsable_transcript").when(F.trim(raw) == "", "blank_text_field")
    return files.filter(F.col("suffix") == ".txt").select("split", "video_id", "stem", F.coalesce(raw, F.lit("")).alias("text_raw"), tx.transcript_conf(c).alias("conf"), kind.alias("kind"))


def bundles(found: DataFrame) -> DataFrame:
    """One row for each run: the archive's before the relay's. Columns: run_id, source, path."""
    order = Window.partitionBy("run_id").orderBy(F.when(F.col("source") == "archive", 0).otherwise(1), "path")
    return found.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def wave(spark: SparkSession, root: str) -> DataFrame:
    """(path, rate, n_samples, samples) of 16-bit mono WAV files; other formats are refused."""
    import pandas as pd

    def read(batches):
        import io
        import wave as w

        import numpy as np

        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                with w.open(io.BytesIO(data)) as f:
                    if f.getnchannels() != 1 or f.getsampwidth() != 2:
                        raise ValueError(f"{path}: not 16-bit mono")
                    x = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float32) / 32768
                    rows.append((path, f.getframerate(), len(x), x))
            yield pd.DataFrame(rows, columns=["path", "rate", "n_samples", "samples"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root)
    return files.select("path", "content").mapInPandas(read, "path string, rate int, n_samples bigint, samples array<float>")


def merge(base: dict, over: dict) -> dict:
    """``over`` on ``base``: dictionaries merge, all else is replaced."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_config(path: str | Path, _seen: tuple = ()) -> dict:
    """A JSON (or, where a YAML library is there, YAML) file on top of the file that its ``base`` names."""
    path = Path(path).resolve()
    if path in _seen:
        raise ValueError(f"cycle of base files at {path}")
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        own = json.loads(text)
    else:
        import yaml

        own = yaml.safe_load(text) or {}
    base = own.pop("base", None)
    return merge(load_config(path.parent / base, (*_seen, path)), own) if base else own


def config_hash(config: dict) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
