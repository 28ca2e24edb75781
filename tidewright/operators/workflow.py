"""From score tables to checked subsets and run records: dispatch, batch, splits, paths, verdicts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions import text as tx
from ..sources import writers
from . import check, select

KEY = "utterance_id"
# Seeds of the stochastic selectors, and suffixes of the staged files by kind.
SEEDS = ("201", "202", "203")
SUFFIXES = {"tokens": ".tokens.pt", "transcript": ".txt", "audio": ".flac"}


@dataclass(frozen=True)
class Pools:
    """What a selection is held against: the index, the train ids and the validation ids."""

    index: DataFrame
    train: DataFrame
    val: DataFrame

    def universe(self) -> int:
        return select.universe(self.index).count()


def subset_name(selector: str, fraction: float, seed: str | None) -> str:
    name = f"{selector}_{round(100 * fraction)}pct" + (f"_seed{seed}" if seed is not None else "")
    if not re.match(check.SUBSET_NAME, name):
        raise ValueError(f"{name} is no subset name")
    return name


def choose(pools: Pools, selector: str, scores: DataFrame, fraction: float, seed: str | None) -> tuple[DataFrame, int]:
    """(ids, budget): a selector's draw from the scores of train rows; the budget counts the whole universe."""
    k, there = select.budget(pools.universe(), fraction), pools.train.count()
    if not 0 < k <= there:
        raise ValueError(f"{selector}: a budget of {k} for {there} rows")
    return select.select(selector, scores.join(pools.train.select(KEY), KEY, "left_semi"), k, seed), k


def require_laws(lines: DataFrame, pools: Pools, k: int) -> None:
    """An error that names the first law that the lines break."""
    if law := check.first_violation(check.manifest_violations(lines, pools.train, pools.val, k)):
        raise ValueError(f"the subset breaks {law}")


def revalidate(spark: SparkSession, path: str, pools: Pools, k: int) -> None:
    """The same laws for a written manifest, line by line as it lies there: repeated and blank lines count."""
    require_laws(spark.read.text(path).withColumnRenamed("value", KEY), pools, k)


def make_subset(pools: Pools, selector: str, scores: DataFrame, fraction: float, seed: str | None, folder: str, stats: DataFrame | None = None) -> dict:
    """Choose, check, write the id file and its description, and check again what was written. Returns the description."""
    name = subset_name(selector, fraction, seed)
    ids, k = choose(pools, selector, scores, fraction, seed)
    ids = ids.persist()
    try:
        require_laws(ids, pools, k)
        meta = {"selector": selector, "fraction": fraction, "subset_seed": seed, "score_table": select.ROSTER[selector].table, "universe_size": pools.universe()}
        about = writers.write_manifest(ids, select.characterize(ids, pools.index, stats), f"{folder}/{name}", meta)
        revalidate(ids.sparkSession, f"{folder}/{name}.ids", pools, k)
    finally:
        ids.unpersist()
    return about


def batch(roster: Iterable[str] | None = None) -> list[tuple[str, str | None]]:
    """Each selector once, the stochastic ones once for each seed."""
    return [(n, s) for n in sorted(roster or select.ROSTER) for s in (SEEDS if select.ROSTER[n].stochastic else (None,))]


def run_batch(spark: SparkSession, calls: list[tuple[str, str | None]], make: Callable[[str, str | None], object]) -> DataFrame:
    """(selector, seed, ok, reason) of each call: a failure is noted and the next call goes on. One row for each call, by the feature's size."""
    rows = []
    for selector, seed in calls:
        try:
            make(selector, seed)
            rows.append((selector, seed, True, ""))
        except (ValueError, OSError) as e:
            rows.append((selector, seed, False, str(e)))
    return spark.createDataFrame(rows, "selector string, seed string, ok boolean, reason string")


def freeze(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """(file, n, hours, sha256) of the three split files: sorted ids, and for the test split pointers under comments. Columns: utterance_id, duration_s; of ``test`` also audio_path, tokens_path."""
    head = ["# official test split: paths only", "# not to be read before the final evaluation", "utterance_id\taudio_path\ttokens_path"]
    # Comments and header sort before the rows by a rank of their own.
    top = test.sparkSession.createDataFrame(list(enumerate(head)), "place int, line string").withColumn(KEY, F.lit(""))
    rows = test.select(F.lit(len(head)).alias("place"), F.concat_ws("\t", KEY, "audio_path", "tokens_path").alias("line"), KEY)
    out = None
    for name, lines, frame in (("train_ids.txt", train.select(F.lit(0).alias("place"), F.col(KEY).alias("line"), KEY), train), ("val_ids.txt", val.select(F.lit(0).alias("place"), F.col(KEY).alias("line"), KEY), val), ("test_pointers.tsv", top.unionByName(rows), test)):
        facts = frame.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("duration_s"), F.lit(0)) / 3600, 3).alias("hours"))
        row = facts.select(F.lit(name).alias("file"), "n", "hours").join(F.broadcast(writers.digest(lines, ["place", KEY], "line")))
        out = row if out is None else out.unionByName(row)
    return out


def write_splits(train: DataFrame, val: DataFrame, test: DataFrame, folder: str, facts: dict) -> DataFrame:
    """The split files and a freeze manifest with their digests; returns the manifest's rows."""
    frozen = freeze(train, val, test)
    writers.write_id_file(train, f"{folder}/train_ids.txt")
    writers.write_id_file(val, f"{folder}/val_ids.txt")
    test.orderBy(KEY).select(F.concat_ws("\t", KEY, "audio_path", "tokens_path").alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/test_pointers.tsv")
    frozen.select("*", *[F.lit(v).alias(k) for k, v in facts.items()]).coalesce(1).write.mode("overwrite").json(f"{folder}/freeze_manifest.json")
    return frozen


# --- paths ---------------------------------------------------------------------------


def index_location(config: dict, environment: dict) -> str:
    """Where the index lies: the environment's word, or the configured path as it stands; never re-anchored."""
    return environment.get("INDEX_PATH") or config["index_path"]


def expected_paths(index: DataFrame, kind: str, layout: str = "staged", prefix: str = "") -> DataFrame:
    """(utterance_id, relpath) where each row's file should be. Staged: video/stem.suffix. Legacy: an audio's own path without ``prefix``, the root that it was recorded under."""
    if layout not in ("staged", "legacy"):
        raise ValueError(f"no layout {layout}")
    if layout == "legacy" and kind == "audio":
        path = F.when(F.col("audio_path").isNull(), F.raise_error(F.concat(F.lit("no audio path: "), F.col(KEY)))).otherwise(F.when(F.col("audio_path").startswith(prefix), F.expr(f"substring(audio_path, {len(prefix) + 1})")).otherwise(F.col("audio_path")))
    else:
        path = tx.relpath(F.col("video_id"), F.col("stem"), SUFFIXES[kind])
    return index.select(KEY, path.alias("relpath"))


def absent_paths(index: DataFrame, files: DataFrame, kind: str, layout: str = "staged") -> DataFrame:
    """(utterance_id, relpath) of rows whose file is not listed."""
    return expected_paths(index, kind, layout).join(files.select("relpath"), "relpath", "left_anti").select(KEY, "relpath")


def preflight(index: DataFrame, files: DataFrame, k: int = 50, seed: str = "20260826", kind: str = "tokens") -> DataFrame:
    """(utterance_id, relpath, there) of k rows by seed: looked at before any work starts. The sample is the feature."""
    sample = index.orderBy(numeric.uniform(seed, F.col(KEY)), KEY).limit(k)
    have = files.select(F.col("relpath").alias("_p")).distinct()
    paths = expected_paths(sample, kind)
    return paths.join(have, F.col("relpath") == F.col("_p"), "left").select(KEY, "relpath", F.col("_p").isNotNull().alias("there"))


def require_preflight(index: DataFrame, files: DataFrame, **how) -> None:
    rows = preflight(index, files, **how).collect()  # k rows
    if not rows:
        raise ValueError("preflight of no rows")
    if gone := sorted(r.relpath for r in rows if not r.there):
        raise ValueError(f"{len(gone)} of {len(rows)} files are not there, first {gone[0]}")


def staging_jobs(index: DataFrame, source: str) -> DataFrame:
    """(src, rel, kind) of the files to stage: tokens, the transcript where there is one, and audio, which always becomes FLAC."""
    rel = {k: tx.relpath(F.col("video_id"), F.col("stem"), s) for k, s in SUFFIXES.items()}
    under = lambda k: F.concat(F.lit(source.rstrip("/") + "/"), F.col("split"), F.lit("/"), rel[k])
    jobs = F.array(
        F.struct(under("tokens").alias("src"), rel["tokens"].alias("rel"), F.lit("tokens").alias("kind")),
        F.when(F.col("has_text"), F.struct(under("transcript").alias("src"), rel["transcript"].alias("rel"), F.lit("transcript").alias("kind"))),
        F.struct(F.col("audio_path").alias("src"), rel["audio"].alias("rel"), F.lit("audio").alias("kind")))
    return index.select(F.explode(F.array_compact(jobs)).alias("j")).select("j.*")


# --- checkpoints, plans, verdicts ------------------------------------------------------


def checkpoints(files: DataFrame, name: str = "name") -> DataFrame:
    """(epoch, name) of the trajectory's checkpoints by epoch; none at all is an error."""
    found = files.select(tx.epoch_of(F.col(name)).alias("epoch"), F.col(name).alias("name")).filter("epoch IS NOT NULL")
    if found.isEmpty():
        raise FileNotFoundError("no checkpoint of a trajectory")
    return found.orderBy("epoch")


def plan_lines(rows: DataFrame, banner: list[str]) -> DataFrame:
    """(place, line) of a run plan's file: banner, header, rows by the number of their task. Columns as in check.PLAN_COLUMNS."""
    bad = check.plan_rows(rows.select(F.concat_ws("\t", *check.PLAN_COLUMNS).alias("value"))).filter("reason IS NOT NULL").first()
    if bad is not None:
        raise ValueError(f"invalid plan: {bad.reason}")
    head = [*(f"# {b}" for b in banner), "\t".join(check.PLAN_COLUMNS)]
    top = rows.sparkSession.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "place bigint, line string")
    return top.unionByName(rows.select(F.col("task").cast("bigint").alias("place"), F.concat_ws("\t", *check.PLAN_COLUMNS).alias("line")))


def plan_is_current(rows: DataFrame, banner: list[str], written: DataFrame) -> DataFrame:
    """One row, ``same``: whether a written plan (columns place, line) has the very bytes that its rows give."""
    want, have = writers.digest(plan_lines(rows, banner), ["place"], "line"), writers.digest(written, ["place"], "line")
    return want.select("sha256").join(F.broadcast(have.select(F.col("sha256").alias("_h")))).select((F.col("sha256") == F.col("_h")).alias("same"))


def merge_verdicts(selected: DataFrame, structural: DataFrame, content: DataFrame, note: str = "no verdict") -> DataFrame:
    """(run_id, reason) of every selected run; an empty reason passes. Structural reasons come first, then the content probe's; a run without any word of the probe is refused.

    ``structural``: (run_id, why) of refused runs. ``content``: (run_id, why), empty where all is well.
    """
    s = structural.select("run_id", F.col("why").alias("_s"))
    c = content.select("run_id", F.col("why").alias("_c"))
    return selected.select("run_id").join(s, "run_id", "left").join(c, "run_id", "left").select("run_id", F.coalesce(F.nullif("_s", F.lit("")), "_c", F.lit(note)).alias("reason"))


def attestations(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """(run_id, lacking): what each run still lacks before it may be marked as complete; empty where it may."""
    have = files.groupBy("run_id").agg(F.bool_or(F.col("name") == "metrics.parquet").alias("m"), F.bool_or(F.col("name") == "last.ckpt").alias("c"))
    rows = metrics.groupBy("run_id").agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "val").alias("v"))
    lacking = F.array_compact(F.array(
        F.when(~F.col("m"), "metrics.parquet"),
        F.when(F.col("m") & ((F.coalesce("t", F.lit(0)) < 1) | (F.coalesce("v", F.lit(0)) < 1)), "rows of both splits"),
        F.when(~F.col("c"), "last.ckpt")))
    return have.join(rows, "run_id", "left").select("run_id", F.array_join(lacking, ", ").alias("lacking"))


def protocol_problems(rows: DataFrame) -> DataFrame:
    """``rows`` of protocol constants with ``problem``: the first law that they break, or null."""
    c = F.col
    fits = c("crop_samples") == F.floor(c("crop_frames") * c("sample_rate") / c("token_hz"))
    problem = F.when(~fits, "crop samples").when((c("token_pad_id") >= 0) & (c("token_pad_id") < c("codebook_size")), "pad id").when(c("min_crop_frames") > c("crop_frames"), "shortest crop")
    return rows.withColumn("problem", problem)


def spread_gate(z: DataFrame) -> DataFrame:
    """One row: the spread of the selectors' mean differences, the greatest standard error of a difference, and whether the gate is open."""
    return z.agg((F.max("delta") - F.min("delta")).alias("spread"), F.max(F.abs(F.col("delta") / F.col("z"))).alias("sigma")).withColumn("open", F.col("spread") > F.col("sigma"))


def spot_lines(picked: DataFrame, measured: Column) -> DataFrame:
    """(place, line) of a spot-check report: each picked row with a warning where the measured duration is off. A few rows by the feature's size."""
    number = F.row_number().over(Window.orderBy(KEY))
    off = F.abs(measured - F.col("duration_s")) > F.greatest(F.lit(0.15), F.col("duration_s") * 0.05)
    line = F.concat(F.lit("["), F.lpad(number.cast("string"), 2, "0"), F.lit("] "), F.col(KEY), F.lit(" frames="), F.col("n_tokens").cast("string"), F.lit(" text="), F.col("text_norm"), F.when(off, " WARNING duration").otherwise(""))
    return picked.select(number.alias("place"), line.alias("line"))
