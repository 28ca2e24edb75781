"""Integrity laws as violation frames, and strict joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "utterance_id"
# Laws of a manifest in the order in which they are reported, and of a subset's name.
LAWS = ["wrong-k", "dup", "blank", "junk", "val-leak", "foreign-id"]
SUBSET_NAME = r"^[a-z][a-z0-9_]*_(5|10|25)pct(_seed\d+)?$"
MANIFEST_KEYS = ["config_hash", "git_sha", "gpu_name", "subset_manifest"]
MOST_FILES = 20
PLAN_COLUMNS = ["task", "track", "subset_manifest", "seed", "config_yaml", "keep_local_traj"]


def strict_semi_join(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is listed; an id without a row is an error that names how many and the first five."""
    absent = ids.select(KEY).distinct().join(rows, KEY, "left_anti")
    first = [r[0] for r in absent.orderBy(KEY).limit(6).collect()]
    if first:
        raise ValueError(f"{absent.count()} ids have no record: {first[:5]}")
    return rows.join(ids.select(KEY), KEY, "left_semi")


def manifest_violations(lines: DataFrame, train: DataFrame, val: DataFrame, k: int) -> DataFrame:
    """(law, n) of every law that the lines (column utterance_id) break."""
    line = F.col(KEY)
    own = lines.agg(
        F.abs(F.count("*") - k).alias("wrong-k"), (F.count(line) - F.count_distinct(line)).alias("dup"), F.count_if(line == "").alias("blank"),
        F.count_if((line != "") & (line.rlike(r"\s") | (F.length(line) - F.length(F.replace(line, F.lit("/"))) != 1))).alias("junk"))
    leak = lines.join(val.select(KEY), KEY, "left_semi").agg(F.count("*").alias("val-leak"))
    foreign = lines.join(train.select(KEY), KEY, "left_anti").agg(F.count("*").alias("foreign-id"))
    frames = [f.unpivot([], f.columns, "law", "n") for f in (own, leak, foreign)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).filter("n > 0")


def first_violation(violations: DataFrame) -> str | None:
    found = {r.law for r in violations.collect()}  # at most one row for each law
    return next((law for law in LAWS if law in found), None)


def score_violations(scores: DataFrame, val: DataFrame) -> DataFrame:
    """(law, n): repeated keys, and rows of the validation part."""
    if KEY not in scores.columns:
        raise ValueError(f"no column {KEY}")
    dup = scores.groupBy(KEY).agg(F.count("*").alias("n")).filter("n > 1").agg(F.lit("dup").alias("law"), F.count("*").alias("n"))
    leak = scores.join(val.select(KEY), KEY, "left_semi").agg(F.lit("val-leak").alias("law"), F.count("*").alias("n"))
    return dup.unionByName(leak).filter("n > 0")


def split_checks(train: DataFrame, val: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: sizes, overlap in ids and groups, and whether the parts make up the universe."""
    rows = train.agg(F.count("*").alias("n_train")).join(val.agg(F.count("*").alias("n_val"))).join(universe.agg(F.count("*").alias("n_universe")))
    same = train.select(KEY).intersect(val.select(KEY)).agg(F.count("*").alias("shared_ids"))
    groups = train.select("video_id").intersect(val.select("video_id")).agg(F.count("*").alias("shared_videos"))
    lost = universe.select(KEY).exceptAll(train.select(KEY).unionAll(val.select(KEY))).agg(F.count("*").alias("lost"))
    return rows.join(same).join(groups).join(lost).withColumn("whole", F.expr("n_train + n_val = n_universe AND shared_ids = 0 AND lost = 0"))


def compare_manifest(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """(relpath, status) of files that are missing, extra or have another hash."""
    d = disk.select(F.col("relpath").alias("_p"), F.col("sha256").alias("_s"))
    both = manifest.join(d, F.col("relpath") == F.col("_p"), "full_outer")
    status = F.when(F.col("_p").isNull(), "missing").when(F.col("relpath").isNull(), "extra").when(F.col("sha256") != F.col("_s"), "mismatch")
    return both.select(F.coalesce("relpath", "_p").alias("relpath"), status.alias("status")).filter("status IS NOT NULL")


def token_anomalies(rows: DataFrame, codebook: int, least: int) -> DataFrame:
    """(kind, utterance_id) from codes: unreadable (null), out of range, too short for crops."""
    c, s = F.col("codes"), F.col("split")
    kinds = F.array_compact(F.array(
        F.when(c.isNull(), F.concat(s, F.lit("_unreadable_tokens"))),
        F.when(F.exists(c, lambda x: (x < 0) | (x >= codebook)), F.concat(s, F.lit("_token_range_violation"))),
        F.when((F.size(c) > 0) & (F.size(c) < least), F.concat(s, F.lit("_too_short_for_crops")))))
    return rows.select(F.explode(kinds).alias("kind"), KEY)


def shape_anomalies(rows: DataFrame, streams: str, n: int) -> DataFrame:
    """(kind, utterance_id) of rows that have not ``n`` streams of one length."""
    sizes = F.transform(streams, lambda x: F.size(x))
    bad = F.coalesce((F.size(streams) != n) | (F.array_min(sizes) != F.array_max(sizes)), F.lit(True))
    return rows.filter(bad).select(F.concat("split", F.lit("_bad_shape")).alias("kind"), KEY)


def anomaly_report(anomalies: DataFrame, examples: int = 50) -> DataFrame:
    """(kind, n, examples): a count and the first ids of each kind. Examples are cut before they are collected."""
    count = anomalies.groupBy("kind").agg(F.count("*").alias("n"))
    few = anomalies.withColumn("_rn", F.row_number().over(Window.partitionBy("kind").orderBy(KEY))).filter(F.col("_rn") <= examples)
    return count.join(few.groupBy("kind").agg(F.sort_array(F.collect_list(KEY)).alias("examples")), "kind")


def plan_rows(lines: DataFrame) -> DataFrame:
    """(line, fields, reason) of a run plan's lines (column value); reason is null for valid rows. Comments and the header are not rows."""
    f = F.split("value", "\t")
    row = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "\t".join(PLAN_COLUMNS))).select(F.col("value").alias("line"), f.alias("fields"))
    g = lambda i: F.get(F.col("fields"), F.lit(i))
    n = F.count("*").over(Window.partitionBy(g(0)))
    reason = (
        F.when(F.size("fields") != len(PLAN_COLUMNS), "arity").when(F.exists("fields", lambda x: x == ""), "empty field").when(~g(0).rlike(r"^\d+$"), "task").when(n > 1, "duplicate task")
        .when(~g(1).isin("track_a", "track_b"), "track").when(~g(3).rlike(r"^\d+$"), "seed").when(~g(5).isin("0", "1"), "keep_local_traj"))
    return row.withColumn("reason", reason)


def plan_lookup(lines: DataFrame, task: str) -> DataFrame:
    """The columns of one task; an invalid plan or an unknown task is an error."""
    rows = plan_rows(lines)
    if (bad := rows.filter("reason IS NOT NULL").first()) is not None:
        raise ValueError(f"invalid plan: {bad.reason}")
    found = rows.filter(F.get("fields", F.lit(0)) == task)
    if found.first() is None:
        raise KeyError(task)
    return found.select(*[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(PLAN_COLUMNS)])


def bundle_verdicts(files: DataFrame, metrics: DataFrame, manifests: DataFrame) -> DataFrame:
    """(run_id, reason) of each run, the first thing that is wrong with it; an empty reason passes. A run of which a part says nothing is refused.

    ``files``: (run_id, name). ``metrics``: the log. ``manifests``: (run_id, manifest) as JSON.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = files.groupBy("run_id").agg(F.bool_or(F.col("name") == "COMPLETED").alias("done"), F.bool_or(F.col("name") == "last.ckpt").alias("last"), F.count("*").alias("n_files"))
    rows = metrics.groupBy("run_id").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    keys = manifests.select("run_id", F.lit(True).alias("has"), F.json_object_keys("manifest").alias("keys"))
    wrong = [
        (~F.col("done"), "not marked as complete"), (~F.col("last"), "no last checkpoint"), (F.col("n_files") > MOST_FILES, f"over {MOST_FILES} files"),
        (n("n_train") + n("n_val") == 0, "metric log absent"), (n("n_train") == 0, "metric log: no train rows"), (n("n_val") == 0, "metric log: no validation rows"),
        (F.col("has").isNull(), "manifest absent"), (F.col("keys").isNull(), "manifest unreadable"),
        *((~F.array_contains("keys", k), f"manifest lacks {k}") for k in MANIFEST_KEYS),
        (~F.array_contains("keys", "train_seed") & ~F.array_contains("keys", "seed"), "manifest lacks a seed")]
    reason = F.coalesce(*[F.when(c, r) for c, r in wrong], F.lit(""))
    return parts.join(rows, "run_id", "left").join(keys, "run_id", "left").select("run_id", reason.alias("reason"))
