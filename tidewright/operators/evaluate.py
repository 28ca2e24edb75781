"""Evaluation over columns, hop scores, and influence over a trajectory's checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, metrics, numeric
from ..functions import text as tx
from .metrics import spearman

KEY = "utterance_id"


def long_enough(rows: DataFrame) -> Column:
    """A row can be aligned if it has at least as many frames as target characters."""
    return F.col("n_frames") >= F.size(tx.encode_chars(F.col("text_norm")))


def predictions(rows: DataFrame) -> DataFrame:
    """(utterance_id, ref, hyp, loss, wer, cer) of the rows that are long enough. Columns: utterance_id, frames (probabilities), n_frames, text_norm. Rates are null for a blank reference."""
    kept = rows.filter(long_enough(rows)).withColumn("_t", tx.encode_chars(F.col("text_norm")))
    kept = kept.withColumns({"ref": tx.decode_chars(F.col("_t")), "hyp": tx.decode_chars(arrays.greedy_ids(F.col("frames"), F.col("n_frames")), collapse=True)})
    loss = metrics.ctc_losses(kept, KEY, "frames", "n_frames", "_t", ["ref", "hyp"])
    return loss.select(KEY, "ref", "hyp", "loss", metrics.wer(F.col("ref"), F.col("hyp")).alias("wer"), metrics.cer(F.col("ref"), F.col("hyp")).alias("cer"))


def summary(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: n_utterances, dropped, mean_wer, mean_cer (over rows with a reference; null if there is none)."""
    dropped = rows.agg(F.count_if(~long_enough(rows)).alias("dropped"))
    return scored.agg(F.count("*").alias("n_utterances"), F.avg("wer").alias("mean_wer"), F.avg("cer").alias("mean_cer")).join(F.broadcast(dropped))


def evaluate(rows: DataFrame, folder: str) -> DataFrame:
    """Write predictions and their summary as lines of JSON; returns the summary."""
    scored = predictions(rows)
    scored.write.mode("overwrite").json(f"{folder}/predictions.jsonl")
    found = rows.sparkSession.read.schema(scored.schema).json(f"{folder}/predictions.jsonl")
    out = summary(rows, found)
    out.coalesce(1).write.mode("overwrite").json(f"{folder}/summary.json")
    return out


# --- audio quality by hops ------------------------------------------------------------


def hop_means(hops: DataFrame, key: str = KEY) -> DataFrame:
    """(key, six means, n_hops) from (key, sig, bak, ovr) of each hop: raw scores, and scores calibrated hop by hop."""
    cols = [F.avg(c).alias(f"{c}_raw") for c in numeric.CALIBRATION] + [F.avg(numeric.calibrate(F.col(c), c)).alias(f"{c}_mos") for c in numeric.CALIBRATION]
    return hops.groupBy(key).agg(*cols, F.count("*").cast("int").alias("n_hops"))


def score_audio(waves: DataFrame, model: Callable, key: str = "path") -> DataFrame:
    """The hop means of each wave: clips are tiled until a hop fits, cut into hops, and scored by ``model`` (an array of segments to an array of sig, bak, ovr). Columns: key, rate, samples. Other rates than 16 kHz are refused."""
    kind = dict(waves.dtypes)[key]

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for name, rate, samples in zip(b[key], b["rate"], b["samples"], strict=True):
                if rate != numeric.SAMPLE_RATE:
                    raise ValueError(f"{name}: {rate} Hz")
                x = np.asarray(samples, np.float32)
                if not len(x):
                    raise ValueError(f"{name}: no samples")
                while len(x) < numeric.HOP_SAMPLES:
                    x = np.concatenate([x, x])
                planned = int(len(x) // rate - numeric.HOP_SECONDS) + 1
                cuts = [(i * rate, int((i + numeric.HOP_SECONDS) * rate)) for i in range(planned)]
                whole = [x[a:z] for a, z in cuts if len(x[a:z]) >= numeric.HOP_SAMPLES]
                scores = np.asarray(model(np.stack(whole)), float)
                yield pd.DataFrame({key: [name] * len(whole), "sig": scores[:, 0], "bak": scores[:, 1], "ovr": scores[:, 2]})

    return hop_means(waves.select(key, "rate", "samples").mapInPandas(run, f"`{key}` {kind}, sig double, bak double, ovr double"), key)


# --- influence ------------------------------------------------------------------------


def projected_twice(references: DataFrame, seed: str, size: int, dims: int) -> DataFrame:
    """(ckpt, q): each checkpoint's reference vector r as P P'r, P a seeded random sign matrix of size x dims.

    (xP)(rP)' is x(PP'r)', so only the few references are projected, and a row's
    influence is one dot product.
    """
    cell = F.concat_ws("|", F.col("i").cast("string"), F.col("j").cast("string"))
    sign = F.when(numeric.uniform(seed, cell) < 0.5, F.lit(1.0)).otherwise(F.lit(-1.0)) / F.sqrt(F.lit(float(dims)))
    grid = references.sparkSession.range(size * dims).select((F.col("id") / dims).cast("int").alias("i"), (F.col("id") % dims).cast("int").alias("j"))
    p = grid.withColumn("p", sign)
    r = references.select("ckpt", F.posexplode("v").alias("i", "x"))
    down = r.join(F.broadcast(p), "i").groupBy("ckpt", "j").agg(F.sum(F.col("x") * F.col("p")).alias("s"))
    up = down.join(F.broadcast(p), "j").groupBy("ckpt", "i").agg(F.sum(F.col("s") * F.col("p")).alias("q"))
    return up.groupBy("ckpt").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q"))


def influence_over_checkpoints(rows: DataFrame, references: DataFrame, seed: str, size: int, dims: int) -> DataFrame:
    """(utterance_id, influence): the projected dot product with each checkpoint's reference, averaged over the checkpoints that have the row, in their order, so that equal rows tie. Columns: utterance_id, ckpt, v; ckpt, v."""
    q = projected_twice(references, seed, size, dims)  # one row for each checkpoint
    each = rows.join(F.broadcast(q), "ckpt").select(KEY, "ckpt", arrays.dot(F.col("v"), F.col("q")).alias("x")).withColumn("x", F.when(F.col("x").isNotNull(), F.struct("ckpt", "x")))
    found = each.groupBy(KEY).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return found.select(KEY, (F.aggregate("x", F.lit(0.0), lambda s, c: s + c["x"]) / F.nullif(F.size("x"), F.lit(0))).alias("influence"))


def rank_agreement(a: DataFrame, b: DataFrame, value: str, key: str = KEY) -> DataFrame:
    """One row, rho: the rank correlation of two tables over the ids that both have."""
    both = a.select(key, F.col(value).alias("left_value")).join(b.select(key, F.col(value).alias("right_value")), key)
    return spearman(both, "left_value", "right_value")
