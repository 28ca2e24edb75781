"""Subsets, splits, paths, evaluation and scratch tables, by hand cases and files."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright import scratch
from tidewright.functions import arrays
from tidewright.functions import text as tx
from tidewright.operators import evaluate, select, workflow
from tidewright.sources import readers, writers


@pytest.fixture(scope="module")
def pools(spark):
    rows = [(f"v{i % 10}/{i:03d}", f"v{i % 10}", "trainval", i != 7, 60 + i, 1.5) for i in range(100)]
    index = spark.createDataFrame(rows, "utterance_id string, video_id string, split string, selectable boolean, n_tokens int, duration_s double")
    val = index.filter("video_id = 'v3'").select("utterance_id")
    train = index.filter("selectable AND video_id <> 'v3'").select("utterance_id")
    return workflow.Pools(index, train, val)


def scores(pools):
    return pools.index.select("utterance_id", F.col("n_tokens").cast("double").alias("loss_mean"))


def test_a_subset_is_chosen_written_and_checked_again(spark, pools, tmp_path):
    about = workflow.make_subset(pools, "lossrank", scores(pools), 0.1, None, str(tmp_path))
    assert about["k"] == 10 and about["universe_size"] == 99 and about["realized_hours"] == round(15 / 3600, 3)
    ids = [r[0] for r in spark.read.text(str(tmp_path / "lossrank_10pct.ids")).collect()]
    assert ids == sorted(f"v{i % 10}/{i:03d}" for i in (0, 1, 2, 4, 5, 6, 8, 9, 10, 11))
    workflow.revalidate(spark, str(tmp_path / "lossrank_10pct.ids"), pools, 10)
    for spoilt, law in ((ids[:9], "wrong-k"), (ids[:9] + ids[:1], "dup"), (ids[:9] + ["v3/003"], "val-leak"), (ids[:9] + ["v7/007"], "foreign-id")):
        path = tmp_path / f"bad_{law}"
        path.write_text("\n".join(spoilt) + "\n")
        with pytest.raises(ValueError, match=law):
            workflow.revalidate(spark, str(path), pools, 10)


def test_names_and_budgets(spark, pools):
    assert workflow.subset_name("dsir", 0.25, "202") == "dsir_25pct_seed202"
    with pytest.raises(ValueError, match="no subset name"):
        workflow.subset_name("dsir", 0.3, "202")
    with pytest.raises(ValueError, match="budget of 99"):
        workflow.choose(pools, "lossrank", scores(pools), 1.0, None)


def test_a_batch_goes_on_after_a_failure(spark):
    calls = workflow.batch(["anti", "kmeans"])
    assert calls == [("anti", None), ("kmeans", "201"), ("kmeans", "202"), ("kmeans", "203")] and len(workflow.batch()) == 13

    def make(selector, seed):
        if seed == "202":
            raise FileNotFoundError("no table")

    assert [tuple(r) for r in workflow.run_batch(spark, calls, make).collect()] == [("anti", None, True, ""), ("kmeans", "201", True, ""), ("kmeans", "202", False, "no table"), ("kmeans", "203", True, "")]


def test_frozen_digests_are_those_of_the_files(spark, pools, tmp_path):
    test = spark.createDataFrame([("t2", 2.0, "t2.mp4", "t2.tokens.pt"), ("t1", 1.0, "t1.mp4", "t1.tokens.pt")], "utterance_id string, duration_s double, audio_path string, tokens_path string")
    train, val = (pools.index.join(x, "utterance_id", "left_semi") for x in (pools.train, pools.val))
    got = {r.file: r for r in workflow.write_splits(train, val, test, str(tmp_path), {"seed": 7}).collect()}
    for name in ("train_ids.txt", "val_ids.txt"):
        parts = [p for p in sorted(os.listdir(tmp_path / name)) if p.startswith("part-")]
        data = b"".join((tmp_path / name / p).read_bytes() for p in parts)
        assert got[name].sha256 == hashlib.sha256(data).hexdigest() and got[name].n == data.count(b"\n")
    lines = ["# official test split: paths only", "# not to be read before the final evaluation", "utterance_id\taudio_path\ttokens_path", "t1\tt1.mp4\tt1.tokens.pt", "t2\tt2.mp4\tt2.tokens.pt"]
    assert got["test_pointers.tsv"].sha256 == hashlib.sha256(("\n".join(lines) + "\n").encode()).hexdigest()
    assert spark.read.json(str(tmp_path / "freeze_manifest.json")).count() == 3


def test_preflight(spark, pools):
    index = pools.index.withColumn("stem", F.substring_index("utterance_id", "/", -1))
    files = workflow.expected_paths(index, "tokens").select("relpath")
    workflow.require_preflight(index, files, k=20)
    with pytest.raises(ValueError, match="20 of 20 files"):
        workflow.require_preflight(index, files.filter("false"), k=20)
    with pytest.raises(ValueError, match="no rows"):
        workflow.require_preflight(index.filter("false"), files)
    with pytest.raises(ValueError, match="no layout"):
        workflow.expected_paths(pools.index, "tokens", "other")
    assert workflow.index_location({"index_path": "a/b.parquet"}, {}) == "a/b.parquet" and workflow.index_location({"index_path": "a"}, {"INDEX_PATH": "/x"}) == "/x"
    with pytest.raises(FileNotFoundError):
        workflow.checkpoints(spark.createDataFrame([("last.ckpt",)], "name string"))


def test_evaluation_writes_what_it_sums_up(spark, tmp_path):
    sharp = lambda *ids: [[0.9 if k == i else 0.1 / 5 for k in range(6)] for i in ids]
    rows = spark.createDataFrame([("u1", sharp(2, 1, 3), 3, "ab"), ("u2", sharp(2, 2, 1), 3, "ab"), ("u3", sharp(2), 1, "ab"), ("u4", sharp(1, 1), 2, "")], "utterance_id string, frames array<array<double>>, n_frames int, text_norm string")
    out = evaluate.evaluate(rows, str(tmp_path)).first()
    assert (out.n_utterances, out.dropped, out.mean_wer, out.mean_cer) == (3, 1, 0.5, 0.25)
    got = {r["utterance_id"]: r for f in os.listdir(tmp_path / "predictions.jsonl") if f.startswith("part-") for r in map(json.loads, open(tmp_path / "predictions.jsonl" / f))}
    assert got["u1"]["hyp"] == "ab" and got["u2"]["hyp"] == "a" and "wer" not in got["u4"] and got["u1"]["loss"] < got["u2"]["loss"]


def test_audio_scores(spark):
    waves = spark.createDataFrame([("a", 16000, [0.5] * 16000), ("b", 16000, [0.25] * (16000 * 12))], "path string, rate int, samples array<float>")
    model = lambda segments: np.stack([segments.mean(1) * k for k in (2, 4, 6)], 1)
    got = {r.path: r for r in evaluate.score_audio(waves, model).collect()}
    assert got["a"].n_hops == 7 and got["b"].n_hops == 3 and got["a"].sig_raw == pytest.approx(1.0) and got["b"].ovr_raw == pytest.approx(1.5)
    with pytest.raises(Exception, match="8000 Hz"):
        evaluate.score_audio(waves.withColumn("rate", F.lit(8000)), model).collect()


def test_projection_equals_matrices(spark):
    rng = np.random.default_rng(5)
    x, r = rng.normal(size=(2, 6, 8)), rng.normal(size=(2, 8))
    rows = spark.createDataFrame([(f"u{i}", c, x[c, i].tolist()) for c in range(2) for i in range(6) if (c, i) != (1, 4)], "utterance_id string, ckpt int, v array<double>")
    refs = spark.createDataFrame([(c, r[c].tolist()) for c in range(2)], "ckpt int, v array<double>")
    got = {y.utterance_id: y.influence for y in evaluate.influence_over_checkpoints(rows, refs, "9", 8, 4).collect()}

    def sign(i, j):
        return 1 if int(hashlib.md5(f"9|{i}|{j}".encode()).hexdigest()[:13], 16) / 2**52 < 0.5 else -1

    p = np.array([[sign(i, j) for j in range(4)] for i in range(8)]) / 2
    each = np.einsum("cik,kj,cj->ci", x, p, r @ p)
    assert got == pytest.approx({f"u{i}": each[:, i].mean() if i != 4 else each[0, 4] for i in range(6)})


def test_arrays_refuse_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, [[1, 2], [3]], [1, 5]), (1, [[4]], [2])], "b int, s array<array<int>>, c array<int>")
    with pytest.raises(Exception, match="unlike numbers"):
        arrays.pad_batch(df, "b", "s", -1).collect()
    with pytest.raises(ValueError, match="negative"):
        arrays.pad_batch(df, "b", "s", 0)
    with pytest.raises(Exception, match="out of range"):
        arrays.histogram(df, "b", "c", codebook=5).collect()
    assert sorted(tuple(r) for r in arrays.histogram(df.filter("size(c) = 2"), "b", "c", 6).collect()) == [(1, 1, 1, 0.5), (1, 5, 1, 0.5)]
    with pytest.raises(Exception, match="longer"):
        df.select(arrays.pad_to(F.col("c"), F.lit(1), F.lit(0))).collect()


def test_vocabulary_files(tmp_path):
    tx.save_vocabulary(str(tmp_path / "v.json"), tx.VOCABULARY)
    assert tx.load_vocabulary(str(tmp_path / "v.json")) == tx.VOCABULARY and tx.VOCABULARY[2] == "a"
    tx.save_vocabulary(str(tmp_path / "w.json"), ["a", "b"])
    with pytest.raises(ValueError, match="does not begin"):
        tx.load_vocabulary(str(tmp_path / "w.json"))


def test_matching_transcripts_and_columns(spark, tmp_path):
    texts = spark.createDataFrame([("a/1", "one"), ("a/2", "two")], "utterance_id string, text string")
    writers.write_matching(texts, spark.createDataFrame([("a/2",), ("a/9",)], "utterance_id string"), str(tmp_path / "t"))
    assert [(r.name, r.value) for r in spark.read.text(str(tmp_path / "t")).collect()] == [("a_2", "Text:  two")]
    writers.write_sorted(texts, str(tmp_path / "p"))
    assert readers.read_columns(spark, str(tmp_path / "p"), ["text"]).columns == ["text"]
    assert readers.load_index(spark, str(tmp_path / "p")).count() == 2
    writers.append_metrics(texts, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    assert spark.range(1).select(tx.utc_now().alias("t")).first().t.endswith("+00:00")


def test_scratch_tables_are_told_and_removed(spark, monkeypatch):
    with scratch.tables_made() as made:
        df = scratch.keep(spark.range(5).toDF("x"), "five")
    assert df.count() == 5 and len(made) == 1
    path = made[0].removeprefix("file://")
    assert os.path.isdir(path)
    scratch.discard(spark, made)
    assert not os.path.exists(os.path.dirname(path))

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError, match="share"):
        scratch.scratch_root(Cluster)


def test_round_robin_needs_no_more_than_k_of_a_cluster(spark):
    df = spark.createDataFrame([(f"u{i:04d}", 0 if i < 900 else i) for i in range(905)], "utterance_id string, cluster_id int")
    assert select.round_robin(df, 7, "1").count() == 7 and len({r[0] for r in select.round_robin(df, 8, "1").collect()} - {f"u{i:04d}" for i in range(900, 905)}) == 3


def test_run_manifests(tmp_path):
    about = writers.write_run_manifest(tmp_path / "runs" / "m.json", {"b": 1, "a": 2}, "random_25pct_seed103.txt", 5, gpu_name="none")
    assert json.loads((tmp_path / "runs" / "m.json").read_text()) == about and about["subset_seed"] == 103 and about["gpu_name"] == "none"
    assert about["config_hash"] == readers.config_hash({"a": 2, "b": 1}) and os.listdir(tmp_path / "runs") == ["m.json"]
    assert writers.write_run_manifest(tmp_path / "n.json", {}, "full.txt", 5)["subset_seed"] is None
