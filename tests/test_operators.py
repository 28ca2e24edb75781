"""Hand cases and laws of the operators."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tidewright.functions import arrays, metrics, numeric
from tidewright.functions import text as tx
from tidewright.operators import check, models, select
from tidewright.operators import metrics as stats
from tidewright.sources import readers, writers
from tidewright.streaming import metrics as streaming


def one(spark, column, **values):
    values = values or {"_": 0}
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x) for x in v]).alias(k) for k, v in values.items()]).select(column.alias("r")).first().r


@pytest.mark.parametrize(("raw", "want"), [
    ("Rain Fell All NIGHT", "rain fell all night"), ("we paid 7 pounds for 15 pears", "we paid seven pounds for fifteen pears"), ("in 1907 he left", "in one thousand nine hundred and seven he left"), ("room 4B, floor 0", "room four b floor zero"),
    ("WON'T you (please) stay?", "won't you please stay"), (" \t tea\n\nfor\r two  ", "tea for two"), ("... ?! --", ""), ("she’s", "she s"), ("2000003 7654321 900 40", "two million and three seven million six hundred and fifty four thousand three hundred and twenty one nine hundred forty"),
    ("5" * 40, " ".join(["five"] * 40))])
def test_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(tx.normalize_text(F.col("t")).alias("r")).first().r == want


def test_transcripts(spark):
    df = spark.createDataFrame([("Text:  low tide at nine\n",), ("Text: two lines\nof it\nConf:  12\n",), ("",), ("no such thing",)], "c string")
    got = [(r[0], r[1]) for r in df.select(tx.transcript_text(F.col("c")), tx.transcript_conf(F.col("c"))).collect()]
    assert got == [("low tide at nine", None), ("two lines\nof it", 12), (None, None), (None, None)]


def test_characters(spark):
    assert one(spark, tx.encode_chars(F.col("t")), t="he'd x_y") == [9, 6, 29, 5, 28, 25, 26]
    assert one(spark, tx.encode_chars(F.col("t")), t="") == []
    assert one(spark, tx.decode_chars(F.col("i"), True), i=[2, 2, 1, 2, 3, 3, 0, 3]) == "aabb"
    assert one(spark, tx.decode_chars(F.col("i"), True), i=[1] * 7) == ""
    assert one(spark, tx.decode_chars(F.col("i")), i=[2, 2, 3]) == "aab"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=12), min_size=1, max_size=20))
def test_collapse_equals_a_loop(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, ids array<int>")
    got = {r.k: r.t for r in df.select("k", tx.decode_chars(F.col("ids"), True).alias("t")).collect()}
    for i, r in enumerate(rows):
        assert got[i] == "".join(tx.ALPHABET[x - 2] for x, _ in itertools.groupby(r) if x > 1)


def test_word_edits(spark):
    rnd = random.Random(12)
    rows = [([rnd.choice("abc") for _ in range(rnd.randrange(9))], [rnd.choice("abc") for _ in range(rnd.randrange(9))]) for _ in range(200)]
    rows.append(([f"w{i}" for i in range(700)], [f"w{i}" for i in range(1, 700)] + ["end"]))
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>").select("i", metrics.word_edits(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        a, b = rows[r.i]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert r.d == row[-1]


def test_error_rates(spark):
    df = spark.createDataFrame([("one two", "one two"), ("p q", "p q r"), ("p q r", "p q"), ("p q", "p z"), (" ", "x"), (None, "x")], "r string, h string")
    got = [r[0] for r in df.select(metrics.wer(F.col("r"), F.col("h"))).collect()]
    assert got[:4] == pytest.approx([0, 0.5, 1 / 3, 0.5]) and got[4:] == [None, None]
    assert one(spark, metrics.cer(F.col("r"), F.col("h")), r="abc", h="abcd") == pytest.approx(1 / 3)
    assert one(spark, metrics.char_accuracy(F.col("r"), F.col("h")), r="a", h="xyz") == 0


def test_ctc_against_all_paths():
    rng = np.random.default_rng(0)
    for target in ([2], [2, 2], [2, 3], []):
        p = rng.dirichlet(np.ones(4), 4)
        total = 0.0
        for path in itertools.product(range(4), repeat=4):
            if [k for k, _ in itertools.groupby(path) if k != 1] == target:
                total += math.prod(p[t, k] for t, k in enumerate(path))
        assert metrics.ctc(np.log(p), target) == pytest.approx(-math.log(total))
    assert metrics.ctc(np.log(p[:2]), [2, 2]) == 0.0  # impossible


def test_frames_and_hops(spark):
    for n, want in ((31999, 100), (32000, 100), (32321, 102)):
        assert one(spark, numeric.frames_for(F.col("n")), n=n) == want
    assert [one(spark, x) for x in numeric.sample_range(F.lit(11), F.lit(31))] == [3520, 9920]
    for seconds, planned, hops in ((2.0, 7, 7), (18.02, 9, 7)):
        n = F.lit(int(seconds * 16000)).cast("bigint")
        tiled = numeric.tiled_length(n)
        assert (one(spark, numeric.hop_count(tiled)), one(spark, numeric.effective_hops(tiled))) == (planned, hops)
    with pytest.raises(Exception, match="empty window"):
        one(spark, numeric.sample_range(F.lit(5), F.lit(5))[0])


def test_features(spark):
    df = spark.createDataFrame([("a", [2, 5, 2]), ("b", [3])], "k string, c array<int>")
    got = {(r.k, r.idx): r.val for r in arrays.features(df, "k", "c", codebook=8).collect()}
    assert got == pytest.approx({("a", 2): 1 / 3, ("a", 5): 1 / 6, ("a", 8 + 2023): 0.25, ("a", 8 + 5047): 0.25, ("b", 3): 1.0})
    assert {r.k: r.entropy for r in arrays.entropy(spark.createDataFrame([("u", list(range(8))), ("s", [1, 1])], "k string, c array<int>"), "k", "c").collect()} == pytest.approx({"u": 3.0, "s": 0.0})
    p = np.exp([2.0, 0, 0]) / np.exp([2.0, 0, 0]).sum()
    assert one(spark, arrays.el2n(F.col("f"), F.lit(1)), f=[p.tolist()]) == pytest.approx(0.2609, abs=1e-4)


def test_selectors(spark):
    ids = [f"v/{i:03d}" for i in range(140)]
    s = spark.createDataFrame([(u, 50.0 if i in (4, 8, 6) else float("nan") if i == 11 else 1.0, float(i), i % 5) for i, u in enumerate(ids)], "utterance_id string, ovr_mos double, loss_mean double, cluster_id int")
    assert [r[0] for r in select.top_k(s, "ovr_mos", 3).orderBy("utterance_id").collect()] == [ids[4], ids[6], ids[8]]
    assert ids[11] not in {r[0] for r in select.top_k(s, "ovr_mos", 139).collect()}
    assert {r[0] for r in select.select("lossrank", s, 5, None).collect()} == set(ids[:5])
    assert {r[0] for r in select.select("anti", s, 5, None).collect()} == set(ids[-5:])
    a, b = ({r[0] for r in select.round_robin(s, 10, x).collect()} for x in ("1", "2"))
    assert a != b and all(sum(int(u[2:]) % 5 == c for u in a) == 2 for c in range(5))
    for bad in (("kmeans", None), ("dnsmos", "1")):
        with pytest.raises(ValueError, match="seed"):
            select.select(bad[0], s, 5, bad[1])
    with pytest.raises(ValueError):
        select.top_k(s, "nothing", 5)
    w = spark.createDataFrame([(u, 8.0 if i >= 100 else 0.0) for i, u in enumerate(ids)], "utterance_id string, score_logit double")
    assert sum(int(r[0][2:]) >= 100 for r in select.gumbel_sample(w, 20, "x").collect()) >= 15
    assert [select.budget(31071, f) for f in (0.25, 0.1, 0.05)] == [7768, 3107, 1554]
    assert select.exact_sample(ids, 5, 1) == select.exact_sample(list(reversed(ids)), 5, 1)


def test_group_split(spark):
    rows = [(f"v{v:02d}/{k}", f"v{v:02d}", "trainval", k != 3) for v in range(10) for k in range(4)]
    df = spark.createDataFrame(rows, "utterance_id string, video_id string, split string, selectable boolean")
    got = select.group_split(df, "7", 6).collect()
    val = [r.utterance_id for r in got if r.part == "val"]
    assert len(got) == 30 and len(val) >= 6 and len(val) % 3 == 0
    assert not {u[:3] for u in val} & {r.utterance_id[:3] for r in got if r.part == "train"}
    assert {tuple(r) for r in select.group_split(df, "8", 6).collect()} != {tuple(r) for r in got}


def test_manifest_laws(spark):
    train, val = (spark.createDataFrame([(f"v/{i}",) for i in r], "utterance_id string") for r in (range(150), range(150, 200)))
    good = [f"v/{i}" for i in range(10)]
    for lines, law in ((good, None), (good[:5], "wrong-k"), (good[:5] * 2, "dup"), (good[:9] + [""], "blank"), (good[:9] + ["not an id"], "junk"), (good[:9] + ["v/160"], "val-leak"), (good[:9] + ["elsewhere/999"], "foreign-id")):
        df = spark.createDataFrame([(x,) for x in lines], "utterance_id string")
        assert check.first_violation(check.manifest_violations(df, train, val, 10)) == law
    with pytest.raises(ValueError, match="2 ids"):
        check.strict_semi_join(train, spark.createDataFrame([("v/1",), ("x",), ("y",)], "utterance_id string"))


def test_plan_errors(spark):
    df = spark.createDataFrame([("0\ttrack_b\ta\t1\tb\t0",), ("0\ttrack_b\ta\t1\tb\t0",)], "value string")
    with pytest.raises(ValueError, match="duplicate"):
        check.plan_lookup(df, "0")
    with pytest.raises(KeyError):
        check.plan_lookup(df.distinct(), "5")


def test_auc_and_ranks(spark):
    for scores, want in (((1, 2, 3, 4), 1.0), ((4, 3, 2, 1), 0.0), ((5, 5, 5, 5), 0.5)):
        df = spark.createDataFrame([(float(s), y) for s, y in zip(scores, (0, 0, 1, 1))], "s double, y int")
        assert stats.auc(df, "s", "y").first().auc == want
    with pytest.raises(Exception, match="single class"):
        stats.auc(spark.createDataFrame([(1.0, 1)], "s double, y int"), "s", "y").first()
    some = spark.createDataFrame([(1.0, 0), (None, 1), (float("nan"), 0), (2.0, 1)], "s double, y int")
    assert stats.auc(some, "s", "y").first().auc == 1.0  # rows without a score do not count
    assert sorted(r["rank"] or 0 for r in stats.ranked(some, "s").collect()) == [0, 0, 1, 2]
    rnd = random.Random(2)
    rows = [(float(rnd.randrange(30)), rnd.randrange(2)) for _ in range(200)]
    pos, neg = ([s for s, y in rows if y == k] for k in (1, 0))
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert stats.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first().auc == pytest.approx(want)


def test_published_statistics(spark):
    # Published validation error rates and the statistics that follow from them.
    floor = [0.6322, 0.6338, 0.6289, 0.6352, 0.6341]
    df = spark.createDataFrame([("random", x) for x in floor] + [("same", 0.6328), ("better", 0.6244)], "condition string, value double")
    z = {r.condition: r for r in stats.z_scores(df).collect()}
    sd = np.std(floor)
    assert z["better"].z == pytest.approx((0.6244 - np.mean(floor)) / (sd * math.sqrt(1 + 1 / 5)))
    p = {r.condition: r.p for r in stats.z_scores(df).select("condition", stats.two_sided_p("z").alias("p")).collect()}
    assert p["better"] == pytest.approx(math.erfc(abs(z["better"].z) / math.sqrt(2)))
    t = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.04), ("d", 0.03)], "condition string, p double")
    assert {r.condition: r.reject for r in stats.holm(t).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_importance_fit(spark):
    pool = spark.createDataFrame([(f"p{i}", [2 + (i + k) % 5 for k in range(6)]) for i in range(40)], "utterance_id string, codes array<int>")
    target = spark.createDataFrame([(f"t{i}", [1] * 6) for i in range(10)], "utterance_id string, codes array<int>")
    x = [models.vectors(arrays.features(d, "utterance_id", "codes", 8, 64), "utterance_id", 72) for d in (pool, target)]
    got = models.importance(*x, 1e-3).collect()
    assert len(got) == 40 and all(r.score_logit < 0 for r in got) and max(r.weight for r in got) == 1
    s = models.sweep(*x, 5, [1e-3])
    assert s[0]["held_out_auc"] == 1.0 and s[0]["held_out_logloss"] < 0.7


def test_readers_and_writers(spark, tmp_path):
    root = tmp_path / "tree"
    for p, content in (("trainval/v1/50001.txt", "Text:  HI\nConf:  3\n"), ("trainval/tree/9.mp4", "x"), ("trainval/v1/50001.mp4", "x"), ("trainval/v1/50002.txt", "oops"), ("test/7.txt", "Text: A")):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(content)
    files = readers.scan_tree(spark, str(root), content=True).cache()
    assert sorted((r.split, r.video_id, r.stem, r.suffix) for r in files.collect()) == [("test", "", "7", ".txt"), ("trainval", "tree", "9", ".mp4"), ("trainval", "v1", "50001", ".mp4"), ("trainval", "v1", "50001", ".txt"), ("trainval", "v1", "50002", ".txt")]
    assert {(r.stem, r.text_raw, r.conf, r.kind) for r in readers.transcripts(files).collect()} == {("50001", "HI", 3, None), ("50002", "", None, "unparsable_transcript"), ("7", "A", None, None)}
    assert {r.stem for r in readers.orphans(files, ".txt", ".mp4").collect()} == {"50002", "7"}
    ids = spark.createDataFrame([("b/2",), ("a/1",), ("a/1",)], "utterance_id string")
    about = writers.write_manifest(ids, ids.agg(F.count("*").alias("k")), str(tmp_path / "m"), {"seed": 1})
    assert about == {"k": 3, "seed": 1}
    assert sorted(r[0] for r in readers.read_id_list(spark, str(tmp_path / "m.ids")).collect()) == ["a/1", "b/2"]
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": [1, 2]}, "b": 2}')
    (tmp_path / "own.json").write_text('{"base": "base.json", "a": {"y": [3]}}')
    assert readers.load_config(tmp_path / "own.json") == {"a": {"x": 1, "y": [3]}, "b": 2}
    (tmp_path / "base.json").write_text('{"base": "own.json"}')
    with pytest.raises(ValueError, match="cycle"):
        readers.load_config(tmp_path / "own.json")
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000), w.writeframes(np.arange(100, dtype="<i2").tobytes())
    got = readers.wave(spark, str(tmp_path)).first()
    assert (got.rate, got.n_samples) == (16000, 100) and got.samples[2] == pytest.approx(2 / 32768)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = streaming.run_to_end(streaming.daily(stream), str(tmp_path / "daily"), str(tmp_path / "ck"))
    want = streaming.daily(events)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    late = streaming.run_to_end(streaming.daily(stream, "1 day"), str(tmp_path / "late"), str(tmp_path / "ck2"), "append")
    assert late.join(want, ["day", "event_type"], "left_anti").count() == 0
    assert streaming.progress(30, 100, 10, 10.0) == {"rate": 2.0, "eta_s": 35.0}


def test_uniform_and_schedule(spark):
    u = [r[0] for r in spark.range(4000).select(numeric.uniform("s", F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02
    lr = [r[0] for r in spark.range(100).select(numeric.learning_rate(F.col("id"), 10, 90)).collect()]
    assert lr[0] == 0.1 and lr[9] == 1.0 and lr[95] == 1e-8


def test_row_numbers(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(50), f"k{i}", i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "x int, k string, g int")
    got = sorted((r.row, r.x, r.k) for r in stats.numbered(df, ["x", "k"]).collect())
    assert [g[1:] for g in got] == sorted((x, k) for x, k, _ in rows) and [g[0] for g in got] == list(range(500))
    each = sorted((r.g, r.row, r.k) for r in stats.numbered(df, ["k"], by="g").collect())
    assert [k for *_, k in each] == [k for _, k in sorted((g, k) for _, k, g in rows)]


def test_ranks_of_values_that_change_with_each_evaluation(spark):
    drawn = F.udf(lambda i: i + random.random() / 2, "double").asNondeterministic()
    rows = spark.range(50).select("id", drawn("id").alias("a"), drawn("id").alias("b"))
    assert {r.id: r["rank"] for r in stats.ranked(rows, "a").collect()} == {i: i + 1 for i in range(50)}
    assert stats.spearman(rows, "a", "b").first().rho == pytest.approx(1)
    labelled = rows.select("a", (F.col("id") >= 25).cast("int").alias("label"))
    assert stats.auc(labelled, "a", "label").first().auc == 1


def test_fits_reach_the_minimum(spark):
    rnd = np.random.default_rng(5)
    x = rnd.random((90, 12)) * (rnd.random((90, 12)) < 0.4) * np.r_[np.full(6, 1e-3), np.ones(6)]  # rare and small features beside large ones
    label, held = (np.arange(90) % 6 == 0).astype(float), np.arange(90) % 5 == 0
    sparse = [SparseVector(12, np.flatnonzero(r), r[r != 0]) if i % 2 else DenseVector(r) for i, r in enumerate(x)]
    rows = spark.createDataFrame([(i, float(label[i]), bool(held[i]), v) for i, v in enumerate(sparse)], StructType([StructField("k", LongType()), StructField("label", DoubleType()), StructField("held", BooleanType()), StructField("features", VectorUDT())])).repartition(3)
    blocks = models.packed(rows, "k")
    fits = [models.Fit(l2, h) for l2 in (1e-5, 1e-2) for h in (True, False)]
    got = models.fitted(blocks, fits)
    for fit, w in zip(fits, got, strict=True):
        use = ~held if fit.held_out else np.ones(90, bool)
        a, y = x[use], label[use]
        c = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        want = np.zeros(12)
        for _ in range(50):  # Newton
            p = 1 / (1 + np.exp(-a @ want))
            want -= np.linalg.solve((a.T * (c * p * (1 - p))) @ a + fit.l2 * np.eye(12), a.T @ (c * (p - y)) + fit.l2 * want)
        assert np.linalg.norm(w - want) <= 2e-6 * max(1, np.linalg.norm(want))
    z = {r.k: r.z for r in models._logits(blocks, "k", got).collect()}
    assert len(z) == 90 and np.allclose([z[i][3] for i in range(90)], x @ got[3])
