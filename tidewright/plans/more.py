"""Registered queries of the run workflow: splits, subsets, paths, plans, verdicts, evaluation, influence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, numeric
from ..functions import text as tx
from ..operators import check, evaluate, select, workflow
from ..operators import metrics as stats
from ..scratch import scratch_path
from .registry import C, _cond, _Z, loss, parts, q
from .views import Views, u_sql

# --- tensor rows ---------------------------------------------------------------------
_STREAMS = "list_transform(range(8), lambda s: list_transform(codes, lambda c: (c + s) % 1024))"
_joined = lambda c: F.md5(F.array_join(F.flatten(c).cast("array<string>"), ","))
q("dataset_items", lambda v: v.streams.select("utterance_id", F.size(F.get("tokens", F.lit(0))).alias("n_tokens"), _joined(C("tokens")).alias("tokens_md5"), F.array_join(tx.encode_chars(C("text_norm")).cast("array<string>"), ",").alias("text_ids")),
  f"SELECT utterance_id, len(codes)::INTEGER AS n_tokens, md5(coalesce(array_to_string(flatten({_STREAMS}), ','), '')) AS tokens_md5, coalesce(array_to_string(list_filter(list_transform(list_filter(string_split(text_norm, ''), lambda c: c <> ''), lambda c: instr('abcdefghijklmnopqrstuvwxyz ''', c) + 1), lambda i: i > 1), ','), '') AS text_ids FROM tokens JOIN utt USING (utterance_id)", "utt", "tokens")
q("batch_padding", lambda v: arrays.pad_batch(v.streams.withColumn("batch", F.expr("doc_id div 16")), "batch", "tokens", -1).select("utterance_id", "length", _joined(C("padded")).alias("padded_md5"), F.size("mask").alias("n"), F.size(F.filter("mask", lambda m: m)).alias("real")),
  f"SELECT utterance_id, len(codes)::INTEGER AS length, md5(coalesce(array_to_string(flatten(list_transform({_STREAMS}, lambda s: list_concat(s, list_transform(range(n - len(codes)), lambda i: -1)))), ','), '')) AS padded_md5, n::INTEGER AS n, len(codes)::INTEGER AS real FROM (SELECT *, max(len(codes)) OVER (PARTITION BY doc_id // 16) AS n FROM tokens)", "tokens")
q("wave_slices", lambda v: v.vectors.select("vec_id", F.array_join(F.transform(arrays.slice_wave(C("v"), C("vec_id") % 4, C("vec_id") % 4 + 3, 4), lambda x: F.round(x * 1000).cast("bigint")).cast("array<string>"), ",").alias("samples")),
  "SELECT vec_id, array_to_string(list_transform(v[(vec_id % 4) * 4 + 1 : (vec_id % 4 + 3) * 4], lambda x: round(x * 1000)::BIGINT), ',') AS samples FROM vectors", "vectors")


def _augment_sql() -> str:
    draw = lambda name, n, k: f"floor({u_sql('aug|' + name, k)} * ({n} + 1))"
    band = [(draw(f"from{b}", f"8 - {draw(f'band{b}', 3, chr(39) + 'all' + chr(39))}", "'all'"), draw(f"band{b}", 3, "'all'")) for b in range(2)]
    span = [(draw(f"at{b}", f"8 - {draw(f'span{b}', 'floor(8 * 0.3::DOUBLE)', 'vec_id')}", "vec_id"), draw(f"span{b}", "floor(8 * 0.3::DOUBLE)", "vec_id")) for b in range(2)]
    channel = " OR ".join(f"(j - 1 >= {a} AND j - 1 < {a} + {w})" for a, w in band)
    time = " OR ".join(f"(i - 1 >= {a} AND i - 1 < {a} + {w})" for a, w in span)
    return f"SELECT vec_id, array_to_string(flatten(list_transform(frames, lambda f, i: list_transform(f, lambda x, j: CASE WHEN {channel} OR {time} THEN 0 ELSE round(x * 1000)::BIGINT END))), ',') AS masked FROM frames"


q("spec_augment", lambda v: v.frames.select("vec_id", F.array_join(F.transform(F.flatten(arrays.spec_augment(C("frames"), C("vec_id"), "aug", 8, band_width=3, span_share=0.3)), lambda x: F.round(x * 1000).cast("bigint")).cast("array<string>"), ",").alias("masked")), _augment_sql(), "frames")

q("shape_anomalies", lambda v: check.anomaly_report(check.shape_anomalies(v.streams.join(v.utt.select("utterance_id", "split"), "utterance_id").withColumn("tokens", F.when(C("doc_id") % 9 == 0, F.slice("tokens", 1, 7)).when(C("doc_id") % 9 == 1, F.array_append("tokens", F.array(F.lit(1)))).when(C("doc_id") % 9 == 2, F.concat(F.slice("tokens", 1, 7), F.array(F.array(F.lit(-1))))).otherwise(C("tokens"))), "tokens", 8)).select("kind", "n", F.size("examples").alias("examples")),
  "SELECT split || '_bad_shape' AS kind, count(*) AS n, least(count(*), 50)::INTEGER AS examples FROM tokens WHERE doc_id % 9 < 2 OR (doc_id % 9 = 2 AND len(codes) <> 1) GROUP BY 1", "tokens")

# --- audits, splits, subsets -----------------------------------------------------------
q("audit_report", lambda v: v.utt.agg(F.count("*").alias("n"), F.count_if(C("split") == "test").alias("test"), F.count_if("selectable").alias("selectable"), F.count_if(C("conf").isNull()).alias("no_conf")).select(F.to_json(F.struct("n", "test", F.struct("selectable", "no_conf").alias("rows"))).alias("report")),
  """SELECT '{"n":' || count(*) || ',"test":' || count(*) FILTER (split = 'test') || ',"rows":{"selectable":' || count(*) FILTER (selectable) || ',"no_conf":' || count(*) FILTER (conf IS NULL) || '}}' AS report FROM utt""", "utt")


def _split_frames(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = parts(v).join(v.utt.select("utterance_id", "duration_s"), "utterance_id")
    test = v.utt.filter("split = 'test'").select("utterance_id", "duration_s", F.concat("stem", F.lit(".mp4")).alias("audio_path"), tx.relpath(C("video_id"), C("stem"), ".tokens.pt").alias("tokens_path"))
    return rows.filter("part = 'train'"), rows.filter("part = 'val'"), test


_FROZEN = "SELECT '{0}' AS file, count(*) AS n, round(sum(duration_s) / 3600, 3) AS hours, sha256({1}string_agg({2}, chr(10) ORDER BY utterance_id) || chr(10)) AS sha256 FROM {3}"
_HEAD = "'# official test split: paths only' || chr(10) || '# not to be read before the final evaluation' || chr(10) || 'utterance_id' || chr(9) || 'audio_path' || chr(9) || 'tokens_path' || chr(10) || "
q("freeze_manifest", lambda v: workflow.freeze(*_split_frames(v)), " UNION ALL ".join([
    *(_FROZEN.format(f"{p}_ids.txt", "", "utterance_id", f"(SELECT parts.utterance_id, duration_s FROM parts JOIN utt USING (utterance_id) WHERE part = '{p}')") for p in ("train", "val")),
    _FROZEN.format("test_pointers.tsv", _HEAD, "utterance_id || chr(9) || stem || '.mp4' || chr(9) || utterance_id || '.tokens.pt'", "utt WHERE split = 'test'")]), "utt", "parts")


def _pools(v: Views) -> workflow.Pools:
    p = parts(v)
    return workflow.Pools(v.utt, p.filter("part = 'train'").select("utterance_id"), p.filter("part = 'val'").select("utterance_id"))


def _written_subset(v: Views) -> DataFrame:
    """A subset as it lies on disk after it was chosen, written and checked again."""
    folder = scratch_path(v.spark, "subsets")
    workflow.make_subset(_pools(v), "anti", loss(v), 0.1, None, folder)
    return v.spark.read.text(f"{folder}/anti_10pct.ids").withColumnRenamed("value", "utterance_id")


q("manifest_revalidate", _written_subset, "SELECT utterance_id FROM loss WHERE utterance_id IN (SELECT utterance_id FROM parts WHERE part = 'train') ORDER BY loss_mean DESC, utterance_id LIMIT (SELECT floor(count(*) * 0.1::DOUBLE + 0.5)::BIGINT FROM pool)", "loss", "parts")


def _batch_status(v: Views) -> DataFrame:
    pools, tables = _pools(v), {"dnsmos": v.dnsmos, "anti": v.dnsmos, "kmeans": v.clusters}

    def make(selector: str, seed: str | None) -> None:
        ids, k = workflow.choose(pools, selector, tables[selector], 0.05, seed)
        workflow.require_laws(ids, pools, k)

    done = workflow.run_batch(v.spark, [("anti", None), *workflow.batch(["dnsmos", "kmeans"]), ("dnsmos", "7")], make)
    return done.select("selector", F.coalesce("seed", F.lit("")).alias("seed"), "ok", "reason")


q("batch_status", _batch_status, "SELECT * FROM (VALUES ('anti', '', false, 'no column loss_mean'), ('dnsmos', '', true, ''), ('kmeans', '201', true, ''), ('kmeans', '202', true, ''), ('kmeans', '203', true, ''), ('dnsmos', '7', false, 'dnsmos: a seed is not accepted')) t(selector, seed, ok, reason)")

# --- paths ---------------------------------------------------------------------------
_some_files = lambda v: v.pool.filter("doc_id % 3 <> 0").select(tx.relpath(C("video_id"), C("stem"), ".tokens.pt").alias("relpath"))
q("preflight", lambda v: workflow.preflight(v.pool, _some_files(v)), f"SELECT utterance_id, utterance_id || '.tokens.pt' AS relpath, doc_id % 3 <> 0 AS there FROM pool ORDER BY {u_sql('20260826', 'utterance_id')}, utterance_id LIMIT 50", "pool")
q("absent_paths", lambda v: workflow.absent_paths(v.pool, _some_files(v), "tokens"), "SELECT utterance_id, utterance_id || '.tokens.pt' AS relpath FROM pool WHERE doc_id % 3 = 0", "pool")
q("legacy_paths", lambda v: workflow.expected_paths(v.utt.withColumn("audio_path", F.when(C("doc_id") % 2 == 0, F.concat(F.lit("old/root/"), "stem", F.lit(".mp4"))).otherwise(F.concat("stem", F.lit(".wav")))), "audio", "legacy", "old/root/"), "SELECT utterance_id, stem || CASE WHEN doc_id % 2 = 0 THEN '.mp4' ELSE '.wav' END AS relpath FROM utt", "utt")
q("staging_jobs", lambda v: workflow.staging_jobs(v.utt.select("*", (C("doc_id") % 2 == 0).alias("has_text"), F.concat(F.lit("raw/"), "stem", F.lit(".mp4")).alias("audio_path")), "/src/"),
  "SELECT '/src/' || split || '/' || utterance_id || '.tokens.pt' AS src, utterance_id || '.tokens.pt' AS rel, 'tokens' AS kind FROM utt UNION ALL SELECT '/src/' || split || '/' || utterance_id || '.txt', utterance_id || '.txt', 'transcript' FROM utt WHERE doc_id % 2 = 0 UNION ALL SELECT 'raw/' || stem || '.mp4', utterance_id || '.flac', 'audio' FROM utt", "utt")

# --- plans, checkpoints, verdicts --------------------------------------------------------
_plan = lambda v: v.table("nation").select(C("n_nationkey").cast("string").alias("task"), F.lit("track_b").alias("track"), F.concat("n_name", F.lit(".txt")).alias("subset_manifest"), (C("n_regionkey") + 200).cast("string").alias("seed"), F.lit("b.yaml").alias("config_yaml"), (C("n_nationkey") % 2).cast("string").alias("keep_local_traj"))
q("plan_render", lambda v: workflow.plan_lines(_plan(v), ["first", "second"]),
  "SELECT * FROM (VALUES (-3::BIGINT, '# first'), (-2, '# second'), (-1, '" + "' || chr(9) || '".join(check.PLAN_COLUMNS) + "')) t(place, line) UNION ALL SELECT n_nationkey, n_nationkey || chr(9) || 'track_b' || chr(9) || n_name || '.txt' || chr(9) || (n_regionkey + 200) || chr(9) || 'b.yaml' || chr(9) || (n_nationkey % 2) FROM nation")
q("plan_check", lambda v: workflow.plan_is_current(_plan(v), ["x"], workflow.plan_lines(_plan(v).repartition(3), ["x"])).select(F.lit("fresh").alias("plan"), "same").union(workflow.plan_is_current(_plan(v), ["x"], workflow.plan_lines(_plan(v), ["y"])).select(F.lit("stale"), "same")), "SELECT 'fresh' AS plan, true AS same UNION ALL SELECT 'stale', false")
q("checkpoint_list", lambda v: workflow.checkpoints(v.table("orders").select(F.when(C("o_orderkey") % 7 == 0, F.format_string("ckpt_epoch%04d.ckpt", C("o_orderkey") % 60)).when(C("o_orderkey") % 7 == 1, "last.ckpt").otherwise(F.format_string("ckpt_epoch%d.ckpt", C("o_orderkey") % 60)).alias("name")).distinct()), "SELECT DISTINCT (o_orderkey % 60)::INTEGER AS epoch, printf('ckpt_epoch%04d.ckpt', (o_orderkey % 60)::INTEGER) AS name FROM orders WHERE o_orderkey % 7 = 0")
q("verdict_merge", lambda v: (lambda n: workflow.merge_verdicts(n, n.filter("k % 5 = 0").select("run_id", F.lit("marker absent").alias("why")), n.filter("k % 3 <> 1").select("run_id", F.when(C("k") % 2 == 0, "log too short").otherwise("").alias("why"))))(v.table("nation").select(C("n_name").alias("run_id"), C("n_nationkey").alias("k"))),
  "SELECT n_name AS run_id, CASE WHEN n_nationkey % 5 = 0 THEN 'marker absent' WHEN n_nationkey % 3 = 1 THEN 'no verdict' WHEN n_nationkey % 2 = 0 THEN 'log too short' ELSE '' END AS reason FROM nation")
_runs = lambda v: v.table("nation").select(C("n_name").alias("run_id"), C("n_nationkey").alias("k"))
q("attestations", lambda v: workflow.attestations(_runs(v).select("run_id", F.explode(F.array_compact(F.array(F.lit("config.json"), F.when(C("k") % 2 == 0, "metrics.parquet"), F.when(C("k") % 3 != 0, "last.ckpt")))).alias("name")), _runs(v).filter("k % 4 = 0 OR k % 6 = 2").select("run_id", F.explode(F.when(C("k") % 4 == 0, F.array(F.lit("train"), F.lit("val"))).otherwise(F.array(F.lit("val")))).alias("split"))),
  "SELECT n_name AS run_id, coalesce(array_to_string(list_filter([CASE WHEN k % 2 = 1 THEN 'metrics.parquet' WHEN k % 4 <> 0 THEN 'rows of both splits' END, CASE WHEN k % 3 = 0 THEN 'last.ckpt' END], lambda x: x IS NOT NULL), ', '), '') AS lacking FROM (SELECT *, n_nationkey AS k FROM nation)")


def _verdicts(v: Views) -> DataFrame:
    """Twenty-five runs, of which each of the reasons strikes at least one."""
    r = _runs(v).withColumn("k", C("k") % 14)
    many = F.transform(F.sequence(F.lit(1), F.when(C("k") == 3, 30).otherwise(3)), lambda i: F.concat(F.lit("f"), i.cast("string")))
    names = F.concat(many, F.array_compact(F.array(F.when(C("k") != 1, "COMPLETED"), F.when(C("k") != 2, "last.ckpt"))))
    splits = F.when(C("k") == 4, F.array().cast("array<string>")).when(C("k") == 5, F.array(F.lit("val"))).when(C("k") == 6, F.array(F.lit("train"))).otherwise(F.array(F.lit("train"), F.lit("val")))
    has = [F.when(C("k") != 9 + i, F.lit(f'"{name}":1')) for i, name in enumerate(check.MANIFEST_KEYS)] + [F.when(C("k") != 13, F.lit('"train_seed":1'))]
    text = F.when(C("k") == 8, "{").otherwise(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*has)), ","), F.lit("}")))
    return check.bundle_verdicts(r.select("run_id", F.explode(names).alias("name")), r.select("run_id", F.explode(splits).alias("split")), r.filter("k <> 7").select("run_id", text.alias("manifest")))


_REASONS = ["", "not marked as complete", "no last checkpoint", f"over {check.MOST_FILES} files", "metric log absent", "metric log: no train rows", "metric log: no validation rows", "manifest absent", "manifest unreadable", *(f"manifest lacks {k}" for k in check.MANIFEST_KEYS), "manifest lacks a seed"]
q("bundle_verdicts", _verdicts, "SELECT n_name AS run_id, [" + ", ".join(f"'{r}'" for r in _REASONS) + "][n_nationkey % 14 + 1] AS reason FROM nation")
q("protocol_checks", lambda v: workflow.protocol_problems(v.table("part").select("p_partkey", F.lit(50).alias("crop_frames"), F.lit(16000).alias("sample_rate"), F.lit(50).alias("token_hz"), (16000 + F.when(C("p_partkey") % 3 == 0, 1).otherwise(0)).alias("crop_samples"), (C("p_partkey") % 5 - 3).alias("token_pad_id"), F.lit(1).alias("codebook_size"), (C("p_size") + 10).alias("min_crop_frames"))).select("p_partkey", "problem"),
  "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'crop samples' WHEN p_partkey % 5 = 3 THEN 'pad id' WHEN p_size + 10 > 50 THEN 'shortest crop' END AS problem FROM part")
q("spread_gate", lambda v: workflow.spread_gate(stats.z_scores(_cond(v))).select(F.round("spread", 6).alias("spread"), F.round("sigma", 6).alias("sigma"), "open"), f"SELECT round(max(delta) - min(delta), 6) AS spread, round(max(abs(delta / z)), 6) AS sigma, max(delta) - min(delta) > max(abs(delta / z)) AS open FROM ({_Z})")
q("spot_check_report", lambda v: workflow.spot_lines(v.utt.orderBy(numeric.uniform("spot", C("utterance_id")), "utterance_id").limit(10), C("conf") * 0.7).select("place", F.substring("line", 1, 60).alias("line"), F.endswith("line", F.lit("WARNING duration")).alias("warned")),
  f"SELECT place, substr('[' || lpad(place::VARCHAR, 2, '0') || '] ' || utterance_id || ' frames=' || n_tokens || ' text=' || text_norm || w, 1, 60) AS line, w <> '' AS warned FROM (SELECT *, row_number() OVER (ORDER BY utterance_id)::INTEGER AS place, CASE WHEN abs(conf * 0.7::DOUBLE - duration_s) > greatest(0.15::DOUBLE, duration_s * 0.05::DOUBLE) THEN ' WARNING duration' ELSE '' END AS w FROM (SELECT * FROM utt ORDER BY {u_sql('spot', 'utterance_id')}, utterance_id LIMIT 10))", "utt")
q("resume_union", lambda v: (lambda done: done.unionByName(v.pool.select("utterance_id").join(done.select("utterance_id"), "utterance_id", "left_anti").select("utterance_id", F.lit(0).cast("bigint").alias("n_ckpts"))))(loss(v).filter("n_ckpts = 3").select("utterance_id", "n_ckpts")), "SELECT utterance_id, CASE WHEN n_ckpts = 3 THEN 3 ELSE 0 END::BIGINT AS n_ckpts FROM pool LEFT JOIN loss USING (utterance_id)", "pool", "loss")

# --- evaluation ----------------------------------------------------------------------
_eval = lambda v: v.frames.select(C("vec_id").cast("string").alias("utterance_id"), "frames", "n_frames", F.when(C("vec_id") % 11 == 0, "").otherwise(F.substring(F.lit("abcdef"), (C("vec_id") % 5 + 1).cast("int"), (C("vec_id") % 2 + 1).cast("int"))).alias("text_norm"))
_EVAL = """SELECT vec_id::VARCHAR AS utterance_id, n_frames, CASE WHEN vec_id % 11 = 0 THEN '' ELSE substr('abcdef', vec_id % 5 + 1, vec_id % 2 + 1) END AS ref, coalesce(array_to_string(list_transform(list_filter(g, lambda x, i: x > 1 AND (i = 1 OR x <> g[i - 1])), lambda x: substr('abcdefghijklmnopqrstuvwxyz ''', x - 1, 1)), ''), '') AS hyp
  FROM (SELECT vec_id, n_frames, list_transform(frames[1:n_frames], lambda f: list_position(f, list_max(f)) - 1) AS g FROM frames)"""
_RATED = f"SELECT *, CASE WHEN ref = '' THEN NULL WHEN ref = hyp THEN 0.0 ELSE 1.0 END AS wer, CASE WHEN ref <> '' THEN levenshtein(ref, hyp) / length(ref) END AS cer FROM ({_EVAL}) WHERE n_frames >= length(ref)"
q("evaluate_predictions", lambda v: evaluate.predictions(_eval(v)).select("utterance_id", "ref", "hyp", F.round("wer", 6).alias("wer"), F.round("cer", 6).alias("cer")), f"SELECT utterance_id, ref, hyp, round(wer::DOUBLE, 6) AS wer, round(cer, 6) AS cer FROM ({_RATED})", "frames")
q("evaluation_summary", lambda v: (lambda e: evaluate.summary(e, evaluate.predictions(e)).select("n_utterances", "dropped", F.round("mean_wer", 6).alias("mean_wer"), F.round("mean_cer", 6).alias("mean_cer")))(_eval(v)), f"SELECT count(*) AS n_utterances, (SELECT count(*) FROM ({_EVAL}) WHERE n_frames < length(ref)) AS dropped, round(avg(wer::DOUBLE), 6) AS mean_wer, round(avg(cer), 6) AS mean_cer FROM ({_RATED})", "frames")
q("hop_means", lambda v: evaluate.hop_means(v.utt.select("utterance_id", F.explode(F.sequence(F.lit(0), C("n_tokens") % 5)).alias("hop")).select("utterance_id", *[(1 + 4 * numeric.uniform(c, F.concat_ws("|", "utterance_id", C("hop").cast("string")))).alias(c) for c in numeric.CALIBRATION])).select("utterance_id", *[F.round(f"{c}_{k}", 6).alias(f"{c}_{k}") for c in numeric.CALIBRATION for k in ("raw", "mos")], "n_hops"),
  "SELECT utterance_id, " + ", ".join(f"round(avg({c}), 6) AS {c}_raw, round(avg({a!r}::DOUBLE * {c} * {c} + {b!r}::DOUBLE * {c} + {d!r}::DOUBLE), 6) AS {c}_mos" for c, (a, b, d) in numeric.CALIBRATION.items()) + ", count(*)::INTEGER AS n_hops FROM (SELECT utterance_id, " + ", ".join(f"1 + 4 * {u_sql(c, 'k')} AS {c}" for c in numeric.CALIBRATION) + " FROM (SELECT utterance_id, utterance_id || '|' || unnest(range(n_tokens % 5 + 1)) AS k FROM utt)) GROUP BY 1", "utt")

# --- influence over checkpoints ----------------------------------------------------------
_DIMS = 16


def _trajectory(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = v.vectors.select(C("vec_id").cast("string").alias("utterance_id"), "label", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ckpt"), "v", "vec_id").select("utterance_id", "label", "ckpt", "vec_id", F.transform("v", lambda x: x * C("ckpt") + 0.01).alias("v"))
    each = rows.filter("label = 1").select("ckpt", F.posexplode("v").alias("i", "x")).groupBy("ckpt", "i").agg(F.avg("x").alias("x"))
    mean = each.groupBy("ckpt").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return rows.filter("vec_id % 5 <> ckpt").select("utterance_id", "ckpt", "v"), mean


def _influence(v: Views, seed: str) -> DataFrame:
    return evaluate.influence_over_checkpoints(*_trajectory(v), seed, 64, _DIMS)


def _influence_sql(seed: str) -> str:
    return f"""(WITH cell AS (SELECT vec_id, label, ckpt, i, v[i + 1] * ckpt + 0.01::DOUBLE AS x FROM vectors, range(1, 4) c(ckpt), range(64) t(i)),
      p AS (SELECT i, j, CASE WHEN {u_sql(seed, "i || '|' || j")} < 0.5 THEN 1 ELSE -1 END / {_DIMS ** 0.5} AS p FROM range(64) a(i), range({_DIMS}) b(j)),
      r AS (SELECT ckpt, i, avg(x) AS x FROM cell WHERE label = 1 GROUP BY ALL), s AS (SELECT ckpt, j, sum(x * p) AS s FROM r JOIN p USING (i) GROUP BY ALL), u AS (SELECT ckpt, i, sum(s * p) AS q FROM s JOIN p USING (j) GROUP BY ALL)
      SELECT vec_id::VARCHAR AS utterance_id, avg(d) AS influence FROM (SELECT vec_id, ckpt, sum(x * q) AS d FROM cell JOIN u USING (ckpt, i) WHERE vec_id % 5 <> ckpt GROUP BY ALL) GROUP BY 1)"""


q("influence_mean", lambda v: _influence(v, "201").select("utterance_id", F.round("influence", 6).alias("influence")), f"SELECT utterance_id, round(influence, 6) AS influence FROM {_influence_sql('201')}", "vectors")
q("select_less", lambda v: select.select("less_ctc", _influence(v, "201"), 100, "201"), f"SELECT utterance_id FROM {_influence_sql('201')} ORDER BY influence DESC, utterance_id LIMIT 100", "vectors")
_RANKED = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"
q("rank_agreement", lambda v: evaluate.rank_agreement(_influence(v, "201"), _influence(v, "202").filter("utterance_id NOT LIKE '%3'"), "influence").select(F.round("rho", 6).alias("rho")), f"SELECT round(corr(ra, rb), 6) AS rho FROM (SELECT {_RANKED.format('a')} AS ra, {_RANKED.format('b')} AS rb FROM (SELECT x.influence AS a, y.influence AS b FROM {_influence_sql('201')} x JOIN {_influence_sql('202')} y ON x.utterance_id = y.utterance_id WHERE y.utterance_id NOT LIKE '%3'))", "vectors")
