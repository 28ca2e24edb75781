"""Registered queries: each is one operator over whole tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, metrics, numeric
from ..functions import text as tx
from ..operators import check, models, select
from ..operators import metrics as stats
from ..sources import readers, writers
from .views import Views, spelt, u_sql, with_views, _numbers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col


def query(name: str, sql: str | None = None, *views: str):
    def add(f: Callable[[Views], DataFrame]):
        from ..session import ship

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(Views(spark, folder))

        QUERIES[name] = run
        if sql:
            SQL[name] = with_views(sql, *views)
        return f

    return add


def q(name: str, f: Callable[[Views], DataFrame], sql: str | None = None, *views: str) -> None:
    query(name, sql, *views)(f)


def _target(v: Views) -> int:
    return v.pool.count() * 65 // 1000


def parts(v: Views) -> DataFrame:
    return select.group_split(v.utt, "split", _target(v)).join(v.pool.select("utterance_id", "video_id"), "utterance_id")


def loss(v: Views) -> DataFrame:
    return v.proxy.groupBy("utterance_id").agg(F.avg("loss").alias("loss_mean"), F.avg("el2n").alias("el2n_mean"), F.count("*").alias("n_ckpts"))


# --- sources -------------------------------------------------------------------------
q("scan_by_split", lambda v: v.utt.filter("split = 'trainval'").select("utterance_id", "n_tokens", "duration_s"), "SELECT utterance_id, n_tokens, duration_s FROM utt WHERE split = 'trainval'", "utt")
q("scan_projection", lambda v: v.table("lineitem").filter(C("l_quantity") > 49).select("l_orderkey", "l_quantity"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
q("union_discovered", lambda v: readers.id_text([v.table("documents").select("doc_id", "text"), v.table("benchmark").select("item_id", "text")], ["doc_id", "item_id"]), "SELECT doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT item_id::VARCHAR, text FROM benchmark")
q("stream_zero", lambda v: v.streams.select("utterance_id", F.array_join(F.get("tokens", F.lit(0)).cast("array<string>"), ",").alias("codes")), "SELECT utterance_id, coalesce(array_to_string(codes, ','), '') AS codes FROM tokens", "tokens")
_IDS = ["# comment", "", "   ", "vid/utt001", " vid/utt002 ", "vid/utt001", "  # more"]
q("id_list", lambda v: readers.id_list(v.lines(_IDS)), "SELECT DISTINCT trim(x) AS utterance_id FROM (VALUES " + ", ".join(f"('{x}')" for x in _IDS) + ") t(x) WHERE trim(x) <> '' AND NOT starts_with(trim(x), '#')")
_content = lambda: F.concat(F.lit("Text:  "), C("text_raw"), F.when(C("conf").isNotNull(), F.concat(F.lit("\nConf:  "), C("conf").cast("string"))).otherwise(""))
q("transcripts", lambda v: v.utt.select("utterance_id", tx.transcript_text(_content()).alias("text"), tx.transcript_conf(_content()).alias("conf_read")),
  r"""SELECT utterance_id, CASE WHEN regexp_matches(c, '^Text:\s+(.*?)\s*(?:\nConf:\s+(\d+))?\s*$', 's') THEN regexp_extract(c, '^Text:\s+(.*?)\s*(?:\nConf:\s+(\d+))?\s*$', 1, 's') END AS text, nullif(regexp_extract(c, '^Text:\s+(.*?)\s*(?:\nConf:\s+(\d+))?\s*$', 2, 's'), '')::INTEGER AS conf_read
  FROM (SELECT utterance_id, 'Text:  ' || text_raw || CASE WHEN conf IS NOT NULL THEN chr(10) || 'Conf:  ' || conf ELSE '' END AS c FROM utt)""", "utt")
_PLAN = ["# plan", "\t".join(check.PLAN_COLUMNS), "0\ttrack_b\tfull.txt\t1\tb.yaml\t0", "1\ttrack_b\trandom_25pct_seed101.txt\t2\tb.yaml\t1", "2\ttrack_x\ta.txt\t3\tb.yaml\t0", "3\ttrack_a\ta.txt\tx\tb.yaml\t0", "4\ttrack_a\t\t3\tb.yaml\t0", "5\ttrack_a\ta.txt", "6\ttrack_a\ta.txt\t3\ta.yaml\t0", "6\ttrack_a\ta.txt\t4\ta.yaml\t0", "x\ttrack_a\ta.txt\t4\ta.yaml\t0", "7\ttrack_a\ta.txt\t4\ta.yaml\t2"]
_PLAN_SQL = "(VALUES " + ", ".join("('" + x.replace("\t", "' || chr(9) || '") + "')" for x in _PLAN[2:]) + ") t(line)"
q("plan_parse", lambda v: check.plan_rows(v.lines(_PLAN)).select("line", "reason"), f"""SELECT line, CASE WHEN len(f) <> 6 THEN 'arity' WHEN list_contains(f, '') THEN 'empty field' WHEN NOT regexp_full_match(f[1], '\\d+') THEN 'task' WHEN count(*) OVER (PARTITION BY f[1]) > 1 THEN 'duplicate task' WHEN f[2] NOT IN ('track_a', 'track_b') THEN 'track' WHEN NOT regexp_full_match(f[4], '\\d+') THEN 'seed' WHEN f[6] NOT IN ('0', '1') THEN 'keep_local_traj' END AS reason FROM (SELECT line, string_split(line, chr(9)) AS f FROM {_PLAN_SQL})""")
q("plan_lookup", lambda v: check.plan_lookup(v.lines(_PLAN[:4]), "1"), f"SELECT " + ", ".join(f"f[{i + 1}] AS {c}" for i, c in enumerate(check.PLAN_COLUMNS)) + f" FROM (SELECT string_split(line, chr(9)) AS f FROM {_PLAN_SQL} LIMIT 2) WHERE f[1] = '1'")
q("bundle_priority", lambda v: readers.bundles(v.table("pages").select(F.concat(F.lit("run"), (C("page_id") % 40).cast("string")).alias("run_id"), F.when(C("page_id") % 3 == 0, "archive").otherwise("relay").alias("source"), C("url").alias("path"))),
  "SELECT run_id, source, path FROM (SELECT 'run' || (page_id % 40) AS run_id, CASE WHEN page_id % 3 = 0 THEN 'archive' ELSE 'relay' END AS source, url AS path FROM pages) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY source <> 'archive', path) = 1")
q("json_field", lambda v: v.table("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")), "SELECT event_id, (props ->> '$.k')::INTEGER AS k FROM events")
q("relpaths", lambda v: v.utt.select(tx.relpath(C("video_id"), C("stem"), ".tokens.pt").alias("path")), "SELECT CASE WHEN video_id = '' THEN stem ELSE video_id || '/' || stem END || '.tokens.pt' AS path FROM utt", "utt")
q("missing_paths", lambda v: v.files.select("relpath").join(v.files.filter(C("bytes") > 1000).select("relpath"), "relpath", "left_anti"), "SELECT relpath FROM files WHERE bytes <= 1000", "files")

# --- sinks ---------------------------------------------------------------------------
q("list_digest", lambda v: writers.list_digest(v.pool.select("utterance_id")), "SELECT count(*) AS n, sha256(string_agg(utterance_id, chr(10) ORDER BY utterance_id) || chr(10)) AS sha256 FROM pool", "pool")
q("metrics_long", lambda v: stats.to_long(v.dnsmos.select("utterance_id", F.round("sig_mos", 6).alias("sig"), F.when(C("bak_raw") > 2, F.round("bak_mos", 6)).alias("bak")), ["utterance_id"], ["sig", "bak"]), "SELECT utterance_id, 'sig' AS metric, round(sig_mos, 6) AS value FROM dnsmos UNION ALL SELECT utterance_id, 'bak', round(bak_mos, 6) FROM dnsmos WHERE bak_raw > 2", "dnsmos")
q("render_rows", lambda v: writers.render(stats.final_epoch(v.log).select("run_id", "epoch", "wer", "loss", (C("wer") > 10).alias("high"))), """SELECT '| ' || run_id || ' | ' || epoch || ' | ' || coalesce(printf('%.4f', wer), '') || ' | ' || coalesce(printf('%.4f', loss), '') || ' | ' || CASE WHEN wer > 10 THEN 'yes' WHEN wer <= 10 THEN 'NO' ELSE '' END || ' |' AS line
  FROM (SELECT run_id, epoch, max(value) FILTER (metric = 'wer') AS wer, max(value) FILTER (metric = 'loss') AS loss FROM (SELECT * FROM log WHERE split = 'val' AND utterance_id IS NULL QUALIFY epoch = max(epoch) OVER (PARTITION BY run_id)) GROUP BY ALL)""", "log")
q("backfill_series", lambda v: stats.series(v.log), """SELECT epoch, max(value) FILTER (metric = 'loss') AS "val/loss", max(value) FILTER (metric = 'wer') AS "val/wer", max(value) FILTER (metric = 'cer') AS "val/cer" FROM log WHERE split = 'val' AND utterance_id IS NULL GROUP BY epoch""", "log")
q("matched_transcripts", lambda v: v.utt.join(v.table("labels").select("doc_id"), "doc_id", "left_semi").select("utterance_id", "text_norm"), "SELECT utterance_id, text_norm FROM utt WHERE doc_id IN (SELECT doc_id FROM labels)", "utt")

# --- scalar functions ----------------------------------------------------------------
_SPELT = "trim(regexp_replace(regexp_replace(lower(" + spelt("text") + "), '[^a-z''\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
q("text_normalize", lambda v: v.utt.select("utterance_id", "text_norm", tx.is_valid(C("text_norm")).alias("valid"), F.length("text_norm").alias("n")), "SELECT utterance_id, text_norm, length(text_norm) > 0 AS valid, length(text_norm)::INTEGER AS n FROM utt", "utt")
q("text_normalize_digits", lambda v: v.table("documents").select("doc_id", tx.normalize_text(F.coalesce("text", F.lit(""))).alias("text_norm")), f"SELECT doc_id, {_SPELT} AS text_norm FROM (SELECT doc_id, coalesce(text, '') AS text, {_numbers()} AS small FROM documents)")
_odd = lambda v: v.table("orders").select("o_orderkey", F.concat_ws(" and ", C("o_orderkey").cast("string"), F.concat(F.lit("No."), (C("o_orderkey") * C("o_custkey")).cast("string")), F.concat((C("o_custkey") % 20 * 1000).cast("string"), F.lit("km")), F.concat(C("o_custkey").cast("string"), F.repeat(F.lit("0"), (C("o_orderkey") % 25).cast("int")))).alias("text"))
q("digits_to_words", lambda v: _odd(v).select("o_orderkey", tx.normalize_text(C("text")).alias("text_norm")), f"SELECT o_orderkey, {_SPELT} AS text_norm FROM (SELECT o_orderkey, o_orderkey || ' and No.' || (o_orderkey * o_custkey) || ' and ' || (o_custkey % 20 * 1000) || 'km and ' || o_custkey || repeat('0', (o_orderkey % 25)::BIGINT) AS text, {_numbers()} AS small FROM orders)")
q("numeric_order", lambda v: v.table("part").select("p_partkey", F.when(C("p_partkey") % 7 == 0, C("p_name")).otherwise(C("p_partkey").cast("string")).alias("stem")).withColumn("place", F.row_number().over(Window.partitionBy((C("p_partkey") % 16)).orderBy(*tx.numeric_order(C("stem")), "p_partkey"))).select("p_partkey", "place"),
  "SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey % 16 ORDER BY CASE WHEN regexp_full_match(stem, '\\d+') THEN 0 ELSE 1 END, try_cast(stem AS HUGEINT), stem, p_partkey)::INTEGER AS place FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE p_partkey::VARCHAR END AS stem FROM part)")
q("name_parts", lambda v: v.table("orders").select("o_orderkey", F.concat(F.lit("runs/track_b/random_25pct_seed"), (C("o_orderkey") % 900).cast("string")).alias("p"), F.format_string("ckpt_epoch%04d.ckpt", C("o_orderkey") % 30).alias("c")).select("o_orderkey", tx.seed_of(C("p")).alias("seed"), tx.epoch_of(C("c")).alias("epoch"), tx.run_id_of(C("p")).alias("run_id"), tx.run_id(F.lit("track_b"), F.lit("x"), C("o_orderkey"), F.lit(1), F.lit(2)).alias("made"), tx.file_kind(C("c")).alias("kind")),
  "SELECT o_orderkey, o_orderkey % 900 AS seed, (o_orderkey % 30)::INTEGER AS epoch, 'track_b/random_25pct_seed' || (o_orderkey % 900) AS run_id, 'track_b/x_seed' || o_orderkey || '_job1_t2' AS made, 'other' AS kind FROM orders")
q("file_kinds", lambda v: v.files.select("relpath", tx.file_kind(C("relpath")).alias("kind"), "sha256"), "SELECT relpath, CASE WHEN relpath LIKE '%.tokens.pt' THEN 'tokens' WHEN relpath LIKE '%.txt' THEN 'txt' WHEN relpath LIKE '%.wav' THEN 'wav' ELSE 'other' END AS kind, sha256 FROM files", "files")
_ENC = """list_filter(list_transform(list_filter(string_split(text_norm, ''), lambda c: c <> ''), lambda c: instr('abcdefghijklmnopqrstuvwxyz ''', c) + 1), lambda i: i > 1)"""
q("char_encode", lambda v: v.utt.select("utterance_id", F.array_join(F.transform(tx.encode_chars(C("text_norm")), lambda x: x.cast("string")), ",").alias("ids")), f"SELECT utterance_id, coalesce(array_to_string({_ENC}, ','), '') AS ids FROM utt", "utt")
q("char_decode", lambda v: v.utt.select("utterance_id", tx.decode_chars(tx.encode_chars(C("text_norm")), collapse=True).alias("text")), f"SELECT utterance_id, coalesce(array_to_string(list_transform(list_filter(e, lambda x, i: i = 1 OR x <> e[i - 1]), lambda x: substr('abcdefghijklmnopqrstuvwxyz ''', x - 1, 1)), ''), '') AS text FROM (SELECT utterance_id, {_ENC} AS e FROM utt)", "utt")
q("budgets", lambda v: v.pool.agg(F.count("*").alias("n")).select("n", *[numeric.budget(C("n"), f).cast("bigint").alias(f"k{p}") for p, f in ((25, 0.25), (10, 0.1), (5, 0.05))]), "SELECT count(*) AS n, floor(count(*) * 0.25::DOUBLE + 0.5)::BIGINT AS k25, floor(count(*) * 0.1::DOUBLE + 0.5)::BIGINT AS k10, floor(count(*) * 0.05::DOUBLE + 0.5)::BIGINT AS k5 FROM pool", "pool")
q("frame_math", lambda v: v.utt.select("utterance_id", numeric.frames_for(C("n_tokens") * 317).cast("bigint").alias("frames"), *[x.cast("bigint").alias(n) for x, n in zip(numeric.sample_range(C("n_tokens"), C("n_tokens") + 50), ("first", "last"))]), "SELECT utterance_id, ceil(n_tokens * 317 / 320.0)::BIGINT AS frames, n_tokens::BIGINT * 320 AS first, (n_tokens::BIGINT + 50) * 320 AS last FROM utt", "utt")
q("calibration", lambda v: v.dnsmos.select("utterance_id", *[F.round(c, 6).alias(c) for c in ("sig_mos", "bak_mos", "ovr_mos")]), "SELECT utterance_id, round(sig_mos, 6) AS sig_mos, round(bak_mos, 6) AS bak_mos, round(ovr_mos, 6) AS ovr_mos FROM dnsmos", "dnsmos")
q("importance_weights", lambda v: v.weights.join(F.broadcast(v.weights.agg(F.max("score_logit").alias("m")))).select("utterance_id", F.round(F.exp(C("score_logit") - C("m")), 6).alias("weight")), "SELECT utterance_id, round(exp(score_logit - max(score_logit) OVER ()), 6) AS weight FROM weights", "weights")
q("softplus_loss", lambda v: v.weights.select("utterance_id", F.round(numeric.softplus_loss(C("score_logit"), F.lit(1.0)), 6).alias("loss")), "SELECT utterance_id, round(greatest(score_logit, 0) + ln(1 + exp(-abs(score_logit))) - score_logit, 6) AS loss FROM weights", "weights")
_PAIRS = "list_transform(range(1, len(codes)), lambda i: [codes[i], codes[i + 1]])"
q("bigram_counts", lambda v: v.tokens.select(F.explode(arrays.bigrams(C("codes"))).alias("p")).select(numeric.bigram_bucket(C("p.a"), C("p.b")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")), f"SELECT ((p[1] * 1009 + p[2]) % 65536)::INTEGER AS bucket, count(*) AS n FROM (SELECT unnest({_PAIRS}) AS p FROM tokens) GROUP BY 1", "tokens")
q("entropy", lambda v: arrays.entropy(v.tokens, "utterance_id", "codes").select("utterance_id", F.round("entropy", 6).alias("entropy")), "SELECT utterance_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT utterance_id, c, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY utterance_id) AS t FROM (SELECT utterance_id, unnest(codes) AS c FROM tokens) GROUP BY 1, 2) GROUP BY 1", "tokens")
q("random_projection", lambda v: v.vectors.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", (C("x") * numeric.rademacher("p", C("i"), 16)).alias("x")).groupBy("vec_id").agg(F.round(F.sum("x"), 6).alias("y")), f"SELECT vec_id, round(sum(x * CASE WHEN {u_sql('p', 'i')} < 0.5 THEN 1 ELSE -1 END / 4.0), 6) AS y FROM (SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS i FROM vectors) GROUP BY 1", "vectors")
q("vector_products", lambda v: v.vectors.select("vec_id", F.round(arrays.dot(C("v"), F.reverse("v")), 6).alias("dot"), F.round(arrays.distance(C("v"), F.reverse("v")), 6).alias("dist"), F.round(arrays.norm(C("v")), 6).alias("norm")), "SELECT vec_id, round(list_dot_product(v, list_reverse(v)), 6) AS dot, round(list_distance(v, list_reverse(v)), 6) AS dist, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM vectors", "vectors")
q("duration_mismatch", lambda v: v.utt.select("utterance_id", (F.abs(C("conf") * 0.7 - C("duration_s")) > F.greatest(F.lit(0.15), C("duration_s") * 0.05)).alias("bad")), "SELECT utterance_id, abs(conf * 0.7::DOUBLE - duration_s) > greatest(0.15::DOUBLE, duration_s * 0.05::DOUBLE) AS bad FROM utt", "utt")
q("crop_tokens", lambda v: v.tokens.filter(F.size("codes") >= 20).select("utterance_id", F.array_join(F.get(arrays.crop(F.array("codes"), F.lit(5), F.lit(10)), F.lit(0)).cast("array<string>"), ",").alias("codes")), "SELECT utterance_id, array_to_string(codes[6:15], ',') AS codes FROM tokens WHERE len(codes) >= 20", "tokens")
q("pad_frames", lambda v: v.vectors.select("vec_id", F.size(arrays.pad_to(C("v"), F.lit(80), F.lit(0.0))).alias("n"), F.size(F.filter(arrays.pad_mask(C("v"), F.lit(80)), lambda m: m)).alias("real")), "SELECT vec_id, 80 AS n, len(v)::INTEGER AS real FROM vectors", "vectors")
q("code_histogram", lambda v: arrays.histogram(v.tokens, "utterance_id", "codes").select("utterance_id", "code", "n", F.round("share", 6).alias("share")), "SELECT utterance_id, code, n, round(n / sum(n) OVER (PARTITION BY utterance_id), 6) AS share FROM (SELECT utterance_id, code, count(*) AS n FROM (SELECT utterance_id, unnest(codes) AS code FROM tokens) GROUP BY 1, 2)", "tokens")
q("ngram_features", lambda v: arrays.features(v.target, "utterance_id", "codes").select("utterance_id", "idx", F.round("val", 6).alias("val")), f"SELECT utterance_id, idx, round(sum(w), 6) AS val FROM (SELECT utterance_id, unnest(codes)::BIGINT AS idx, 1.0::DOUBLE / (len(codes) * CASE WHEN len(codes) > 1 THEN 2 ELSE 1 END) AS w FROM target UNION ALL SELECT utterance_id, (p[1] * 1009 + p[2]) % 65536 + 1024, 0.5::DOUBLE / n FROM (SELECT utterance_id, unnest({_PAIRS}) AS p, len(codes) - 1 AS n FROM target)) GROUP BY 1, 2", "target")
q("hop_windows", lambda v: v.utt.filter("n_tokens > 0").select("utterance_id", numeric.tiled_length(C("n_tokens") * 2000).alias("n")).select("utterance_id", "n", numeric.hop_count(C("n")).alias("planned"), numeric.effective_hops(C("n")).alias("hops")),
  "SELECT utterance_id, n, planned, len(list_filter(range(planned), lambda i: least(trunc((i + 9.01::DOUBLE) * 16000)::BIGINT, n) - i * 16000 >= 144160))::INTEGER AS hops FROM (SELECT utterance_id, n, trunc(floor(n / 16000.0) - 9.01::DOUBLE)::INTEGER + 1 AS planned FROM (SELECT utterance_id, (n_tokens * 2000 * pow(2, greatest(ceil(log2(144160.0 / (n_tokens * 2000))), 0)))::BIGINT AS n FROM utt WHERE n_tokens > 0))", "utt")
q("code_range", lambda v: v.tokens.select("utterance_id", arrays.out_of_range(C("codes"), 1000).alias("bad")), "SELECT utterance_id, len(list_filter(codes, lambda c: c < 0 OR c >= 1000)) > 0 AS bad FROM tokens", "tokens")

# --- filters -------------------------------------------------------------------------
q("universe", lambda v: select.universe(v.utt).select("utterance_id"), "SELECT utterance_id FROM pool", "pool")
q("ctc_length_filter", lambda v: v.utt.select("utterance_id", (C("n_tokens") >= F.size(tx.encode_chars(C("text_norm")))).alias("keep")), f"SELECT utterance_id, n_tokens >= len({_ENC}) AS keep FROM utt", "utt")
q("aggregate_rows", lambda v: stats.aggregates(v.log).select("event_id", "metric", "value"), "SELECT event_id, metric, value FROM log WHERE split = 'val' AND utterance_id IS NULL", "log")
q("length_band", lambda v: v.utt.filter(C("n_tokens").between(48, 320)).orderBy("utterance_id").limit(32).select("utterance_id"), "SELECT utterance_id FROM utt WHERE n_tokens BETWEEN 48 AND 320 ORDER BY utterance_id LIMIT 32", "utt")
q("late_checkpoints", lambda v: (lambda l: l.join(F.broadcast(l.agg(F.max("epoch").alias("m")))).filter(C("epoch") >= F.ceil(C("m") * 0.5)).select("event_id", "epoch"))(v.log), "SELECT event_id, epoch FROM log WHERE epoch >= (SELECT ceil(max(epoch) * 0.5) FROM log)", "log")
q("held_out", lambda v: select.held_out(v.pool, 5, "video_id").select("utterance_id", "held"), "SELECT utterance_id, (row_number() OVER (PARTITION BY video_id ORDER BY utterance_id) - 1) % 5 = 0 AS held FROM pool", "pool")
q("duration_band", lambda v: v.utt.filter((C("duration_s") > 1) & (C("duration_s") <= 4 + 1e-9)).select("utterance_id"), "SELECT utterance_id FROM utt WHERE duration_s > 1 AND duration_s <= 4 + 1e-9", "utt")

# --- joins ---------------------------------------------------------------------------
q("semi_join", lambda v: v.utt.join(v.table("labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select("utterance_id"), "SELECT utterance_id FROM utt WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "utt")
q("strict_semi_join", lambda v: check.strict_semi_join(v.utt, v.pool.select("utterance_id")).select("utterance_id"), "SELECT utterance_id FROM pool", "pool")
q("characterize", lambda v: select.characterize(select.top_k(v.dnsmos, "ovr_mos", 100), v.utt, arrays.entropy(v.tokens, "utterance_id", "codes").withColumnRenamed("entropy", "codebook_entropy")),
  "SELECT count(*) AS k, round(sum(duration_s) / 3600, 3) AS realized_hours, count(DISTINCT video_id) AS n_videos, round(avg(e), 4) AS mean_entropy FROM utt JOIN (SELECT utterance_id FROM dnsmos ORDER BY ovr_mos DESC, utterance_id LIMIT 100) USING (utterance_id) LEFT JOIN (SELECT utterance_id, -sum(n / t * log2(n / t)) AS e FROM (SELECT utterance_id, c, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY utterance_id) AS t FROM (SELECT utterance_id, unnest(codes) AS c FROM tokens) GROUP BY 1, 2) GROUP BY 1) USING (utterance_id)", "dnsmos", "tokens")
q("leaks", lambda v: check.score_violations(v.dnsmos.unionByName(v.dnsmos.filter(C("ovr_mos") > 3)), parts(v).filter("part = 'val'")), "SELECT 'dup' AS law, count(*) AS n FROM dnsmos WHERE ovr_mos > 3 UNION ALL SELECT 'val-leak', count(*) FROM (SELECT * FROM dnsmos UNION ALL SELECT * FROM dnsmos WHERE ovr_mos > 3) WHERE utterance_id IN (SELECT utterance_id FROM parts WHERE part = 'val')", "dnsmos", "parts")
q("manifest_compare", lambda v: check.compare_manifest(v.files.filter("page_id % 11 <> 3").select("relpath", "sha256"), v.files.filter("page_id % 13 <> 5").select("relpath", F.when(C("page_id") % 17 == 2, "0").otherwise(C("sha256")).alias("sha256"))),
  "SELECT coalesce(a.relpath, b.relpath) AS relpath, CASE WHEN b.relpath IS NULL THEN 'missing' WHEN a.relpath IS NULL THEN 'extra' ELSE 'mismatch' END AS status FROM (SELECT * FROM files WHERE page_id % 11 <> 3) a FULL JOIN (SELECT relpath, CASE WHEN page_id % 17 = 2 THEN '0' ELSE sha256 END AS sha256 FROM files WHERE page_id % 13 <> 5) b ON a.relpath = b.relpath WHERE a.sha256 IS DISTINCT FROM b.sha256", "files")
q("checkpoint_means", lambda v: loss(v).select("utterance_id", F.round("loss_mean", 6).alias("loss_mean"), F.round("el2n_mean", 6).alias("el2n_mean"), "n_ckpts"), "SELECT utterance_id, round(loss_mean, 6) AS loss_mean, round(el2n_mean, 6) AS el2n_mean, n_ckpts FROM loss", "loss")
q("resume", lambda v: v.pool.join(loss(v).filter("n_ckpts = 3").select("utterance_id"), "utterance_id", "left_anti").select("utterance_id"), "SELECT utterance_id FROM pool WHERE utterance_id NOT IN (SELECT utterance_id FROM loss WHERE n_ckpts = 3)", "pool", "loss")
q("match_counts", lambda v: v.table("documents").join(v.table("labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left").agg(F.count("hit").alias("matched"), (F.count("*") - F.count("hit")).alias("unmatched")), "SELECT count(l.doc_id) AS matched, count(*) - count(l.doc_id) AS unmatched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
q("orphans", lambda v: v.table("orders").join(v.table("lineitem").filter("l_quantity > 45").select(C("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
q("reference_join", lambda v: v.table("nation").select("n_name", F.concat(F.lit("runs/"), "n_name", F.lit("/"), C("n_regionkey").cast("string"), F.lit("/last.ckpt")).alias("path")).withColumn("r_regionkey", F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).cast("bigint")).join(v.table("region").select(C("r_regionkey").cast("bigint"), "r_name"), "r_regionkey").select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON contains('/' || n_name || '/' || n_regionkey || '/last.ckpt', '/' || r_regionkey || '/')")

# --- aggregates ----------------------------------------------------------------------
_AUDIT = "SELECT split, count(*) AS n, count(DISTINCT nullif(video_id, '')) AS n_videos, round(sum(duration_s) / 3600, 3) AS hours, round(avg(duration_s), 4) AS mean_s, round(quantile_cont(duration_s, 0.95), 4) AS p95_s, count(*) FILTER (length(text_norm) > 0) AS with_text, count(*) FILTER (selectable) AS selectable FROM utt GROUP BY split"
q("audit_by_split", lambda v: stats.audit(v.utt), _AUDIT, "utt")
q("conf_histogram", lambda v: v.utt.filter("conf IS NOT NULL").groupBy("split", "conf").agg(F.count("*").alias("n")), "SELECT split, conf, count(*) AS n FROM utt WHERE conf IS NOT NULL GROUP BY ALL", "utt")
q("conf_rollup", lambda v: v.utt.rollup("split", "conf").agg(F.count("*").alias("n"), F.grouping_id().alias("level")), "SELECT split, conf, count(*) AS n, grouping_id(split, conf)::BIGINT AS level FROM utt GROUP BY ROLLUP (split, conf)", "utt")
q("universe_summary", lambda v: v.pool.agg(F.count("*").alias("n"), F.round(F.sum("duration_s") / 3600, 3).alias("hours"), F.count_distinct("video_id").alias("videos")), "SELECT count(*) AS n, round(sum(duration_s) / 3600, 3) AS hours, count(DISTINCT video_id) AS videos FROM pool", "pool")
q("anomaly_report", lambda v: check.anomaly_report(check.token_anomalies(v.tokens, 1000, 60)).select("kind", "n", F.array_join("examples", ",").alias("examples")), "SELECT kind, count(*) AS n, array_to_string(list_sort(list(utterance_id) FILTER (rn <= 50)), ',') AS examples FROM (SELECT kind, utterance_id, row_number() OVER (PARTITION BY kind ORDER BY utterance_id) AS rn FROM (SELECT split || '_token_range_violation' AS kind, utterance_id FROM tokens WHERE len(list_filter(codes, lambda c: c >= 1000)) > 0 UNION ALL SELECT split || '_too_short_for_crops', utterance_id FROM tokens WHERE len(codes) > 0 AND len(codes) < 60)) GROUP BY 1", "tokens")
q("group_sizes", lambda v: v.pool.groupBy("video_id").agg(F.count("*").alias("n")), "SELECT video_id, count(*) AS n FROM pool GROUP BY 1", "pool")
q("bytes_by_kind", lambda v: v.files.groupBy(tx.file_kind(C("relpath")).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("bytes") / 1e9, 9).alias("gb")), "SELECT CASE WHEN relpath LIKE '%.tokens.pt' THEN 'tokens' WHEN relpath LIKE '%.txt' THEN 'txt' ELSE 'wav' END AS kind, count(*) AS n, round(sum(bytes) / 1e9, 9) AS gb FROM files GROUP BY 1", "files")
q("epoch_means", lambda v: v.log.groupBy("utterance_id", "epoch").agg(F.round(F.avg("value"), 9).alias("value")), "SELECT utterance_id, epoch, round(avg(value), 9) AS value FROM log GROUP BY ALL", "log")
q("mean_vector", lambda v: models.mean_vector(v.vectors, "v").select(F.posexplode("mean").alias("i", "x")).select("i", F.round("x", 6).alias("x")), "SELECT i::INTEGER AS i, round(avg(x), 6) AS x FROM (SELECT unnest(range(64)) AS i, unnest(v) AS x FROM vectors) GROUP BY i", "vectors")
q("masked_mean", lambda v: v.vectors.select("vec_id", F.round(arrays.masked_mean(C("v"), (C("vec_id") % 60).cast("int")), 6).alias("m")), "SELECT vec_id, round(coalesce(list_sum(v[1 : (vec_id % 60)::INTEGER]), 0) / greatest(vec_id % 60, 1), 6) AS m FROM vectors", "vectors")
q("weight_spread", lambda v: v.weights.agg(F.round(F.stddev_pop(F.exp("score_logit")) / F.avg(F.exp("score_logit")), 6).alias("cv")), "SELECT round(stddev_pop(exp(score_logit)) / avg(exp(score_logit)), 6) AS cv FROM weights", "weights")
q("table_summary", lambda v: loss(v).agg(F.count("*").alias("n"), *[F.round(f("loss_mean"), 6).alias(a) for f, a in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mean"), (F.stddev_pop, "sd"))]), "SELECT count(*) AS n, round(min(loss_mean), 6) AS lo, round(max(loss_mean), 6) AS hi, round(avg(loss_mean), 6) AS mean, round(stddev_pop(loss_mean), 6) AS sd FROM loss", "loss")
q("class_weights", lambda v: models.balanced(v.table("labels").filter("quality IS NOT NULL").select("doc_id", C("quality").alias("label"))).select("doc_id", F.round("weight", 6).alias("weight")), "SELECT doc_id, round(count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY quality)), 6) AS weight FROM labels WHERE quality IS NOT NULL")
q("rows_per_split", lambda v: v.log.groupBy("run_id").agg(F.count_if(C("split") == "train").alias("n_train"), F.count_if(C("split") == "val").alias("n_val")), "SELECT run_id, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val FROM log GROUP BY 1", "log")
q("best_row", lambda v: v.dnsmos.agg(F.max_by("utterance_id", F.struct("ovr_raw", "utterance_id")).alias("best")), "SELECT utterance_id AS best FROM dnsmos ORDER BY ovr_raw DESC, utterance_id DESC LIMIT 1", "dnsmos")
q("storage_check", lambda v: v.files.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("inodes")).select("bytes", "inodes", F.when(C("bytes") >= 10**9, "abort").when(C("bytes") >= 10**5, "warn").otherwise("ok").alias("state")), "SELECT sum(bytes)::BIGINT AS bytes, count(*) AS inodes, CASE WHEN sum(bytes) >= 1000000000 THEN 'abort' WHEN sum(bytes) >= 100000 THEN 'warn' ELSE 'ok' END AS state FROM files", "files")

# --- windows, top-k, samples, sets ---------------------------------------------------
q("first_n_per_group", lambda v: select.first_n(v.utt, 5).select("split", "utterance_id"), "SELECT split, utterance_id FROM utt QUALIFY row_number() OVER (PARTITION BY split ORDER BY utterance_id) <= 5", "utt")
q("average_rank", lambda v: stats.ranked(v.table("part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "rank"), "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS rank FROM part")
q("select_kmeans", lambda v: select.select("kmeans", v.clusters, 100, "201"), f"SELECT utterance_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {u_sql('201', 'utterance_id')}, utterance_id) AS t FROM clusters) ORDER BY t, cluster_id LIMIT 100", "clusters")
q("group_split", lambda v: parts(v).select("utterance_id", "part"), "SELECT utterance_id, part FROM parts", "parts")
q("run_collapse", lambda v: v.table("events").withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))).filter("prev IS NULL OR prev <> event_type").select("event_id"), "SELECT event_id FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type")
q("cluster_sizes", lambda v: v.clusters.join(F.broadcast(v.clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))), "cluster_id").select("utterance_id", "cluster_id", "size"), "SELECT *, count(*) OVER (PARTITION BY cluster_id) AS size FROM clusters", "clusters")
q("final_epoch", lambda v: stats.final_epoch(v.log), "SELECT run_id, epoch, max(value) FILTER (metric = 'loss') AS loss, max(value) FILTER (metric = 'wer') AS wer, max(value) FILTER (metric = 'cer') AS cer FROM (SELECT * FROM log WHERE split = 'val' AND utterance_id IS NULL QUALIFY epoch = max(epoch) OVER (PARTITION BY run_id)) GROUP BY ALL", "log")
q("band_pick", lambda v: select.band_pick(v.table("part").select(C("p_partkey").cast("string").alias("utterance_id"), "p_retailprice"), "p_retailprice", 10, "spot").select("utterance_id", C("band").cast("bigint").alias("band")), f"SELECT utterance_id, band FROM (SELECT *, ntile(10) OVER (ORDER BY p_retailprice, utterance_id) AS band FROM (SELECT p_partkey::VARCHAR AS utterance_id, p_retailprice FROM part)) QUALIFY row_number() OVER (PARTITION BY band ORDER BY {u_sql('spot', 'utterance_id')}, utterance_id) = 1")
for _name, _table, _view, _order, _seed in (("dnsmos", lambda v: v.dnsmos, "dnsmos", "ovr_mos DESC", None), ("lossrank", loss, "loss", "loss_mean", None), ("anti", loss, "loss", "loss_mean DESC", None), ("el2n", loss, "loss", "el2n_mean DESC", None), ("dsir", lambda v: v.weights, "weights", f"score_logit - ln(-ln(greatest({u_sql('202', 'utterance_id')}, 1.1102230246251565e-16))) DESC", "202")):
    q(f"select_{_name}", lambda v, n=_name, t=_table, s=_seed: select.select(n, t(v), 100, s), f"SELECT utterance_id FROM {_view} ORDER BY {_order}, utterance_id LIMIT 100", _view)
q("select_random", lambda v: select.uniform_sample(v.pool, 100, "101"), f"SELECT utterance_id FROM pool ORDER BY {u_sql('101', 'utterance_id')}, utterance_id LIMIT 100", "pool")
q("random_crops", lambda v: v.pool.select("utterance_id", F.floor(numeric.uniform("crop", C("utterance_id")) * (C("n_tokens") - 49)).alias("start")), f"SELECT utterance_id, floor({u_sql('crop', 'utterance_id')} * (n_tokens - 49))::BIGINT AS start FROM pool", "pool")
q("set_union", lambda v: v.table("customer").select(C("c_nationkey").alias("k")).union(v.table("supplier").select("s_nationkey")).distinct(), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
q("set_difference", lambda v: v.table("orders").select(C("o_custkey").alias("k")).exceptAll(v.table("customer").select("c_custkey")), "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
q("set_intersection", lambda v: v.table("orders").select(C("o_custkey").alias("k")).intersect(v.table("customer").filter("c_acctbal > 0").select("c_custkey")), "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
_both = lambda v: (lambda p: (p.filter("part = 'train' OR utterance_id LIKE '%7'"), p.filter("part = 'val' OR utterance_id LIKE '%77'")))(parts(v))
q("split_checks", lambda v: check.split_checks(*_both(v), v.pool), """WITH a AS (SELECT * FROM parts WHERE part = 'train' OR utterance_id LIKE '%7'), b AS (SELECT * FROM parts WHERE part = 'val' OR utterance_id LIKE '%77')
  SELECT *, n_train + n_val = n_universe AND shared_ids = 0 AND lost = 0 AS whole FROM (SELECT (SELECT count(*) FROM a) AS n_train, (SELECT count(*) FROM b) AS n_val, (SELECT count(*) FROM pool) AS n_universe, (SELECT count(DISTINCT utterance_id) FROM a WHERE utterance_id IN (SELECT utterance_id FROM b)) AS shared_ids, (SELECT count(DISTINCT video_id) FROM a WHERE video_id IN (SELECT video_id FROM b)) AS shared_videos,
    (SELECT count(*) FROM (SELECT utterance_id FROM pool EXCEPT ALL SELECT utterance_id FROM (SELECT utterance_id FROM a UNION ALL SELECT utterance_id FROM b))) AS lost)""", "parts")
_lines = lambda v, p: p.filter("utterance_id LIKE '%1'").select("utterance_id").union(p.filter("utterance_id LIKE '%21'").select("utterance_id")).union(v.lines(["", "", "no id", "a/b/c", "else/where"]))
q("manifest_laws", lambda v: (lambda p: check.manifest_violations(_lines(v, p), p.filter("part = 'train'"), p.filter("part = 'val'"), 100))(parts(v)),
  """WITH m AS (SELECT utterance_id FROM parts WHERE utterance_id LIKE '%1' UNION ALL SELECT utterance_id FROM parts WHERE utterance_id LIKE '%21' UNION ALL VALUES (''), (''), ('no id'), ('a/b/c'), ('else/where'))
  SELECT * FROM (SELECT 'wrong-k' AS law, abs(count(*) - 100)::BIGINT AS n FROM m UNION ALL SELECT 'dup', (count(*) - count(DISTINCT utterance_id))::BIGINT FROM m UNION ALL SELECT 'blank', count(*) FROM m WHERE utterance_id = '' UNION ALL SELECT 'junk', count(*) FROM m WHERE utterance_id <> '' AND (contains(utterance_id, ' ') OR len(string_split(utterance_id, '/')) <> 2)
    UNION ALL SELECT 'val-leak', count(*) FROM m WHERE utterance_id IN (SELECT utterance_id FROM parts WHERE part = 'val') UNION ALL SELECT 'foreign-id', count(*) FROM m WHERE utterance_id NOT IN (SELECT utterance_id FROM parts WHERE part = 'train')) WHERE n > 0""", "parts")

# --- scorers, models, metrics --------------------------------------------------------
q("held_out_auc", lambda v: stats.auc(v.table("part").select("p_size", (C("p_partkey") % 3 == 0).cast("int").alias("y")), "p_size", "y").select(F.round("auc", 6).alias("auc"), F.round("null_se", 6).alias("null_se")),
  "SELECT round((sum(r) FILTER (y = 1) - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc, round(sqrt((n1 + n0 + 1) / (12.0::DOUBLE * n1 * n0)), 6) AS null_se FROM (SELECT *, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS r, sum(y) OVER () AS n1, sum(1 - y) OVER () AS n0 FROM (SELECT p_size, (p_partkey % 3 = 0)::INTEGER AS y FROM part)) GROUP BY n1, n0")
q("lloyd_step", lambda v: models.lloyd_step(v.vectors, [[0.0] * 64, [0.1] * 64, [-0.1] * 64], "vec_id", "v").select("vec_id", "cluster_id", F.round("dist", 6).alias("dist")), "SELECT vec_id, (CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END)::INTEGER AS cluster_id, round(least(a, b, c), 6) AS dist FROM (SELECT vec_id, round(list_distance(v, list_transform(v, lambda x: 0.0::DOUBLE)), 9) AS a, round(list_distance(v, list_transform(v, lambda x: 0.1::DOUBLE)), 9) AS b, round(list_distance(v, list_transform(v, lambda x: -0.1::DOUBLE)), 9) AS c FROM vectors)", "vectors")
q("kmeans", lambda v: models.cluster(v.vectors, 8, 201, "vec_id", "v"))
q("dsir_fit", lambda v: models.importance(*[models.sparse(arrays.feature_lists(t, "utterance_id", "codes"), "utterance_id", 1024 + 65536) for t in (v.tokens.join(v.pool.select("utterance_id"), "utterance_id", "left_semi"), v.target)], 1e-3))
q("dsir_sweep", lambda v: v.spark.createDataFrame(models.sweep(*[models.sparse(arrays.feature_lists(t, "utterance_id", "codes"), "utterance_id", 1024 + 65536) for t in (v.tokens.join(v.pool.select("utterance_id"), "utterance_id", "left_semi"), v.target)], 5, [1e-4, 1e-2]), "l2 double, held_out_auc double, held_out_logloss double, weight_spread double"))
_CTC = """, x AS (SELECT vec_id, frames, n_frames, 2 + vec_id % 6 + 1 AS one, 2 + vec_id % 5 + 1 AS two, 2 AS blank FROM frames),
  a AS (SELECT *, 1 AS t, frames[1][blank] AS a0, frames[1][one] AS a1, 0.0::DOUBLE AS a2, 0.0::DOUBLE AS a3, 0.0::DOUBLE AS a4 FROM x
    UNION ALL SELECT vec_id, frames, n_frames, one, two, blank, t + 1, a0 * frames[t + 1][blank], (a0 + a1) * frames[t + 1][one], (a1 + a2) * frames[t + 1][blank], (a2 + a3 + CASE WHEN one <> two THEN a1 ELSE 0 END) * frames[t + 1][two], (a3 + a4) * frames[t + 1][blank] FROM a WHERE t < n_frames)
  SELECT vec_id, CASE WHEN a3 + a4 > 0 THEN round(-ln(a3 + a4), 6) ELSE 0 END AS loss FROM a WHERE t = n_frames"""
q("ctc_loss", lambda v: metrics.ctc_losses(v.frames.withColumn("target", F.array((2 + C("vec_id") % 6).cast("int"), (2 + C("vec_id") % 5).cast("int"))), "vec_id", "frames", "n_frames", "target").select("vec_id", F.round("loss", 6).alias("loss")), with_views("", "frames").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + _CTC)
q("el2n_scores", lambda v: v.frames.select("vec_id", F.round(arrays.el2n(C("frames"), C("n_frames")), 6).alias("el2n")), "SELECT vec_id, round(list_sum(list_transform(frames[1:n_frames], lambda f: sqrt(greatest(list_sum(list_transform(f, lambda p: p * p)) - 2 * list_max(f) + 1, 0)))) / n_frames, 6) AS el2n FROM frames", "frames")
q("greedy_decode", lambda v: v.frames.select("vec_id", tx.decode_chars(arrays.greedy_ids(C("frames"), C("n_frames")), collapse=True).alias("text")), "SELECT vec_id, coalesce(array_to_string(list_transform(list_filter(g, lambda x, i: x > 1 AND (i = 1 OR x <> g[i - 1])), lambda x: substr('abcdefghijklmnopqrstuvwxyz ''', x - 1, 1)), ''), '') AS text FROM (SELECT vec_id, list_transform(frames[1:n_frames], lambda f: list_position(f, list_max(f)) - 1) AS g FROM frames)", "frames")
_WORDS = "string_split({0}, ' ')"
_CODED = "array_to_string(list_transform(string_split({0}, ' '), lambda w: chr((33 + list_position(list_sort(list_distinct(list_concat(string_split(ref, ' '), string_split(hyp, ' ')))), w))::INTEGER)), '')"
q("wer", lambda v: v.pairs.select("pair_id", F.round(metrics.wer(C("ref"), C("hyp")), 6).alias("wer")), f"SELECT pair_id, round(levenshtein({_CODED.format('ref')}, {_CODED.format('hyp')}) / len({_WORDS.format('ref')}), 6) AS wer FROM pairs", "pairs")
q("cer", lambda v: v.pairs.select("pair_id", F.round(metrics.cer(C("ref"), C("hyp")), 6).alias("cer"), F.round(metrics.char_accuracy(C("ref"), C("hyp")), 6).alias("accuracy")), "SELECT pair_id, round(levenshtein(ref, hyp) / length(ref), 6) AS cer, round(greatest(0, 1 - levenshtein(ref, hyp) / length(ref)), 6) AS accuracy FROM pairs", "pairs")
_blanked = lambda v: v.pairs.withColumn("ref", F.when(C("pair_id") % 9 == 0, " ").otherwise(C("ref")))
_BLANKED = "(SELECT pair_id, hyp, CASE WHEN pair_id % 9 = 0 THEN ' ' ELSE ref END AS ref FROM pairs) WHERE trim(ref) <> ''"
q("macro_means", lambda v: _blanked(v).agg(F.round(F.avg(metrics.wer(C("ref"), C("hyp"))), 6).alias("wer"), F.round(F.avg(metrics.cer(C("ref"), C("hyp"))), 6).alias("cer"), F.count_if(F.trim("ref") != "").alias("n"), F.count("*").alias("n_rows")), f"SELECT round(avg(levenshtein({_CODED.format('ref')}, {_CODED.format('hyp')}) / len({_WORDS.format('ref')})), 6) AS wer, round(avg(levenshtein(ref, hyp) / length(ref)), 6) AS cer, count(*) AS n, (SELECT count(*) FROM pairs) AS n_rows FROM {_BLANKED}", "pairs")
q("influence", lambda v: models.influence(v.vectors, v.vectors.filter("label = 1"), "v").select("vec_id", F.round("influence", 6).alias("influence")), "SELECT vec_id, round(list_dot_product(v, m), 6) AS influence FROM vectors, (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(range(64)) AS i, unnest(v) AS x FROM vectors WHERE label = 1) GROUP BY i))", "vectors")
q("learning_rate", lambda v: v.spark.range(100).select(C("id").alias("step"), F.round(numeric.learning_rate(C("id"), 10, 90), 9).alias("scale")), "SELECT range AS step, round(CASE WHEN range < 10 THEN (range + 1) / 10.0::DOUBLE ELSE greatest((90 - range) / 80.0::DOUBLE, 1e-8) END, 9) AS scale FROM range(100)")

# --- statistics ----------------------------------------------------------------------
_COND = "SELECT CASE l_linenumber WHEN 1 THEN 'random' ELSE 'line' || l_linenumber END AS condition, l_extendedprice * l_discount AS value FROM lineitem"
_cond = lambda v: v.table("lineitem").select(F.when(C("l_linenumber") == 1, "random").otherwise(F.concat(F.lit("line"), C("l_linenumber").cast("string"))).alias("condition"), (C("l_extendedprice") * C("l_discount")).alias("value"))
_Z = f"SELECT condition, n, mean, mean - m AS delta, (mean - m) / (s * sqrt(1.0::DOUBLE / n + 1.0::DOUBLE / k)) AS z FROM (SELECT condition, count(*) AS n, avg(value) AS mean FROM ({_COND}) WHERE condition <> 'random' GROUP BY 1), (SELECT avg(value) AS m, stddev_pop(value) AS s, count(*) AS k FROM ({_COND}) WHERE condition = 'random')"
q("z_scores", lambda v: stats.z_scores(_cond(v)).select("condition", "n", F.round("mean", 6).alias("mean"), F.round("delta", 6).alias("delta"), F.round("z", 6).alias("z")), f"SELECT condition, n, round(mean, 6) AS mean, round(delta, 6) AS delta, round(z, 6) AS z FROM ({_Z})")
# erfc by the series of erf, which needs no more than 60 terms below 5 deviations; beyond, nothing is left of six decimals.
_P = "CASE WHEN abs(z) > 7 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(120), lambda k: power(-1, k) * power(abs(z) / sqrt(2.0::DOUBLE), 2 * k + 1) / gamma(k + 1) / (2 * k + 1))) END"
q("p_values", lambda v: stats.z_scores(_cond(v)).select("condition", F.round(stats.two_sided_p(C("z")), 6).alias("p")), f"SELECT condition, round({_P}, 6) AS p FROM ({_Z})")
q("holm", lambda v: stats.holm(v.table("nation").select(C("n_name").alias("condition"), (numeric.uniform("p", C("n_name")) / 50).alias("p"))).select("condition", "reject"), f"SELECT condition, bool_and(ok) OVER (ORDER BY p, condition) AS reject FROM (SELECT *, p <= 0.05::DOUBLE / (25 - row_number() OVER (ORDER BY p, condition) + 1) AS ok FROM (SELECT n_name AS condition, {u_sql('p', 'n_name')} / 50 AS p FROM nation))")
q("tost", lambda v: stats.z_scores(_cond(v)).withColumn("se", C("delta") / C("z")).select("condition", *[F.round(x, 6).alias(n) for x, n in zip(stats.tost(C("delta"), C("se"), 5.0), ("lower", "upper"))]), f"SELECT condition, round((delta + 5) / (delta / z), 6) AS lower, round((delta - 5) / (delta / z), 6) AS upper FROM ({_Z})")
q("direction", lambda v: stats.consistent_direction(v.table("customer").select(C("c_mktsegment").alias("condition"), (C("c_acctbal")).alias("delta"))), "SELECT c_mktsegment AS condition, count(DISTINCT sign(c_acctbal)) = 1 AS consistent FROM customer GROUP BY 1")
q("spearman", lambda v: stats.spearman(v.table("part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice").select(F.round("rho", 6).alias("rho")), "SELECT round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS b FROM part)")
q("kendall", lambda v: stats.kendall(v.table("nation").select("n_name", C("n_nationkey").alias("a"), C("n_regionkey").alias("b")), "n_name", "a", "b").select(F.round("tau", 6).alias("tau")), "SELECT round(avg(sign(x.n_nationkey - y.n_nationkey) * sign(x.n_regionkey - y.n_regionkey)), 6) AS tau FROM nation x JOIN nation y ON x.n_name < y.n_name")
q("bootstrap", lambda v: stats.bootstrap(v.table("supplier"), "s_suppkey", "s_acctbal", 20, "boot").select("round", F.round("mean", 6).alias("mean")),
  "SELECT round::INTEGER AS round, round(sum(w * s_acctbal) / sum(w), 6) AS mean FROM (SELECT round, s_acctbal, " + " + ".join(f"(u >= {c!r})::INTEGER" for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)) + f" AS w FROM (SELECT round, s_acctbal, {u_sql('boot', chr(34) + 'round' + chr(34) + ' || chr(124) || s_suppkey')} AS u FROM supplier, range(20) t(round))) GROUP BY 1")

# --- the event stream ----------------------------------------------------------------


def event_stream(v: Views) -> DataFrame:
    from ..scratch import scratch_path
    from ..streaming import metrics as streaming

    schema = v.table("events").schema
    rows = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    return streaming.run_to_end(streaming.daily(rows), scratch_path(v.spark, "daily"), scratch_path(v.spark, "offsets"))


q("event_stream_daily", event_stream, "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")

from . import more  # noqa: E402, F401  (registers the queries of the run workflow)
