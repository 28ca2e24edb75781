"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, packing, quality, scoring, sharding, simhash, substrings, suffixes, warc

SHARDS = 16


def tokenizer_path() -> str:
    """The vocabulary's path: a setting, or the installed file."""
    if path := os.environ.get("TIDEWRIGHT_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), stays="max")


def op2_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path(), with_ids=False)


def op3_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.prefix_shards(documents(spark, sf_dir), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good; background: all documents."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    out = scoring.cross_entropy_difference(documents(spark, sf_dir), good)
    return out.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), tokenizer_path())


#: Damage planted in the second replica, by the first hex digits of a url's md5: altered, lost.
ALTERED, LOST = "0", "f0"


def op6_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, against a replica with planted damage."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    mark = F.md5(F.coalesce("url", F.lit("")))
    replica = pages.filter(~mark.startswith(LOST)).withColumn("html", F.when(mark.startswith(ALTERED), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    return warc.audit(warc.records(pages), warc.records(replica))


def op7_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, r=4)


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeated_passages(documents(spark, sf_dir), digest=True)
    return out.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", F.col("left").alias("kept_sha256"))


def op10_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeated_strings(documents(spark, sf_dir), digest=True)
    return out.select("doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", F.col("left").alias("kept_sha256"))


OP1_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

_WS = r"[\x20\x09-\x0D]+"
_RATES = {k: v.replace(" div ", " // ") for k, v in quality.RATES.items()}
_FENCES = [(r, f, f"{f.times} * greatest({r}_{f.high} - {r}_{f.low}, {f.least_spread})") for r, f in quality.FENCES.items()]
_WITHIN = [f"{_RATES[r]} <= max_{r}" for r, _, _ in _FENCES] + [f"{_RATES[r]} >= min_{r}" for r, f, _ in _FENCES if f.below]
#: From documents (doc_id, lang, source, text) to the counts, thresholds and verdicts.
QUALITY_CTES = rf"""
w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS ws FROM documents),
tri AS (SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(3) r(j)) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lin.lines, 0)::BIGINT AS n_lines, coalesce(lin.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN lin ON w.doc_id = lin.doc_id),
r AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, {v} AS x FROM c WHERE NOT {quality.BASE_FAILED}" for k, v in _RATES.items())}),
cell AS (SELECT lang, source, rate, (x >> k) << k AS cell FROM (SELECT *, greatest(length(bin(x)) - 7, 0) AS k FROM r)),
s AS (SELECT lang, source, rate, cell, sum(count(*)) OVER (PARTITION BY lang, source, rate ORDER BY cell) AS upto, sum(count(*)) OVER (PARTITION BY lang, source, rate) AS total FROM cell GROUP BY lang, source, rate, cell),
q AS (SELECT lang, source, {", ".join(f"min(cell) FILTER (rate = '{r}' AND upto * 100 >= total * {k}) AS {r}_{k}" for r, f, _ in _FENCES for k in (f.low, f.high))} FROM s GROUP BY lang, source),
f AS (SELECT lang, source, {", ".join([f"{r}_{f.high} + {x} AS max_{r}" for r, f, x in _FENCES] + [f"{r}_{f.low} - {x} AS min_{r}" for r, f, x in _FENCES if f.below])} FROM q),
verdict AS (SELECT c.*, {quality.BASE_FAILED} AS base_failed, NOT {quality.BASE_FAILED} AND coalesce({" AND ".join(_WITHIN)}, false) AS kept
      FROM c LEFT JOIN f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source)
"""
OP7_SQL = f"WITH {QUALITY_CTES} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"

_RECORD = """'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>' || e
  || 'WARC-Date: %s' || e || 'WARC-Target-URI: ' || u || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(h)::VARCHAR || e || e || h || e || e""" % warc.DATE
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, u, CASE WHEN md5(u) LIKE '{ALTERED}%' THEN '#' || substr(h, 2) ELSE h END AS h FROM p WHERE md5(u) NOT LIKE '{LOST}%'),
x AS (SELECT 'a' AS side, * FROM p UNION ALL SELECT 'b', * FROM r),
rec AS (SELECT side, page_id, {_RECORD} AS rec FROM (SELECT *, chr(13) || chr(10) AS e, md5(u || '|' || sha256(h)) AS m FROM x)),
m AS (SELECT side, page_id, page_id // {warc.FILE_RECORDS} AS file, strlen(rec)::BIGINT AS length, sha256(rec) AS sha,
        (sum(strlen(rec)) OVER (PARTITION BY side, page_id // {warc.FILE_RECORDS} ORDER BY page_id) - strlen(rec))::BIGINT AS "offset" FROM rec),
j AS (SELECT a.file, a.page_id AS record_id, a."offset", a.length, a.sha AS expected_sha256, b."offset" AS found_offset, b.sha AS found_sha256,
        CASE WHEN b.sha IS NULL THEN 'missing' WHEN a.sha <> b.sha THEN 'altered' WHEN a."offset" <> b."offset" THEN 'moved' END AS status
      FROM (SELECT * FROM m WHERE side = 'a') a LEFT JOIN (SELECT * FROM m WHERE side = 'b') b ON a.page_id = b.page_id)
SELECT * FROM j WHERE status IS NOT NULL
"""

#: CRC-32 from its definition: a table of 256 entries by eight steps of the polynomial, then a fold over the bytes.
OP3_SQL = f"""
WITH RECURSIVE step(b, k, v) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)))::BIGINT AS text_crc32 FROM d, crc),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - size AS start, sum(size) OVER () AS total FROM n),
c AS (SELECT *, least({SHARDS - 1}, ((2 * start + size) * {SHARDS}) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard FROM c
"""

OP4_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}'), lambda x: x <> '') AS ws, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents),
t AS (SELECT doc_id, good, unnest(ws) AS w, unnest(list_prepend(NULL, ws[:-2])) AS h FROM w WHERE len(ws) > 0),
u AS (SELECT w, count(*) AS c0, count(*) FILTER (good) AS c1 FROM t GROUP BY w),
b AS (SELECT h, w, count(*) AS c0, count(*) FILTER (good) AS c1 FROM t WHERE h IS NOT NULL GROUP BY h, w),
n AS (SELECT greatest(count(*), 1)::DOUBLE AS v, greatest(sum(c0), 1)::DOUBLE AS n0, greatest(sum(c1), 1)::DOUBLE AS n1 FROM u),
p AS (SELECT t.doc_id, {", ".join(f"CASE WHEN coalesce(g.c{k}, 0) > 0 THEN {scoring.A2}::DOUBLE * b.c{k} / g.c{k} + {scoring.A1}::DOUBLE * u.c{k} / n{k} ELSE {scoring.A2 + scoring.A1}::DOUBLE * u.c{k} / n{k} END + {scoring.A0}::DOUBLE / v AS p{k}" for k in (0, 1))}
      FROM t JOIN u ON t.w = u.w LEFT JOIN u g ON t.h = g.w LEFT JOIN b ON t.h = b.h AND t.w = b.w, n),
s AS (SELECT doc_id, -avg(ln(p1)) AS l1, -avg(ln(p0)) AS l0 FROM p GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, round(l1, 6) AS target_loss, round(l0, 6) AS background_loss, round(l0 - l1, 6) AS score FROM w LEFT JOIN s ON w.doc_id = s.doc_id
"""
OP9_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(g), g) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(50) r(j)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT word.doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
byte AS (SELECT doc_id, substr(h, 2 * i + 1, 2) AS x, i FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d)),
edge AS (SELECT doc_id, i, sum(n) AS n FROM (SELECT doc_id, i, 1 AS n FROM hit UNION ALL SELECT doc_id, i + 50, -1 FROM hit) GROUP BY doc_id, i),
mark AS (SELECT byte.doc_id, byte.i, x, sum(coalesce(n, 0)) OVER (PARTITION BY byte.doc_id ORDER BY byte.i) > 0 AS gone FROM byte LEFT JOIN edge ON byte.doc_id = edge.doc_id AND byte.i = edge.i),
run AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS fresh FROM mark),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (fresh) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS t FROM run GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_bm25_packing, op3_prefix_shards, op4_cross_entropy, op5_bpe, op6_merkle_audit, op7_adaptive_quality, op8_simhash_vptree, op9_recompression, op10_prefix_doubling)}
SQL = {"op1_exact_dedup": OP1_SQL, "op3_prefix_shards": OP3_SQL, "op4_cross_entropy": OP4_SQL, "op9_recompression": OP9_SQL, "op10_prefix_doubling": OP10_SQL, "op6_merkle_audit": OP6_SQL, "op7_adaptive_quality": OP7_SQL}
