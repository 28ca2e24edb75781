"""The tables that the queries speak of, built from the given ones; each also as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, numeric
from ..functions import text as tx

CLASSES = 8


def u_sql(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


def code_of(word: Column) -> Column:
    """A code below 1024 from a word's length and three of its characters."""
    return ((F.ascii(word) * 131 + F.ascii(F.substring(word, 2, 1)) * 31 + F.ascii(F.substring(word, -1, 1)) * 7 + F.length(word) * 17) % 1024).cast("int")


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def lines(self, rows: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(r,) for r in rows], "value string")

    @cached_property
    def utt(self) -> DataFrame:
        d, test = self.table("documents"), F.col("doc_id") % 20 == 19
        rows = d.join(self.table("labels").select("doc_id", "quality"), "doc_id", "left")
        video = F.when(test, "").otherwise(F.concat_ws("_", "source", (F.col("doc_id") % 10).cast("string")))
        rows = rows.select("doc_id", F.when(test, "test").otherwise("trainval").alias("split"), video.alias("video_id"), F.col("doc_id").cast("string").alias("stem"), (F.col("n_chars") % 400).cast("int").alias("n_tokens"), F.when(F.col("quality").isNotNull(), (1 + F.col("doc_id") % 6).cast("int")).alias("conf"), F.col("text").alias("text_raw"))
        return rows.select(
            tx.relpath(F.col("video_id"), F.col("stem"), "").alias("utterance_id"), "doc_id", "split", "video_id", "stem", "n_tokens", numeric.duration(F.col("n_tokens")).alias("duration_s"), ((F.col("split") == "trainval") & (F.col("n_tokens") >= 50)).alias("selectable"), "conf", "text_raw",
            tx.normalize_plain(F.regexp_replace("text_raw", "[0-9]+", " ")).alias("text_norm"))

    @cached_property
    def tokens(self) -> DataFrame:
        """(utterance_id, split, codes): a code for each word."""
        word = F.filter(F.split("text_raw", r"\s+"), lambda w: w != "")
        return self.utt.select("utterance_id", "doc_id", "split", F.transform(word, code_of).alias("codes"))

    @cached_property
    def streams(self) -> DataFrame:
        """Rows of eight streams of codes, as a codec gives them, with the text."""
        shifted = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.transform("codes", lambda c: (c + s) % 1024))
        return self.tokens.select("utterance_id", "doc_id", shifted.alias("tokens")).join(self.utt.select("utterance_id", "text_norm"), "utterance_id")

    @cached_property
    def target(self) -> DataFrame:
        word = F.filter(F.split("text", r"\s+"), lambda w: w != "")
        return self.table("benchmark").select(F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("utterance_id"), F.transform(word, code_of).alias("codes"))

    @cached_property
    def pool(self) -> DataFrame:
        return self.utt.filter((F.col("split") == "trainval") & F.col("selectable"))

    @cached_property
    def dnsmos(self) -> DataFrame:
        raw = [(1 + 4 * numeric.uniform(c, F.col("utterance_id"))).alias(f"{c}_raw") for c in ("sig", "bak", "ovr")]
        rows = self.pool.select("utterance_id", *raw)
        return rows.select("*", *[numeric.calibrate(F.col(f"{c}_raw"), c).alias(f"{c}_mos") for c in ("sig", "bak", "ovr")])

    @cached_property
    def proxy(self) -> DataFrame:
        """(utterance_id, ckpt, loss, el2n): three checkpoints, each without some rows."""
        rows = self.pool.select("utterance_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ckpt"))
        key = F.concat_ws("|", F.col("ckpt").cast("string"), "utterance_id")
        return rows.filter(numeric.uniform("seen", key) < 0.9).select("utterance_id", "ckpt", (3 * numeric.uniform("loss", key)).alias("loss"), numeric.uniform("el2n", key).alias("el2n"))

    @cached_property
    def weights(self) -> DataFrame:
        return self.pool.select("utterance_id", (8 * numeric.uniform("logit", F.col("utterance_id")) - 4).alias("score_logit"))

    @cached_property
    def clusters(self) -> DataFrame:
        return self.pool.select("utterance_id", F.floor(8 * numeric.uniform("cluster", F.col("utterance_id"))).cast("int").alias("cluster_id"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")

    @cached_property
    def frames(self) -> DataFrame:
        """(vec_id, frames, n_frames): eight frames of eight probabilities."""
        f = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: arrays.softmax(F.slice(F.col("v"), i * CLASSES + 1, CLASSES)))
        return self.vectors.select("vec_id", f.alias("frames"), (1 + F.col("vec_id") % 8).cast("int").alias("n_frames"))

    @cached_property
    def log(self) -> DataFrame:
        """Metric log: run_id, epoch, split, utterance_id, metric, value."""
        e = self.table("events")
        metric = F.get(F.array(F.lit("loss"), F.lit("wer"), F.lit("cer"), F.lit("dropped_utts")), (F.col("event_id") % 4).cast("int"))
        who = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 10 == 1, F.lit("")).otherwise(F.col("user_id").cast("string"))
        return e.select(F.concat(F.lit("track_b/run"), (F.col("user_id") % 5).cast("string")).alias("run_id"), F.dayofmonth("ts").alias("epoch"), F.when(F.col("event_type") == "view", "train").otherwise("val").alias("split"), who.alias("utterance_id"), metric.alias("metric"), "value", "event_id")

    @cached_property
    def pairs(self) -> DataFrame:
        p = self.table("part")
        t = lambda a: F.lower(F.concat_ws(" ", f"{a}.p_name", f"{a}.p_type"))
        return p.alias("a").join(p.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1).select(F.col("a.p_partkey").alias("pair_id"), t("a").alias("ref"), t("b").alias("hyp"))

    @cached_property
    def files(self) -> DataFrame:
        return self.table("pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.get(F.array(F.lit(".txt"), F.lit(".tokens.pt"), F.lit(".wav")), (F.col("page_id") % 3).cast("int"))).alias("relpath"), F.octet_length("html").cast("bigint").alias("bytes"), F.sha2("html", 256).alias("sha256"), "page_id")


_CODES = "list_transform(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''), lambda w: ((ascii(w) * 131 + ascii(substr(w, 2, 1)) * 31 + ascii(substr(w, -1, 1)) * 7 + length(w) * 17) % 1024)::INTEGER)"
_CAL = {c: " + ".join(f"{k!r}::DOUBLE * {c}_raw * {c}_raw" if i == 0 else f"{k!r}::DOUBLE * {c}_raw" if i == 1 else f"{k!r}::DOUBLE" for i, k in enumerate(v)) for c, v in numeric.CALIBRATION.items()}
#: View -> (views that it needs, SQL).
SQL: dict[str, tuple[list[str], str]] = {
    "utt": ([], r"""SELECT CASE WHEN video_id = '' THEN stem ELSE video_id || '/' || stem END AS utterance_id, *, round(n_tokens / 50.0, 4)::DOUBLE AS duration_s, split = 'trainval' AND n_tokens >= 50 AS selectable,
        trim(regexp_replace(regexp_replace(lower(regexp_replace(text_raw, '[0-9]+', ' ', 'g')), '[^a-z''\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS text_norm
      FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 20 = 19 THEN 'test' ELSE 'trainval' END AS split, CASE WHEN d.doc_id % 20 = 19 THEN '' ELSE source || '_' || (d.doc_id % 10) END AS video_id, d.doc_id::VARCHAR AS stem, (n_chars % 400)::INTEGER AS n_tokens,
        CASE WHEN quality IS NOT NULL THEN (1 + d.doc_id % 6)::INTEGER END AS conf, text AS text_raw FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""),
    "tokens": (["utt"], f"SELECT utterance_id, doc_id, split, {_CODES.format('text_raw')} AS codes FROM utt"),
    "target": ([], f"SELECT 'item/' || item_id AS utterance_id, {_CODES.format('text')} AS codes FROM benchmark"),
    "pool": (["utt"], "SELECT * FROM utt WHERE split = 'trainval' AND selectable"),
    "dnsmos": (["pool"], f"SELECT *, {', '.join(f'{v} AS {c}_mos' for c, v in _CAL.items())} FROM (SELECT utterance_id, " + ", ".join(f"1 + 4 * {u_sql(c, 'utterance_id')} AS {c}_raw" for c in _CAL) + " FROM pool)"),
    "proxy": (["pool"], f"SELECT utterance_id, ckpt, 3 * {u_sql('loss', 'k')} AS loss, {u_sql('el2n', 'k')} AS el2n FROM (SELECT utterance_id, ckpt::INTEGER AS ckpt, ckpt || '|' || utterance_id AS k FROM pool, range(1, 4) t(ckpt)) WHERE {u_sql('seen', 'k')} < 0.9"),
    "weights": (["pool"], f"SELECT utterance_id, 8 * {u_sql('logit', 'utterance_id')} - 4 AS score_logit FROM pool"),
    "clusters": (["pool"], f"SELECT utterance_id, floor(8 * {u_sql('cluster', 'utterance_id')})::INTEGER AS cluster_id FROM pool"),
    "vectors": ([], "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"),
    "frames": (["vectors"], "SELECT vec_id, list_transform(range(8), lambda i: list_transform(v[i * 8 + 1 : i * 8 + 8], lambda x: exp(x - list_max(v[i * 8 + 1 : i * 8 + 8])) / list_sum(list_transform(v[i * 8 + 1 : i * 8 + 8], lambda y: exp(y - list_max(v[i * 8 + 1 : i * 8 + 8])))))) AS frames, (1 + vec_id % 8)::INTEGER AS n_frames FROM vectors"),
    "log": ([], "SELECT 'track_b/run' || (user_id % 5) AS run_id, day(ts)::INTEGER AS epoch, CASE WHEN event_type = 'view' THEN 'train' ELSE 'val' END AS split, CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE user_id::VARCHAR END AS utterance_id, ['loss', 'wer', 'cer', 'dropped_utts'][(event_id % 4 + 1)::INTEGER] AS metric, value, event_id FROM events"),
    "pairs": ([], "SELECT a.p_partkey AS pair_id, lower(a.p_name || ' ' || a.p_type) AS ref, lower(b.p_name || ' ' || b.p_type) AS hyp FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"),
    "files": ([], "SELECT 'pages/' || page_id || ['.txt', '.tokens.pt', '.wav'][(page_id % 3 + 1)::INTEGER] AS relpath, strlen(html)::BIGINT AS bytes, sha256(html) AS sha256, page_id FROM pages"),
    "parts": (["pool"], f"SELECT utterance_id, p.video_id, CASE WHEN b < t THEN 'val' ELSE 'train' END AS part FROM pool p JOIN (SELECT video_id, sum(n) OVER (ORDER BY {u_sql('split', 'video_id')}, video_id) - n AS b, (SELECT count(*) * 65 // 1000 FROM pool) AS t FROM (SELECT video_id, count(*) AS n FROM pool GROUP BY 1)) g ON p.video_id = g.video_id"),
    "loss": (["proxy"], "SELECT utterance_id, avg(loss) AS loss_mean, avg(el2n) AS el2n_mean, count(*) AS n_ckpts FROM proxy GROUP BY 1"),
}


def _numbers() -> str:
    """SQL for the names of 0 to 999 (0 is empty) as a list."""
    ones, tens = (f"[{', '.join(repr(w) for w in ws)}]" for ws in (tx.ONES, tx.TENS))
    rest = f"CASE WHEN k % 100 < 20 THEN CASE WHEN k % 100 > 0 THEN {ones}[k % 100 + 1] ELSE '' END ELSE {tens}[k % 100 // 10 + 1] || CASE WHEN k % 10 > 0 THEN ' ' || {ones}[k % 10 + 1] ELSE '' END END"
    return f"(SELECT list(CASE WHEN k >= 100 THEN {ones}[k // 100 + 1] || ' hundred' || CASE WHEN k % 100 > 0 THEN ' and ' ELSE '' END ELSE '' END || {rest} ORDER BY k) FROM range(1000) t(k))"


def spelt(text: str) -> str:
    """SQL: a text in which each run of digits is written out as words between spaces (a column ``small`` has the names below 1000)."""
    powers, scales = "[" + ", ".join(f"{1000 ** g}::HUGEINT" for g in range(12)) + "]", f"[{', '.join(repr(x) for x in tx.SCALES)}]"
    n = "x::HUGEINT"
    part = f"CASE WHEN g = 0 AND {n} >= 1000 AND {n} % 1000 < 100 THEN 'and ' ELSE '' END || small[({n} // {powers}[g + 1] % 1000)::BIGINT + 1] || CASE WHEN g > 0 THEN ' ' || {scales}[g + 1] ELSE '' END"
    words = f"array_to_string(list_transform(list_filter(range(11, -1, -1), lambda g: {n} // {powers}[g + 1] % 1000 > 0), lambda g: {part}), ' ')"
    return f"array_to_string(list_transform(regexp_extract_all({text}, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN NOT regexp_matches(x, '^[0-9]') THEN x WHEN {n} = 0 THEN ' zero ' ELSE ' ' || {words} || ' ' END), '')"


def with_views(query: str, *names: str) -> str:
    """The query with the views it needs in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in SQL[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    if not order:
        return query
    own = query.strip()
    return "WITH " + ", ".join(f'"{n}" AS ({SQL[n][1]})' for n in order) + (", " + own[5:] if own.startswith("WITH ") else " " + query)
