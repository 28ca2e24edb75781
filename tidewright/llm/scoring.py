"""Cross-entropy difference scoring with matched n-gram models.

Two word bigram models, one of a target corpus and one of all documents, have the same
vocabulary (every word of the documents), orders, weights and smoothing:

    p(w | h) = (A2 c(h, w) / c(h) + A1 c(w) / N) (or (A2 + A1) c(w) / N where h is new) + A0 / V

A document's score is the mean over its words of log p_target - log p_background; higher
means more like the target. The first word has no history. Counts are exact and cover all
documents; they are looked up as in repeats.py: chunks of documents send their distinct
n-grams with counts, in sorted blocks for each part of the key space, and get the corpus
counts back; the three totals are one broadcast row. An n-gram is named by 56 bits of a hash, so that names collide about once in
10**8 look-ups for 10**9 n-grams. A target document is part of its own model.

Edge cases: a null text or one without words has no words and a null score; null and
repeated ids are scored like others, each row by its own text, and spread over chunks;
words and texts of any length are read whole; target ids that no document has do not matter; with
an empty target all target probabilities are A0 / V; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import CHUNK_BYTES, grouped, mix64, pack, pack_sorted, partitions, unpack, unpack_sorted
from .repeats import PART_BYTES, Tokens, _steps, by_part
from .substrings import words

A2, A1, A0 = 0.7, 0.25, 0.05
#: Chunks over which rows of one id may be dealt, by their texts.
SALT = 16
_LOW = np.uint64((1 << 56) - 1)
_ASK = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("order", pa.int32()), ("keys", pa.binary()), ("background", pa.binary()), ("target", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("order", pa.int32()), ("background", pa.binary()), ("target", pa.binary())])
_PLAIN_CASE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _lowered(table: pa.Table):
    for piece, ids, texts in _steps(table):
        tokens = words([t.translate(_PLAIN_CASE) for t in texts])
        yield piece, ids, Tokens(tokens.values & _LOW, tokens.starts)


def _grams(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The key of each word with the one before it, and where those are (not at a text's first word)."""
    v = tokens.values
    if not len(v):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.zeros(len(v) + 1, bool)
    first[tokens.starts] = True
    at = np.flatnonzero(~first[: len(v)])
    return mix64(v[at - 1] * np.uint64(0x9E3779B97F4A7C15) + v[at]) & _LOW, at


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _by_part(keys: np.ndarray, parts: int) -> list[slice]:
    """Ascending keys lie part by part: parts are equal ranges of the key space."""
    edges = np.searchsorted(keys, np.array([-(-(p << 56) // parts) for p in range(parts + 1)], np.uint64))
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, target_loss, background_loss, score) of every row; losses are mean negative log probabilities, score = background_loss - target_loss.

    ``target_ids``: one column of ids, the documents that make up the target corpus.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(max(-(-size // PART_BYTES), partitions(spark) // 2, 1))
    chunks = int(max(-(-size // CHUNK_BYTES), 2 * partitions(spark)))
    tasks = max(partitions(spark), chunks // 2)

    def chunk_of(c: Column, salt: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("bigint"), salt), F.lit(chunks)).alias("chunk")

    doc, by_text = F.col(id_col), F.xxhash64(F.col(text_col))
    texts = docs.select(chunk_of(doc, F.when(doc.isNull(), by_text).otherwise(F.pmod(by_text, F.lit(SALT)))), doc.cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).repartition(tasks, "chunk")
    wanted = F.col(target_ids.columns[0])
    salted = target_ids.filter(wanted.isNotNull()).select(wanted.cast("bigint").alias("id")).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    target = salted.select(chunk_of(F.col("id"), F.col("salt")), "id")

    def ask(key, table, chosen):
        if not table.num_rows:
            return _table([], _ASK)
        chosen = np.sort(np.asarray(chosen.column("id")))
        each = {1: ([], []), 2: ([], [])}
        for _, ids, tokens in _lowered(table):
            among = np.isin(ids, chosen)
            mine = np.repeat(among, np.diff(tokens.starts))
            grams, at = _grams(tokens)
            for order, k, m in ((1, tokens.values, mine), (2, grams, mine[at])):
                each[order][0].append(_counted(k))
                each[order][1].append(_counted(k[m]))
        rows = []
        for order, pair in each.items():
            keys = np.unique(np.concatenate([k for k, _ in pair[0]]))
            counts = []
            for found in pair:
                c = np.zeros(len(keys), np.int64)
                for k, n in found:
                    c[np.searchsorted(keys, k)] += n
                counts.append(c)
            rows += [(p, key[0].as_py(), order, pack_sorted(keys[s]), pack(counts[0][s]), pack(counts[1][s])) for p, s in enumerate(_by_part(keys, parts)) if s.start < s.stop]
        return _table(rows, _ASK)

    def answer(key, table):
        part, out = key[0].as_py(), []
        for order in (1, 2):
            t = table.filter(pc.equal(table.column("order"), order))
            asked = [unpack_sorted(k) for k in t.column("keys").to_pylist()]
            if not asked:
                continue
            every, place = np.unique(np.concatenate(asked), return_inverse=True)
            sums = [np.bincount(place, np.concatenate([unpack(x, np.int64) for x in t.column(c).to_pylist()]), len(every)).astype(np.int64) for c in ("background", "target")]
            ends = np.cumsum(list(map(len, asked)))
            for c, k, e in zip(t.column("chunk").to_pylist(), asked, ends, strict=True):
                mine = place[e - len(k) : e]
                out.append((c, part, order, pack(sums[0][mine]), pack(sums[1][mine])))
        return _table(out, _ANSWER)

    def totals(key, table):
        """Distinct words and occurrences of one part."""
        t = table.filter(pc.equal(table.column("order"), 1))
        n = len(np.unique(np.concatenate([np.empty(0, np.uint64), *map(unpack_sorted, t.column("keys").to_pylist())])))
        b, c = (sum(int(unpack(x, np.int64).sum()) for x in t.column(k).to_pylist()) for k in ("background", "target"))
        return pa.table({k: pa.array([x], pa.int64()) for k, x in (("v", n), ("b", b), ("t", c))})

    def score(key, table, answers):
        said = {(p, o): (b, t) for p, o, b, t in zip(*(answers.column(c).to_pylist() for c in ("part", "order", "background", "target")), strict=True)}
        vocabulary, n_background, n_target = (answers.column(c)[0].as_py() if len(answers) else 1 for c in ("v", "b", "t"))
        keys: dict[int, list] = {1: [], 2: []}
        for _, _, tokens in _lowered(table):
            keys[1].append(np.unique(tokens.values))
            keys[2].append(np.unique(_grams(tokens)[0]))
        known = {o: np.unique(np.concatenate(k)) for o, k in keys.items()} if table.num_rows else {}
        counts = {o: [np.concatenate([unpack(said[p, o][i], np.int64) if s.start < s.stop else np.empty(0, np.int64) for p, s in enumerate(_by_part(k, parts))]) for i in (0, 1)] for o, k in known.items()}
        out = []
        for piece, _, tokens in _lowered(table):
            n = np.diff(tokens.starts)
            losses = []
            grams, at = _grams(tokens)
            one, two = np.searchsorted(known[1], tokens.values), np.searchsorted(known[2], grams)
            for which, total in ((0, n_background), (1, n_target)):
                single = counts[1][which][one].astype(np.float64)
                p = (A2 + A1) * single / total
                before = single[at - 1]
                p[at] = np.where(before > 0, A2 * counts[2][which][two] / np.maximum(before, 1) + A1 * single[at] / total, p[at])
                logs = np.r_[0.0, np.cumsum(np.log(p + A0 / vocabulary))]
                losses.append(-(logs[tokens.starts[1:]] - logs[tokens.starts[:-1]]))
            some = n > 0
            background, mean = (x / np.maximum(n, 1) for x in losses)
            out.append(pa.table([piece.column("id"), pa.array(n, pa.int64()), *(pa.array(x, pa.float64(), mask=~some) for x in (mean, background, background - mean))], names=["id", "n_words", "target_loss", "background_loss", "score"]))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "target_loss": pa.array([], pa.float64()), "background_loss": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})

    known = texts.groupBy("chunk").cogroup(target.groupBy("chunk")).applyInArrow(grouped(ask), "part bigint, chunk bigint, `order` int, keys binary, background binary, target binary")
    told = by_part(known, parts).applyInArrow(grouped(answer), "chunk bigint, part bigint, `order` int, background binary, target binary")
    # One row for each part, then one for all.
    sums = by_part(known, parts).applyInArrow(grouped(totals), "v bigint, b bigint, t bigint").agg(*[F.greatest(F.sum(c), F.lit(1)).alias(c) for c in ("v", "b", "t")])
    told = told.join(F.broadcast(sums))
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(grouped(score), "id bigint, n_words bigint, target_loss double, background_loss double, score double").withColumnRenamed("id", id_col)
