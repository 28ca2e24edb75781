"""Lexical retrieval packing with a sharded BM25 inverted index.

One map encodes every document (words to ids by bpe.py) and notes for each task in how
many documents each id occurs; these document frequencies, over all documents, are one
number for each id of the vocabulary, which bounds what goes to the driver. Documents are
range-partitioned by a min-hash of their id pairs, so documents with common passages meet
in one shard and a group of copies of any size spreads evenly. Each shard builds a BM25
inverted index of its documents. A seed document queries it with all its terms; its
unused neighbours, best first, fill the window; the one that overflows is cut and its
rest is the next seed. Windows are therefore full; what is left at a shard's end is cut
into sequences whose lengths are powers of two, which need no padding.

Edge cases: a null or empty text is the end mark alone; a document longer than a window
runs through several; copies and repeated ids are packed like any others; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .bpe import BATCH_CHARS, encoder
from .common import grouped, keep, mapped, pack, slices, unpack

WINDOW = 4096
END_ID = 2
#: Tokens of a shard's index.
SHARD_TOKENS = 2 << 20
K1, B = 1.2, 0.75
#: A term is common in a shard if one document of so many has it.
COMMON_SHARE = 8
_PARTS = 64


def _encode(docs: DataFrame, path: str, vocabulary: int) -> DataFrame:
    """Rows (doc_id, ids as little-endian uint16 or uint32, n, near) of every document, and one row of each task with its document frequencies (n is null)."""
    wide = vocabulary > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = encoder(path), np.zeros(vocabulary, np.int64)
        for batch in batches:
            for a, b in slices(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), 4 * BATCH_CHARS):
                ids, counts = bpe.encode_batch([t or "" for t in batch.column(1)[a:b].to_pylist()])
                ends = np.cumsum(counts)
                kind, half = (np.uint64, 32) if wide or b - a > 1 << 16 else (np.uint32, 16)
                pairs = np.repeat(np.arange(b - a, dtype=kind) << kind(half), counts) | ids.astype(kind)
                pairs.sort()
                if len(pairs):
                    seen += np.bincount((pairs[np.r_[True, pairs[1:] != pairs[:-1]]] & kind((1 << half) - 1)).astype(np.int64), minlength=vocabulary)
                hashed = (ids * np.uint32(0x9E3779B1)) ^ (np.r_[ids[1:], ids[:1]] * np.uint32(0x85EBCA77))
                hashed ^= hashed >> np.uint32(15)
                hashed *= np.uint32(0x2C1B3C6D)
                near = np.zeros(b - a, np.uint32)
                some = np.flatnonzero(counts)
                if len(some):
                    near[some] = np.minimum.reduceat(hashed, ends[some] - counts[some])
                small = ids if wide else ids.astype(np.uint16)
                yield pa.record_batch([batch.column(0)[a:b], pa.array([small[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary()), pa.array(counts, pa.int64()), pa.array(near, pa.int64())], names=["doc_id", "ids", "n", "near"])
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([pack(seen)], pa.binary()), pa.array([None], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int64())], names=["doc_id", "ids", "n", "near"])

    return mapped(docs, run, "doc_id bigint, ids binary, n bigint, near bigint")


def _frequencies(rows: DataFrame, vocabulary: int) -> np.ndarray:
    """In how many documents each id occurs: sums of vectors, in two steps."""

    def total(key, table):
        s = np.zeros(vocabulary, np.int64)
        for x in table.column("ids").to_pylist():
            s += unpack(x, np.int64)
        return pa.table({"part": pa.array([0], pa.int64()), "ids": pa.array([pack(s)], pa.binary())})

    schema = "part bigint, ids binary"
    first = rows.filter("n IS NULL").select(F.pmod("near", F.lit(_PARTS)).alias("part"), "ids").groupBy("part").applyInArrow(grouped(total), schema)
    row = first.groupBy("part").applyInArrow(grouped(total), schema).first()
    return unpack(row.ids, np.int64) if row else np.zeros(vocabulary, np.int64)


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray], frequency: np.ndarray, n_docs: int, mean: float):
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        kind, half = (np.uint32, 16) if self.n <= 1 << 16 and len(frequency) <= 1 << 16 else (np.uint64, 32)
        keys = np.repeat(np.arange(self.n, dtype=kind) << kind(half), lengths)
        if len(keys):
            keys |= np.concatenate(docs).astype(kind)
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        times = np.diff(np.r_[first, len(keys)]).astype(np.float32)
        keys = keys[first]
        del first
        doc, term = (keys >> kind(half)).astype(np.int32), (keys & kind((1 << half) - 1)).astype(np.uint16 if half == 16 else np.int64)
        idf = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
        norm = (K1 * (1 - B + B * lengths / max(mean, 1.0))).astype(np.float32)
        weight = idf[term] * times * np.float32(K1 + 1) / (times + norm[doc])
        self._own_terms = term
        self._own = np.searchsorted(doc, np.arange(self.n + 1))
        order = np.argsort(term, kind="stable")
        doc, weight, term = doc[order].astype(np.int64), weight[order].astype(np.float64), term[order]
        # Postings of a term that much of the shard has become a row of a matrix: whole rows add up faster than entries.
        each = np.bincount(term, minlength=len(frequency))
        common = np.flatnonzero(each * COMMON_SHARE > self.n)
        self._row = np.full(len(frequency), -1, np.int64)
        self._row[common] = np.arange(len(common))
        row = self._row[term]
        self._matrix = np.zeros((len(common), self.n), np.float32)
        self._matrix[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        each[common] = 0
        self._docs, self._weight, self._gone = doc[row < 0], weight[row < 0], 0
        self._at = np.r_[0, np.cumsum(each)]

    def forget(self, used: np.ndarray) -> None:
        """Now and then the postings of documents that are used, and stay so, leave."""
        gone = int(used.sum())
        if gone - self._gone > (self.n - self._gone) // 10:
            stay = ~used[self._docs]
            self._docs, self._weight, self._at, self._gone = self._docs[stay], self._weight[stay], np.r_[0, np.cumsum(stay)][self._at], gone

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that have a term of the seed, best first by all its terms."""
        a, b = self._own[seed], self._own[seed + 1]
        terms = self._own_terms[a:b]
        first, last, row = self._at[terms], self._at[terms + np.int64(1)], self._row[terms]
        some = last > first
        spans = [slice(x, y) for x, y in zip(first[some].tolist(), last[some].tolist(), strict=True)]
        score = self._matrix[row[row >= 0]].sum(0).astype(np.float64)
        if spans:
            score += np.bincount(np.concatenate([self._docs[s] for s in spans]), np.concatenate([self._weight[s] for s in spans]), self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        while len(found):
            top = found if len(found) <= 16 else found[np.argpartition(-score[found], 16)[:16]]
            yield from top[np.lexsort((top, -score[top]))].tolist()
            score[top] = 0
            found = found[score[found] > 0]


def fill(lengths: list[int], index: Index, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token once; all sequences full but the last."""
    n, pieces = len(lengths), []
    used, cursor = np.zeros(n, bool), 0
    sequence, room = 0, window

    def put(doc: int, start: int) -> int:
        """What fits of the document from ``start`` on; returns where it was cut."""
        nonlocal sequence, room
        size = min(room, lengths[doc] - start)
        pieces.append((doc, start, size, sequence, window - room))
        room -= size
        if not room:
            sequence, room = sequence + 1, window
        return start + size

    rest = None
    while True:
        if rest is None:
            while cursor < n and used[cursor]:
                cursor += 1
            if cursor == n:
                return pieces
            rest = (cursor, 0)
            used[cursor] = True
        seed, start = rest
        rest, before = None, sequence
        start = put(seed, start)
        if start < lengths[seed]:
            rest = (seed, start)
            continue
        if sequence != before:
            continue
        index.forget(used)
        for doc in index.neighbours(seed, used):
            used[doc] = True
            cut = put(doc, 0)
            if cut < lengths[doc]:
                rest = (doc, cut)
            if sequence != before:
                break


def power_tail(pieces: list[tuple[int, int, int, int, int]], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """The last, partly filled sequence as sequences whose lengths are powers of two."""
    if not pieces:
        return pieces
    last = pieces[-1][3]
    tail = [p for p in pieces if p[3] == last]
    total = sum(p[2] for p in tail)
    if total == window:
        return pieces
    out = pieces[: len(pieces) - len(tail)]
    sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    at = 0
    for doc, start, size, _, _ in tail:
        while size:
            step = min(size, sizes[0] - at)
            out.append((doc, start, step, last, at))
            start, size, at = start + step, size - step, at + step
            if at == sizes[0]:
                sizes, last, at = sizes[1:], last + 1, 0
    return out


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece; ids are little-endian uint32."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = len(encoder(path)._names)
    rows = keep(_encode(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), path, vocabulary), "tokens")
    n_docs, tokens = rows.filter("n IS NOT NULL").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = _frequencies(rows, vocabulary)
    mean, kind = tokens / max(n_docs, 1), np.uint32 if vocabulary > 1 << 16 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, each = [], []
        for b in batches:
            names += b.column("doc_id").to_pylist()
            each += [np.frombuffer(x, kind) for x in b.column("ids").to_pylist()]
        if not names:
            return
        pieces = power_tail(fill([len(e) + 1 for e in each], Index(each, frequency, n_docs, mean), window), window)
        base = TaskContext.get().partitionId() << 32
        for a in range(0, len(pieces), 4096):
            part = pieces[a : a + 4096]
            ids = []
            for doc, start, size, _, _ in part:
                e = each[doc][start : start + size].astype(np.uint32)
                ids.append((e if len(e) == size else np.r_[e, np.uint32(END_ID)]).tobytes())
            cols = list(zip(*part, strict=True))
            out = [pa.array([names[d] for d in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(list(map(zlib.crc32, ids)), pa.int64()), pa.array([len(each[d]) + 1 for d in cols[0]], pa.int64()), pa.array([base + s for s in cols[3]], pa.int64()), pa.array(cols[4], pa.int64())]
            yield pa.record_batch(out + [pa.array(ids, pa.binary())] * with_ids, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

    shards = max(1, -(-tokens // SHARD_TOKENS))
    dealt = rows.filter("n IS NOT NULL").select("doc_id", "ids", "near").repartitionByRange(shards, "near", "doc_id").sortWithinPartitions("near", "doc_id")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    return mapped(dealt.select("doc_id", "ids"), run, schema).withColumnRenamed("doc_id", id_col)
