"""Finding every window of ``WINDOW`` tokens that an earlier document has too: the frame of both substring operators.

Documents are dealt into chunks by id. What a chunk asks of the corpus goes out as blocks:
its distinct keys of one part of the key space, sorted and packed. One task for each part
puts the blocks of all chunks together and answers with a bit or two for each key. So a
key that a third of all documents share is sent once by each chunk, not once by each document.

1. A scheme cuts texts into *landmark* keys that depend on nothing but their surroundings,
   so that any two equal windows hold the same landmark. Question: does another document
   have this landmark?
2. Windows whose landmarks allow it are hashed whole. Question: does a document with a
   smaller id have this window?
3. The tokens that such windows cover are removed.

All passes over the texts read one and the same exchange. A window is named by two
polynomials modulo the prime 2**61 - 1 at two random points, drawn anew for each run. Two
unequal windows of n tokens agree in both with a chance of at most (n / 2**61)**2, about
10**-33, whatever the texts are: no text can be made to collide, and among 10**14 windows
any wrong match at all has a chance of about 10**-5. Landmarks have a faster hash: where
two of them collide, windows are compared in vain.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import CHUNK_BYTES, grouped, mix64, pack, pack_sorted, partitions, slices, unpack, unpack_sorted

WINDOW = 50
#: Bytes of text whose arrays are held at once inside a chunk.
STEP_BYTES = 1 << 19
#: Bytes of text for each part of the key space.
PART_BYTES = 8 << 20
#: Ids that are null count as the largest.
NULL_ID = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_points: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
#: Tokens of which polynomials are taken at once, and the most of one range.
_BLOCK, LONGEST = 1 << 18, 128
PRIME = (1 << 61) - 1
_P, _M31, _M30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_U30, _U31, _U61 = np.uint64(30), np.uint64(31), np.uint64(61)


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for values up to 61 bits."""
    a1, a0, b1, b0 = a >> _U31, a & _M31, b >> _U31, b & _M31
    middle = a1 * b0 + a0 * b1
    return _folded(np.uint64(2) * a1 * b1 + (middle >> _U30) + ((middle & _M30) << _U31) + a0 * b0)


def _ascending(base: int, n: int) -> np.ndarray:
    """base**i modulo the prime for i below n."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = times(out[:more], np.uint64(pow(base, have, PRIME)))
        have += more
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if _BASE not in _powers or len(_powers[_BASE][0]) < n:
        _powers[_BASE] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(max(n, _BLOCK) - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return tuple(p[:n] for p in _powers[_BASE])


class Spans:
    """Fast hashes of token ranges, from one prefix sum; for landmarks alone."""

    def __init__(self, tokens: np.ndarray):
        up, self._down = powers(len(tokens) + 1)
        self._sum = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[:-1], out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sum[end] - self._sum[start]) * self._down[start])


def random_points() -> tuple[int, int]:
    return tuple(secrets.randbelow(PRIME - (1 << 32)) + (1 << 31) for _ in range(2))


def _limbs(point: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the powers of a point, and its inverse powers, for one block; those of the last points are kept."""
    if point not in _points:
        while len(_points) > 1:
            del _points[next(iter(_points))]
        up = _ascending(point, _BLOCK + 1)
        _points[point] = up & _M31, up >> _U31, _ascending(pow(point, -1, PRIME), _BLOCK + 1)
    return _points[point]


def _polynomials(tokens: np.ndarray, start: np.ndarray, end: np.ndarray, point: int, small: bool) -> np.ndarray:
    low_up, high_up, down = _limbs(point)
    n = len(tokens)
    low, high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    if small:  # below 2**9: products need not be reduced before they are summed
        each = tokens * low_up[:n], tokens * high_up[:n]
    else:
        x = times(tokens, low_up[:n] + (high_up[:n] << _U31))
        each = x & _M31, x >> _U31
    np.cumsum(each[0], out=low[1:])  # may wrap: only differences over short ranges are used
    np.cumsum(each[1], out=high[1:])
    low, high = low[end] - low[start], high[end] - high[start]
    return times(_folded(low + (high >> _U30) + ((high & _M30) << _U31)), down[start])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (starts ascending) that overlap or touch as one: their starts and ends, and which of them each range is in."""
    reach = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]
    return start[new], reach[last], np.cumsum(new) - 1


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n tokens lie in some range."""
    step = np.zeros(n + 1, np.int8)
    if len(start):
        order = np.argsort(start, kind="stable")
        a, b, _ = merged(start[order], end[order])
        step[a], step[b] = 1, -1
    return np.cumsum(step[:n], dtype=np.int8).astype(bool)


def names(tokens: np.ndarray, start: np.ndarray, end: np.ndarray, points: tuple[int, int], small: bool = False) -> list[np.ndarray]:
    """Two names of each of some short ranges (starts ascending): the polynomials of their tokens modulo the prime at two points.

    Only tokens that some range covers are looked at, and a block of them at a time.
    ``small``: tokens are bytes, and count as one more; else they have up to 61 bits and none is zero.
    """
    out = [np.empty(len(start), np.uint64) for _ in points]
    if not len(start):
        return out
    a, b, which = merged(start, end)
    kept = tokens[covered(len(tokens), a, b)]
    shift = (np.cumsum(b - a) - (b - a) - a)[which]
    start, end = start + shift, end + shift
    i = 0
    while i < len(start):
        j = int(np.searchsorted(start, start[i] + _BLOCK - LONGEST, "right"))
        base, top = int(start[i]), int(end[i:j].max())
        block = kept[base:top].astype(np.uint64) + np.uint64(small)
        for name, point in zip(out, points, strict=True):
            name[i:j] = _polynomials(block, start[i:j] - base, end[i:j] - base, point, small)
        i = j
    return out


def is_in(ascending: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(keys), bool)
    return ascending[np.minimum(np.searchsorted(ascending, keys), len(ascending) - 1)] == keys


@dataclass
class Tokens:
    """The tokens of some texts in one array, and where each text's tokens begin (with the end as a last entry)."""

    values: np.ndarray
    starts: np.ndarray


@dataclass
class Scheme:
    """tokens: texts to tokens. landmarks: tokens to (start, key), none across texts.
    possible: of each window's start, whether the window may be repeated, by a test of shared keys.
    left: what is left of a text.
    """

    tokens: Callable[[list[bytes]], Tokens]
    landmarks: Callable[[Tokens], tuple[np.ndarray, np.ndarray]]
    possible: Callable[[Tokens, Callable[[np.ndarray], np.ndarray]], np.ndarray]
    left: Callable[[bytes, np.ndarray], object]
    left_type: pa.DataType


def _steps(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, list[bytes]]]:
    table = table.combine_chunks()
    text = table.column("text")
    for a, b in slices(np.asarray(pc.binary_length(text)), STEP_BYTES):
        piece = table.slice(a, b - a)
        yield piece, np.asarray(piece.column("id").fill_null(NULL_ID)), piece.column("text").to_pylist()


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys with the smallest and the largest document of each."""
    if not len(keys):
        return keys, docs, docs
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)


def _blocks(chunk: int, keys: np.ndarray, part: np.ndarray, docs: np.ndarray, extra: Callable[[np.ndarray, np.ndarray], tuple[bytes, bytes]]) -> tuple[list, list]:
    """A chunk's question: for each part (chunk, part, keys, extra), keys distinct and ascending."""
    rows, asked = [], []
    order = np.argsort(part, kind="stable")
    keys, docs, part = keys[order], docs[order], part[order]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        k, low, high = _distinct(keys[a:b], docs[a:b])
        rows.append((chunk, int(part[a]), pack_sorted(k), extra(low, high)))
        asked.append((int(part[a]), k, low))
    return rows, asked


ASK, ANSWER = "chunk bigint, part bigint, keys binary, extra binary", "chunk bigint, part bigint, bits binary"
_ASK = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("bits", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _landmarks(table: pa.Table, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    keys, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for _, ids, texts in _steps(table):
        tokens = scheme.tokens(texts)
        start, key = scheme.landmarks(tokens)
        k, low, high = _distinct(key, ids[np.searchsorted(tokens.starts, start, "right") - 1])
        two = high > low
        keys += [k, k[two]]
        docs += [low, high[two]]
    return np.concatenate(keys), np.concatenate(docs)


def _shared_bits(table: pa.Table, scheme: Scheme, parts: int, chunk: int, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's distinct landmarks, ascending, and whether another document has each."""
    keys, docs = _landmarks(table, scheme)
    asked = _blocks(chunk, keys, (keys % np.uint64(parts)).astype(np.int64), docs, lambda *_: b"")[1]
    known = [k for _, k, _ in asked]
    bits = [np.unpackbits(np.frombuffer(answers[p], np.uint8), count=len(k)).astype(bool) for p, k, _ in asked]
    if not known:
        return np.empty(0, np.uint64), np.empty(0, bool)
    keys, bits = np.concatenate(known), np.concatenate(bits)
    order = np.argsort(keys)
    return keys[order], bits[order]


def _candidates(tokens: Tokens, scheme: Scheme, shared: np.ndarray, points: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that may be repeated as far as ``shared`` landmarks (ascending) tell, with both names."""
    n = len(tokens.values)
    if n < WINDOW or not len(shared):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    room = np.diff(tokens.starts)
    whole = covered(n, tokens.starts[:-1][room >= WINDOW], tokens.starts[1:][room >= WINDOW] - WINDOW + 1)[: n - WINDOW + 1]
    s = np.flatnonzero(scheme.possible(tokens, lambda key: is_in(shared, key)) & whole)
    # All 64 bits of a token between them.
    return s, *(names(v | np.uint64(1), s, s + WINDOW, (p,))[0] for v, p in zip((tokens.values >> np.uint64(3), tokens.values & _P), points, strict=True))


def named(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, place): an ascending order of the rows of some columns, where in it each distinct row begins, and which distinct row each one is."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def joined(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        end = at + 8 + int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : end])
        at = end
    return out


@dataclass
class Question:
    """What a chunk asks about windows: a row for each part, and for each window which of the distinct ones it is."""

    rows: list
    edges: np.ndarray
    low: np.ndarray
    place: np.ndarray

    def verdicts(self, said: dict[int, bytes], own: np.ndarray) -> np.ndarray:
        """Whether a document smaller than ``own`` has each window, given the answers."""
        bits = [np.unpackbits(np.frombuffer(said[r[1]], np.uint8), count=n) for r, n in zip(self.rows, np.diff(self.edges).tolist(), strict=True)]
        return np.concatenate([np.empty(0, np.uint8), *bits]).astype(bool)[self.place] | (self.low[self.place] < own)


def question(chunk: int, one: np.ndarray, two: np.ndarray, ids: np.ndarray, parts: int) -> Question:
    """Of windows with names (one, two) each distinct one once, with the smallest of the chunk's documents that have it."""
    part = (two % np.uint64(parts)).astype(np.int64)
    order, first, place = named(part, one, two)
    if not len(first):
        return Question([], np.zeros(1, np.int64), ids, place)
    at, low = order[first], np.minimum.reduceat(ids[order], first)
    p, one, two = part[at], one[at], two[at]
    edges = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True])
    rows = [(chunk, int(p[a]), pack_sorted(one[a:b]), joined(pack(low[a:b]), pack(two[a:b]))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return Question(rows, edges, low, place)


def stripped(piece: pa.Table, texts: list[bytes], tokens: Tokens, starts: np.ndarray, ends: np.ndarray, left_of, left_type: pa.DataType, digest, carry: bool) -> pa.Table:
    """The result rows of some texts, given the ranges of tokens to remove."""
    gone = covered(len(tokens.values), starts, ends)
    each = [gone[a:b] for a, b in zip(tokens.starts[:-1], tokens.starts[1:], strict=True)]
    left = [left_of(t, c) for t, c in zip(texts, each, strict=True)]
    if digest:
        left = list(map(digest, left))
    spans = [int(c[:1].sum()) + int((c[1:] & ~c[:-1]).sum()) for c in each]
    return pa.table([piece.column("id"), pa.array(np.diff(tokens.starts), pa.int64()), pa.array([int(c.sum()) for c in each], pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.string() if digest else left_type), *([piece.column("rest")] if carry else [])], names=["id", "n_tokens", "n_removed", "n_spans", "left", *["rest"] * carry])


def dealt(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, int, int]:
    """(chunk, id, text, rest) of every row, the number of parts of the key space, and the bytes of text.

    Rows of one id, or without any, are dealt by their texts too, so that none of them is one chunk's load.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(max(-(-size // PART_BYTES), partitions(spark) // 2, 1))
    chunks = int(max(-(-size // CHUNK_BYTES), 2 * partitions(spark)))
    texts = docs.select(F.pmod(F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col)), F.lit(chunks)).alias("chunk"), F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *([F.struct(*[F.col(c) for c in carry]).alias("rest")] if carry else []))
    return texts.repartition(max(partitions(spark), chunks // 2), "chunk"), parts, size


def by_part(asks: DataFrame, parts: int):
    """Questions by part, over as many tasks as there are parts for."""
    return asks.repartition(max(partitions(asks.sparkSession), parts // 2), "part").groupBy("part")


def result_schema(docs: DataFrame, left: str, carry: list[str]) -> str:
    kinds = dict(docs.dtypes)
    rest = ", ".join(f"`{c}`: {kinds[c]}" for c in carry)
    return f"id bigint, n_tokens bigint, n_removed bigint, n_spans bigint, left {left}" + (f", rest struct<{rest}>" if carry else "")


def answer_windows(key, table):
    """For each key of each chunk: does a smaller document than the chunk's smallest have it? A row of part -1 - chunk is handed through."""
    part = key[0].as_py()
    if part < 0:
        return _table([(-1 - part, -1, table.column("extra")[0].as_py())], _ANSWER)
    one = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    low, two = zip(*map(parted, table.column("extra").to_pylist()), strict=True)
    ids, two = np.concatenate([unpack(x, np.int64) for x in low]), np.concatenate([unpack(x, np.uint64) for x in two])
    order, first, place = named(np.concatenate(one), two)
    bits = np.split(np.minimum.reduceat(ids[order], first)[place] < ids, np.cumsum(list(map(len, one)))[:-1])
    return _table([(c, part, np.packbits(b).tobytes()) for c, b in zip(table.column("chunk").to_pylist(), bits, strict=True)], _ANSWER)


def remove_repeats(docs: DataFrame, scheme: Scheme, id_col: str, text_col: str, carry: list[str], digest: Callable[[object], object] | None = None) -> DataFrame:
    """(id, n_tokens, n_removed, n_spans, left[, rest]) of every row: what is left once each token is removed that a window covers which also starts in a document with a smaller id.

    Null ids count as larger than all others; a null text as empty; rows with one id as
    one document (their windows do not remove each other's). Names of further columns do
    not matter, those in ``carry`` are handed through.
    """
    texts, parts, _ = dealt(docs, id_col, text_col, carry)
    points = random_points()

    def ask_landmarks(key, table):
        keys, ids = _landmarks(table, scheme)
        return _table(_blocks(key[0].as_py(), keys, (keys % np.uint64(parts)).astype(np.int64), ids, lambda low, high: np.packbits(high > low).tobytes())[0], _ASK)

    def answer_landmarks(key, table):
        asked = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("extra").to_pylist(), asked, strict=True)]
        every, place, times = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        shared = (times > 1) | (np.bincount(place, np.concatenate(several), len(every)) > 0)
        bits = np.split(shared[place], np.cumsum(list(map(len, asked)))[:-1])
        return _table([(c, key[0].as_py(), np.packbits(b).tobytes()) for c, b in zip(table.column("chunk").to_pylist(), bits, strict=True)], _ANSWER)

    def windows(table: pa.Table, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Both names and the document of each candidate, and the starts of each step's."""
        found = [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))]
        starts = []
        for _, ids, texts in _steps(table):
            tokens = scheme.tokens(texts)
            s, one, two = _candidates(tokens, scheme, shared, points)
            found.append((one, two, ids[np.searchsorted(tokens.starts, s, "right") - 1]))
            starts.append(s)
        return *map(np.concatenate, zip(*found, strict=True)), starts

    def ask_windows(key, table, answers):
        chunk = key[0].as_py()
        known, bits = _shared_bits(table, scheme, parts, chunk, dict(zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True)))
        shared = known[bits]
        rows = question(chunk, *windows(table, shared)[:3], parts).rows
        return _table([*rows, (chunk, -1 - chunk, b"", pack_sorted(shared))], _ASK)  # the last goes through to the third pass

    def remove(key, table, answers):
        said = dict(zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        one, two, own, starts = windows(table, unpack_sorted(said[-1]))
        gone, out, done = question(key[0].as_py(), one, two, own, parts).verdicts(said, own), [], 0
        for (piece, _, texts), s in zip(_steps(table), starts, strict=True):
            s, done = s[gone[done : done + len(s)]], done + len(s)
            out.append(stripped(piece, texts, scheme.tokens(texts), s, s + WINDOW, scheme.left, scheme.left_type, digest, bool(carry)))
        return pa.concat_tables(out)

    schema = result_schema(docs, "string" if digest or scheme.left_type == pa.string() else "binary", carry)
    known = by_part(texts.groupBy("chunk").applyInArrow(grouped(ask_landmarks), ASK), parts).applyInArrow(grouped(answer_landmarks), ANSWER)
    told = by_part(texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(grouped(ask_windows), ASK), parts).applyInArrow(grouped(answer_windows), ANSWER)
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(grouped(remove), schema).withColumnRenamed("id", id_col)
