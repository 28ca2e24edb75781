"""SimHash near duplicates with vantage-point trees.

A bounded sample of the distinct fingerprints (``SAMPLE``) chooses the vantage points of
a tree whose leaves are the shards; it only shapes the tree, every fingerprint is routed
through it. At a vantage point p with median distance m a fingerprint x goes inside if
d(x, p) <= m + ceil(r / 2) and outside if d(x, p) > m - r + ceil(r / 2): by the triangle
bound any two within r of each other share a side, so both get to some shard together.
A shard goes on splitting in the same way until its pieces are small, then compares all
pairs of a piece. It emits a spanning forest, not pairs: at most one edge for each
fingerprint and shard. Components come from components.py.

Edge cases: a null text counts as empty and has fingerprint zero; equal fingerprints are
one point, so copies cost nothing; rows with a null id get the component's smallest id,
which is null only if no row of it has an id; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import grouped, keep, mapped, mix64, pack, pack_sorted, partitions, slices, text_or_empty, unpack, unpack_sorted
from .components import components

SAMPLE = 20_000
#: Shards: at least and at most so many for parallel work, and more where one would hold over SHARD_POINTS.
#: Every level of the tree sends some points to both sides, so more shards than that cost more than they give.
MIN_SHARDS, MAX_SHARDS, SHARD_POINTS = 16, 64, 1 << 20
#: Fingerprints up to which a piece of a shard is compared pair by pair.
PIECE = 1024
#: Ids up to which a list of them may be broadcast.
BROADCAST_IDS = 200_000
#: Documents of the sample that says which shingles are common, in how many of them such a one is, and how many are told.
COMMON_SAMPLE, COMMON, COMMON_MOST = 8192, 3, 1 << 20
#: Prefix shingles of one part.
PART_KEYS = 500_000
_STEP = 1 << 20
_PAIR_ROWS, _ROWS_AT_ONCE = 512, 64


def fingerprints(texts: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is set if set in over half of the shingles' XXH64."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.lower().split()
        if not words:
            continue
        text = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
        ends = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
        counts[i] = len(ends)
        hashes += [digest(text[a:b], seed) for a, b in zip(starts, ends, strict=False)]
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.cumsum(counts[some]) - counts[some]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(np.diff(np.frombuffer(b.column(1).buffers()[1], np.int32, len(b) + 1, b.column(1).offset * 4)), _STEP):
                fp = fingerprints(b.column(1)[i:j].to_pylist(), shingle)
                yield pa.record_batch([b.column(0)[i:j], pa.array(fp.view(np.int64))], names=["id", "fp"])

    return mapped(docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).cast("binary").alias("text")), run, "id bigint, fp bigint")


def distance(x: np.ndarray, p) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(p)).astype(np.int16)


def _sides(d: np.ndarray, m: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    up = (r + 1) // 2
    return d <= m + up, d > m - r + up


def _split(points: np.ndarray, r: int, rng: np.random.Generator, tries: int = 8) -> tuple[int, int] | None:
    """The vantage point and distance that leave the least work: None if no split helps."""
    best, at = 0.97 * float(len(points)) ** 2, None
    for p in rng.choice(points, min(tries, len(points)), replace=False):
        d = distance(points, p)
        for m in {int(np.median(d)), r, 2 * r}:
            inside, outside = _sides(d, m, r)
            cost = float(inside.sum()) ** 2 + float(outside.sum()) ** 2
            if cost < best:
                best, at = cost, (int(p), m)
    return at


class Tree:
    """Vantage points and radii, as nested tuples (point, distance, inside, outside); a leaf is its number."""

    def __init__(self, sample: np.ndarray, leaves: int, r: int, seed: int = 1):
        self.r, self.leaves = r, 0
        depth = max(0, leaves - 1).bit_length()
        self.root = self._grow(sample, depth, np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, depth: int, rng: np.random.Generator):
        at = _split(points, self.r, rng) if depth and len(points) > 8 else None
        if at is None:
            self.leaves += 1
            return self.leaves - 1
        inside, outside = _sides(distance(points, at[0]), at[1], self.r)
        return (*at, self._grow(points[inside], depth - 1, rng), self._grow(points[outside], depth - 1, rng))

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, leaf) of each point in each shard that its ball touches."""
        found: list[tuple[np.ndarray, int]] = []
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, int):
                found.append((at, node))
            elif len(at):
                inside, outside = _sides(distance(points[at], node[0]), node[1], self.r)
                stack += [(node[2], at[inside]), (node[3], at[outside])]
        return np.concatenate([a for a, _ in found]), np.concatenate([np.full(len(a), n) for a, n in found])


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Join what the pairs (i, j) link in ``root`` (each point's smallest known companion); the pairs that did so."""
    used = []
    while True:
        p, q = root[i], root[j]
        open_ = np.flatnonzero(p != q)
        if not len(open_):
            return used
        i, j = i[open_], j[open_]
        high, low = np.maximum(p[open_], q[open_]), np.minimum(p[open_], q[open_])
        roots, first = np.unique(high, return_index=True)  # each root hangs under a smaller one: no cycles
        root[roots] = low[first]
        used.append(np.stack([i[first], j[first]], 1))
        while (root[root] != root).any():
            root[:] = root[root]


def forest(points: np.ndarray, r: int, seed: int = 2) -> np.ndarray:
    """Pairs of indices of distinct points within r bits that connect what all such pairs connect, without cycles."""
    root, rng = np.arange(len(points)), np.random.default_rng(seed)
    stack, found = [np.arange(len(points))], [np.empty((0, 2), np.int64)]
    while stack:
        at = stack.pop()
        split = _split(points[at], r, rng, 4) if len(at) > PIECE else None
        if split is not None:
            inside, outside = _sides(distance(points[at], split[0]), split[1], r)
            stack += [at[inside], at[outside]]
            continue
        x = points[at]
        for a in range(0, len(x), 128):
            i, j = np.nonzero(np.bitwise_count(x[a : a + 128, None] ^ x[None, a:]) <= r)
            later = j > i
            found += _joined(root, at[a + i[later]], at[a + j[later]])
    return np.concatenate(found)


def near_pairs_forest(points: DataFrame, r: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of column ``fp`` that connect them exactly as all pairs within r bits would."""
    spark = points.sparkSession
    ship(spark)
    n = points.count()
    sample = np.array([x.fp for x in points.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    shards = max(min(MAX_SHARDS, max(MIN_SHARDS, partitions(spark))), -(-n // SHARD_POINTS))
    tree = Tree(sample, shards, r)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column(0))
            at, leaf = tree.route(fp.view(np.uint64))
            yield pa.record_batch([pa.array(leaf, pa.int32()), pa.array(fp[at])], names=["leaf", "fp"])

    def link(key, table):
        fp = np.sort(np.asarray(table.column("fp")))
        pairs = forest(fp.view(np.uint64), r, 2 + key[0].as_py())
        return pa.table({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]})

    return points.select("fp").mapInArrow(route, "leaf int, fp bigint").repartition(tree.leaves, "leaf").groupBy("leaf").applyInArrow(grouped(link), "a bigint, b bigint")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes, each chained from the hashes of its words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out + h[i : i + len(out)])
    return np.unique(out)


def _majority(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash of each set of hashes."""
    out, some = np.zeros(len(sets), np.uint64), [i for i, s in enumerate(sets) if len(s)]
    if some:
        n = np.array([len(sets[i]) for i in some])
        bits = np.unpackbits(np.concatenate([sets[i] for i in some]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def parity(s: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of them have it. As many bits as a power of two holds the set.

    Where two sets differ in k hashes their bits differ in at most k places, and halves of
    a longer one added (xor) are the shorter one.
    """
    size = max(64, 1 << max(len(s) - 1, 0).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_be_similar(p: bytes, q: bytes, n: int, m: int, similarity: float) -> bool:
    """False only where sets of n and m hashes with parities p and q cannot have the similarity."""
    if len(p) < len(q):
        p, q = q, p
    x = int.from_bytes(p, "little")
    for size in range(len(p).bit_length() - 1, len(q).bit_length() - 1, -1):
        half = 8 << (size - 1)
        x = (x >> half) ^ (x & ((1 << half) - 1))
    return (x ^ int.from_bytes(q, "little")).bit_count() <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6


def shingle_sets(docs: DataFrame, shingle: int, similarity: float = 1.0, common: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, d, n, shingles[, bits, fp]) of each row: hash of the text, digest of its set of shingles, their number, and the set (packed).

    With ``common``, in place of the set its prefix, and besides its parities and SimHash.
    Any two sets as similar as asked share a shingle of their prefixes, because the order
    (not in ``common`` first, then by place in it, then by hash) is one for all and a
    prefix leaves out less than such a set must share.
    """
    place = None if common is None else np.argsort(common)
    ascending = None if common is None else common[place]

    def prefix(s: np.ndarray) -> np.ndarray:
        n = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
        if not len(s) or not len(ascending):
            return s[:n]
        at = np.minimum(np.searchsorted(ascending, s), len(ascending) - 1)
        return np.sort(s[np.argsort(np.where(ascending[at] == s, place[at], -1), kind="stable")[:n]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in slices(np.asarray(pc.binary_length(whole.column(2))), _STEP):
                b = whole.slice(i, j - i)
                sets = [shingle_set(t, shingle) for t in b.column(2).to_pylist()]
                digests = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                kept = sets if common is None else map(prefix, sets)
                cols = [b.column(0), b.column(1), pa.array(digests), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(pack_sorted, kept)), pa.binary())]
                if common is not None:
                    cols += [pa.array(list(map(parity, sets)), pa.binary()), pa.array(_majority(sets).view(np.int64))]
                yield pa.record_batch(cols, names=["id", "t", "d", "n", "shingles", "bits", "fp"][: len(cols)])

    more = "" if common is None else ", bits binary, fp bigint"
    return mapped(docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("t"), text_or_empty(text_col).cast("binary").alias("text")), run, f"id bigint, t bigint, d bigint, n bigint, shingles binary{more}")


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that several documents of a bounded sample have, rarest first. They only shape the order of ``shingle_sets``; no shingle is left out for being common."""
    every = max(1, docs.count() // COMMON_SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.record_batch([pa.array(unpack_sorted(x).view(np.int64))], names=["h"])

    counted = mapped(shingle_sets(sample, shingle).select("shingles"), run, "h bigint").groupBy("h").count().filter(F.col("count") >= COMMON)
    rows = counted.orderBy(F.desc("count"), "h").limit(COMMON_MOST).toArrow()
    return np.asarray(rows.column("h").combine_chunks()).view(np.uint64)[::-1].copy()


def shared_shingles(marked: DataFrame, parts: int) -> DataFrame:
    """(key, d, n, next, next_n) of each prefix shingle of ``marked`` that two sets have: a row for each of its sets, with the one that follows by size."""

    def block(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        d, n = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
        keys, at = np.concatenate([h[2] for h in held]), np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        order = np.argsort(keys)
        keys, at = keys[order], at[order]
        part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
        rows = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            some, which = np.unique(at[a:b], return_inverse=True)
            rows.append((int(part[a]), pack_sorted(keys[a:b]), pack(which.astype(np.uint32)), pack(d[some]), pack(n[some])))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.record_batch([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "keys", "which", "d", "n"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for d, n, x in zip(*(b.column(c).to_pylist() for c in ("d", "n", "shingles")), strict=True):
                held.append((d, n, unpack_sorted(x)))
                size += len(held[-1][2])
                if size >= _STEP:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    def meet(key, table):
        keys, d, n = [], [], []
        for k, w, x, y in zip(*(table.column(c).to_pylist() for c in ("keys", "which", "d", "n")), strict=True):
            which = unpack(w, np.uint32)
            keys.append(unpack_sorted(k))
            d.append(unpack(x, np.int64)[which])
            n.append(unpack(y, np.int64)[which])
        keys, d, n = map(np.concatenate, (keys, d, n))
        _, times = np.unique(keys, return_counts=True)
        order = np.argsort(keys, kind="stable")
        order = order[np.repeat(times > 1, times)]
        keys, d, n = keys[order], d[order], n[order]
        order = np.lexsort((d, n, keys))
        keys, d, n = keys[order], d[order], n[order]
        fresh = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (d[1:] != d[:-1])]) if len(keys) else np.empty(0, np.int64)
        keys, d, n = keys[fresh], d[fresh], n[fresh]
        follows = np.r_[keys[1:] == keys[:-1], False] if len(keys) else np.empty(0, bool)
        ok = follows | np.r_[False, follows[:-1]] if len(keys) else follows
        cols = {"key": keys.view(np.int64), "d": d, "n": n}
        out = {c: pa.array(x[ok]) for c, x in cols.items()}
        out |= {c: pa.array(np.r_[x[1:], x[:1]][ok], mask=~follows[ok]) for c, x in (("next", d), ("next_n", n))}
        return pa.table(out)

    blocks = mapped(marked.select("d", "n", "shingles"), deal, "part bigint, keys binary, which binary, d binary, n binary")
    return blocks.repartition(parts, "part").groupBy("part").applyInArrow(grouped(meet), "key bigint, d bigint, n bigint, next bigint, next_n bigint")


def _words_of(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


_FAR = np.iinfo(np.int32).max


def _apart(one: np.ndarray, two: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """In how many places the parities of each two sets differ; _FAR where numbers or parities rule the similarity out."""
    if one.shape[1] < two.shape[1]:
        return _apart(two, one, m, n, similarity).T
    while one.shape[1] > two.shape[1]:
        half = one.shape[1] // 2
        one = one[:, :half] ^ one[:, half:]
    out = np.empty((len(n), len(m)), np.int32)
    for j in range(0, len(m), _PAIR_ROWS):
        apart = np.bitwise_count(one[:, None] ^ two[None, j : j + _PAIR_ROWS]).sum(2, dtype=np.int32)
        x, y = n[:, None], m[None, j : j + _PAIR_ROWS]
        ok = (apart <= (x + y) * (1 - similarity) / (1 + similarity) + 1e-6) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6)
        out[:, j : j + _PAIR_ROWS] = np.where(ok, apart, _FAR)
    return out


def _meeting(n: np.ndarray, root: np.ndarray, bits: list[bytes], similarity: float, nearest: bool) -> np.ndarray:
    """Pairs of positions in one key's list, of different roots, that may be similar; with ``nearest`` only the closest for each root."""
    size, found = np.array(list(map(len, bits))), [np.empty((0, 2), np.int64)]
    least, other = np.full(len(n), _FAR), np.zeros(len(n), np.int64)
    each = {k: np.flatnonzero(size == k) for k in np.unique(size).tolist()}
    parities = {k: np.frombuffer(b"".join([bits[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1) for k, at in each.items()}
    for k, one in each.items():
        for m in (k, 2 * k):  # sets of further sizes are too unlike in number
            two = each.get(m)
            for i in range(0, len(one) if two is not None else 0, _ROWS_AT_ONCE):
                p = one[i : i + _ROWS_AT_ONCE]
                apart = np.where(root[p, None] != root[None, two], _apart(parities[k][i : i + _ROWS_AT_ONCE], parities[m], n[p], n[two], similarity), _FAR)
                if not nearest:
                    x, y = np.nonzero(apart < _FAR)
                    found.append(np.stack([p[x], two[y]], 1))
                    continue
                for at, to, table in ((p, two, apart), (two, p, apart.T)):
                    best = table.argmin(1)
                    closer = table[np.arange(len(at)), best] < least[at]
                    least[at[closer]], other[at[closer]] = table[closer, best[closer]], to[best[closer]]
    if nearest:
        order = np.lexsort((np.arange(len(n)), least, root))
        first = order[np.r_[True, root[order][1:] != root[order][:-1]]]
        first = first[least[first] < _FAR]
        found.append(np.stack([first, other[first]], 1))
    return np.concatenate(found)


def pairs_across(shared: DataFrame, points: DataFrame, roots: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """(a, b): the distinct pairs of sets that have a key in common and no root, and whose numbers and parities allow the similarity; with ``nearest`` the closest of them for each key and root.

    Parities travel only with the sets of keys under which several roots meet, and pairs
    that they rule out are never rows: what is emitted is nearly the links. No list of a key is cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([*((c, pa.int64()) for c in ("key", "n", "d", "root")), ("bits", pa.binary())]))
        key, n, d, root = (np.asarray(table.column(c).combine_chunks()) for c in ("key", "n", "d", "root"))
        edges, found = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, int), [np.empty((0, 2), np.int64)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            ends = d[a + _meeting(n[a:b], root[a:b], table.column("bits").slice(a, b - a).to_pylist(), similarity, nearest)]
            found.append(np.sort(ends, axis=1))
            if len(found) > 1000:
                found = [np.unique(np.concatenate(found), axis=0)]
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    rooted = shared.select("key", "d", "n").join(roots, "d", "left").withColumn("root", F.coalesce("root", "d"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    met = rooted.join(mixed, "key", "left_semi").join(points.select("d", "bits"), "d")
    return mapped(met.select("key", "n", "d", "root", "bits").repartition("key").sortWithinPartitions("key"), run, "a bigint, b bigint").distinct()


def possible_pairs(pairs: DataFrame, points: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) of digests whose numbers and parities allow the similarity: nearly all others go here, at a hundred bytes a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [min(n, m) >= similarity * max(n, m) - 1e-6 and may_be_similar(p, q, n, m, similarity) for p, q, n, m in zip(*(b.column(c).to_pylist() for c in ("p", "q", "n", "m")), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, two = (points.select(F.col("d").alias(i), F.col("bits").alias(c), F.col("n").alias(k)) for i, c, k in (("a", "p", "n"), ("b", "q", "m")))
    return mapped(pairs.join(one, "a").join(two, "b").select("a", "b", "p", "q", "n", "m"), run, "a bigint, b bigint")


def similar_pairs(docs: DataFrame, pairs: DataFrame, points: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) of digests whose sets of shingles have a Jaccard similarity of at least ``similarity``; ``points`` names a document (least) for each digest."""
    wanted = keep(points.join(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct(), "d", "left_semi").select(F.col("d").alias("_d"), F.col("least.id").alias("_id")), "wanted")
    ids = wanted.select("_id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    sets = shingle_sets(docs.join(ids, F.col("doc_id") == F.col("_id"), "left_semi"), shingle)
    sets = keep(sets.join(wanted.select("_d"), F.col("d") == F.col("_d"), "left_semi").dropDuplicates(["d"]).select("d", "shingles"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for p, q in zip(b.column("p").to_pylist(), b.column("q").to_pylist(), strict=True):
                p, q = unpack_sorted(p), unpack_sorted(q)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common >= similarity * (len(p) + len(q) - common))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, two = (sets.select(F.col("d").alias(i), F.col("shingles").alias(c)) for i, c in (("a", "p"), ("b", "q")))
    return mapped(pairs.join(one, "a").join(two, "b").select("a", "b", "p", "q"), run, "a bigint, b bigint")


def fingerprint_pairs(points: DataFrame, r: int) -> DataFrame:
    """(a, b): pairs of digests to compare first. Sets of one fingerprint by its least digest, and what connects fingerprints within r bits."""
    heads = points.groupBy("fp").agg(F.min("d").alias("head"))
    same = points.join(heads, "fp").filter("d <> head").select(F.col("head").alias("a"), F.col("d").alias("b"))
    edges = near_pairs_forest(heads, r)
    one, two = (heads.select(F.col("fp").alias(f), F.col("head").alias(h)) for f, h in (("a", "x"), ("b", "y")))
    return same.union(edges.join(one, "a").join(two, "b").select(F.least("x", "y"), F.greatest("x", "y")))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, r: int = 4) -> DataFrame:
    """``docs`` with one document, the one with the smallest id, of each group of near duplicates.

    A vertex is a distinct set of shingles, and two are linked if their Jaccard similarity
    is as asked; nothing counts as a link before two whole sets have been compared. The
    vantage-point trees give the pairs that connect fingerprints within ``r`` bits, which
    join large groups with few comparisons. Similar sets whose fingerprints are further
    apart share a shingle of their prefixes (``shingle_sets``): each shingle's sets are
    compared along a chain by size, then each group's closest other one, then every pair
    that shares a shingle and is not joined yet. So components are those of all similar pairs.

    Edge cases: a null text counts as empty, and texts without words are one vertex; texts
    of any length are compared whole; a row with a null id stays and removes no other; a
    row goes by its id and text, so rows that repeat an id are judged each by its own
    text, and equal rows go or stay together; an empty table stays empty; further columns
    are handed through under any name.
    """
    spark = docs.sparkSession
    marked = keep(shingle_sets(docs, shingle, similarity, common_shingles(docs, shingle)), "shingles")
    named = marked.filter("id IS NOT NULL")
    points = keep(named.groupBy("d").agg(F.min(F.struct("id", "t")).alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fp").alias("fp")), "points")
    total = marked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = keep(shared_shingles(named, max(partitions(spark), int(total * (1 - similarity)) // PART_KEYS)), "shared")
    chain = shared.filter((F.col("next") != F.col("d")) & (F.col("n") >= similarity * F.col("next_n") - 1e-6)).select(F.least("d", "next").alias("a"), F.greatest("d", "next").alias("b"))
    first = keep(possible_pairs(fingerprint_pairs(points, r).union(chain).distinct(), points, similarity), "first")
    links, tried = keep(similar_pairs(docs, first, points, shingle, similarity), "links"), first
    for nearest in (True, False):
        roots = components(links, "a", "b").withColumnRenamed("node", "d")
        rest = keep(pairs_across(shared, points, roots, similarity, nearest).join(tried, ["a", "b"], "left_anti"), "rest")
        links, tried = links.union(keep(similar_pairs(docs, rest, points, shingle, similarity), "links")), tried.union(rest)
    grouped = points.join(components(links, "a", "b").withColumnRenamed("node", "d"), "d", "left").select("d", "least", F.coalesce("root", "d").alias("root"))
    stays = grouped.groupBy("root").agg(F.min("least").alias("stays"))
    labels = grouped.join(stays, "root").select("d", "stays")
    other = (F.col("id") != F.col("stays.id")) | (F.col("t") != F.col("stays.t"))
    gone = keep(named.join(labels, "d").filter(other).select(F.col("id").alias("_id"), F.col("t").alias("_t")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, (docs.doc_id == F.col("_id")) & (F.xxhash64(docs.text) == F.col("_t")), "left_anti")


def near_duplicates(docs: DataFrame, shingle: int = 5, r: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row: fingerprints within r bits are linked, component_id is the smallest id reachable."""
    marked = keep(with_fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    points = keep(marked.groupBy("fp").agg(F.min("id").alias("least")), "points")
    roots = components(near_pairs_forest(points, r), "a", "b")
    named = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(labels, F.col("fp") == F.col("_fp")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
