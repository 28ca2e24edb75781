"""Suffix-array dedup by prefix doubling, over UTF-8 bytes.

Positions are ranked by growing prefixes. A rank is a hash, so equal prefixes get equal
ranks in every partition, and a longer rank comes from the pair of ranks at a position and
at an offset. A position leaves as soon as it is unique, or decided.

    1, 2, 4, 8, 16 bytes   inside a chunk
    26 bytes (16 at offset 10)
        exchanged for a sample of positions that content alone chooses: a 50-byte string
        is represented by the least rank among its first 25 positions. Does another
        document have that rank? If not, the string is unique.
    runs   neighbouring strings with one representative, at most 25 of them (longer ones, of
        texts that repeat a few bytes, are cut), named by all
        their bytes (two polynomials modulo a prime at random points, see repeats.py). Exchanged: does a smaller document have the same run? Then all
        its strings are repeated. Is it the only run with its representative? Then nothing
        is left to compare.
    50 bytes
        exchanged for what remains: of each group of equal runs the smallest document's
        strings, where other runs have the same representative.

Ranking every position in every round would exchange some twenty bytes for each byte of
text in each round; here rounds two to four exchange a part of the text's size.

Edge cases: a null text is empty; matches never cross documents; null ids count as larger
than all others; rows with one id count as one document; texts of any length are compared
whole; an empty table gives an empty result; further columns are ignored under any name,
or handed through where ``carry`` names them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import grouped, mix64, pack, pack_sorted, unpack, unpack_sorted
from .repeats import _ANSWER, _ASK, ANSWER, ASK, WINDOW, Tokens, _distinct, _steps, _table, answer_windows, by_part, covered, dealt, is_in, joined, named, names, parted, question, random_points, result_schema, stripped

#: Bytes of the first exchanged rank.
PREFIX = 26
_SAMPLE = WINDOW - PREFIX + 1
_BLOCK = 1 << 18
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def positions(texts: list[bytes]) -> Tokens:
    return Tokens(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))].astype(np.int64))


def ranks(values: np.ndarray, length: int) -> np.ndarray:
    """The rank of each position by its next ``length`` tokens, by doubling; shorter by length - 1."""
    rank, have = values, 1
    while have < length:
        step = min(have, length - have)  # the last pair overlaps
        a, b = rank[: len(rank) - step], rank[step:]
        rank = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b * np.uint64(0x94D049BB133111EB)
        have += step
    return mix64(rank)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[: len(x) - step], x[step:])
        have += step
    return x


def runs(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, representative) of each run of neighbouring windows; none across texts."""
    n = len(tokens.values)
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    room = np.diff(tokens.starts)
    inside = covered(n, tokens.starts[:-1][room >= WINDOW], tokens.starts[1:][room >= WINDOW] - WINDOW + 1)[: n - WINDOW + 1]
    new = np.r_[True, inside[1:] != inside[:-1]]
    new[tokens.starts[:-1][tokens.starts[:-1] < len(new)]] = True
    # Block by block, so that long texts need no more than a few bytes for each of theirs.
    start, key, last = [], [], None
    for a in range(0, len(new), _BLOCK):
        least = _sliding(ranks(_BYTE[tokens.values[a : a + _BLOCK + WINDOW - 1]], PREFIX), _SAMPLE, np.minimum)
        here = new[a : a + _BLOCK]
        here[1:] |= least[1:] != least[:-1]
        here[:1] |= least[:1] != last
        last = least[-1]
        at = np.flatnonzero(here)
        start.append(at + a)
        key.append(least[at])
    start, key = np.concatenate(start), np.concatenate(key)
    size = np.diff(np.r_[start, len(new)])
    ok = inside[start]
    start, size, key = start[ok], size[ok], key[ok]
    pieces = -(-size // _SAMPLE)  # more than one only in texts of a short period
    skip = _SAMPLE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return np.repeat(start, pieces) + skip, np.minimum(np.repeat(size, pieces) - skip, _SAMPLE), np.repeat(key, pieces)


def left(text: bytes, covered: np.ndarray) -> bytes:
    return np.frombuffer(text, np.uint8)[~covered].tobytes() if covered.any() else text


def left_text(text: bytes, covered: np.ndarray) -> str:
    """The text without the covered bytes; a character of which a byte stays, stays whole."""
    if not covered.any():
        return text.decode()
    raw = np.frombuffer(text, np.uint8)
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    gone = np.repeat(np.minimum.reduceat(covered.view(np.uint8), first), np.diff(np.r_[first, len(raw)]))
    return raw[gone == 0].tobytes().decode()


def part_edges(parts: int) -> np.ndarray:
    """Where parts of the key space begin, by 32 leading bits, but for the first: each gets as many representatives.

    A representative is the least of 25 ranks, so small ranks are frequent (the smallest
    13 times as frequent as the mean). A rank x in [0, 1) is one with the chance that fewer
    than two of 25 others are smaller on either side: (1 - x)**25 + 25 x (1 - x)**24.
    """
    w, x = _SAMPLE, np.linspace(0, 1, (1 << 20) + 1)
    upto = 1 - (1 - x) ** (w + 1) - (w + 1) / 2 * x * (1 - x) ** w
    return (np.interp(np.arange(1, parts) / parts, upto, x) * 2**32).astype(np.uint64)


def _part(keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The part of each key; ascending keys lie part by part."""
    return np.searchsorted(edges, keys >> np.uint64(32), "right")


def _said(answers: pa.Table) -> dict[int, bytes]:
    return dict(zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True))


def _bits(data: bytes, n: int, fields: int = 1) -> list[np.ndarray]:
    size = -(-n // 8)
    return [np.unpackbits(np.frombuffer(data, np.uint8, size, k * size), count=n).astype(bool) for k in range(fields)]


class Chunk:
    """The texts of one chunk with their runs, and what the corpus has said about them."""

    def __init__(self, table: pa.Table, edges: np.ndarray, bits: int, points: tuple[int, int]):
        self.edges, self.drop, self.points = edges, np.uint64(64 - bits), points
        self.steps = []
        for piece, ids, texts in _steps(table):
            tokens = positions(texts)
            start, size, key = runs(tokens)
            self.steps.append((piece, texts, start, size, key, ids[np.searchsorted(tokens.starts, start, "right") - 1]))

    def _all(self, column: int, kind) -> np.ndarray:
        return np.concatenate([np.empty(0, kind), *[s[column] for s in self.steps]])

    def representatives(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ranks (their leading bits) with the smallest and largest document."""
        return _distinct(self._all(4, np.uint64) >> self.drop, self._all(5, np.int64))

    def split(self, keys: np.ndarray, full_bits: bool) -> list[tuple[int, slice]]:
        part = _part(keys if full_bits else keys << self.drop, self.edges)
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
        return [(int(part[a]), slice(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def shared(self, said: dict[int, bytes]) -> np.ndarray:
        keys, _, _ = self.representatives()
        return np.concatenate([np.empty(0, np.uint64), *[keys[s][_bits(said[p], s.stop - s.start)[0]] for p, s in self.split(keys, False)]])

    def narrow(self, shared: np.ndarray) -> None:
        """Keep the runs whose representative is shared, with 32 bits of the representative and both names of the whole run."""
        steps = []
        for piece, texts, start, size, key, own in self.steps:
            at = np.flatnonzero(is_in(shared, key >> self.drop))
            start, size, key, own = start[at], size[at], key[at], own[at]
            steps.append((piece, texts, start, size, key >> np.uint64(32), own, *names(positions(texts).values, start, start + size + WINDOW - 1, self.points, small=True)))
        self.steps = steps

    def whole_runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct run, ascending, its representative, both names and the smallest document; and which of them each run is."""
        head, own, one, two = self._all(4, np.uint64), self._all(5, np.int64), self._all(6, np.uint64), self._all(7, np.uint64)
        order, first, place = named(head, one, two)
        low = np.minimum.reduceat(own[order], first) if len(first) else own
        at = order[first]
        return head[at], one[at], two[at], low, place

    def decide(self, said: dict[int, bytes]) -> None:
        """Replace each step's keys by the verdict: 1 a smaller document has the run, 2 its windows are still to be compared, 0 nothing has."""
        head, _, _, low, place = self.whole_runs()
        smaller, others = np.zeros(len(head), bool), np.zeros(len(head), bool)
        for p, s in self.split(head << np.uint64(32), True):
            smaller[s], others[s] = _bits(said[p], s.stop - s.start, 2)
        steps, done = [], 0
        for piece, texts, start, size, key, own, *_ in self.steps:
            at, done = place[done : done + len(key)], done + len(key)
            verdict = np.where(smaller[at] | (low[at] < own), 1, np.where(others[at], 2, 0)) if len(key) else np.empty(0, np.int64)
            steps.append((piece, texts, start, size, verdict, own))
        self.steps = steps

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Both names and the document of each window still to be compared, and the starts of each step's."""
        found, starts = [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))], []
        for _, texts, start, size, verdict, own in self.steps:
            at = np.flatnonzero(verdict == 2)
            total = np.cumsum(size[at])
            s = np.repeat(start[at] - (total - size[at]), size[at]) + np.arange(total[-1] if len(at) else 0)
            s = s.astype(np.int64)
            found.append((*names(positions(texts).values, s, s + WINDOW, self.points, small=True), np.repeat(own[at], size[at])))
            starts.append(s)
        return *map(np.concatenate, zip(*found, strict=True)), starts


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, digest: bool = False, as_text: bool = False) -> DataFrame:
    """(id, n_tokens, n_removed, n_spans, left[, rest]) of every row: bytes covered by a 50-byte string that an earlier document has are gone; ``left`` is bytes, text (whole characters) or the bytes' sha256; ``rest`` has the columns named in ``carry``."""
    carry = carry or []
    texts, parts, total = dealt(docs, id_col, text_col, carry)
    bits = min(64, max(40, int(total).bit_length() + 10))  # enough for few false meetings, which cost a comparison each
    points, part_starts = random_points(), part_edges(parts)
    left_of, left_type = (left_text, pa.string()) if as_text else (left, pa.binary())
    sha = (lambda b: hashlib.sha256(b.encode() if as_text else b).hexdigest()) if digest else None

    def ask_ranks(key, table):
        chunk = Chunk(table, part_starts, bits, points)
        keys, low, high = chunk.representatives()
        return _table([(key[0].as_py(), p, pack_sorted(keys[s]), np.packbits(high[s] > low[s]).tobytes()) for p, s in chunk.split(keys, False)], _ASK)

    def answer_ranks(key, table):
        asked = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
        several = [_bits(x, len(k))[0] for x, k in zip(table.column("extra").to_pylist(), asked, strict=True)]
        every, place, times = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        shared = ((times > 1) | (np.bincount(place, np.concatenate(several), len(every)) > 0))[place]
        return _table([(c, key[0].as_py(), np.packbits(b).tobytes()) for c, b in zip(table.column("chunk").to_pylist(), np.split(shared, np.cumsum(list(map(len, asked)))[:-1]), strict=True)], _ANSWER)

    def ask_runs(key, table, answers):
        chunk = Chunk(table, part_starts, bits, points)
        shared = chunk.shared(_said(answers))
        chunk.narrow(shared)
        head, one, two, low, _ = chunk.whole_runs()
        me = key[0].as_py()
        rows = [(me, p, pack_sorted(head[s]), joined(pack(low[s]), pack(one[s]), pack(two[s]))) for p, s in chunk.split(head << np.uint64(32), True)]
        return _table([*rows, (me, -1 - me, b"", pack_sorted(shared))], _ASK)

    def answer_runs(key, table):
        part = key[0].as_py()
        if part < 0:
            return answer_windows(key, table)
        asked = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
        low, one, two = zip(*map(parted, table.column("extra").to_pylist()), strict=True)
        head, ids, one, two = np.concatenate(asked), np.concatenate([unpack(x, np.int64) for x in low]), *(np.concatenate([unpack(x, np.uint64) for x in c]) for c in (one, two))
        order, first, place = named(head, one, two)
        least = np.minimum.reduceat(ids[order], first)[place]
        _, which, times = np.unique(head[order][first], return_inverse=True, return_counts=True)
        others = (times[which] > 1)[place]
        ends = np.cumsum(list(map(len, asked)))[:-1]
        return _table([(c, part, np.packbits(a).tobytes() + np.packbits(b).tobytes()) for c, a, b in zip(table.column("chunk").to_pylist(), np.split(least < ids, ends), np.split(others, ends), strict=True)], _ANSWER)

    def decided(table, answers):
        said = _said(answers)
        chunk = Chunk(table, part_starts, bits, points)
        chunk.narrow(unpack_sorted(said[-1]))
        return chunk, said

    def ask_windows(key, table, answers):
        chunk, said = decided(table, answers)
        verdicts = b"".join(said[p] for p, _ in chunk.split(chunk.whole_runs()[0] << np.uint64(32), True))
        chunk.decide(said)
        me = key[0].as_py()
        rows = question(me, *chunk.windows()[:3], parts).rows
        return _table([*rows, (me, -1 - me, b"", joined(said[-1], verdicts))], _ASK)

    def remove(key, table, answers):
        said = _said(answers)
        shared, memo = parted(said.pop(-1))
        chunk = Chunk(table, part_starts, bits, points)
        chunk.narrow(unpack_sorted(shared))
        verdicts, n = {}, 0
        for p, s in chunk.split(chunk.whole_runs()[0] << np.uint64(32), True):
            size = 2 * -(-(s.stop - s.start) // 8)
            verdicts[p], n = memo[n : n + size], n + size
        chunk.decide(verdicts)
        one, two, own, starts = chunk.windows()
        gone, out, done = question(key[0].as_py(), one, two, own, parts).verdicts(said, own), [], 0
        for (piece, texts, start, size, verdict, _), s in zip(chunk.steps, starts, strict=True):
            s, done = s[gone[done : done + len(s)]], done + len(s)
            full = np.flatnonzero(verdict == 1)
            ends = np.concatenate([s + WINDOW, start[full] + size[full] - 1 + WINDOW])
            out.append(stripped(piece, texts, positions(texts), np.concatenate([s, start[full]]), ends, left_of, left_type, sha, bool(carry)))
        return pa.concat_tables(out)

    def each(answers):
        return texts.groupBy("chunk").cogroup(answers.groupBy("chunk"))

    one = by_part(texts.groupBy("chunk").applyInArrow(grouped(ask_ranks), ASK), parts).applyInArrow(grouped(answer_ranks), ANSWER)
    two = by_part(each(one).applyInArrow(grouped(ask_runs), ASK), parts).applyInArrow(grouped(answer_runs), ANSWER)
    three = by_part(each(two).applyInArrow(grouped(ask_windows), ASK), parts).applyInArrow(grouped(answer_windows), ANSWER)
    return each(three).applyInArrow(grouped(remove), result_schema(docs, "string" if digest or as_text else "binary", carry)).withColumnRenamed("id", id_col)
