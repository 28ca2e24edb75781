"""BPE encoding and decoding in batched numpy merge rounds.

All new words of a batch become one flat symbol array. In each round every adjacent
pair is looked up by binary search in the sorted pair keys of the merge table, each word
picks its lowest rank, and the pairs of that rank are merged in all words at once.
Words that are done leave the array. A worker keeps the ids of words it has met
(a cache that is emptied when full, so it bounds memory and not the work).

Edge cases: null or empty texts give no ids; texts of any length are encoded whole;
repeated rows give repeated results; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import mapped, only, slices

_NEVER = np.iinfo(np.int32).max
#: Characters for which lower-casing and splitting need no Unicode tables: visible ASCII and Latin letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ɏ]+|[0-9]|[^\\sa-z0-9À-ɏ]+")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACES = "\x1c\x1d\x1e\x1f"  # str.split() takes these as white space, the tokenizer does not
_STOPS = frozenset(".,;:!?")
CACHE_WORDS = 1_000_000
BATCH_CHARS = 1 << 20


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Index(dict):
    """Number of each word; a word not met before gets the next one and is noted as new."""

    def __init__(self):
        self.new: list[str] = []
        self.known = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordBPE:
    """Encoder and decoder for a word-end BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self._normalize, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        end, chars = spec["model"]["end_of_word_suffix"] or "", _byte_chars()
        self._byte_of = {c: b for b, c in chars.items()}
        self._base = np.array([vocab[chars[b]] for b in range(256)] + [vocab[chars[b] + end] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in ((p[0] for p in pairs), (p[1] for p in pairs), (p[0] + p[1] for p in pairs)))
        n = max(max(vocab.values()), *self.special.values()) + 1 if self.special else max(vocab.values()) + 1
        # Pairs of ids below 2**16 are keys of 32 bits: half the memory to search.
        self._half, self._key = (16, np.uint32) if n <= 1 << 16 else (32, np.uint64)
        keys, order = np.unique(left << self._half | right, return_index=True)
        self._keys, self._rank, self._made = keys.astype(self._key), order.astype(np.int32), made[order].astype(np.int32)
        # A rank may be merged everywhere at once if no merge of the symbol that it makes comes before it.
        soonest = np.full(n, _NEVER)
        np.minimum.at(soonest, left, np.arange(len(left)))
        np.minimum.at(soonest, right, np.arange(len(right)))
        self._at_once = soonest[made] > np.arange(len(made))
        names: list[str] = [""] * n
        for t, i in (vocab | self.special).items():
            names[i] = t
        # The first round's pairs are of single bytes: looked up once for all.
        self._first_rank, self._first_made = (x.reshape(512, 512) for x in self._pairs(np.repeat(self._base, 512), np.tile(self._base, 512), np.repeat(np.arange(512) < 256, 512)))
        self._names = np.array([t.encode() for t in names], object)
        self._clear()

    def _clear(self) -> None:
        self._index = _Index()
        self._ids = np.empty(1 << 16, np.uint32)
        self._ends = np.zeros(1 << 12, np.int64)
        self._uses = np.zeros(1 << 12, np.int32)

    def _forget(self) -> None:
        """Keep the words met more than once, half a cache of them at most."""
        n = len(self._index)
        uses = self._uses[:n]
        stay = np.flatnonzero(uses > max(1, int(np.partition(uses, n // 2)[n // 2])))
        words = list(self._index)
        ids, ends = self._ids, self._ends
        self._clear()
        if len(stay):
            self._store([words[i] for i in stay.tolist()], np.concatenate([ids[ends[i] : ends[i + 1]] for i in stay.tolist()]), ends[stay + 1] - ends[stay])
            for i in stay.tolist():
                self._index[words[i]]
            self._index.new.clear()

    def _store(self, chunks: list[str], symbols: np.ndarray, counts: np.ndarray) -> None:
        known = self._index.known
        used = int(self._ends[known])
        while used + len(symbols) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
        while known + len(chunks) + 1 > len(self._ends):
            self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
            self._uses = np.concatenate([self._uses, np.zeros_like(self._uses)])
        self._ids[used : used + len(symbols)] = symbols
        self._ends[known + 1 : known + 1 + len(chunks)] = used + np.cumsum(counts)
        self._index.known = known + len(chunks)

    def merge(self, symbols: np.ndarray, words: np.ndarray, rank: np.ndarray | None = None, made: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols and their words, from the first symbols of all words (words ascending) and, where known, their pairs' ranks."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if rank is None and len(symbols):
            rank, made = self._pairs(symbols, np.r_[symbols[1:], 0], np.r_[words[1:] == words[:-1], False])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            low = np.minimum.reduceat(rank, starts)
            lowest = np.repeat(low, np.diff(np.r_[starts, len(words)]))
            active = lowest != _NEVER
            if not active.all():
                done.append((symbols[~active], words[~active]))
                symbols, words, rank, made, lowest = (x[active] for x in (symbols, words, rank, made, lowest))
                if not len(symbols):
                    break
            best = np.flatnonzero(rank == lowest)
            # Of overlapping equal pairs (aaa) every other one counts, from the left.
            run = np.r_[True, (np.diff(best) != 1)]
            first = np.maximum.accumulate(np.where(run, np.arange(len(best)), 0))
            best = best[(np.arange(len(best)) - first) % 2 == 0]
            leftmost = np.r_[True, words[best[1:]] != words[best[:-1]]]
            best = best[leftmost | self._at_once[rank[best]]]
            symbols[best] = made[best]
            stay = np.ones(len(symbols), bool)
            stay[best + 1] = False
            best = best - np.arange(len(best))
            symbols, words, rank, made = symbols[stay], words[stay], rank[stay], made[stay]
            # Only pairs with a new symbol have another rank than before.
            touched = np.zeros(len(symbols), bool)
            touched[best] = True
            touched[best[best > 0] - 1] = True
            fresh = np.flatnonzero(touched)
            after = np.minimum(fresh + 1, len(symbols) - 1)
            rank[fresh], made[fresh] = self._pairs(symbols[fresh], symbols[after], (after > fresh) & (words[after] == words[fresh]))
        if not done:
            return symbols, words
        symbols, words = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(words, kind="stable")
        return symbols[order], words[order]

    def _pairs(self, left: np.ndarray, right: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair, by binary search."""
        key = left.astype(self._key) << self._key(self._half) | right.astype(self._key)
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(inside & (self._keys[at] == key), self._rank[at], np.int32(_NEVER)), self._made[at]

    def _pieces(self, chunk: str) -> list[bytes | int]:
        """The words of a chunk without white space as bytes; special tokens as ids."""
        if "<|" in chunk:
            parts = self._special.split(chunk)
            if len(parts) > 1:
                return [x for p in parts if p for x in ([self.special[p]] if p in self.special else self._pieces(p))]
        if chunk.isascii() or _PLAIN.fullmatch(chunk):
            low = chunk.lower()
            if low.isalpha():
                return [low.encode()]
            if low[-1] in _STOPS and low[:-1].isalpha():
                return [low[:-1].encode(), low[-1].encode()]
            if chunk.isprintable():
                return [p.encode() for p in _PIECE.findall(low)]
        return [bytes(map(self._byte_of.__getitem__, p)) for p, _ in self._split(self._normalize(chunk))]

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks and append their ids to the cache."""
        words: list[bytes] = []
        counts: list[int] = []
        special: list[tuple[int, int]] = []
        for c in chunks:
            if c.isalpha() and c.isascii():
                words.append(c.lower().encode())
                counts.append(1)
                continue
            pieces = self._pieces(c)
            counts.append(len(pieces))
            for p in pieces:
                if isinstance(p, int):
                    special.append((len(words), p))
                    p = b"\0"
                words.append(p)
        if not words:
            return self._store(chunks, np.empty(0, np.int64), np.zeros(len(chunks), np.int64))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        last = np.cumsum(sizes) - 1
        kind = raw.astype(np.int64)
        kind[last] += 256
        rank, made = (t[kind, np.r_[kind[1:], 0]] for t in (self._first_rank, self._first_made))
        symbols, owner = self.merge(self._base[kind], np.repeat(np.arange(len(words), dtype=np.int32), sizes), rank, made)
        for i, token in special:
            symbols[np.searchsorted(owner, i)] = token
        size = np.bincount(owner, minlength=len(words))
        return self._store(chunks, symbols, np.diff(np.r_[0, np.cumsum(size)][np.cumsum(counts)], prepend=0))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array (uint32), and the number of ids of each text."""
        ids, counts = [], []
        for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), BATCH_CHARS):
            x, n = self._encode(texts[a:b])
            ids.append(x)
            counts.append(n)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = list(map(self._chunks, texts))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        if len(self._index) > CACHE_WORDS:
            self._forget()
        at = np.fromiter(map(self._index.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if self._index.new:
            self._learn(self._index.new)
            self._index.new = []
        np.add.at(self._uses, at, np.int32(1))
        first, counts = self._ends[at], self._ends[at + 1] - self._ends[at]
        total = np.cumsum(counts)
        n = int(total[-1]) if len(total) else 0
        ids = self._ids[np.repeat(first - (total - counts), counts) + np.arange(n)]
        upto = np.r_[0, total][np.cumsum(sizes)] if len(sizes) else np.empty(0, np.int64)
        return ids, np.diff(upto, prepend=0)

    @staticmethod
    def _chunks(text: str) -> list[str]:
        try:
            # Where each character has one lower-case form and nothing composes, case goes first: fewer different chunks.
            if "<|" not in text:
                text.encode("latin-1")
                text = text.lower()
        except UnicodeEncodeError:
            pass
        return list(filter(None, _SPACE.split(text))) if any(c in text for c in _ODD_SPACES) else text.split()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the token strings joined by spaces, as the library decodes without a decoder; special tokens stay."""
        return b" ".join(self._names[ids].tolist())


_loaded: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    """One encoder for each vocabulary and worker process."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids as little-endian uint32 bytes, decoded text) of every document; one map over the input, no shuffle."""
    return _mapped(docs, path, id_col, text_col, False)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return _mapped(docs, path, id_col, text_col, True)


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for a, b in slices(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), 4 * BATCH_CHARS):
                texts = [t or "" for t in batch.column(1)[a:b].to_pylist()]
                ids, counts = bpe.encode_batch(texts)
                ends = np.cumsum(counts)
                each = [ids[e - n : e] for e, n in zip(ends, counts, strict=True)]
                if digests:
                    out = [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each], pa.string()), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in each], pa.string())]
                else:
                    out = [pa.array([x.tobytes() for x in each], pa.binary()), pa.array([bpe.decode(x).decode() for x in each], pa.string())]
                yield pa.record_batch([batch.column(0)[a:b], pa.array(counts, pa.int64()), *out], names=names)

    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")
    return mapped(only(docs, id_col, text_col), run, schema)
