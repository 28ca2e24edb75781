"""Substring dedup by recompression, over words.

Rounds shorten every document's word string by naming: runs of two or three equal words,
then adjacent pairs (left, right), where a symbol's hash decides whether it is a left or a
right one. A name is a hash of what it stands for, so it is the same in every document and
no naming table has to be exchanged. Whether two symbols merge depends on these two alone,
so equal texts get the same symbols but for a few words at either end:

    round 1  runs and pairs up to 3 words   loses at most 3 + 2 words at an end
    round 2  pairs up to 5 words            4
    round 3  pairs up to 8 words            7

In a window of 50 words at least 50 - 2 * 16 = 18 words in the middle have the same
symbols wherever the window occurs. A landmark is a sequence of whole symbols of 8 or
more words, so at most 15: each window holds one, found in every copy of it. Landmarks
that two documents share reveal where to look, and windows are compared there (see repeats.py).

Edge cases: a null text has no words; words and texts of any length are compared whole;
an empty table gives an empty result; further columns are ignored under any name, or
handed through where ``carry`` names them; see ``remove_repeats`` for null and repeated ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import mix64
from .repeats import WINDOW, Scheme, Spans, Tokens, remove_repeats

#: Most words of a symbol after each round.
CAPS = (3, 5, 8)
LANDMARK_WORDS = 8
#: Words at either end of a window whose symbols may depend on what is beyond it.
LOST = 16
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Of eight bytes the first n.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes up to which words are named eight bytes at a time, all at once.
_LONG = 64


def _bounds(raw: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in texts that lie end to end; no word crosses a text's end."""
    inside = ~_SPACE[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[text_starts] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | fresh[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | fresh[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_names(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word raw[a:b]: one-to-one up to seven bytes, beyond that a chain of bijections of eight bytes each (xxh3 for long words)."""
    padded = np.r_[raw, np.zeros(8, np.uint8)]
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    size = b - a
    name = mix64((eight[a] & _FIRST[np.minimum(size, 7)]) | (np.minimum(size, 8).astype(np.uint64) << np.uint64(56)))
    at, done = np.flatnonzero(size > 7), 7
    while len(at) and done < _LONG:
        more = np.minimum(size[at] - done, 8)
        name[at] = mix64(name[at] * np.uint64(0x9FB21C651E98DF25) + (eight[a[at] + done] & _FIRST[more]))
        name[at] ^= size[at].astype(np.uint64) << np.uint64(40)
        done += 8
        at = at[size[at] > done]
    for i in at.tolist():
        name[i] = xxhash.xxh3_64_intdigest(raw[a[i] : b[i]].tobytes())
    return name


def words(texts: list[bytes]) -> Tokens:
    raw = np.frombuffer(b"".join(texts), np.uint8)
    text_starts = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))].astype(np.int64)
    if not len(raw):
        return Tokens(np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    a, b = _bounds(raw, text_starts)
    return Tokens(word_names(raw, a, b), np.searchsorted(a, text_starts))


def rounds(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Start and name of every symbol after all rounds; a symbol reaches to the next one's start."""
    n = len(tokens.values)
    name, start = tokens.values, np.arange(n)
    fresh = np.zeros(n + 1, bool)
    fresh[tokens.starts] = True
    for k, cap in enumerate(CAPS):
        if k == 0 and n:
            new = np.r_[True, (name[1:] != name[:-1]) | fresh[1:-1]]
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, n])
            short = size <= cap
            stay = new | ~np.repeat(short, size)
            name = name.copy()
            named = first[short & (size > 1)]
            name[named] = mix64(name[named] + np.uint64(0x632BE59BD9B4E019) * size[short & (size > 1)].astype(np.uint64))
            name, start = name[stay], start[stay]
        if len(name) < 2:
            break
        length = np.diff(np.r_[start, n])
        right = (mix64(name ^ np.uint64(0xA0761D6478BD642F + k)) >> np.uint64(63)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & ~fresh[start[1:]] & (length[:-1] + length[1:] <= cap))
        name = name.copy()
        name[pair] = mix64(name[pair] * np.uint64(0xE7037ED1A0B428DB) + mix64(name[pair + 1]) + np.uint64(k + 1))
        stay = np.ones(len(name), bool)
        stay[pair + 1] = False
        name, start = name[stay], start[stay]
    return start, name


def _sequences(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, key). From each symbol on, the shortest sequence of symbols with at least LANDMARK_WORDS words, named by its symbols."""
    start, name = rounds(tokens)
    n = len(tokens.values)
    bounds = np.r_[start, n]
    last = np.searchsorted(bounds, start + LANDMARK_WORDS)  # the symbol before which the sequence ends
    text_end = tokens.starts[np.searchsorted(tokens.starts, start, "right")] if len(start) else start
    ok = np.flatnonzero(last <= len(start))
    ok = ok[bounds[last[ok]] <= text_end[ok]]
    return start[ok], bounds[last[ok]], Spans(name)(ok, last[ok])


def landmarks(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    start, _, key = _sequences(tokens)
    return start, key


def possible(tokens: Tokens, shared) -> np.ndarray:
    """Windows with some shared landmark, and none in their middle that is not shared."""
    n = len(tokens.values)
    start, end, key = _sequences(tokens)
    if not len(start):
        return np.zeros(n - WINDOW + 1, bool)
    common = np.r_[0, np.cumsum(shared(key))]
    begun = np.zeros(n + 1, np.int64)  # landmarks that start before a position
    begun[1:] = np.cumsum(np.bincount(start, minlength=n)[:n])
    ended = np.cumsum(np.bincount(end, minlength=n + 1)[: n + 1])  # landmarks that end at or before a position
    some = common[np.maximum(ended[WINDOW:], begun[: n - WINDOW + 1])] > common[begun[: n - WINDOW + 1]]
    a = begun[LOST : n - WINDOW + LOST + 1]
    b = np.maximum(ended[WINDOW - LOST : n + 1 - LOST], a)
    return some & (common[b] - common[a] == b - a)


def left(text: bytes, covered: np.ndarray) -> str:
    """The words that stay, joined by one space."""
    if not len(covered):
        return ""
    raw = np.frombuffer(text, np.uint8)
    a, b = _bounds(raw, np.array([0, len(raw)]))
    return b" ".join([text[i:j] for i, j in zip(a[~covered].tolist(), b[~covered].tolist(), strict=True)]).decode()


SCHEME = Scheme(words, landmarks, possible, left, pa.string())


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, digest: bool = False) -> DataFrame:
    """(id, n_tokens, n_removed, n_spans, left): words covered by a 50-word window that an earlier document has are gone; ``left`` is text, or its sha256."""
    return remove_repeats(docs, SCHEME, id_col, text_col, carry or [], (lambda t: hashlib.sha256(t.encode()).hexdigest()) if digest else None)


