"""Error rates and CTC loss."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The first of the characters that stand for words, and how many there are before the surrogates.
_FIRST, _MOST = 0x0100, 0xD700


def _coded(words: Column, names: Column) -> Column:
    """A string with one character for each word: its place among ``names``."""
    place = lambda w: F.lpad(F.hex(F.array_position(names, w) + (_FIRST - 1)), 4, "0")
    return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(place(w)), "UTF-16BE")), "")


def word_edits(ref: Column, hyp: Column) -> Column:
    """The edit distance of two arrays of words."""
    names = F.array_distinct(F.concat(ref, hyp))
    return F.when(F.size(names) <= _MOST, F.levenshtein(_coded(ref, names), _coded(hyp, names))).otherwise(F.raise_error(F.lit("too many different words")).cast("int"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def wer(ref: Column, hyp: Column) -> Column:
    """Word edits over reference words; null for a blank reference."""
    return F.when(F.size(words(ref)) > 0, word_edits(words(ref), words(hyp)) / F.size(words(ref)))


def cer(ref: Column, hyp: Column) -> Column:
    return F.when(F.trim(ref) != "", F.levenshtein(ref, hyp) / F.length(ref))


def char_accuracy(ref: Column, hyp: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - cer(ref, hyp))


def ctc(log_probs: np.ndarray, target: list[int], blank: int = 1) -> float:
    """Negative log likelihood of the target by the forward recursion; 0 where no alignment exists."""
    labels = np.full(2 * len(target) + 1, blank)
    labels[1::2] = target
    alpha = np.full(len(labels), -np.inf)
    if not len(log_probs):
        return 0.0
    alpha[:2] = log_probs[0, labels[:2]]
    skip = np.zeros(len(labels), bool)
    skip[2:] = (labels[2:] != blank) & (labels[2:] != labels[:-2])
    for frame in log_probs[1:]:
        one = np.concatenate(([-np.inf], alpha[:-1]))
        two = np.where(skip, np.concatenate(([-np.inf] * 2, alpha[:-2]))[: len(labels)], -np.inf)
        alpha = np.logaddexp(np.logaddexp(alpha, one), two) + frame[labels]
    loss = -np.logaddexp.reduce(alpha[-2:])
    return float(loss) if np.isfinite(loss) else 0.0


def ctc_losses(df: DataFrame, key: str, frames: str, length: str, target: str, carry: list[str] | None = None) -> DataFrame:
    """(key, loss[, carried columns]): CTC loss of each row's probabilities (frames by classes) for its target ids."""
    carry, kinds = carry or [], dict(df.dtypes)

    def run(batches):
        for b in batches:
            with np.errstate(divide="ignore"):
                loss = [ctc(np.log(np.array([np.asarray(x, float) for x in f[: int(n)]])), list(t)) for f, n, t in zip(b[frames], b[length], b[target])]
            yield pd.DataFrame({key: b[key], "loss": loss} | {c: b[c] for c in carry})

    schema = ", ".join([f"`{key}` {kinds[key]}", "loss double", *(f"`{c}` {kinds[c]}" for c in carry)])
    return df.select(key, frames, length, target, *carry).mapInPandas(run, schema)
