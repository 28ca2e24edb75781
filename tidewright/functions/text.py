"""Text expressions: normalisation, transcripts, names, vocabulary."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The names of numbers, the transcript format and the character vocabulary.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion", "sextillion", "septillion", "octillion", "nonillion", "decillion"]
TRANSCRIPT = r"(?s)^Text:\s+(.*?)\s*(?:\nConf:\s+(\d+))?\s*$"
ALPHABET = "abcdefghijklmnopqrstuvwxyz '"
PAD, BLANK = 0, 1
VOCABULARY = ["<pad>", "<blank>", *ALPHABET]


def cardinal(digits: str) -> str:
    """English words for a run of decimal digits, with "and" before a last part under one hundred."""
    n = int(digits)
    if n == 0:
        return ONES[0]
    groups = []
    while n:
        groups.append(n % 1000)
        n //= 1000
    if len(groups) > len(SCALES):
        return " ".join(ONES[int(d)] for d in digits)

    def below(k: int) -> str:
        hundreds, rest = divmod(k, 100)
        tail = ONES[rest] if rest < 20 else TENS[rest // 10] + (f" {ONES[rest % 10]}" if rest % 10 else "")
        return " and ".join(([f"{ONES[hundreds]} hundred"] if hundreds else []) + ([tail] if rest else []))

    words = [f"{below(g)} {SCALES[i]}".strip() for i, g in reversed(list(enumerate(groups))) if g]
    if len(words) > 1 and 0 < groups[0] < 100:
        return " ".join(words[:-1]) + " and " + words[-1]
    return " ".join(words)


@F.pandas_udf(StringType())
def spell_digits(text: pd.Series) -> pd.Series:
    """Each run of digits as words between spaces; null stays null."""
    return text.str.replace(r"\d+", lambda m: f" {cardinal(m.group())} ", regex=True)


def normalize_plain(text: Column) -> Column:
    """Lower case, only a-z and apostrophes, single spaces."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z'\s]+", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Canonical text: digits spelt out. Rows without digits never leave the JVM's values: Python gets null for them."""
    spelt = spell_digits(F.when(text.rlike(r"(?U)\d"), text))
    return normalize_plain(F.coalesce(spelt, text))


def is_valid(text: Column) -> Column:
    return F.length(text) > 0


def transcript_text(content: Column) -> Column:
    """The text of a transcript file; null if it is not one."""
    return F.when(content.rlike(TRANSCRIPT), F.regexp_extract(content, TRANSCRIPT, 1))


def transcript_conf(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, TRANSCRIPT, 2), F.lit("")).cast("int")


def numeric_order(stem: Column) -> list[Column]:
    """Sort keys: numeric names by number first, then the others by text."""
    number = stem.rlike(r"^\d+$")
    return [F.when(number, 0).otherwise(1), F.when(number, stem.cast("decimal(38,0)")), stem]


def seed_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"seed(\d+)", 1), F.lit("")).cast("bigint")


def epoch_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^ckpt_epoch(\d{4})\.ckpt$", 1), F.lit("")).cast("int")


def run_id_of(path: Column) -> Column:
    """parent/name of a path."""
    parts = F.split(path, "/")
    return F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))


def run_id(track: Column, stem: Column, seed: Column, job: Column, task: Column) -> Column:
    return F.format_string("%s/%s_seed%s_job%s_t%s", track, stem, seed.cast("string"), job.cast("string"), task.cast("string"))


def file_kind(path: Column) -> Column:
    return F.when(path.endswith(".tokens.pt"), "tokens").when(path.endswith(".txt"), "txt").when(path.endswith(".wav"), "wav").otherwise("other")


def relpath(video: Column, stem: Column, suffix: str) -> Column:
    """``video/stem.suffix``, or the bare stem where there is no video; stems with a slash or none are refused."""
    ok = (F.length(stem) > 0) & ~stem.contains("/")
    path = F.when(video == "", F.concat(stem, F.lit(suffix))).otherwise(F.concat(video, F.lit("/"), stem, F.lit(suffix)))
    return F.when(ok, path).otherwise(F.raise_error(F.concat(F.lit("bad stem: "), F.coalesce(stem, F.lit("null")))))


def encode_chars(text: Column) -> Column:
    """Ids of the vocabulary's characters; others are dropped."""
    return F.filter(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) + 1), lambda i: i > BLANK)


def decode_chars(ids: Column, collapse: bool = False) -> Column:
    """Characters of ids; with ``collapse`` as CTC output: repeats merge, pad and blank part them."""

    real = lambda x: ~x.isin(PAD, BLANK)
    if collapse:
        # Each id beside the one before it; the array is read twice a row, not once for each id.
        pairs = F.zip_with(ids, F.concat(F.array(F.lit(-1)), ids), lambda x, before: F.struct(x.alias("x"), before.alias("before")))
        kept = F.transform(F.filter(pairs, lambda p: p["x"].isNotNull() & real(p["x"]) & (p["x"] != p["before"])), lambda p: p["x"])
    else:
        kept = F.filter(ids, real)
    return F.array_join(F.transform(kept, lambda x: F.substring(F.lit(ALPHABET), x - 1, F.lit(1))), "")


def save_vocabulary(path: str, tokens: list[str]) -> None:
    Path(path).write_text(json.dumps({"tokens": tokens}, indent=2), encoding="utf-8")


def load_vocabulary(path: str) -> list[str]:
    """The tokens of a vocabulary file, which must begin with pad and blank."""
    tokens = json.loads(Path(path).read_text(encoding="utf-8"))["tokens"]
    if tokens[:2] != VOCABULARY[:2]:
        raise ValueError(f"{path} does not begin with {VOCABULARY[:2]}")
    return tokens


def utc_now() -> Column:
    """The time of the query in UTC, as ISO 8601."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
