"""Array expressions: crops, padding, histograms, decoding of frames, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import uniform


def crop(streams: Column, start: Column, n: Column) -> Column:
    return F.transform(streams, lambda s: F.slice(s, start + 1, n))


def pad_to(values: Column, length: Column, fill) -> Column:
    """Right padding; an array that is longer is refused."""
    return F.when(F.size(values) <= length, F.concat(values, F.array_repeat(fill, length - F.size(values)))).otherwise(F.raise_error(F.lit("longer than its frames")))


def pad_mask(values: Column, length: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), length), lambda i: i <= F.size(values))


def tile(values: Column, times: Column) -> Column:
    return F.flatten(F.array_repeat(values, times))


def slice_wave(wave: Column, first_frame: Column, last_frame: Column, samples: int = 320) -> Column:
    """The samples of a half-open range of frames."""
    return F.slice(wave, first_frame * samples + 1, (last_frame - first_frame) * samples)


def pad_batch(df: DataFrame, batch: str, streams: str, fill: int) -> DataFrame:
    """``df`` with ``padded`` (each of a row's streams as long as the longest of its batch), ``mask`` and ``length``. The fill must be no code; rows of one batch have as many streams. Of a batch only two numbers are shuffled."""
    if fill >= 0:
        raise ValueError("the fill must be negative: codes begin at 0")
    length = F.coalesce(F.array_max(F.transform(streams, lambda s: F.size(s))), F.lit(0))
    shape = df.groupBy(batch).agg(F.max(length).alias("_n"), F.min(F.size(streams)).alias("_lo"), F.max(F.size(streams)).alias("_hi"))
    n = F.when(F.col("_lo") == F.col("_hi"), F.col("_n")).otherwise(F.raise_error(F.lit("unlike numbers of streams")).cast("int"))
    joined = df.join(shape, batch)
    padded = F.transform(streams, lambda s: F.concat(s, F.array_repeat(F.lit(fill), n - F.size(s))))
    return joined.select(*df.columns, padded.alias("padded"), F.transform(F.sequence(F.lit(1), n), lambda i: i <= length).alias("mask"), length.alias("length"))


def zero_ranges(values: Column, ranges: list[tuple[Column, Column]]) -> Column:
    """``values`` with 0 in each half-open range (start, width)."""
    def hit(i: Column) -> Column:
        out = F.lit(False)
        for start, width in ranges:
            out = out | ((i >= start) & (i < start + width))
        return out

    return F.transform(values, lambda x, i: F.when(hit(i), F.lit(0.0)).otherwise(x))


def spec_augment(frames: Column, key: Column, seed: str, channels: int, bands: int = 2, band_width: int = 12, spans: int = 2, span_share: float = 0.15) -> Column:
    """Frames (time by channels) with bands of channels at zero, the same for all rows of a seed, and spans of time, drawn for each row within its length."""
    if min(bands, spans) < 0 or not 0 <= span_share <= 1:
        raise ValueError("numbers of masks must not be negative, a share lies in [0, 1]")
    draw = lambda name, n, k: F.floor(uniform(f"{seed}|{name}", k) * (n + 1))
    wide = [draw(f"band{b}", F.lit(min(band_width, channels)), F.lit("all")) for b in range(bands)]
    channel = [(draw(f"from{b}", F.lit(channels) - w, F.lit("all")), w) for b, w in enumerate(wide)]
    n = F.size(frames)
    long = [draw(f"span{b}", F.floor(n * span_share), key) for b in range(spans)]
    time = [(draw(f"at{b}", n - w, key), w) for b, w in enumerate(long)]

    def masked(f: Column, t: Column) -> Column:
        out = F.lit(False)
        for start, width in time:
            out = out | ((t >= start) & (t < start + width))
        return F.when(out, F.transform(f, lambda x: F.lit(0.0))).otherwise(zero_ranges(f, channel))

    return F.transform(frames, masked)


def out_of_range(codes: Column, top: int) -> Column:
    return F.exists(codes, lambda c: (c < 0) | (c >= top))


def in_range(codes: Column, top: int) -> Column:
    """The codes; one that no codebook of ``top`` entries has is an error."""
    return F.when(out_of_range(codes, top), F.raise_error(F.lit("code out of range")).cast("array<int>")).otherwise(codes)


def bigrams(codes: Column) -> Column:
    """Pairs of neighbours; none for fewer than two codes."""
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(F.size(codes) > 1, pairs).otherwise(F.filter(F.transform(codes, lambda c: F.struct(c.alias("a"), c.alias("b"))), lambda _: F.lit(False)))


def run_ends(s: Column) -> Column:
    """Array of (value, end) of the runs of equal neighbours in an ascending array. ``s`` is read for each element, so it must be a column, not an expression."""
    return F.filter(F.transform(s, lambda x, i: F.struct(x.alias("value"), (i + 1).alias("end"))), lambda r: F.coalesce(F.get(s, r["end"]) != r["value"], F.lit(True)))


def run_lengths(ends: Column) -> Column:
    """Array of (value, n) from (value, end): where nothing is shuffled, the row itself counts its values."""
    before = F.slice(F.concat(F.array(F.lit(0)), F.transform(ends, lambda r: r["end"])), F.lit(1), F.size(ends))
    return F.zip_with(ends, before, lambda r, b: F.struct(r["value"].alias("value"), (r["end"] - b).alias("n")))


def histogram(df: DataFrame, key: str, codes: str, codebook: int | None = None) -> DataFrame:
    """(key, code, n, share): share of each code, all shares of a key sum to 1. With ``codebook`` other codes are an error."""
    values = in_range(F.col(codes), codebook) if codebook else F.col(codes)
    rows = df.select(key, F.size(codes).alias("_t"), F.sort_array(values).alias("_s")).select(key, "_t", run_ends(F.col("_s")).alias("_e"))
    return rows.select(key, "_t", F.explode(run_lengths(F.col("_e"))).alias("r")).select(key, F.col("r.value").alias("code"), F.col("r.n").cast("bigint").alias("n"), (F.col("r.n") / F.col("_t")).alias("share"))


def entropy(df: DataFrame, key: str, codes: str) -> DataFrame:
    """(key, entropy) in bits of rows with codes, as log2 t - sum(n log2 n) / t."""
    rows = df.filter(F.size(codes) > 0).select(key, F.size(codes).alias("_t"), F.sort_array(codes).alias("_s")).select(key, "_t", run_ends(F.col("_s")).alias("_e"))
    weighted = F.aggregate(run_lengths(F.col("_e")), F.lit(0.0), lambda a, r: F.when(r["n"] > 1, a + r["n"] * F.log2(r["n"].cast("double"))).otherwise(a))
    return rows.select(key, (F.log2(F.col("_t").cast("double")) - weighted / F.col("_t")).alias("entropy"))


def feature_lists(df: DataFrame, key: str, codes: str, codebook: int = 1024, buckets: int = 65536) -> DataFrame:
    """(key, f) of each row with codes: ascending (idx, val) of unigrams and hashed bigrams, equal mass for each block present, total 1."""
    n = F.size(codes)
    blocks = F.when(n > 1, 2).otherwise(1)
    pairs = F.transform(bigrams(F.col(codes)), lambda p: F.pmod(p["a"].cast("bigint") * 1009 + p["b"], F.lit(buckets)) + codebook)
    rows = df.filter(n > 0).select(key, (n * blocks).alias("_u"), ((n - 1) * blocks).alias("_b"), F.sort_array(F.transform(codes, lambda c: c.cast("bigint"))).alias("_s"), F.sort_array(pairs).alias("_p"))
    rows = rows.select(key, "_u", "_b", run_ends(F.col("_s")).alias("_s"), run_ends(F.col("_p")).alias("_p"))

    def weighed(c: str, w: str) -> Column:
        return F.transform(run_lengths(F.col(c)), lambda r: F.struct(r["value"].alias("idx"), (r["n"] / F.col(w)).alias("val")))

    return rows.select(key, F.concat(weighed("_s", "_u"), weighed("_p", "_b")).alias("f"))


def features(df: DataFrame, key: str, codes: str, codebook: int = 1024, buckets: int = 65536) -> DataFrame:
    """(key, idx, val): ``feature_lists``, a row for each feature."""
    return feature_lists(df, key, codes, codebook, buckets).select(key, F.explode("f").alias("f")).select(key, "f.idx", "f.val")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    return F.transform(a, lambda x: F.exp(x - top) / F.aggregate(a, F.lit(0.0), lambda s, y: s + F.exp(y - top)))


def masked_mean(values: Column, length: Column) -> Column:
    return F.aggregate(F.slice(values, F.lit(1), length), F.lit(0.0), lambda s, x: s + x) / F.greatest(length, F.lit(1))


def el2n(frames: Column, length: Column) -> Column:
    """Mean over valid frames of the distance between probabilities and the one-hot of their largest."""
    each = F.transform(frames, lambda f: F.sqrt(F.greatest(F.aggregate(f, F.lit(0.0), lambda s, p: s + p * p) - 2 * F.array_max(f) + 1, F.lit(0.0))))
    return masked_mean(each, length)


def greedy_ids(frames: Column, length: Column) -> Column:
    """The index of the largest entry of each valid frame; the first of equal ones."""
    return F.transform(F.slice(frames, F.lit(1), length), lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))
