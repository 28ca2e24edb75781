"""Numeric expressions: budgets, frames, calibration, hashes, uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The calibration polynomials (highest power first) and frame constants.
CALIBRATION = {"sig": (-0.08397278, 1.22083953, 0.0052439), "bak": (-0.13166888, 1.60915514, -0.39604546), "ovr": (-0.06766283, 1.11546468, 0.04602535)}
TOKENS_PER_SECOND, SAMPLES_PER_FRAME, SAMPLE_RATE = 50, 320, 16000
HOP_SECONDS, HOP_SAMPLES = 9.01, 144160


def budget(n: Column, fraction: float) -> Column:
    """Half up, never to even."""
    return F.floor(n * F.lit(fraction) + 0.5)


def duration(n_tokens: Column) -> Column:
    return F.round(n_tokens / TOKENS_PER_SECOND, 4)


def frames_for(samples: Column) -> Column:
    return F.ceil(samples / SAMPLES_PER_FRAME)


def sample_range(start: Column, end: Column) -> tuple[Column, Column]:
    """Samples of a half-open range of frames; an empty range is refused."""
    bad = F.raise_error(F.lit("empty window"))
    return F.when(end > start, start * SAMPLES_PER_FRAME).otherwise(bad), F.when(end > start, end * SAMPLES_PER_FRAME).otherwise(bad)


def calibrate(raw: Column, channel: str) -> Column:
    a, b, c = CALIBRATION[channel]
    return a * raw * raw + b * raw + c


def softplus_loss(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z


def bigram_bucket(a: Column, b: Column, buckets: int = 65536) -> Column:
    return F.pmod(a * 1009 + b, F.lit(buckets))


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key alone: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rademacher(seed: str, key: Column, dims: int) -> Column:
    return F.when(uniform(seed, key) < 0.5, F.lit(1.0)).otherwise(F.lit(-1.0)) / F.sqrt(F.lit(float(dims)))


def no_nan(x: Column) -> Column:
    """NaN as null: missing values are skipped by aggregates and sorted last."""
    return F.nanvl(x, F.lit(None).cast("double"))


def learning_rate(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, linear decay, never below 1e-8."""
    warmup = min(warmup, max(total - 1, 0))
    return F.when(step < warmup, (step + 1) / F.lit(float(max(warmup, 1)))).otherwise(F.greatest((F.lit(total) - step) / F.lit(float(max(total - warmup, 1))), F.lit(1e-8)))


def hop_count(samples: Column) -> Column:
    """Planned hops of a clip that is long enough; truncated, not floored."""
    return (F.floor(samples / SAMPLE_RATE) - F.lit(HOP_SECONDS)).cast("int") + 1


def tiled_length(samples: Column) -> Column:
    """The length after doubling until a hop fits."""
    doublings = F.greatest(F.ceil(F.log2(F.lit(float(HOP_SAMPLES)) / samples)), F.lit(0))
    return (samples * F.pow(F.lit(2.0), doublings)).cast("bigint")


def effective_hops(samples: Column) -> Column:
    """Hops whose segment is whole: in doubles the end of some hops is one sample short, and these are skipped."""
    ends = F.transform(F.sequence(F.lit(0), F.greatest(hop_count(samples) - 1, F.lit(0))), lambda i: F.least(((i + F.lit(HOP_SECONDS)) * SAMPLE_RATE).cast("bigint"), samples) - i * SAMPLE_RATE)
    return F.size(F.filter(ends, lambda n: n >= HOP_SAMPLES))
