"""Waveform features over sample arrays, as native higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frame length and hop of the framed features, in samples.
FRAME_LENGTH = 2048
HOP_LENGTH = 512


def duration(samples: Column, rate: Column) -> Column:
    return F.array_size(samples) / rate


def adjacent_diff(values: Column) -> Column:
    """``v[i+1] - v[i]``; empty for fewer than two values."""
    n = F.greatest(F.array_size(values) - 1, F.lit(0))
    return F.zip_with(
        F.slice(values, F.lit(2), n), F.slice(values, F.lit(1), n), lambda after, before: after - before
    )


def _array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def zero_crossing_global(samples: Column) -> Column:
    """Mean ``|diff(sign)|`` over the clip: a full crossing counts 2. NULL below two samples."""
    signs = F.transform(samples, lambda v: F.signum(v.cast("double")))
    steps = F.transform(adjacent_diff(signs), F.abs)
    return F.when(F.array_size(samples) > 1, _array_sum(steps) / (F.array_size(samples) - 1))


def rms_global(samples: Column) -> Column:
    """Root mean square over the clip. NULL for an empty clip."""
    squares = F.transform(samples, lambda v: v.cast("double") * v.cast("double"))
    return F.when(F.array_size(samples) > 0, F.sqrt(_array_sum(squares) / F.array_size(samples)))


def frames(samples: Column, length: int = FRAME_LENGTH, hop: int = HOP_LENGTH) -> Column:
    """Overlapping full frames of a waveform; none when it is shorter than one frame."""
    count = F.floor((F.array_size(samples) - length) / hop) + 1
    starts = F.sequence(F.lit(0).cast("bigint"), count - 1)
    cut = F.transform(starts, lambda i: F.slice(samples, (i * hop + 1).cast("int"), F.lit(length)))
    return F.when(F.array_size(samples) >= length, cut).otherwise(F.slice(F.array(samples), 1, 0))


def frame_rms(frame: Column) -> Column:
    return rms_global(frame)


def frame_mean(
    samples: Column, feature: Callable[[Column], Column], length: int = FRAME_LENGTH, hop: int = HOP_LENGTH
) -> Column:
    """Mean of a per-frame feature over the full frames of a waveform, inside its row.

    One frame is cut at a time: neither the frames nor their rows are held, and nothing is shuffled. NULL
    when the waveform is shorter than one frame.
    """
    count = F.floor((F.array_size(samples) - length) / hop).cast("int") + 1
    starts = F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)
    total = F.aggregate(
        starts, F.lit(0.0), lambda sum_, i: sum_ + feature(F.slice(samples, i * hop + 1, F.lit(length)))
    )
    return F.when(F.array_size(samples) >= length, total / count)
