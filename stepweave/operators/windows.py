"""Event windows that slide to stay inside their episode, and the time templates anchored in them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def window_shift(center: Column, half: int, num_steps: Column) -> Column:
    """How far ``[center - half, center + half]`` slides to lie in ``[0, num_steps)``; null if it can't."""
    back = -F.greatest(center + half - (num_steps - 1), F.lit(0))
    return F.when(F.lit(2 * half) < num_steps, back + F.greatest(F.lit(0), -(center - half + back)))


def frame_window(center: Column, offsets: list[int], num_frames: Column) -> Column:
    """Frame indices for arbitrary offsets, slid in the same way; null if their span doesn't fit."""
    low, high = min(offsets), max(offsets)
    back = -F.greatest(center + high - (num_frames - 1), F.lit(0))
    shift = back + F.greatest(F.lit(0), -(center + low + back))
    return F.when(F.lit(high - low) < num_frames, F.array(*[center + o + shift for o in offsets]))


def fit_windows(events: DataFrame, half: int, center: str = "waypoint_step", num_steps: str = "num_steps") -> DataFrame:
    """Adds window_start, window_shift and event_idx; all null where the window can't fit."""
    shift = window_shift(F.col(center), half, F.col(num_steps))
    return events.withColumn("window_shift", shift).withColumns({"window_start": F.col(center) - half + F.col("window_shift"), "event_idx": half - F.col("window_shift")})


def window_steps(windows: DataFrame, half: int) -> DataFrame:
    """One row per window position (``pos``) and step; windows that don't fit give none."""
    fits = windows.filter(F.col("window_start").isNotNull())
    return fits.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(2 * half)))).withColumn("step", F.col("window_start") + F.col("pos"))


def template_rows(half: int) -> list[tuple[int, int, float | None, float | None]]:
    """(event_idx, pos, pulse, step_up) for all anchors; step_down is minus step_up. None: the template is constant."""
    size, out = 2 * half + 1, []

    def unit(x: list[float]) -> list[float | None]:
        mean = sum(x) / size
        centred = [v - mean for v in x]
        norm = math.sqrt(sum(v * v for v in centred))
        return [v / norm if norm > 1e-12 else None for v in centred]

    for anchor in range(size):
        pulse = unit([max(0.0, 1 - abs(p - anchor) / (half + 1)) for p in range(size)])
        up = unit([-1.0 if p < anchor else 1.0 for p in range(size)])
        out += [(anchor, p, pulse[p], up[p]) for p in range(size)]
    return out


def template_weights(spark: SparkSession, half: int) -> DataFrame:
    """The templates as a table of (2 * half + 1) ** 2 rows, fixed by ``half``."""
    return spark.createDataFrame(template_rows(half), "event_idx int, pos int, pulse double, step_up double")
