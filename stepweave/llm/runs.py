"""Runs of identical or nearly identical consecutive events.

Method: a state machine over the sorted events of each entity. It holds the
anchor of the open run, compares each event with it under a value and a gap
tolerance, and emits the run when an event falls outside. The anchor moves to
each accepted event: a run is a chain of neighbours.

Entities of any size are cut into segments of a fixed step range, which bounds
a segment's events, since each step counts once. The machine runs on single
segments and marks the runs that touch a segment's edge; these few are then
stitched along each entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a segment. At most this many events meet in one segment.
SEGMENT = 8192
RUN_COLUMNS = "run_id string, episode_num int, segment long, first_step long, last_step long, first_value double, last_value double, low double, high double, n_steps long, started timestamp_ntz, ended timestamp_ntz, at_start boolean, at_end boolean"


def counting_steps(records: DataFrame) -> DataFrame:
    """One row per (run_id, episode_num, step_in_episode): its row of latest logged_at, if gripper_action is a number there.

    Of rows tied on logged_at, the one of greatest (gripper_action, step_at)
    counts, NaN being greatest. Rows with a null in the key name no step and
    are left out; a null logged_at is earliest. Infinite actions are numbers.
    """
    r = records.select("run_id", "episode_num", "step_in_episode", F.struct("logged_at", "gripper_action", "step_at").alias("r"))
    r = r.filter(F.col("run_id").isNotNull() & F.col("episode_num").isNotNull() & F.col("step_in_episode").isNotNull())
    latest = r.groupBy("run_id", "episode_num", "step_in_episode").agg(F.max("r").alias("r"))
    value = F.col("r.gripper_action")
    return latest.filter(value.isNotNull() & ~F.isnan(value)).select("run_id", F.col("episode_num").cast("int").alias("episode_num"), F.col("step_in_episode").cast("long").alias("step"), value.cast("double").alias("value"), F.col("r.step_at").cast("timestamp_ntz").alias("at"))


def _close(step_gap, value_gap, max_gap: int, tolerance: float):
    return (step_gap <= max_gap) & (value_gap <= tolerance)


def _machine(max_gap: int, tolerance: float):
    schema = pa.schema(
        [("run_id", pa.string()), ("episode_num", pa.int32()), ("segment", pa.int64()), ("first_step", pa.int64()), ("last_step", pa.int64()), ("first_value", pa.float64()), ("last_value", pa.float64()), ("low", pa.float64()), ("high", pa.float64()), ("n_steps", pa.int64()), ("started", pa.timestamp("us")), ("ended", pa.timestamp("us")), ("at_start", pa.bool_()), ("at_end", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """State: the open run (one-row batch) and whether it touches its segment's start."""
        open_run: dict | None = None

        def emit(runs: list[dict] | dict[str, object]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(runs, schema=schema)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            step, value = b.column("step").to_numpy(), b.column("value").to_numpy()
            new_segment = np.ones(n, bool)
            if n > 1:
                same = None
                for name in ("run_id", "episode_num", "segment"):
                    c = b.column(name)
                    eq = pc.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                    same = eq if same is None else same & eq
                new_segment[1:] = ~same
            with np.errstate(invalid="ignore"):
                starts = new_segment.copy()
                starts[1:] |= ~_close(np.diff(step), np.abs(np.diff(value)), max_gap, tolerance)
                if open_run is not None:
                    here = all(b.column(k)[0].as_py() == open_run[k] for k in ("run_id", "episode_num", "segment"))
                    new_segment[0] = not here
                    starts[0] = not (here and _close(step[0] - open_run["last_step"], abs(value[0] - open_run["last_value"]), max_gap, tolerance))
            if open_run is not None and starts[0]:
                open_run["at_end"] = bool(new_segment[0])
                yield emit([open_run])
                open_run = None
            first = np.flatnonzero(starts)
            if not starts[0]:
                first = np.concatenate(([0], first))  # the head of the batch continues the open run
            last = np.append(first[1:], n) - 1
            low, high = np.minimum.reduceat(value, first), np.maximum.reduceat(value, first)
            at = b.column("at")
            ends_segment = np.append(new_segment[1:], False)
            cols = {
                "run_id": b.column("run_id").take(pa.array(first)),
                "episode_num": b.column("episode_num").take(pa.array(first)),
                "segment": b.column("segment").take(pa.array(first)),
                "first_step": pa.array(step[first]),
                "last_step": pa.array(step[last]),
                "first_value": pa.array(value[first]),
                "last_value": pa.array(value[last]),
                "low": pa.array(low),
                "high": pa.array(high),
                "n_steps": pa.array(last - first + 1),
                "started": at.take(pa.array(first)),
                "ended": at.take(pa.array(last)),
                "at_start": pa.array(new_segment[first]),
                "at_end": pa.array(ends_segment[last]),
            }
            made = pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in schema], schema=schema)
            if open_run is not None:
                head = made.slice(0, 1).to_pylist()[0]
                keep = {k: open_run[k] for k in ("first_step", "first_value", "started", "at_start")}
                keep |= {"low": min(open_run["low"], head["low"]), "high": max(open_run["high"], head["high"]), "n_steps": open_run["n_steps"] + head["n_steps"]}
                head |= keep
                if made.num_rows > 1:
                    yield emit([head])
                    made = made.slice(1)
                else:
                    open_run = head
                    continue
            if made.num_rows > 1:
                yield made.slice(0, made.num_rows - 1)
            open_run = made.slice(made.num_rows - 1).to_pylist()[0]
        if open_run is not None:
            open_run["at_end"] = True
            yield emit([open_run])

    return run


def collapse_runs(records: DataFrame, *, max_gap: int = 5, tolerance: float = 0.02, min_steps: int = 2, segment: int = SEGMENT) -> DataFrame:
    """Each run once: first and last step, number of steps, duration, range of its values.

    Two counting steps with none between them belong together if their steps
    differ by at most ``max_gap`` and their values by at most ``tolerance``.
    duration_s runs from the first to the last step's step_at, null if either is
    null. ``min_steps=1`` keeps single events, so that the result is the whole
    collapsed sequence. Repeated and older rows count as in
    :func:`counting_steps`; an empty table gives no runs.
    """
    if segment <= max_gap:
        raise ValueError("a segment must be longer than the gap tolerance")
    keys = ["run_id", "episode_num", "segment"]
    steps = counting_steps(records).withColumn("segment", F.floor(F.col("step") / segment).cast("long"))
    runs = steps.repartition(*keys).sortWithinPartitions(*keys, "step").mapInArrow(_machine(max_gap, tolerance), RUN_COLUMNS)
    edge = F.col("at_start") | F.col("at_end")
    runs = runs.filter(edge | (F.col("n_steps") >= min_steps))
    # Edge runs of an entity meet under one key, the others stay under their segment: no group grows with an entity's rows.
    w = Window.partitionBy("run_id", "episode_num", F.when(~edge, F.col("segment")), ~edge).orderBy("first_step")
    prev = lambda c: F.lag(c).over(w)
    joined = F.col("at_start") & prev("at_end") & (F.col("first_step") - prev("last_step") <= max_gap) & (F.abs(F.col("first_value") - prev("last_value")) <= tolerance)
    linked = runs.withColumn("fresh", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    chained = linked.withColumn("chain", F.sum("fresh").over(w))
    whole = chained.groupBy("run_id", "episode_num", F.when(~edge, F.col("segment")).alias("part"), (~edge).alias("inner"), "chain").agg(
        F.min("first_step").alias("first_step"),
        F.max("last_step").alias("last_step"),
        F.sum("n_steps").alias("n_steps"),
        F.min(F.struct("first_step", "started"))["started"].alias("started"),
        F.max(F.struct("last_step", "ended"))["ended"].alias("ended"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return whole.filter(F.col("n_steps") >= min_steps).select("run_id", "episode_num", F.col("first_step").cast("int").alias("first_step"), F.col("last_step").cast("int").alias("last_step"), "n_steps", seconds.alias("duration_s"), "low", "high")
