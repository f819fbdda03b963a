"""Episodes as ordered step series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators.segments import with_neighbour

KEY = ["run_id", "episode_num"]


def latest_steps(records: DataFrame) -> DataFrame:
    """One row per (run_id, episode_num, step): its row of latest logged_at. Pre-aggregated map-side."""
    cols = [c for c in ("task_id", "task_episode_idx", "task_description", "eef_pos", "gripper_qpos", "gripper_action", "done", "step_at") if c in records.columns]
    rows = records.select(*KEY, F.col("step_in_episode").alias("step"), F.struct("logged_at", *cols).alias("r")).filter("run_id is not null and episode_num is not null and step is not null")
    latest = rows.groupBy(*KEY, "step").agg(F.max("r").alias("r"))
    return latest.select(*KEY, "step", *[F.col(f"r.{c}").alias(c) for c in cols])


def assemble(steps: DataFrame) -> DataFrame:
    """One row per episode: attributes of its first step, success of its last, and step counts."""
    first = lambda c: F.min_by(c, "step").alias(c)
    return steps.groupBy(*KEY).agg(
        first("task_id"),
        first("task_episode_idx"),
        first("task_description"),
        F.coalesce(F.max_by("done", "step"), F.lit(False)).alias("success"),
        F.count(F.lit(1)).alias("num_steps"),
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
        F.count_if(F.col("eef_pos").isNotNull()).alias("num_positions"),
        F.min("eef_pos").isNotNull().alias("has_position"),
        F.bool_and(F.col("gripper_qpos").isNotNull()).alias("has_gripper"),
    )


def assemble_vectors(steps: DataFrame, columns: list[str], *, segment: int = 8192) -> DataFrame:
    """Ordered vectors of each episode: KEY, ``segment`` and ``vectors``, structs of step and columns in the order of steps.

    An episode of any length comes out as rows of at most ``segment`` steps
    each, so that no list grows with it. Steps without the columns are left out.
    """
    s = steps.dropna(subset=columns).select(*KEY, F.floor(F.col("step") / segment).alias("segment"), F.struct("step", *columns).alias("v"))
    return s.groupBy(*KEY, "segment").agg(F.array_sort(F.collect_list("v")).alias("vectors"))


def filter_episodes(episodes: DataFrame, *, outcome: str = "all", task_description: str | None = None, limit: int | None = None) -> DataFrame:
    """Episodes with at least two positions, by outcome (all, success, failure) and exact task description; the first ``limit`` in order."""
    if outcome not in ("all", "success", "failure"):
        raise ValueError(outcome)
    e = episodes.filter(F.col("num_positions") >= 2)
    if outcome != "all":
        e = e.filter(F.col("success") == (outcome == "success"))
    if task_description is not None:
        e = e.filter(F.col("task_description") == task_description)
    return e if limit is None else e.orderBy("episode_num", "task_id", "task_episode_idx", "run_id").limit(limit)


def missing_inputs(steps: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The first n steps without ``column``: what a caller that requires it reports."""
    return steps.filter(F.col(column).isNull()).select(*KEY, "step").orderBy(*KEY, "step").limit(n)


def toggles(steps: DataFrame) -> DataFrame:
    """Steps whose gripper command differs from that of the following one. Only numeric actions count; the command is their sign."""
    s = steps.filter(F.col("gripper_action").isNotNull() & ~F.isnan("gripper_action"))
    s = s.withColumn("command", F.when(F.col("gripper_action") > 0, 1).otherwise(-1))
    n = with_neighbour(s, KEY, "step", ["command"], following=True, prefix="next_")
    return n.filter(F.col("next_command") != F.col("command")).select(*KEY, "step", "command", "next_step")


def contiguity(steps: DataFrame) -> DataFrame:
    """Are an episode's steps exactly 0 .. n - 1? Steps are unique, so three aggregates decide."""
    n = F.count(F.lit(1))
    return steps.groupBy(*KEY).agg(n.alias("num_steps"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), (F.max("step") - F.min("step") + 1 - n).alias("missing_steps"), ((F.min("step") == 0) & (F.max("step") == n - 1)).alias("contiguous"))


def step_velocity(steps: DataFrame, dt: float = 0.05) -> DataFrame:
    """Linear velocity of the end effector by finite difference with the previous step that is there."""
    p = with_neighbour(steps.filter(F.col("eef_pos").isNotNull()), KEY, "step", ["eef_pos"])
    seconds = (F.col("step") - F.col("prev_step")) * dt
    v = F.when(F.col("prev_eef_pos").isNotNull(), F.zip_with("eef_pos", "prev_eef_pos", lambda a, b: (a - b) / seconds))
    return p.select(*KEY, "step", "eef_pos", "prev_eef_pos", v.alias("velocity"), seconds.alias("seconds"))


def success_rates(episodes: DataFrame) -> DataFrame:
    """Episodes, successes and rate per task, and overall (null task)."""
    return episodes.rollup("task_id").agg(F.count(F.lit(1)).alias("episodes"), F.count_if("success").alias("successes"), (F.count_if("success") / F.count(F.lit(1))).alias("success_rate"))


def fewest_waypoints(p: np.ndarray, eta: float) -> list[int]:
    """Indices of the fewest waypoints, the last one included, between which straight lines stay within eta of all points.

    Shortest path over "can be one segment": each index keeps the smallest
    number of segments that reach it, and the earliest predecessor.
    """
    n = len(p)
    if n == 0:
        return []
    best, parent = np.full(n, np.iinfo(np.int64).max), np.zeros(n, int)
    best[0] = 0
    for j in range(1, n):
        for i in range(j):
            if best[i] + 1 >= best[j]:
                continue
            a, d = p[i], p[j] - p[i]
            inner = p[i + 1 : j] - a
            length = float(d @ d)
            t = np.clip(inner @ d / length, 0, 1)[:, None] if length > 0 else np.zeros((len(inner), 1))
            off = inner - t * d
            if len(inner) == 0 or float(np.max(np.einsum("ij,ij->i", off, off))) <= eta * eta:
                best[j], parent[j] = best[i] + 1, i
    out, j = [], n - 1
    while j > 0:
        out.append(j)
        j = int(parent[j])
    return out[::-1] or [0]


def keyframes(steps: DataFrame, *, eta: float = 0.05, block: int = 256) -> DataFrame:
    """Waypoint steps of each episode, by dynamic programming over its positions.

    Episodes are cut into blocks of ``block`` steps, which bounds the quadratic
    programme and the rows of a task's state; a block's last position is a
    waypoint. Steps without a full position are left out.
    """
    s = steps.filter(F.col("eef_pos").isNotNull() & (F.size("eef_pos") == 3) & ~F.exists("eef_pos", lambda x: x.isNull() | F.isnan(x)))
    s = s.select(*KEY, F.floor(F.col("step") / block).cast("int").alias("block"), "step", "eef_pos").repartition(*KEY, "block").sortWithinPartitions(*KEY, "block", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, steps_, points = None, [], []

        def done() -> pa.RecordBatch:
            w = fewest_waypoints(np.array(points, float), eta)
            return pa.RecordBatch.from_pydict({"run_id": [key[0]] * len(w), "episode_num": pa.array([key[1]] * len(w), pa.int32()), "step": pa.array([steps_[i] for i in w], pa.int32())})

        for b in batches:
            for r, e, k, st, pos in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if key != (r, e, k):
                    if key is not None:
                        yield done()
                    key, steps_, points = (r, e, k), [], []
                steps_.append(st)
                points.append(pos)
        if key is not None:
            yield done()

    return s.mapInArrow(run, "run_id string, episode_num int, step int")
