"""Streams of control steps: ordered aggregates and per-episode state machines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_steps(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 1) -> DataFrame:
    """A folder of parquet files as a stream, file by file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timestep_sums(values: DataFrame, keys: list[str]) -> DataFrame:
    """Running sums per time step and feature; a group may be split over any number of batches."""
    return values.groupBy(*keys, "feature").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_values"))


def windowed_counts(steps: DataFrame, time: str = "step_at", *, window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Steps per run and time window; rows later than the watermark are dropped."""
    t = steps.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return t.groupBy("run_id", F.window(time, window)).agg(F.count(F.lit(1)).alias("n_steps"))


def release_triggers(steps: DataFrame, *, stable_steps: int = 3, min_lift: float = 0.01, delay: int = 2) -> DataFrame:
    """The release trigger as a state machine per (run_id, episode_num), one row when it fires.

    State: z0, streak, eligible_since and the times of the open grasp, all of
    fixed size. Steps of an episode have to arrive in order across batches;
    inside a batch they are sorted. A step older than the last one seen is ignored.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z0, last, streak, since, grasp, stable, lift, fired = state.get if state.exists else (None, -1, 0, -1, -1, -1, -1, False)
        rows: list[dict[str, Any]] = []
        pdf = pd.concat(list(batches)).sort_values("step")
        for step, grasped, z in zip(pdf["step"], pdf["grasped"], pdf["z"], strict=True):
            if fired or step <= last:
                continue
            last = int(step)
            z0 = float(z) if z0 is None else z0
            lifted = z - z0 >= min_lift
            if grasped is True or grasped == True and grasped is not None:  # noqa: E712
                if streak == 0:
                    grasp, stable, lift = last, -1, -1
                streak += 1
                stable = last if streak >= stable_steps and stable < 0 else stable
                lift = last if lifted and lift < 0 else lift
            else:
                streak, since, grasp, stable, lift = 0, -1, -1, -1, -1
            if streak >= stable_steps and lifted:
                since = last if since < 0 else since
                if last - since >= delay:
                    fired = True
                    rows.append({"run_id": key[0], "episode_num": key[1], "trigger_step": last, "t_grasp": grasp, "t_stable_grasp": stable, "t_lift": lift})
            else:
                since = -1
        state.update((z0, last, streak, since, grasp, stable, lift, fired))
        yield pd.DataFrame(rows, columns=["run_id", "episode_num", "trigger_step", "t_grasp", "t_stable_grasp", "t_lift"])

    out = "run_id string, episode_num int, trigger_step int, t_grasp int, t_stable_grasp int, t_lift int"
    held = "z0 double, last int, streak int, since int, grasp int, stable int, lift int, fired boolean"
    return steps.select("run_id", "episode_num", "step", "grasped", "z").groupBy("run_id", "episode_num").applyInPandasWithState(advance, out, held, "append", GroupStateTimeout.NoTimeout)


def detachments(steps: DataFrame, *, confirm: int = 3) -> DataFrame:
    """The detach tracker as a state machine per (run_id, episode_num): one row when a detachment is confirmed.

    State of fixed size: last step, whether it was grasped, candidate and rows since. Steps arrive in order across batches.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, before, cand, n, done = state.get if state.exists else (-(1 << 31), False, -1, 0, False)
        rows: list[dict[str, Any]] = []
        pdf = pd.concat(list(batches)).sort_values("step")
        for step, grasped in zip(pdf["step"], pdf["grasped"], strict=True):
            if done or step <= last:
                continue
            last, on = int(step), grasped is not None and grasped == True  # noqa: E712
            if on:
                n = 0
            elif n or before:
                cand, n = (cand, n + 1) if n else (last, 1)
                if n == confirm:
                    done = True
                    rows.append({"run_id": key[0], "episode_num": key[1], "t_detach": cand, "t_detach_confirmed": last})
            before = on
        state.update((last, before, cand, n, done))
        yield pd.DataFrame(rows, columns=["run_id", "episode_num", "t_detach", "t_detach_confirmed"])

    out = "run_id string, episode_num int, t_detach int, t_detach_confirmed int"
    held = "last int, before boolean, cand int, n int, done boolean"
    return steps.select("run_id", "episode_num", "step", "grasped").groupBy("run_id", "episode_num").applyInPandasWithState(advance, out, held, "append", GroupStateTimeout.NoTimeout)


def ordered_sums(values: DataFrame, *, part: str = "run_id") -> DataFrame:
    """Sums per (episode, step) of rows that arrive in order; a group comes out once a later one begins.

    Each part holds one open group. A key smaller than the last one seen fails the stream: sums would be wrong.
    Inside a batch rows are in the order of ``row_id``. The last group stays open until more arrives.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        episode, step, total, n = state.get if state.exists else (-1, -1, 0.0, 0)
        rows: list[tuple] = []
        pdf = pd.concat(list(batches)).sort_values("row_id")
        change = (pdf["episode"] != pdf["episode"].shift()) | (pdf["step"] != pdf["step"].shift())
        for _, g in pdf.groupby(change.cumsum(), sort=True):
            e, s = int(g["episode"].iloc[0]), int(g["step"].iloc[0])
            if (e, s) < (episode, step):
                raise ValueError(f"{key[0]}: ({e}, {s}) comes after ({episode}, {step})")
            if (e, s) != (episode, step):
                if n:
                    rows.append((key[0], episode, step, total, n))
                episode, step, total, n = e, s, 0.0, 0
            total, n = total + float(g["value"].sum()), n + len(g)
        state.update((episode, step, total, n))
        yield pd.DataFrame(rows, columns=["part", "episode", "step", "total", "n_rows"])

    out = "part string, episode int, step int, total double, n_rows long"
    return values.select(part, "row_id", "episode", "step", "value").groupBy(part).applyInPandasWithState(advance, out, "episode int, step int, total double, n long", "append", GroupStateTimeout.NoTimeout)


def quota_stop(attempts: DataFrame, *, target_valid: int, target_primary: int, most: int) -> DataFrame:
    """Per task, the attempt at which collection stops: both targets are met, or the most attempts are made. One row a task."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, valid, primary, done = state.get if state.exists else (0, 0, 0, False)
        rows: list[tuple] = []
        for a in pd.concat(list(batches)).sort_values("attempt").itertuples(index=False):
            if done:
                break
            n, valid, primary = n + 1, valid + bool(a.valid), primary + bool(a.primary)
            met = valid >= target_valid and primary >= target_primary
            if met or n >= most:
                done = True
                rows.append((key[0], int(a.attempt), n, valid, primary, met))
        state.update((n, valid, primary, done))
        yield pd.DataFrame(rows, columns=["task_id", "stopped_at", "attempts", "valid", "primary", "reached"])

    out = "task_id int, stopped_at int, attempts int, valid int, primary int, reached boolean"
    return attempts.select("task_id", "attempt", "valid", "primary").groupBy("task_id").applyInPandasWithState(advance, out, "n int, valid int, primary int, done boolean", "append", GroupStateTimeout.NoTimeout)


def folded_moments(rows: DataFrame) -> DataFrame:
    """Sums per dimension over shards that arrive one by one; the state is one row a dimension. See :func:`stepweave.operators.activations.fidelity`."""
    x, r = F.col("x"), F.col("residual")
    return rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(r).alias("sr"), F.sum(x * x).alias("sxx"), F.sum(r * r).alias("srr"))


def keep_finished(steps: DataFrame, path: str, keep: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Write the steps of a stream once their episode is decided: ``keep`` names the episodes of a batch that stay.

    Every batch is one transaction: its folder carries the batch's number and replaces that of a failed try.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.join(keep(df), ["run_id", "episode_num"], "left_semi").write.mode("overwrite").parquet(f"{path}/batch={number}")

    steps.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_end(stream: DataFrame, name: str, *, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Process all that is there and return what came out, as a table in memory; for tests and small results."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "complete") -> DataFrame:
    """Process all that is there into a parquet table and return it. ``complete``: every batch replaces the table; ``append``: it adds to it.

    A batch that is run again after a failure replaces what it wrote before.
    """
    schema = stream.schema

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(path)
