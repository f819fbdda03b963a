"""Sparse activations: rows of (feature ids, values) that stand for control steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.segments import global_rank, with_neighbour

MAPPINGS = ("inference_step", "action_executed", "chunk_executed")


def default_mapping(capture_target: str | None) -> str:
    return {"action_expert": "action_executed", "paligemma": "chunk_executed"}.get(capture_target or "", "inference_step")


def effective_steps(mapping: str) -> Column:
    """The control steps a row stands for; -1 in the chunk columns means that there is no chunk."""
    start, length, token, step = (F.col(c) for c in ("chunk_start_step", "executed_chunk_len", "token_idx", "step_in_episode"))
    none = F.array().cast("array<bigint>")
    chunk = (start >= 0) & (length > 0)
    if mapping == "inference_step":
        return F.when(step >= 0, F.array(step)).otherwise(none)
    if mapping == "action_executed":
        return F.when(chunk & (token >= 0) & (token < length), F.array(start + token)).otherwise(none)
    if mapping == "chunk_executed":
        return F.when(chunk, F.sequence(start, start + length - 1)).otherwise(none)
    raise ValueError(f"unknown step mapping {mapping!r}")


def long_form(topk_rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, feature, value) per stored activation; pairs by position, null ids or values left out."""
    pairs = F.explode(F.arrays_zip(F.col("top_feature_ids").alias("feature"), F.col("top_feature_vals").alias("value")))
    flat = topk_rows.select(*keep, pairs.alias("p")).select(*keep, "p.feature", F.col("p.value").cast("double").alias("value"))
    return flat.filter(F.col("feature").isNotNull() & F.col("value").isNotNull())


def timestep_mean(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each feature over the rows of a time step. A row without the feature counts as 0.

    ``rows`` has one row per stored row (its keys), ``values`` one per (row,
    feature). Both are combined map-side; the join runs on time steps.
    """
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    s = values.groupBy(*keys, "feature").agg(F.sum("value").alias("total"))
    return s.join(n, keys).select(*keys, "feature", (F.col("total") / F.col("n_rows")).alias("x"))


def task_mean(means: DataFrame, timesteps: DataFrame) -> DataFrame:
    """Mean over the time steps of a task, each with equal weight. timesteps: distinct (task, time step) keys, with ``task``."""
    n = timesteps.groupBy("task").agg(F.count(F.lit(1)).alias("n_timesteps"))
    s = means.groupBy("task", "feature").agg(F.sum("x").alias("total"))
    return s.join(n, "task").select("task", "feature", (F.col("total") / F.col("n_timesteps")).alias("task_mean"), "n_timesteps")


def alive_features(values: DataFrame) -> DataFrame:
    """Features with a stored value above 0."""
    return values.filter((F.col("value") > 0) & ~F.isnan("value")).select("feature").distinct()


def expand_index(index: DataFrame) -> DataFrame:
    """A row for every activation row in [row_start, row_end), with its token and step; null episode and step become 0."""
    rows = index.filter(F.col("row_end") > F.col("row_start"))
    e = rows.withColumn("row_idx", F.explode(F.sequence(F.col("row_start"), F.col("row_end") - 1)))
    return e.withColumns({"token_idx": F.col("row_idx") - F.col("row_start"), "episode_num": F.coalesce("episode_num", F.lit(0)), "step_in_episode": F.coalesce("step_in_episode", F.lit(0))})


def interval_breaks(index: DataFrame, shard: list[str]) -> DataFrame:
    """Per shard: intervals, and how many of them neither start at 0 nor where another one ends.

    A self-join on the boundary, not an ordered window: shards of any size spread out.
    """
    d = index.select(*shard, "row_start", "row_end").distinct()
    ends = d.select(*shard, F.col("row_end").alias("row_start"), F.lit(1).alias("met")).distinct()
    j = d.join(ends, [*shard, "row_start"], "left")
    loose = (F.col("row_start") != 0) & F.col("met").isNull()
    return j.groupBy(*shard).agg(F.count(F.lit(1)).alias("intervals"), F.count_if(loose).alias("breaks"), F.max("row_end").alias("num_rows"))


def row_topk(vector: Column, k: int) -> Column:
    """The k greatest elements of a vector as structs (feature, value), ties to the smaller index; null elements left out."""
    pairs = F.transform(vector, lambda x, i: F.struct((-x.cast("double")).alias("down"), i.alias("feature")))
    best = F.slice(F.sort_array(F.filter(pairs, lambda p: p["down"].isNotNull())), 1, k)
    return F.transform(best, lambda p: F.struct(p["feature"].alias("feature"), (-p["down"]).alias("value")))


def fidelity_sums(rows: DataFrame) -> DataFrame:
    """One pass over (row, dim, x, residual): per dimension count, sums and sums of squares. Partial sums merge by adding."""
    return rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("residual").alias("sr"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("residual") * F.col("residual")).alias("srr"))


def fidelity(sums: DataFrame) -> DataFrame:
    """Explained variance and mean squared error from per-dimension sums."""
    var_x, var_r = F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")), F.sum(F.col("srr") - F.col("sr") * F.col("sr") / F.col("n"))
    return sums.agg(F.max("n").alias("num_rows"), (1 - var_r / var_x).alias("frac_variance_explained"), (F.sum("srr") / F.sum("n")).alias("reconstruction_mse"))


def shard_moments(rows: DataFrame) -> DataFrame:
    """Per (shard, dim): count, mean and M2 (sum of squared deviations), ready to be merged."""
    m = [F.count(F.lit(1)).alias("n")]
    for c in ("x", "residual"):
        m += [F.avg(c).alias(f"mean_{c}"), (F.var_pop(c) * F.count(c)).alias(f"m2_{c}")]
    return rows.groupBy("shard", "dim").agg(*m)


def merge_moments(moments: DataFrame) -> DataFrame:
    """Moments of all shards together, by the rule for merging means and M2."""
    out = [F.sum("n").alias("n")]
    for c in ("x", "residual"):
        n, mean = F.col("n"), F.col(f"mean_{c}")
        total = F.sum(n * mean)
        out += [(total / F.sum("n")).alias(f"mean_{c}"), (F.sum(F.col(f"m2_{c}")) + F.sum(n * mean * mean) - total * total / F.sum("n")).alias(f"m2_{c}")]
    return moments.groupBy("dim").agg(*out)


def row_step() -> Column:
    """The step a stored row stands for: that of its token inside a chunk, else its own; 0 if unknown."""
    return F.coalesce(F.when(F.col("chunk_start_step") >= 0, F.col("chunk_start_step") + F.col("token_idx")).otherwise(F.col("step_in_episode")), F.lit(0))


def drop_reason() -> Column:
    """Why a row stands for no executed step; null if it does."""
    c, n, t = (F.col(x) for x in ("chunk_start_step", "executed_chunk_len", "token_idx"))
    return F.when((c < 0) | (n <= 0), "no_chunk").when(t < 0, "negative_token").when(t >= n, "not_executed")


def task_means_of_clusters(windows: DataFrame, task_means: DataFrame, order: str) -> DataFrame:
    """Task means under every cluster; a cluster's task is that of its first event in ``order``."""
    tasks = windows.groupBy("cluster").agg(F.min_by("task", order).alias("task"))
    return tasks.join(task_means, "task")


def fidelity_report(rows: DataFrame) -> DataFrame:
    """One pass over (shard, dim, x, residual, latent): sums per shard and dimension, which merge by adding."""
    x, r, h = F.col("x"), F.col("residual"), F.col("latent")
    g = rows.groupBy("shard", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(r).alias("sr"), F.sum(x * x).alias("sxx"), F.sum(r * r).alias("srr"), F.count_if(h != 0).alias("nz"), F.bool_and(~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"))
    d = g.groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sr", "sxx", "srr", "nz")], F.bool_and("finite").alias("finite"))
    var_x, var_r = F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")), F.sum(F.col("srr") - F.col("sr") * F.col("sr") / F.col("n"))
    one = d.agg(F.max("n").alias("num_rows"), (1 - var_r / var_x).alias("frac_variance_explained"), (F.sum("srr") / F.sum("n")).alias("reconstruction_mse"), F.count_if(F.col("nz") > 0).alias("alive_features"), (F.count_if(F.col("nz") > 0) / F.count(F.lit(1))).alias("alive_fraction"), (F.sum("nz") / F.max("n")).alias("mean_l0"), F.bool_and("finite").alias("all_finite"))
    return one.join(F.broadcast(g.agg(F.count_distinct("shard").alias("num_shards"))))  # one row


def forwards_off(index: DataFrame, expected: int) -> DataFrame:
    """Per run and layer: steps, steps with another number of forwards than expected, and the greatest number."""
    s = index.groupBy("run_id", "layer_idx", "episode_num", "step_in_episode").agg(F.count_distinct("global_forward_idx").alias("n"))
    return s.groupBy("run_id", "layer_idx").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("n") != expected).alias("off_steps"), F.max("n").alias("most"))


def interval_tiling(index: DataFrame, shard: list[str]) -> DataFrame:
    """Per shard: do its intervals lie end to end from 0, and where do they end?

    They do exactly if each starts at 0 or where another ends, and their lengths
    sum up to the last end: an overlap would make the sum greater, a gap would
    leave a start loose. No ordered window, so shards of any size spread out.
    """
    d = index.filter(F.col("row_end") > F.col("row_start")).select(*shard, "row_start", "row_end").distinct()
    ends = d.select(*shard, F.col("row_end").alias("row_start"), F.lit(1).alias("met")).distinct()
    j = d.join(ends, [*shard, "row_start"], "left")
    loose = (F.col("row_start") != 0) & F.col("met").isNull()
    tiles = (F.count_if(loose) == 0) & (F.sum((F.col("row_end") - F.col("row_start")).cast("long")) == F.max("row_end"))
    return j.groupBy(*shard).agg(tiles.alias("tiles"), F.max("row_end").alias("last_row"))


def disorder(rows: DataFrame, part: list[str], order: str, key: str) -> DataFrame:
    """Per part: rows, how often ``key`` decreases along ``order``, and where first (-1: never). ``order`` is unique inside a part."""
    n = with_neighbour(rows, part, order, [key])
    down = F.col(key) < F.col(f"prev_{key}")
    return n.groupBy(*part).agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if(down).alias("decreases"), F.coalesce(F.min(F.when(down, F.col(order))), F.lit(-1)).alias("first_at"))


def batches(rows: DataFrame, order: list[str], size: int, limit: int | None = None) -> DataFrame:
    """Rows with the number of their batch: full batches of ``size`` and one tail, of the first ``limit`` rows in order."""
    r = global_rank(rows, order, "__n")
    if limit is not None:
        r = r.filter(F.col("__n") <= limit)
    return r.withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")


def index_of_layer(index: DataFrame, layer: int) -> DataFrame:
    """shard_path, row_start, row_end of one layer, with the place inside the shard. The filter reaches the scan."""
    i = index.filter((F.col("layer_idx") == layer) & F.col("shard_path").isNotNull()).select("shard_path", "row_start", "row_end").distinct()
    w = Window.partitionBy("shard_path").orderBy("row_start", "row_end")  # distinct intervals of one file
    return i.withColumn("position", F.row_number().over(w))
