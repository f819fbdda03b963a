"""Feature scores of event clusters, and the rankings made from them.

A template is mean-centred, so projecting a window on it needs only the stored
activations: a feature that is absent from a step adds nothing. Scores are
therefore sparse sums over (event, step, feature), never dense matrices.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.windows import fit_windows, template_weights, window_steps

ROUND = 6


def complete_windows(events: DataFrame, timesteps: DataFrame, half: int) -> DataFrame:
    """Window rows (sample, pos, step) of the events all of whose steps are among ``timesteps`` (episode, step)."""
    w = window_steps(fit_windows(events, half), half)
    met = w.join(timesteps, ["episode", "step"], "left_semi")
    full = met.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 2 * half + 1).select("sample")
    return w.join(full, "sample", "left_semi")


def required_timesteps(events: DataFrame, half: int) -> DataFrame:
    """The (episode, step) pairs any window asks for: what is aggregated can be cut down to them first."""
    return window_steps(fit_windows(events, half), half).select("episode", "step").distinct()


def score_events(windows: DataFrame, means: DataFrame, half: int) -> DataFrame:
    """(cluster, episode, sample, feature): non-negative template projections and the window mean.

    An event at step 0 has a constant step template and is an error.
    """
    weights = F.broadcast(template_weights(windows.sparkSession, half))  # (2 * half + 1) ** 2 rows
    j = windows.join(means, ["episode", "step"]).join(weights, ["event_idx", "pos"])
    up = F.when(F.col("step_up").isNull(), F.raise_error(F.lit("constant step template: an event at step 0"))).otherwise(F.col("step_up"))
    s = j.groupBy("cluster", "episode", "sample", "feature").agg(F.sum(F.col("pulse") * F.col("x")).alias("pulse"), F.sum(up * F.col("x")).alias("up"), (F.sum("x") / (2 * half + 1)).alias("window_mean"))
    zero = F.lit(0.0)
    return s.select("cluster", "episode", "sample", "feature", F.greatest("pulse", zero).alias("pulse"), F.greatest("up", zero).alias("step_up"), F.greatest(-F.col("up"), zero).alias("step_down"), "window_mean")


def cluster_scores(events_scored: DataFrame, windows: DataFrame) -> DataFrame:
    """(cluster, feature): score, window_mean. Means run over events, then over episodes; the best template is taken in between."""
    samples = windows.select("cluster", "episode", "sample").distinct()
    per_episode = samples.groupBy("cluster", "episode").agg(F.count(F.lit(1)).alias("n_events"))
    per_cluster = per_episode.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_episodes"), F.sum("n_events").alias("num_events"))
    sums = events_scored.groupBy("cluster", "episode", "feature").agg(*[F.sum(c).alias(c) for c in ("pulse", "step_up", "step_down", "window_mean")])
    e = sums.join(per_episode, ["cluster", "episode"])
    n = F.col("n_events")
    best = e.select("cluster", "feature", F.greatest(F.col("pulse") / n, F.col("step_up") / n, F.col("step_down") / n).alias("s"), (F.col("window_mean") / n).alias("m"))
    total = best.groupBy("cluster", "feature").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    return total.join(per_cluster, "cluster").select("cluster", "feature", (F.col("s") / F.col("n_episodes")).alias("score"), (F.col("m") / F.col("n_episodes")).alias("window_mean"), "n_episodes", "num_events")


def top_features(scores: DataFrame, group: str, value: str, n: int, *, positive: bool = False) -> DataFrame:
    """The n best features of each group; equal (rounded) values go to the smaller feature. Spark prunes before the shuffle."""
    s = scores.withColumn("__v", F.round(value, ROUND))
    if positive:
        s = s.filter(F.col("__v") > 0)
    w = Window.partitionBy(group).orderBy(F.col("__v").desc(), F.col("feature"))
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(group, "rank", "feature", F.col("__v").alias(value))


def coverage(events: DataFrame, attempted: DataFrame) -> DataFrame:
    """Distinct member episodes of a cluster over the attempted episodes of its task. attempted: task, n_attempted.

    A task without attempts counts the episodes of its own events; the divisor is at least 1.
    """
    own = events.groupBy("task").agg(F.count_distinct("episode").alias("n_own"))
    members = events.groupBy("task", "cluster").agg(F.count(F.lit(1)).alias("num_members"), F.count_distinct("episode").alias("member_episodes"), F.avg("progress").alias("mean_progress"))
    j = members.join(own, "task").join(attempted, "task", "left")
    total = F.greatest(F.coalesce(F.nullif(F.col("n_attempted"), F.lit(0)), F.col("n_own")), F.lit(1))
    return j.select("task", "cluster", "num_members", "member_episodes", total.alias("total_episodes"), (F.col("member_episodes") / total).alias("episode_coverage"), "mean_progress")


def suite_event_aligned(scores: DataFrame, canonical: DataFrame) -> DataFrame:
    """Unweighted mean over the canonical clusters; a cluster without the feature counts as 0."""
    n = canonical.join(scores.select("cluster").distinct(), "cluster", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    s = scores.join(canonical.select("cluster"), "cluster", "left_semi").groupBy("feature").agg(F.sum("score").alias("s"))
    return s.join(F.broadcast(n)).select("feature", (F.col("s") / F.col("n")).alias("score"))  # one row


def suite_window_mean(scores: DataFrame, canonical: DataFrame) -> DataFrame:
    """Mean over the canonical clusters weighted by their scored events."""
    c = scores.join(canonical.select("cluster"), "cluster", "left_semi")
    total = c.select("cluster", "num_events").distinct().agg(F.sum("num_events").alias("w"))
    s = c.groupBy("feature").agg(F.sum(F.col("window_mean") * F.col("num_events")).alias("s"))
    return s.join(F.broadcast(total)).select("feature", (F.col("s") / F.col("w")).alias("score"))  # one row


def suite_task_mean(task_means: DataFrame, canonical: DataFrame) -> DataFrame:
    """Mean over the tasks that have a canonical cluster, weighted by their time steps (missing or 0: 1)."""
    tasks = canonical.select("task").distinct()
    t = task_means.join(tasks, "task", "left_semi")
    weight = F.coalesce(F.nullif(F.col("n_timesteps"), F.lit(0)), F.lit(1)).cast("double")
    total = t.select("task", weight.alias("w")).distinct().agg(F.sum("w").alias("w"))
    s = t.groupBy("feature").agg(F.sum(F.col("task_mean") * weight).alias("s"))
    return s.join(F.broadcast(total)).select("feature", (F.col("s") / F.col("w")).alias("score"))  # one row


def ranked(suite: DataFrame, name: str, k: int) -> DataFrame:
    """The k best features over all: TakeOrdered, no full sort. Columns ranking, rank, feature, score."""
    s = suite.select("feature", F.round("score", ROUND).alias("score"))
    best = s.orderBy(F.col("score").desc(), "feature").limit(k)
    w = Window.orderBy(F.col("score").desc(), "feature")  # k rows
    return best.select(F.lit(name).alias("ranking"), F.row_number().over(w).alias("rank"), "feature", "score")


def random_alive(alive: DataFrame, informed: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k alive features outside the informed ones, drawn from the sorted set as ``random.Random(seed).sample`` does, then sorted.

    The set is bounded by the dictionary size and is checked to hold no more than a million ids.
    """
    rest = alive.join(informed, "feature", "left_anti").orderBy("feature").limit(1_000_001).collect()
    if len(rest) > 1_000_000:
        raise ValueError("the dictionary is too large to be drawn from on the driver")
    ids = [r.feature for r in rest]
    drawn = sorted(random.Random(seed).sample(ids, min(k, len(ids))))
    return alive.sparkSession.createDataFrame([("random_alive", i + 1, int(f), 0.0) for i, f in enumerate(drawn)], "ranking string, rank int, feature long, score double")


def memberships(candidates: DataFrame) -> DataFrame:
    """Each feature with the rankings that name it; a ranking names a feature once, so lists are bounded by the rankings."""
    return candidates.groupBy("feature").agg(F.array_join(F.sort_array(F.collect_set("ranking")), ",").alias("rankings"), F.min("rank").alias("best_rank"))


def is_active(value: Column) -> Column:
    return (value > 0) & ~F.isnan(value)


def member_counts(clusters: DataFrame, events: DataFrame) -> DataFrame:
    """cluster, members, member_episodes of every cluster; 0 for one without members."""
    n = events.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("episode").alias("member_episodes"))
    return clusters.select("cluster").join(n, "cluster", "left").fillna(0, ["members", "member_episodes"])


def first_seen(candidates: DataFrame, order: tuple[str, ...], per_ranking: int) -> DataFrame:
    """feature and the place in the list of all candidates at which it first stands; rankings come in ``order``."""
    place = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("ranking")).cast("int") - 1
    return candidates.groupBy("feature").agg(F.min(place * per_ranking + F.col("rank") - 1).alias("first_seen"))


def delta_by_feature(episodes: DataFrame, named: DataFrame) -> DataFrame:
    """Success of the episodes under each feature against that of all, with the rankings that name it. episodes: feature, s (0 or 1)."""
    base = F.broadcast(episodes.agg(F.avg("s").alias("base")))  # one row
    r = episodes.groupBy("feature").agg(F.count(F.lit(1)).alias("episodes"), F.avg("s").alias("success_rate")).join(base)
    j = r.join(named.select("feature", "rankings"), "feature", "left").fillna("", ["rankings"])
    return j.select("feature", "rankings", "episodes", "success_rate", (F.col("success_rate") - F.col("base")).alias("delta"))


def compare_results(raw: DataFrame, hooked: DataFrame, protocol: list[str]) -> DataFrame:
    """One-row results side by side: n, rate and protocol columns of each; rates compare only under one protocol."""
    r = raw.select(F.col("n").alias("raw_episodes"), F.col("rate").alias("raw_rate"), F.struct(*protocol).alias("p"))
    h = hooked.select(F.col("n").alias("hooked_episodes"), F.col("rate").alias("hooked_rate"), F.struct(*protocol).alias("q"))
    j = r.join(F.broadcast(h))  # one row on either side
    delta = F.col("hooked_rate") - F.col("raw_rate")
    return j.select("raw_episodes", "hooked_episodes", "raw_rate", "hooked_rate", delta.alias("delta"), (-delta).alias("success_drop"), F.col("p").eqNullSafe(F.col("q")).alias("same_protocol"))


def nested_mean(dims: Column, field: str) -> Column:
    """Mean of one field over an array of structs."""
    return F.aggregate(F.transform(dims, lambda x: x[field]), F.lit(0.0), lambda a, x: a + x) / F.size(dims)
