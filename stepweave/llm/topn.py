"""Top N items of every group.

Method: a hot-cold split. Exact counts of each group's rows separate the heavy
groups from the rest. Light groups are brought together by one shuffle, in
which duplicates are merged and an ordinary window keeps the best. Heavy groups
are merged with map-side combine, salted and range-sorted by (group, salt);
each salt keeps its own top N, and a last window over at most N rows a salt
decides. Both results are united.

What is heavy depends on the rows that a task can hold, not on the size of the
table, and a heavy group gets as many salts as it fills tasks. The list of
heavy groups is broadcast if it is short by count, and shuffled if not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.runtime import broadcast_if_small, cut

#: Rows of a group that one task may hold; a group with more is heavy.
HEAVY_ROWS = 50_000


def _hot_groups(counts: DataFrame, heavy_rows: int) -> DataFrame | None:
    """The heavy groups of ``counts`` (the group columns and ``n``) with their number of salts. None if no group is heavy."""
    hot = cut(counts.filter(F.col("n") > heavy_rows).withColumn("n", F.ceil(F.col("n") / max(heavy_rows, 1)).cast("long")))
    return None if hot.isEmpty() else hot


def top_n(
    rows: DataFrame, group: Sequence[str], item: str, n: int, value: Column, *, keep: Column | None = None, counts: DataFrame | None = None, offered: Callable[[DataFrame], DataFrame] | None = None, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """The n best items of each group with ``value`` and ``item_rank`` from 1: higher values first, of equal ones the smaller item.

    ``value`` is an aggregate over an item's rows, ``keep`` a condition on it.
    ``counts`` may bring the rows per group (group columns and ``n``) if they
    are known more cheaply; ``offered`` turns rows into those with item and
    value, after the split. Null group columns form groups of their own. Fewer
    rows come out for smaller groups, none for an empty table.
    """
    group = list(group)
    order = [F.col("value").desc(), F.col(item).asc()]
    offered = offered or (lambda df: df)

    def merged(df: DataFrame) -> DataFrame:
        m = df.groupBy(*group, *[c for c in ("__salt",) if c in df.columns], item).agg(value.alias("value"))
        return m if keep is None else m.filter(keep)

    def ranked(df: DataFrame, *more: str) -> DataFrame:
        w = Window.partitionBy(*group, *more).orderBy(*order)
        return df.withColumn("item_rank", F.row_number().over(w)).filter(F.col("item_rank") <= n)

    def light(df: DataFrame) -> DataFrame:  # partitioned by group once, for the merge and for the window
        return ranked(merged(offered(df).repartition(*group)))

    hot = _hot_groups(counts if counts is not None else rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), heavy_rows)
    if hot is None:
        return light(rows)
    h = broadcast_if_small(hot.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("n").alias("__salts")))
    cond = F.lit(True)
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    heavy = offered(rows.join(h, cond).drop(*[f"__g{i}" for i in range(len(group))]))
    salted = merged(heavy.withColumn("__salt", F.pmod(F.xxhash64(item), F.col("__salts"))))
    first = ranked(salted.repartitionByRange(*group, "__salt"), "__salt").drop("item_rank", "__salt")
    return light(rows.join(h, cond, "left_anti")).unionByName(ranked(first))


def _counts(value: Column, item: Column) -> Column:
    v = value.cast("double")
    return (v > 0) & (v < float("inf")) & ~F.isnan(v) & (item >= 0)


STEP = ["run_id", "episode_num", "step_in_episode"]


def best_per_step(topk_rows: DataFrame, n: int = 5, **kw) -> DataFrame:
    """Best features of each time step; a feature's value is its highest over the step's rows.

    Ids and values pair by position, surplus ones are ignored. A row offers no
    more than its own n best features (plus as many as it repeats): none of the
    others can be among the n best of its step.
    """
    known = topk_rows.filter(F.col("run_id").isNotNull() & F.col("episode_num").isNotNull() & F.col("step_in_episode").isNotNull())
    zipped = F.arrays_zip(F.col("top_feature_ids").alias("f"), F.col("top_feature_vals").alias("v"))
    good = F.transform(F.filter(zipped, lambda p: _counts(p["v"], p["f"])), lambda p: F.struct((-p["v"]).alias("down"), p["f"].alias("feature_id")))
    repeats = F.size("good") - F.size(F.array_distinct(F.col("good.feature_id")))

    def offered(df: DataFrame) -> DataFrame:
        more = [c for c in df.columns if c == "__salts"]
        rows = df.select(*STEP, *more, good.alias("good"))
        best = F.slice(F.sort_array("good"), F.lit(1), F.lit(n) + repeats)
        return rows.select(*STEP, *more, F.explode(best).alias("p")).select(*STEP, *more, "p.feature_id", (-F.col("p.down")).alias("v"))

    # the number of rows that are offered, without sorting
    counts = known.select(*STEP, good.alias("good")).groupBy(*STEP).agg(F.sum(F.least(F.size("good"), F.lit(n) + repeats)).alias("n"))
    return top_n(known.select(*STEP, "top_feature_ids", "top_feature_vals"), STEP, "feature_id", n, F.max("v"), counts=counts, offered=offered, **kw)


def best_per_cluster(score_matrix: DataFrame, n: int = 10, **kw) -> DataFrame:
    """Best features of each cluster by their latest score (null scored_at is earliest; of ties, the greatest score, NaN above all)."""
    s = score_matrix.select("cluster_id", "feature_id", F.struct("scored_at", "score").alias("r")).filter(F.col("cluster_id").isNotNull() & (F.col("feature_id") >= 0))
    return top_n(s, ["cluster_id"], "feature_id", n, F.max("r")["score"], keep=_counts(F.col("value"), F.col("feature_id")), **kw)


def best_features(topk_rows: DataFrame, score_matrix: DataFrame, *, per_step: int = 5, per_cluster: int = 10, **kw) -> DataFrame:
    """scored_in, group_key, item_rank, feature_id, value for the time steps and the clusters.

    Only finite values above 0 and ids that are neither null nor negative count.
    Rows with a null in run_id, episode_num or step_in_episode name no time step.
    """
    out = ["item_rank", "feature_id", F.col("value").cast("double").alias("value")]
    t, c = best_per_step(topk_rows, per_step, **kw), best_per_cluster(score_matrix, per_cluster, **kw)
    return t.select(F.lit("topk_rows").alias("scored_in"), F.concat_ws("/", *STEP).alias("group_key"), *out).unionByName(c.select(F.lit("score_matrix").alias("scored_in"), F.col("cluster_id").alias("group_key"), *out))
