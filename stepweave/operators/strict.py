"""Strict joins: every record is joined or gets the reason why it is not.

A lookup side is unique by key; where that is not given, ambiguous keys are a
reason of their own. Reasons stand in the order in which they are tested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(*tests: tuple[str, Column]) -> Column:
    """The first test that holds, by name; null if none does."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(tests):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def by_reason(df: DataFrame, column: str = "reason", kept: str = "joined", n: str = "records") -> DataFrame:
    """Records per reason, those without one under ``kept``."""
    return df.groupBy(F.coalesce(F.col(column), F.lit(kept)).alias(column)).agg(F.count(F.lit(1)).alias(n))


def center_states(samples: DataFrame, steps: DataFrame, keys: Sequence[str], position: str = "eef_pos") -> DataFrame:
    """Samples with the state of their step: reason missing_state, missing_position, or null. ``steps`` is unique by keys."""
    s = steps.select(*keys, F.col(position).alias("__p"), F.lit(True).alias("__here"))
    j = samples.join(s, list(keys), "left")
    reason = reasons(("missing_state", F.col("__here").isNull()), ("missing_position", F.col("__p").isNull()))
    return j.withColumn("reason", reason).withColumnRenamed("__p", position).drop("__here")


def state_vector(position: Column, gripper: Column, uniform: Column) -> Column:
    """Position, and the gripper's joints if all records of the episode have them."""
    return F.when(uniform, F.concat(position, gripper)).otherwise(position)


def with_uniform(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Adds whether every record of its group has ``column``: an aggregate joined back, so that no group is gathered."""
    all_have = df.groupBy(*keys).agg(F.bool_and(F.col(column).isNotNull()).alias(name))
    return df.join(all_have, list(keys))


def media_lookup(waypoints: DataFrame, episodes: DataFrame, media: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Waypoints with episode and medium: reason missing_episode, then missing_medium."""
    e, m = episodes.select(*keys, F.lit(True).alias("__e")), media.select(*keys, F.lit(True).alias("__m"))
    j = waypoints.join(e, list(keys), "left").join(m, list(keys), "left")
    return j.withColumn("reason", reasons(("missing_episode", F.col("__e").isNull()), ("missing_medium", F.col("__m").isNull()))).drop("__e", "__m")


def unique_lookup(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a key: its columns, and ``copies``. A key with copies above 1 is ambiguous."""
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in columns], F.count(F.lit(1)).alias("copies"))


def lengths_agree(records: DataFrame, lookup: DataFrame, keys: Sequence[str], length: str, expected: str) -> DataFrame:
    """Records against a lookup (see :func:`unique_lookup`): unknown_key, ambiguous_key, length_mismatch, or null."""
    j = records.join(lookup, list(keys), "left")
    reason = reasons(("unknown_key", F.col("copies").isNull()), ("ambiguous_key", F.col("copies") > 1), ("length_mismatch", ~F.col(length).eqNullSafe(F.col(expected))))
    return j.withColumn("reason", reason)


def struct_mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys of both sides whose rows differ as a whole, with ``fields``: the columns that do. Null equals null, NaN equals NaN."""
    l, r = left.select(*keys, F.struct(*columns).alias("a")), right.select(*keys, F.struct(*columns).alias("b"))
    j = l.join(r, list(keys)).filter(~F.col("a").eqNullSafe(F.col("b")))
    bad = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    return j.select(*keys, F.array_join(bad, ",").alias("fields"))


def coverage(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only: ``uncovered`` is required but not present, ``outside`` the other way round."""
    both = required.select(*keys, F.lit(1).alias("q"), F.lit(0).alias("p")).unionByName(present.select(*keys, F.lit(0).alias("q"), F.lit(1).alias("p")))
    g = both.groupBy(*keys).agg(F.max("q").alias("q"), F.max("p").alias("p")).filter(F.col("q") != F.col("p"))
    return g.select(*keys, F.when(F.col("q") == 1, "uncovered").otherwise("outside").alias("side"))


def union_all_strict(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All rows of parts with equal columns; a key that occurs more than once fails the query, naming the key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    ok = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key "), key))).otherwise(F.lit(True))
    return out.join(n.filter(ok).drop("__n"), list(keys))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The rows; none is an error."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows, if all columns are there."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_of(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of several names of a column that the table has: old tables keep older names."""
    have = [n for n in names if n in df.columns]
    if not have:
        raise ValueError(f"none of the columns {', '.join(names)}")
    return F.coalesce(*[F.col(n) for n in have])


def one_per_rank(candidates: DataFrame, names: Sequence[str], rank: int = 1) -> DataFrame:
    """Each ranking of ``names`` with its features of a rank: reason missing, several, shared (another ranking picks the same), or null."""
    spark = candidates.sparkSession
    domain = spark.createDataFrame([(n,) for n in names], "ranking string")
    picked = candidates.filter(F.col("rank") == rank).groupBy("ranking").agg(F.count(F.lit(1)).alias("n"), F.min("feature").alias("feature"))
    j = domain.join(picked, "ranking", "left")
    users = j.filter(F.col("feature").isNotNull()).groupBy("feature").agg(F.count(F.lit(1)).alias("users"))
    return j.join(users, "feature", "left").select("ranking", "feature", reasons(("missing", F.col("n").isNull()), ("several", F.col("n") > 1), ("shared", F.col("users") > 1)).alias("reason"))


def ranking_counts(candidates: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Entries of each ranking against the number it should have, and whether its ranks are exactly 1 .. n. Rankings nobody expects come out, too."""
    spark = candidates.sparkSession
    e = spark.createDataFrame(list(expected.items()), "ranking string, expected long")
    g = candidates.groupBy("ranking").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("feature").alias("features"))
    j = e.join(g, "ranking", "full_outer").fillna(0, ["entries", "expected", "ranks", "features"])
    exact = (F.col("entries") == F.col("expected")) & (F.col("ranks") == F.col("entries")) & (F.col("features") == F.col("entries")) & ((F.col("entries") == 0) | ((F.col("low") == 1) & (F.col("high") == F.col("entries"))))
    return j.select("ranking", "expected", "entries", "features", exact.alias("exact"))
