"""Merging runs: surrogate keys, renumbering, strict joins and comparisons of key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.segments import global_rank


def global_episode(task: Column, trial: Column, trials: int, *, strict: bool = False) -> Column:
    """task * trials + trial + 1; null, or an error, if task or trial is out of range."""
    n = F.when((task >= 0) & (trial >= 0) & (trial < trials), task * trials + trial + 1)
    return F.coalesce(n, F.raise_error(F.format_string("no episode of task %s and trial %s", task, trial)).cast("int")) if strict else n


def rekey(records: DataFrame, runs: DataFrame, trials: int) -> DataFrame:
    """Records under their merged episode number, with lineage columns. runs: run_id, source_run_idx."""
    j = records.join(runs, "run_id")
    return j.withColumn("source_episode_num", F.col("episode_num")).withColumn("episode_num", global_episode(F.col("task_id"), F.col("task_episode_idx"), trials))


def ordered_runs(registry: DataFrame) -> DataFrame:
    """Distinct runs numbered from 0 in the order of their names."""
    return global_rank(registry.select("run_id").distinct(), ["run_id"], "r").select("run_id", (F.col("r") - 1).cast("int").alias("source_run_idx"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once: a merge that demands unique keys wants none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def renumber_forwards(index: DataFrame) -> DataFrame:
    """(run_id, global_forward_idx) with a new number from 1 in the order of first appearance (run, shard, row).

    Forward ids of 0 or less name no forward.
    """
    valid = index.filter(F.col("global_forward_idx") > 0)
    first = valid.groupBy("run_id", "global_forward_idx").agg(F.min(F.struct(F.coalesce("shard_path", F.lit("")).alias("shard"), F.col("row_start").alias("row"))).alias("f"))
    flat = first.select("run_id", F.col("f.shard").alias("shard"), F.col("f.row").alias("row"), "global_forward_idx")
    return global_rank(flat, ["run_id", "shard", "row", "global_forward_idx"], "new_forward_idx").select("run_id", "global_forward_idx", "new_forward_idx")


def inventory_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, problem, expected_size, actual_size): missing, wrong_size, unexpected. Both sides: path, size; unique paths."""
    j = expected.select("path", F.col("size").alias("expected_size")).join(actual.select("path", F.col("size").alias("actual_size")), "path", "full_outer")
    problem = F.when(F.col("actual_size").isNull(), "missing").when(F.col("expected_size").isNull(), "unexpected").when(F.col("expected_size") != F.col("actual_size"), "wrong_size")
    return j.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with ``side``: left or right."""
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    g = both.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return g.filter(F.col("l") != F.col("r")).select(*keys, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def zip_alignment(left: DataFrame, right: DataFrame, part: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Positional join within each part: positions at which the streams end unequally or their columns disagree."""
    w = Window.partitionBy(part).orderBy(order)

    def numbered(df: DataFrame, p: str) -> DataFrame:
        return df.select(part, F.row_number().over(w).alias("position"), *[F.col(c).alias(f"{p}{c}") for c in columns], F.lit(True).alias(f"{p}here"))

    j = numbered(left, "l_").join(numbered(right, "r_"), [part, "position"], "full_outer")
    bad = F.col("l_here").isNull() | F.col("r_here").isNull()
    for c in columns:
        bad = bad | ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    return j.groupBy(part).agg(F.count(F.lit(1)).alias("positions"), F.count_if(bad).alias("mismatches"), F.min(F.when(bad, F.col("position"))).alias("first_mismatch"))


def strict_lookup(records: DataFrame, lookup: DataFrame, keys: Sequence[str], agree: Sequence[str]) -> DataFrame:
    """Records with a reason where the lookup lacks their key or disagrees in a column; ``lookup`` is unique by key."""
    l = lookup.select(*keys, *[F.col(c).alias(f"__{c}") for c in agree], F.lit(True).alias("__known"))
    j = records.join(l, list(keys), "left")
    reason = F.when(F.col("__known").isNull(), F.lit("unknown_key"))
    for c in agree:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(f"mismatch:{c}"))
    return j.withColumn("reason", reason).drop("__known", *[f"__{c}" for c in agree])


def without_allowed(differences: DataFrame, allowed: str) -> DataFrame:
    """Inventory differences without the unexpected files whose path matches a pattern."""
    return differences.filter(~((F.col("problem") == "unexpected") & F.col("path").rlike(allowed)))


def fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as canonical JSON: names in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def key_pattern(word: str) -> str:
    """A pattern for JSON text with a key that contains the word, in any case."""
    return '(?i)"[^"]*' + word + r'[^"]*"\s*:'
