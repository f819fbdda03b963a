"""Data-quality constraints: named conditions whose violations are counted in one pass.

A row constraint is a Column that holds for a good row; a null counts as a
violation. All row constraints of a table are evaluated by one aggregation.
A query constraint is a DataFrame of violations (duplicates, missing keys).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.vectors import finite


@dataclass(frozen=True)
class Constraint:
    """``holds`` is a SQL condition or a Column."""

    name: str
    holds: str | Column

    def column(self) -> Column:
        return F.expr(self.holds) if isinstance(self.holds, str) else self.holds


def check_rows(df: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """(constraint, violations, checked) for all row constraints, from a single scan."""
    bad = [F.count_if(~F.coalesce(c.column(), F.lit(False))).alias(f"v{i}") for i, c in enumerate(constraints)]
    one = df.agg(F.count(F.lit(1)).alias("checked"), *bad)
    entries = F.array(*[F.struct(F.lit(c.name).alias("constraint"), F.col(f"v{i}").alias("violations")) for i, c in enumerate(constraints)])
    return one.select("checked", F.explode(entries).alias("e")).select("e.constraint", "e.violations", "checked")


def check_query(name: str, violations: DataFrame) -> DataFrame:
    return violations.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("constraint"), "violations", F.lit(None).cast("long").alias("checked"))


def check_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def enforce(df: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """The rows themselves; the first that breaks a constraint fails the query with the constraint's name."""
    ok = F.lit(True)
    for c in constraints:
        ok = F.when(~F.coalesce(c.column(), F.lit(False)), F.raise_error(F.lit(f"violated: {c.name}"))).otherwise(ok)
    return df.filter(ok)


def vector_of(c: str, n: int) -> Column:
    """A vector of n finite numbers."""
    v = F.col(c)
    return v.isNotNull() & (F.size(v) == n) & F.forall(v, lambda x: finite(x))


def within(c: str, low: float, high: float) -> Column:
    return finite(F.col(c)) & F.col(c).between(low, high)


def sha256_text(c: str) -> Column:
    return F.col(c).rlike("^[0-9a-f]{64}$")


Rule = Callable[[DataFrame], DataFrame]

TRAJECTORY = (
    Constraint("eef_pos_is_3_finite", "size(eef_pos) = 3 and forall(eef_pos, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"),
    Constraint("gripper_qpos_is_2_finite", "size(gripper_qpos) = 2 and forall(gripper_qpos, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"),
    Constraint("gripper_action_finite", "gripper_action is not null and not isnan(gripper_action)"),
    Constraint("gripper_action_in_range", "gripper_action between -1.5 and 1.5"),
    Constraint("step_not_negative", "step_in_episode >= 0"),
    Constraint("described", "trim(task_description) <> ''"),
    Constraint("logged_after_step", "logged_at >= step_at"),
)
INDEX = (
    Constraint("range_not_empty", "row_end > row_start and row_start >= 0"),
    Constraint("forward_positive", "global_forward_idx > 0"),
    Constraint("episode_named", "episode_num is not null and episode_num <> -1"),
    Constraint("shard_named", "trim(shard_path) <> ''"),
)
PROMPTS = (
    Constraint("initial_state_hash", "initial_state_sha256 rlike '^[0-9a-f]{64}$'"),
    Constraint("actions_not_negative", "num_actions >= 0"),
    Constraint("outcome_known", "success is not null"),
    Constraint("lifetime_in_order", "deleted_at is null or deleted_at > registered_at"),
    Constraint("prompt_matches_task", "lower(trim(prompt_task_description)) = lower(trim(task_description))"),
)
TOPK = (
    Constraint("ids_and_values_pair", "size(top_feature_ids) = size(top_feature_vals)"),
    Constraint("values_finite", "forall(top_feature_vals, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"),
    Constraint("ids_not_negative", "forall(top_feature_ids, x -> x >= 0)"),
    Constraint("ids_distinct", "size(array_distinct(top_feature_ids)) = size(top_feature_ids)"),
    Constraint("chunk_sentinels_agree", "(chunk_start_step = -1) = (executed_chunk_len = -1)"),
)
REPLAY = (
    Constraint("qpos_is_9_finite", "size(qpos) = 9 and forall(qpos, x -> x is not null and not isnan(x))"),
    Constraint("qvel_is_9_finite", "size(qvel) = 9 and forall(qvel, x -> x is not null and not isnan(x))"),
    Constraint("state_hash", "control_state_sha256 rlike '^[0-9a-f]{64}$'"),
    Constraint("reward_in_unit", "reward between 0 and 1"),
    Constraint("done_known", "done is not null"),
)
