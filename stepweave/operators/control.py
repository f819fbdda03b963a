"""Controlled-release experiments: triggers, detachment, quotas, paired comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.vectors import max_abs_delta
from stepweave.operators.machines import Detach, Trigger, by_segment, fold_segments
from stepweave.operators.segments import SEGMENT, running, with_neighbour


def release_triggers(steps: DataFrame, keys: Sequence[str], *, stable_steps: int = 3, min_lift: float = 0.01, delay: int = 2, segment: int = SEGMENT) -> DataFrame:
    """Per entity: the earliest trigger and the times of its grasp.

    ``steps`` has step, grasped and z. The rule is a state machine: a grasp
    (null counts as none) that has lasted ``stable_steps`` rows and is lifted by
    ``min_lift`` above the first z is eligible; ``delay`` steps after it became
    so without a break, it triggers. Losing the grasp resets all. Rows are
    shuffled once, by entity and segment; see :mod:`stepweave.operators.machines`.
    Without a trigger, trigger_step and the times are null.
    """
    keys = list(keys)
    rows = by_segment(steps.select(*keys, "step", "grasped", "z"), keys, segment=segment)
    firsts = rows.groupBy(*keys, "__seg").agg(F.min(F.struct("step", "z")).alias("f"))
    w = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, 0)  # one row a segment
    z0 = firsts.select(*keys, "__seg", F.first("f.z").over(w).alias("z0"))
    rise = F.col("z") - F.col("z0")
    s = rows.join(z0.hint("merge"), [*keys, "__seg"]).withColumns({"grasped": F.coalesce("grasped", F.lit(False)), "lifted": F.coalesce((rise >= min_lift) & ~F.isnan(rise), F.lit(False))})
    m = Trigger(stable_steps, delay)
    return fold_segments(s, keys, ["grasped", "lifted"], m.summarize, m.fold, "trigger_step int, t_grasp int, t_stable_grasp int, t_lift int")


def detachments(steps: DataFrame, keys: Sequence[str], *, confirm: int = 3, segment: int = SEGMENT) -> DataFrame:
    """Per entity: the first confirmed detachment.

    ``steps`` has step, pre_grasped, post_grasped. The first row of a run of
    ungrasped rows is a candidate if it was grasped before; the detachment is
    confirmed ``confirm`` rows into the run. A regrasp discards the candidate.
    """
    keys = list(keys)
    rows = by_segment(steps.select(*keys, "step", (~F.coalesce("post_grasped", F.lit(False))).alias("off"), F.coalesce("pre_grasped", F.lit(False)).alias("pre")), keys, segment=segment)
    m = Detach(confirm)
    return fold_segments(rows, keys, ["off", "pre"], m.summarize, m.fold, "t_detach int, t_detach_confirmed int")


def quota_summary(attempts: DataFrame, *, target_valid: int = 20, target_primary: int = 20) -> DataFrame:
    """Per task: counts of attempts, and the first attempt at which both targets are met (must be the last).

    ``attempts`` has task_id, attempt (unique in the task), eligible, valid, primary.
    """
    r = running(attempts, ["task_id"], "attempt", {"n_valid": ("sum", F.when(F.col("valid"), 1).otherwise(0)), "n_primary": ("sum", F.when(F.col("primary"), 1).otherwise(0))})
    met = (F.col("n_valid") >= target_valid) & (F.col("n_primary") >= target_primary)
    q = r.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("eligible").alias("eligible_pairs"),
        F.count_if(F.col("eligible") & F.col("valid")).alias("valid_pairs"),
        F.count_if(F.col("eligible") & ~F.col("valid")).alias("invalid_pairs"),
        F.count_if(~F.col("eligible")).alias("ineligible_pairs"),
        F.count_if("primary").alias("primary_pairs"),
        F.min(F.when(met, F.col("attempt"))).alias("met_at"),
        F.max("attempt").alias("last_attempt"),
    )
    return q.withColumn("target_reached", F.col("met_at").isNotNull()).withColumn("stopped_late", F.coalesce(F.col("met_at") < F.col("last_attempt"), F.lit(False)))


def condition_summary(episodes: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Episodes, successes, failures and rate for each condition of a fixed domain; an empty one has rate 0."""
    domain = episodes.sparkSession.createDataFrame([(c,) for c in conditions], "condition string")
    n = episodes.groupBy("condition").agg(F.count(F.lit(1)).alias("episodes"), F.count_if("success").alias("successes"))
    j = domain.join(n, "condition", "left").fillna(0, ["episodes", "successes"])
    return j.withColumn("failures", F.col("episodes") - F.col("successes")).withColumn("success_rate", F.when(F.col("episodes") > 0, F.col("successes") / F.col("episodes")).otherwise(0.0))


def action_divergence(pairs: DataFrame, *, tolerance: float = 1e-6) -> DataFrame:
    """Per entity: how two action sequences diverge.

    ``pairs`` has one row per (entity, step) with the actions a and b, null
    where a side has no such step. Means are over compared values; if nothing
    differs but the lengths do, the first changed step is the common length.
    A step whose actions can't be compared (unequal sizes, null or non-finite
    elements) is changed: its delta is infinite, and the mean leaves it out.
    """
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    delta = F.when(both, max_abs_delta(F.col("a"), F.col("b")))
    compared = delta < float("inf")
    total = F.when(compared, F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    size = F.when(compared, F.size("a"))
    g = pairs.select("entity", "step", both.alias("both"), F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b"), delta.alias("delta"), total.alias("total"), size.alias("size"))
    r = g.groupBy("entity").agg(
        F.count_if("in_a").alias("raw_steps"),
        F.count_if("in_b").alias("condition_steps"),
        F.count_if("both").alias("common_steps"),
        F.min(F.when(F.col("delta") > tolerance, F.col("step"))).alias("changed_at"),
        F.coalesce(F.max("delta"), F.lit(0.0)).alias("max_abs_delta"),
        F.coalesce(F.sum("total") / F.nullif(F.sum("size"), F.lit(0)), F.lit(0.0)).alias("mean_abs_delta"),
    )
    first = F.coalesce("changed_at", F.when(F.col("raw_steps") != F.col("condition_steps"), F.col("common_steps")))
    return r.select("entity", "raw_steps", "condition_steps", first.alias("first_changed_step"), "max_abs_delta", "mean_abs_delta")


def prefix_comparison(pairs: DataFrame, fields: Sequence[tuple[str, Column]]) -> DataFrame:
    """Per entity: steps compared, and the first step with a mismatch and its field; of several fields the first in order counts.

    ``fields``: (name, condition that holds if the field differs).
    """
    which = F.lit(None).cast("string")
    for name, differs in reversed(list(fields)):
        which = F.when(differs, F.lit(name)).otherwise(which)
    s = pairs.select("entity", "step", which.alias("field"))
    bad = F.min(F.when(F.col("field").isNotNull(), F.struct("step", "field")))
    return s.groupBy("entity").agg(F.count(F.lit(1)).alias("steps_compared"), bad.alias("b")).select("entity", "steps_compared", F.col("b.step").alias("first_mismatch_step"), F.col("b.field").alias("mismatch_field"))


def grasp_transitions(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds pre_grasped (the previous row's state) and post_grasped to steps with ``grasped``."""
    n = with_neighbour(steps, keys, "step", ["grasped"])
    return n.withColumns({"pre_grasped": F.col("prev_grasped"), "post_grasped": F.col("grasped")})
