"""Constraints of paired (normal and forced) runs, each as the first reason that a record breaks.

Reasons are strings in a fixed order; a record without one is sound. Counting
them is one aggregation, so every check is a scan plus the joins it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.vectors import all_close, finite, only_last_changed
from stepweave.operators.strict import reasons

#: What an action row may say about its intervention and its input.
NONE, FORCED = "none", "forced_gripper_open"
OBSERVED, REPLAYED = "observed", "normal_prefix_replay"
#: Round-off that a probability mass may have.
MASS_TOLERANCE = 1e-6


def release_time_reason(*, stable_steps: int = 3, max_force_steps: int = 8) -> Column:
    """Over trigger_step, t_cmd, t_detach, t_detach_confirmed and t_obs (may be null)."""
    trigger, cmd, off, sure, seen = (F.col(c) for c in ("trigger_step", "t_cmd", "t_detach", "t_detach_confirmed", "t_obs"))
    return reasons(
        ("missing_times", cmd.isNull() | off.isNull() | sure.isNull() | trigger.isNull()),
        ("wrong_order", (cmd != trigger) | (off < cmd) | (sure < off)),
        ("too_long", sure - cmd + 1 > max_force_steps),
        ("confirmation_window", sure != off + stable_steps - 1),
        ("late_observation", seen.isNotNull() & (seen != off + 1)),
    )


def action_reason(*, tolerance: float = 1e-6) -> Column:
    """Over condition, step, policy, executed, applied, kind and source of an action row and the times of its pair."""
    policy, executed = F.col("policy"), F.col("executed")
    same = all_close(policy, executed, tolerance)
    normal = F.col("condition") == "normal"
    applied = F.coalesce("applied", F.lit(False))
    due = F.col("step").between(F.col("t_cmd"), F.col("t_detach_confirmed"))
    expected = F.when(F.col("step") <= F.col("t_cmd"), REPLAYED).otherwise(OBSERVED)
    return reasons(
        ("normal_modified", normal & ~same),
        ("normal_flagged", normal & applied),
        ("normal_kind", normal & (F.coalesce("kind", F.lit(NONE)) != NONE)),
        ("normal_source", normal & ~F.col("source").eqNullSafe(F.lit(OBSERVED))),
        ("forced_source", ~normal & ~F.col("source").eqNullSafe(expected)),
        ("forced_kind", ~normal & ~F.col("kind").eqNullSafe(F.lit(FORCED))),
        ("interval", ~normal & (applied != due)),
        ("other_dimension", ~normal & applied & ~only_last_changed(policy, executed, tolerance)),
        ("outside", ~normal & ~applied & ~same),
    )


def incomplete_intervals(actions: DataFrame) -> DataFrame:
    """Pairs whose applied steps do not start at t_cmd and end at t_detach_confirmed. actions: pair_id, condition, step, applied and times."""
    on = F.when((F.col("condition") != "normal") & F.coalesce("applied", F.lit(False)), F.col("step"))
    g = actions.groupBy("pair_id", "t_cmd", "t_detach_confirmed").agg(F.min(on).alias("first"), F.max(on).alias("last"))
    return g.filter(~(F.col("first").eqNullSafe(F.col("t_cmd")) & F.col("last").eqNullSafe(F.col("t_detach_confirmed"))))


def recorded_time_reason(recorded: DataFrame, recomputed: DataFrame, keys: list[str], times: list[str]) -> DataFrame:
    """Recorded times against those found in the raw steps: ``wrong_<time>`` for the first that differs, null if none does."""
    j = recorded.join(recomputed.select(*keys, *[F.col(t).alias(f"__{t}") for t in times]), keys, "left")
    return j.withColumn("reason", reasons(*[(f"wrong_{t}", ~F.col(t).eqNullSafe(F.col(f"__{t}"))) for t in times])).drop(*[f"__{t}" for t in times])


#: Hashes whose inequality makes a pair invalid, with the reason, in order; those without one are evidence only.
AUDIT = (("initial_state", "initial_state_hash_mismatch"), ("sim_state", None), ("source_rgb", None), ("integration_state", "warm_start_integration_state_hash_mismatch"), ("model_xml", "warm_start_model_xml_hash_mismatch"), ("python_state", "warm_start_python_state_hash_mismatch"))


def invalid_reasons(pairs: DataFrame) -> DataFrame:
    """pair_id, invalid_reasons (in order) and an ``_exact`` flag per hash. pairs: structs ``normal`` and ``forced`` with the hashes, forced also with invalid_reason and failed."""
    exact = {n: F.col(f"normal.{n}").eqNullSafe(F.col(f"forced.{n}")) for n, _ in AUDIT}
    why = [F.col("forced.invalid_reason"), *[F.when(~exact[n], F.lit(r)) for n, r in AUDIT if r], F.when(F.coalesce("forced.failed", F.lit(False)), F.lit("forced_exception"))]
    return pairs.select("pair_id", F.array_compact(F.array(*why)).alias("invalid_reasons"), *[c.alias(f"{n}_exact") for n, c in exact.items()])


def uncertainty_reason(*, dimensions: int = 7) -> Column:
    """Over token_ids, vocab_start, vocab_end, vocab_size and dims (structs of dimension, token, is_action, rank, probability, entropy, mass)."""
    dims = F.col("dims")
    some = lambda bad: F.exists(dims, bad)
    unit = lambda x: finite(x) & x.between(0.0, 1.0)
    in_vocab = lambda x: (x >= F.col("vocab_start")) & (x < F.col("vocab_end"))
    wrong = lambda cond: ~F.coalesce(cond, F.lit(False))
    return reasons(
        ("token_count", wrong(F.size("token_ids") == dimensions)),
        ("vocabulary", wrong((F.col("vocab_size") > 1) & (F.col("vocab_end") - F.col("vocab_start") == F.col("vocab_size")))),
        ("dimension_order", wrong((F.size(dims) == dimensions) & (F.transform(dims, lambda d: d["dimension"]) == F.array(*[F.lit(i) for i in range(dimensions)])))),
        ("token_mismatch", wrong(F.transform(dims, lambda d: d["token"]) == F.col("token_ids"))),
        ("token_flag", some(lambda d: wrong(d["is_action"] == in_vocab(d["token"])))),
        ("no_action_token", some(lambda d: wrong(d["is_action"]))),
        ("rank", some(lambda d: wrong(d["rank"].between(1, F.col("vocab_size"))))),
        ("probability", some(lambda d: wrong(unit(d["probability"])))),
        ("entropy", some(lambda d: wrong(finite(d["entropy"]) & (d["entropy"] >= 0)))),
        ("mass", some(lambda d: wrong(finite(d["mass"]) & d["mass"].between(-MASS_TOLERANCE, 1 + MASS_TOLERANCE)))),
    )


def not_contiguous(attempts: DataFrame, part: str, index: str) -> DataFrame:
    """Parts whose indices are not exactly 0 .. n - 1."""
    n = F.count(F.lit(1))
    return attempts.groupBy(part).agg(n.alias("n"), F.min(index).alias("low"), F.max(index).alias("high"), F.count_distinct(index).alias("distinct")).filter((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("distinct") != F.col("n")))


def identity_mismatches(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys of both files whose identity columns differ. Either side may repeat keys; all their rows count."""
    one = lambda df, p: df.groupBy(*keys).agg(*[f(c).alias(f"{p}{n}{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    j = one(left, "l").join(one(right, "r"), keys)
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~(F.col(f"llo{c}").eqNullSafe(F.col(f"rlo{c}")) & F.col(f"lhi{c}").eqNullSafe(F.col(f"rhi{c}")) & F.col(f"llo{c}").eqNullSafe(F.col(f"lhi{c}")))
    return j.filter(bad).select(*keys)
