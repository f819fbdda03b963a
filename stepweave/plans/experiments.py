"""Queries over the domain tables: trajectories, activation indices, controlled releases, merges, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions.paths import normal_path
from stepweave.functions.text import contact_class, label, may_collide, number_tag, pair_id, pair_seed, sample_id
from stepweave.functions.vectors import angular_velocity, max_abs_delta, norm, replace_last
from stepweave.operators import activations as act
from stepweave.operators import constraints as con
from stepweave.operators import control as ctl
from stepweave.operators import merging as mg
from stepweave.operators import nested
from stepweave.operators import trajectories as tr
from stepweave.operators.copydiff import digest
from stepweave.operators.segments import with_neighbour
from stepweave.plans.general import sql_path as _general_path
from stepweave.runtime import cut, table

TRIALS = 1000


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return tr.latest_steps(table(spark, d, "trajectory_records"))


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return tr.assemble(_steps(spark, d))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """The latest lifetime of each episode."""
    p = table(spark, d, "prompt_records")
    cols = ["registered_at", "deleted_at", "task_id", "task_episode_idx", "task_description", "initial_state_sha256", "success", "num_actions"]
    return p.groupBy("run_id", "episode_num").agg(F.max(F.struct(*cols)).alias("r")).select("run_id", "episode_num", *[f"r.{c}" for c in cols])


def episode_assembly(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d).select("run_id", "episode_num", "task_id", "task_episode_idx", "task_description", "success", "num_steps", "first_step", "last_step", "num_positions", "has_gripper")


def episode_filter_head(spark: SparkSession, d: str) -> DataFrame:
    return tr.filter_episodes(_episodes(spark, d), outcome="success", limit=20).select("run_id", "episode_num", "task_id", "num_steps")


def missing_gripper_inputs(spark: SparkSession, d: str) -> DataFrame:
    return tr.missing_inputs(_steps(spark, d), "gripper_qpos")


def gripper_toggle(spark: SparkSession, d: str) -> DataFrame:
    return tr.toggles(_steps(spark, d))


def step_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return tr.contiguity(_steps(spark, d))


def success_rate_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = tr.success_rates(_episodes(spark, d))
    return r.select(F.coalesce(F.col("task_id"), F.lit(-1)).alias("task_id"), "episodes", "successes", F.round("success_rate", 6).alias("success_rate"))


def eef_speed(spark: SparkSession, d: str) -> DataFrame:
    v = tr.step_velocity(_steps(spark, d))
    return v.groupBy("run_id", "episode_num").agg(F.round(F.max(norm(F.col("velocity"))), 4).alias("max_speed"), F.count("velocity").alias("n_steps"))


def quat_delta_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Angular speed between orientations made from neighbouring positions: (x, y, z, 1)."""
    v = tr.step_velocity(_steps(spark, d)).filter(F.col("prev_eef_pos").isNotNull())
    q = lambda c: F.concat(F.col(c), F.array(F.lit(1.0)))
    w = v.select("run_id", "episode_num", "step", norm(angular_velocity(q("prev_eef_pos"), q("eef_pos"), F.col("seconds"))).alias("w"))
    return w.select("run_id", "episode_num", "step", F.round("w", 4).alias("angular_speed"))


def keyframes(spark: SparkSession, d: str) -> DataFrame:
    return tr.keyframes(_steps(spark, d))


def keyframe_totals(spark: SparkSession, d: str) -> DataFrame:
    k = tr.keyframes(_steps(spark, d)).groupBy("run_id", "episode_num").agg(F.count(F.lit(1)).alias("n"))
    return k.agg(F.count(F.lit(1)).alias("episodes"), F.sum("n").alias("waypoints"), F.avg("n").alias("per_episode"))


def _effective(mapping: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        t = table(spark, d, "topk_rows").withColumn("step", F.explode(act.effective_steps(mapping)))
        return t.groupBy("run_id", "episode_num", "step").agg(F.count(F.lit(1)).alias("n_rows"))

    return query


def topk_timestep_mean(spark: SparkSession, d: str) -> DataFrame:
    """A stored NaN or infinity makes the mean of its feature in its time step what arithmetic makes of it."""
    t = table(spark, d, "topk_rows")
    v = act.long_form(t, ["run_id", "episode_num", "step_in_episode"])
    return act.timestep_mean(t, v, ["run_id", "episode_num", "step_in_episode"]).select("run_id", "episode_num", "step_in_episode", "feature", F.round("x", 8).alias("x"))


def index_range_expand(spark: SparkSession, d: str) -> DataFrame:
    e = act.expand_index(table(spark, d, "activation_index").dropDuplicates(["index_id"]))
    return e.groupBy("run_id", "layer_idx", "episode_num").agg(F.count(F.lit(1)).alias("n_rows"), F.max("token_idx").alias("last_token"), F.sum(F.col("row_idx").cast("long")).alias("row_sum"))


def interval_contiguity(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "activation_index").withColumn("path", normal_path(F.col("shard_path"))).filter(F.col("path").isNotNull())
    return act.interval_breaks(i, ["path"]).select("path", "intervals", "breaks", "num_rows")


def forward_renumber(spark: SparkSession, d: str) -> DataFrame:
    return mg.renumber_forwards(table(spark, d, "activation_index"))


def _grasps(spark: SparkSession, d: str) -> DataFrame:
    """Grasped while the gripper command is negative; the height is that of the end effector."""
    s = _steps(spark, d)
    g, z = F.col("gripper_action"), F.col("eef_pos")[2]
    return s.select("run_id", "episode_num", "step", F.when(F.isnan(g), F.lit(None)).otherwise(g < 0).alias("grasped"), F.when(~F.isnan(z), z).alias("z"))


def release_trigger(spark: SparkSession, d: str) -> DataFrame:
    return ctl.release_triggers(_grasps(spark, d), tr.KEY)


def detach_tracker(spark: SparkSession, d: str) -> DataFrame:
    return ctl.detachments(ctl.grasp_transitions(_grasps(spark, d), tr.KEY), tr.KEY)


def pair_quota(spark: SparkSession, d: str) -> DataFrame:
    """Attempts are a task's trials, each with its latest prompt; primary ones are short."""
    p = _prompts(spark, d).filter(F.col("task_episode_idx").isNotNull() & F.col("task_id").isNotNull())
    one = p.groupBy("task_id", F.col("task_episode_idx").alias("attempt")).agg(F.max(F.struct("registered_at", "run_id", "episode_num", "success", "num_actions")).alias("r"))
    ok = F.coalesce(F.col("r.success"), F.lit(False))
    a = one.select("task_id", "attempt", F.col("r.num_actions").isNotNull().alias("eligible"), ok.alias("valid"), F.coalesce(ok & (F.col("r.num_actions") < 150), F.lit(False)).alias("primary"))
    return ctl.quota_summary(a, target_valid=2, target_primary=1)


def condition_summary(spark: SparkSession, d: str) -> DataFrame:
    p = _prompts(spark, d).select(F.when(F.col("episode_num") % 2 == 0, "forced").otherwise("normal").alias("condition"), F.coalesce("success", F.lit(False)).alias("success"))
    c = ctl.condition_summary(p, ["normal", "forced", "replay"])
    return c.withColumn("success_rate", F.round("success_rate", 6))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """The two replay copies side by side: one row per (entity, step)."""
    r, c = (table(spark, d, f"replay_{x}") for x in ("reference", "current"))
    cols = ["qpos", "qvel", "control_state_sha256", "reward", "done"]

    def side(t: DataFrame, p: str) -> DataFrame:
        m = t.groupBy(F.col("pair_id").alias("entity"), F.col("sample_step").alias("step")).agg(F.max_by(F.struct(*cols), "written_at").alias("r"))
        wide = lambda x: F.transform(f"r.{x}", lambda v: v.cast("double")).alias(f"{p}_{x}")
        return m.select("entity", "step", wide("qpos"), wide("qvel"), digest(F.col("r.control_state_sha256")).alias(f"{p}_hash"), F.lit(True).alias(f"{p}_here"))

    return side(r, "a").join(side(c, "b"), ["entity", "step"], "full_outer")


def action_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Every step counts; one without a vector, in a copy that has the step, can't be compared."""
    side = lambda p: F.when(F.col(f"{p}_here"), F.coalesce(f"{p}_qvel", F.array(F.lit(None).cast("double")))).alias(p)
    r = ctl.action_divergence(_pairs(spark, d).select("entity", "step", side("a"), side("b")))
    return r.select("entity", "raw_steps", "condition_steps", "first_changed_step", F.round("max_abs_delta", 6).alias("max_abs_delta"), F.round("mean_abs_delta", 6).alias("mean_abs_delta"))


def prefix_compare(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).filter("a_here and b_here")
    far = lambda c: max_abs_delta(F.col(f"a_{c}"), F.col(f"b_{c}")) > 1e-6
    return ctl.prefix_comparison(p, [("pre_qpos", far("qpos")), ("pre_qvel", far("qvel")), ("state_hash", ~F.col("a_hash").eqNullSafe(F.col("b_hash")))])


def max_abs_deltas(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).filter("a_here and b_here").select("entity", "step", max_abs_delta(F.col("a_qpos"), F.col("b_qpos")).alias("x"))
    return p.groupBy("entity").agg(F.count_if(F.col("x") == float("inf")).alias("not_comparable"), F.round(F.max(F.when(F.col("x") < float("inf"), F.col("x"))), 6).alias("max_delta"))


def delta_success(spark: SparkSession, d: str) -> DataFrame:
    """Success rate of each backbone against that of all episodes."""
    runs = table(spark, d, "run_registry").select("run_id", "backbone").dropDuplicates(["run_id"])
    e = _prompts(spark, d).join(runs, "run_id").select("backbone", F.coalesce("success", F.lit(False)).cast("int").alias("s"))
    base = F.broadcast(e.agg(F.avg("s").alias("base")))  # one row
    r = e.groupBy("backbone").agg(F.count(F.lit(1)).alias("episodes"), F.avg("s").alias("rate")).join(base)
    return r.select("backbone", "episodes", F.round("rate", 6).alias("success_rate"), F.round(F.col("rate") - F.col("base"), 6).alias("delta"))


def merge_rekey(spark: SparkSession, d: str) -> DataFrame:
    runs = mg.ordered_runs(table(spark, d, "run_registry"))
    k = mg.rekey(_prompts(spark, d).select("run_id", "episode_num", "task_id", "task_episode_idx"), runs, TRIALS)
    seed = pair_seed(7, F.col("task_id"), F.col("task_episode_idx"))
    return k.select("run_id", "source_run_idx", "source_episode_num", F.col("episode_num").cast("long").alias("episode_num"), seed.cast("long").alias("pair_seed"), pair_id(F.lit("suite"), F.col("task_id"), F.col("task_episode_idx"), seed).alias("pair_id"))


def merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Merged episode numbers that more than one source episode claims."""
    return mg.duplicates(merge_rekey(spark, d), ["episode_num"])


def merge_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of the trajectories against the prompts: unknown, or at odds over the task."""
    r = mg.strict_lookup(_episodes(spark, d), _prompts(spark, d), tr.KEY, ["task_id", "task_episode_idx"])
    return r.groupBy(F.coalesce("reason", F.lit("joined")).alias("reason")).agg(F.count(F.lit(1)).alias("episodes"))


def inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "shard_registry").groupBy(normal_path(F.col("shard_path")).alias("path")).agg(F.max("num_rows").alias("size"))
    idx = table(spark, d, "activation_index").groupBy("shard_path").agg(F.max("row_end").alias("n")).groupBy(normal_path(F.col("shard_path")).alias("path")).agg(F.max("n").cast("long").alias("size")).filter("path is not null")
    return mg.inventory_diff(reg, idx).select("path", "problem", "expected_size", "actual_size")


def key_set_equality(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "prompt_records").select(*tr.KEY)
    b = table(spark, d, "activation_index").select(*tr.KEY).filter("episode_num is not null and episode_num <> -1")
    return mg.key_differences(a, b, tr.KEY)


def zip_alignment(spark: SparkSession, d: str) -> DataFrame:
    return mg.zip_alignment(_prompts(spark, d), _episodes(spark, d), "run_id", "episode_num", ["episode_num", "task_id"])


def labels_and_ids(spark: SparkSession, d: str) -> DataFrame:
    p = _prompts(spark, d).filter("task_id is not null and task_description is not null and num_actions is not null")
    return p.select("run_id", "episode_num", label(F.col("task_description"), 20).alias("label"), sample_id(F.col("episode_num"), F.col("task_id"), F.lit(1), F.col("num_actions"), label(F.col("task_description"), 20)).alias("sample_id"), number_tag(F.col("num_actions") / 1000).alias("tag"))


def forced_actions(spark: SparkSession, d: str) -> DataFrame:
    """Every replay velocity with its last dimension forced: elements, those that are no numbers, and the sum of the others. A vector without elements has none to force."""
    v = F.when(F.size("qvel") > 0, replace_last(F.col("qvel"), F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    r = table(spark, d, "replay_reference").select("pair_id", "sample_step", v.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x)
    total = F.aggregate(F.filter("v", lambda x: ~bad(x)), F.lit(0.0), lambda a, x: a + x)
    return r.select("pair_id", "sample_step", F.size("v").alias("elements"), F.size(F.filter("v", bad)).alias("no_numbers"), F.round(total, 5).alias("total")).distinct()


def contact_classes(spark: SparkSession, d: str) -> DataFrame:
    """Contacts by the kinds of their owners. What an owner is stands in its node, where it stands in the bridge."""
    nodes, bridge = nested.tables(table(spark, d, "telemetry_snapshots"))
    named = nodes.filter("kind = 'contact_owner'").select("salt", F.col("node_hash").alias("child_hash"), F.regexp_replace("content", '^"|"$', "").alias("owner"))
    o = bridge.join(named, ["salt", "child_hash"]).select("snapshot_id", "parent_key", "owner").distinct()
    c = o.groupBy("snapshot_id", "parent_key").agg(F.collect_set("owner").alias("owners"))  # the owners of one contact
    k = contact_class(F.col("owners"))
    return c.select(k.alias("semantic_class"), may_collide(k).alias("collision_candidate")).groupBy("semantic_class", "collision_candidate").agg(F.count(F.lit(1)).alias("contacts"))


def _violations(name: str, rules: tuple[con.Constraint, ...]):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return con.check_rows(table(spark, d, name), rules)

    return query


def violations_keys(spark: SparkSession, d: str) -> DataFrame:
    """Query constraints: duplicates, unmatched keys, gaps, broken intervals."""
    ep = cut(_episodes(spark, d))
    prompts = _prompts(spark, d)
    parts = [
        con.check_query("prompt_lifetimes_unique", mg.duplicates(table(spark, d, "prompt_records").select("run_id", "episode_num").distinct(), tr.KEY)),
        con.check_query("episodes_have_prompts", ep.join(prompts, tr.KEY, "left_anti")),
        con.check_query("prompts_have_episodes", prompts.join(ep, tr.KEY, "left_anti")),
        con.check_query("index_ids_unique", mg.duplicates(table(spark, d, "activation_index").distinct(), ["index_id"])),
        con.check_query("steps_contiguous", step_contiguity(spark, d).filter("not contiguous")),
        con.check_query("success_means_done", ep.join(prompts.select(*tr.KEY, F.col("success").alias("stated")), tr.KEY).filter("success <> stated")),
    ]
    return con.check_all(parts)


def success_steps(spark: SparkSession, d: str) -> DataFrame:
    """First done step of each episode that has one, and steps recorded after it."""
    s = _steps(spark, d)
    f = s.filter("done").groupBy(*tr.KEY).agg(F.min("step").alias("success_step"))
    return s.join(f, tr.KEY).groupBy(*tr.KEY, "success_step").agg(F.count_if(F.col("step") > F.col("success_step")).alias("steps_after"))


def neighbour_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between neighbouring recorded steps, by length."""
    n = with_neighbour(_steps(spark, d).select(*tr.KEY, "step"), tr.KEY, "step", [])
    return n.filter(F.col("prev_step").isNotNull()).groupBy((F.col("step") - F.col("prev_step")).cast("long").alias("gap")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (episode_assembly, episode_filter_head, missing_gripper_inputs, gripper_toggle, step_contiguity, success_rate_rollup, eef_speed, quat_delta_velocity, keyframes, keyframe_totals, topk_timestep_mean, index_range_expand, interval_contiguity, forward_renumber, release_trigger, detach_tracker, pair_quota, condition_summary, action_divergence, prefix_compare, max_abs_deltas, delta_success, merge_rekey, merge_duplicates, merge_lookup, inventory_diff, key_set_equality, zip_alignment, labels_and_ids, forced_actions, contact_classes, violations_keys, success_steps, neighbour_gaps)
}
QUERIES |= {f"effective_steps_{n}": _effective(m) for n, m in (("inference", "inference_step"), ("action", "action_executed"), ("chunk", "chunk_executed"))}
QUERIES |= {
    "violations_trajectory": _violations("trajectory_records", con.TRAJECTORY),
    "violations_index": _violations("activation_index", con.INDEX),
    "violations_prompts": _violations("prompt_records", con.PROMPTS),
    "violations_topk": _violations("topk_rows", con.TOPK),
    "violations_replay": _violations("replay_reference", con.REPLAY),
}

_TRAJ = """
WITH steps AS (SELECT run_id, episode_num, step_in_episode AS step, task_id, task_episode_idx, task_description, eef_pos, gripper_qpos, gripper_action, done
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, episode_num, step_in_episode ORDER BY logged_at DESC NULLS LAST) AS rn FROM trajectory_records) WHERE rn = 1),
eps AS (SELECT run_id, episode_num, arg_min(task_id, step) AS task_id, arg_min(task_episode_idx, step) AS task_episode_idx,
    first(task_description ORDER BY step) AS task_description, coalesce(last(done ORDER BY step), false) AS success, count(*) AS num_steps,
    min(step) AS first_step, max(step) AS last_step, count(eef_pos) AS num_positions, bool_and(gripper_qpos IS NOT NULL) AS has_gripper FROM steps GROUP BY ALL),
prompts AS (SELECT run_id, episode_num, task_id, task_episode_idx, task_description, initial_state_sha256, success, num_actions, registered_at
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, episode_num ORDER BY registered_at DESC NULLS LAST, deleted_at DESC NULLS LAST) AS rn FROM prompt_records) WHERE rn = 1),
vel0 AS (SELECT run_id, episode_num, step, eef_pos AS p, lag(eef_pos) OVER e AS q, (step - lag(step) OVER e) * 0.05 AS dt FROM steps WHERE eef_pos IS NOT NULL WINDOW e AS (PARTITION BY run_id, episode_num ORDER BY step)),
grasp AS (SELECT run_id, episode_num, step, coalesce(NOT isnan(gripper_action) AND gripper_action < 0, false) AS g, CASE WHEN NOT isnan(eef_pos[3]) THEN eef_pos[3] END AS z FROM steps),
g1 AS (SELECT *, z - first(z) OVER e AS rise, row_number() OVER e AS idx, lag(g) OVER e AS pg, sum(CASE WHEN g THEN 0 ELSE 1 END) OVER e AS island FROM grasp WINDOW e AS (PARTITION BY run_id, episode_num ORDER BY step)),
g2 AS (SELECT *, coalesce(rise >= 0.01, false) AS up, CASE WHEN g THEN row_number() OVER (PARTITION BY run_id, episode_num, island, g ORDER BY step) ELSE 0 END AS streak FROM g1),
g3 AS (SELECT *, g AND up AND streak >= 3 AS el FROM g2),
g4 AS (SELECT *, sum(CASE WHEN el THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, episode_num ORDER BY step) AS ei FROM g3),
g5 AS (SELECT *, min(CASE WHEN el THEN step END) OVER (PARTITION BY run_id, episode_num, ei) AS since, min(CASE WHEN g THEN step END) OVER i AS t_grasp,
    min(CASE WHEN streak = 3 THEN step END) OVER i AS t_stable, min(CASE WHEN g AND up THEN step END) OVER i AS t_lift FROM g4 WINDOW i AS (PARTITION BY run_id, episode_num, island)),
fires AS (SELECT run_id, episode_num, min(step) AS step FROM g5 WHERE el AND step - since >= 2 GROUP BY ALL),
d1 AS (SELECT run_id, episode_num, step, coalesce(pg, false) AS pre, g AS post, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, episode_num ORDER BY step) AS island FROM g1),
d2 AS (SELECT *, row_number() OVER (PARTITION BY run_id, episode_num, island ORDER BY step) AS rn FROM d1 WHERE NOT post),
cand AS (SELECT run_id, episode_num, island, min(step) AS t_detach, min(rn) AS rn FROM d2 WHERE pre GROUP BY ALL),
conf AS (SELECT c.run_id, c.episode_num, c.t_detach, d.step AS confirmed FROM cand c JOIN d2 d ON c.run_id = d.run_id AND c.episode_num = d.episode_num AND c.island = d.island AND d.rn = c.rn + 2)
"""
_PAIRS = """
WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, sample_step ORDER BY written_at DESC) AS rn FROM replay_reference) WHERE rn = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, sample_step ORDER BY written_at DESC) AS rn FROM replay_current) WHERE rn = 1),
p AS (SELECT coalesce(r.pair_id, c.pair_id) AS entity, coalesce(r.sample_step, c.sample_step) AS step, CAST(r.qpos AS DOUBLE[]) AS qa, CAST(c.qpos AS DOUBLE[]) AS qb, CAST(r.qvel AS DOUBLE[]) AS va, CAST(c.qvel AS DOUBLE[]) AS vb,
    DIGEST_A AS ha, DIGEST_B AS hb, r.pair_id IS NOT NULL AS in_a, c.pair_id IS NOT NULL AS in_b FROM r FULL JOIN c ON r.pair_id = c.pair_id AND r.sample_step = c.sample_step)
""".replace("DIGEST_A", "regexp_replace(lower(trim(r.control_state_sha256)), '^sha256:', '')").replace("DIGEST_B", "regexp_replace(lower(trim(c.control_state_sha256)), '^sha256:', '')")


def _far(a: str, b: str) -> str:
    """Greatest absolute difference, infinite where the vectors can't be compared."""
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR len({a}) <> len({b}) THEN CAST('inf' AS DOUBLE) ELSE coalesce(list_max(list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN ({a})[i] IS NULL OR ({b})[i] IS NULL OR isnan(({a})[i] - ({b})[i]) THEN CAST('inf' AS DOUBLE) ELSE abs(({a})[i] - ({b})[i]) END)), 0) END"


def _counted(rules: tuple[con.Constraint, ...], name: str, sql: dict[str, str]) -> str:
    one = "UNION ALL ".join(f"SELECT '{r.name}' AS \"constraint\", count(*) FILTER (NOT coalesce({sql[r.name]}, false)) AS violations, count(*) AS checked FROM {name} " for r in rules)
    return one


_NUM = "len({c}) = {n} AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_SQL_RULES = {
    "eef_pos_is_3_finite": _NUM.format(c="eef_pos", n=3),
    "gripper_qpos_is_2_finite": _NUM.format(c="gripper_qpos", n=2),
    "gripper_action_finite": "gripper_action IS NOT NULL AND NOT isnan(gripper_action)",
    "gripper_action_in_range": "NOT isnan(gripper_action) AND gripper_action BETWEEN -1.5 AND 1.5",
    "step_not_negative": "step_in_episode >= 0",
    "described": "trim(task_description) <> ''",
    "logged_after_step": "logged_at >= step_at",
    "range_not_empty": "row_end > row_start AND row_start >= 0",
    "forward_positive": "global_forward_idx > 0",
    "episode_named": "episode_num IS NOT NULL AND episode_num <> -1",
    "shard_named": "trim(shard_path) <> ''",
    "initial_state_hash": "regexp_full_match(initial_state_sha256, '[0-9a-f]{64}')",
    "actions_not_negative": "num_actions >= 0",
    "outcome_known": "success IS NOT NULL",
    "lifetime_in_order": "deleted_at IS NULL OR deleted_at > registered_at",
    "prompt_matches_task": "lower(trim(prompt_task_description)) = lower(trim(task_description))",
    "ids_and_values_pair": "len(top_feature_ids) = len(top_feature_vals)",
    "values_finite": "top_feature_vals IS NOT NULL AND len(list_filter(top_feature_vals, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0",
    "ids_not_negative": "CASE WHEN len(list_filter(top_feature_ids, lambda x: x < 0)) > 0 THEN false WHEN len(list_filter(top_feature_ids, lambda x: x IS NULL)) > 0 THEN NULL ELSE top_feature_ids IS NOT NULL END",
    "ids_distinct": "len(list_distinct(top_feature_ids)) + CASE WHEN len(list_filter(top_feature_ids, lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END = len(top_feature_ids)",
    "chunk_sentinels_agree": "(chunk_start_step = -1) = (executed_chunk_len = -1)",
    "qpos_is_9_finite": "len(qpos) = 9 AND len(list_filter(qpos, lambda x: x IS NULL OR isnan(x))) = 0",
    "qvel_is_9_finite": "len(qvel) = 9 AND len(list_filter(qvel, lambda x: x IS NULL OR isnan(x))) = 0",
    "state_hash": "regexp_full_match(control_state_sha256, '[0-9a-f]{64}')",
    "reward_in_unit": "NOT isnan(reward) AND reward BETWEEN 0 AND 1",
    "done_known": "done IS NOT NULL",
}
_EFF = {
    "inference": "SELECT run_id, episode_num, step_in_episode AS step FROM topk_rows WHERE step_in_episode >= 0",
    "action": "SELECT run_id, episode_num, chunk_start_step + token_idx AS step FROM topk_rows WHERE chunk_start_step >= 0 AND executed_chunk_len > 0 AND token_idx >= 0 AND token_idx < executed_chunk_len",
    "chunk": "SELECT run_id, episode_num, chunk_start_step + unnest(range(executed_chunk_len)) AS step FROM topk_rows WHERE chunk_start_step >= 0 AND executed_chunk_len > 0",
}
_LABEL = "substr(coalesce(nullif(trim(regexp_replace(task_description, '[^a-zA-Z0-9]+', '_', 'g'), '_'), ''), 'unnamed'), 1, 20)"
_P = _general_path
_W = "CASE WHEN {n} < 1e-12 THEN 0 ELSE 2 * atan2({n}, least(greatest({s}, -1), 1)) / dt END"

ORACLE = {
    "episode_assembly": _TRAJ + "SELECT run_id, episode_num, task_id, task_episode_idx, task_description, success, num_steps, first_step, last_step, num_positions, has_gripper FROM eps",
    "episode_filter_head": _TRAJ + "SELECT run_id, episode_num, task_id, num_steps FROM eps WHERE num_positions >= 2 AND success ORDER BY episode_num, task_id, task_episode_idx, run_id LIMIT 20",
    "missing_gripper_inputs": _TRAJ + "SELECT run_id, episode_num, step FROM steps WHERE gripper_qpos IS NULL ORDER BY 1, 2, 3 LIMIT 10",
    "gripper_toggle": _TRAJ + "SELECT run_id, episode_num, step, CAST(c AS INTEGER) AS command, n AS next_step FROM (SELECT run_id, episode_num, step, CASE WHEN gripper_action > 0 THEN 1 ELSE -1 END AS c, lead(step) OVER e AS n, lead(CASE WHEN gripper_action > 0 THEN 1 ELSE -1 END) OVER e AS nc FROM steps WHERE gripper_action IS NOT NULL AND NOT isnan(gripper_action) WINDOW e AS (PARTITION BY run_id, episode_num ORDER BY step)) WHERE nc <> c",
    "step_contiguity": _TRAJ + "SELECT run_id, episode_num, num_steps, first_step, last_step, last_step - first_step + 1 - num_steps AS missing_steps, first_step = 0 AND last_step = num_steps - 1 AS contiguous FROM eps",
    "success_rate_rollup": _TRAJ + "SELECT CASE WHEN grouping(task_id) = 1 THEN -1 ELSE coalesce(task_id, -1) END AS task_id, count(*) AS episodes, count(*) FILTER (success) AS successes, round(count(*) FILTER (success) / count(*), 6) AS success_rate FROM eps GROUP BY ROLLUP (task_id)",
    "eef_speed": _TRAJ + "SELECT run_id, episode_num, round(max(CASE WHEN q IS NOT NULL THEN sqrt((p[1]-q[1])**2 + (p[2]-q[2])**2 + (p[3]-q[3])**2) / dt END), 4) AS max_speed, count(q) AS n_steps FROM vel0 GROUP BY ALL",
    "quat_delta_velocity": _TRAJ + """, qn AS (SELECT *, sqrt(1 + q[1]**2 + q[2]**2 + q[3]**2) AS nq, sqrt(1 + p[1]**2 + p[2]**2 + p[3]**2) AS np FROM vel0 WHERE q IS NOT NULL),
      qd AS (SELECT *, (-q[1]*1 + p[1]*1 - p[2]*q[3] + p[3]*q[2]) / (nq*np) AS x, (-q[2] + p[2] + p[1]*q[3] - p[3]*q[1]) / (nq*np) AS y, (-q[3] + p[3] - p[1]*q[2] + p[2]*q[1]) / (nq*np) AS z, (1 + p[1]*q[1] + p[2]*q[2] + p[3]*q[3]) / (nq*np) AS s FROM qn)
      SELECT run_id, episode_num, step, round(""" + _W.format(n="sqrt(x*x + y*y + z*z)", s="s") + ", 4) AS angular_speed FROM qd",
    "topk_timestep_mean": "WITH n AS (SELECT run_id, episode_num, step_in_episode, count(*) AS n FROM topk_rows GROUP BY ALL), l AS (SELECT run_id, episode_num, step_in_episode, unnest(top_feature_ids[:least(len(top_feature_ids), len(top_feature_vals))]) AS feature, unnest(top_feature_vals[:least(len(top_feature_ids), len(top_feature_vals))]) AS v FROM topk_rows) SELECT run_id, episode_num, step_in_episode, feature, round(sum(CAST(v AS DOUBLE)) / any_value(n), 8) AS x FROM l JOIN n USING (run_id, episode_num, step_in_episode) WHERE feature IS NOT NULL AND v IS NOT NULL GROUP BY run_id, episode_num, step_in_episode, feature",
    "index_range_expand": "WITH i AS (SELECT DISTINCT * FROM activation_index WHERE row_end > row_start) SELECT run_id, layer_idx, coalesce(episode_num, 0) AS episode_num, CAST(sum(row_end - row_start) AS BIGINT) AS n_rows, CAST(max(row_end - row_start - 1) AS INTEGER) AS last_token, CAST(sum((row_start + row_end - 1) * (row_end - row_start) // 2) AS BIGINT) AS row_sum FROM i GROUP BY run_id, layer_idx, coalesce(episode_num, 0)",
    "interval_contiguity": f"WITH i AS (SELECT DISTINCT {_P('shard_path')} AS path, row_start, row_end FROM activation_index) SELECT path, count(*) AS intervals, count(*) FILTER (row_start <> 0 AND NOT EXISTS (SELECT 1 FROM i b WHERE b.path = i.path AND b.row_end = i.row_start)) AS breaks, max(row_end) AS num_rows FROM i WHERE path IS NOT NULL GROUP BY path",
    "forward_renumber": "WITH f AS (SELECT run_id, global_forward_idx, min((coalesce(shard_path, ''), row_start)) AS first FROM activation_index WHERE global_forward_idx > 0 GROUP BY ALL) SELECT run_id, global_forward_idx, row_number() OVER (ORDER BY run_id, first, global_forward_idx) AS new_forward_idx FROM f",
    "release_trigger": _TRAJ + "SELECT e.run_id, e.episode_num, g.step AS trigger_step, t_grasp, t_stable AS t_stable_grasp, t_lift FROM eps e LEFT JOIN (SELECT g5.* FROM g5 JOIN fires USING (run_id, episode_num, step)) g ON e.run_id = g.run_id AND e.episode_num = g.episode_num",
    "detach_tracker": _TRAJ + "SELECT e.run_id, e.episode_num, arg_min(t_detach, confirmed) AS t_detach, min(confirmed) AS t_detach_confirmed FROM eps e LEFT JOIN conf c ON e.run_id = c.run_id AND e.episode_num = c.episode_num GROUP BY ALL",
    "pair_quota": _TRAJ + """, a0 AS (SELECT *, row_number() OVER (PARTITION BY task_id, task_episode_idx ORDER BY registered_at DESC, run_id DESC, episode_num DESC) AS rn FROM prompts WHERE task_id IS NOT NULL AND task_episode_idx IS NOT NULL),
      a AS (SELECT task_id, task_episode_idx AS attempt, num_actions IS NOT NULL AS el, coalesce(success, false) AS v, coalesce(success AND num_actions < 150, false) AS p FROM a0 WHERE rn = 1),
      r AS (SELECT *, sum(v::INT) OVER t AS nv, sum(p::INT) OVER t AS np FROM a WINDOW t AS (PARTITION BY task_id ORDER BY attempt))
      SELECT task_id, count(*) AS attempts, count(*) FILTER (el) AS eligible_pairs, count(*) FILTER (el AND v) AS valid_pairs, count(*) FILTER (el AND NOT v) AS invalid_pairs, count(*) FILTER (NOT el) AS ineligible_pairs, count(*) FILTER (p) AS primary_pairs,
        min(attempt) FILTER (nv >= 2 AND np >= 1) AS met_at, max(attempt) AS last_attempt, min(attempt) FILTER (nv >= 2 AND np >= 1) IS NOT NULL AS target_reached, coalesce(min(attempt) FILTER (nv >= 2 AND np >= 1) < max(attempt), false) AS stopped_late FROM r GROUP BY task_id""",
    "condition_summary": _TRAJ + "SELECT d.condition, count(p.run_id) AS episodes, count(*) FILTER (coalesce(p.success, false)) AS successes, count(p.run_id) - count(*) FILTER (coalesce(p.success, false)) AS failures, round(CASE WHEN count(p.run_id) > 0 THEN count(*) FILTER (coalesce(p.success, false)) / count(p.run_id) ELSE 0 END, 6) AS success_rate FROM (VALUES ('normal'), ('forced'), ('replay')) d(condition) LEFT JOIN prompts p ON d.condition = CASE WHEN p.episode_num % 2 = 0 THEN 'forced' ELSE 'normal' END GROUP BY d.condition",
    "action_divergence": _PAIRS + f""", q AS (SELECT entity, step, in_a, in_b, va, CASE WHEN in_a AND in_b THEN {_far("va", "vb")} END AS m, CASE WHEN in_a AND in_b THEN list_sum(list_transform(range(1, least(len(va), len(vb)) + 1), lambda i: abs(va[i] - vb[i]))) END AS t FROM p)
      SELECT entity, count(*) FILTER (in_a) AS raw_steps, count(*) FILTER (in_b) AS condition_steps, CAST(coalesce(min(step) FILTER (m > 1e-6), CASE WHEN count(*) FILTER (in_a) <> count(*) FILTER (in_b) THEN count(*) FILTER (in_a AND in_b) END) AS BIGINT) AS first_changed_step, round(coalesce(max(m), 0), 6) AS max_abs_delta, round(coalesce(sum(t) FILTER (NOT isinf(m)) / nullif(sum(len(va)) FILTER (NOT isinf(m)), 0), 0), 6) AS mean_abs_delta FROM q GROUP BY entity""",
    "prefix_compare": _PAIRS + f""", f AS (SELECT entity, step, CASE WHEN {_far("qa", "qb")} > 1e-6 THEN 'pre_qpos' WHEN {_far("va", "vb")} > 1e-6 THEN 'pre_qvel' WHEN ha IS DISTINCT FROM hb THEN 'state_hash' END AS field FROM p WHERE in_a AND in_b)
      SELECT entity, count(*) AS steps_compared, min(step) FILTER (field IS NOT NULL) AS first_mismatch_step, arg_min(field, step) FILTER (field IS NOT NULL) AS mismatch_field FROM f GROUP BY entity""",
    "max_abs_deltas": _PAIRS + f", f AS (SELECT entity, {_far('qa', 'qb')} AS x FROM p WHERE in_a AND in_b) SELECT entity, count(*) FILTER (isinf(x)) AS not_comparable, round(max(x) FILTER (NOT isinf(x)), 6) AS max_delta FROM f GROUP BY entity",
    "delta_success": _TRAJ + ", e AS (SELECT backbone, coalesce(success, false)::INT AS s FROM prompts JOIN (SELECT DISTINCT run_id, backbone FROM run_registry) USING (run_id)) SELECT backbone, count(*) AS episodes, round(avg(s), 6) AS success_rate, round(avg(s) - (SELECT avg(s) FROM e), 6) AS delta FROM e GROUP BY backbone",
    "merge_rekey": _TRAJ + ", r AS (SELECT run_id, CAST(row_number() OVER (ORDER BY run_id) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT run_id FROM run_registry)) SELECT run_id, i AS source_run_idx, episode_num AS source_episode_num, CAST(task_id * 1000 + task_episode_idx + 1 AS BIGINT) AS episode_num, CAST(7 + task_id * 10000 + task_episode_idx AS BIGINT) AS pair_seed, printf('suite-task%02d-trial%03d-seed%d', task_id, task_episode_idx, 7 + task_id * 10000 + task_episode_idx) AS pair_id FROM prompts JOIN r USING (run_id)",
    "merge_duplicates": _TRAJ + "SELECT CAST(task_id * 1000 + task_episode_idx + 1 AS BIGINT) AS episode_num, count(*) AS n FROM prompts WHERE run_id IN (SELECT run_id FROM run_registry) GROUP BY 1 HAVING count(*) > 1",
    "merge_lookup": _TRAJ + "SELECT CASE WHEN p.run_id IS NULL THEN 'unknown_key' WHEN e.task_id IS DISTINCT FROM p.task_id THEN 'mismatch:task_id' WHEN e.task_episode_idx IS DISTINCT FROM p.task_episode_idx THEN 'mismatch:task_episode_idx' ELSE 'joined' END AS reason, count(*) AS episodes FROM eps e LEFT JOIN prompts p ON e.run_id = p.run_id AND e.episode_num = p.episode_num GROUP BY 1",
    "inventory_diff": f"WITH e AS (SELECT {_P('shard_path')} AS path, max(num_rows) AS size FROM shard_registry GROUP BY 1), a AS (SELECT {_P('shard_path')} AS path, CAST(max(row_end) AS BIGINT) AS size FROM activation_index GROUP BY 1) SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.size IS NULL THEN 'missing' WHEN e.size IS NULL THEN 'unexpected' ELSE 'wrong_size' END AS problem, e.size AS expected_size, a.size AS actual_size FROM e FULL JOIN (SELECT * FROM a WHERE path IS NOT NULL) a ON e.path = a.path WHERE e.size IS DISTINCT FROM a.size",
    "key_set_equality": "WITH a AS (SELECT DISTINCT run_id, episode_num FROM prompt_records), b AS (SELECT DISTINCT run_id, episode_num FROM activation_index WHERE episode_num IS NOT NULL AND episode_num <> -1) (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))",
    "zip_alignment": _TRAJ + ", l AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY episode_num) AS n, episode_num, task_id FROM prompts), r AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY episode_num) AS n, episode_num, task_id FROM eps), j AS (SELECT coalesce(l.run_id, r.run_id) AS run_id, coalesce(l.n, r.n) AS n, l.run_id IS NULL OR r.run_id IS NULL OR l.episode_num IS DISTINCT FROM r.episode_num OR l.task_id IS DISTINCT FROM r.task_id AS bad FROM l FULL JOIN r ON l.run_id = r.run_id AND l.n = r.n) SELECT run_id, count(*) AS positions, count(*) FILTER (bad) AS mismatches, min(n) FILTER (bad) AS first_mismatch FROM j GROUP BY run_id",
    "labels_and_ids": _TRAJ + f"SELECT run_id, episode_num, {_LABEL} AS label, printf('ep%04d_task%02d_wp01_step%04d_', episode_num, task_id, num_actions) || {_LABEL} AS sample_id, replace(regexp_replace(regexp_replace(printf('%.4f', num_actions / 1000.0), '0+$', ''), '\\.$', ''), '.', 'p') AS tag FROM prompts WHERE task_id IS NOT NULL AND task_description IS NOT NULL AND num_actions IS NOT NULL",
    "forced_actions": "WITH v AS (SELECT pair_id, sample_step, CASE WHEN len(qvel) > 0 THEN list_append(qvel[1:len(qvel) - 1], 1.0) ELSE [] END AS v FROM replay_reference) SELECT DISTINCT pair_id, sample_step, CAST(len(v) AS INTEGER) AS elements, CAST(len(v) - len(list_filter(v, lambda x: x IS NOT NULL AND NOT isnan(x))) AS INTEGER) AS no_numbers, round(coalesce(list_sum(list_filter(v, lambda x: x IS NOT NULL AND NOT isnan(x))), 0), 5) AS total FROM v",
    "violations_keys": _TRAJ + """SELECT 'prompt_lifetimes_unique' AS "constraint", CAST(0 AS BIGINT) AS violations, CAST(NULL AS BIGINT) AS checked
      UNION ALL SELECT 'episodes_have_prompts', count(*), NULL FROM eps ANTI JOIN prompts USING (run_id, episode_num)
      UNION ALL SELECT 'prompts_have_episodes', count(*), NULL FROM prompts ANTI JOIN eps USING (run_id, episode_num)
      UNION ALL SELECT 'index_ids_unique', count(*), NULL FROM (SELECT index_id FROM (SELECT DISTINCT * FROM activation_index) GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'steps_contiguous', count(*), NULL FROM eps WHERE NOT (first_step = 0 AND last_step = num_steps - 1)
      UNION ALL SELECT 'success_means_done', count(*), NULL FROM eps e JOIN prompts p USING (run_id, episode_num) WHERE e.success <> p.success""",
    "success_steps": _TRAJ + "SELECT s.run_id, s.episode_num, f.success_step, count(*) FILTER (s.step > f.success_step) AS steps_after FROM steps s JOIN (SELECT run_id, episode_num, min(step) AS success_step FROM steps WHERE done GROUP BY ALL) f USING (run_id, episode_num) GROUP BY ALL",
    "neighbour_gaps": _TRAJ + "SELECT gap, count(*) AS n FROM (SELECT CAST(step - lag(step) OVER (PARTITION BY run_id, episode_num ORDER BY step) AS BIGINT) AS gap FROM steps) WHERE gap IS NOT NULL GROUP BY gap",
    "violations_trajectory": _counted(con.TRAJECTORY, "trajectory_records", _SQL_RULES),
    "violations_index": _counted(con.INDEX, "activation_index", _SQL_RULES),
    "violations_prompts": _counted(con.PROMPTS, "prompt_records", _SQL_RULES),
    "violations_topk": _counted(con.TOPK, "topk_rows", _SQL_RULES),
    "violations_replay": _counted(con.REPLAY, "replay_reference", _SQL_RULES),
}

#: Whole numbers that may be missing; queries and SQL show -1 instead, since engines render missing integers differently.
_MISSING = {
    "release_trigger": ["trigger_step", "t_grasp", "t_stable_grasp", "t_lift"],
    "detach_tracker": ["t_detach", "t_detach_confirmed"],
    "pair_quota": ["met_at"],
    "action_divergence": ["first_changed_step"],
    "prefix_compare": ["first_mismatch_step"],
    "inventory_diff": ["expected_size", "actual_size"],
    "zip_alignment": ["first_mismatch"],
    "violations_keys": ["checked"],
}


def _filled(query, columns: list[str]):
    return lambda spark, d: query(spark, d).fillna(-1, columns)


QUERIES |= {n: _filled(QUERIES[n], c) for n, c in _MISSING.items()}
ORACLE |= {n: "SELECT * REPLACE (" + ", ".join(f"coalesce({x}, -1) AS {x}" for x in c) + f") FROM ({ORACLE[n]})" for n, c in _MISSING.items()}
ORACLE |= {f"effective_steps_{n}": f"SELECT run_id, episode_num, step, count(*) AS n_rows FROM ({q}) GROUP BY ALL" for n, q in _EFF.items()}
