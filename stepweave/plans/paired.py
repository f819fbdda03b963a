"""Queries that validate paired runs, stages and configurations, over pairs made from the replay tables.

A pair's times come from its number n (the last three digits of its id), and
some of them are wrong on purpose, so that every reason occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions.paths import normal_path
from stepweave.functions.vectors import replace_last
from stepweave.operators import constraints as con
from stepweave.operators import control as ctl
from stepweave.operators import merging as mg
from stepweave.operators import paired as pr
from stepweave.operators import strict as st
from stepweave.operators import trajectories as tr
from stepweave.plans import experiments as ex
from stepweave.plans import scores as so
from stepweave.plans.experiments import _PAIRS, _TRAJ, _far
from stepweave.plans.general import sql_path
from stepweave.plans.scores import _ROLES
from stepweave.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _times(pairs: DataFrame) -> DataFrame:
    """trigger_step and the release times of each pair."""
    n = F.substring("pair_id", -3, 3).cast("int")
    t = n % 4
    bump = lambda k: F.when(n % k == 0, 1).otherwise(0)
    return pairs.select("pair_id", "n" if "n" in pairs.columns else n.alias("n"), t.alias("trigger_step"), (t + bump(13)).alias("t_cmd"), F.when(n % 17 != 0, t + 1).alias("t_detach"), (t + 3 + bump(7) + 6 * bump(19)).alias("t_detach_confirmed"), F.when(n % 5 != 0, t + 2 + bump(11)).alias("t_obs"))


_TIMES = """times AS (SELECT pair_id, n, n % 4 AS trigger_step, n % 4 + CASE WHEN n % 13 = 0 THEN 1 ELSE 0 END AS t_cmd, CASE WHEN n % 17 <> 0 THEN n % 4 + 1 END AS t_detach,
    n % 4 + 3 + CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN n % 19 = 0 THEN 6 ELSE 0 END AS t_detach_confirmed, CASE WHEN n % 5 <> 0 THEN n % 4 + 2 + CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END END AS t_obs
  FROM (SELECT DISTINCT pair_id, CAST(right(pair_id, 3) AS INTEGER) AS n FROM replay_reference))"""


def _pair_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "replay_reference").select("pair_id").distinct()


@query(
    f"WITH {_TIMES} SELECT CASE WHEN t_cmd IS NULL OR t_detach IS NULL OR t_detach_confirmed IS NULL THEN 'missing_times' WHEN t_cmd <> trigger_step OR t_detach < t_cmd OR t_detach_confirmed < t_detach THEN 'wrong_order' WHEN t_detach_confirmed - t_cmd + 1 > 8 THEN 'too_long' WHEN t_detach_confirmed <> t_detach + 2 THEN 'confirmation_window' WHEN t_obs <> t_detach + 1 THEN 'late_observation' ELSE 'sound' END AS reason, count(*) AS records FROM times GROUP BY 1"
)
def violations_release_times(spark: SparkSession, d: str) -> DataFrame:
    return st.by_reason(_times(_pair_ids(spark, d)).withColumn("reason", pr.release_time_reason()), kept="sound")


def _actions(spark: SparkSession, d: str) -> DataFrame:
    """Action rows of both conditions: the reference as the policy, the current copy as what was carried out."""
    p = ex._pairs(spark, d).filter("a_here and b_here").withColumnRenamed("entity", "pair_id")
    j = p.join(_times(_pair_ids(spark, d)).filter("t_detach is not null"), "pair_id")
    due = F.col("step").between(F.col("t_cmd"), F.col("t_detach_confirmed"))
    normal = j.select("pair_id", "t_cmd", "t_detach_confirmed", "step", F.lit("normal").alias("condition"), F.col("a_qvel").alias("policy"), F.col("a_qvel").alias("executed"), (F.col("n") % 23 == 0).alias("applied"), F.when(F.col("n") % 29 == 0, "other").otherwise(pr.NONE).alias("kind"), F.when(F.col("n") % 31 != 0, pr.OBSERVED).alias("source"))
    moved = F.when(due & (F.col("n") % 3 != 0) & (F.size("b_qvel") > 0), replace_last(F.col("b_qvel"), F.lit(-1.0))).otherwise(F.col("b_qvel"))
    source = F.when(F.col("n") % 37 == 0, pr.OBSERVED).when(F.col("step") <= F.col("t_cmd"), pr.REPLAYED).otherwise(pr.OBSERVED)
    forced = j.select("pair_id", "t_cmd", "t_detach_confirmed", "step", F.lit("forced").alias("condition"), F.col("a_qvel").alias("policy"), moved.alias("executed"), (due & ((F.col("n") % 41 != 0) | (F.col("step") > F.col("t_cmd")))).alias("applied"), F.when(F.col("n") % 43 != 0, pr.FORCED).alias("kind"), source.alias("source"))
    return normal.unionByName(forced)


_ACTIONS = (
    _PAIRS
    + f""", {_TIMES},
  j AS (SELECT p.*, t.n, t.t_cmd, t.t_detach_confirmed, p.step BETWEEN t.t_cmd AND t.t_detach_confirmed AS due FROM p JOIN times t ON p.entity = t.pair_id WHERE t.t_detach IS NOT NULL AND in_a AND in_b),
  act AS (SELECT entity, t_cmd, t_detach_confirmed, step, 'normal' AS condition, va AS policy, va AS executed, n % 23 = 0 AS applied, CASE WHEN n % 29 = 0 THEN 'other' ELSE 'none' END AS kind, CASE WHEN n % 31 <> 0 THEN 'observed' END AS source, due FROM j
    UNION ALL SELECT entity, t_cmd, t_detach_confirmed, step, 'forced', va, CASE WHEN due AND n % 3 <> 0 AND len(vb) > 0 THEN list_append(vb[1:len(vb) - 1], -1.0) ELSE vb END, due AND (n % 41 <> 0 OR step > t_cmd), CASE WHEN n % 43 <> 0 THEN 'forced_gripper_open' END, CASE WHEN n % 37 = 0 THEN 'observed' WHEN step <= t_cmd THEN 'normal_prefix_replay' ELSE 'observed' END, due FROM j),
  m AS (SELECT *, {_far("policy", "executed")} AS far, {_far("policy[1:len(policy) - 1]", "executed[1:len(executed) - 1]")} AS far_head FROM act)
"""
)


@query(
    _ACTIONS
    + """SELECT CASE WHEN condition = 'normal' THEN CASE WHEN NOT far <= 1e-6 THEN 'normal_modified' WHEN applied THEN 'normal_flagged' WHEN kind <> 'none' THEN 'normal_kind' WHEN source IS DISTINCT FROM 'observed' THEN 'normal_source' ELSE 'sound' END
      WHEN source <> CASE WHEN step <= t_cmd THEN 'normal_prefix_replay' ELSE 'observed' END THEN 'forced_source' WHEN kind IS DISTINCT FROM 'forced_gripper_open' THEN 'forced_kind' WHEN applied <> due THEN 'interval' WHEN applied AND NOT far_head <= 1e-6 THEN 'other_dimension' WHEN NOT applied AND NOT far <= 1e-6 THEN 'outside' ELSE 'sound' END AS reason, count(*) AS records FROM m GROUP BY 1"""
)
def violations_intervention(spark: SparkSession, d: str) -> DataFrame:
    return st.by_reason(_actions(spark, d).withColumn("reason", pr.action_reason()), kept="sound")


@query(_ACTIONS + "SELECT entity AS pair_id FROM m GROUP BY entity, t_cmd, t_detach_confirmed HAVING min(CASE WHEN condition <> 'normal' AND applied THEN step END) IS DISTINCT FROM t_cmd OR max(CASE WHEN condition <> 'normal' AND applied THEN step END) IS DISTINCT FROM t_detach_confirmed")
def incomplete_interventions(spark: SparkSession, d: str) -> DataFrame:
    return pr.incomplete_intervals(_actions(spark, d)).select("pair_id")


@query(
    _TRAJ
    + """, det AS (SELECT run_id, episode_num, arg_min(t_detach, confirmed) AS t_detach, min(confirmed) AS t_sure FROM conf GROUP BY ALL)
    SELECT CASE WHEN episode_num % 7 = 0 THEN 'wrong_t_detach' WHEN episode_num % 5 = 0 THEN 'wrong_t_detach_confirmed' ELSE 'sound' END AS reason, count(*) AS records FROM det GROUP BY 1"""
)
def violations_detach(spark: SparkSession, d: str) -> DataFrame:
    """Recorded times, some of them off by one, against the raw steps."""
    t = ctl.detachments(ctl.grasp_transitions(ex._grasps(spark, d), tr.KEY), tr.KEY).filter("t_detach is not null")
    off = lambda c, k: (F.col(c) + F.when(F.col("episode_num") % k == 0, 1).otherwise(0)).alias(c)
    recorded = t.select(*tr.KEY, off("t_detach", 7), off("t_detach_confirmed", 5))
    return st.by_reason(pr.recorded_time_reason(recorded, t, tr.KEY, ["t_detach", "t_detach_confirmed"]), kept="sound")


_HASHES = ("initial_state", "sim_state", "source_rgb", "integration_state", "model_xml", "python_state")


@query(
    _PAIRS
    + ", h AS (SELECT entity, CAST(right(entity, 3) AS INTEGER) AS n, "
    + ", ".join(f"bool_and(ha IS NOT DISTINCT FROM hb) FILTER (step = {i}) IS NOT FALSE AND count(*) FILTER (step = {i} AND in_a <> in_b AND coalesce(ha, hb) IS NOT NULL) = 0 AS e{i}" for i in range(6))
    + " FROM p GROUP BY entity) SELECT entity AS pair_id, concat_ws(';', CASE WHEN n % 9 = 0 THEN 'never_grasped' END, CASE WHEN NOT e0 THEN 'initial_state_hash_mismatch' END, CASE WHEN NOT e3 THEN 'warm_start_integration_state_hash_mismatch' END, CASE WHEN NOT e4 THEN 'warm_start_model_xml_hash_mismatch' END, CASE WHEN NOT e5 THEN 'warm_start_python_state_hash_mismatch' END, CASE WHEN n % 10 = 0 THEN 'forced_exception' END) AS reasons, "
    + ", ".join(f"e{i} AS {n}_exact" for i, n in enumerate(_HASHES))
    + " FROM h"
)
def pair_invalid_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why pairs are invalid, and the audit of their hashes: those of the first six samples."""
    p = ex._pairs(spark, d)
    at = lambda c: [F.max(F.when(F.col("step") == i, F.col(c))).alias(n) for i, n in enumerate(_HASHES)]
    n = F.substring("entity", -3, 3).cast("int")
    g = p.groupBy(F.col("entity").alias("pair_id")).agg(F.struct(*at("a_hash")).alias("normal"), F.struct(*at("b_hash"), F.max(F.when(n % 9 == 0, F.lit("never_grasped"))).alias("invalid_reason"), F.max(n % 10 == 0).alias("failed")).alias("forced"))
    r = pr.invalid_reasons(g)
    return r.withColumn("reasons", F.array_join("invalid_reasons", ";")).drop("invalid_reasons")


@query(
    "SELECT CASE WHEN vec_id % 37 = 0 THEN 'dimension_order' WHEN vec_id % 29 = 0 THEN 'token_flag' WHEN vec_id % 17 = 0 THEN 'rank' WHEN vec_id % 19 = 0 THEN 'probability' WHEN vec_id % 31 = 0 THEN 'entropy' WHEN vec_id % 23 = 0 THEN 'mass' ELSE 'sound' END AS reason, count(*) AS records FROM embeddings GROUP BY 1"
)
def violations_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """Uncertainty records made from vectors, some of them spoilt."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    bad = lambda k: F.col("vec_id") % k == 0

    def dim(i: int):
        x = F.abs(F.get("embedding", F.lit(i)).cast("double"))
        token = F.when(bad(29), 5).otherwise(31744 + F.col("label"))
        return F.struct(
            (F.lit(i) + F.when(bad(37), 1).otherwise(0)).alias("dimension"), token.alias("token"), F.lit(True).alias("is_action"), F.when(bad(17), 0).otherwise(F.lit(i + 1)).alias("rank"),
            F.when(bad(19), 1.5).otherwise(x).alias("probability"), F.when(bad(31), -0.1).otherwise(x).alias("entropy"), F.when(bad(23), 1.001).otherwise(F.lit(1.0 + 1e-7)).alias("mass"),
        )

    r = e.select("vec_id", F.array(*[dim(i) for i in range(7)]).alias("dims"), F.lit(31744).alias("vocab_start"), F.lit(32000).alias("vocab_end"), F.lit(256).alias("vocab_size"))
    r = r.withColumn("token_ids", F.transform("dims", lambda x: x["token"]))
    return st.by_reason(r.withColumn("reason", pr.uncertainty_reason()), kept="sound")


@query(
    _TRAJ
    + """, a AS (SELECT task_id, task_episode_idx AS attempt, run_id, success FROM prompts WHERE task_id IS NOT NULL AND task_episode_idx IS NOT NULL),
      u AS (SELECT DISTINCT task_id, attempt FROM a)
    SELECT 'attempts_contiguous' AS "constraint", count(*) AS violations FROM (SELECT task_id FROM u GROUP BY 1 HAVING min(attempt) <> 0 OR max(attempt) <> count(*) - 1)
    UNION ALL SELECT 'attempts_unique', count(*) FROM (SELECT task_id, attempt FROM a GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT 'outcomes_known', count(*) FROM a WHERE success IS NULL
    UNION ALL SELECT 'summary_recomputed', count(*) FROM (SELECT r.run_id FROM (SELECT run_id, max(num_episodes) AS n FROM run_registry GROUP BY 1) r LEFT JOIN (SELECT run_id, count(*) AS n FROM prompts GROUP BY 1) p USING (run_id) WHERE r.n IS DISTINCT FROM coalesce(p.n, 0))"""
)
def violations_paired_run(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of each task, and each run's summary against what its records give."""
    a = ex._prompts(spark, d).filter("task_id is not null and task_episode_idx is not null").select("task_id", F.col("task_episode_idx").alias("attempt"), "run_id", "success")
    stated = table(spark, d, "run_registry").groupBy("run_id").agg(F.max("num_episodes").alias("n"))
    found = ex._prompts(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("m"))
    off = stated.join(found, "run_id", "left").filter(~F.col("n").eqNullSafe(F.coalesce("m", F.lit(0))))
    parts = [
        con.check_query("attempts_contiguous", pr.not_contiguous(a.select("task_id", "attempt").distinct(), "task_id", "attempt")),
        con.check_query("attempts_unique", mg.duplicates(a, ["task_id", "attempt"])),
        con.check_query("outcomes_known", a.filter("success is null")),
        con.check_query("summary_recomputed", off),
    ]
    return con.check_all(parts).drop("checked")


@query(
    _ROLES
    + """SELECT 'coverage_is_a_share' AS "constraint", count(*) FILTER (NOT (episode_coverage > 0 AND episode_coverage <= 1)) AS violations FROM coverage
    UNION ALL SELECT 'members_cover_episodes', count(*) FILTER (num_members < member_episodes) FROM coverage
    UNION ALL SELECT 'progress_is_a_share', count(*) FILTER (NOT (mean_progress >= 0 AND mean_progress <= 1)) FROM coverage
    UNION ALL SELECT 'clusters_recur', count(*) FILTER (episode_coverage < 0.5) FROM coverage
    UNION ALL SELECT 'scores_not_negative', count(*) FILTER (NOT score >= 0) FROM scores"""
)
def violations_stages(spark: SparkSession, d: str) -> DataFrame:
    """What each stage of the scoring pipeline promises to the next one."""
    c = so.cluster_coverage(spark, d)
    share = lambda x: F.col(x).between(0, 1)
    rules = [con.Constraint("coverage_is_a_share", (F.col("episode_coverage") > 0) & (F.col("episode_coverage") <= 1)), con.Constraint("members_cover_episodes", F.col("num_members") >= F.col("member_episodes")), con.Constraint("progress_is_a_share", share("mean_progress")), con.Constraint("clusters_recur", F.col("episode_coverage") >= so.MIN_COVERAGE)]
    s = con.check_rows(so.scores(spark, d), [con.Constraint("scores_not_negative", F.col("score") >= 0)])
    return con.check_all([con.check_rows(c, rules), s]).drop("checked")


@query(
    "SELECT CASE WHEN length(run_id) % 5 = 4 THEN 'tampered' ELSE 'sound' END AS reason, count(*) AS records FROM (SELECT DISTINCT run_id, backbone, layer_idx, num_episodes FROM run_registry WHERE backbone IS NOT NULL AND layer_idx IS NOT NULL AND num_episodes IS NOT NULL) GROUP BY 1"
)
def violations_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Stored fingerprints, some made under another layer, against those of the protocols at hand."""
    cols = ["run_id", "backbone", "layer_idx", "num_episodes"]
    r = table(spark, d, "run_registry").select(*cols).distinct().filter(" and ".join(f"{c} is not null" for c in cols))
    other = r.withColumn("layer_idx", F.col("layer_idx") + F.when(F.length("run_id") % 5 == 4, 1).otherwise(0)).select(*cols, mg.fingerprint(cols).alias("stored"))
    back = other.withColumn("layer_idx", F.col("layer_idx") - F.when(F.length("run_id") % 5 == 4, 1).otherwise(0))
    return st.by_reason(back.withColumn("reason", st.reasons(("tampered", F.col("stored") != mg.fingerprint(cols)))), kept="sound")


_P = sql_path
_CONFIG = {
    "trials_positive": ("trials_per_task > 0", "trials_per_task > 0"),
    "tasks_positive": ("expected_tasks > 0", "expected_tasks > 0"),
    "shards_known": ("expected_shards >= 0", "expected_shards >= 0"),
    "link_mode_known": ("link_mode in ('symlink', 'hardlink', 'copy')", "link_mode IN ('symlink', 'hardlink', 'copy')"),
    "has_inputs": ("size(filter(input_dirs, x -> trim(x) <> '')) > 0", "len(list_filter(input_dirs, lambda x: trim(x) <> '')) > 0"),
    "output_named": ("trim(output_dir) <> ''", "trim(output_dir) <> ''"),
    "output_is_no_input": ("not array_contains(input_dirs, output_dir)", "NOT list_contains(input_dirs, output_dir)"),
}


@query("UNION ALL ".join(f"SELECT '{n}' AS \"constraint\", count(*) FILTER (NOT coalesce({s}, false)) AS violations FROM merge_configs " for n, (_, s) in _CONFIG.items()))
def violations_configs(spark: SparkSession, d: str) -> DataFrame:
    r = con.check_rows(table(spark, d, "merge_configs"), [con.Constraint(n, e) for n, (e, _) in _CONFIG.items() if n != "output_is_no_input"] + [con.Constraint("output_is_no_input", ~F.exists("input_dirs", lambda x: F.coalesce(x == F.col("output_dir"), F.lit(False))))])
    return r.drop("checked")


_CAPABLE = {"state": "json_state", "robots": "robots", "observables": "observables", "time": "captured_at", "phase": "snapshot_phase"}


@query("UNION ALL ".join(f"SELECT run_id, '{n}' AS capability, count(*) AS snapshots, count({c}) AS available FROM telemetry_snapshots GROUP BY run_id " for n, c in _CAPABLE.items()))
def capability_matrix(spark: SparkSession, d: str) -> DataFrame:
    """What each run's snapshots can be asked for."""
    g = table(spark, d, "telemetry_snapshots").groupBy("run_id").agg(F.count(F.lit(1)).alias("snapshots"), *[F.count(c).alias(n) for n, c in _CAPABLE.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("capability"), F.col(n).alias("available")) for n in _CAPABLE])
    return g.select("run_id", "snapshots", F.explode(cells).alias("c")).select("run_id", "c.capability", "snapshots", "c.available")


_IDS = "SELECT run_id, episode_num, min(task_id) AS t0, max(task_id) AS t1, min(task_episode_idx) AS e0, max(task_episode_idx) AS e1 FROM {t} WHERE episode_num IS NOT NULL AND run_id IS NOT NULL GROUP BY ALL"
_FILES = ("trajectory_records", "prompt_records", "activation_index")


@query(
    "UNION ALL ".join(
        f"SELECT '{a}-{b}' AS files, count(*) AS mismatches FROM ({_IDS.format(t=a)}) l JOIN ({_IDS.format(t=b)}) r USING (run_id, episode_num) WHERE l.t0 IS DISTINCT FROM r.t0 OR l.t1 IS DISTINCT FROM r.t1 OR l.t0 IS DISTINCT FROM l.t1 OR l.e0 IS DISTINCT FROM r.e0 OR l.e1 IS DISTINCT FROM r.e1 OR l.e0 IS DISTINCT FROM l.e1 "
        for a, b in (_FILES[:2], _FILES[1:], (_FILES[0], _FILES[2]))
    )
)
def identity_columns(spark: SparkSession, d: str) -> DataFrame:
    """Episodes whose task and trial differ between files."""
    parts = []
    for a, b in (_FILES[:2], _FILES[1:], (_FILES[0], _FILES[2])):
        bad = pr.identity_mismatches(*[table(spark, d, t).filter("episode_num is not null and run_id is not null") for t in (a, b)], tr.KEY, ["task_id", "task_episode_idx"])
        parts.append(bad.agg(F.count(F.lit(1)).alias("mismatches")).select(F.lit(f"{a}-{b}").alias("files"), "mismatches"))
    return con.check_all(parts)


@query(f"SELECT {_P('dir')} AS path, count(DISTINCT merge_id) AS merges FROM (SELECT merge_id, unnest(input_dirs) AS dir FROM merge_configs) WHERE {_P('dir')} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT merge_id) > 1")
def shared_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Input folders, in normal form, that several merges name."""
    m = table(spark, d, "merge_configs").select("merge_id", F.explode("input_dirs").alias("dir"))
    return m.groupBy(normal_path(F.col("dir")).alias("path")).agg(F.count_distinct("merge_id").alias("merges")).filter("path is not null and merges > 1")
