"""Registered queries of the general data problems: nested records, dangling references, copy differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators import copydiff, nested, references
from stepweave.runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found_records(table(spark, d, "telemetry_snapshots"))


def p2_robots(spark: SparkSession, d: str) -> DataFrame:
    """The records of p2_found that come from the typed column, which SQL can take apart as well."""
    return p2_found(spark, d).filter(F.col("child_kind").isin("robot", "controller_field", "robot_field", "gripper_field"))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.distinct_nodes(nested.flatten_snapshots(table(spark, d, "telemetry_snapshots")))


def p2_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_snapshots(table(spark, d, "telemetry_snapshots"), content=False).drop("salt", "content").distinct()


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = ("activation_index", "merge_configs", "shard_registry", "prompt_records", "run_registry")
    return references.experiment_orphans(*[table(spark, d, n) for n in names])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_field", "ref_id", "ref_pos")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


def _differences(spark: SparkSession, d: str) -> DataFrame:
    return copydiff.replay_differences(table(spark, d, "replay_reference"), table(spark, d, "replay_current"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _differences(spark, d)


def p5_summary(spark: SparkSession, d: str) -> DataFrame:
    return _differences(spark, d).groupBy("diff_field").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("pair_id").alias("pairs"))


QUERIES = {f.__name__: f for f in (p2_found, p2_robots, p2_nodes, p2_bridge, p4_found, p4_report, p5_found, p5_summary)}


def sql_path(c: str) -> str:
    p = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return f"""CASE WHEN {p} = '' THEN NULL ELSE (CASE WHEN starts_with({p}, '/') THEN '/' ELSE '' END) || array_to_string(list_reduce(
      list_transform(string_split({p}, '/'), lambda x: [x]),
      lambda acc, x: CASE WHEN x[1] IN ('', '.') THEN acc
        WHEN x[1] = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[1:len(acc) - 1]
        WHEN x[1] = '..' AND starts_with({p}, '/') THEN acc ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[])), '/') END"""


_ORPHANS = f"""
WITH dirs AS (SELECT merge_id, created_at, unnest(input_dirs) AS dir, generate_subscripts(input_dirs, 1) - 1 AS pos FROM merge_configs),
refs AS (
  SELECT 'activation_index' AS ref_table, 'shard_path' AS ref_field, index_id AS ref_id, 0 AS ref_pos, {sql_path("shard_path")} AS key, 's' AS kind, logged_at AS t FROM activation_index
  UNION ALL SELECT 'activation_index', 'episode_num', index_id, 0, run_id || '/' || episode_num, 'e', logged_at FROM activation_index WHERE episode_num <> -1
  UNION ALL SELECT 'merge_configs', 'input_dirs', merge_id, pos, {sql_path("dir")}, 'r', created_at FROM dirs),
lives AS (
  SELECT {sql_path("shard_path")} AS key, 's' AS kind, registered_at, deleted_at FROM shard_registry
  UNION ALL SELECT run_id || '/' || episode_num, 'e', registered_at, deleted_at FROM prompt_records
  UNION ALL SELECT {sql_path("run_dir")}, 'r', registered_at, deleted_at FROM run_registry),
orphans AS (
  SELECT DISTINCT ref_table, ref_field, ref_id, CAST(ref_pos AS INTEGER) AS ref_pos, key, strftime(t, '%Y-%m') AS month FROM refs
  WHERE key IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM lives WHERE lives.kind = refs.kind AND lives.key = refs.key AND registered_at <= t AND (deleted_at IS NULL OR t < deleted_at)))
"""


def _apart(a: str, b: str) -> str:
    return f"""CASE WHEN {a} IS NULL OR {b} IS NULL THEN ({a} IS NULL) <> ({b} IS NULL)
      WHEN isnan({a}) OR isnan({b}) THEN isnan({a}) <> isnan({b}) ELSE {a} <> {b} AND NOT abs({a} - {b}) <= 1e-6 END"""


def _arrays(c: str) -> str:
    x, y = f"CAST(r.{c} AS DOUBLE[])", f"CAST(c.{c} AS DOUBLE[])"
    return f"""((r.{c} IS NULL) <> (c.{c} IS NULL) OR coalesce(len(r.{c}) <> len(c.{c}), false)
      OR coalesce(len(list_filter(range(1, len(r.{c}) + 1), lambda i: {_apart(f"({x})[i]", f"({y})[i]")})) > 0, false))"""


def _digest(c: str) -> str:
    return f"regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '^(sha-?256\\s*[:=]\\s*)?(0x)?', '')"


def _latest(t: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, sample_step ORDER BY written_at DESC NULLS LAST) AS rn FROM {t}) WHERE rn = 1"


_DIFF = f"""
WITH r AS ({_latest("replay_reference")}), c AS ({_latest("replay_current")}),
both_in AS (SELECT r.pair_id AS p, r.sample_step AS s, {_arrays("qpos")} AS d1, {_arrays("qvel")} AS d2,
    {_digest("r.control_state_sha256")} IS DISTINCT FROM {_digest("c.control_state_sha256")} AS d3,
    {_apart("r.reward", "c.reward")} AS d4, r.done IS DISTINCT FROM c.done AS d5
  FROM r JOIN c ON r.pair_id = c.pair_id AND r.sample_step = c.sample_step),
diffs AS (
  SELECT pair_id, sample_step, 'only_in_reference' AS diff_field FROM r ANTI JOIN c USING (pair_id, sample_step)
  UNION ALL SELECT pair_id, sample_step, 'only_in_current' FROM c ANTI JOIN r USING (pair_id, sample_step)
  UNION ALL SELECT p, s, 'qpos' FROM both_in WHERE d1 UNION ALL SELECT p, s, 'qvel' FROM both_in WHERE d2
  UNION ALL SELECT p, s, 'control_state_sha256' FROM both_in WHERE d3
  UNION ALL SELECT p, s, 'reward' FROM both_in WHERE d4 UNION ALL SELECT p, s, 'done' FROM both_in WHERE d5)
"""
ORACLE = {
    "p2_robots": """WITH r AS (SELECT snapshot_id, unnest(robots) AS r, CAST(generate_subscripts(robots, 1) - 1 AS VARCHAR) AS i FROM telemetry_snapshots),
      c AS (SELECT snapshot_id, i, unnest(map_entries(r.controller_fields)) AS e FROM r), g AS (SELECT snapshot_id, i, unnest(map_entries(r.gripper_fields)) AS e FROM r), f AS (SELECT snapshot_id, i, unnest(r.robot_fields) AS e FROM r)
      SELECT snapshot_id, 'robot' AS child_kind, '' AS parent_key, i AS child_key FROM r WHERE r IS NOT NULL
      UNION SELECT snapshot_id, 'controller_field', i, e.key FROM c WHERE e.value IS NOT NULL UNION SELECT snapshot_id, 'gripper_field', i, e.key FROM g WHERE e.value IS NOT NULL
      UNION SELECT snapshot_id, 'robot_field', i, e.field_name FROM f WHERE e.field_name IS NOT NULL""",
    "p4_found": _ORPHANS + "SELECT DISTINCT ref_table, ref_field, ref_id, ref_pos FROM orphans",
    "p4_report": _ORPHANS + "SELECT ref_table, ref_field, month, count(DISTINCT (ref_id, ref_pos)) AS orphans, count(DISTINCT key) AS missing_keys FROM orphans GROUP BY ALL",
    "p5_found": _DIFF + "SELECT pair_id, sample_step, diff_field FROM diffs",
    "p5_summary": _DIFF + "SELECT diff_field, count(*) AS samples, count(DISTINCT pair_id) AS pairs FROM diffs GROUP BY ALL",
}
