"""Registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import mixing, runs, sentences, tokens, topn
from stepweave.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "trajectory_records")).select("run_id", "episode_num", "first_step", "last_step")


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    r = runs.collapse_runs(table(spark, d, "trajectory_records"))
    return r.select("run_id", "episode_num", "first_step", "last_step", "n_steps", F.round("duration_s", 6).alias("duration_s"), "low", "high")


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """The whole collapsed sequence, single events kept."""
    r = runs.collapse_runs(table(spark, d, "trajectory_records"), min_steps=1)
    return r.select("run_id", "episode_num", "first_step", "last_step", "n_steps")


def _best(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_features(table(spark, d, "topk_rows"), table(spark, d, "score_matrix"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("scored_in", "group_key", "item_rank", "feature_id")


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[1]


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[0]


def p7_temperature(spark: SparkSession, d: str) -> DataFrame:
    """Natural shares at the temperature that has the entropy of each mixture's weights."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mixture_targets"), temperature=True)[1]


def p7_targets(spark: SparkSession, d: str) -> DataFrame:
    """The targets as they are read, with the documents that each source has to offer."""
    t = [(x.mixture, x.source, x.target, -1 if x.cap is None else x.cap) for x in mixing.read_targets(table(spark, d, "mixture_targets"))]
    docs = table(spark, d, "documents").filter("text <> ''").groupBy(mixing.source_name(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    targets = spark.createDataFrame(t, "mixture string, source string, target_share double, max_repeats int")
    return targets.join(docs, "source", "left").select("mixture", "source", F.round("target_share", 9).alias("target_share"), "max_repeats", F.coalesce("n", F.lit(0)).alias("source_docs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p1_collapsed, p3_found, p3_values, p6_ids, p7_shares, p7_documents, p7_temperature, p7_targets, p8_found)}

_RUNS = """
WITH latest AS (
  SELECT run_id, episode_num, step_in_episode AS step, gripper_action AS g, step_at,
         row_number() OVER (PARTITION BY run_id, episode_num, step_in_episode ORDER BY logged_at DESC NULLS LAST, gripper_action DESC NULLS LAST, step_at DESC NULLS LAST) AS rn
  FROM trajectory_records),
counting AS (SELECT * FROM latest WHERE rn = 1 AND g IS NOT NULL AND NOT isnan(g)),
marked AS (
  SELECT *, CASE WHEN step - lag(step) OVER e <= 5 AND abs(g - lag(g) OVER e) <= 0.02 THEN 0 ELSE 1 END AS fresh
  FROM counting WINDOW e AS (PARTITION BY run_id, episode_num ORDER BY step)),
chained AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id, episode_num ORDER BY step) AS chain FROM marked),
runs AS (
  SELECT run_id, episode_num, CAST(min(step) AS INTEGER) AS first_step, CAST(max(step) AS INTEGER) AS last_step,
         CAST(count(*) AS BIGINT) AS n_steps, round((epoch_us(arg_max(step_at, step)) - epoch_us(arg_min(step_at, step))) / 1e6, 6) AS duration_s,
         min(g) AS low, max(g) AS high
  FROM chained GROUP BY run_id, episode_num, chain)
"""
_TOP = """
WITH pairs AS (
  SELECT run_id, episode_num, step_in_episode, unnest(top_feature_ids[:least(len(top_feature_ids), len(top_feature_vals))]) AS f,
         unnest(top_feature_vals[:least(len(top_feature_ids), len(top_feature_vals))]) AS v
  FROM topk_rows),
steps AS (
  SELECT run_id, episode_num, step_in_episode, f, max(v) AS v FROM pairs
  WHERE f >= 0 AND v > 0 AND NOT isnan(v) AND NOT isinf(v) GROUP BY ALL),
step_rank AS (
  SELECT 'topk_rows' AS scored_in, run_id || '/' || episode_num || '/' || step_in_episode AS group_key, f, v,
         row_number() OVER (PARTITION BY run_id, episode_num, step_in_episode ORDER BY v DESC, f) AS r, 5 AS most FROM steps),
latest AS (
  SELECT cluster_id, feature_id, score, row_number() OVER (PARTITION BY cluster_id, feature_id ORDER BY scored_at DESC NULLS LAST, score DESC NULLS LAST) AS rn FROM score_matrix),
cluster_rank AS (
  SELECT 'score_matrix' AS scored_in, cluster_id AS group_key, feature_id AS f, score AS v,
         row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, feature_id) AS r, 10 AS most
  FROM latest WHERE rn = 1 AND feature_id >= 0 AND score > 0 AND NOT isnan(score) AND NOT isinf(score)),
both_in AS (SELECT * FROM step_rank UNION ALL SELECT * FROM cluster_rank)
"""
_NAME = "replace(regexp_replace(lower(source), '\\s+', '', 'g'), '-', '_')"
ORACLE = {
    "p7_targets": f"""WITH t AS (SELECT mixture, {_NAME} AS source, max(weight) AS w, min(max_repeats) AS cap FROM mixture_targets WHERE mixture IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
      d AS (SELECT {_NAME} AS source, count(*) AS n FROM documents WHERE text <> '' GROUP BY ALL)
      SELECT mixture, source, round(w / sum(w) OVER (PARTITION BY mixture), 9) AS target_share, coalesce(cap, -1) AS max_repeats, coalesce(n, 0) AS source_docs FROM t LEFT JOIN d USING (source)""",
    "p1_found": _RUNS + "SELECT run_id, episode_num, first_step, last_step FROM runs WHERE n_steps >= 2",
    "p1_runs": _RUNS + "SELECT * FROM runs WHERE n_steps >= 2",
    "p1_collapsed": _RUNS + "SELECT run_id, episode_num, first_step, last_step, n_steps FROM runs",
    "p3_found": _TOP + "SELECT scored_in, group_key, CAST(r AS INTEGER) AS item_rank, f AS feature_id FROM both_in WHERE r <= most",
    "p3_values": _TOP + "SELECT scored_in, group_key, CAST(r AS INTEGER) AS item_rank, f AS feature_id, CAST(v AS DOUBLE) AS value FROM both_in WHERE r <= most",
}
