"""Queries that send a table through a sink, a source or a stream and back; SQL states what has to come out.

What they write lies in the shared checkpoint folder, under a name of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators import trajectories as tr
from stepweave.plans import experiments as ex
from stepweave.plans.experiments import _TRAJ
from stepweave.runtime import ensure_checkpoint_dir, table
from stepweave.sources import readers, sinks
from stepweave.streaming import stateful

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/trip-{uuid.uuid4().hex}"


_PROMPTS = "run_id string, episode_num int, task_id int, task_description string, success boolean, num_actions int"
_COLS = [x.split()[0] for x in _PROMPTS.split(", ")]
_SUMS = "SELECT run_id, count(*) AS n, CAST(sum(episode_num) AS BIGINT) AS episodes, CAST(sum(coalesce(num_actions, 0)) AS BIGINT) AS actions, count(task_description) AS described, count(*) FILTER (success) AS successes FROM prompt_records GROUP BY run_id"


def _sums(df: DataFrame) -> DataFrame:
    return df.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("episode_num").cast("long")).alias("episodes"), F.sum(F.coalesce(F.col("num_actions").cast("long"), F.lit(0))).alias("actions"), F.count("task_description").alias("described"), F.count_if(F.col("success").cast("boolean")).alias("successes"))


@query(_SUMS)
def trip_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Prompts as line-delimited JSON, appended in two parts."""
    p, to = table(spark, d, "prompt_records").select(*_COLS), _folder(spark)
    sinks.write_jsonl(p.filter("episode_num % 2 = 0"), to)
    sinks.write_jsonl(p.filter("episode_num % 2 <> 0"), to, append=True)
    return _sums(readers.read_jsonl(spark, to, _PROMPTS))


@query(_SUMS)
def trip_csv(spark: SparkSession, d: str) -> DataFrame:
    """Prompts as CSV with one header, in two folders."""
    p, to = table(spark, d, "prompt_records").select(*_COLS), _folder(spark)
    for i in (0, 1):
        p.filter(f"episode_num % 2 = {i}").coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{to}/{i}")
    return _sums(readers.read_csv_same_header(spark, [f"{to}/0", f"{to}/1"]))


@query("SELECT run_id, count(*) AS n, count(DISTINCT index_id) AS ids FROM activation_index GROUP BY run_id")
def trip_shards(spark: SparkSession, d: str) -> DataFrame:
    """The index in shards of at most 500 rows, the rows of a forward in one task."""
    to = _folder(spark)
    sinks.write_shards(table(spark, d, "activation_index"), to, 500, together=["run_id", "global_forward_idx"])
    return spark.read.parquet(to).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("index_id").alias("ids"))


@query("SELECT layer_idx, count(*) AS n, count(DISTINCT index_id) AS ids FROM (SELECT DISTINCT index_id, layer_idx, row_start FROM activation_index WHERE layer_idx IS NOT NULL) GROUP BY layer_idx")
def trip_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Shards written in two runs: the second checks what is there and adds the rest."""
    i, to = table(spark, d, "activation_index").select("index_id", "layer_idx", "row_start").filter("layer_idx is not null").distinct(), _folder(spark)
    sinks.resume_shards(i.filter("layer_idx <= 15"), to, "layer_idx")
    sinks.resume_shards(i, to, "layer_idx")
    return spark.read.parquet(to).groupBy("layer_idx").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("index_id").alias("ids"))


@query("SELECT run_id, episode_num, step_in_episode AS step, CAST(f AS BIGINT) AS feature, count(*) AS n_values, round(sum(CAST(v AS DOUBLE)), 5) AS total FROM (SELECT run_id, episode_num, step_in_episode, unnest(top_feature_ids[:least(len(top_feature_ids), len(top_feature_vals))]) AS f, unnest(top_feature_vals[:least(len(top_feature_ids), len(top_feature_vals))]) AS v FROM topk_rows) WHERE f IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) GROUP BY ALL")
def stream_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums of stored values over a stream of files, equal to those of the whole table."""
    from stepweave.operators.activations import long_form

    t = table(spark, d, "topk_rows").select("run_id", "episode_num", F.col("step_in_episode").alias("step"), "top_feature_ids", "top_feature_vals")
    to = _folder(spark)
    t.repartition(3).write.parquet(to)
    s = long_form(stateful.read_steps(spark, to, t.schema), ["run_id", "episode_num", "step"]).filter("not isnan(value) and abs(value) < double('inf')")
    out = stateful.run_to_table(stateful.timestep_sums(s, ["run_id", "episode_num", "step"]), f"{to}-out", f"{to}-state")
    return out.select("run_id", "episode_num", "step", F.col("feature").cast("long").alias("feature"), "n_values", F.round("total", 5).alias("total"))


@query(_TRAJ + "SELECT run_id, episode_num, step AS trigger_step, t_grasp FROM g5 JOIN fires USING (run_id, episode_num, step)")
def stream_triggers(spark: SparkSession, d: str) -> DataFrame:
    """The release trigger over a stream of steps, in order, equal to that of the table."""
    g = ex._grasps(spark, d).select(*tr.KEY, "step", "grasped", "z")
    to = _folder(spark)
    g.filter("step < 60").coalesce(2).write.parquet(f"{to}/0")
    g.filter("step >= 60").coalesce(2).write.parquet(f"{to}/1")
    s = stateful.read_steps(spark, f"{to}/*", g.schema, files_per_trigger=2)
    out = stateful.run_to_table(stateful.release_triggers(s), f"{to}-out", f"{to}-state", mode="append")
    return out.select(*tr.KEY, "trigger_step", "t_grasp")
