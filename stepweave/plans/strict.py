"""Queries over strict joins, filters with reasons, action conversions and further aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import actions as fa
from stepweave.functions.paths import normal_path
from stepweave.functions.vectors import rank_in, round_binary
from stepweave.operators import activations as act
from stepweave.operators import merging as mg
from stepweave.operators import scoring as sc
from stepweave.operators import strict as st
from stepweave.operators import trajectories as tr
from stepweave.operators.segments import global_rank, with_neighbour
from stepweave.operators.windows import frame_window
from stepweave.plans import experiments as ex
from stepweave.plans import scores as so
from stepweave.plans.experiments import _PAIRS, _TRAJ
from stepweave.plans.general import sql_path
from stepweave.plans.scores import _ROLES
from stepweave.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- joins ----------------------------------------------------------------------------------------------------------

_INDEX_KEYS = "SELECT DISTINCT run_id, episode_num, step_in_episode AS step FROM activation_index WHERE run_id IS NOT NULL AND episode_num IS NOT NULL AND step_in_episode IS NOT NULL"


def _index_keys(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "activation_index").select("run_id", "episode_num", F.col("step_in_episode").alias("step"))
    return i.filter("run_id is not null and episode_num is not null and step is not null").distinct()


@query(_TRAJ + f"SELECT CASE WHEN s.run_id IS NULL THEN 'missing_state' WHEN s.eef_pos IS NULL THEN 'missing_position' ELSE 'joined' END AS reason, count(*) AS records FROM ({_INDEX_KEYS}) i LEFT JOIN steps s USING (run_id, episode_num, step) GROUP BY 1")
def center_states(spark: SparkSession, d: str) -> DataFrame:
    """Activation keys as samples, joined to the state of their step."""
    return st.by_reason(st.center_states(_index_keys(spark, d), ex._steps(spark, d), [*tr.KEY, "step"]))


@query(_TRAJ + "SELECT run_id, episode_num, count(*) AS steps, count(*) FILTER (eef_pos IS NOT NULL) AS vectors, CAST(max(len(eef_pos) + CASE WHEN has_gripper THEN len(gripper_qpos) ELSE 0 END) AS INTEGER) AS width FROM steps JOIN (SELECT run_id, episode_num, has_gripper FROM eps) USING (run_id, episode_num) GROUP BY ALL")
def state_vectors(spark: SparkSession, d: str) -> DataFrame:
    """State vectors of each episode; the gripper is part of them only where every record has it."""
    s = st.with_uniform(ex._steps(spark, d).select(*tr.KEY, "eef_pos", "gripper_qpos"), tr.KEY, "gripper_qpos", "uniform")
    v = s.select(*tr.KEY, st.state_vector(F.col("eef_pos"), F.col("gripper_qpos"), F.col("uniform")).alias("v"))
    return v.groupBy(*tr.KEY).agg(F.count(F.lit(1)).alias("steps"), F.count("v").alias("vectors"), F.max(F.when(F.col("v").isNotNull(), F.size("v"))).alias("width")).fillna(-1, ["width"])


ORACLE["state_vectors"] = f"SELECT * REPLACE (coalesce(width, -1) AS width) FROM ({ORACLE['state_vectors']})"


@query(
    _TRAJ
    + """, w AS (SELECT run_id, episode_num, step FROM (SELECT run_id, episode_num, step, CASE WHEN gripper_action > 0 THEN 1 ELSE -1 END AS c, lead(CASE WHEN gripper_action > 0 THEN 1 ELSE -1 END) OVER e AS nc FROM steps WHERE gripper_action IS NOT NULL AND NOT isnan(gripper_action) WINDOW e AS (PARTITION BY run_id, episode_num ORDER BY step)) WHERE nc <> c),
    m AS (SELECT DISTINCT run_id, episode_num FROM activation_index WHERE trim(shard_path) <> '')
    SELECT CASE WHEN p.run_id IS NULL THEN 'missing_episode' WHEN m.run_id IS NULL THEN 'missing_medium' ELSE 'joined' END AS reason, count(*) AS records FROM w LEFT JOIN prompts p ON w.run_id = p.run_id AND w.episode_num = p.episode_num LEFT JOIN m ON w.run_id = m.run_id AND w.episode_num = m.episode_num GROUP BY 1"""
)
def waypoint_media(spark: SparkSession, d: str) -> DataFrame:
    """Waypoints (gripper toggles) against episodes (prompts) and media (stored shards), with the reason of each that is skipped."""
    media = table(spark, d, "activation_index").filter("trim(shard_path) <> ''").select(*tr.KEY).distinct()
    return st.by_reason(st.media_lookup(ex.gripper_toggle(spark, d), ex._prompts(spark, d), media, tr.KEY))


@query(
    _TRAJ
    + """, l AS (SELECT run_id, task_description, task_episode_idx, min(num_actions) AS n, count(*) AS copies FROM prompts GROUP BY ALL)
    SELECT CASE WHEN l.copies IS NULL THEN 'unknown_key' WHEN l.copies > 1 THEN 'ambiguous_key' WHEN l.n IS DISTINCT FROM e.num_steps THEN 'length_mismatch' ELSE 'joined' END AS reason, count(*) AS records FROM eps e LEFT JOIN l ON e.run_id = l.run_id AND e.task_description = l.task_description AND e.task_episode_idx = l.task_episode_idx GROUP BY 1"""
)
def action_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories against prompts by task description and trial; the number of actions must be that of the steps."""
    keys = ["run_id", "task_description", "task_episode_idx"]
    lookup = st.unique_lookup(ex._prompts(spark, d), keys, ["num_actions"])
    return st.by_reason(st.lengths_agree(ex._episodes(spark, d).select(*keys, "num_steps"), lookup, keys, "num_steps", "num_actions"))


@query(
    _TRAJ
    + """, i AS (SELECT DISTINCT run_id, episode_num, step_in_episode AS step, task_id, task_episode_idx FROM activation_index WHERE episode_num <> -1)
    SELECT CASE WHEN s.run_id IS NULL THEN 'unknown_key' WHEN i.task_id IS DISTINCT FROM s.task_id THEN 'mismatch:task_id' WHEN i.task_episode_idx IS DISTINCT FROM s.task_episode_idx THEN 'mismatch:task_episode_idx' ELSE 'joined' END AS reason, count(*) AS records FROM i LEFT JOIN steps s ON i.run_id = s.run_id AND i.episode_num = s.episode_num AND i.step = s.step GROUP BY 1"""
)
def index_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Activation index against action rows; task and trial must agree."""
    i = table(spark, d, "activation_index").filter("episode_num <> -1").select(*tr.KEY, F.col("step_in_episode").alias("step"), "task_id", "task_episode_idx").distinct()
    return st.by_reason(mg.strict_lookup(i, ex._steps(spark, d), [*tr.KEY, "step"], ["task_id", "task_episode_idx"]))


@query(
    _PAIRS.replace("in_b FROM r", "in_b, r.reward AS ra, c.reward AS rb, r.done AS da, c.done AS db FROM r")
    + "SELECT entity, step, concat_ws(',', CASE WHEN ra IS DISTINCT FROM rb THEN 'reward' END, CASE WHEN da IS DISTINCT FROM db THEN 'done' END, CASE WHEN ha IS DISTINCT FROM hb THEN 'hash' END) AS fields FROM p WHERE in_a AND in_b AND (ra IS DISTINCT FROM rb OR da IS DISTINCT FROM db OR ha IS DISTINCT FROM hb)"
)
def pair_results_equal(spark: SparkSession, d: str) -> DataFrame:
    """Samples of both copies whose results differ as a whole struct, and in which fields."""

    def side(name: str) -> DataFrame:
        r = F.max_by(F.struct("reward", "done", ex.digest(F.col("control_state_sha256")).alias("hash")), "written_at")
        return table(spark, d, name).groupBy(F.col("pair_id").alias("entity"), F.col("sample_step").alias("step")).agg(r.alias("r")).select("entity", "step", "r.*")

    return st.struct_mismatches(side("replay_reference"), side("replay_current"), ["entity", "step"], ["reward", "done", "hash"])


_SETS = "SELECT DISTINCT task_id, task_episode_idx, initial_state_sha256 FROM prompts WHERE episode_num % 2 = {i} AND task_id IS NOT NULL AND task_episode_idx IS NOT NULL AND initial_state_sha256 IS NOT NULL"


@query(_TRAJ + f", a AS ({_SETS.format(i=0)}), b AS ({_SETS.format(i=1)}) (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))")
def condition_sets(spark: SparkSession, d: str) -> DataFrame:
    """Task, trial and initial state must be the same sets under two conditions."""
    keys = ["task_id", "task_episode_idx", "initial_state_sha256"]
    p = ex._prompts(spark, d).filter(" and ".join(f"{k} is not null" for k in keys))
    return mg.key_differences(p.filter("episode_num % 2 = 0"), p.filter("episode_num % 2 = 1"), keys)


@query(
    _TRAJ
    + f", i AS ({_INDEX_KEYS} AND episode_num <> -1), s AS (SELECT run_id, episode_num, step FROM steps) SELECT run_id, side, count(*) AS keys FROM (SELECT *, 'uncovered' AS side FROM (SELECT * FROM s EXCEPT SELECT * FROM i) UNION ALL SELECT *, 'outside' FROM (SELECT * FROM i EXCEPT SELECT * FROM s)) GROUP BY ALL"
)
def activation_cover(spark: SparkSession, d: str) -> DataFrame:
    """Steps without activations and activations outside the steps, per run."""
    c = st.coverage(ex._steps(spark, d), _index_keys(spark, d).filter("episode_num <> -1"), [*tr.KEY, "step"])
    return c.groupBy("run_id", "side").agg(F.count(F.lit(1)).alias("keys"))


@query(
    _ROLES
    + ", f0 AS (SELECT sample, episode, waypoint_step, -greatest(waypoint_step + 6 - 82, 0) AS back FROM events_v), f AS (SELECT *, back + greatest(0, -(waypoint_step - 4 + back)) AS shift FROM f0), o AS (SELECT unnest([-4, -2, 0, 3, 6]) AS off) SELECT sample, count(*) AS frames, count(t.step) AS found, CAST(min(waypoint_step + off + shift) AS INTEGER) AS first_frame FROM f CROSS JOIN o LEFT JOIN ts t ON t.episode = f.episode AND t.step = waypoint_step + off + shift GROUP BY sample"
)
def frame_windows(spark: SparkSession, d: str) -> DataFrame:
    """Frames of arbitrary offsets around each event, slid into its episode, and how many of them are there."""
    e = so.events(spark, d).select("sample", "episode", F.explode(frame_window(F.col("waypoint_step"), [-4, -2, 0, 3, 6], F.col("num_steps"))).alias("step"))
    have = so.timesteps(spark, d).withColumn("here", F.lit(True))
    return e.join(have, ["episode", "step"], "left").groupBy("sample").agg(F.count(F.lit(1)).alias("frames"), F.count("here").alias("found"), F.min("step").alias("first_frame"))


@query(_PAIRS + ", t AS (SELECT pair_id AS entity, min(sample_step) AS t_cmd FROM r WHERE done GROUP BY 1) SELECT p.entity, t_cmd, count(*) AS steps_compared, count(*) FILTER (ha IS DISTINCT FROM hb) AS mismatches FROM p JOIN t ON p.entity = t.entity AND p.step <= t.t_cmd WHERE in_a AND in_b GROUP BY ALL")
def prefix_until_command(spark: SparkSession, d: str) -> DataFrame:
    """The paired join up to the command: the first done step of the reference bounds the steps that are compared."""
    r = table(spark, d, "replay_reference").groupBy(F.col("pair_id").alias("entity"), F.col("sample_step").alias("step")).agg(F.max_by("done", "written_at").alias("done"))
    t = r.filter("done").groupBy("entity").agg(F.min("step").alias("t_cmd"))
    p = ex._pairs(spark, d).filter("a_here and b_here").join(t, "entity").filter(F.col("step") <= F.col("t_cmd"))
    return p.groupBy("entity", "t_cmd").agg(F.count(F.lit(1)).alias("steps_compared"), F.count_if(~F.col("a_hash").eqNullSafe(F.col("b_hash"))).alias("mismatches"))


@query(
    f"SELECT problem, count(*) AS files FROM (SELECT CASE WHEN a.size IS NULL THEN 'missing' WHEN e.size IS NULL THEN 'unexpected' ELSE 'wrong_size' END AS problem FROM (SELECT {sql_path('shard_path')} AS path, max(num_rows) AS size FROM shard_registry GROUP BY 1) e FULL JOIN (SELECT * FROM (SELECT {sql_path('shard_path')} AS path, CAST(max(row_end) AS BIGINT) AS size FROM activation_index GROUP BY 1) WHERE path IS NOT NULL) a ON e.path = a.path WHERE e.size IS DISTINCT FROM a.size AND NOT (e.size IS NULL AND regexp_matches(a.path, 'layer_15'))) GROUP BY 1"
)
def inventory_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Inventory differences, where unexpected files of one layer are allowed."""
    f = ex.inventory_diff(spark, d)
    return mg.without_allowed(f, "layer_15").groupBy("problem").agg(F.count(F.lit(1)).alias("files"))


@query("WITH d AS (SELECT DISTINCT run_id FROM run_registry) SELECT i.run_id, count(*) AS shards FROM (SELECT DISTINCT run_id, shard_path FROM activation_index WHERE shard_path IS NOT NULL) i ANTI JOIN (SELECT DISTINCT shard_path FROM shard_registry) s USING (shard_path) GROUP BY 1")
def required_present(spark: SparkSession, d: str) -> DataFrame:
    """Required shards, as written, that the registry does not hold, per run."""
    need = st.require_columns(table(spark, d, "activation_index"), ["run_id", "shard_path"]).select("run_id", "shard_path").filter("shard_path is not null").distinct()
    return need.join(table(spark, d, "shard_registry").select("shard_path"), "shard_path", "left_anti").groupBy("run_id").agg(F.count(F.lit(1)).alias("shards"))


# ---- projections and filters ----------------------------------------------------------------------------------------


@query("SELECT run_id, episode_num, step, count(*) AS n_rows, max(token_idx) AS last_token FROM (SELECT run_id, coalesce(episode_num, 0) AS episode_num, coalesce(CASE WHEN chunk_start_step >= 0 THEN chunk_start_step + token_idx ELSE step_in_episode END, 0) AS step, token_idx FROM topk_rows) GROUP BY ALL")
def row_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The step of each stored row: that of its token inside a chunk, else its own; unknown ones are 0."""
    t = table(spark, d, "topk_rows").select("run_id", F.coalesce("episode_num", F.lit(0)).alias("episode_num"), act.row_step().alias("step"), "token_idx")
    return t.groupBy("run_id", "episode_num", "step").agg(F.count(F.lit(1)).alias("n_rows"), F.max("token_idx").alias("last_token"))


@query("SELECT pair_id, sample_step, CAST(o AS INTEGER) AS step_offset, round(qvel[o + 1], 6) AS action FROM (SELECT DISTINCT pair_id, sample_step, qvel FROM replay_reference WHERE qvel IS NOT NULL), (SELECT unnest(range(3)) AS o) WHERE o < len(qvel)")
def chunk_actions(spark: SparkSession, d: str) -> DataFrame:
    """The first three entries of each chunk with their offset."""
    r = table(spark, d, "replay_reference").filter("qvel is not null").select("pair_id", "sample_step", "qvel").distinct()
    return r.select("pair_id", "sample_step", F.explode(fa.chunk(F.col("qvel"), 3)).alias("c")).select("pair_id", "sample_step", F.col("c.offset").alias("step_offset"), round_binary(F.col("c.action"), 6).alias("action"))


@query("SELECT vec_id, round(2 * x - 1, 5) AS scaled, CAST(sign(2 * x - 1) AS DOUBLE) AS signed, CAST(-sign(2 * x - 1) AS DOUBLE) AS executed, -1.0::DOUBLE AS forced, CAST(n AS INTEGER) AS n FROM (SELECT vec_id, CAST(embedding[-1] AS DOUBLE) AS x, len(embedding) AS n FROM embeddings)")
def gripper_conversions(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as action vectors, their last element as the gripper in every convention."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    out = {"scaled": fa.gripper_to_sign(F.col("v"), binarize=False), "signed": fa.gripper_to_sign(F.col("v")), "executed": fa.executed(F.col("v")), "forced": fa.forced_open(F.col("v"))}
    return e.select("vec_id", *[(F.round(fa.last(c), 5) if n == "scaled" else fa.last(c)).alias(n) for n, c in out.items()], F.size(out["forced"]).alias("n"))


_LOW, _HIGH, _MASK = [-0.5, -1.0, 0.0, -2.0], [0.5, 1.0, 2.0, 2.0], [True, True, True, False]


@query("SELECT run_id, episode_num, step_in_episode, token_idx, batch_idx, CAST(i AS INTEGER) AS dim, round(sum(CASE WHEN i < 3 THEN 0.5 * (x + 1) * ([0.5, 1.0, 2.0])[i + 1] * 2 * CASE WHEN i = 2 THEN 0.5 ELSE 1 END + ([-0.5, -1.0, 0.0])[i + 1] ELSE x END), 5) AS total FROM (SELECT *, (least(greatest(32000 - 31744 - top_feature_ids[i + 1] % 256 - 1, 0), 254) + 0.5) * (2.0 / 255) - 1 AS x FROM topk_rows, (SELECT unnest(range(4)) AS i) WHERE top_feature_ids[i + 1] >= 0) GROUP BY ALL")
def action_detokenize(spark: SparkSession, d: str) -> DataFrame:
    """Feature ids read as action tokens (31744 and up, of 32000), as action values."""
    ids = F.filter(F.transform(F.slice("top_feature_ids", 1, 4), lambda t: F.lit(31744) + t % 256), lambda t: F.lit(True))
    v = fa.detokenized(ids, _LOW, _HIGH, _MASK, vocab_size=32000)
    t = table(spark, d, "topk_rows").select("run_id", "episode_num", "step_in_episode", "token_idx", "batch_idx", F.posexplode(F.arrays_zip(F.slice("top_feature_ids", 1, 4).alias("t"), v.alias("v"))).alias("dim", "p"))
    return t.filter("p.t >= 0").groupBy("run_id", "episode_num", "step_in_episode", "token_idx", "batch_idx", "dim").agg(F.round(F.sum("p.v"), 5).alias("total"))


@query("SELECT run_id, run_dir, sha256('{\"backbone\":\"' || backbone || '\",\"layer_idx\":' || layer_idx || ',\"num_episodes\":' || num_episodes || ',\"run_id\":\"' || run_id || '\"}') AS fingerprint FROM (SELECT DISTINCT run_id, run_dir, backbone, layer_idx, num_episodes FROM run_registry WHERE backbone IS NOT NULL AND layer_idx IS NOT NULL AND num_episodes IS NOT NULL)")
def protocol_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A stable fingerprint of each run's protocol; where it is stored is no part of it."""
    r = table(spark, d, "run_registry").select("run_id", "run_dir", "backbone", "layer_idx", "num_episodes").distinct().filter("backbone is not null and layer_idx is not null and num_episodes is not null")
    return r.select("run_id", "run_dir", mg.fingerprint(["run_id", "backbone", "layer_idx", "num_episodes"]).alias("fingerprint"))


_DROPS = "CASE WHEN chunk_start_step < 0 OR executed_chunk_len <= 0 THEN 'no_chunk' WHEN token_idx < 0 THEN 'negative_token' WHEN token_idx >= executed_chunk_len THEN 'not_executed' ELSE 'used' END"


@query(f"SELECT {_DROPS} AS reason, count(*) AS records FROM topk_rows GROUP BY 1")
def step_drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stand for no executed step, counted by reason."""
    return st.by_reason(table(spark, d, "topk_rows").withColumn("reason", act.drop_reason()), kept="used")


@query(_TRAJ + "SELECT task_id, count(*) AS episodes, count(*) FILTER (coalesce(success, false)) AS successes FROM prompts WHERE task_episode_idx < 3 GROUP BY 1")
def first_trials(spark: SparkSession, d: str) -> DataFrame:
    """Success of the first three trials of each task."""
    p = ex._prompts(spark, d).filter(F.col("task_episode_idx") < 3)
    return p.groupBy("task_id").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.coalesce("success", F.lit(False))).alias("successes"))


@query(
    _TRAJ
    + "SELECT run_id, episode_num, count(*) AS steps, count(*) FILTER (has_gripper) AS gated FROM steps JOIN (SELECT run_id, episode_num, has_gripper FROM eps) USING (run_id, episode_num) GROUP BY ALL"
)
def gated_gripper(spark: SparkSession, d: str) -> DataFrame:
    """The optional column, used only in episodes all of whose records have it."""
    s = st.with_uniform(ex._steps(spark, d).select(*tr.KEY, "gripper_qpos"), tr.KEY, "gripper_qpos", "uniform").withColumn("used", F.when(F.col("uniform"), F.col("gripper_qpos")))
    return s.groupBy(*tr.KEY).agg(F.count(F.lit(1)).alias("steps"), F.count("used").alias("gated"))


@query(_ROLES + "SELECT cluster, count(*) AS features FROM scores WHERE window_mean <> 0 GROUP BY 1")
def nonzero_rows(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with a window mean that is not zero, and how many features have one; clusters without are left out."""
    return so.scores(spark, d).filter(F.col("window_mean") != 0).groupBy("cluster").agg(F.count(F.lit(1)).alias("features"))


@query("SELECT snapshot_id, CAST(i AS INTEGER) AS robot, e.key AS field FROM (SELECT snapshot_id, i, unnest(map_entries(r.gripper_fields)) AS e FROM (SELECT DISTINCT snapshot_id, unnest(robots) AS r, generate_subscripts(robots, 1) - 1 AS i FROM telemetry_snapshots)) WHERE e.value IS NOT NULL AND NOT isnan(e.value) AND NOT regexp_matches(lower(e.key), 'image|depth|segmentation') GROUP BY ALL")
def observation_state(spark: SparkSession, d: str) -> DataFrame:
    """Numeric fields of the observations, images, depth and segmentation left out."""
    r = table(spark, d, "telemetry_snapshots").select("snapshot_id", F.posexplode("robots").alias("robot", "r"))
    m = F.map_filter("r.gripper_fields", lambda k, v: v.isNotNull() & ~F.isnan(v) & ~F.lower(k).rlike("image|depth|segmentation"))
    return r.select("snapshot_id", "robot", F.explode(F.map_keys(m)).alias("field")).distinct()


@query("SELECT count(*) FILTER (regexp_matches(json_state, '\"[^\"]*[Gg][Rr][Aa][Ss][Pp][^\"]*\"\\s*:')) AS snapshots, count(*) FILTER (regexp_matches(json_state, '\"[^\"]*[Ll][Oo][Gg][Ii][Tt][^\"]*\"\\s*:')) AS forbidden FROM telemetry_snapshots")
def forbidden_fields(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots whose JSON has a key that contains a word, at any depth."""
    has = lambda w: F.col("json_state").rlike(mg.key_pattern(w))
    return table(spark, d, "telemetry_snapshots").agg(F.count_if(has("grasp")).alias("snapshots"), F.count_if(has("logit")).alias("forbidden"))


@query("SELECT run_id, layer_idx, count(*) AS shards, count(*) FILTER (num_rows >= 1500) AS kept FROM shard_registry GROUP BY ALL")
def sized_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards above a least size."""
    s = table(spark, d, "shard_registry")
    return s.groupBy("run_id", "layer_idx").agg(F.count(F.lit(1)).alias("shards"), F.count_if(F.col("num_rows") >= 1500).alias("kept"))


@query("SELECT cluster_id, feature_id, CAST(max(score) AS DOUBLE) AS value FROM score_matrix WHERE NOT isnan(score) GROUP BY ALL")
def legacy_scores(spark: SparkSession, d: str) -> DataFrame:
    """A matrix under the first of the names that the table has for it."""
    s = table(spark, d, "score_matrix")
    return s.select("cluster_id", "feature_id", st.first_of(s, ["score_matrix", "score", "scores"]).cast("double").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("cluster_id", "feature_id").agg(F.max("value").alias("value"))


# ---- aggregates -----------------------------------------------------------------------------------------------------


@query(_ROLES + ", f AS (SELECT cluster, arg_min(task, sample) AS task FROM w GROUP BY cluster) SELECT f.cluster, feature, round(task_mean, 6) AS task_mean FROM f JOIN taskm USING (task)")
def cluster_task_means(spark: SparkSession, d: str) -> DataFrame:
    """The task means, carried to the clusters; a cluster's task is that of its first scored event."""
    return act.task_means_of_clusters(so._windows(spark, d), so._task_means(spark, d), "sample").select("cluster", "feature", F.round("task_mean", 6).alias("task_mean"))


@query(_ROLES + "SELECT c.cluster, count(e.sample) AS members, count(DISTINCT e.episode) AS member_episodes FROM (SELECT DISTINCT cluster FROM events_v UNION ALL SELECT 'never_seen') c LEFT JOIN events_v e ON c.cluster = e.cluster GROUP BY 1")
def cluster_member_counts(spark: SparkSession, d: str) -> DataFrame:
    """Members and distinct episodes of every cluster, 0 for one without members."""
    e = so.events(spark, d)
    c = e.select("cluster").distinct().unionByName(spark.createDataFrame([("never_seen",)], "cluster string"))
    return sc.member_counts(c, e)


@query(
    "WITH d AS (SELECT vec_id, label AS shard, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), f AS (SELECT *, round(x, 1) AS h, x - round(x, 1) AS r FROM d), g AS (SELECT dim, count(*) AS n, sum(x) AS sx, sum(r) AS sr, sum(x * x) AS sxx, sum(r * r) AS srr, bool_or(h <> 0) AS alive, count(*) FILTER (h <> 0) AS nz, bool_and(NOT isnan(x) AND NOT isinf(x)) AS fx FROM f GROUP BY dim) SELECT max(n) AS num_rows, (SELECT count(DISTINCT shard) FROM d) AS num_shards, round(1 - sum(srr - sr * sr / n) / sum(sxx - sx * sx / n), 6) AS frac_variance_explained, round(sum(srr) / sum(n), 6) AS reconstruction_mse, count(*) FILTER (alive) AS alive_features, round(count(*) FILTER (alive) / count(*), 6) AS alive_fraction, round(sum(nz) / max(n), 6) AS mean_l0, bool_and(fx) AS all_finite FROM g"
)
def fidelity_full(spark: SparkSession, d: str) -> DataFrame:
    """Explained variance, error, living features, mean number of active features and finiteness, in one pass."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("shard"), F.posexplode("embedding").alias("dim", "x"))
    x, h = F.col("x").cast("double"), F.round(F.col("x").cast("double"), 1)
    f = act.fidelity_report(e.select("shard", "dim", x.alias("x"), (x - h).alias("residual"), h.alias("latent")))
    return f.select("num_rows", "num_shards", *[F.round(c, 6).alias(c) for c in ("frac_variance_explained", "reconstruction_mse")], "alive_features", *[F.round(c, 6).alias(c) for c in ("alive_fraction", "mean_l0")], "all_finite")


@query("SELECT run_id, count(*) FILTER (b <> 0) AS active_before, round(max(b), 5) AS max_before, count(*) FILTER (a <> 0) AS active_after, round(max(a), 5) AS max_after, round(sum(abs(a - b)), 4) AS absolute_delta FROM (SELECT run_id, v AS b, CASE WHEN f % 7 = 0 THEN 0.25 * v ELSE v END AS a FROM (SELECT run_id, unnest(top_feature_ids[:least(len(top_feature_ids), len(top_feature_vals))]) AS f, CAST(unnest(top_feature_vals[:least(len(top_feature_ids), len(top_feature_vals))]) AS DOUBLE) AS v FROM topk_rows) WHERE f IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)) GROUP BY run_id")
def intervention_stats(spark: SparkSession, d: str) -> DataFrame:
    """Activations before and after features are scaled to a quarter; values that are no finite numbers have no scale."""
    v = act.long_form(table(spark, d, "topk_rows"), ["run_id"]).filter(~F.isnan("value") & (F.abs("value") < float("inf")))
    after = F.when(F.col("feature") % 7 == 0, 0.25 * F.col("value")).otherwise(F.col("value"))
    r = v.groupBy("run_id").agg(*fa.perturbation_sums(F.col("value"), after))
    return r.select("run_id", "active_before", F.round("max_before", 5).alias("max_before"), "active_after", F.round("max_after", 5).alias("max_after"), F.round("absolute_delta", 4).alias("absolute_delta"))


@query(
    _TRAJ
    + _ROLES.replace("WITH ", ", ", 1)
    + ", e AS (SELECT episode_num % 64 AS feature, coalesce(success, false)::INT AS s FROM prompts), m AS (SELECT feature, string_agg(ranking, ',' ORDER BY ranking) AS rankings FROM ranked WHERE rank <= 5 GROUP BY feature) SELECT CAST(e.feature AS BIGINT) AS feature, coalesce(any_value(rankings), '') AS rankings, count(*) AS episodes, round(avg(s), 6) AS success_rate, round(avg(s) - (SELECT avg(s) FROM e), 6) AS delta FROM e LEFT JOIN m ON e.feature = m.feature GROUP BY 1"
)
def feature_delta_success(spark: SparkSession, d: str) -> DataFrame:
    """Success under an intervention on each feature against the baseline, with the rankings that name the feature."""
    e = ex._prompts(spark, d).select((F.col("episode_num") % 64).cast("long").alias("feature"), F.coalesce("success", F.lit(False)).cast("int").alias("s"))
    return sc.delta_by_feature(e, so.feature_memberships(spark, d)).select("feature", "rankings", "episodes", F.round("success_rate", 6).alias("success_rate"), F.round("delta", 6).alias("delta"))


@query(
    _TRAJ
    + ", c AS (SELECT episode_num % 2 AS c, count(*) AS n, avg(coalesce(success, false)::INT) AS r, count(DISTINCT task_id) AS t FROM prompts GROUP BY 1) SELECT a.n AS raw_episodes, b.n AS hooked_episodes, round(a.r, 6) AS raw_rate, round(b.r, 6) AS hooked_rate, round(b.r - a.r, 6) AS delta, round(a.r - b.r, 6) AS success_drop, a.t = b.t AS same_protocol FROM c a, c b WHERE a.c = 0 AND b.c = 1"
)
def hooked_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two results side by side, with whether their protocols agree."""
    p = ex._prompts(spark, d)
    one = lambda i: p.filter(F.col("episode_num") % 2 == i).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("success", F.lit(False)).cast("int")).alias("rate"), F.count_distinct("task_id").alias("protocol"))
    r = sc.compare_results(one(0), one(1), ["protocol"])
    return r.select("raw_episodes", "hooked_episodes", *[F.round(c, 6).alias(c) for c in ("raw_rate", "hooked_rate", "delta", "success_drop")], "same_protocol")


@query(_ROLES + "SELECT ranking, CAST(5 AS BIGINT) AS expected, count(*) AS entries, count(DISTINCT feature) AS features, count(*) = 5 AND count(DISTINCT rank) = 5 AND count(DISTINCT feature) = 5 AND max(rank) = 5 AND min(rank) = 1 AS exact FROM ranked WHERE rank <= 5 GROUP BY 1")
def ranking_counts(spark: SparkSession, d: str) -> DataFrame:
    return st.ranking_counts(so.candidates(spark, d), {n: 5 for n in so.SUITES})


@query(_ROLES + ", o AS (SELECT ranking, feature FROM ranked WHERE rank = 1) SELECT ranking, feature, CASE WHEN (SELECT count(*) FROM o x WHERE x.feature = o.feature) > 1 THEN 'shared' ELSE 'picked' END AS reason FROM o")
def rank_one_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best feature of each ranking; two rankings may not pick the same one."""
    return st.one_per_rank(so.candidates(spark, d), so.SUITES).withColumn("reason", F.coalesce("reason", F.lit("picked")))


@query(_ROLES + "SELECT feature, CAST(min(CASE ranking WHEN 'event_aligned' THEN 0 WHEN 'window_mean' THEN 5 ELSE 10 END + rank - 1) AS INTEGER) AS first_seen FROM ranked WHERE rank <= 5 GROUP BY 1")
def feature_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Features in the order in which the candidate list first names them."""
    return sc.first_seen(so.candidates(spark, d), so.SUITES, 5)


@query(_ROLES + "SELECT ranking, CAST(rank AS INTEGER) AS rank, feature FROM ranked WHERE rank <= 5")
def candidates_with_control(spark: SparkSession, d: str) -> DataFrame:
    """All four lists; the random control comes with a score of 0 and is left out of the SQL check, since it is drawn."""
    c = so.candidates(spark, d).unionByName(so.random_alive(spark, d))
    return c.filter((F.col("ranking") != "random_alive") | (F.col("score") != 0)).select("ranking", "rank", "feature")


@query("SELECT run_id, layer_idx, count(*) AS steps, count(*) FILTER (n <> 1) AS off_steps, CAST(max(n) AS BIGINT) AS most FROM (SELECT run_id, layer_idx, episode_num, step_in_episode, count(DISTINCT global_forward_idx) AS n FROM activation_index WHERE episode_num <> -1 AND step_in_episode IS NOT NULL GROUP BY ALL) GROUP BY ALL")
def forwards_per_step(spark: SparkSession, d: str) -> DataFrame:
    """Steps whose number of forwards is not the expected one."""
    return act.forwards_off(table(spark, d, "activation_index").filter("episode_num <> -1 and step_in_episode is not null"), 1)


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 8), lambda i: abs(CAST(embedding[i] AS DOUBLE)))) / 7, 6) AS mean_abs, round(list_sum(list_transform(range(1, 8), lambda i: CAST(embedding[i] AS DOUBLE) ** 2)) / 7, 6) AS mean_square FROM embeddings")
def nested_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of nested metrics over seven action dimensions."""
    dims = F.transform(F.slice("embedding", 1, 7), lambda x: F.struct(F.abs(x.cast("double")).alias("mean_abs"), (x.cast("double") * x.cast("double")).alias("mean_square")))
    e = table(spark, d, "embeddings").select("vec_id", dims.alias("dims"))
    return e.select("vec_id", *[F.round(sc.nested_mean(F.col("dims"), c), 6).alias(c) for c in ("mean_abs", "mean_square")])


@query(_ROLES + "SELECT count(DISTINCT task) AS tasks, count(*) AS clusters FROM canon")
def recurring_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that have a recurring cluster."""
    return so.canonical(spark, d).agg(F.count_distinct("task").alias("tasks"), F.count(F.lit(1)).alias("clusters"))


@query("SELECT run_id, array_to_string(list_sort(list(DISTINCT executed_chunk_len)), ',') AS lengths FROM topk_rows WHERE executed_chunk_len > 0 GROUP BY 1")
def chunk_length_tags(spark: SparkSession, d: str) -> DataFrame:
    """The distinct lengths of executed chunks of each run, in order; there are no more of them than a chunk has entries."""
    t = table(spark, d, "topk_rows").filter("executed_chunk_len > 0")
    return t.groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set("executed_chunk_len")).cast("array<string>"), ",").alias("lengths"))


@query(
    _PAIRS
    + f"SELECT task, count(*) AS steps, count(*) FILTER (m > 1e-6) AS changed, count(DISTINCT entity) FILTER (m > 1e-6) AS changed_entities FROM (SELECT entity, CASE WHEN in_a AND in_b THEN {ex._far('va', 'vb')} END AS m, CAST(CAST(right(entity, 2) AS INTEGER) % 10 AS INTEGER) AS task FROM p WHERE in_a AND in_b) GROUP BY GROUPING SETS ((task), ())"
)
def divergence_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Changed steps per task and over all (task -1)."""
    p = ex._pairs(spark, d).filter("a_here and b_here")
    m = p.select("entity", (F.substring("entity", -2, 2).cast("int") % 10).alias("task"), (ex.max_abs_delta(F.col("a_qvel"), F.col("b_qvel")) > 1e-6).alias("changed"))
    g = m.rollup("task").agg(F.count(F.lit(1)).alias("steps"), F.count_if("changed").alias("changed"), F.count_distinct(F.when(F.col("changed"), F.col("entity"))).alias("changed_entities"))
    return g.fillna(-1, ["task"])


ORACLE["divergence_rollup"] = f"SELECT * REPLACE (coalesce(task, -1) AS task) FROM ({ORACLE['divergence_rollup']})"


@query(
    _TRAJ
    + "SELECT run_id, episode_num, step // 64 AS segment, count(*) AS n, string_agg(step, ',' ORDER BY step) AS steps, CAST(sum(coalesce(CAST(round_even(CASE WHEN isnan(eef_pos[1]) THEN 0 ELSE eef_pos[1] END * 1e6, 0) AS BIGINT), 0) * (step % 64 + 1)) AS BIGINT) AS weighted_x FROM steps WHERE eef_pos IS NOT NULL GROUP BY ALL"
)
def episode_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Ordered vectors of each episode, a bounded segment of steps a row; shown as their steps and a sum that depends on the order."""
    v = tr.assemble_vectors(ex._steps(spark, d), ["eef_pos"], segment=64)
    weighted = F.aggregate("vectors", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.rint(F.nanvl(x["eef_pos"][0], F.lit(0.0)) * 1e6).cast("long"), F.lit(0).cast("long")) * (x["step"] % 64 + 1))
    return v.select(*tr.KEY, F.col("segment").cast("long").alias("segment"), F.size("vectors").cast("long").alias("n"), F.array_join(F.transform("vectors", lambda x: x["step"].cast("string")), ",").alias("steps"), weighted.alias("weighted_x"))


# ---- windows, order, sets -------------------------------------------------------------------------------------------


@query(
    f"WITH i AS (SELECT DISTINCT {sql_path('shard_path')} AS path, row_start, row_end FROM activation_index), s AS (SELECT {sql_path('shard_path')} AS path, max(num_rows) AS registered FROM shard_registry GROUP BY 1), o AS (SELECT *, row_start - coalesce(lag(row_end) OVER w, 0) AS jump FROM i WHERE path IS NOT NULL AND row_end > row_start WINDOW w AS (PARTITION BY path ORDER BY row_start, row_end)) SELECT path, bool_and(jump = 0) AS tiles, coalesce(max(row_end) = any_value(registered), false) AS full_length FROM o LEFT JOIN s USING (path) GROUP BY path"
)
def interval_tiling(spark: SparkSession, d: str) -> DataFrame:
    """Do the intervals of a shard lie end to end from 0, without gap or overlap, up to its registered number of rows?"""
    i = table(spark, d, "activation_index").withColumn("path", normal_path(F.col("shard_path"))).filter(F.col("path").isNotNull())
    reg = table(spark, d, "shard_registry").groupBy(normal_path(F.col("shard_path")).alias("path")).agg(F.max("num_rows").alias("registered"))
    return act.interval_tiling(i, ["path"]).join(reg, "path", "left").select("path", "tiles", F.coalesce(F.col("last_row") == F.col("registered"), F.lit(False)).alias("full_length"))


@query("SELECT run_id, count(*) AS rows_seen, count(*) FILTER (global_forward_idx < p) AS decreases, coalesce(min(index_id) FILTER (global_forward_idx < p), -1) AS first_at FROM (SELECT *, lag(global_forward_idx) OVER (PARTITION BY run_id ORDER BY index_id) AS p FROM (SELECT index_id, run_id, max(global_forward_idx) AS global_forward_idx FROM activation_index GROUP BY ALL)) GROUP BY run_id")
def index_disorder(spark: SparkSession, d: str) -> DataFrame:
    """Where a key decreases along the stored order."""
    i = table(spark, d, "activation_index").groupBy("run_id", "index_id").agg(F.max("global_forward_idx").alias("forward"))
    return act.disorder(i, ["run_id"], "index_id", "forward")


@query(
    _TRAJ
    + ", det AS (SELECT run_id, episode_num, arg_min(t_detach, confirmed) AS t_detach FROM conf GROUP BY ALL) SELECT d.run_id, d.episode_num, t_detach, t_detach + 1 AS t_obs, coalesce(min(g.step) FILTER (g.g AND g.step > t_detach), -1) AS next_contact FROM det d JOIN grasp g USING (run_id, episode_num) GROUP BY ALL"
)
def post_detach(spark: SparkSession, d: str) -> DataFrame:
    """The first observation after each confirmed detachment, and the first contact from then on."""
    t = ex.detach_tracker(spark, d).filter("t_detach is not null and t_detach >= 0").select(*tr.KEY, "t_detach")
    g = ex._grasps(spark, d).join(t, tr.KEY)
    c = g.groupBy(*tr.KEY, "t_detach").agg(F.min(F.when(F.coalesce("grasped", F.lit(False)) & (F.col("step") > F.col("t_detach")), F.col("step"))).alias("next_contact"))
    return c.select(*tr.KEY, "t_detach", (F.col("t_detach") + 1).alias("t_obs"), F.coalesce("next_contact", F.lit(-1)).alias("next_contact"))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda y: y > embedding[label + 1])) + 1 AS INTEGER) AS selected_rank FROM embeddings")
def selected_rank(spark: SparkSession, d: str) -> DataFrame:
    """The rank of a selected entry inside its vector."""
    return table(spark, d, "embeddings").select("vec_id", rank_in(F.col("embedding"), F.element_at("embedding", F.col("label") + 1)).alias("selected_rank"))


@query(_ROLES + "SELECT sample, row_number() OVER (ORDER BY task, cluster, episode, waypoint_step, sample) AS position FROM events_v")
def event_order(spark: SparkSession, d: str) -> DataFrame:
    """Events in a stable order of several keys, numbered without a single task."""
    return global_rank(so.events(spark, d).select("task", "cluster", "episode", "waypoint_step", "sample"), ["task", "cluster", "episode", "waypoint_step", "sample"], "position").select("sample", "position")


@query(_TRAJ + "SELECT run_id, row_number() OVER (ORDER BY t, run_id) AS position FROM (SELECT run_id, list_sort(list(DISTINCT task_id)) AS t FROM prompts WHERE task_id IS NOT NULL GROUP BY 1)")
def source_order(spark: SparkSession, d: str) -> DataFrame:
    """Runs in the order of their task ids, then of their name."""
    t = ex._prompts(spark, d).filter("task_id is not null").groupBy("run_id").agg(F.sort_array(F.collect_set("task_id")).alias("tasks"))  # at most the tasks there are
    return global_rank(t, ["tasks", "run_id"], "position").select("run_id", "position")


@query("SELECT CAST(len(list_intersect(list_filter(top_feature_ids, lambda x: x IS NOT NULL), [19, 24, 1000, 1001])) AS INTEGER) AS shared, count(*) AS n_rows FROM topk_rows WHERE top_feature_ids IS NOT NULL GROUP BY 1")
def feature_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many of a given set of features a row holds."""
    t = table(spark, d, "topk_rows").filter("top_feature_ids is not null")
    n = F.size(F.array_intersect("top_feature_ids", F.array(*[F.lit(x) for x in (19, 24, 1000, 1001)])))
    return t.groupBy(n.alias("shared")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT batch, count(*) AS n_rows, CAST(min(vec_id) AS BIGINT) AS first_id FROM (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS batch FROM embeddings) GROUP BY batch")
def row_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rows in full batches and one tail."""
    b = act.batches(table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id")), ["vec_id"], 64)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.min("vec_id").alias("first_id"))


@query("SELECT shard_path, row_start, row_end, row_number() OVER (PARTITION BY shard_path ORDER BY row_start, row_end) AS position FROM (SELECT DISTINCT shard_path, row_start, row_end FROM activation_index WHERE layer_idx = 15 AND shard_path IS NOT NULL)")
def layer_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of one layer, each shard in the order of its rows."""
    return act.index_of_layer(table(spark, d, "activation_index"), 15)
