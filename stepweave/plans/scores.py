"""Feature scoring, ranking and event clusters over the role views of the star schema.

Activations: lineitem (episode = supplier, step = month since 1995, feature = part mod 64, value = quantity).
Events: embeddings (episode and waypoint from the vector's id, cluster from task and label).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions.text import parse_answer, slug
from stepweave.functions.vectors import entropy, softmax, top_margin
from stepweave.operators import activations as act
from stepweave.operators import clusters as cl
from stepweave.operators import scoring as sc
from stepweave.operators.windows import fit_windows, template_weights
from stepweave.runtime import cut, table

HALF = 5
MIN_COVERAGE = 0.5


def acts(spark: SparkSession, d: str) -> DataFrame:
    """One row per token: episode, step, feature, value."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("episode"), ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("step"), (F.col("l_partkey") % 64).cast("long").alias("feature"), F.col("l_quantity").cast("double").alias("value"))


_known: dict[tuple[str, str], int] = {}


def _episodes(spark: SparkSession, d: str) -> int:
    """Distinct episodes of the activations, counted once for an application and folder."""
    key = spark.sparkContext.applicationId, d
    if key not in _known:
        _known[key] = table(spark, d, "lineitem").agg(F.count_distinct("l_suppkey")).first()[0]
    return _known[key]


def events(spark: SparkSession, d: str) -> DataFrame:
    n = _episodes(spark, d)
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("sample"), (F.col("vec_id") % n).cast("long").alias("episode"), (1 + (F.col("vec_id") * 7) % 81).cast("int").alias("waypoint_step"), F.lit(83).alias("num_steps"), "label", "embedding")
    e = e.withColumn("task", (F.col("episode") % 10).cast("int"))
    return e.withColumns({"cluster": F.concat(F.lit("t"), F.col("task"), F.lit("_c"), F.col("label") % 3), "progress": F.col("waypoint_step") / F.greatest(F.col("num_steps") - 1, F.lit(1))})


def timesteps(spark: SparkSession, d: str) -> DataFrame:
    return acts(spark, d).select("episode", "step").distinct()


def means(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    a = acts(spark, d)
    if only is not None:
        a = a.join(only, ["episode", "step"], "left_semi")
    return act.timestep_mean(a, a, ["episode", "step"])


def _windows(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("sample", "episode", "task", "cluster", "waypoint_step", "num_steps")
    return cut(sc.complete_windows(e, timesteps(spark, d), HALF))  # read by several branches


def scores(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d)
    need = w.select("episode", "step").distinct()
    return sc.cluster_scores(sc.score_events(w, means(spark, d, need), HALF), w)


def canonical(spark: SparkSession, d: str) -> DataFrame:
    """Recurring clusters: enough of their task's attempted episodes hold a member."""
    attempted = acts(spark, d).select("episode").distinct().groupBy((F.col("episode") % 10).cast("int").alias("task")).agg(F.count(F.lit(1)).alias("n_attempted"))
    return sc.coverage(events(spark, d), attempted).filter(F.col("episode_coverage") >= MIN_COVERAGE)


def _task_means(spark: SparkSession, d: str) -> DataFrame:
    task = (F.col("episode") % 10).cast("int")
    chosen = _windows(spark, d).select("task").distinct()
    m = means(spark, d).withColumn("task", task).join(chosen, "task", "left_semi")
    return act.task_mean(m, timesteps(spark, d).withColumn("task", task))


# ---- queries --------------------------------------------------------------------------------------------------------


def window_shift(spark: SparkSession, d: str) -> DataFrame:
    return fit_windows(events(spark, d), HALF).select("sample", "window_start", "window_shift", "event_idx")


def template_table(spark: SparkSession, d: str) -> DataFrame:
    return template_weights(spark, HALF).select("event_idx", "pos", F.round("pulse", 6).alias("pulse"), F.coalesce(F.round("step_up", 6), F.lit(0.0)).alias("step_up"))


def required_timesteps(spark: SparkSession, d: str) -> DataFrame:
    need = sc.required_timesteps(events(spark, d), HALF)
    have = timesteps(spark, d).withColumn("cached", F.lit(True))
    return need.join(have, ["episode", "step"], "left").groupBy("episode").agg(F.count(F.lit(1)).alias("needed"), F.count("cached").alias("found"))


def timestep_mean(spark: SparkSession, d: str) -> DataFrame:
    return means(spark, d).select("episode", "step", "feature", F.round("x", 6).alias("x"))


def task_mean(spark: SparkSession, d: str) -> DataFrame:
    return _task_means(spark, d).select("task", "feature", F.round("task_mean", 6).alias("task_mean"), "n_timesteps")


def cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("cluster", "feature", F.round("score", 6).alias("score"), F.round("window_mean", 6).alias("window_mean"), "n_episodes", "num_events")


def cluster_top_features(spark: SparkSession, d: str) -> DataFrame:
    return sc.top_features(scores(spark, d), "cluster", "score", 5)


def window_mean_top_features(spark: SparkSession, d: str) -> DataFrame:
    return sc.top_features(scores(spark, d), "cluster", "window_mean", 5, positive=True)


def cluster_coverage(spark: SparkSession, d: str) -> DataFrame:
    attempted = acts(spark, d).select("episode").distinct().groupBy((F.col("episode") % 10).cast("int").alias("task")).agg(F.count(F.lit(1)).alias("n_attempted"))
    c = sc.coverage(events(spark, d), attempted)
    return c.select("task", "cluster", "num_members", "member_episodes", "total_episodes", F.round("episode_coverage", 6).alias("episode_coverage"), F.round("mean_progress", 6).alias("mean_progress"))


SUITES = ("event_aligned", "window_mean", "task_mean")


def _suites(spark: SparkSession, d: str, names: tuple[str, ...] = SUITES) -> dict[str, DataFrame]:
    c = cut(canonical(spark, d))
    s = cut(scores(spark, d)) if set(names) & set(SUITES[:2]) else None
    make = {"event_aligned": lambda: sc.suite_event_aligned(s, c), "window_mean": lambda: sc.suite_window_mean(s, c), "task_mean": lambda: sc.suite_task_mean(_task_means(spark, d), c)}
    return {n: make[n]() for n in names}


def suite_event_aligned(spark: SparkSession, d: str) -> DataFrame:
    return sc.ranked(_suites(spark, d, ("event_aligned",))["event_aligned"], "event_aligned", 10)


def suite_window_mean(spark: SparkSession, d: str) -> DataFrame:
    return sc.ranked(_suites(spark, d, ("window_mean",))["window_mean"], "window_mean", 10)


def suite_task_mean(spark: SparkSession, d: str) -> DataFrame:
    return sc.ranked(_suites(spark, d, ("task_mean",))["task_mean"], "task_mean", 10)


def alive_features(spark: SparkSession, d: str) -> DataFrame:
    return act.alive_features(act.long_form(table(spark, d, "topk_rows"), ["run_id"])).select(F.col("feature").cast("long").alias("feature"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """The informed rankings in one list, with the other rankings that name each feature."""
    s = _suites(spark, d)
    c = sc.ranked(s["event_aligned"], "event_aligned", 5)
    for n in ("window_mean", "task_mean"):
        c = c.unionByName(sc.ranked(s[n], n, 5))
    return c


def feature_memberships(spark: SparkSession, d: str) -> DataFrame:
    return sc.memberships(candidates(spark, d))


def random_alive(spark: SparkSession, d: str) -> DataFrame:
    informed = candidates(spark, d).select("feature").distinct()
    return sc.random_alive(alive_features(spark, d), informed, 5)


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of clusters, from documents: the label is the phrase, defects become errors."""
    c = events(spark, d).select("cluster", "task").distinct()
    n = F.pmod(F.substring("cluster", 2, 1).cast("int") * 3 + F.substring("cluster", 5, 1).cast("int"), F.lit(7))
    a = c.withColumns({"n": n}).withColumns({"api_error": F.when(F.col("n") == 0, "quota"), "parse_error": F.when(F.col("n") == 1, "no json"), "phrase": F.when(F.col("n") == 2, " ").otherwise(F.concat(F.lit("phrase "), "cluster")), "phase": F.when(F.col("n") == 3, F.lit(None)).otherwise(F.lit("contact"))})
    return a.filter(F.col("n") != 6).withColumn("reason", cl.annotation_reason(F.col("api_error"), F.col("parse_error"), F.col("phrase"), F.col("phase")))


def annotation_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _annotated(spark, d).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("annotations"))


def annotation_overlay(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d).select("cluster", "task").distinct()
    return cl.overlay_annotations(c, _annotated(spark, d)).select("cluster", "task", "phrase", "phase", "annotation_valid")


def cluster_join_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Assignments joined to clusters and events; some of either are taken away to be accounted for."""
    e = events(spark, d)
    a = e.select("sample", "cluster", "task")
    c = e.select("cluster", "task").distinct().filter(F.col("cluster") != "t3_c1")
    r = cl.join_accounting(a, c, e.filter(F.col("sample") % 13 != 0).select("sample"))
    return r.groupBy(F.coalesce("reason", F.lit("joined")).alias("reason")).agg(F.count(F.lit(1)).alias("assignments"))


def row_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.explode(act.row_topk(F.col("embedding"), 5)).alias("p"))
    return e.select("vec_id", F.col("p.feature").cast("int").alias("feature"), F.round("p.value", 6).alias("value"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("shard"), F.posexplode("embedding").alias("dim", "x"))
    x = F.col("x").cast("double")
    return e.select("shard", "dim", x.alias("x"), (x - F.round(x, 1)).alias("residual"))


def fidelity_global(spark: SparkSession, d: str) -> DataFrame:
    f = act.fidelity(act.fidelity_sums(_dense(spark, d)))
    return f.select("num_rows", F.round("frac_variance_explained", 6).alias("frac_variance_explained"), F.round("reconstruction_mse", 6).alias("reconstruction_mse"))


def fidelity_merge(spark: SparkSession, d: str) -> DataFrame:
    m = act.merge_moments(act.shard_moments(_dense(spark, d)))
    return m.select("dim", "n", *[F.round(c, 6).alias(c) for c in ("mean_x", "m2_x", "mean_residual", "m2_residual")])


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Event feature vectors: the embedding as vision, its first three elements as state."""
    e = events(spark, d).select("sample", "episode", "task", "cluster", "embedding", "progress", *[F.col("embedding")[i].cast("double").alias(f"s{i}") for i in range(3)])
    z = cl.zscore(e, "task", ["s0", "s1", "s2", "progress"])
    return z.select("sample", "episode", "task", "cluster", cl.task_vector(F.col("embedding"), F.array("s0", "s1", "s2"), F.col("progress")).alias("vector"))


def zscore_by_task(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("sample", "task", *[F.col("embedding")[i].cast("double").alias(f"s{i}") for i in range(3)])
    return cl.zscore(e, "task", ["s0", "s1", "s2"]).select("sample", "task", *[F.round(f"s{i}", 6).alias(f"s{i}") for i in range(3)])


def cosine_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    return cl.centroid_distance(_vectors(spark, d), "cluster", "vector").select("sample", "cluster", F.round("distance", 6).alias("distance"))


def exemplars(spark: SparkSession, d: str) -> DataFrame:
    x = cl.exemplars(cl.centroid_distance(_vectors(spark, d), "cluster", "vector"), "cluster", 5, ["sample"])
    return x.select("cluster", "exemplar_rank", "sample", "episode")


def agglomerative(spark: SparkSession, d: str) -> DataFrame:
    return cl.agglomerate(_vectors(spark, d), "task", "sample", "vector", threshold=0.5)


def entropy_margin(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "embeddings").select("vec_id", softmax(F.transform("embedding", lambda x: x * 20)).alias("p"))
    return p.select("vec_id", F.round(entropy(F.col("p")), 5).alias("entropy_nats"), F.round(F.array_max("p"), 5).alias("top1_probability"), F.round(top_margin(F.col("p")), 5).alias("top1_top2_margin"))


def annotation_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers built from score_matrix: JSON with phrase and phase, some of it spoilt."""
    s = table(spark, d, "score_matrix").select("task_description", "phase").distinct()
    text = F.to_json(F.struct(F.col("task_description").alias("phrase"), "phase"))
    a = parse_answer(text)
    return s.select("task_description", "phase", a.alias("a")).select(F.coalesce("task_description", F.lit("")).alias("described"), F.coalesce("phase", F.lit("")).alias("stated"), F.col("a.phrase").alias("phrase"), F.col("a.error").alias("error"), slug(F.col("task_description")).alias("slug"))


QUERIES = {
    f.__name__: f
    for f in (cluster_top_features, window_shift, template_table, required_timesteps, timestep_mean, task_mean, cluster_scores, window_mean_top_features, cluster_coverage, suite_event_aligned, suite_window_mean, suite_task_mean, alive_features, candidates, feature_memberships, random_alive, annotation_cascade, annotation_overlay, cluster_join_accounting, row_topk, fidelity_global, fidelity_merge, zscore_by_task, cosine_to_centroid, exemplars, agglomerative, entropy_margin, annotation_answers)
}

_ROLES = """
WITH acts AS (SELECT l_suppkey AS episode, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS step, l_partkey % 64 AS feature, CAST(l_quantity AS DOUBLE) AS value FROM lineitem),
ev0 AS (SELECT vec_id AS sample, vec_id % (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS episode, 1 + (vec_id * 7) % 81 AS waypoint_step, 83 AS num_steps, label, embedding FROM embeddings),
events_v AS (SELECT *, episode % 10 AS task, 't' || (episode % 10) || '_c' || (label % 3) AS cluster, waypoint_step / 82.0 AS progress FROM ev0),
win0 AS (SELECT *, -greatest(waypoint_step + 5 - 82, 0) AS back FROM events_v),
win AS (SELECT *, back + greatest(0, -(waypoint_step - 5 + back)) AS shift FROM win0),
tm AS (SELECT s.episode, s.step, s.feature, s.total / n.n AS x FROM (SELECT episode, step, feature, sum(value) AS total FROM acts GROUP BY ALL) s JOIN (SELECT episode, step, count(*) AS n FROM acts GROUP BY ALL) n USING (episode, step)),
ts AS (SELECT DISTINCT episode, step FROM acts),
wsteps AS (SELECT sample, episode, task, cluster, 5 - shift AS event_idx, p AS pos, waypoint_step - 5 + shift + p AS step FROM win, (SELECT unnest(range(11)) AS p)),
complete AS (SELECT sample FROM wsteps JOIN ts USING (episode, step) GROUP BY sample HAVING count(*) = 11),
w AS (SELECT * FROM wsteps WHERE sample IN (SELECT sample FROM complete)),
tpl0 AS (SELECT i AS event_idx, p AS pos, greatest(0, 1 - abs(p - i) / 6.0) AS pu, CASE WHEN p < i THEN -1.0 ELSE 1.0 END AS su FROM (SELECT unnest(range(11)) AS i), (SELECT unnest(range(11)) AS p)),
tpl1 AS (SELECT event_idx, pos, pu - avg(pu) OVER g AS pu, su - avg(su) OVER g AS su FROM tpl0 WINDOW g AS (PARTITION BY event_idx)),
tpl AS (SELECT event_idx, pos, pu / sqrt(sum(pu * pu) OVER g) AS pulse, CASE WHEN sum(su * su) OVER g > 1e-20 THEN su / sqrt(sum(su * su) OVER g) END AS step_up FROM tpl1 WINDOW g AS (PARTITION BY event_idx)),
es AS (SELECT cluster, episode, sample, feature, greatest(sum(pulse * x), 0) AS pu, greatest(sum(step_up * x), 0) AS up, greatest(-sum(step_up * x), 0) AS dn, sum(x) / 11 AS wm FROM w JOIN tm USING (episode, step) JOIN tpl USING (event_idx, pos) GROUP BY ALL),
smp AS (SELECT DISTINCT cluster, episode, sample FROM w),
pe AS (SELECT cluster, episode, count(*) AS n FROM smp GROUP BY ALL),
pc AS (SELECT cluster, count(*) AS n_episodes, sum(n) AS num_events FROM pe GROUP BY ALL),
ce AS (SELECT cluster, feature, greatest(sum(pu) / any_value(n), sum(up) / any_value(n), sum(dn) / any_value(n)) AS s, sum(wm) / any_value(n) AS m FROM es JOIN pe USING (cluster, episode) GROUP BY cluster, episode, feature),
scores AS (SELECT cluster, feature, sum(s) / any_value(n_episodes) AS score, sum(m) / any_value(n_episodes) AS window_mean, any_value(n_episodes) AS n_episodes, CAST(any_value(num_events) AS BIGINT) AS num_events FROM ce JOIN pc USING (cluster) GROUP BY cluster, feature),
attempted AS (SELECT episode % 10 AS task, count(DISTINCT episode) AS n FROM acts GROUP BY ALL),
cov AS (SELECT task, cluster, count(*) AS num_members, count(DISTINCT episode) AS member_episodes, avg(progress) AS mean_progress FROM events_v GROUP BY ALL),
coverage AS (SELECT task, cluster, num_members, member_episodes, n AS total_episodes, member_episodes / n AS episode_coverage, mean_progress FROM cov JOIN attempted USING (task)),
canon AS (SELECT * FROM coverage WHERE episode_coverage >= 0.5),
taskm AS (SELECT task, feature, s / n AS task_mean, n AS n_timesteps FROM (SELECT episode % 10 AS task, feature, sum(x) AS s FROM tm GROUP BY ALL) JOIN (SELECT episode % 10 AS task, count(*) AS n FROM ts GROUP BY ALL) USING (task) WHERE task IN (SELECT task FROM w)),
ea AS (SELECT feature, round(sum(score) / (SELECT count(*) FROM canon WHERE cluster IN (SELECT cluster FROM scores)), 6) AS score FROM scores WHERE cluster IN (SELECT cluster FROM canon) GROUP BY feature),
wms AS (SELECT feature, round(sum(window_mean * num_events) / (SELECT sum(num_events) FROM pc WHERE cluster IN (SELECT cluster FROM canon)), 6) AS score FROM scores WHERE cluster IN (SELECT cluster FROM canon) GROUP BY feature),
tms AS (SELECT feature, round(sum(task_mean * n_timesteps) / (SELECT sum(n) FROM (SELECT DISTINCT task, n_timesteps AS n FROM taskm WHERE task IN (SELECT task FROM canon))), 6) AS score FROM taskm WHERE task IN (SELECT task FROM canon) GROUP BY feature),
ranked AS (SELECT 'event_aligned' AS ranking, *, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM ea
  UNION ALL SELECT 'window_mean', *, row_number() OVER (ORDER BY score DESC, feature) FROM wms
  UNION ALL SELECT 'task_mean', *, row_number() OVER (ORDER BY score DESC, feature) FROM tms),
vz AS (SELECT sample, episode, task, cluster, embedding, (embedding[1] - avg(embedding[1]) OVER t) / stddev_pop(embedding[1]) OVER t AS s0, (embedding[2] - avg(embedding[2]) OVER t) / stddev_pop(embedding[2]) OVER t AS s1, (embedding[3] - avg(embedding[3]) OVER t) / stddev_pop(embedding[3]) OVER t AS s2, (progress - avg(progress) OVER t) / stddev_pop(progress) OVER t AS zp FROM events_v WINDOW t AS (PARTITION BY task)),
vc AS (SELECT *, list_concat(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))), [0.5 * s0 / sqrt(s0 * s0 + s1 * s1 + s2 * s2), 0.5 * s1 / sqrt(s0 * s0 + s1 * s1 + s2 * s2), 0.5 * s2 / sqrt(s0 * s0 + s1 * s1 + s2 * s2)], [0.4 * zp]) AS v FROM vz),
vn AS (SELECT sample, episode, cluster, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM vc),
vl AS (SELECT sample, episode, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vn),
cent AS (SELECT cluster, i, avg(x) AS c FROM vl GROUP BY ALL),
centn AS (SELECT cluster, sqrt(sum(c * c)) AS n FROM cent GROUP BY ALL),
dist AS (SELECT sample, episode, cluster, round(1 - sum(x * c) / any_value(n), 6) AS distance FROM vl JOIN cent USING (cluster, i) JOIN centn USING (cluster) GROUP BY ALL)
"""
_ANN = """, ann0 AS (SELECT DISTINCT cluster, task, (CAST(substr(cluster, 2, 1) AS INTEGER) * 3 + CAST(substr(cluster, 5, 1) AS INTEGER)) % 7 AS n FROM events_v),
ann AS (SELECT cluster, task, n, CASE n WHEN 0 THEN 'api_error' WHEN 1 THEN 'parse_error' WHEN 2 THEN 'empty_phrase' WHEN 3 THEN 'empty_phase' END AS reason FROM ann0 WHERE n <> 6)
"""
_DENSE = """
WITH dense AS (SELECT label AS shard, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
d AS (SELECT shard, dim, x, x - round(x, 1) AS r FROM dense)
"""


def _top(value: str, positive: bool = False) -> str:
    keep = f"WHERE round({value}, 6) > 0" if positive else ""
    return _ROLES + f"SELECT cluster, CAST(rank AS INTEGER) AS rank, feature, {value} FROM (SELECT cluster, feature, round({value}, 6) AS {value}, row_number() OVER (PARTITION BY cluster ORDER BY round({value}, 6) DESC, feature) AS rank FROM scores {keep}) WHERE rank <= 5"


def _ranking(name: str) -> str:
    return _ROLES + f"SELECT ranking, CAST(rank AS INTEGER) AS rank, feature, score FROM ranked WHERE ranking = '{name}' AND rank <= 10"


ORACLE = {
    "cluster_top_features": _top("score"),
    "window_mean_top_features": _top("window_mean", True),
    "window_shift": _ROLES + "SELECT sample, CAST(waypoint_step - 5 + shift AS INTEGER) AS window_start, CAST(shift AS INTEGER) AS window_shift, CAST(5 - shift AS INTEGER) AS event_idx FROM win",
    "template_table": _ROLES + "SELECT CAST(event_idx AS INTEGER) AS event_idx, CAST(pos AS INTEGER) AS pos, round(pulse, 6) AS pulse, coalesce(round(step_up, 6), 0) AS step_up FROM tpl",
    "required_timesteps": _ROLES + "SELECT n.episode, count(*) AS needed, count(t.step) AS found FROM (SELECT DISTINCT episode, step FROM wsteps) n LEFT JOIN ts t ON n.episode = t.episode AND n.step = t.step GROUP BY ALL",
    "timestep_mean": _ROLES + "SELECT episode, CAST(step AS INTEGER) AS step, feature, round(x, 6) AS x FROM tm",
    "task_mean": _ROLES + "SELECT CAST(task AS INTEGER) AS task, feature, round(task_mean, 6) AS task_mean, n_timesteps FROM taskm",
    "cluster_scores": _ROLES + "SELECT cluster, feature, round(score, 6) AS score, round(window_mean, 6) AS window_mean, n_episodes, num_events FROM scores",
    "cluster_coverage": _ROLES + "SELECT CAST(task AS INTEGER) AS task, cluster, num_members, member_episodes, total_episodes, round(episode_coverage, 6) AS episode_coverage, round(mean_progress, 6) AS mean_progress FROM coverage",
    "suite_event_aligned": _ranking("event_aligned"),
    "suite_window_mean": _ranking("window_mean"),
    "suite_task_mean": _ranking("task_mean"),
    "alive_features": "SELECT DISTINCT CAST(f AS BIGINT) AS feature FROM (SELECT unnest(top_feature_ids[:least(len(top_feature_ids), len(top_feature_vals))]) AS f, unnest(top_feature_vals[:least(len(top_feature_ids), len(top_feature_vals))]) AS v FROM topk_rows) WHERE f IS NOT NULL AND v > 0 AND NOT isnan(v)",
    "candidates": _ROLES + "SELECT ranking, CAST(rank AS INTEGER) AS rank, feature, score FROM ranked WHERE rank <= 5",
    "feature_memberships": _ROLES + "SELECT feature, string_agg(ranking, ',' ORDER BY ranking) AS rankings, CAST(min(rank) AS INTEGER) AS best_rank FROM ranked WHERE rank <= 5 GROUP BY feature",
    "annotation_cascade": _ROLES + _ANN + "SELECT coalesce(reason, 'valid') AS reason, count(*) AS annotations FROM ann GROUP BY ALL",
    "annotation_overlay": _ROLES + _ANN + "SELECT a.cluster, CAST(a.task AS INTEGER) AS task, CASE WHEN v.cluster IS NULL THEN a.cluster ELSE 'phrase ' || a.cluster END AS phrase, CASE WHEN v.cluster IS NULL THEN 'unlabeled' ELSE 'contact' END AS phase, v.cluster IS NOT NULL AS annotation_valid FROM ann0 a LEFT JOIN (SELECT cluster FROM ann WHERE reason IS NULL) v ON a.cluster = v.cluster",
    "cluster_join_accounting": _ROLES + "SELECT CASE WHEN cluster = 't3_c1' THEN 'missing_cluster' WHEN sample % 13 = 0 THEN 'missing_event' ELSE 'joined' END AS reason, count(*) AS assignments FROM events_v GROUP BY ALL",
    "row_topk": "SELECT vec_id, CAST(feature AS INTEGER) AS feature, round(CAST(v AS DOUBLE), 6) AS value FROM (SELECT vec_id, feature, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, feature) AS r FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings)) WHERE r <= 5",
    "fidelity_global": _DENSE + "SELECT max(n) AS num_rows, round(1 - sum(srr - sr * sr / n) / sum(sxx - sx * sx / n), 6) AS frac_variance_explained, round(sum(srr) / sum(n), 6) AS reconstruction_mse FROM (SELECT dim, count(*) AS n, sum(x) AS sx, sum(r) AS sr, sum(x * x) AS sxx, sum(r * r) AS srr FROM d GROUP BY dim)",
    "fidelity_merge": _DENSE + "SELECT CAST(dim AS INTEGER) AS dim, count(*) AS n, round(avg(x), 6) AS mean_x, round(var_pop(x) * count(*), 6) AS m2_x, round(avg(r), 6) AS mean_residual, round(var_pop(r) * count(*), 6) AS m2_residual FROM d GROUP BY dim",
    "zscore_by_task": _ROLES + "SELECT sample, CAST(task AS INTEGER) AS task, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM vz",
    "cosine_to_centroid": _ROLES + "SELECT sample, cluster, distance FROM dist",
    "exemplars": _ROLES + "SELECT cluster, CAST(r AS INTEGER) AS exemplar_rank, sample, episode FROM (SELECT cluster, sample, episode, row_number() OVER (PARTITION BY cluster ORDER BY e > 1, distance, sample) AS r FROM (SELECT *, row_number() OVER (PARTITION BY cluster, episode ORDER BY distance, sample) AS e FROM dist)) WHERE r <= 5",
    "entropy_margin": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(20 * CAST(x AS DOUBLE) - 20 * CAST(list_max(embedding) AS DOUBLE))) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e) SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))), 5) AS entropy_nats, round(list_max(p), 5) AS top1_probability, round(list_max(p) - list_reverse_sort(p)[2], 5) AS top1_top2_margin FROM p",
    "annotation_answers": "WITH s AS (SELECT DISTINCT task_description, phase FROM score_matrix) SELECT coalesce(task_description, '') AS described, coalesce(phase, '') AS stated, nullif(trim(task_description), '') AS phrase, CASE WHEN phase IS NOT NULL AND trim(phase) IN ('pre_grasp', 'immobilization', 'contact', 'detach', 'post_grasp', 'transition') AND nullif(trim(task_description), '') IS NOT NULL THEN NULL ELSE concat_ws('; ', CASE WHEN nullif(trim(task_description), '') IS NULL THEN 'missing_or_invalid_phrase' END, CASE WHEN phase IS NULL THEN 'missing_or_invalid_phase' WHEN trim(phase) NOT IN ('pre_grasp', 'immobilization', 'contact', 'detach', 'post_grasp', 'transition') THEN 'invalid_phase:' || trim(phase) END) END AS error, coalesce(nullif(lower(trim(regexp_replace(task_description, '[^a-zA-Z0-9]+', '_', 'g'), '_')), ''), 'task') AS slug FROM s",
}
