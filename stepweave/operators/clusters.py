"""Joining events with clusters and annotations; feature vectors of events; clusters of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.vectors import cosine_distance, l2_normalize


def annotation_reason(api_error: Column, parse_error: Column, phrase: Column, phase: Column) -> Column:
    """Why an annotation is not usable, the first of the tests that fails; null if it is."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return F.when(~blank(api_error), "api_error").when(~blank(parse_error), "parse_error").when(blank(phrase), "empty_phrase").when(blank(phase), "empty_phase")


def overlay_annotations(clusters: DataFrame, annotations: DataFrame, *, annotated_only: bool = False) -> DataFrame:
    """Clusters with phrase and phase. A cluster without a valid annotation keeps its id as phrase and is unlabeled, or is dropped."""
    valid = annotations.filter(F.col("reason").isNull()).select("cluster", F.trim("phrase").alias("phrase"), F.trim("phase").alias("phase"))
    j = clusters.join(valid, "cluster", "inner" if annotated_only else "left")
    return j.withColumn("annotation_valid", F.col("phrase").isNotNull()).withColumns({"phrase": F.coalesce("phrase", "cluster"), "phase": F.coalesce("phase", F.lit("unlabeled"))})


def join_accounting(assignments: DataFrame, clusters: DataFrame, events: DataFrame) -> DataFrame:
    """assignments (sample, cluster, task) with a reason: cluster missing, then event missing, then task mismatch; null: joined."""
    c = clusters.select("cluster", F.col("task").alias("cluster_task"))
    e = events.select("sample", F.lit(True).alias("has_event"))
    j = assignments.join(c, "cluster", "left").join(e, "sample", "left")
    reason = F.when(F.col("cluster_task").isNull(), "missing_cluster").when(F.col("has_event").isNull(), "missing_event").when(F.col("task") != F.col("cluster_task"), "task_mismatch")
    return j.select("sample", "cluster", "task", reason.alias("reason"))


def zscore(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Columns as z-scores within their group: population deviation, one of at most 1e-12 counts as 1.

    Moments are aggregated and joined, so that no group is gathered.
    """
    moments = df.groupBy(by).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    j = df.join(moments, by)
    made = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 1e-12, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}
    return j.withColumns(made).drop(*[f"__{n}_{c}" for c in columns for n in "ms"])


def task_vector(vision: Column, state: Column, progress: Column, *, vision_weight: float = 1.0, state_weight: float = 0.5, progress_weight: float = 0.4) -> Column:
    """Weighted concatenation of unit vision, unit z-scored state and z-scored progress, as a unit vector."""
    scaled = lambda v, w: F.transform(l2_normalize(v), lambda x: x * w)
    return l2_normalize(F.concat(scaled(vision, vision_weight), scaled(state, state_weight), F.array(progress * progress_weight)))


def centroids(members: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Unit mean vector of each cluster, element by element: combined map-side, a cluster of any size is never gathered."""
    means = members.select(cluster, F.posexplode(vector).alias("pos", "x")).groupBy(cluster, "pos").agg(F.avg("x").alias("x"))
    lists = means.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("l"))  # one entry a dimension
    return lists.select(cluster, l2_normalize(F.transform("l", lambda p: p["x"])).alias("centroid"))


def centroid_distance(members: DataFrame, cluster: str, vector: str) -> DataFrame:
    return members.join(centroids(members, cluster, vector), cluster).withColumn("distance", cosine_distance(F.col(vector), F.col("centroid"))).drop("centroid")


def exemplars(distances: DataFrame, cluster: str, k: int, tie: list[str]) -> DataFrame:
    """Up to k members nearest the centroid: the nearest of each episode first, then the others.

    Only the k nearest of each (cluster, episode) can be chosen, and only k of
    those for a cluster; Spark prunes both before it shuffles.
    """
    d = distances.withColumn("__d", F.round("distance", 6))
    w = Window.partitionBy(cluster, "episode").orderBy("__d", *tie)
    first = d.withColumn("__e", F.row_number().over(w)).filter(F.col("__e") <= k)
    v = Window.partitionBy(cluster).orderBy(F.col("__e") > 1, "__d", *tie)
    return first.withColumn("exemplar_rank", F.row_number().over(v)).filter(F.col("exemplar_rank") <= k).drop("__d", "__e")


def average_linkage(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of agglomerative clustering by cosine distance, average linkage, cut at ``threshold``; numbered by first member."""
    n = len(vectors)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    d = 1.0 - np.clip(unit @ unit.T, -1.0, 1.0)
    np.fill_diagonal(d, np.inf)
    size, alive, owner = np.ones(n), np.ones(n, bool), np.arange(n)
    while alive.sum() > 1:
        i, j = divmod(int(np.argmin(d)), n)
        if not d[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        owner[owner == j] = i
    return np.unique(owner, return_inverse=True)[1]


def agglomerate(events: DataFrame, task: str, key: str, vector: str, *, threshold: float = 0.18, max_members: int = 5000) -> DataFrame:
    """key, cluster_label within each task.

    Average linkage needs all distances of a task; tasks of more than
    ``max_members`` events are an error, found by counting first.
    """
    big = events.groupBy(task).count().filter(F.col("count") > max_members).limit(1).collect()
    if big:
        raise ValueError(f"task {big[0][0]} has {big[0][1]} events; average linkage is limited to {max_members}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        labels = average_linkage(np.array(pdf[vector].tolist(), dtype=float), threshold)
        return pd.DataFrame({task: pdf[task], key: pdf[key], "cluster_label": labels.astype("int32")})

    t, k = events.schema[task].dataType.simpleString(), events.schema[key].dataType.simpleString()
    return events.select(task, key, vector).groupBy(task).applyInPandas(run, f"{task} {t}, {key} {k}, cluster_label int")


