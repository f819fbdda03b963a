import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ordered import detach, episodes, frame  # noqa: F401

from stepweave.functions import config
from stepweave.operators import strict
from stepweave.sources import readers, sinks
from stepweave.streaming import stateful


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{broken\n{"a": 4}\n')
    got = [(r.line, r.error, r.a) for r in readers.read_jsonl_numbered(spark, str(tmp_path / "a.jsonl"), "a int", blank_is_error=True).orderBy("line").collect()]
    assert got == [(1, None, 1), (2, "blank_line", None), (3, "broken", None), (4, None, 4)]
    assert readers.read_jsonl_numbered(spark, str(tmp_path / "a.jsonl"), "a int").count() == 3


@pytest.mark.parametrize("layout", ["", "sae_activations/expert"])
def test_sparse_runs_in_both_layouts(spark, tmp_path, layout):
    part = tmp_path / layout
    for i in range(2):
        spark.range(3).select(F.lit(i).cast("long").alias("episode_num"), F.col("id").alias("step_in_episode")).coalesce(1).write.parquet(str(tmp_path / "w" / str(i)))
        part.mkdir(parents=True, exist_ok=True)
        next((tmp_path / "w" / str(i)).glob("*.parquet")).rename(part / f"s{i}.parquet")
    (part / "manifest.json").write_text(json.dumps({"format": "token_topk_sparse_v1", "shards": [{"path": f"s{i}.parquet", "num_rows": 3, "row_start": 3 * i} for i in range(2)]}))
    assert readers.read_sparse_run(spark, str(tmp_path)).count() == 6
    (part / "s1.parquet").unlink()
    with pytest.raises(FileNotFoundError, match="s1"):
        readers.read_sparse_run(spark, str(tmp_path))


def test_npz_headers(spark, tmp_path):
    np.savez(tmp_path / "a b.npz", x=np.zeros((4, 3)), y=np.zeros(2))
    assert {(r.array, tuple(r.shape)) for r in readers.npz_headers(spark, str(tmp_path)).collect()} == {("x", (4, 3)), ("y", (2,))}


def test_publish_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.publish(spark, path, lambda p: spark.range(3).write.parquet(p))
    with pytest.raises(FileExistsError):
        sinks.publish(spark, path, lambda p: None)

    def broken(p):
        spark.range(9).write.parquet(p)
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        sinks.publish(spark, path, broken, replace=True)
    assert spark.read.parquet(path).count() == 3 and [x.name for x in tmp_path.iterdir()] == ["out"]
    sinks.publish(spark, path, lambda p: spark.range(5).write.parquet(p), replace=True)
    assert spark.read.parquet(path).count() == 5


def test_aligned_streams(spark, tmp_path):
    a, b = spark.range(4).withColumn("x", F.lit(1)), spark.range(4).withColumn("y", F.lit(2))
    m = sinks.write_aligned({"a": a, "b": b}, str(tmp_path / "o"), ["id"])
    assert {(r.stream, r.num_rows, r.status) for r in m.collect()} == {("a", 4, "complete"), ("b", 4, "complete")}
    with pytest.raises(ValueError, match="aligned"):
        sinks.write_aligned({"a": a, "b": b.filter("id > 0")}, str(tmp_path / "p"), ["id"])
    assert not (tmp_path / "p").exists()


def test_resumed_shards_are_checked(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(30).select(F.col("id"), (F.col("id") % 3).cast("int").alias("shard"))
    assert sorted(r.shard for r in sinks.resume_shards(df.filter("shard < 2"), path, "shard").collect()) == [0, 1]
    assert [r.shard for r in sinks.resume_shards(df, path, "shard").collect()] == [2]
    assert sinks.resume_shards(df, path, "shard").count() == 0 and spark.read.parquet(path).count() == 30
    with pytest.raises(ValueError, match="shard 1"):
        sinks.resume_shards(df.withColumn("id", F.when(F.col("id") == 4, 5).otherwise(F.col("id"))), path, "shard")


def test_step_transactions(spark, tmp_path):
    t = sinks.StepTransaction(spark, str(tmp_path / "t"))
    for n, keep in ((2, True), (5, False), (3, True)):
        t.begin()
        with pytest.raises(RuntimeError):
            t.begin()
        t.add(spark.range(n))
        t.commit() if keep else t.abort()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5 and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(RuntimeError):
        t.add(spark.range(1))


def streamed(spark, tmp_path, df, cuts):
    for i, c in enumerate(cuts):
        df.filter(c).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return stateful.read_steps(spark, str(tmp_path / "in"), df.schema)


def test_streamed_detachments_equal_the_batch(spark, episodes, tmp_path):  # noqa: F811
    s = streamed(spark, tmp_path, frame(spark, episodes), ["step < 25", "step >= 25"])
    got = {r.episode_num: tuple(r)[2:] for r in stateful.run_to_end(stateful.detachments(s), "detached").collect()}
    assert got == {e: t for e, rows in episodes.items() if (t := detach(rows))[0] is not None}


def test_ordered_sums_fail_on_disorder(spark, tmp_path):
    rows = [("r", i, e, s, float(i)) for i, (e, s) in enumerate([(1, 0), (1, 1), (1, 1), (2, 0), (2, 0), (2, 3)])]
    df = spark.createDataFrame(rows, "run_id string, row_id long, episode int, step int, value double")
    s = streamed(spark, tmp_path, df, ["row_id < 2", "row_id >= 2"])
    got = {tuple(r)[1:] for r in stateful.run_to_end(stateful.ordered_sums(s), "sums_in_order").collect()}
    assert got == {(1, 0, 0.0, 1), (1, 1, 3.0, 2), (2, 0, 7.0, 2)}
    bad = df.withColumn("episode", F.when(F.col("row_id") == 4, 1).otherwise(F.col("episode")))
    (tmp_path / "b").mkdir()
    with pytest.raises(Exception, match="comes after"):
        stateful.run_to_end(stateful.ordered_sums(streamed(spark, tmp_path / "b", bad, ["row_id < 4", "row_id >= 4"])), "sums_broken")


def test_quota_stop(spark, tmp_path):
    rows = [(1, i, v, p) for i, (v, p) in enumerate([(False, False), (True, False), (True, True), (True, True)])] + [(2, i, True, False) for i in range(6)]
    s = streamed(spark, tmp_path, spark.createDataFrame(rows, "task_id int, attempt int, valid boolean, primary boolean"), ["attempt < 2", "attempt >= 2"])
    got = {tuple(r) for r in stateful.run_to_end(stateful.quota_stop(s, target_valid=2, target_primary=1, most=5), "quota").collect()}
    assert got == {(1, 2, 3, 2, 1, True), (2, 4, 5, 5, 0, False)}


def test_moments_folded_over_shards(spark, tmp_path):
    df = spark.createDataFrame([(d, float(i), float(i) / 2, i) for i in range(8) for d in range(2)], "dim int, x double, residual double, i int")
    s = streamed(spark, tmp_path, df, ["i < 3", "i >= 3"])
    from stepweave.operators.activations import fidelity

    r = fidelity(stateful.run_to_end(stateful.folded_moments(s), "moments", mode="complete")).first()
    assert r.num_rows == 8 and r.frac_variance_explained == pytest.approx(0.75)


def test_only_finished_episodes_are_kept(spark, tmp_path):
    df = spark.createDataFrame([("r", e, s, e != 2 and s == 2) for e in (1, 2, 3) for s in range(3)], "run_id string, episode_num int, step int, done boolean")
    s = streamed(spark, tmp_path, df, ["episode_num < 3", "episode_num = 3"])
    stateful.keep_finished(s, str(tmp_path / "o"), lambda d: d.filter("done").select("run_id", "episode_num"), str(tmp_path / "c"))
    assert {(r.episode_num, r.step) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {(e, s) for e in (1, 3) for s in range(3)}


def test_strict_union_and_required_parts(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")
    assert strict.union_all_strict([a, b], ["k"]).count() == 2
    with pytest.raises(Exception, match="repeated key 1"):
        strict.union_all_strict([a, a], ["k"]).collect()
    with pytest.raises(ValueError, match="no rows"):
        strict.require_rows(a.limit(0), "rows")
    with pytest.raises(ValueError, match="w"):
        strict.require_columns(a, ["k", "w"])


def test_configurations(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"x": 1}, "b": 2}')
    c = config.load(str(tmp_path / "c.json"), {"a": {"y": 5, "x": 0}}, {"a.z.w": 3, "b": 4})
    assert c == {"a": {"y": 5, "x": 1, "z": {"w": 3}}, "b": 4}
    with pytest.raises(ValueError, match="b.q"):
        config.with_overrides(c, {"b.q": 1})
    assert config.problems(c, [("a.x", lambda v: v > 0, "positive"), ("a.y", lambda v: v < 5, "small"), ("a.q", lambda v: v > 0, "there")]) == ["a.y: small", "a.q: there"]


def test_random_configurations_merge_like_their_leaves():
    r = random.Random(1)

    def tree(n):
        return {k: tree(n - 1) if n and r.random() < 0.5 else r.randint(0, 9) for k in r.sample("abcd", 3)}

    def leaves(t, p=()):
        return {q: v for k, x in t.items() for q, v in (leaves(x, (*p, k)).items() if isinstance(x, dict) and x else {(*p, k): x}.items())}

    for _ in range(50):
        a, b = tree(3), tree(3)
        m = leaves(config.merged(a, b))
        assert leaves(b).items() <= m.items() and all(v == leaves(a).get(k) for k, v in m.items() if k not in leaves(b))
