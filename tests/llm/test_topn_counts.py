from stepweave.llm import topn

TOPK = "run_id string, episode_num long, step_in_episode long, top_feature_ids array<int>, top_feature_vals array<float>"


def test_a_step_counts_the_rows_that_are_kept(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(topn, "top_n", lambda rows, *a, counts, offered, f=topn.top_n, **kw: seen.update(rows=offered(rows), counts=counts) or f(rows, *a, counts=counts, offered=offered, **kw))
    repeated = ("r", 1, 1, [7] * 20, [1.0] * 20)
    bad = ("r", 1, 2, [1, 2, -1, None, 3], [1.0, 0.0, 1.0, 1.0, float("nan")])
    many = ("r", 1, 3, list(range(30)), [1.0] * 30)
    df = spark.createDataFrame([repeated, bad, many, many, ("r", 1, 4, None, [1.0]), ("r", 1, 5, [], [])], TOPK)
    assert topn.best_per_step(df).count() == 1 + 1 + 5
    kept = {r[0]: r[1] for r in seen["rows"].groupBy("step_in_episode").count().collect()}
    assert kept == {1: 20, 2: 1, 3: 10}
    assert {r.step_in_episode: r.n for r in seen["counts"].collect() if r.n} == kept


def test_salts_follow_the_size_of_the_group_alone(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 11), ("c", 95), ("d", 10**12)], "g string, n long")
    assert {r.g: r.n for r in topn._hot_groups(counts.filter("g <> 'd'"), 10).collect()} == {"b": 2, "c": 10}
    assert topn._hot_groups(counts, 10**13) is None


def test_a_long_list_of_heavy_groups_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(topn, "broadcast_if_small", lambda df: df.hint("merge"))
    rows = spark.createDataFrame([(g, i, float(i % 7)) for g in ("a", "b", None) for i in range(40)], "g string, item int, v double")
    from pyspark.sql import functions as F

    want = topn.top_n(rows, ["g"], "item", 3, F.max("v"), heavy_rows=1000).collect()
    assert sorted(map(str, topn.top_n(rows, ["g"], "item", 3, F.max("v"), heavy_rows=5).collect())) == sorted(map(str, want)) and len(want) == 9
