import datetime as dt
import posixpath
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepweave.functions.paths import normal_path
from stepweave.operators import references as ref

T0 = dt.datetime(2025, 3, 1)
at = lambda d: None if d is None else T0 + dt.timedelta(days=d)


def frames(spark, index, merges=(), shards=(), prompts=(), runs=()):
    a = spark.createDataFrame([(i, r, e, p, at(t), "x", 1) for i, r, e, p, t in index], "index_id long, run_id string, episode_num int, shard_path string, logged_at timestamp_ntz, kind string, n int")
    m = spark.createDataFrame([(i, d, at(t)) for i, d, t in merges], "merge_id long, input_dirs array<string>, created_at timestamp_ntz")
    s = spark.createDataFrame([(p, at(b), at(e)) for p, b, e in shards], "shard_path string, registered_at timestamp_ntz, deleted_at timestamp_ntz")
    p = spark.createDataFrame([(r, e, at(b), at(d)) for r, e, b, d in prompts], "run_id string, episode_num int, registered_at timestamp_ntz, deleted_at timestamp_ntz")
    r = spark.createDataFrame([(p, at(b), at(e)) for p, b, e in runs], "run_dir string, registered_at timestamp_ntz, deleted_at timestamp_ntz")
    return a, m, s, p, r


def orphans(spark, *args, heavy_rows=100_000, **kw):
    out = [(x.ref_table, x.ref_field, x.ref_id, x.ref_pos) for x in ref.experiment_orphans(*frames(spark, *args, **kw), heavy_rows=heavy_rows).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("heavy_rows", [0, 100_000])
def test_lifetimes(spark, heavy_rows):
    index = [(1, "r", 1, "a/b.pt", 5), (1, "r", 1, "a/b.pt", 5), (2, "r", 1, " a//x/../b.pt ", 10), (3, "r", 1, "a/b.pt", 0), (4, "r", 2, "A/b.pt", 5), (5, None, 1, None, 5), (6, "r", -1, "  ", 5), (7, "r", None, "a/b.pt", None), (8, "r", 1, "a/b.pt", 20)]
    shards, prompts = [("a/b.pt", 1, 10), ("./a/b.pt", 15, None)], [("r", 1, 1, 12), ("r", 2, 6, None), ("r", 1, 15, None)]
    s, e = "shard_path", "episode_num"
    want = {(2, s), (3, s), (3, e), (4, s), (4, e), (5, e), (7, s)}
    assert orphans(spark, index, shards=shards, prompts=prompts, heavy_rows=heavy_rows) == {("activation_index", f, i, 0) for i, f in want}


def test_lists(spark):
    merges = [(1, ["x", None, " ", "y/", "x"], 5), (2, None, 5), (3, [], 5), (4, ["x"], None)]
    got = orphans(spark, [], merges=merges, runs=[("y", 1, None), ("x", None, None)])
    assert got == {("merge_configs", "input_dirs", 1, 0), ("merge_configs", "input_dirs", 1, 4), ("merge_configs", "input_dirs", 4, 0)}


def test_nothing(spark):
    assert orphans(spark, []) == set()


@pytest.mark.parametrize("heavy_rows", [0, 20, 10**6])
def test_against_brute_force(spark, heavy_rows):
    r = random.Random(1)
    shards = [(f"s{r.randint(0, 9)}", b := r.randint(0, 80), r.choice([None, b + r.randint(1, 60)])) for _ in range(14)]
    index = [(i, "r", -1, f"s{min(r.randint(0, 20), 12) % 11}", r.randint(0, 150)) for i in range(400)]
    want = {("activation_index", "shard_path", i, 0) for i, _, _, p, t in index if not any(q == p and b <= t and (e is None or t < e) for q, b, e in shards)}
    assert orphans(spark, index, shards=shards, heavy_rows=heavy_rows) == want


def test_report_counts_by_month(spark):
    o = ref.experiment_orphans(*frames(spark, [(1, "r", -1, "a", 0), (2, "r", -1, "a", 3), (3, "r", -1, "b", 40), (4, "r", -1, "b", None)]))
    got = {(x.month, x.orphans, x.missing_keys) for x in ref.orphan_report(o).collect()}
    assert got == {("2025-03", 2, 1), ("2025-04", 1, 1), (None, 1, 1)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="a./ B", max_size=14), min_size=30, max_size=60))
def test_paths_like_the_library(spark, paths):
    got = [x[0] for x in spark.createDataFrame([(p,) for p in paths], "p string").select(normal_path(F.col("p"))).collect()]
    for p, g in zip(paths, got, strict=True):
        s = p.strip()
        want = None if not s else posixpath.normpath(s)
        if want is not None and want.startswith("//"):
            want = want[1:]
        assert g == want, p
