"""Segmented windows and the state machines built on them, against step-by-step simulations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.operators import control, merging, segments
from stepweave.operators.clusters import average_linkage
from stepweave.operators.trajectories import fewest_waypoints
from stepweave.streaming import stateful


def simulate(rows, stable=3, lift=0.01, delay=2):
    z0 = rows[0][2]
    streak, since, tg, ts, tl = 0, None, None, None, None
    for step, g, z in rows:
        up = z is not None and z - z0 >= lift
        if g:
            if streak == 0:
                tg, ts, tl = step, None, None
            streak += 1
            ts = step if streak >= stable and ts is None else ts
            tl = step if up and tl is None else tl
        else:
            streak, since, tg, ts, tl = 0, None, None, None, None
        if g and up and streak >= stable:
            since = step if since is None else since
            if step - since >= delay:
                return (step, tg, ts, tl)
        else:
            since = None
    return (None,) * 4


def detach(rows, k=3):
    cand, n, pre = None, 0, False
    for step, g, _ in rows:
        g = bool(g)
        if not g:
            if cand is None and not pre:
                pre = g
                continue
            cand = step if cand is None else cand
            n += 1
            if n >= k:
                return (cand, step)
        else:
            cand, n = None, 0
        pre = g
    return (None, None)


@pytest.fixture(scope="module")
def episodes():
    r, out = random.Random(7), {}
    for e in range(25):
        g, rows = False, []
        for step in range(60):
            if r.random() < 0.1 and step:
                continue
            g = (not g) if r.random() < 0.2 else g
            rows.append((step, r.choice([g, g, g, None]), round(r.choice([0.0, 0.005, 0.02, 0.03]), 3) if step else 0.0))
        out[e] = rows
    return out


SCHEMA = "run_id string, episode_num int, step int, grasped boolean, z double"


def frame(spark, episodes):
    return spark.createDataFrame([("r", e, *x) for e, rows in episodes.items() for x in rows], SCHEMA)


def test_release_trigger_and_detachment(spark, episodes, monkeypatch):
    df, keys = frame(spark, episodes), ["run_id", "episode_num"]
    got = {r.episode_num: tuple(r)[2:] for r in control.release_triggers(df, keys).collect()}
    assert got == {e: simulate(rows) for e, rows in episodes.items()} and any(v[0] for v in got.values())
    got = {r.episode_num: tuple(r)[2:] for r in control.detachments(control.grasp_transitions(df, keys), keys).collect()}
    assert got == {e: detach(rows) for e, rows in episodes.items()}


@pytest.mark.parametrize("segment", [1, 3, 7, 20])
def test_machines_pass_through_segments(spark, segment):
    """Long grasps and gaps, cut into segments shorter than what the machines wait for."""
    r, eps = random.Random(segment), {}
    for e in range(40):
        g, up, rows = False, False, []
        for step in range(70):
            if r.random() < 0.1 and step:
                continue
            g = (not g) if r.random() < 0.12 else g
            up = (not up) if r.random() < 0.12 else up
            rows.append((step, g, 0.05 if up and step else 0.0))
        eps[e] = rows
    df, keys = frame(spark, eps), ["run_id", "episode_num"]
    for stable, delay in ((3, 2), (1, 0), (5, 6)):
        got = {x.episode_num: tuple(x)[2:] for x in control.release_triggers(df, keys, stable_steps=stable, delay=delay, segment=segment).collect()}
        assert got == {e: simulate(rows, stable, 0.01, delay) for e, rows in eps.items()}
    for k in (1, 3, 6):
        got = {x.episode_num: tuple(x)[2:] for x in control.detachments(control.grasp_transitions(df, keys), keys, confirm=k, segment=segment).collect()}
        assert got == {e: detach(rows, k) for e, rows in eps.items()}


def test_streamed_trigger_equals_the_batch(spark, episodes, tmp_path):
    df = frame(spark, episodes)
    for i, (a, b) in enumerate(((0, 20), (20, 40), (40, 60))):
        df.filter(f"step >= {a} and step < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = stateful.read_steps(spark, str(tmp_path / "in"), df.schema)
    out = stateful.run_to_end(stateful.release_triggers(s), "triggers", checkpoint=str(tmp_path / "cp"))
    got = {r.episode_num: tuple(r)[2:] for r in out.collect()}
    assert got == {e: t for e, rows in episodes.items() if (t := simulate(rows))[0] is not None}


def test_streamed_sums_span_batches(spark, tmp_path):
    for part in ([(1, 0, 0, 2.0), (1, 1, 1, 4.0)], [(1, 1, 1, 8.0), (2, 0, 2, 6.0)]):
        spark.createDataFrame(part, "episode int, step int, feature int, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    s = stateful.read_steps(spark, str(tmp_path / "v"), "episode int, step int, feature int, value double")
    out = stateful.run_to_end(stateful.timestep_sums(s, ["episode", "step"]), "sums", mode="complete")
    assert {(r.episode, r.step, r.feature): (r.total, r.n_values) for r in out.collect()} == {(1, 0, 0): (2, 1), (1, 1, 1): (12, 2), (2, 0, 2): (6, 1)}


@pytest.mark.parametrize("segment", [4, 1000])
def test_neighbours_and_running_values(spark, segment):
    r = random.Random(segment)
    rows = [(k, s, r.randint(-5, 5)) for k in "ab" for s in sorted(r.sample(range(-30, 90), 40))]
    df = spark.createDataFrame(rows, "k string, s int, v int")
    near = segments.with_neighbour(df, ["k"], "s", ["v"], segment=segment)
    got = {(x.k, x.s): (x.prev_s, x.prev_v) for x in near.collect()}
    run = {(x.k, x.s): (x.total, x.top) for x in segments.running(df, ["k"], "s", {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}, segment=segment).collect()}
    for k in "ab":
        prev, total, top = (None, None), 0, -99
        for _, s, v in (x for x in rows if x[0] == k):
            total, top = total + v, max(top, v)
            assert got[k, s] == prev and run[k, s] == (total, top)
            prev = (s, v)


def test_global_rank(spark):
    ids = random.Random(1).sample(range(10_000), 500)
    got = {r.i: r["rank"] for r in segments.global_rank(spark.createDataFrame([(i,) for i in ids], "i int"), ["i"]).collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(ids))}


def test_quota_stops(spark):
    rows = [(1, i, True, v, p) for i, (v, p) in enumerate([(True, False), (False, False), (True, True), (True, True)])]
    q = control.quota_summary(spark.createDataFrame(rows, "task_id int, attempt int, eligible boolean, valid boolean, primary boolean"), target_valid=2, target_primary=1).first()
    assert (q.attempts, q.valid_pairs, q.invalid_pairs, q.met_at, q.stopped_late) == (4, 3, 1, 2, True)


def test_inventory(spark):
    f = lambda x: spark.createDataFrame(x, "path string, size long")
    got = {(r.path, r.problem) for r in merging.inventory_diff(f([("a", 1), ("b", 2), ("c", 3)]), f([("b", 2), ("c", 4), ("d", 5)])).collect()}
    assert got == {("a", "missing"), ("c", "wrong_size"), ("d", "unexpected")}


def test_waypoints():
    p = np.array([[x, 0, 0] for x in range(5)] + [[4, y, 0] for y in range(1, 5)], float)
    assert fewest_waypoints(p, 0.01) == [4, 8] and fewest_waypoints(p, 10) == [8] and fewest_waypoints(p[:1], 0.1) == [0]


def test_linkage_separates_and_ignores_order():
    r = np.random.default_rng(0)
    v = np.concatenate([r.normal(c, 0.02, (6, 3)) for c in (np.array([1, 0, 0]), np.array([0, 1, 0]), np.array([0, 0, 1]))])
    labels = average_linkage(v, 0.18)
    assert [len(set(labels[i : i + 6])) for i in (0, 6, 12)] == [1, 1, 1] and len(set(labels)) == 3
    assert len(set(average_linkage(v[r.permutation(18)], 0.18))) == 3 and len(set(average_linkage(v, 2.1))) == 1


def test_global_episodes(spark):
    df = spark.createDataFrame([(2, 3), (2, 50), (-1, 3), (None, 1)], "t int, e int")
    g = lambda **kw: merging.global_episode(F.col("t"), F.col("e"), 50, **kw)
    assert [r.n for r in df.select(g().alias("n")).collect()] == [104, None, None, None]
    assert df.filter("e = 3 and t > 0").select(g(strict=True).alias("n")).first().n == 104
    with pytest.raises(Exception, match="no episode"):
        df.select(g(strict=True)).collect()
