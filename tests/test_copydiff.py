import datetime as dt
import math
import random

import pytest

from stepweave.operators.copydiff import checksum_matrix, bucket_bits, diff_copies, replay_differences, unequal_cells, REPLAY_FIELDS, REPLAY_KEYS

REF = "pair_id string, sample_step int, qpos array<double>, qvel array<double>, control_state_sha256 string, reward double, done boolean, written_at timestamp_ntz, bucket string, side string, k0 int, t int"
T0 = dt.datetime(2025, 3, 1)
H = "ab" * 32


def row(pair="p", step=0, qpos=(1.0, 2.0), qvel=(0.5,), h=H, reward=0.0, done=False, at=0):
    return (pair, step, None if qpos is None else list(qpos), None if qvel is None else list(qvel), h, reward, done, None if at is None else T0 + dt.timedelta(seconds=at), "x", "y", 1, 2)


def found(spark, a, b, **kw):
    r = replay_differences(spark.createDataFrame(a, REF), spark.createDataFrame(b, REF), **kw)
    out = [tuple(x) for x in r.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize(
    ("change", "fields"),
    [
        ({}, set()),
        ({"qpos": (1.0 + 9e-7, 2.0)}, set()),
        ({"qpos": (1.0 + 2e-6, 2.0)}, {"qpos"}),
        ({"qpos": (1.0,)}, {"qpos"}),
        ({"qpos": None}, {"qpos"}),
        ({"qpos": (math.nan, 2.0)}, {"qpos"}),
        ({"qpos": (None, 2.0)}, {"qpos"}),
        ({"qvel": ()}, {"qvel"}),
        ({"h": " SHA256:" + H.upper() + " "}, set()),
        ({"h": "0x" + H}, set()),
        ({"h": "cd" * 32}, {"control_state_sha256"}),
        ({"h": None}, {"control_state_sha256"}),
        ({"reward": None}, {"reward"}),
        ({"reward": 1e-7}, set()),
        ({"reward": -0.0}, set()),
        ({"done": None, "reward": 1.0}, {"done", "reward"}),
    ],
)
def test_fields(spark, change, fields):
    assert found(spark, [row()], [row(**change)]) == {("p", 0, f) for f in fields}


def test_nan_infinity_and_null_equal_themselves(spark):
    same = {"qpos": (math.nan, math.inf, -math.inf, None, 1e300), "qvel": None, "h": None, "reward": math.nan, "done": None}
    assert found(spark, [row(**same)], [row(**same)]) == set()


def test_sides_versions_repeats_and_null_keys(spark):
    a = [row(step=1), row(step=1), row(step=2, qpos=(9.0,), at=1), row(step=2, at=5), row(pair=None, step=None), row(step=3, at=None), row(step=4)]
    b = [row(step=2, at=2), row(step=2, reward=7.0, at=1), row(pair=None, step=None, reward=3.0), row(step=3), row(step=5)]
    assert found(spark, a, b) == {("p", 1, "only_in_reference"), ("p", 4, "only_in_reference"), ("p", 5, "only_in_current"), (None, None, "reward")}


def test_empty_copies(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [row()], []) == {("p", 0, "only_in_reference")}


def test_against_brute_force(spark):
    r = random.Random(3)
    make = lambda: [row(pair=f"p{r.randint(0, 5)}", step=r.randint(0, 20), qpos=(r.choice([1.0, 1.0 + 5e-7, 1.1]), 2.0), reward=r.choice([0.0, 1.0, None]), at=i) for i in range(150)]
    a, b = make(), make()
    latest = lambda rows: {(x[0], x[1]): x for x in sorted(rows, key=lambda x: x[7])}
    la, lb, want = latest(a), latest(b), set()
    for k in la.keys() | lb.keys():
        if k not in lb:
            want.add((*k, "only_in_reference"))
        elif k not in la:
            want.add((*k, "only_in_current"))
        else:
            if abs(la[k][2][0] - lb[k][2][0]) > 1e-6:
                want.add((*k, "qpos"))
            if la[k][5] != lb[k][5]:
                want.add((*k, "reward"))
    for kw in ({"bits": 0}, {"bits": 3}, {"bits": 10}, {"bits": 12, "first_bits": 1, "more_bits": 4}, {"bits": 9, "first_bits": 0, "more_bits": 8}):
        assert found(spark, a, b, **kw) == want


def test_matrix_flags_only_unequal_columns(spark):
    a, b = spark.createDataFrame([row(step=i) for i in range(50)], REF), spark.createDataFrame([row(step=i, reward=float(i == 7)) for i in range(50)], REF)
    m = lambda d: checksum_matrix(d, REPLAY_KEYS, "written_at", REPLAY_FIELDS, 10, 1e-6)
    cells = unequal_cells(m(a), m(b), 5).collect()
    assert len(cells) == 1 and cells[0].c3 and not any((cells[0].p, cells[0].c0, cells[0].c1, cells[0].c2, cells[0].c4))


def test_buckets_grow_with_the_rows():
    assert bucket_bits(0) == 10 and bucket_bits(81_000) == 15 and bucket_bits(4 * 10**12) == 40


def test_finer_matrices_read_only_unequal_buckets(spark, monkeypatch):
    from stepweave.operators import copydiff

    seen = []
    monkeypatch.setattr(copydiff, "checksum_matrix", lambda d, *a, f=copydiff.checksum_matrix: seen.append(d.count()) or f(d, *a))
    a, b = [row(step=i) for i in range(400)], [row(step=i, reward=float(i == 7)) for i in range(400)]
    assert found(spark, a, b, bits=10, first_bits=4, more_bits=3) == {("p", 7, "reward")}
    assert len(seen) == 6 and seen[0] == seen[1] == 400 and seen[2] < 100 and seen[4] < 20


def test_many_unequal_buckets_are_shuffled(spark, monkeypatch):
    from stepweave.operators import copydiff

    monkeypatch.setattr(copydiff, "broadcast_if_small", lambda df, n: df.hint("merge"))
    a, b = [row(step=i) for i in range(60)], [row(step=i, reward=float(i % 2)) for i in range(60)]
    assert found(spark, a, b, bits=10, first_bits=4) == {("p", i, "reward") for i in range(1, 60, 2)}


def test_other_keys_and_value_fields(spark):
    from stepweave.operators.copydiff import Field

    a, b = (spark.createDataFrame([(1, x, 0)], "id long, v string, t int") for x in ("a", "b"))
    assert [tuple(r) for r in diff_copies(a, b, ["id"], "t", [Field("v")]).collect()] == [(1, "v")]
