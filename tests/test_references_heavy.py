import pytest
from test_references import frames, orphans

from stepweave.operators import references as ref

SPELLINGS = ["hot/a.pt", "./hot/a.pt", "hot//a.pt", " hot/a.pt "]


def data():
    index = [(i, "r", -1, SPELLINGS[i % 4] if i < 12 else f"cold/{i}", i % 30) for i in range(4000)]
    shards = [("hot/a.pt", 0, 5), *[(f"cold/{i}", 0, None) for i in range(12, 4000) if i % 7]]
    want = {("activation_index", "shard_path", i, 0) for i in range(4000) if (i % 30 >= 5 if i < 12 else not i % 7)}
    return index, shards, want


def test_a_key_is_heavy_by_its_share_over_all_spellings(spark, monkeypatch):
    index, shards, want = data()
    made = []
    monkeypatch.setattr(ref, "_heavy", lambda g, n, f=ref._heavy: made.append(f(g, n)) or made[-1])
    f = frames(spark, index, shards=shards)
    got = {(x.ref_table, x.ref_field, x.ref_id, x.ref_pos) for x in ref.experiment_orphans(*f).collect()}
    assert [tuple(r) for r in made[0].collect()] == [("shard", "hot/a.pt")]
    assert got == want


@pytest.mark.parametrize("heavy_rows", [0, 10**6])
def test_the_split_changes_nothing(spark, heavy_rows):
    index, shards, want = data()
    assert orphans(spark, index, shards=shards, heavy_rows=heavy_rows) == want


def test_salted_partners_of_heavy_keys(spark, monkeypatch):
    index, shards, want = data()
    monkeypatch.setattr(ref, "_small", lambda df: False)
    assert orphans(spark, index, shards=shards, heavy_rows=0) == want


def test_a_share_is_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(ref, "TASK_ROWS", 10)
    monkeypatch.setattr(ref, "SHARE", 2)
    groups = spark.createDataFrame([("shard", "a", 11), ("shard", "b", 10), ("shard", "c", 500), ("run", "a", 2000)], "kind string, key string, n long")
    assert {tuple(r) for r in ref._heavy(groups, 0).collect()} == {("shard", "a"), ("shard", "c"), ("run", "a")}


def test_the_registered_query_takes_both_branches(spark, monkeypatch):
    from compare import SMALL

    from stepweave.plans import registry

    made = []
    monkeypatch.setattr(ref, "_unheld", lambda *a, f=ref._unheld: made.append(a) or f(*a))
    registry.QUERIES["p4_found"](spark, SMALL)
    assert len(made) == 2
