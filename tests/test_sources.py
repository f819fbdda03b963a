import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.functions import text, vectors
from stepweave.operators import constraints as con
from stepweave.sources import readers, schemas, sinks


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"episode_num": 1}\n\n{"episode_num": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"episode_num": 1}\n{broken\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), schemas.PROMPTS).count() == 2
    assert readers.count_lines(spark, str(tmp_path / "a.jsonl")) == 2
    assert [r.blank_lines for r in readers.blank_lines(spark, str(tmp_path / "a.jsonl")).collect()] == [1]
    with pytest.raises(Exception):  # noqa: B017, PT011
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), schemas.PROMPTS).collect()
    bad = readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), schemas.PROMPTS, strict=False).cache()
    assert [r._corrupt_record for r in bad.collect() if r._corrupt_record] == ["{broken"]


def test_csv_headers_must_agree(spark, tmp_path):
    for n, h in (("a", "x,y"), ("b", "x,y"), ("c", "x,z")):
        (tmp_path / f"{n}.csv").write_text(f"{h}\n1,2\n")
    p = lambda *n: [str(tmp_path / f"{x}.csv") for x in n]
    assert readers.read_csv_same_header(spark, p("a", "b")).count() == 2
    with pytest.raises(ValueError, match="headers"):
        readers.read_csv_same_header(spark, p("a", "c"))


def test_documents(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"source_trajectory_records_path": "t", "episodes": [{"episode_num": 1, "waypoint_indices": [3, 5]}]}')
    (tmp_path / "m.json").write_text('{"format": "other", "shards": []}')
    assert readers.read_waypoint_summary(spark, str(tmp_path / "w.json")).first().waypoint_indices == [3, 5]
    with pytest.raises(Exception, match="unknown format"):
        readers.read_manifest(spark, str(tmp_path / "m.json")).collect()


def test_npz(spark, tmp_path):
    a = np.arange(12.0).reshape(4, 3)
    np.savez(tmp_path / "layer_31_shard_00000.npz", x=a, y=np.zeros(2))
    rows = readers.read_npz(spark, str(tmp_path), "x").orderBy("row_idx").collect()
    assert [list(r["values"]) for r in rows] == a.tolist()
    assert {(r.array, tuple(r.shape)) for r in readers.npz_shapes(spark, str(tmp_path)).collect()} == {("x", (4, 3)), ("y", (2,))}
    assert readers.find_shards(spark, str(tmp_path), 31).count() == 1 and readers.find_shards(spark, str(tmp_path), 30).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.range(10)
    sinks.write_shards(df.coalesce(1), str(tmp_path / "s"), 4)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 3
    assert sinks.write_missing(df, str(tmp_path / "m"), ["id"]).count() == 10
    assert sinks.write_missing(spark.range(12), str(tmp_path / "m"), ["id"]).count() == 2
    assert spark.read.parquet(str(tmp_path / "m")).count() == 12


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    r = one(spark, vectors.l2_normalize(v(3, 4)), vectors.cosine_distance(v(1, 0), v(0, 1)), vectors.max_abs_delta(v(1, 2), v(1, 2.5)), vectors.max_abs_delta(v(1), v(1, 2)), vectors.max_abs_delta(v(), v()), vectors.only_last_changed(v(1, 2), v(1, 9)), vectors.only_last_changed(v(1, 2), v(2, 2)))
    assert r.c0 == pytest.approx([0.6, 0.8]) and tuple(r)[1:] == (1.0, 0.5, math.inf, 0.0, True, False)
    half = math.sqrt(0.5)
    turn = vectors.angular_velocity(v(0, 0, 0, 1), v(0, 0, half, half), F.lit(0.5))
    flipped = vectors.angular_velocity(v(0, 0, 0, 1), v(0, 0, -half, -half), F.lit(0.5))
    still = vectors.angular_velocity(v(0, 0, 0, 1), v(0, 0, 0, 2), F.lit(0.5))
    r = one(spark, turn, flipped, still, vectors.softmax(v(0, 0)), vectors.entropy(v(0.5, 0.5)))
    assert r.c0 == pytest.approx([0, 0, math.pi]) and r.c1 == pytest.approx([0, 0, math.pi]) and r.c2 == [0, 0, 0] and r.c3 == [0.5, 0.5] and r.c4 == pytest.approx(math.log(2))


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"phrase": " open ", "phase": "contact"}', ("open", "contact", None)),
        ('{"phrase": "", "phase": "fly"}', (None, "fly", "missing_or_invalid_phrase; invalid_phase:fly")),
        ('{"phrase": 3}', (None, None, "missing_or_invalid_phrase; missing_or_invalid_phase")),
        ("[1]", (None, None, "top_level_json_not_object")),
        ("{", (None, None, "json_decode_error")),
    ],
)
def test_answers(spark, answer, want):
    assert tuple(one(spark, text.parse_answer(F.lit(answer))).c0) == want


def test_contact_classes_in_order(spark):
    c = lambda *o: text.contact_class(F.array(*[F.lit(x) for x in o]))
    r = one(spark, c("gripper:a", "object:b", "robot:c", "fixture:d"), c("robot:a", "fixture:b"), c("object:a", "fixture:b"), c("object:a", "object:b"), c("robot:a", "gripper:b"), c("site:x"))
    assert tuple(r) == ("gripper_object_manipulation", "robot_fixture_contact", "object_fixture_contact", "object_object_contact", "robot_self_contact", "unclassified_contact")


def test_labels(spark):
    r = one(spark, text.slug(F.lit("--Put it, DOWN!")), text.slug(F.lit("!!")), text.label(F.lit("A b"), 2), text.number_tag(F.lit(0.05)), text.int_list(F.lit("3, 1,3")), text.int_list(F.lit("3,x")))
    assert tuple(r) == ("put_it_down", "task", "A_", "0p05", [3, 1], None)


def test_enforce(spark):
    df = spark.range(3)
    assert con.enforce(df, [con.Constraint("small", "id < 5")]).count() == 3
    with pytest.raises(Exception, match="violated: tiny"):
        con.enforce(df, [con.Constraint("tiny", "id < 2")]).collect()
