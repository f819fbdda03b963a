import math

import pyarrow as pa
import pyarrow.parquet as pq
from compare import views

from stepweave.plans import registry

INF, NAN = math.inf, math.nan


def exact(rows):
    """Rows with every digit of their floats; NaN equals NaN, and a zero has no sign."""
    return sorted((*map(str, r[:3]), "null" if r[3] is None else repr(r[3] + 0.0)) for r in map(tuple, rows))


def test_every_digit_is_that_of_the_sql(spark, tmp_path):
    vectors = [
        [2.0652595, 0.5095985, 133619.3211515],
        [-2.0652595, -0.5095985, -133619.3211515],
        [5e-7, 1.5e-6, 2.5e-6, 9.0],
        [-76581543265395.52, 1.7976931348623157e308, -1.034824534352107e248],
        [NAN, INF, -INF],
        [None, 0.1, -4e-7],
        [0.49999999999999994e-6, 4.5e15, 5e-324],
        [0.5],
        [],
        None,
    ]
    rows = [("a", i, v) for i, v in enumerate(vectors)] + [("a", 4, vectors[4]), ("a", 7, [0.25]), (None, 0, [1.0])]
    columns = {"pair_id": pa.string(), "sample_step": pa.int32(), "qvel": pa.list_(pa.float64())}
    pq.write_table(pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(columns.items())}), f"{tmp_path}/replay_reference.parquet")
    got = exact(registry.QUERIES["chunk_actions"](spark, str(tmp_path)).collect())
    assert got == exact(views(str(tmp_path)).execute(registry.ORACLE["chunk_actions"]).fetchall())
    assert ("a", "0", "0", "2.065259") in got and ("a", "4", "0", "nan") in got and ("a", "5", "0", "null") in got
