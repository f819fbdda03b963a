import math

import duckdb

from stepweave.plans import registry

V = [0.5] * 9


def lit(v):
    return "NULL" if v is None else "[" + ",".join("NULL" if x is None else "'nan'::DOUBLE" if math.isnan(x) else str(x) for x in v) + "]::DOUBLE[]"


def copies(path, rows):
    """Both replay tables from (pair, step, reference qvel, current qvel); False stands for no such step."""
    for i, name in enumerate(("reference", "current")):
        sides = [(r[0], r[1], r[2 + i]) for r in rows if r[2 + i] is not False]
        values = ", ".join(f"('{p}', {s}, [1.0]::DOUBLE[], {lit(v)}, 'ab', 0.0::DOUBLE, false, TIMESTAMP '2025-03-01')" for p, s, v in sides)
        cols = "pair_id, sample_step, qpos, qvel, control_state_sha256, reward, done, written_at"
        duckdb.sql(f"COPY (SELECT * FROM (VALUES {values}) t({cols})) TO '{path}/replay_{name}.parquet'")


def test_steps_that_cannot_be_compared_count_as_changed(spark, tmp_path):
    moved = [1.5, *V[1:]]
    rows = [(p, s, V, V) for p in ("same", "nan", "null", "short", "none", "mean") for s in (0, 1)]
    rows += [("same", 2, V, V), ("nan", 2, V, [math.nan, *V[1:]]), ("null", 2, [None, *V[1:]], V), ("short", 2, V, V[:8]), ("none", 2, None, V)]
    rows += [("mean", 2, V, moved), ("mean", 3, [math.nan, *V[1:]], V), ("both", 0, [math.nan, *V[1:]], [math.nan, *V[1:]])]
    rows += [("eight", 0, V[:8], V[:8]), ("late", 0, V, V), ("late", 1, V, False)]
    copies(tmp_path, rows)
    got = {r[0]: tuple(r[1:]) for r in registry.QUERIES["action_divergence"](spark, str(tmp_path)).collect()}
    inf = math.inf
    assert got == {
        "same": (3, 3, -1, 0.0, 0.0),
        "nan": (3, 3, 2, inf, 0.0),
        "null": (3, 3, 2, inf, 0.0),
        "short": (3, 3, 2, inf, 0.0),
        "none": (3, 3, 2, inf, 0.0),
        "mean": (4, 4, 2, inf, round(1.0 / 27, 6)),
        "both": (1, 1, 0, inf, 0.0),
        "eight": (1, 1, -1, 0.0, 0.0),
        "late": (2, 1, 1, 0.0, 0.0),
    }
