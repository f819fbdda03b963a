"""Ordered computations along entities of any length.

A plain window partitioned by entity puts an entity's whole history into one
task. Here an entity is cut into segments of a fixed range of its integer step,
windows run inside segments, and one row per segment carries what must pass
from a segment to the next. Steps are unique within an entity, which bounds a
segment at SEGMENT rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.runtime import cut

SEGMENT = 8192


def _cut(df: DataFrame, step: str, segment: int) -> DataFrame:
    return df.withColumn("__seg", F.floor(F.col(step) / segment).cast("long"))


def with_neighbour(df: DataFrame, keys: Sequence[str], step: str, columns: Sequence[str], *, following: bool = False, prefix: str = "prev_", segment: int = SEGMENT) -> DataFrame:
    """Adds the columns (and the step) of the previous, or following, row of the same entity; null at its end."""
    keys, cols = list(keys), [step, *[c for c in columns if c != step]]
    s = _cut(df, step, segment)
    w = Window.partitionBy(*keys, "__seg").orderBy(step)
    pick = F.lead if following else F.lag
    row = F.struct(*[F.col(c).alias(c) for c in cols])
    inner = s.withColumn("__near", pick(row).over(w))
    edge = (F.min_by if following else F.max_by)(row, F.col(step))
    edges = s.groupBy(*keys, "__seg").agg(edge.alias("__edge"))
    over = Window.partitionBy(*keys).orderBy("__seg")  # one row a segment
    carried = edges.select(*keys, "__seg", pick("__edge").over(over).alias("__carried"))
    near = F.coalesce("__near", "__carried")
    out = inner.join(carried, [*keys, "__seg"])
    return out.withColumns({f"{prefix}{c}": near[c] for c in cols}).drop("__seg", "__near", "__carried")


def running(df: DataFrame, keys: Sequence[str], step: str, columns: dict[str, tuple[str, Column]], *, segment: int = SEGMENT) -> DataFrame:
    """Adds running aggregates from the entity's first row to the current one. columns: name -> (``sum`` or ``max``, value).

    The input is written to the checkpoint folder, since rows and segment totals both read it.
    """
    keys = list(keys)
    s = _cut(cut(df), step, segment).withColumns({f"__v_{n}": v for n, (_, v) in columns.items()})
    agg = {"sum": F.sum, "max": F.max}
    inside = Window.partitionBy(*keys, "__seg").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    s2 = s.withColumns({f"__i_{n}": agg[how](f"__v_{n}").over(inside) for n, (how, _) in columns.items()})
    totals = s.groupBy(*keys, "__seg").agg(*[agg[how](f"__v_{n}").alias(f"__t_{n}") for n, (how, _) in columns.items()])
    before = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)  # one row a segment
    carried = totals.select(*keys, "__seg", *[agg[how](f"__t_{n}").over(before).alias(f"__c_{n}") for n, (how, _) in columns.items()])
    out = s2.join(carried, [*keys, "__seg"])
    made = {}
    for n, (how, _) in columns.items():
        i, c = F.col(f"__i_{n}"), F.col(f"__c_{n}")
        made[n] = F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0)) if how == "sum" else F.greatest(i, c)
    keep = [c for c in df.columns]
    return out.withColumns(made).select(*keep, *columns)


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in the order of unique keys, without bringing them to one task.

    Range partitions are counted, and each adds the rows of the ones before it.
    """
    sorted_rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = F.broadcast(sizes.select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before")))
    return sorted_rows.withColumn("__part", part).join(offsets, "__part").withColumn(name, F.col("__before") + place + 1).drop("__id", "__part", "__before")
