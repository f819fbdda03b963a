"""Field-by-field differences between two copies of one keyed data set.

Method: a column-by-bucket checksum matrix. Each copy is reduced, on its own,
to one row per key bucket that holds an additive 128-bit checksum for every
column. Comparing the two small matrices locates the unequal buckets and the
unequal columns; only those columns of only those buckets are read again and
compared value by value. Where a bucket of the first matrix still holds many
keys, the unequal ones are cut into finer buckets by a matrix of their own, and
so on: however large the copies, what is read again in the end is a few rows
for each difference.

Numbers match within a tolerance, so they are hashed on a grid whose cells are
as wide as the tolerance. Two numbers that differ by more than the tolerance
then fall into different cells (down to the rounding of doubles, to which the
comparison of values is subject as well): the matrix can flag a bucket that
turns out equal, but does not pass one that differs. Numbers too large for a
sharp grid are hashed as they are, with a flag that keeps them apart from cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.runtime import broadcast_if_small, cut

#: From this many cells on, rounding to the grid would no longer be sharp; the number is hashed as it is.
EXACT_ABOVE = 1e10


@dataclass(frozen=True)
class Field:
    """A compared column. kind: ``numbers`` (array), ``number``, ``digest`` (hex text) or ``value``."""

    name: str
    kind: str = "value"


def _cell(x: Column, tolerance: float) -> Column:
    x = x.cast("double")
    y = F.when(F.isnan(x), F.lit(float("nan"))).when(F.abs(x) < EXACT_ABOVE * tolerance, F.rint(x * F.lit(1.0 / tolerance))).otherwise(x)
    return y + F.lit(0.0)  # -0.0 becomes 0.0


def _raw(x: Column, tolerance: float) -> Column:
    """True beside a number that is hashed as it is, so that no cell's number equals it; null, which hashes skip, beside a cell."""
    return F.when(~(F.abs(x.cast("double")) < EXACT_ABOVE * tolerance), F.lit(True))


def canonical(field: Field, tolerance: float) -> Column:
    """The form of a value that is hashed; equal values have equal forms."""
    c = F.col(field.name)
    if field.kind == "numbers":
        return F.transform(c, lambda x: F.struct(x.isNull().alias("z"), F.coalesce(_cell(x, tolerance), F.lit(0.0)).alias("v"), _raw(x, tolerance).alias("raw")))
    if field.kind == "number":
        return F.struct(_cell(c, tolerance).alias("v"), _raw(c, tolerance).alias("raw"))
    if field.kind == "digest":
        return digest(c)
    return c


def digest(c: Column) -> Column:
    """A hash as a digest: without surrounding blanks, algorithm prefix, ``0x`` and letter case."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"^(sha-?256\s*[:=]\s*)?(0x)?", "")


def _differs(field: Field, tolerance: float) -> Column:
    a, b = F.col(f"a.{field.name}"), F.col(f"b.{field.name}")
    nulls = a.isNull() != b.isNull()

    def apart(x: Column, y: Column) -> Column:
        x, y = x.cast("double"), y.cast("double")
        return F.coalesce(
            F.when(x.isNull() | y.isNull(), x.isNull() != y.isNull())
            .when(F.isnan(x) | F.isnan(y), F.isnan(x) != F.isnan(y))
            .otherwise((x != y) & ~(F.abs(x - y) <= tolerance)),
            F.lit(False),
        )

    if field.kind == "numbers":
        there = (F.size(a) != F.size(b)) | F.exists(F.zip_with(a, b, apart), lambda d: d)
    elif field.kind == "number":
        there = apart(a, b)
    elif field.kind == "digest":
        there = digest(a) != digest(b)
    else:
        there = ~a.eqNullSafe(b)
    return nulls | (a.isNotNull() & b.isNotNull() & F.coalesce(there, F.lit(False)))


def _lanes(*values: Column) -> list[Column]:
    """A 128-bit hash as four 32-bit lanes, whose sums over a bucket stay inside a bigint."""
    out = []
    for seed in (17, 29):
        h = F.xxhash64(F.lit(seed), *values)
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return out


def bucket_of(keys: Sequence[str], bits: int) -> Column:
    """The leading ``bits`` bits of the key's hash: a bucket's number begins with that of every coarser bucket around it."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits) if bits else F.lit(0).cast("long")


def checksum_matrix(df: DataFrame, keys: Sequence[str], version: str, fields: Sequence[Field], bits: int, tolerance: float) -> DataFrame:
    """One row per non-empty bucket: additive checksums of presence and of each field.

    Of several rows of a key, each field counts with the row of latest
    ``version`` (null is earliest); rows tied on it, with the greatest hash.
    Only hashes are shuffled, pre-aggregated per key.
    """
    hashed = df.select(
        bucket_of(keys, bits).alias("bucket"),
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        *[F.struct(F.col(version).alias("t"), *[x.alias(f"l{j}") for j, x in enumerate(_lanes(F.lit(i), *keys, F.col(f.name).isNull(), canonical(f, tolerance)))]).alias(f"h{i}") for i, f in enumerate(fields)],
    )
    names = [f"k{i}" for i in range(len(keys))]
    latest = hashed.groupBy("bucket", *names).agg(*[F.max(f"h{i}").alias(f"h{i}") for i in range(len(fields))])
    presence = _lanes(F.lit(-1), *names)
    return latest.groupBy("bucket").agg(
        *[F.sum(x).alias(f"p_l{j}") for j, x in enumerate(presence)],
        *[F.sum(F.col(f"h{i}.l{j}")).alias(f"c{i}_l{j}") for i in range(len(fields)) for j in range(4)],
    )


def unequal_cells(left: DataFrame, right: DataFrame, n_fields: int) -> DataFrame:
    """Buckets whose checksums differ, with one flag for presence (``p``) and one per field (``c0`` ...)."""
    names = ["p", *[f"c{i}" for i in range(n_fields)]]
    both = left.alias("a").join(right.alias("b"), "bucket", "full_outer")

    def unequal(n: str) -> Column:
        return F.greatest(*[F.coalesce(F.col(f"a.{n}_l{j}"), F.lit(0)) != F.coalesce(F.col(f"b.{n}_l{j}"), F.lit(0)) for j in range(4)])

    flags = both.select("bucket", *[unequal(n).alias(n) for n in names])
    return flags.filter(F.greatest(*names) if len(names) > 1 else F.col(names[0]))


#: Keys of a bucket in the last matrix; bits of the first matrix at most, and bits by which each further one is finer.
BUCKET_KEYS, FIRST_BITS, MORE_BITS = 4, 20, 10


def bucket_bits(rows: int) -> int:
    """Bits of the last matrix: about BUCKET_KEYS keys a bucket, at least 2**10 buckets."""
    return max(10, (max(rows, 1) // BUCKET_KEYS).bit_length())


def _within(df: DataFrame, keys: Sequence[str], cells: DataFrame, bits: int) -> DataFrame:
    """The rows in the buckets of ``cells``, broadcast if they are few by count, else by a shuffle of both."""
    return df.withColumn("__bucket", bucket_of(keys, bits)).join(broadcast_if_small(cells, 1 << FIRST_BITS), "__bucket")


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    version: str,
    fields: Sequence[Field],
    *,
    tolerance: float = 1e-6,
    bits: int | None = None,
    first_bits: int = FIRST_BITS,
    more_bits: int = MORE_BITS,
    left_only: str = "only_in_left",
    right_only: str = "only_in_right",
) -> DataFrame:
    """Keys plus ``diff_field``: a side marker, or the name of each field that differs.

    Null keys are ordinary keys (null matches null). Null equals only null, NaN
    only NaN, infinities only themselves; null and missing elements differ from
    numbers. Versions and repeated rows collapse as in :func:`checksum_matrix`.
    Empty copies are allowed, extra columns are ignored. Each difference comes
    out once.
    """
    n = len(fields)
    if bits is None:
        bits = bucket_bits(max(left.count(), right.count()))
    a, b, at = left, right, min(bits, first_bits)
    while True:
        matrix = [checksum_matrix(x, keys, version, fields, at, tolerance) for x in (a, b)]
        cells = cut(unequal_cells(*matrix, n)).withColumnRenamed("bucket", "__bucket")
        if at >= bits or cells.isEmpty():
            break
        a, b = (_within(x, keys, cells.select("__bucket"), at).drop("__bucket") for x in (left, right))
        at = min(bits, at + more_bits)
    hit = cells.agg(*[F.coalesce(F.max(f"c{i}"), F.lit(False)).alias(f"c{i}") for i in range(n)]).first()
    use = [i for i in range(n) if hit[f"c{i}"]]
    wanted = cells.select("__bucket", *[F.col(f"c{i}").alias(f"__c{i}") for i in use])

    def side(df: DataFrame, name: str) -> DataFrame:
        cols = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
        vals = []
        for i in use:
            f = fields[i]
            c = F.col(f.name)
            c = F.transform(c, lambda x: x.cast("double")) if f.kind == "numbers" else c.cast("double") if f.kind == "number" else c
            order = [x.alias(f"l{j}") for j, x in enumerate(_lanes(F.lit(i), *keys, F.col(f.name).isNull(), canonical(f, tolerance)))]
            vals.append(F.struct(F.col(version).alias("t"), *order, c.alias(f.name)).alias(f"v{i}"))
        near = _within(df, keys, wanted, at)
        return near.select(F.lit(name).alias("side"), *cols, *vals, *[f"__c{i}" for i in use])

    both = side(left, "a").unionByName(side(right, "b"))
    names = [f"k{i}" for i in range(len(keys))]

    def of(s: str, c: Column) -> Column:
        return F.max(F.when(F.col("side") == s, c))

    merged = both.groupBy(*names).agg(
        of("a", F.lit(True)).alias("in_a"),
        of("b", F.lit(True)).alias("in_b"),
        *[F.max(f"__c{i}").alias(f"__c{i}") for i in use],
        *[of(s, F.col(f"v{i}")).alias(f"{s}{i}") for i in use for s in "ab"],
    )

    def empty_or(s: str) -> Column:
        cols = [F.col(f"{s}{i}.{fields[i].name}").alias(fields[i].name) for i in use]
        return F.struct(*cols, F.lit(1).alias("__one")).alias(s)

    pairs = merged.select(*names, "in_a", "in_b", *[f"__c{i}" for i in use], empty_or("a"), empty_or("b"))
    found = [
        F.when(F.col("in_b").isNull(), F.lit(left_only)),
        F.when(F.col("in_a").isNull(), F.lit(right_only)),
        *[F.when(F.col("in_a") & F.col("in_b") & F.col(f"__c{i}") & _differs(fields[i], tolerance), F.lit(fields[i].name)) for i in use],
    ]
    out = pairs.select(*names, F.explode(F.array_compact(F.array(*found))).alias("diff_field"))
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "diff_field")


REPLAY_KEYS = ("pair_id", "sample_step")
REPLAY_FIELDS = (Field("qpos", "numbers"), Field("qvel", "numbers"), Field("control_state_sha256", "digest"), Field("reward", "number"), Field("done"))


def replay_differences(reference: DataFrame, current: DataFrame, **kw) -> DataFrame:
    return diff_copies(reference, current, REPLAY_KEYS, "written_at", REPLAY_FIELDS, left_only="only_in_reference", right_only="only_in_current", **kw)
