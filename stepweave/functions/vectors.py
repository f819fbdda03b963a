"""Array expressions for vectors, quaternions and probability vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value computed once per row: a lambda would compute it again for each element."""
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, *, strict: bool = False) -> Column:
    """Unit vector; a zero vector stays (divided by 1e-12), or is an error."""

    def divided(u: Column) -> Column:
        n = norm(u)
        n = F.when(n == 0, F.raise_error(F.lit("zero vector"))).otherwise(n) if strict else F.greatest(n, F.lit(1e-12))
        return let(n, lambda m: F.transform(u, lambda x: x.cast("double") / m))

    return let(v, divided)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b for unit vectors, the product cut to [-1, 1]."""
    return 1.0 - F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0))


def max_abs_delta(a: Column, b: Column) -> Column:
    """Greatest absolute difference; infinite for unequal lengths, nulls or non-finite elements, 0 for empty vectors."""
    inf = F.lit(float("inf"))

    def apart(x: Column, y: Column) -> Column:
        d = F.abs(x.cast("double") - y.cast("double"))
        return F.when(d.isNull() | F.isnan(d), inf).otherwise(d)

    d = F.coalesce(F.array_max(F.zip_with(a, b, apart)), F.lit(0.0))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), inf).otherwise(d)


def all_close(a: Column, b: Column, tolerance: float) -> Column:
    return max_abs_delta(a, b) <= tolerance


def only_last_changed(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Do the vectors agree in all dimensions but the last?"""
    head = lambda v: F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0)))
    return (F.size(a) == F.size(b)) & (max_abs_delta(head(a), head(b)) <= tolerance)


def replace_last(v: Column, x: Column) -> Column:
    return F.concat(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.array(x))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def round_binary(x: Column, digits: int) -> Column:
    """A double rounded half away from zero as DuckDB does it: the product with 10 ** digits decides, not the decimal digits that Spark's round
    looks at, so 2.0652595 gives 2.065259. NaN, infinities and values whose product is infinite stay; a zero has no sign."""
    scaled = x * (10.0**digits)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / (10.0**digits)).otherwise(x)


def quat_multiply(a: Column, b: Column) -> Column:
    """Product of quaternions (x, y, z, w)."""
    x1, y1, z1, w1 = (a[i] for i in range(4))
    x2, y2, z2, w2 = (b[i] for i in range(4))
    return F.array(w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2, w1 * y2 + y1 * w2 + z1 * x2 - x1 * z2, w1 * z2 + z1 * w2 + x1 * y2 - y1 * x2, w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2)


def angular_velocity(q0: Column, q1: Column, dt: Column) -> Column:
    """Rotation vector from q0 to q1 per second, the shorter way round; zero below 1e-12."""

    def between(a: Column, b: Column) -> Column:
        b = F.when(dot(a, b) < 0, F.transform(b, lambda x: -x)).otherwise(b)
        return quat_multiply(b, F.array(-a[0], -a[1], -a[2], a[3]))

    def turned(d: Column) -> Column:
        v = F.slice(d, 1, 3)
        n = norm(v)
        angle = 2.0 * F.atan2(n, F.least(F.greatest(d[3], F.lit(-1.0)), F.lit(1.0)))
        scale = F.when(n < 1e-12, F.lit(0.0)).otherwise(angle / (n * dt))
        return let(scale, lambda k: F.transform(v, lambda x: x * k))

    return let(l2_normalize(q0), lambda a: let(l2_normalize(q1), lambda b: let(between(a, b), turned)))


def softmax(v: Column) -> Column:
    def shares(u: Column) -> Column:
        e = let(F.array_max(u).cast("double"), lambda top: F.transform(u, lambda x: F.exp(x.cast("double") - top)))
        return let(e, lambda w: let(total(w), lambda s: F.transform(w, lambda x: x / s)))

    return let(v, shares)


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(1e-12)))))


def top_margin(p: Column) -> Column:
    """Difference of the two greatest elements."""
    s = F.sort_array(p, asc=False)
    return s[0] - s[1]


def rank_in(p: Column, x: Column) -> Column:
    """1 + number of greater elements."""
    return F.size(F.filter(p, lambda y: y > x)) + 1
