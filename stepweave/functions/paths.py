"""Unix path text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(c: Column) -> Column:
    """Lexical normal form of a Unix path, case kept; surrounding blanks are dropped, blank paths give null.

    Empty and ``.`` parts vanish, ``..`` removes the part before it; at the
    root it is dropped, in front of a relative path it stays.
    """
    p = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rooted = p.startswith("/")
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when(part != "..", F.concat(acc, F.array(part)))
            .when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(rooted, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    parts = F.aggregate(F.split(p, "/"), empty, step)
    joined = F.array_join(parts, "/")
    whole = F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)
    plain = ~p.rlike(r"(^|/)(\.{0,2})(/|$)") & ~p.endswith("/")  # most paths: nothing to resolve
    return F.when(p == "", F.lit(None).cast("string")).when(plain, p).otherwise(whole)
