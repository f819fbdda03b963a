"""Column expressions over action vectors; the last element is the gripper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepweave.functions.vectors import replace_last


def last(v: Column) -> Column:
    return F.when(F.size(v) > 0, F.element_at(v, -1))


def gripper_to_sign(v: Column, *, binarize: bool = True) -> Column:
    """The gripper from [0, 1] to [-1, 1], or to its sign."""
    x = 2.0 * last(v) - 1.0
    return replace_last(v, F.signum(x) if binarize else x)


def gripper_inverted(v: Column) -> Column:
    return replace_last(v, -last(v))


def executed(v: Column) -> Column:
    """A raw action as it is carried out: the gripper's sign, turned round."""
    return gripper_inverted(gripper_to_sign(v))


def forced_open(v: Column) -> Column:
    return replace_last(v, F.lit(-1.0))


def chunk(actions: Column, n: int) -> Column:
    """The first n actions of a chunk as structs (offset, action), to be exploded."""
    return F.transform(F.slice(actions, 1, n), lambda a, i: F.struct(i.alias("offset"), a.alias("action")))


def bin_index(token: Column, vocab_size: int, bins: int) -> Column:
    """The bin of an action token: tokens count down from the end of the vocabulary."""
    return F.least(F.greatest(F.lit(vocab_size) - token - 1, F.lit(0)), F.lit(bins - 2))


def detokenized(tokens: Column, low: Sequence[float], high: Sequence[float], mask: Sequence[bool], *, vocab_size: int, bins: int = 256) -> Column:
    """Action values of token ids: the centre of the bin in [-1, 1], stretched to [low, high] where ``mask`` holds."""
    width = 2.0 / (bins - 1)
    lo, hi, on = (F.array(*[F.lit(x) for x in xs]) for xs in (low, high, mask))

    def value(t: Column, i: Column) -> Column:
        x = (bin_index(t, vocab_size, bins) + 0.5) * width - 1.0
        return F.when(F.get(on, i), 0.5 * (x + 1.0) * (F.get(hi, i) - F.get(lo, i)) + F.get(lo, i)).otherwise(x)

    return F.transform(tokens, value)


def perturbation_sums(before: Column, after: Column) -> list[Column]:
    """Aggregates over feature values before and after an intervention."""
    return [
        F.count_if(before != 0).alias("active_before"),
        F.max(before).alias("max_before"),
        F.count_if(after != 0).alias("active_after"),
        F.max(after).alias("max_after"),
        F.sum(F.abs(after - before)).alias("absolute_delta"),
    ]
