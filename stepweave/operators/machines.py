"""State machines along entities of any length, in one pass over the rows.

Rows are shuffled once, into segments of a fixed range of the integer step. A
machine does not know in which state it enters a segment, but only few entry
states make a difference; each segment is reduced to one short summary that
holds the outcome for all of them. The summaries, one row a segment, are then
folded along each entity as a sorted stream. No task holds more than a segment.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators.segments import SEGMENT


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows with equal keys, as slices of batches; nulls equal each other."""
    key: tuple | None = None
    parts: list[pa.RecordBatch] = []
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new = np.zeros(max(n - 1, 0), bool)
        for k in keys:
            a, c = b.column(k).slice(1), b.column(k).slice(0, n - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, c), False), pc.and_(pc.is_null(a), pc.is_null(c)))
            new |= ~np.asarray(same.to_numpy(zero_copy_only=False), bool)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for s, e in zip(edges, edges[1:], strict=False):
            here = tuple(b.column(k)[s].as_py() for k in keys)
            if here != key and parts:
                yield key, parts
                parts = []
            key = here
            parts.append(b.slice(s, e - s))
    if parts:
        yield key, parts


def fold_segments(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], summarize: Callable[..., dict], fold: Callable[[Iterator[dict]], tuple], out: str, *, step: str = "step") -> DataFrame:
    """keys plus what ``fold`` makes of the summaries of an entity's segments, in order.

    ``rows`` has keys, ``__seg``, ``step`` (unique inside an entity) and boolean
    ``columns``, and is already partitioned by keys and segment. ``summarize``
    takes arrays of the step and the columns, in the order of steps. ``out``
    names and types the values that ``fold`` returns.
    """
    keys, head = list(keys), [*keys, "__seg"]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *[x.split()[0] for x in out.split(",")]]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in groups(batches, head):
            t = pa.Table.from_batches(parts)
            cols = [t.column(c).to_numpy() for c in (step, *columns)]
            text = json.dumps(summarize(cols[0].astype("int64"), *[c.astype(bool) for c in cols[1:]]))
            first = parts[0].slice(0, 1)
            yield pa.RecordBatch.from_arrays([*[first.column(k) for k in keys], pa.array([key[-1]], pa.int64()), pa.array([text])], names=[*head, "summary"])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summaries(parts_of: Iterator[list[pa.RecordBatch]]) -> Iterator[dict]:
            for parts in parts_of:
                for b in parts:
                    for x in b.column("summary").to_pylist():
                        yield json.loads(x)

        for _, parts in groups(batches, keys):
            values = fold(summaries(iter([parts])))
            first = parts[0].slice(0, 1)
            yield pa.RecordBatch.from_arrays([*[first.column(k) for k in keys], *[pa.array([v], pa.int32()) for v in values]], names=names)

    short = rows.select(*head, step, *columns).sortWithinPartitions(*head, step).mapInArrow(reduce, f"{kinds}, `__seg` long, summary string")
    return short.repartition(*keys).sortWithinPartitions(*head).mapInArrow(along, f"{kinds}, {out}")


def by_segment(rows: DataFrame, keys: Sequence[str], step: str = "step", segment: int = SEGMENT) -> DataFrame:
    """Rows partitioned by entity and segment (``__seg``)."""
    return rows.withColumn("__seg", F.floor(F.col(step) / segment).cast("long")).repartition(*keys, "__seg")


class Trigger:
    """A grasp that lasts and is lifted stays so for a while: see :func:`stepweave.operators.control.release_triggers`.

    A segment's outcome depends on the rows the grasp has lasted (up to
    ``stable``) and on when it became eligible, which only matters while the
    first rows stay eligible.
    """

    def __init__(self, stable: int, delay: int) -> None:
        self.stable, self.delay = stable, delay

    def scan(self, step: np.ndarray, on: np.ndarray, up: np.ndarray, before: int) -> dict[str, Any]:
        """Outcome for a grasp that has lasted ``before`` rows. f: what fires; e: the state at the end; both end with whether the grasp came in."""
        n = len(step)
        i = np.arange(1, n + 1)
        off = np.maximum.accumulate(np.where(on, 0, i))
        streak = np.where(on, i - off + np.where(off == 0, before, 0), 0)
        eligible = on & up & (streak >= self.stable)
        since = step[np.minimum(np.maximum.accumulate(np.where(eligible, 0, i)), n - 1)]

        def times(j: int) -> list:
            a = int(off[j])
            came = a == 0 and before > 0
            k = a + self.stable - 1 - (before if came else 0)
            lifts = np.flatnonzero(up[a : j + 1])
            return [None if came else int(step[a]), int(step[k]) if a <= k <= j else None, int(step[a + lifts[0]]) if len(lifts) else None, came]

        hits = np.flatnonzero(eligible & (step - since >= self.delay))
        j = n - 1
        end = [min(int(streak[j]), self.stable), int(since[j]) if eligible[j] else None, *times(j)] if on[j] else [0, None, None, None, None, False]
        return {"f": [int(step[hits[0]]), *times(int(hits[0]))] if len(hits) else None, "e": end}

    def summarize(self, step: np.ndarray, on: np.ndarray, up: np.ndarray) -> dict:
        bad = np.flatnonzero(~(on & up))
        run = int(bad[0]) if len(bad) else len(step)
        return {"v": [self.scan(step, on, up, c) for c in range(self.stable + 1)], "run": step[: min(run, max(self.delay, 1))].tolist(), "all": run == len(step)}

    def fold(self, summaries: Iterator[dict]) -> tuple:
        c, since, grasp, stable, lift = 0, None, None, None, None
        for s in summaries:
            if since is not None:
                for step in s["run"]:
                    if step - since >= self.delay:
                        return step, grasp, stable, lift
            v = s["v"][c]

            def own(g, st, li, came, had=(grasp, stable, lift)):
                return (had[0], had[1] if had[1] is not None else st, had[2] if had[2] is not None else li) if came else (g, st, li)

            if v["f"]:
                return v["f"][0], *own(*v["f"][1:])
            n, at, *t = v["e"]
            since = since if since is not None and s["all"] else at
            grasp, stable, lift = own(*t)
            c = n
        return None, None, None, None


class Detach:
    """A grasp that is lost and stays lost for ``confirm`` rows. A segment's outcome depends on the rows since the candidate (0: none)."""

    def __init__(self, confirm: int) -> None:
        self.confirm = confirm

    def scan(self, step: np.ndarray, off: np.ndarray, pre: np.ndarray) -> dict[str, Any]:
        n = len(step)
        if not n:
            return {"f": None, "e": [0, None]}
        i = np.arange(1, n + 1)
        on = np.maximum.accumulate(np.where(off, 0, i))
        drops = np.cumsum(off & pre)
        first = off & pre & (drops - np.concatenate(([0], drops))[on] == 1)
        cand = np.maximum.accumulate(np.where(first, i, 0))
        live = off & (cand > on)
        hits = np.flatnonzero(live & (i - cand == self.confirm - 1))
        return {"f": [int(step[cand[hits[0]] - 1]), int(step[hits[0]])] if len(hits) else None, "e": [int(n - cand[-1] + 1), int(step[cand[-1] - 1])] if live[-1] else [0, None]}

    def summarize(self, step: np.ndarray, off: np.ndarray, pre: np.ndarray) -> dict:
        on = np.flatnonzero(~off)
        head = int(on[0]) if len(on) else len(step)
        return {"none": self.scan(step, off, pre), "head": step[: min(head, self.confirm)].tolist(), "n": head, "all": head == len(step), "rest": self.scan(step[head:], off[head:], pre[head:])}

    def fold(self, summaries: Iterator[dict]) -> tuple:
        c, at = 0, None
        for s in summaries:
            if c:
                need = self.confirm - c
                if s["n"] >= need:
                    return at, s["head"][need - 1]
                if s["all"]:
                    c += s["n"]
                    continue
            v = s["rest"] if c else s["none"]
            if v["f"]:
                return tuple(v["f"])
            c, at = v["e"]
        return None, None
