"""Mixing sources to target weights under repetition limits.

Method: temperature mixing. The natural token shares of the sources are raised
to an exponent; bisection finds the exponent at which a target entropy, or the
repetition limits, are met. With target weights w and natural shares q the
family is w * (q / w) ** tau: tau 0 gives the weights, tau 1 the natural
shares, and a source over its limit gets the smallest tau that keeps it, which
gives its share. In the plain form (``temperature``) the weights only set the
entropy, and natural shares are raised to the exponent that has it.

Without a given size, a mix is as large as the corpus allows: the largest size,
up to one pass over its sources, at which the planned shares miss the weights
by no more than MAX_MISS in total variation.

The shares are realised as budgeted block permutations: the documents of a
source lie in blocks of a bounded number of rows, every pass of every mixture
has its own order of the blocks, whole passes come first, and the last pass is
cut where its budget ends. The place of the cut is found digit by digit from
sums over ranges of the order, so no task holds more than one small range.

Only numbers per target reach the driver, never documents or blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.tokens import RANK_FILE, TOKENIZER_DIR, count_tokens
from stepweave.runtime import cut

#: Ceiling on (mixture, source) rows: the plan of a mix is a configuration table, and it is broadcast.
MAX_TARGETS = 10_000
#: By how much, in total variation, the planned shares of a mix without a given size may miss its weights.
MAX_MISS = 0.1
#: Documents of a block, on average; rows that one task may order to find a cut; bits of the order that a step of the search looks at.
BLOCK_DOCS, CUT_ROWS, DIGIT = 1024, 100_000, 10
POSITION_BITS = 63


def source_name(c: Column) -> Column:
    """Sources that differ only in case, blanks or ``-`` for ``_`` are the same; blank names are null."""
    s = F.replace(F.regexp_replace(F.lower(c), r"(?U)\s+", ""), F.lit("-"), F.lit("_"))
    return F.when(s != "", s)


def entropy(p: list[float]) -> float:
    return -sum(x * math.log(x) for x in p if x > 0)


def temperature_shares(tokens: list[float], exponent: float) -> list[float]:
    """Token counts raised to an exponent, as shares."""
    top = max(tokens)
    x = [(t / top) ** exponent if t > 0 else 0.0 for t in tokens]
    return [v / sum(x) for v in x]


def exponent_for_entropy(tokens: list[float], target: float) -> float:
    """The exponent whose shares have the target entropy; entropy falls as the exponent grows. Out of reach: the nearest end."""
    low, high = 0.0, 64.0
    for _ in range(200):
        mid = (low + high) / 2
        if entropy(temperature_shares(tokens, mid)) > target:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def limited_shares(weights: list[float], tokens: list[float], limits: list[float], budget: float) -> tuple[list[float], list[float]]:
    """(shares, exponents): the weights, softened just as far as ``limits`` (most tokens of each source) require.

    Sources over their limit get the share of the smallest exponent that keeps
    it, and the others share the rest by weight; repeated until no source is
    over. If all limits together are below the budget, every source is at its
    limit. An exponent is NaN where none gives the share: there, and if the
    limit is 0 or above the weight, or the weight is no more than the natural
    share; such a source is set to its limit.
    """
    n = len(weights)
    q = [t / sum(tokens) for t in tokens]
    if sum(limits) <= budget:
        return [x / sum(limits) for x in limits], [math.nan] * n
    tau = [0.0] * n
    fixed: dict[int, float] = {}
    shares = list(weights)
    for _ in range(n + 1):
        free = sum(w for i, w in enumerate(weights) if i not in fixed)
        rest = 1 - sum(fixed.values())
        shares = [fixed.get(i, weights[i] / free * rest if free else 0.0) for i in range(n)]
        over = [i for i in range(n) if i not in fixed and shares[i] * budget > limits[i] * (1 + 1e-12)]
        if not over:
            break
        for i in over:
            tau[i] = softening(weights[i], q[i], limits[i] / budget)
            fixed[i] = limits[i] / budget if math.isnan(tau[i]) else min(weights[i] * (q[i] / weights[i]) ** tau[i], limits[i] / budget)
    return shares, tau


def softening(weight: float, natural: float, most: float) -> float:
    """The smallest exponent, by bisection, at which weight * (natural / weight) ** exponent is no more than ``most``; NaN if there is none above 0."""
    if most <= 0 or most >= weight or natural >= weight:
        return math.nan
    low, high = 0.0, 1.0
    while weight * (natural / weight) ** high > most:
        low, high = high, high * 2
    for _ in range(100):
        mid = (low + high) / 2
        if weight * (natural / weight) ** mid > most:
            low = mid
        else:
            high = mid
    return high


@dataclass(frozen=True)
class Line:
    """The plan for one source of one mixture."""

    mixture: str
    source: str
    target: float
    cap: int | None
    tokens: int = 0
    docs: int = 0
    share: float = 0.0
    exponent: float = 0.0
    budget: float = 0.0
    passes: int = 0
    rest: float = 0.0
    blocks: int = 1
    cut_pos: int = -1
    cut_hash: int = 0
    cut_doc: int = 0


def miss(shares: list[float], weights: list[float]) -> float:
    """Total variation: the part of the mix that stands in the wrong source."""
    return sum(abs(a - b) for a, b in zip(shares, weights, strict=True)) / 2


def largest_budget(weights: list[float], tokens: list[float], limits: list[float], max_miss: float) -> float:
    """The largest size, up to one pass over the sources, at which the shares miss the weights by at most ``max_miss``.

    The miss grows with the size, since more sources reach their limits; bisection finds where it exceeds the bound.
    """
    high = min(sum(tokens), sum(limits))
    ok = lambda b: miss(limited_shares(weights, tokens, limits, b)[0], weights) <= max_miss + 1e-12
    if ok(high):
        return high
    low = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        if ok(mid):
            low = mid
        else:
            high = mid
    return low


def plan_shares(lines: list[Line], budget: float | None = None, *, temperature: bool = False, max_miss: float = MAX_MISS) -> list[Line]:
    """Shares, exponents and budgets of one mixture. Sources without tokens get nothing; their weight goes to the others.

    ``temperature``: instead of the weights themselves, natural shares raised to
    the exponent at which they have the weights' entropy; limits hold as ever,
    and the exponents are those of the natural shares.
    """
    live = [x for x in lines if x.tokens > 0 and x.target > 0]
    if not live:
        return lines
    w = [x.target for x in live]
    w = [x / sum(w) for x in w]
    t = [float(x.tokens) for x in live]
    base = 0.0
    if temperature:
        base = exponent_for_entropy(t, entropy(w))
        w = temperature_shares(t, base)
    limits = [math.inf if x.cap is None else float(x.cap * x.tokens) for x in live]
    size = min(budget or largest_budget(w, t, limits, max_miss), sum(limits))
    if size <= 0:  # all limits are 0
        return lines
    shares, tau = limited_shares(w, t, limits, size)
    done = {}
    for x, s, e in zip(live, shares, tau, strict=True):
        want = s * size
        passes = int((want + 1e-6) // x.tokens)
        done[x.source] = replace(x, share=s, exponent=base + e * (1 - base), budget=want, passes=passes, rest=max(0.0, want - passes * x.tokens), blocks=max(1, math.ceil(x.docs / BLOCK_DOCS)))
    return [done.get(x.source, x) for x in lines]


def read_targets(mixture_targets: DataFrame) -> list[Line]:
    """The targets, with weights as shares of their mixture. Repeated rows count once.

    Null, NaN, infinite and negative weights count as 0. If a mixture names a
    source twice with different weights the larger holds, of caps the smaller;
    a null cap is none. Rows without mixture or source are left out.
    """
    t = mixture_targets.select("mixture", source_name(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("cap"))
    w = F.col("weight")
    t = t.withColumn("weight", F.when((w > 0) & ~F.isnan(w) & (w < float("inf")), w).otherwise(0.0))
    rows = t.filter("mixture is not null and source is not null").groupBy("mixture", "source").agg(F.max("weight").alias("weight"), F.min("cap").alias("cap")).orderBy("mixture", "source").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    total: dict[str, float] = {}
    for r in rows:
        total[r.mixture] = total.get(r.mixture, 0.0) + r.weight
    return [Line(r.mixture, r.source, r.weight / total[r.mixture] if total[r.mixture] else 0.0, None if r.cap is None else max(r.cap, 0)) for r in rows]


def _positions(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """docs with every target of their source, and their place (``pos``, ``hash``, doc_id) in its last pass.

    ``pos`` is the block's place in the permutation of this mixture and pass.
    ``targets`` is broadcast: at most MAX_TARGETS rows.
    """
    j = docs.join(F.broadcast(targets), "source")
    block = F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), F.col("blocks"))
    pos = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "mixture", "source", "passes", block), 64 - POSITION_BITS)
    return j.withColumns({"pos": pos, "hash": F.xxhash64(F.lit(seed + 2), "source", "doc_id")})


PLAN = "mixture string, source string, target double, cap int, tokens long, docs long, share double, exponent double, budget double, passes int, rest double, blocks long, cut_pos long, cut_hash long, cut_doc long"


def _rows(plan: list[Line]) -> list[tuple]:
    return [(x.mixture, x.source, x.target, x.cap, x.tokens, x.docs, x.share, x.exponent, float(x.budget), x.passes, float(x.rest), x.blocks, x.cut_pos, x.cut_hash, x.cut_doc) for x in plan]


def _cuts(docs: DataFrame, lines: list[Line], seed: int, digit: int = DIGIT, cut_rows: int = CUT_ROWS) -> list[Line]:
    """Where the last pass of each source ends.

    The search fixes the leading bits of the place: sums over ranges of the
    order say in which one the budget ends, and the next step looks only into
    that range, until it is small enough to be ordered.
    """
    spark, by = docs.sparkSession, ["mixture", "source"]
    found: dict[tuple[str, str], Line] = {}
    # target -> what is left of its budget in the range that starts with ``lead``
    left = {(x.mixture, x.source): (0, x.rest) for x in lines if x.rest > 0}
    plans = {(x.mixture, x.source): x for x in lines}
    bits = 0
    small: dict[tuple[str, str], tuple[int, float, int]] = {}

    def ranges(of: dict) -> DataFrame:
        rows = [(m, s, plans[m, s].passes, plans[m, s].blocks, lead, float(rest)) for (m, s), (lead, rest) in of.items()]
        t = spark.createDataFrame(rows, "mixture string, source string, passes int, blocks long, lead long, rest double")
        return _positions(docs, t, seed).filter(F.shiftright("pos", POSITION_BITS - bits) == F.col("lead")) if bits else _positions(docs, t, seed)

    while left:
        step = min(digit, POSITION_BITS - bits)
        sums = ranges(left).groupBy(*by, "rest", F.shiftright("pos", POSITION_BITS - bits - step).alias("range")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
        w = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 ** step rows a target
        edge = sums.withColumn("upto", F.sum("n").over(w)).filter(F.col("upto") >= F.col("rest")).groupBy(*by).agg(F.min(F.struct("range", "upto", "n", "docs", "rest")).alias("e"))
        edges = {(r.mixture, r.source): r.e for r in edge.collect()}  # one row a target
        for k in left.keys() - edges.keys():  # rounding: the whole range
            found[k] = replace(plans[k], cut_pos=(left[k][0] + 1 << POSITION_BITS - bits) - 1, cut_hash=(1 << 63) - 1, cut_doc=(1 << 63) - 1)
        bits += step
        left = {}
        for k, e in edges.items():
            rest = e.rest - e.upto + e.n
            if e.docs <= cut_rows or bits == POSITION_BITS:
                small[k] = (e.range, rest, bits)
            else:
                left[k] = (e.range, rest)
    for bits in sorted({b for *_, b in small.values()}):
        part = {k: (lead, rest) for k, (lead, rest, b) in small.items() if b == bits}
        inside = Window.partitionBy(*by).orderBy("pos", "hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # at most cut_rows rows, or one block
        run = ranges(part).withColumn("upto", F.sum("n_tokens").over(inside))
        # the cut that comes nearest to what is left: a document stays if most of it fits
        last = run.filter(F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).groupBy(*by).agg(F.max(F.struct("pos", "hash", "doc_id")).alias("d"))
        ends = {(r.mixture, r.source): r.d for r in last.collect()}  # one row a target
        for k, (lead, _) in part.items():
            d = ends.get(k)
            found[k] = replace(plans[k], cut_pos=d.pos, cut_hash=d.hash, cut_doc=d.doc_id) if d else replace(plans[k], cut_pos=(lead << POSITION_BITS - bits) - 1)
    return [found.get((x.mixture, x.source), x) for x in lines]


def tokenized(documents: DataFrame, *, folder: str = TOKENIZER_DIR, name: str = RANK_FILE) -> DataFrame:
    """doc_id, source, n_tokens of each document that has a source and a token."""
    d = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").filter(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return count_tokens(d, keep=["doc_id", "source"], folder=folder, name=name).filter(F.col("n_tokens") > 0)


def mix_plan(docs: DataFrame, mixture_targets: DataFrame, *, budget: float | None = None, temperature: bool = False, max_miss: float = MAX_MISS, seed: int = 0) -> list[Line]:
    """The plan of every mixture for tokenized documents. ``budget``: tokens of each mix, by default :func:`largest_budget`; see :func:`plan_shares`."""
    lines = read_targets(mixture_targets)
    names = sorted({x.source for x in lines})
    if not names:
        return []
    have = docs.filter(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    size = {r.source: (r.tokens, r.docs) for r in have.collect()}  # at most one row a target source
    lines = [replace(x, tokens=size.get(x.source, (0, 0))[0], docs=size.get(x.source, (0, 0))[1]) for x in lines]
    planned: list[Line] = []
    for m in dict.fromkeys(x.mixture for x in lines):
        planned += plan_shares([x for x in lines if x.mixture == m], budget, temperature=temperature, max_miss=max_miss)
    return _cuts(docs, planned, seed)


def choose(docs: DataFrame, plan: list[Line], seed: int = 0) -> DataFrame:
    """mixture, source, doc_id, copies, n_tokens: every chosen document with the number of its copies."""
    p = docs.sparkSession.createDataFrame(_rows(plan), PLAN).select("mixture", "source", "passes", "blocks", "cut_pos", "cut_hash", "cut_doc")
    placed = _positions(docs, p, seed)
    in_last = F.struct("pos", "hash", "doc_id") <= F.struct(F.col("cut_pos").alias("pos"), F.col("cut_hash").alias("hash"), F.col("cut_doc").alias("doc_id"))
    copies = F.col("passes") + F.when(in_last, 1).otherwise(0)
    return placed.select("mixture", "source", "doc_id", copies.cast("int").alias("copies"), "n_tokens").filter(F.col("copies") > 0)


def report(chosen: DataFrame, plan: list[Line]) -> DataFrame:
    """A row for each target: its share, the planned and the actual share, tokens, documents, repeats."""
    spark = chosen.sparkSession
    got = chosen.groupBy("mixture", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_docs"), F.max("copies").alias("max_copies"))
    rows = [(x.mixture, x.source, x.target, x.cap, x.tokens, x.docs, x.share, x.exponent) for x in plan]
    p = spark.createDataFrame(rows, "mixture string, source string, target_share double, max_repeats int, source_tokens long, source_docs long, planned_share double, exponent double")
    w = Window.partitionBy("mixture")  # at most MAX_TARGETS rows
    full = p.join(got, ["mixture", "source"], "left").fillna(0, ["mixed_tokens", "mixed_docs", "max_copies"])
    all_tokens = F.sum("mixed_tokens").over(w)
    return full.withColumn("actual_share", F.when(all_tokens > 0, F.col("mixed_tokens") / all_tokens).otherwise(0.0)).withColumn("repeats", F.when(F.col("source_tokens") > 0, F.col("mixed_tokens") / F.col("source_tokens")).otherwise(0.0))


def mix(documents: DataFrame, mixture_targets: DataFrame, *, budget: float | None = None, temperature: bool = False, max_miss: float = MAX_MISS, seed: int = 0, folder: str = TOKENIZER_DIR, name: str = RANK_FILE) -> tuple[DataFrame, DataFrame]:
    """(chosen documents, report). Documents without text, tokens or source are never chosen.

    doc_id is unique; a repeated row would be one more document of its source.
    Mixtures whose sources all lack tokens choose nothing and report zeros.
    """
    docs = cut(tokenized(documents, folder=folder, name=name))
    plan = mix_plan(docs, mixture_targets, budget=budget, temperature=temperature, max_miss=max_miss, seed=seed)
    if not plan:
        empty = docs.select(F.lit("").alias("mixture"), "source", "doc_id", F.lit(0).alias("copies"), "n_tokens").limit(0)
        return empty, report(empty, [])
    chosen = choose(docs, plan, seed)
    return chosen, report(chosen, plan)
