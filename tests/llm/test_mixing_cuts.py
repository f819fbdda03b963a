import math
import random

import pytest
from compare import SMALL

from stepweave.llm import mixing
from stepweave.runtime import table

DOCS = "doc_id long, source string, n_tokens long"


@pytest.mark.parametrize(("digit", "cut_rows"), [(10, 100_000), (2, 3), (1, 1)])
def test_a_cut_is_found_at_any_depth(spark, monkeypatch, digit, cut_rows):
    r = random.Random(3)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 7)
    docs = [(i, "ab"[i % 3 == 0], r.randint(1, 90)) for i in range(600)]
    size = {s: sum(n for _, t, n in docs if t == s) for s in "ab"}
    lines = [mixing.Line(m, s, 0.5, None, size[s], sum(t == s for _, t, _ in docs), passes=p, rest=f * size[s], blocks=29) for m, s, p, f in (("m", "a", 0, 0.3), ("m", "b", 2, 0.77), ("n", "a", 1, 0.0), ("n", "b", 0, 1.0), ("o", "b", 1, 1e-9))]
    df = spark.createDataFrame(docs, DOCS)
    plan = mixing._cuts(df, lines, 0, digit, cut_rows)
    got: dict = {}
    for x in mixing.choose(df, plan).collect():
        got[x.mixture, x.source] = got.get((x.mixture, x.source), 0) + x.copies * x.n_tokens
    for x in lines:
        assert abs(got.get((x.mixture, x.source), 0) - (x.passes * x.tokens + x.rest)) <= 45


def test_each_pass_and_mixture_has_its_own_order_of_blocks(spark):
    df = spark.createDataFrame([(i, "a", 10) for i in range(5000)], DOCS)
    lines = [mixing.Line(m, "a", 1.0, None, 50_000, 5000, passes=p, rest=25_000.0, blocks=50) for m, p in (("m", 0), ("n", 0), ("o", 1))]
    chosen = {m: set() for m in "mno"}
    for x in mixing.choose(df, mixing._cuts(df, lines, 0)).collect():
        if x.copies > (x.mixture == "o"):
            chosen[x.mixture].add(x.doc_id)
    assert all(len(c) == 2500 for c in chosen.values()) and len({frozenset(c) for c in chosen.values()}) == 3


def test_the_largest_size_within_the_miss():
    w, t, limits = [0.5, 0.5], [1000.0, 10.0], [math.inf, 40.0]
    b = mixing.largest_budget(w, t, limits, 0.1)
    assert b == pytest.approx(100.0) and mixing.largest_budget(w, t, limits, 0.0) == pytest.approx(80.0)
    assert mixing.largest_budget(w, t, limits, 1.0) == 1010.0


def test_documents_sum_up_to_the_report(spark):
    chosen, rep = mixing.mix(table(spark, SMALL, "documents"), table(spark, SMALL, "mixture_targets"))
    got: dict = {}
    for x in chosen.collect():
        n, d, c = got.get((x.mixture, x.source), (0, 0, 0))
        got[x.mixture, x.source] = n + x.copies * x.n_tokens, d + 1, max(c, x.copies)
    rows = rep.collect()
    for x in rows:
        assert (x.mixed_tokens, x.mixed_docs, x.max_copies) == got.get((x.mixture, x.source), (0, 0, 0))
        assert x.max_repeats is None or x.max_copies <= x.max_repeats
    for m in {x.mixture for x in rows}:
        mine = [x for x in rows if x.mixture == m]
        assert sum(x.actual_share for x in mine) == pytest.approx(1.0) and sum(x.planned_share for x in mine) == pytest.approx(1.0)
        live = sum(x.target_share for x in mine if x.source_tokens)
        assert sum(abs(x.planned_share - (x.target_share / live if x.source_tokens else 0)) for x in mine) / 2 <= mixing.MAX_MISS + 1e-9
    assert any(x.exponent and x.exponent > 0 for x in rows)
