import math

import pytest

from stepweave.llm import mixing, queries


def test_the_exponent_gives_the_share_of_a_softened_source():
    w, t, limits = [0.5, 0.5], [499.0, 501.0], [100.0, math.inf]
    shares, tau = mixing.limited_shares(w, t, limits, 1000.0)
    assert shares == pytest.approx([0.1, 0.9])
    assert w[0] * (0.499 / w[0]) ** tau[0] == pytest.approx(0.1)


def test_without_an_exponent_the_limit_is_the_share():
    shares, tau = mixing.limited_shares([0.3, 0.5, 0.2], [700.0, 200.0, 100.0], [100.0, math.inf, 0.0], 1000.0)
    assert shares == pytest.approx([0.1, 0.9, 0.0])
    assert math.isnan(tau[0]) and tau[1] == 0 and math.isnan(tau[2])


def test_target_entropy():
    assert "p7_temperature" in queries.QUERIES
    lines = [mixing.Line("m", s, w, c, t, 10) for s, w, c, t in (("a", 0.6, None, 9000), ("b", 0.3, None, 900), ("c", 0.1, None, 100))]
    got = mixing.plan_shares(lines, 500.0, temperature=True)
    e = got[0].exponent
    assert mixing.entropy([x.share for x in got]) == pytest.approx(mixing.entropy([0.6, 0.3, 0.1]), abs=1e-6)
    assert [x.share / got[0].share for x in got] == pytest.approx([(x.tokens / 9000) ** e for x in got])
    capped = mixing.plan_shares([*lines[:2], mixing.Line("m", "c", 0.1, 1, 100, 10)], 2000.0, temperature=True)
    assert capped[2].share == pytest.approx(0.05) and capped[2].exponent > e
