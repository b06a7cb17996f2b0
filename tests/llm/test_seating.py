"""Tables of dishes of any size against their exact odds, and sweeps that move every customer."""

import signal

import numpy as np
import pytest

from shelfmark.llm import seating


@pytest.mark.parametrize("d", [0.1, 0.6, 0.93])
@pytest.mark.parametrize("weight", [0.01, 0.7, 30.0, 2_000.0])
def test_odds_of_large_dishes_are_those_of_the_recursion(d, weight):
    c, t = 1_400, np.arange(1, 1_401)
    want = seating.stirling(d, c)[c, 1:] + np.log(weight) * t
    best = float(np.argmax(want)) + 1
    got = seating.log_odds(c, weight, d, t, best)
    np.testing.assert_allclose(np.exp(got - got.max()), np.exp(want - want.max()), atol=2e-5)


@pytest.mark.parametrize("c,weight", [(17, 2.0), (300, 5.0), (1_024, 0.3), (1_400, 0.3), (1_400, 40.0)])
def test_tables_of_dishes_without_seats_keep_their_exact_odds(c, weight):
    """The mean and spread of their number, which a limit for many customers misses."""
    d, n = 0.6, 3_000
    tables, _ = seating.seated(np.full(n, c), np.full(n, weight), d, None, np.random.default_rng(2))
    log = seating.stirling(d, 1_400)[c, 1 : c + 1] + np.log(weight) * np.arange(1, c + 1)
    p = np.exp(log - log.max())
    p /= p.sum()
    mean = (p * np.arange(1, c + 1)).sum()
    spread = np.sqrt((p * (np.arange(1, c + 1) - mean) ** 2).sum())
    assert abs(tables.mean() - mean) < 5 * spread / np.sqrt(n) + 1e-9
    assert abs(tables.std() - spread) < 0.1 * spread + 1e-9


def test_a_very_large_dish_is_drawn_too():
    tables = seating.drawn(np.array([10**7, 10**12, 0, 1, 2_000]), np.array([50.0, 0.5, 1.0, 1.0, 1e6]), 0.7, np.random.default_rng(1))
    # 1 + Poisson(weight / d) is what they tend to
    assert 30 < tables[0] < 130 and 1 <= tables[1] < 10 and tables[2:4].tolist() == [0, 1] and 1_800 < tables[4] <= 2_000


def test_a_sweep_moves_every_customer():
    """From one table each, with a weight that keeps nobody alone, one sweep leaves few apart; customers drawn at random leave a third of them where they were."""
    n, c = 500, 16
    state = (np.full(n, c, np.uint32), np.ones(n * c, np.uint32))
    tables, _ = seating.seated(np.full(n, c), np.full(n, 1e-9), 0.5, state, np.random.default_rng(3))
    assert tables.mean() < 6


@pytest.mark.parametrize("c,weight,d", [(86_306, 69_774.0, 0.666), (209_213, 271_957.0, 0.28), (146_387, 3_356_007.0, 0.881), (9_231_817, 292_638.0, 0.908)])
def test_dishes_of_many_tables_end_near_their_mean(c, weight, d):
    """A first guess far from the mean never ended: rounding outweighs the odds there."""
    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(30)
    try:
        tables = seating.drawn(np.array([c]), np.array([weight]), d, np.random.default_rng(4))
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    # 1 - z of the average size: weight * z * (1 - z)**(d - 1) = c, by halving
    low, high = 0.0, 1.0
    for _ in range(200):
        rest = (low + high) / 2
        low, high = (low, rest) if weight * (1 - rest) * rest ** (d - 1) < c else (rest, high)
    mean = weight / d * (1 - rest**d)
    spread = np.sqrt(mean - c * rest / (rest + (1 - rest) * (1 - d)))
    assert abs(tables[0] - mean) < 6 * spread + 6


@pytest.mark.parametrize("weight", [20_000.0, 1e6, 1e8])
def test_odds_hold_where_nearly_all_tables_have_one_customer(weight):
    d, c, t = 0.6, 1_400, np.arange(1_300, 1_401)
    want = seating.stirling(d, c)[c, 1_300:] + np.log(weight) * t
    got = seating.log_odds(c, weight, d, t, float((t * np.exp(want - want.max())).sum() / np.exp(want - want.max()).sum()))
    np.testing.assert_allclose(np.exp(got - got.max()), np.exp(want - want.max()), atol=2e-5)


@pytest.mark.parametrize("c", [2, 3, 9, 16])
@pytest.mark.parametrize("weight", [1e-18, 0.01, 0.8, 40.0, 1e18])
def test_small_dishes_are_drawn_by_their_exact_odds(c, weight):
    """A dish's tables, drawn at once as those of large dishes are, among dishes of other sizes."""
    d, n = 0.6, 20_000
    log = seating.stirling(d, 16)[c, 1 : c + 1] + np.log(weight) * np.arange(1, c + 1)
    p = np.exp(log - log.max())
    counts = np.r_[np.full(n, c), 0, 1, 5, 700, 70_000, 2_000, 66_000]
    tables = seating.drawn(counts, np.r_[np.full(n, weight), np.ones(7)], d, np.random.default_rng(6))
    np.testing.assert_allclose(np.bincount(tables[:n], minlength=c + 1)[1:] / n, p / p.sum(), atol=0.015)
    assert tables[n : n + 2].tolist() == [0, 1] and (1 <= tables[n + 2 :]).all() and (tables[n + 2 :] <= counts[n + 2 :]).all()
