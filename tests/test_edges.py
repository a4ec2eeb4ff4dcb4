"""The rules for a spectrum's ends, one by one."""

import numpy as np
import pytest

from peaklight.functions import edges
from peaklight.model import Trim


def test_points_that_a_span_takes():
    assert [edges.points_across(np.arange(9.0) * s, 4.0) for s in (0.5, 1, 2, 100)] == [8, 4, 3, 3] and edges.points_across(np.zeros(1), 4.0) == 3


def test_moving_medians_repeat_at_the_ends():
    a = np.array([9.0, 1, 5, 2, 8, 3, 7])
    assert edges.moving_median(a, 3).tolist() == [5, 5, 2, 5, 3, 7, 7]
    assert edges.moving_median(a, 4).tolist() == [3.5, 3.5, 3.5, 3.5, 4, 5, 5]
    assert edges.moving_median(a, 1).tolist() == a.tolist() == edges.moving_median(a, 8).tolist()


def test_the_first_step_that_is_enough_or_the_largest():
    level = np.array([0.0] * 6 + [60] * 6 + [200] * 6)
    assert edges.steepest_step(level, 3, 50) == 5 and edges.steepest_step(level, 3, 100) == 11 and edges.steepest_step(level, 3, 1000) == 11
    assert edges.steepest_step(level[:6], 3, 50) is None


@pytest.mark.parametrize(("after", "back"), [([300, 141], False), ([300, 140], True), ([300, 60], True), ([59, 300], False), ([300, 300], False)])
def test_a_rise_that_comes_back_is_a_band(after, back):
    assert edges.comes_back(np.array([130.0, 100, 180]), np.array(after, float), Trim(return_share=0.2, return_counts=40)) is back


def test_the_spread_of_values_that_are_alike_is_tiny():
    assert edges.sigma(np.full(5, 3.0)) == edges.sigma(np.zeros(0)) == edges.NOTHING
    assert edges.sigma(np.array([0.0, 1, 2, 3, 4])) == pytest.approx(1.4826)


def edge(level, rise, **how):
    x = np.arange(float(len(level)))
    return edges.Edge(x, np.array(level, float), rise, Trim(ramp_span=2, **how), x)


def test_a_ramp_ends_where_its_slope_is_spent():
    up = [0] * 10 + [40 * i for i in range(1, 11)] + [400] * 20
    at = edges.slope_ends(edge(up, 10))
    assert 19 <= at <= 22
    assert edges.slope_ends(edge(up[:20], 10)) is None and edges.slope_ends(edge(up[:11], 10)) is None


def test_a_ramp_ends_where_the_signal_falls():
    peak = [0] * 10 + [40 * i for i in range(1, 11)] + [400 - 10 * i for i in range(1, 21)]
    at = edges.fall_begins(edge(peak, 10, fall_counts=30.0, noise_range=6))
    assert peak[at] <= 370 and 22 <= at <= 25
    assert edges.fall_begins(edge(peak, 10, fall_counts=500.0, noise_range=6)) is None
    assert edges.fall_begins(edge(peak, 10, fall_counts=30.0, noise_range=6, fall_rising_share=-1.0)) is None


def test_zeros_at_both_ends():
    x, y = np.arange(10.0), np.array([0, 0, 5, 6, 7, 40, 40, 0, 0, 0.0])
    assert edges.leading_zeros(x, y, Trim(head_extra=0)) == 2 and edges.leading_zeros(x, y, Trim(head_extra=2)) == 4 and edges.leading_zeros(x, y[2:], Trim()) == 0
    assert edges.leading_zeros(x, np.zeros(10), Trim(head_extra=0)) == 9
    assert edges.trailing_zeros(y, 5, Trim()) == 7 and edges.trailing_zeros(y, 5, Trim(tail_jump=50)) == 10 and edges.trailing_zeros(y, 7, Trim()) == 10
    assert edges.trailing_zeros(np.zeros(4), 0, Trim()) == 4


def test_whole_spectra():
    x = np.arange(400.0)
    ramp = 5 + np.minimum(25.0 * x, 1000)
    assert edges.edge_range(x, ramp, Trim())[0] == 41 and edges.edge_range(x, ramp + 0 * x, Trim(edge_range=5)) == (0, 400)
    for n in (1, 2, 6, 7):
        assert edges.edge_range(x[:n], ramp[:n], Trim()) == (0, n)
    # A flat spectrum, and one that only noise moves, stay whole.
    assert edges.edge_range(x, np.full(400, 7.0), Trim()) == (0, 400)
