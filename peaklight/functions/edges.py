"""What is cut off the ends of a spectrum: zeros at both, and at the left the ramp that a filter leaves.

A spectrum rises from such a ramp once and stays up; where it comes down again the rise was a band.  Each rule below is a function of its own that tells a place or
that there is none; ``edge_range`` puts them together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from peaklight.model import Trim

#: Fewest points that a left edge can be judged by.
FEWEST = 7
NOTHING = 1e-12


def points_across(x: np.ndarray, span: float) -> int:
    """How many typical steps of an axis a span takes, three at least."""
    if len(x) < 2:
        return 3
    step = max(float(np.median(np.diff(x))), NOTHING)
    return max(3, int(np.rint(span / step)))


def windows(a: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """The windows of w values that begin at ``starts``, one a row."""
    return a[starts[:, None] + np.arange(w)]


def moving_median(a: np.ndarray, w: int) -> np.ndarray:
    """The median of the w values around each place; near an end that of the last whole window, and what is shorter than a window stays."""
    if not 1 < w <= len(a):
        return a.copy()
    return np.median(windows(a, np.clip(np.arange(len(a)) - w // 2, 0, len(a) - w), w), axis=1)


def sigma(a: np.ndarray) -> float:
    """Robust spread of values, tiny where they are all alike."""
    if not len(a) or np.allclose(a, a[0]):
        return NOTHING
    return max(1.4826 * float(np.median(np.abs(a - np.median(a)))), NOTHING)


def first_true(mask: np.ndarray) -> int | None:
    return int(mask.argmax()) if mask.any() else None


def steepest_step(level: np.ndarray, w: int, enough: float) -> int | None:
    """Where the median of w values lies ``enough`` above that of the w before: the first such place, else the one of the largest step."""
    starts = np.arange(len(level) - 2 * w)
    if not len(starts):
        return None
    step = np.median(windows(level, starts + w, w), axis=1) - np.median(windows(level, starts, w), axis=1)
    at = first_true(step >= enough)
    return w + (int(step.argmax()) if at is None else at)


def comes_back(before: np.ndarray, after: np.ndarray, how: Trim) -> bool:
    """Whether a signal is again near the least value before its rise: within a share of that value or a number of counts."""
    least = float(before.min())
    return bool((np.abs(after - least) <= max(abs(least) * max(0.0, how.return_share), how.return_counts)).any())


@dataclass(frozen=True)
class Edge:
    """The left edge of a scaled spectrum, smoothed, from its first point to ``edge_range``; ``rise`` is where it goes up."""

    x: np.ndarray
    level: np.ndarray
    rise: int
    how: Trim
    #: The axis of the whole spectrum, which tells the typical step.
    axis: np.ndarray

    def far_enough(self) -> np.ndarray:
        """Places that lie a ramp's length behind the rise."""
        return self.x - self.x[self.rise] >= self.how.ramp_span

    def noise_points(self, most: int) -> int:
        """How many values at the very edge tell the noise, of ``most`` there are."""
        return min(max(5, int(np.count_nonzero(self.x <= self.x[0] + self.how.noise_range))), self.how.noise_points, most)


def slope_of(edge: Edge) -> np.ndarray:
    """The smoothed slope of each interval."""
    return moving_median(np.diff(edge.level) / np.maximum(np.diff(edge.x), NOTHING), points_across(edge.axis, edge.how.slope_window))


def slope_ends(edge: Edge) -> int | None:
    """The first place where the slope is spent: it lies within the noise and rises no more, or has dropped to a share of its peak."""
    how, slope = edge.how, slope_of(edge)
    begin = max(0, edge.rise - 1)
    if begin >= len(slope) - 1:
        return None
    place, peak = np.arange(len(slope)), begin + int(slope[begin:].argmax())
    quiet = how.quiet_sigma * sigma(slope[: max(5, edge.noise_points(len(slope)))])
    rising = moving_median((slope > 0).astype(float), points_across(edge.axis, how.slope_window))
    calm = (np.abs(slope) <= quiet) & (rising <= how.rising_share) & (place > begin)
    spent = (slope <= max(quiet, how.peak_share * float(slope[peak]))) & (place > peak)
    at = first_true((calm | spent) & edge.far_enough()[1:])
    return None if at is None else at + 1


def fall_begins(edge: Edge) -> int | None:
    """The first place that lies clearly below the highest one since the rise, behind a stretch that mostly doesn't rise."""
    how, level, n = edge.how, edge.level, len(edge.level)
    slope = slope_of(edge)
    noise = sigma(level[: max(5, min(edge.noise_points(len(slope)) + 1, n))])
    low, high = np.percentile(level, [10, 90])
    clear = max(how.fall_sigma * noise, how.fall_share * max(float(high - low), NOTHING), how.fall_counts)
    place = np.arange(edge.rise + 1, n)
    below = np.maximum.accumulate(level[edge.rise :])[:-1] - level[place] >= clear
    # Rising intervals in the stretch before a place, from running counts.
    counts = np.concatenate([[0], np.cumsum(slope > 0)])
    begin, end = np.maximum(edge.rise, place - points_across(edge.axis, how.fall_window)), np.minimum(place - 1, len(slope) - 1)
    length = end - begin
    share = (counts[np.maximum(end, begin)] - counts[begin]) / np.maximum(length, 1)
    at = first_true(below & edge.far_enough()[place] & (length > 0) & (share <= how.fall_rising_share))
    return None if at is None else int(place[at])


def ramp_end(x: np.ndarray, y: np.ndarray, how: Trim) -> int | None:
    """Where the ramp at the left edge of a scaled signal ends, or None where nothing is to be cut."""
    n = int(np.count_nonzero(x <= x[0] + how.edge_range)) if len(y) >= FEWEST else 0
    if n < FEWEST:
        return None
    w = points_across(x, how.smooth_window)
    level = moving_median(y[:n], w)
    rise = steepest_step(level, w, max(0.0, how.edge_jump))
    if rise is None:
        return None
    behind = y[(np.arange(len(x)) >= rise) & (x <= x[rise] + how.return_range)]
    if len(behind) < 2 or comes_back(y[:rise], behind, how):
        return None
    edge = Edge(x[:n], level, rise, how, x)
    if max(0, rise - 1) >= n - 2:
        return None
    ends = [e for e in (slope_ends(edge), fall_begins(edge)) if e is not None]
    return min(max(min(ends), rise + 1), n - 1) if ends else None


def leading_zeros(x: np.ndarray, y: np.ndarray, how: Trim) -> int:
    """Where a spectrum begins behind zeros, as measured, and head_extra of axis behind them; its last point where there is nothing else."""
    signal = np.abs(y) > how.zero
    begin = first_true(signal)
    if begin == 0 or how.head_extra <= 0:
        return len(y) - 1 if begin is None else begin
    begin = len(y) - 1 if begin is None else begin
    return min(begin + int(np.count_nonzero(x[begin:] < x[begin] + how.head_extra)), len(y) - 1)


def trailing_zeros(y: np.ndarray, start: int, how: Trim) -> int:
    """Where a spectrum ends before zeros that lie tail_jump or more below the points before them."""
    signal = np.flatnonzero(np.abs(y) > how.zero)
    end = int(signal[-1]) + 1 if len(signal) else 0
    if not start < end < len(y):
        return len(y)
    step = float(np.median(y[max(start, end - how.tail_points) : end])) - float(np.median(y[end:]))
    return end if step >= how.tail_jump else len(y)


def edge_range(x: np.ndarray, y: np.ndarray, how: Trim) -> tuple[int, int]:
    """Half-open range of the points that stay; x ascending.  One point stays at least; at the right nothing but zeros is cut."""
    start = leading_zeros(x, y, how)
    if start >= len(y) - 1:
        return start, len(y)
    rest = np.asarray(y[start:], float)
    size = np.ptp(rest)
    scaled = how.low + (rest - rest.min()) / size * (how.high - how.low) if size > 0 else np.full(len(rest), how.low)
    start += ramp_end(x[start:], scaled, how) or 0
    return start, trailing_zeros(y, start, how)
