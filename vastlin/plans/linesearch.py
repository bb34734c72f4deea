"""Line searches over a function alpha -> (value, slope): strong Wolfe, and backtracking for piecewise-smooth objectives."""

from __future__ import annotations

import math
from collections.abc import Callable

Phi = Callable[[float], tuple[float, float]]


class SearchFailed(ArithmeticError):
    """No acceptable step was found."""


def strong_wolfe(phi: Phi, init: float, c1: float = 1e-4, c2: float = 0.9, steps: int = 10, zooms: int = 10) -> float:
    """A step with sufficient decrease and a slope of at most ``c2`` times the first (Nocedal and Wright, 3.5 and 3.6)."""
    f0, d0 = phi(0.0)

    def cubic(a: tuple[float, float, float], b: tuple[float, float, float]) -> float:
        (x, fx, dx), (y, fy, dy) = a, b
        m = dx + dy - 3 * (fx - fy) / (x - y)
        inner = m * m - dx * dy
        lo, hi = min(x, y), max(x, y)
        edge = 0.1 * (hi - lo)
        if inner < 0:
            return (lo + hi) / 2
        root = math.copysign(math.sqrt(inner), y - x)
        bottom = dy - dx + 2 * root
        at = y - (y - x) * (dy + root - m) / bottom if bottom else (lo + hi) / 2
        return min(max(at, lo + edge), hi - edge)

    def zoom(low: tuple[float, float, float], high: tuple[float, float, float]) -> float:
        for _ in range(zooms):
            t = cubic(low, high) if low[0] <= high[0] else cubic(high, low)
            f, d = phi(t)
            if f > f0 + c1 * t * d0 or f >= low[1] or math.isnan(f):
                high = (t, f, d)
            else:
                if abs(d) <= c2 * abs(d0):
                    return t
                if d * (high[0] - low[0]) >= 0:
                    high = low
                low = (t, f, d)
        raise SearchFailed("zoom")

    t, low = init, (0.0, f0, d0)
    for i in range(steps):
        f, d = phi(t)
        if not (math.isfinite(f) and math.isfinite(d)):
            t /= 2
            continue
        if f > f0 + c1 * t * d0 or (f >= low[1] and i > 0):
            return zoom(low, (t, f, d))
        if abs(d) <= c2 * abs(d0):
            return t
        if d >= 0:
            return zoom((t, f, d), low)
        low = (t, f, d)
        t *= 1.5
    raise SearchFailed("steps")


def backtracking(phi: Phi, init: float, first_value: float, shrink: float, steps: int = 20, grow: float = 2.1, armijo: float = 1e-4, wolfe: float = 0.9, least: float = 1e-10, most: float = 1e10) -> float:
    """A step by shrinking and growing. ``first_value`` stands for the value at the first step, as in the published optimiser."""
    f0, d0 = phi(0.0)
    t, f, d = init, first_value, phi(init)[1]
    for _ in range(steps):
        if f > f0 + t * d0 * armijo or not math.isfinite(f):
            factor = shrink
        elif d < wolfe * d0:
            factor = grow
        elif d > -wolfe * d0:
            factor = shrink
        else:
            return t
        t *= factor
        if not least <= t <= most:
            raise SearchFailed("step out of range")
        f, d = phi(t)
    return t
