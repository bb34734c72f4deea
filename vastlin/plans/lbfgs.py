"""Limited-memory quasi-Newton optimisers that touch vectors only through dot products and linear combinations.

The two-loop recursion runs on the table of dot products of the history's vectors, so the driver holds a few dozen numbers and
vectors may be distributed (``DistVector``) or local (``LocalVector``). Each iteration asks for the new
entries of the table in one batch, makes the direction with one combination, and searches along it.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from enum import IntEnum
from typing import Any

import numpy as np

from vastlin.plans.linesearch import SearchFailed, backtracking, strong_wolfe

Objective = Callable[[Any], tuple[float, Any]]


class Flag(IntEnum):
    NOT_CONVERGED = 0
    MAX_ITER = 1
    VALUE_CONVERGED = 2
    GRADIENT_CONVERGED = 3
    SEARCH_FAILED = 4


@dataclass(frozen=True)
class State:
    x: Any
    value: float
    gradient: Any
    adjusted_value: float
    adjusted_gradient: Any
    iteration: int
    initial_value: float
    values: tuple[float, ...]
    flag: Flag = Flag.NOT_CONVERGED


@dataclass
class History:
    """The newest m pairs (s, y) and their dot products."""

    m: int
    s: list[Any] = field(default_factory=list)
    y: list[Any] = field(default_factory=list)
    table: dict[tuple[int, int], float] = field(default_factory=dict)

    def push(self, s: Any, y: Any) -> None:
        """Adds a pair. One that doesn't curve upwards would spoil the directions and is left out."""
        kept_s, kept_y = [*self.s, s][-self.m :], [*self.y, y][-self.m :]
        basis = kept_s + kept_y
        known = self._known()
        pairs = [(a, b) for i, a in enumerate(basis) for b in basis[i:] if (id(a), id(b)) not in known]
        values = type(s).dots(pairs)
        fresh = {(id(a), id(b)): v for (a, b), v in zip(pairs, values, strict=True)}
        if fresh[id(s), id(y)] <= 0:
            s.release()
            y.release()
            return
        alive = {id(v) for v in basis}
        for v in [*self.s, *self.y]:
            if id(v) not in alive:
                v.release()
        self.table = {k: v for k, v in (self.table | fresh).items() if k[0] in alive and k[1] in alive}
        self.s, self.y = kept_s, kept_y

    def release(self) -> None:
        for v in [*self.s, *self.y]:
            v.release()

    def _known(self) -> set[tuple[int, int]]:
        return set(self.table) | {(b, a) for a, b in self.table}

    def direction(self, g: Any) -> Any:
        """-H g by the vector-free two-loop recursion."""
        k = len(self.s)
        if not k:
            return g.scale(-1.0)
        basis = [*self.s, *self.y, g]
        n = 2 * k + 1
        table = np.zeros((n, n))
        for i in range(n - 1):
            for j in range(i, n - 1):
                key = (id(basis[i]), id(basis[j]))
                table[i, j] = table[j, i] = self.table[key] if key in self.table else self.table[key[::-1]]
        table[-1] = table[:, -1] = type(g).dots([(b, g) for b in basis])
        delta, alpha = np.zeros(n), np.zeros(k)
        delta[-1] = -1
        for i in range(k - 1, -1, -1):
            alpha[i] = delta @ table[:, i] / table[i, k + i]
            delta[k + i] -= alpha[i]
        delta *= table[k - 1, 2 * k - 1] / table[2 * k - 1, 2 * k - 1]
        for i in range(k):
            delta[i] += alpha[i] - delta @ table[:, k + i] / table[i, k + i]
        return type(g).combine([(float(a), b) for a, b in zip(delta, basis, strict=True)])


class LBFGS:
    """L-BFGS with a strong Wolfe search."""

    def __init__(self, max_iter: int = 100, m: int = 7, tolerance: float = 1e-9, window: int = 20):
        if m <= 0:
            raise ValueError("m must be positive")
        self.max_iter, self.m, self.tolerance, self.window = max_iter, m, tolerance, window

    # what the L1 variant changes
    def adjust(self, x: Any, value: float, gradient: Any) -> tuple[float, Any]:
        return value, gradient

    def aim(self, history: History, state: State) -> Any:
        return history.direction(state.gradient)

    def step(self, state: State, direction: Any, alpha: float) -> Any:
        return state.x.axpy(alpha, direction)

    def search(self, phi: Callable[[float], tuple[float, float]], state: State, direction: Any) -> float:
        init = 1.0 / direction.norm() if state.iteration == 0 else 1.0
        alpha = strong_wolfe(phi, init)
        if alpha * state.gradient.norm() < 1e-10:
            raise SearchFailed("the step vanishes")
        return alpha

    def _converged(self, s: State) -> Flag:
        if self.max_iter >= 0 and s.iteration >= self.max_iter:
            return Flag.MAX_ITER
        if abs(s.adjusted_value - max(s.values)) <= self.tolerance * s.initial_value:
            return Flag.VALUE_CONVERGED
        if s.adjusted_gradient.norm() <= max(self.tolerance * s.adjusted_value, 1e-8):
            return Flag.GRADIENT_CONVERGED
        return Flag.NOT_CONVERGED

    def iterations(self, objective: Objective, x: Any) -> Iterator[State]:
        """States from the first point to the terminal one. After a failed search the history starts anew once.

        Vectors are written as they are made, and deleted as soon as no later step reads them: a state that was given out is gone
        when the next one comes. Any other failure of a step, a lost job say, ends the run with the last good state.
        """
        value, gradient = objective(x)
        av, ag = self.adjust(x, value, gradient)
        state = State(x, value, gradient, av, ag, 0, av, (math.inf,))
        yield state
        history, fresh = History(self.m), True
        while True:
            made: list[Any] = []  # by the search, the direction first
            try:
                direction = self.aim(history, state).materialize()
                made.append(direction)
                seen: dict[float, tuple] = {}

                def at(alpha: float, state: State = state, direction: Any = direction, seen: dict = seen, made: list = made) -> tuple:
                    if alpha not in seen:
                        seen.clear()  # one result is kept: the last, which is the one accepted as a rule
                        self._release(made[1:])
                        del made[1:]
                        new = self.step(state, direction, alpha).materialize()
                        v, g = objective(new)
                        seen[alpha] = (new, v, g, *self.adjust(new, v, g))
                        made += [new, g, seen[alpha][4]]
                    return seen[alpha]

                slope = state.adjusted_gradient.dot(direction)

                def phi(alpha: float, state: State = state, direction: Any = direction, slope: float = slope, at: Callable = at) -> tuple[float, float]:
                    if alpha == 0:
                        return state.adjusted_value, slope
                    found = at(alpha)
                    return found[3], found[4].dot(direction)

                new, v, g, av, ag = at(self.search(phi, state, direction))
                if not math.isfinite(av):
                    raise SearchFailed("the value is not finite")
                change = new.sub(state.x).materialize(), g.sub(state.gradient).materialize()
            except Exception as e:
                self._release(made)
                searched = isinstance(e, (SearchFailed, ZeroDivisionError))
                if not searched:
                    logging.getLogger(__name__).error("a step failed", exc_info=True)
                history.release()
                if fresh or not searched:
                    yield replace(state, flag=Flag.SEARCH_FAILED)
                    return
                history, fresh = History(self.m), True
                continue
            history.push(*change)
            fresh = False
            self._release([direction, *([] if state.iteration == 0 else [state.x]), state.gradient, state.adjusted_gradient])
            state = State(new, v, g, av, ag, state.iteration + 1, state.initial_value, (*state.values, v)[-self.window :])
            flag = self._converged(state)
            if flag:
                history.release()
                yield replace(state, flag=flag)
                return
            yield state

    @staticmethod
    def _release(vectors: list[Any]) -> None:
        for v in {id(v): v for v in vectors}.values():
            v.release()

    def minimize(self, objective: Objective, x: Any) -> State:
        state = None
        for state in self.iterations(objective, x):  # noqa: B007
            pass
        return state


class OWLQN(LBFGS):
    """The orthant-wise L1 variant; ``l1`` holds a weight per component."""

    def __init__(self, l1: Any, max_iter: int = 100, m: int = 7, tolerance: float = 1e-8, window: int = 20):
        super().__init__(max_iter, m, tolerance, window)
        self.l1 = l1

    def adjust(self, x: Any, value: float, gradient: Any) -> tuple[float, Any]:
        return value + x.l1_value(self.l1), x.pseudo_gradient(gradient, self.l1).materialize()

    def aim(self, history: History, state: State) -> Any:
        return history.direction(state.adjusted_gradient).project(state.adjusted_gradient)

    def step(self, state: State, direction: Any, alpha: float) -> Any:
        return state.x.orthant_step(direction, state.adjusted_gradient, alpha)

    def search(self, phi: Callable[[float], tuple[float, float]], state: State, direction: Any) -> float:
        first = state.iteration < 1
        norm = state.gradient.norm()
        return backtracking(phi, 0.5 / norm if first and norm else 1.0, state.value, 0.1 if first else 0.5)


def quadratic(center: float = 3.0) -> Objective:
    """sum (x - c)^2, a demonstration objective over either kind of vector."""

    def f(x: Any) -> tuple[float, Any]:
        from vastlin.operators.dvector import DistVector, LocalVector

        d = LocalVector(x.values - center) if isinstance(x, LocalVector) else x.shift(-center)
        g = d.scale(2.0)
        return d.dot(d), g.materialize() if isinstance(g, DistVector) else g

    return f


def rosenbrock(x: Any) -> tuple[float, Any]:
    """sum over pairs (a, b) of (1 - a)^2 + 100 (b - a^2)^2, for vectors of even size; distributed ones have an even number in a block."""
    from pyspark.sql import functions as F

    from vastlin.operators.dvector import DistVector, LocalVector

    if isinstance(x, DistVector):
        if x.per_block % 2 or x.size % 2:
            raise ValueError("pairs must not be split")
        pair = F.transform(F.sequence(F.lit(0), (F.size("values") / 2).cast("int") - 1), lambda i: F.struct(F.element_at("values", (2 * i + 1).cast("int")).alias("a"), F.element_at("values", (2 * i + 2).cast("int")).alias("b")))
        pairs = x.df.select("pid", pair.alias("p"))
        each = lambda p: F.pow(1 - p["a"], F.lit(2.0)) + 100 * F.pow(p["b"] - p["a"] * p["a"], F.lit(2.0))
        value = pairs.agg(F.sum(F.aggregate("p", F.lit(0.0), lambda s, p: s + each(p)))).first()[0]
        slopes = F.transform("p", lambda p: F.array(-2 * (1 - p["a"]) - 400 * p["a"] * (p["b"] - p["a"] * p["a"]), 200 * (p["b"] - p["a"] * p["a"])))
        return float(value), DistVector(pairs.select("pid", F.flatten(slopes).alias("values")), x.per_block, x.size).materialize()
    a, b = x.values[0::2], x.values[1::2]
    g = np.zeros(x.size)
    g[0::2], g[1::2] = -2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)
    return float(((1 - a) ** 2 + 100 * (b - a * a) ** 2).sum()), LocalVector(g)
