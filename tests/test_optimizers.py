import numpy as np
import pytest

from vastlin.operators.dvector import DistVector, LocalVector
from vastlin.plans.lbfgs import LBFGS, OWLQN, Flag, History, quadratic, rosenbrock
from vastlin.plans.linesearch import SearchFailed, strong_wolfe


def test_two_loop_recursion_from_dot_products():
    rnd = np.random.default_rng(0)
    n, m = 8, 4
    a = rnd.normal(size=(n, n))
    a = a @ a.T + np.eye(n)
    h, s, y = History(m), [], []
    for _ in range(6):
        v = rnd.normal(size=n)
        h.push(LocalVector(v), LocalVector(a @ v))
        s, y = [*s, v][-m:], [*y, a @ v][-m:]
    g = rnd.normal(size=n)
    q, alphas = g.copy(), []
    for i in range(m - 1, -1, -1):
        alphas.append(s[i] @ q / (s[i] @ y[i]))
        q -= alphas[-1] * y[i]
    q *= s[-1] @ y[-1] / (y[-1] @ y[-1])
    for i in range(m):
        q += (alphas[m - 1 - i] - y[i] @ q / (s[i] @ y[i])) * s[i]
    assert np.allclose(h.direction(LocalVector(g)).values, -q, atol=1e-12)


@pytest.mark.parametrize("m", [4, 7, 10])
@pytest.mark.parametrize("dim", [4, 6])
def test_rosenbrock(m, dim):
    s = LBFGS(60, m).minimize(rosenbrock, LocalVector(np.tile([-1.2, 1.0], dim // 2)))
    assert np.allclose(s.x.values, 1, atol=1e-3)


def test_owlqn_quadratic():
    s = OWLQN(LocalVector(np.full(10, 3.0)), 100, 5).minimize(quadratic(), LocalVector(np.random.default_rng(1).uniform(-10, 10, 10)))
    assert np.allclose(s.x.values, 1.5, atol=1e-3)
    s = OWLQN(LocalVector(np.full(4, 10.0)), 100, 5).minimize(quadratic(), LocalVector(np.ones(4)))
    assert not s.x.values.any()


def test_states_and_flags():
    states = list(LBFGS(3, 5).iterations(rosenbrock, LocalVector(np.array([-1.2, 1.0]))))
    assert [s.iteration for s in states] == [0, 1, 2, 3] and states[-1].flag == Flag.MAX_ITER
    assert list(LBFGS(50, 5).iterations(quadratic(), LocalVector(np.zeros(3))))[-1].flag == Flag.GRADIENT_CONVERGED
    bad = lambda x: (float("nan") if x.values.any() else 1.0, LocalVector(np.ones(2)))
    assert list(LBFGS(5, 3).iterations(bad, LocalVector(np.zeros(2))))[-1].flag == Flag.SEARCH_FAILED
    with pytest.raises(ValueError):
        LBFGS(5, 0)
    with pytest.raises(SearchFailed):
        strong_wolfe(lambda a: (-a, -1.0), 1.0)


def test_distributed_iteration_as_local(spark):
    start = np.linspace(-3, 3, 7)
    a = LBFGS(2, 4).minimize(quadratic(), DistVector.of(spark, start, 3))
    b = LBFGS(2, 4).minimize(quadratic(), LocalVector(start))
    assert np.allclose(a.x.to_numpy(), b.x.values) and a.flag == b.flag


def test_distributed_rosenbrock_as_local(spark):
    start = np.linspace(-1.5, 1.2, 8)
    value, gradient = rosenbrock(DistVector.of(spark, start, 6))
    expected, slopes = rosenbrock(LocalVector(start))
    assert np.isclose(value, expected) and np.allclose(gradient.to_numpy(), slopes.values)
    with pytest.raises(ValueError):
        rosenbrock(DistVector.of(spark, start, 3))


def test_superseded_vectors_are_deleted(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from vastlin.operators.storage import _folder

    tables = lambda: len(list(Path(urlparse(_folder(spark)).path).glob("table-*")))
    before, m = tables(), 2
    states = LBFGS(6, m).iterations(rosenbrock, DistVector.of(spark, [-1.2, 1.0, 0.5, 0.2], 2))
    for state in states:  # the state's vectors and the history; the first point isn't written
        assert tables() - before <= 3 + 2 * m
    assert state.iteration == 6 and tables() - before <= 3 and state.x.to_numpy().shape == (4,)


def test_any_failure_ends_with_the_last_state():
    calls = []

    def f(x):
        calls.append(1)
        if len(calls) > 4:
            raise OSError("a job was lost")
        return rosenbrock(x)

    states = list(LBFGS(30, 4).iterations(f, LocalVector(np.array([-1.2, 1.0]))))
    assert states[-1].flag == Flag.SEARCH_FAILED and (states[-1].x is states[-2].x)
