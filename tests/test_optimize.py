import numpy as np
import pytest

from murmur.functions import special
from murmur.operators import objective as ob
from murmur.plans import optimize as op


def quad(x):
    return 0.5 * float(np.sum((x - 1) ** 2))


def rosen(x):
    return float(np.sum(100 * (x[1:] - x[:-1] ** 2) ** 2 + (1 - x[:-1]) ** 2))


def rosen_g(x):
    g = np.zeros_like(x)
    d = x[1:] - x[:-1] ** 2
    g[:-1] = -400 * x[:-1] * d - 2 * (1 - x[:-1])
    g[1:] += 200 * d
    return g


def rosen_h(x):
    h = np.diag(np.full(len(x), 0.0))
    for i in range(len(x) - 1):
        h[i, i] += 1200 * x[i] ** 2 - 400 * x[i + 1] + 2
        h[i, i + 1] = h[i + 1, i] = -400 * x[i]
        h[i + 1, i + 1] += 200
    return h


@pytest.mark.parametrize("method,search", [("bfgs", "wolfe"), ("bfgs", "backtracking"), ("newton-cg", "wolfe")])
def test_line_search(method, search):
    got = op.minimize(op.line_search, rosen, [-1.2, 1.0, 0.5], jac=rosen_g, hess=rosen_h, method=method, search=search, max_iter=300)
    assert np.abs(got.x - 1).max() < 1e-3
    values = [t["fun"] for t in got.trace]
    assert all(b <= a for a, b in zip(values, values[1:], strict=False))


def test_line_search_within_bounds():
    got = op.line_search(quad, np.array([0.2, 0.3]), jac=lambda x: x - 1, method="bfgs", bounds=[(0, 0.5), (0, 3)])
    assert np.allclose(got.x, [0.5, 1.0], atol=1e-4)
    assert op.line_search(quad, np.zeros(2), jac=lambda x: x - 1, method="gd").fun < 1e-8


@pytest.mark.parametrize("solver", ["iterative", "cg-steihaug", op.nearly_exact])
@pytest.mark.parametrize("hess", ["bfgs", rosen_h])
def test_trust_region(solver, hess):
    got = op.trust_region(rosen, np.array([-1.2, 1.0]), jac=rosen_g, hess=hess, solver=solver, max_iter=500)
    assert np.abs(got.x - 1).max() < 1e-3


def test_region_steps():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a = rng.standard_normal((4, 4))
        b, g = (a + a.T) / 2, rng.standard_normal(4)
        s, t = op.nearly_exact(g, b, 0.7), op.steihaug(g, b, 0.7)
        m = lambda z: g @ z + 0.5 * z @ b @ z
        assert np.linalg.norm(s) <= 0.7 + 1e-6 and np.linalg.norm(t) <= 0.7 + 1e-6
        assert m(s) <= m(t) + 1e-6 and m(t) <= 0


@pytest.mark.parametrize("optimizer", ["gd", "adam", "adamax"])
def test_enopt(optimizer):
    ens = op.GaussianEnsemble(quad, 40, 3)
    got = op.enopt(quad, np.array([-1.0, 2.5]), 0.05 * np.eye(2), ensemble=ens, optimizer=optimizer, step=0.5, max_iter=40)
    assert got.fun < 0.02 and got.trace[-1]["fun"] == got.fun


def test_ensemble_on_spark_and_restart(spark, tmp_path):
    fun = op.EnsembleObjective(spark, lambda x, model: 0.5 * float(np.sum((x - 1 - 0 * model) ** 2)), bounds=[(0.0, 2.0)] * 2, models=2)
    assert abs(fun(np.array([0.5, 0.5]))) < 1e-12
    ens = op.GaussianEnsemble(fun, 10, 1, [(0, 1)] * 2)
    got = op.enopt(fun, np.zeros(2), 0.02 * np.eye(2), ensemble=ens, step=0.3, max_iter=2, bounds=[(0, 1)] * 2)
    got.save(spark, str(tmp_path / "t"))
    iteration, x = op.load(spark, str(tmp_path / "t"))
    assert iteration == got.trace[-1]["iteration"] and np.allclose(x, got.x)


def test_smc_and_genopt():
    ens = op.GaussianEnsemble(quad, 60, 4)
    assert op.smcopt(quad, np.zeros(2), 0.2 * np.eye(2), ensemble=ens, beta=5.0, max_iter=40).fun < 0.05
    for cma in (False, True):
        got = op.genopt(lambda x: float(np.sum((x - 0.6) ** 2)), np.array([0.2, 0.9]), 20.0, members=60, bounds=[(0, 1)] * 2, cma=cma, max_iter=25)
        assert got.fun < 0.01


def test_penalties():
    run = lambda f, x: op.line_search(f, np.zeros(2) if x is None else x, jac=lambda z: np.array([(f(z + h) - f(z - h)) / 2e-6 for h in 1e-6 * np.eye(2)]), max_iter=200)
    got = op.penalised(run, quad, lambda x: (np.array([x[0] + x[1] - 1]), np.array([x[0] - 0.7])))
    assert np.allclose(got.x, [0.7, 0.3], atol=5e-3)


def test_marginals():
    x = np.linspace(0.15, 0.85, 7)
    for m in (ob.Gaussian(0.4, 0.3), ob.Logistic(0.4, 0.2), ob.TruncatedGaussian(0.4, 0.3, 0.0, 1.0), ob.Beta(2.5, 3.5), ob.beta_of_mode(0.3, 8.0)):
        h = 1e-5
        log = lambda z, m=m: np.log(m.pdf(z))
        assert np.allclose((log(x + h) - log(x - h)) / (2 * h), m.grad_log(x), atol=1e-5)
        assert np.allclose((m.grad_log(x + h) - m.grad_log(x - h)) / (2 * h), m.hess_log(x), atol=1e-4)
        u = np.linspace(0.05, 0.95, 9)
        z = m.ppf(u)
        grid = np.linspace(m.ppf(np.array([1e-9]))[0], z[4], 20001)
        mass = np.sum((m.pdf(grid[1:]) + m.pdf(grid[:-1])) / 2 * np.diff(grid))
        assert abs(mass - u[4]) < 1e-4
    b = ob.Beta(2.5, 3.5)
    for k in range(2):
        up, down = (ob.Beta(2.5 + s * 1e-5 * (k == 0), 3.5 + s * 1e-5 * (k == 1)) for s in (1, -1))
        assert np.allclose((np.log(up.pdf(x)) - np.log(down.pdf(x))) / 2e-5, b.grad_shapes(x)[k], atol=1e-4)
    k = ob.concentration_of(0.3, 0.02)
    m = ob.beta_of_mode(0.3, k)
    assert abs(m.a * m.b / ((m.a + m.b) ** 2 * (m.a + m.b + 1)) - 0.02) < 1e-9


def test_special_functions():
    assert abs(float(special.digamma(1.0)) + 0.5772156649015329) < 1e-12 and abs(float(special.trigamma(1.0)) - np.pi**2 / 6) < 1e-9
    p = np.array([1e-10, 0.01, 0.5, 0.975, 0.999999])
    assert np.allclose(special.norm_cdf(special.norm_ppf(p)), p, rtol=1e-9)
    assert abs(float(special.norm_ppf(0.975)) - 1.959963984540054) < 1e-9
    u = np.array([0.1, 0.5, 0.9])
    assert np.allclose(special.beta_cdf(special.beta_ppf(u, 2.0, 5.0), 2.0, 5.0), u) and np.allclose(special.beta_cdf(u, 1.0, 1.0), u)


def test_copula_gradient_descends():
    rng_corr = np.array([[1.0, 0.5], [0.5, 1.0]])
    m = [ob.beta_of_mode(0.3, 12.0), ob.beta_of_mode(0.7, 12.0)]
    x, z = ob.copula_sample(m, rng_corr, 4000, 1)
    f = ((x - 0.5) ** 2).sum(1)
    g = ob.stein_gradient(ob.copula_score(m, rng_corr, x, z), f)
    assert g[0] < 0 < g[1]
    h = ob.stein_hessian(ob.copula_score(m, rng_corr, x, z), np.stack([m[k].hess_log(x[:, k]) for k in range(2)], 1), f)
    assert np.allclose(h, h.T)
    r = ob.correlation_gradient(rng_corr, z, f)
    assert np.allclose(r, r.T) and np.allclose(np.diag(r), 0)


def test_covariance_update_keeps_it_positive():
    rng = np.random.default_rng(2)
    c, path = np.eye(3), np.zeros(3)
    for _ in range(5):
        x = rng.standard_normal((10, 3))
        c, path = op.cma_update(c, x, (x**2).sum(1), np.zeros(3), path, 0.3, 0.1, 5)
    assert np.linalg.eigvalsh(c).min() > 0
