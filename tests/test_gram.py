"""Updates by members x members matrices against the same formulas written with all data at once."""

import numpy as np
import pytest

from murmur.operators import gram, localization

NX, ND, NE = 40, 30, 12


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(3)
    x, y, e, v = rng.standard_normal((NX, NE)), rng.standard_normal((ND, NE)), rng.standard_normal((ND, NE)), rng.uniform(0.5, 2, ND)
    return x, y, e, v


@pytest.fixture(scope="module")
def frames(spark, case):
    x, y, e, v = case
    state = spark.createDataFrame([("x", i, r.tolist()) for i, r in enumerate(x)], "param string, cell int, x array<double>").repartition(3)
    data = spark.createDataFrame([(i, y[i].tolist(), e[i].tolist(), float(v[i])) for i in range(ND)], "datum int, y array<double>, e array<double>, v double").repartition(3)
    return state, data


def values(df, key="cell", value="x"):
    return np.array([r[value] for r in df.orderBy(key).collect()])


def test_grams_and_misfit(case, frames):
    _, y, e, v = case
    yc = gram.projected(y) / np.sqrt(v)[:, None]
    m = gram.data_grams(frames[1])
    assert np.allclose(m.g, yc.T @ yc) and np.allclose(m.h, yc.T @ ((e - y) / np.sqrt(v)[:, None]))
    assert np.allclose(gram.member_misfit(frames[1]), ((y - e) ** 2 / v[:, None]).sum(0))


def test_approx_is_the_kalman_update(case, frames):
    x, y, e, v = case
    state, data = frames
    for lam in (0.0, 3.0):
        got = values(gram.transformed(state, gram.approx_weights(gram.data_grams(data), lam)))
        cxy, cyy = gram.projected(x) @ gram.projected(y).T, gram.projected(y) @ gram.projected(y).T
        want = x + gram.kalman_gain(cxy, cyy, (lam + 1) * np.diag(v)) @ (e - y)
        assert np.allclose(got, want, atol=1e-9)
        assert np.allclose(gram.kalman_gain(cxy, cyy, np.diag(v), True), gram.kalman_gain(cxy, cyy, np.diag(v)))


def test_energy_cuts_directions(case, frames):
    x, y, e, v = case
    m = gram.data_grams(frames[1])
    yc = gram.projected(y) / np.sqrt(v)[:, None]
    u, s, vt = np.linalg.svd(yc, full_matrices=False)
    k = max(1, int((np.cumsum(s) / s.sum() < 0.9).sum()))
    want = (vt[:k].T * (s[:k] / (1 + s[:k] ** 2))) @ u[:, :k].T @ ((e - y) / np.sqrt(v)[:, None])
    got = gram.approx_weights(m, 0.0, 0.9)
    # the rank is counted over directions that have data
    assert np.allclose(got, want, atol=1e-8)


def test_ensemble_space_schemes_begin_as_approx(frames):
    m = gram.data_grams(frames[1])
    state = frames[0]
    want = values(gram.transformed(state, gram.approx_weights(m, 0.0)))
    assert np.allclose(values(gram.transformed(state, gram.subspace_weights(m, np.zeros((NE, NE)), 0.0), "prior")), want, atol=1e-9)
    assert np.allclose(values(gram.transformed(state, gram.subspace2_weights(m, np.eye(NE), 0.0), "mean")), want, atol=1e-9)


def test_full_adds_the_pull_of_the_prior(case):
    x, y, e, v = case
    rng = np.random.default_rng(5)
    x0 = x + 0.1 * rng.standard_normal(x.shape)
    xc, d0, yc = gram.projected(x), gram.projected(x0), gram.projected(y) / np.sqrt(v)[:, None]
    m = gram.Grams(yc.T @ yc, yc.T @ ((e - y) / np.sqrt(v)[:, None]))
    got = gram.full_weights(m, 1.0, d0.T @ d0, xc.T @ d0, d0.T @ (x - x0))
    u, s, vt = np.linalg.svd(yc, full_matrices=False)
    u, s, vt = u[:, : NE - 1], s[: NE - 1], vt[: NE - 1]
    p, q, _ = np.linalg.svd(d0, full_matrices=False)
    am = p[:, : NE - 1] / q[: NE - 1]
    want = vt.T @ np.diag(1 / (2 + s**2)) @ vt @ (yc.T @ ((e - y) / np.sqrt(v)[:, None]) - xc.T @ am @ am.T @ (x - x0))
    assert np.allclose(got, want, atol=1e-8)


def test_full_covariance_blocks(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((4, 4))
    c = a @ a.T + np.eye(4)
    y = rng.standard_normal((4, 3))
    rows = spark.createDataFrame([("w", i, y[i].tolist()) for i in range(4)], "b string, i int, y array<double>")
    blocks = spark.createDataFrame([("w", i, j, float(c[i, j])) for i in range(4) for j in range(4)], "b string, i int, j int, v double")
    got = np.array([r["y"] for r in gram.whiten_blocks(rows, blocks, ["b"], ["y"]).orderBy("i").collect()])
    assert np.allclose(got, np.linalg.solve(np.linalg.cholesky(c), y))


def test_local_update_is_the_masked_dense_one(spark, case, frames):
    x, y, e, v = case
    rng = np.random.default_rng(8)
    rho = rng.uniform(0, 1, (NX, ND)) * (rng.uniform(0, 1, (NX, ND)) > 0.4)
    mask = spark.createDataFrame([("x", i, n, float(rho[i, n])) for i in range(NX) for n in range(ND) if rho[i, n] > 0], "param string, cell int, datum int, rho double")
    yc, sd = gram.projected(y) / np.sqrt(v)[:, None], np.sqrt(v)[:, None]
    want = x + (rho * (gram.projected(x) @ yc.T)) @ np.linalg.solve(yc @ yc.T + np.eye(ND), (e - y) / sd)
    assert np.allclose(values(localization.local_update(*frames, mask)), want)
    assert np.allclose(values(localization.local_update(*frames)), values(gram.transformed(frames[0], gram.approx_weights(gram.data_grams(frames[1]), 0.0))), atol=1e-9)


def test_marginal_noise_follows_residuals(frames, case):
    _, y, e, v = case
    got = values(gram.marginal_ratio(frames[1], 2.0), "datum", "v")
    assert np.allclose(got, (((e - y) ** 2).sum(1) + 2 * v) / (NE + 2))


def test_few_data_give_the_same_weights(case):
    """Less data than members: by rows, and by members x members sums, over several steps."""
    rng = np.random.default_rng(9)
    y, r, b = rng.standard_normal((5, NE)), rng.standard_normal((5, NE)), rng.standard_normal((NX, NE))
    y = gram.projected(y) * 3
    few, many = gram.FewData(y, r), gram.Grams(y.T @ y, y.T @ r)
    same = lambda got, want: np.allclose(b @ got, b @ want, atol=1e-8) and np.allclose(got.dense(), want, atol=1e-8)
    for energy in (1.0, 0.8):
        assert same(gram.approx_weights(few, 2.0, energy), gram.approx_weights(many, 2.0, energy))
        assert same(gram.rlmmac_weights(few, 2.0, True, energy), gram.rlmmac_weights(many, 2.0, True, energy))
    assert same(few.solved(3.0), many.solved(3.0))
    x0 = gram.projected(rng.standard_normal((20, NE)))
    assert np.allclose(gram.full_weights(few, 1.0, x0.T @ x0, x0.T @ x0, x0.T @ x0), gram.full_weights(many, 1.0, x0.T @ x0, x0.T @ x0, x0.T @ x0), atol=1e-8)
    for update, base in ((gram.subspace_weights, 0.0), (gram.subspace2_weights, 1.0)):
        w, dense = gram.LowRank.unit(NE, base), base * np.eye(NE)
        for lam in (0.0, 1.5, 0.3, 4.0, 0.7):
            y = gram.projected(rng.standard_normal((5, NE)))
            few, many = gram.FewData(y, r), gram.Grams(y.T @ y, y.T @ r)
            w, dense = update(few, w, lam), update(many, dense, lam)
            assert same(w, dense) and w.left.shape[1] <= NE
            assert same(update(few, dense, lam), update(many, w, lam))


def test_members_beyond_any_square(spark):
    """20,000 members, of which a square has 3 GB, and two data."""
    rng = np.random.default_rng(10)
    n = 20_000
    x, e = rng.standard_normal((3, n)), rng.standard_normal((2, n))
    y, v = x[:2] + 0.1 * rng.standard_normal((2, n)), np.array([0.5, 2.0])
    state = spark.createDataFrame([("x", i, r.tolist()) for i, r in enumerate(x)], "param string, cell int, x array<double>")
    data = spark.createDataFrame([(i, y[i].tolist(), e[i].tolist(), float(v[i])) for i in range(2)], "datum int, y array<double>, e array<double>, v double")
    m = gram.data_grams(data)
    cxy, cyy = gram.projected(x) @ gram.projected(y).T, gram.projected(y) @ gram.projected(y).T
    want = x + gram.kalman_gain(cxy, cyy, np.diag(v)) @ (e - y)
    unit = gram.LowRank.unit
    for w, kind in ((gram.approx_weights(m, 0.0), "step"), (gram.subspace_weights(m, unit(n, 0.0), 0.0), "prior"), (gram.subspace2_weights(m, unit(n, 1.0), 0.0), "mean")):
        assert np.allclose(values(gram.transformed(state, w, kind)), want, atol=1e-9)


def test_gram_rows_by_blocks(spark, monkeypatch, case, frames):
    _, y, _, v = case
    yc = gram.projected(y) / np.sqrt(v)[:, None]
    for block in (5, 12, 100):
        monkeypatch.setattr(gram, "BLOCK", block)
        got = np.full((NE, NE), np.nan)
        for r in gram.gram_rows(frames[1], NE).collect():
            assert np.isnan(got[r["i"], r["j"]])
            got[r["i"], r["j"]] = r["g"]
        assert np.allclose(got, yc.T @ yc)


def test_gram_rows_take_no_square(spark):
    """9,000 members: 81 million rows, of which a task holds a block; before, all were Python objects of the driver."""
    from pyspark.sql import functions as F

    n = 9_000
    data = spark.createDataFrame([(np.arange(n, dtype=float).tolist(), 4.0)], "y array<double>, v double")
    got = gram.gram_rows(data, n).agg(F.count("*").alias("n"), F.sum(F.when(F.col("i") == F.col("j"), F.col("g"))).alias("trace")).first()
    assert got["n"] == n * n and got["trace"] == pytest.approx(np.arange(n).var(ddof=1) / 4)
