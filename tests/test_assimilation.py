from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.operators import gram, prior, simulate
from murmur.plans import assimilation as da

NX, NE = 6, 400
CELLS = [1, 4]


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((NX, NE))
    x[1:] += 0.7 * x[:-1]
    state = spark.createDataFrame([("x", i, r.tolist()) for i, r in enumerate(x)], "param string, cell int, x array<double>")
    obs = spark.createDataFrame([(c, "v", 0, d, 0.25) for c, d in zip(CELLS, (1.5, -1.0), strict=True)], "report int, datatype string, comp int, d double, v double")

    def forward(s):
        return s.where(F.col("cell").isin(CELLS)).select(F.col("cell").alias("report"), F.lit("v").alias("datatype"), F.lit(0).alias("comp"), F.col("x").alias("y"))

    return da.Problem(state, forward, obs, NE), x


def posterior(x):
    """Closed form with the sample prior."""
    mean, c = x.mean(1), np.cov(x)
    k = c[:, CELLS] @ np.linalg.inv(c[np.ix_(CELLS, CELLS)] + 0.25 * np.eye(2))
    return mean + k @ (np.array([1.5, -1.0]) - mean[CELLS]), c - k @ c[CELLS]


def members(df):
    return np.array([r["x"] for r in df.orderBy("cell").collect()])


@pytest.mark.parametrize("run", [
    lambda p: da.es(p), lambda p: da.es(p, "subspace"), lambda p: da.esmda(p, prior.inflation(3, [2, 4, 4])), lambda p: da.esmda(p, [2.0, 2.0], "subspace2"),
    lambda p: da.enkf(p, [[1], [4]]), lambda p: da.gn_enrml(p, "subspace2", 1.0, max_iter=2),
], ids=["es", "es_subspace", "esmda", "esmda_subspace2", "enkf", "gnenrml"])
def test_linear_posterior(problem, run):
    p, x = problem
    got = members(run(p).state)
    mean, cov = posterior(x)
    assert np.abs(got.mean(1) - mean).max() < 0.1
    assert np.abs(np.cov(got) - cov).max() < 0.15


def test_one_step_mda_is_es(problem):
    p, _ = problem
    assert np.allclose(members(da.es(p).state), members(da.esmda(p, [1.0]).state))


@pytest.mark.parametrize("flavour", ["approx", "full", "subspace", "subspace2", "margis"])
def test_levenberg_marquardt_lowers_the_misfit(problem, flavour):
    result = da.lm_enrml(problem[0], flavour, lam=1.0, max_iter=3)
    kept = [t["misfit"] for t in result.trace if t["accepted"]]
    assert all(b < a for a, b in zip(kept, kept[1:], strict=False)) and kept[-1] < 0.7 * kept[0]


def test_rejected_steps_are_rolled_back(problem):
    p, _ = problem
    bad = da.Problem(p.state, lambda s: p.forward(s).withColumn("y", F.transform("y", lambda v: -v * v * v)), p.obs, p.members)
    result = da.lm_enrml(bad, lam=1e-9, gamma=2.0, max_iter=2)
    if not any(t["accepted"] for t in result.trace[1:]):
        assert np.allclose(members(result.state), members(p.state))
    assert result.trace_table(p.state.sparkSession).count() == len(result.trace)


def dense_update(x, rho, e, v):
    """x moved by the dense gain whose entries are multiplied by rho (cells x data)."""
    y = x[CELLS]
    xc, yc = gram.projected(x), gram.projected(y)
    return x + (rho * (xc @ yc.T)) @ np.linalg.solve(yc @ yc.T + v * np.eye(len(CELLS)), e - y)


def test_localized_mda_is_the_dense_one(spark, problem):
    p, x = problem
    rho = {(0, 1): 0.5, (1, 1): 1.0, (2, 1): 0.25, (2, 4): 0.5, (4, 4): 1.0}
    rows = [("x", c, "v", d, w) for (c, d), w in rho.items()] + [("x", 3, "v", None, 0.3), ("x", 5, "v", 9, 1.0)]
    mask = spark.createDataFrame(rows, "param string, cell int, datatype string, report int, rho double")
    local = replace(p, mask=mask)
    dense = np.zeros((NX, 2))
    for (c, d), w in rho.items():
        dense[c, CELLS.index(d)] = w
    dense[3] = 0.3
    want = x
    for i, alpha in enumerate((2.0, 2.0)):
        e = np.array([r["e"] for r in p.data(p.state, f"mda{i}", alpha).orderBy("report").collect()])
        want = dense_update(want, dense, e, 0.25 * alpha)
    got = members(da.esmda(local, [2.0, 2.0]).state)
    assert np.allclose(got, want) and np.array_equal(got[5], x[5])
    kept = [t["misfit"] for t in da.lm_enrml(local, lam=1.0, max_iter=2).trace if t["accepted"]]
    assert kept[-1] < kept[0]
    with pytest.raises(ValueError, match="localized"):
        da.es(local, "subspace")
    with pytest.raises(ValueError, match="localized"):
        da.gn_enrml(local)


def test_adaptive_loop_leaves_uncorrelated_rows(problem):
    p, x = problem
    far = replace(p, adaptive=1e6)
    assert np.allclose(members(da.es(far).state), x)
    assert np.allclose(members(da.es(replace(p, adaptive=0.0)).state), members(da.es(p).state))


def test_full_pulls_to_the_prior(problem):
    p, x = problem
    assert np.allclose(members(da.es(p, "full").state), members(da.es(p).state))  # nothing has moved yet
    two, plain = (members(da.esmda(p, [2.0, 2.0], f).state) for f in ("full", "approx"))
    assert np.linalg.norm(two.mean(1) - x.mean(1)) < np.linalg.norm(plain.mean(1) - x.mean(1))


def test_screening_widens_variances_beyond_the_members(spark, problem):
    p, x = problem
    far = replace(p, obs=spark.createDataFrame([(1, "v", 0, 50.0, 0.25), (4, "v", 0, -1.0, 0.25), (9, "v", 0, 1.0, 0.5)], p.obs.schema), screen=True)
    got = {r["report"]: r["v"] for r in far.screened().obs.collect()}
    assert np.isclose(got[1], (50 - x[1].max()) ** 2) and got[4] == 0.25 and got[9] == 0.5


def test_failed_and_far_members_are_replaced(spark, problem):
    p, x = problem
    wild = x.copy()
    wild[1, 7] = 500.0
    state = spark.createDataFrame([("x", i, r.tolist()) for i, r in enumerate(wild)], "param string, cell int, x array<double>")

    def forward(s):
        dead = F.transform("y", lambda v, m: F.when(m != 3, v))
        return p.forward(s).withColumn("y", dead)

    sick = replace(p, state=state, forward=forward, repair=True)
    new, data = sick.met(state, "n")
    got, y = members(new), np.array([r["y"] for r in data.orderBy("report").collect()])
    for m in (3, 7):
        assert any(np.array_equal(got[:, m], wild[:, k]) for k in range(NE) if k not in (3, 7))
        assert np.array_equal(y[:, m], got[CELLS, m])
    rest = [k for k in range(NE) if k not in (3, 7)]
    assert np.array_equal(got[:, rest], wild[:, rest])
    with pytest.raises(RuntimeError, match="every member failed"):
        replace(sick, forward=lambda s: p.forward(s).withColumn("y", F.transform("y", lambda v: F.lit(None).cast("double")))).met(state, "n")
    with pytest.raises(ValueError, match="replaced"):
        da.lm_enrml(sick, "subspace")


@pytest.mark.parametrize("run", [
    lambda p, n: da.esmda(p, [4.0] * 4), lambda p, n: da.lm_enrml(p, lam=1.0, max_iter=n, tol=0.0), lambda p, n: da.gn_enrml(p, max_iter=n, tol=0.0),
], ids=["esmda", "lmenrml", "gnenrml"])
def test_a_stopped_run_resumes(problem, tmp_path, run):
    p, _ = problem
    want = run(p, 3)
    forecasts = []

    def breaks(s):
        forecasts.append(1)
        if len(forecasts) == 3:
            raise OSError("stopped")
        return p.forward(s)

    with pytest.raises(OSError, match="stopped"):
        run(replace(p, keep=str(tmp_path / "run"), forward=breaks), 3)
    got = run(replace(p, keep=str(tmp_path / "run")), 3)
    assert np.allclose(members(got.state), members(want.state))
    assert [t["misfit"] for t in got.trace] == pytest.approx([t["misfit"] for t in want.trace])


def test_gies_and_names(problem):
    result = da.gies(problem[0], max_iter=2)
    assert result.trace[-1]["misfit"] < result.trace[0]["misfit"]
    assert da.scheme("ESMDA", "approx") is da.esmda
    with pytest.raises(ValueError, match="no scheme"):
        da.scheme("os", "system")


def test_two_equal_levels_are_one(spark, problem):
    p, x = problem
    two = spark.createDataFrame([("x", i, r.tolist(), r.tolist()) for i, r in enumerate(x)], "param string, cell int, x0 array<double>, x1 array<double>")
    got = da.multilevel_esmda(two, [p.forward, p.forward], p.obs, [NE, NE], [0.5, 0.5], [1.0])
    rows = got.orderBy("cell").collect()
    mean, _ = posterior(x)
    for c in ("x0", "x1"):
        assert np.abs(np.array([r[c] for r in rows]).mean(1) - mean).max() < 0.1


def test_streamed_reports(spark, problem, tmp_path):
    from murmur.streaming.sequential import SequentialFilter, start

    p, x = problem
    for n, c in enumerate(CELLS):
        p.obs.where(F.col("report") == c).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep = SequentialFilter(p)
    start(stream, keep, str(tmp_path / "check")).awaitTermination(120)
    assert keep.updates == 2
    keep.batch(p.obs, keep.last_batch)  # delivered again
    assert keep.updates == 2
    mean, _ = posterior(x)
    assert np.abs(members(keep.problem.state).mean(1) - mean).max() < 0.12


def test_inflation_factors():
    assert prior.inflation(4) == [4.0] * 4
    with pytest.raises(ValueError):
        prior.inflation(2, [2.0, 3.0])
    for steps in (1, 2, 4):
        a = prior.geometric_inflation(np.array([9.0, 5.0, 1.0]), steps)
        assert steps == 1 or abs(sum(1 / v for v in a) - 1) < 1e-6


def test_prior_samples(spark):
    p = prior.Prior("k", 2.0, (4.0, 1.0), (5, 4, 2), ("exp", "gau"), (3.0,), (0.5,), (30.0,))
    rows = prior.sample(spark, [p], 3000, 7).orderBy("cell").collect()
    x = np.array([r["x"] for r in rows])
    assert x.shape == (40, 3000) and np.abs(x.mean(1) - 2).max() < 0.2
    want = prior.variogram_covariance(5, 4, 4.0, 3.0, 0.5, 30.0, "exp")
    assert np.abs(np.cov(x[:20]) - want).max() < 0.5
    assert np.array_equal(x, np.array([r["x"] for r in prior.sample(spark, [p], 3000, 7).orderBy("cell").collect()]))
    scaled = {r["cell"]: r["std"] for r in prior.scaling(prior.sample(spark, [p], 3, 7), [p]).collect()}
    assert scaled[0] == 2.0 and scaled[39] == 1.0


def test_failed_members_take_a_donor(spark):
    from murmur.operators import layout, simulate

    class Fragile:
        def run_fwd_sim(self, state, member):
            return None if member % 3 == 0 else [{"v": state["x"] * 2}]

    state = spark.createDataFrame([("x", 0, [float(m) for m in range(9)])], "param string, cell int, x array<double>")
    got = simulate.forecast(state, Fragile())
    long = layout.to_long(state)
    picks = simulate.donors(long.select("member").distinct(), got.select("member").distinct())
    found = {r["member"]: r["donor"] for r in picks.collect()}
    assert set(found) == {0, 3, 6} and all(d % 3 for d in found.values())
    y = {r["member"]: r["y"] for r in simulate.replaced(got, picks).collect()}
    assert all(y[m] == 2.0 * found.get(m, m) for m in range(9))
    assert gram.projected(np.eye(2)).shape == (2, 2)


def test_donors_over_sectors_by_brute_force(spark):
    """Few members (sectors without a successful one, and none at all) and many."""
    import bisect
    import hashlib

    place = lambda m: (hashlib.md5(f"donor|{m}".encode()).hexdigest()[:15], m)
    for n, fails in ((12, lambda m: m % 5 == 0), (12, lambda m: m != 7), (3, lambda m: True), (20_000, lambda m: m % 5 == 0), (20_000, lambda m: m % 5000 > 0)):
        every = spark.range(n).withColumnRenamed("id", "member")
        good = [m for m in range(n) if not fails(m)]
        ring = sorted(place(m) for m in good)
        want = {m: ring[bisect.bisect(ring, place(m)) % len(ring)][1] if ring else None for m in range(n) if fails(m)}
        ok = spark.createDataFrame([(m,) for m in good], "member long")
        got = simulate.donors(every, ok)
        assert {r["member"]: r["donor"] for r in got.collect()} == want


def test_donor_windows_carry_their_frames(spark):
    """No frame that begins at its row, which Spark reads anew for each row, and no window over all members."""
    every = spark.range(100).withColumnRenamed("id", "member")
    plan = simulate.donors(every, every.where("member % 5 <> 0"))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(" in plan and "unboundedfollowing" not in plan.replace("unboundedpreceding$(), unboundedfollowing", "")


def test_gies_without_a_count_runs_until_it_settles(problem):
    got = da.gies(problem[0], max_iter=None)
    assert got.why in ("the misfit settled", "no step lowers the misfit") and got.trace[-1]["iteration"] > 2
    if got.why == "the misfit settled":
        kept = [t["misfit"] for t in got.trace if t["accepted"]]
        assert abs(1 - kept[-1] / kept[-2]) < 0.01


def test_gies_query_has_no_count_of_iterations(monkeypatch, spark, sf):
    from murmur import queries

    seen = []
    monkeypatch.setattr(queries.assimilation, "gies", lambda problem, **more: seen.append(more) or da.Result(problem.state))
    monkeypatch.setattr(queries, "_each_label", lambda spark, sf, run: run(0))
    queries.gies_rlmmac(spark, sf)
    assert seen == [{"max_iter": None}]
