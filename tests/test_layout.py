"""Small operators that no query covers."""

import numpy as np
from pyspark.sql import functions as F

from murmur.operators import grid, layout, localization, observations, prior, simulate, statistics
from murmur.sources import records


def test_reshaping(spark):
    m = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 0, [3.0, 4.0])], "k string, o int, y array<double>")
    assert layout.flat(m, ["k"], ["o"]).first().y == [3, 4, 1, 2]
    assert [r.y for r in layout.of_member(m, 1, "y").orderBy("o").collect()] == [4, 2]
    s = spark.createDataFrame([("p", 0, 1.0), ("p", 1, 2.0)], "param string, cell int, x double")
    u = spark.createDataFrame([("p", 1, 9.0)], "param string, cell int, x double")
    assert {r.cell: r.x for r in layout.scatter(s, u, ["param", "cell"]).collect()} == {0: 1.0, 1: 9.0}
    both = layout.union_params({"a": s.drop("param"), "b": u.drop("param")})
    assert layout.of_param(both, "b").count() == 1
    wide = layout.pivot_types(spark.createDataFrame([(1, "q", 2.0)], "report int, datatype string, y double"), types=["q", "r"])
    assert [tuple(r) for r in layout.unpivot_types(wide, ["report"]).collect()] == [(1, "q", 2.0)]
    assert layout.assimilation_steps([[0, 1], 2], True) == [[0, 1], [2]] and layout.assimilation_steps([[0, 1], 2], False) == [[0, 1, 2]]
    assert layout.element([["a", 1], ["b", 2]], "b") == 2 and layout.index2d(7, 3) == (2, 1)


def test_observations(spark):
    raw = spark.createDataFrame([(1, "a", 0, "2.5"), (1, "b", 0, "N/A"), (2, "a", 0, ""), (2, "b", 0, None), (3, "b", 0, "1e3")], "report int, datatype string, comp int, d string")
    assert {(r.report, r.datatype): r.d for r in observations.organise(raw, {"b": 0.1}).collect()} == {(1, "a"): 2.5, (3, "b"): 100.0}
    v = spark.createDataFrame([(1, "a", 0, 4.0), (1, "b", 0, 9.0)], "report int, datatype string, comp int, v double")
    full = spark.createDataFrame([(1, "b", 0, 0, 2.0), (1, "b", 0, 1, 0.5)], "report int, datatype string, i int, j int, v double")
    blocks = observations.covariance_blocks(v, full)
    assert blocks.count() == 3 and {r.datatype: r.v for r in observations.variances_of(blocks).collect()} == {"a": 4.0, "b": 2.0}
    c = np.array([[2.0, 0.5], [0.5, 1.0]])
    assert np.abs(np.cov(observations.correlated_noise(c, 50_000, 1)) - c).max() < 0.05
    x = spark.createDataFrame([(0, 0.5, 0.0, 2.0), (1, 3.0, None, None)], "i int, x double, lb double, ub double")
    unit = observations.to_unit(x)
    assert [r.x for r in unit.orderBy("i").collect()] == [0.25, 3.0] and [r.x for r in observations.from_unit(unit).orderBy("i").collect()] == [0.5, 3.0]
    assert observations.expand_models(spark.createDataFrame([(0, 1.0), (1, 2.0)], "member int, x double"), 3).select("member").distinct().count() == 6


def test_small_matrices():
    assert [statistics.energy_rank([5, 3, 2], 0.8, k) for k in ("below", "upto", "reach")] == [1, 2, 2]
    a = statistics.positive_semidefinite(np.diag([1.0, -1.0]))
    assert np.allclose(a, np.diag([1.0, 1e-5]))
    x = statistics.resample(np.array([1.0, 2.0]), np.diag([1.0, 4.0]), 40_000, 2)
    assert np.abs(x.mean(1) - [1, 2]).max() < 0.05 and np.abs(np.cov(x) - np.diag([1, 4])).max() < 0.15


def test_numbered_and_shares(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 500).astype(float)
    df = spark.createDataFrame([(i * 37, float(x)) for i, x in enumerate(v)], "k long, s double")
    got = statistics.numbered(df, "k", "n", block=1000).orderBy("k").collect()
    assert [r.n for r in got] == list(range(500))
    share = {r.k: r.share for r in statistics.running_share(df, "s", "k", parts=7).collect()}
    order = sorted(range(500), key=lambda i: (-v[i], i))
    want = np.cumsum(v[order]) / v.sum()
    assert np.allclose([share[i * 37] for i in order], want)


def test_block_tables(spark):
    one = spark.createDataFrame([(0, 0, 1.0)], "i int, j int, v double")
    got = statistics.block_diagonal({"a": one, "b": one}, {"a": 1, "b": 1})
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1.0), (1, 1, 1.0)]
    corr = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5)], "p_i string, p_j string, rho double")
    assert statistics.blocks_of(corr, "p").count() == 1


def test_masks(spark):
    cells = spark.range(64).select(F.lit("x").alias("param"), F.col("id").cast("int").alias("cell"), F.lit(0).alias("k"), (F.col("id") / 8).cast("int").alias("j"), (F.col("id") % 8).cast("int").alias("i"), (F.col("id") != 9).alias("active"))
    got = localization.masks(cells, localization.parse(["gc 1 2 0 r all x 0 1 1 0 1 2", "region 1 1 0 b 3 x box 0 0 2 3 2 3"]), 10).collect()
    rho = {(r.datatype, r.report, r.cell): r.rho for r in got}
    assert ("r", None, 9) not in rho and rho["r", None, 10] == 1.0 and all(0 < v <= 1 for v in rho.values())
    assert {c for d, _, c in rho if d == "b"} == {18, 19, 26, 27}


def test_adaptive_tapers_keep_what_is_correlated(spark):
    rng = np.random.default_rng(3)
    z = rng.standard_normal((200, 1))
    x = np.concatenate([np.outer(np.ones(5), z[:, 0]) + 0.1 * rng.standard_normal((5, 200)), rng.standard_normal((60, 200))])
    state = spark.createDataFrame([("x", i, r.tolist()) for i, r in enumerate(x)], "param string, cell int, x array<double>")
    t = np.array([r.taper[0] for r in localization.adaptive_state(state, z, 3.0).orderBy("cell").collect()])
    assert t[:5].min() == 1 and t[5:].mean() < 0.1


def test_models_and_adjoints(spark):
    class Linear:
        def run_fwd_sim(self, state, member):
            return [{"v": 2 * state["x"][:1]}], [{("v", "x"): np.array([2.0, 0.0])}]

    state = spark.createDataFrame([("x", 0, [1.0, 2.0]), ("x", 1, [3.0, 4.0])], "param string, cell int, x array<double>")
    got = simulate.forecast(state, Linear(), adjoints=True)
    assert {r.member: r.y for r in got.where("param is null").collect()} == {0: 2.0, 1: 4.0}
    assert got.where("param = 'x' and cell = 0").select("y").distinct().first().y == 2.0
    h = np.array([[0.0, 1.0], [2.0, 3.0]])
    assert simulate.SurfaceModel(h).run_fwd_sim({"x": np.array([0.5, 9.0]), "y": np.array([0.5, 0.0])}, 0)[0]["elevation"].tolist() == [1.5, 1.0]
    assert simulate.IdentityModel().run_fwd_sim({"a": 1}, 0) == [{"a": 1}]
    ok = simulate.external(lambda s, m, f: ["python", "-c", "open('o','w').write('4')"], lambda f: [{"v": float(open(f + "/o").read())}], lambda s, m, f: None)
    bad = simulate.external(lambda s, m, f: ["python", "-c", "raise SystemExit(1)"], lambda f: [], lambda s, m, f: None)
    assert ok.run_fwd_sim({}, 0) == [{"v": 4.0}] and bad.run_fwd_sim({}, 0) is None


def test_controls_and_prior_options(tmp_path):
    x, v = prior.initial_controls([0.5, 3.0], "10%", (0.0, 2.0))
    assert x.tolist() == [0.5, 2.0] and np.allclose(v, 0.04)
    np.savez(tmp_path / "m.npz", mean=np.arange(8.0))
    p = prior.prior_of("poro", {"mean": str(tmp_path / "m.npz"), "var": [1.0, 2.0], "grid": [2, 2, 2], "vario": "sph", "range": 3.0})
    assert p.layer_mean(1).tolist() == [4, 5, 6, 7] and p.of_layer(p.variance, 1) == 2.0 and p.layers == 2
    assert prior.Levels((3, 2), (1.0, 3.0)).weights == (0.25, 0.75) and prior.max_iterations({"iteration": [["max_iter", 7]]}) == 7


def test_ridges_and_logs(spark, tmp_path):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(3.0))
    row = spark.range(1).select(grid.above(a, b), grid.above(b, a), grid.overlap(a, b, b, b), grid.overlap(a, b, a, b)).first()
    assert tuple(row) == (True, False, False, True)
    well = [("WELLETC", "CHAR", np.array(["", "P1"])), ("SWAT", "REAL", np.array([0.1, 0.2])), ("WELLETC", "CHAR", np.array(["", "P2"])), ("SWAT", "REAL", np.array([0.3]))]
    (tmp_path / "C.RFT").write_bytes(records.encode(well))
    df = records.read(spark, str(tmp_path / "C.RFT"))
    assert [round(r.v, 6) for r in records.well_log(df, "P2", "SWAT").collect()] == [0.3]
