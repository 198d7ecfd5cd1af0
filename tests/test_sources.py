import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest

from murmur.operators import grid as g
from murmur.operators import layout, wavelet
from murmur.sources import config, grids, records, tables


def test_keyword_values():
    text = "KEYWORD1\nSTRING1\n\nkeyword2\n1\n\n# note\nKEYWORD3\nSTRING1\tSTRING2\tSTRING3\n\nKEYWORD4\n1 2 3 4\n\nKEYWORD5\nSTRING1\tSTRING2\nSTRING3\n\nKEYWORD6\n1 2 3\n4 5\n\nKEYWORD7\nSTRING1\t1 2\tSTRING3\n\n"
    text += "KEYWORD8\nSTRING1\t1 2\t3 4\tSTRING2\t5\nSTRING3\t6 7 8\n\nKEYWORD9\nSTRING1 STRING2\n"
    assert config.parse_keywords(text.splitlines()) == {
        "keyword1": "string1", "keyword2": 1.0, "keyword3": ["string1", "string2", "string3"], "keyword4": [1.0, 2.0, 3.0, 4.0], "keyword5": [["string1", "string2"], ["string3"]],
        "keyword6": [[1.0, 2.0, 3.0], [4.0, 5.0]], "keyword7": ["string1", [1.0, 2.0], "string3"],
        "keyword8": [["string1", [1.0, 2.0], [3.0, 4.0], "string2", 5.0], ["string3", [6.0, 7.0, 8.0]]], "keyword9": "string1 string2",
    }


def test_configurations(tmp_path):
    text = tmp_path / "a.txt"
    text.write_text("DATAASSIM\n\nTRUEDATA\ntrue.csv\n\nNE\n50\n\nFWDSIM\n\nDATATYPE\nwopr\twwpr\n\nREPORTPOINT\n1 2 3\n")
    first, second, _ = config.read(str(text))
    assert first["ne"] == 50 and second == {"datatype": ["wopr", "wwpr"], "reportpoint": [1.0, 2.0, 3.0]}
    config.convert(str(text), str(tmp_path / "a.toml"))
    assert config.read_toml(str(tmp_path / "a.toml"))["fwdsim"]["datatype"] == ["wopr", "wwpr"]
    config.convert(str(text), str(tmp_path / "a.yaml"))
    assert config.read_yaml(str(tmp_path / "a.yaml"))["dataassim"]["ne"] == 50
    (tmp_path / "b.yaml").write_text("a: !ndarray [1, 2]\n")
    assert config.read_yaml(str(tmp_path / "b.yaml"))["a"].tolist() == [1, 2]
    with pytest.raises(ValueError, match="lacks"):
        config.read(str(tmp_path / "a.toml"))
    (tmp_path / "idx.csv").write_text("0,1\n2\n")
    (tmp_path / "types.csv").write_text("wopr,wwpr\n")
    o, s = config.organise({"assimindex": str(tmp_path / "idx.csv")}, {"datatype": str(tmp_path / "types.csv"), "reporttype": "dates", "reportpoint": {"date_range": [dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 21), 10]}})
    assert o["assimindex"] == [[0, 1], [2]] and s["datatype"] == ["wopr", "wwpr"] and len(s["reportpoint"]) == 3


@pytest.mark.parametrize("text", ["header_both,wopr,wwpr\n10,1.5,n/a\n20,[1 2],4\n", "wwpr,wopr\nn/a,1.5\n4,[1 2]\n", "1.5,n/a\n[1 2],4\n"])
def test_observation_layouts(spark, tmp_path, text):
    path = tmp_path / "d.csv"
    path.write_text(text)
    got = {(r.report, r.datatype, r.comp): r.d for r in tables.observations(spark, str(path), ["wopr", "wwpr"], [10, 20]).collect()}
    assert got == {(10, "wopr", 0): 1.5, (20, "wopr", 0): 1.0, (20, "wopr", 1): 2.0, (20, "wwpr", 0): 4.0}


def test_variances_and_frames(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("ABS,64,REL,[10 5]\nabs,32,rel,20\n")
    got = {(r.report, r.datatype): (r.kind, r.value, r.floor) for r in tables.variances(spark, str(path), ["a", "b"], [1, 2]).collect()}
    assert got == {(1, "a"): ("abs", 64.0, None), (1, "b"): ("rel", 10.0, 5.0), (2, "a"): ("abs", 32.0, None), (2, "b"): ("rel", 20.0, None)}
    frame = pd.DataFrame({"a": ["[1 2]", None], "b": [3.0, np.array([4.0, 5.0])]}, index=[1, 2])
    assert sorted(tuple(r) for r in tables.from_frame(spark, frame).collect()) == [(1, "a", 0, 1.0), (1, "a", 1, 2.0), (1, "b", 0, 3.0), (2, "b", 0, 4.0), (2, "b", 1, 5.0)]
    np.savez(tmp_path / "x.npz", m=np.arange(6.0).reshape(2, 3))
    assert [r.x for r in tables.arrays(spark, str(tmp_path / "x.npz")).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]


def test_property_files(spark, tmp_path):
    path = tmp_path / "p.inc"
    path.write_text("-- a comment / here\nPORO -- more\n3*0.2 0.3\n2*1e-2 /\nPERMX\n1 2 3 /\n")
    got = tables.properties(spark, str(path), "poro").orderBy("idx").collect()
    assert [r.v for r in got] == [0.2, 0.2, 0.2, 0.3, 0.01, 0.01]
    out = str(tmp_path / "q.inc")
    tables.write_property(tables.properties(spark, str(path), "poro"), out, "poro", compressed=True)
    assert "3*0.2" in open(out).read()
    assert [r.v for r in tables.properties(spark, out).orderBy("idx").collect()] == [r.v for r in got]


def small_grid():
    rng = np.random.default_rng(1)
    ni, nj, nk = 3, 2, 2
    coord = np.zeros((nj + 1, ni + 1, 2, 3))
    coord[..., 0], coord[..., 1] = np.arange(ni + 1)[None, :, None] * 10.0, np.arange(nj + 1)[:, None, None] * 20.0
    coord[..., 1, 2] = 100.0
    z = np.zeros((nk, 2, nj, 2, ni, 2)) + (np.arange(nk)[:, None] * 10 + np.arange(2) * 10)[:, :, None, None, None, None]
    return {"DIMENS": (ni, nj, nk), "COORD": coord, "ZCORN": z, "ACTNUM": rng.uniform(size=(nk, nj, ni)) > 0.3, "PORO": np.round(rng.uniform(size=(nk, nj, ni)), 3)}


@pytest.mark.parametrize("multi", [False, True])
def test_grid_round_trip(tmp_path, multi):
    grid = small_grid()
    path = str(tmp_path / "g.grdecl")
    grids.write(path, grid, multi=multi)
    got = grids.read(path)
    assert got["DIMENS"] == grid["DIMENS"]
    for k in ("COORD", "ZCORN", "ACTNUM", "PORO"):
        assert np.allclose(got[k], grid[k])
    assert (len(os.listdir(tmp_path)) > 1) == multi
    with pytest.raises(grids.GridError, match="no end"):
        (tmp_path / "bad").write_text("PORO\n1 2 3\n")
        grids.read(str(tmp_path / "bad"))


def test_grid_tables(spark):
    grid = small_grid()
    t = grids.tables(spark, grid)
    assert t["cells"].where("active and poro is null").count() == 0 and t["cells"].where("not active and poro is not null").count() == 0
    pts = g.corner_points(t["corners"], t["pillars"])
    box = g.bounding_box(pts).first()
    assert (box.min_x, box.max_x, box.min_y, box.max_y, box.min_z, box.max_z) == (0, 30, 0, 40, 0, 20)
    assert tuple(g.mass_center(pts).first()) == (15, 20, 10)
    hexes = g.hexahedron(t["corners"], g.corner_number(2, 2, 3)).collect()
    assert all(len(set(r.points)) == 8 for r in hexes)
    assert g.face_points(pts, g.Face.UP).count() == 12 * 4
    live = g.filtered(t["cells"], lambda i, j, k: (i > 0) & (k == 1))
    assert live.count() == int(grid["ACTNUM"][1, :, 1:].sum())
    snug = g.snug_pillars(t["pillars"], t["corners"]).where("end = 1").select("z").distinct().collect()
    assert [r.z for r in snug] == [20.0]
    turned = g.map_axes(pts, (1000.0, 500.0), (1000.0, 600.0), (900.0, 500.0)).where("x < 961").count()
    assert turned > 0
    assert g.sector(t["pillars"], (1, 0, 0), (2, 0, 1), pillars=True).select("i", "j").distinct().count() == 6
    assert g.parse_triple("(2, 3, 4)") == (1, 2, 3)


def test_binary_records(spark, tmp_path):
    head = np.zeros(100)
    head[8:11], head[14], head[64:67] = (3, 2, 2), 7, (5, 3, 2021)
    second = head.copy()
    second[64] = 9
    made = [
        ("INTEHEAD", "INTE", head), ("PORV", "REAL", np.array([0.0, *range(1, 12)])), ("PRESSURE", "REAL", np.arange(11.0)), ("NAMES", "CHAR", np.array([f"W{i}" for i in range(300)])),
        ("BIG", "DOUB", np.arange(2500.0)), ("INTEHEAD", "INTE", second), ("ENDSOL", "MESS", np.zeros(0)),
    ]
    (tmp_path / "C.UNRST").write_bytes(records.encode(made))
    df = records.read(spark, str(tmp_path / "C.UNRST")).cache()
    assert records.dimensions(df) == (3, 2, 2) and records.phases(df) == ["OIL", "WAT", "GAS"]
    assert [r.num for r in records.values(df, "BIG").orderBy("idx").collect()] == list(np.arange(2500.0))
    assert [r.text for r in records.values(df, "NAMES").orderBy("idx").collect()] == [f"W{i}" for i in range(300)]
    days = records.report_dates(df)
    assert records.at(days, dt.date(2021, 3, 9)) == 1
    cells = {r.cell: r.v for r in records.cell_data(df, "PRESSURE", 12, records.active_cells(df)).collect()}
    assert cells[0] is None and cells[1] == 0.0 and cells[11] == 10.0


def test_summary_vectors(spark, tmp_path):
    spec = [("KEYWORDS", "CHAR", np.array(["TIME", "WOPR", "WOPR"])), ("WGNAMES", "CHAR", np.array([":+:+", "P1", "P2"]))]
    data = [x for t in range(3) for x in (("SEQHDR", "INTE", np.array([0])), ("PARAMS", "REAL", np.array([t, 10 + t, 20 + t])))]
    (tmp_path / "C.SMSPEC").write_bytes(records.encode(spec))
    (tmp_path / "C.UNSMRY").write_bytes(records.encode(data))
    got = records.summary(*(records.read(spark, str(tmp_path / f"C.{x}")) for x in ("SMSPEC", "UNSMRY")), "WOPR", "P2").orderBy("step").collect()
    assert [r.v for r in got] == [20, 21, 22]


@pytest.mark.parametrize("sizes", [[5, 7, 3], [10], [2, 3, 1, 4, 2, 3], [3, 0, 2]])
def test_levels_round_trip(spark, sizes):
    n = sum(sizes)
    rows = [("x", i, [float(i * n + m) for m in range(n)]) for i in range(6)]
    m = spark.createDataFrame(rows, "param string, cell int, x array<double>")
    parts = layout.split_levels(m, sizes)
    assert sorted({(r.level, len(r.x)) for r in parts.collect()}) == [(i, s) for i, s in enumerate(sizes)]
    assert sorted(tuple(r) for r in layout.join_levels(parts, ["param", "cell"]).collect()) == rows


@pytest.mark.parametrize("name", ["haar", "db2"])
@pytest.mark.parametrize("shape", [(16,), (13,), (8, 6), (7, 9), (5, 6, 7)])
def test_wavelets_reconstruct(name, shape):
    a = np.random.default_rng(3).standard_normal(shape)
    parts = wavelet.decompose(a, 2, name)
    assert np.allclose(wavelet.reconstruct(*parts, name), a)


def test_sparse_fields(spark):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:16, :16]
    smooth = np.sin(x / 5) * np.cos(y / 4)
    s = wavelet.Sparse((16, 16), 2, "haar", colored=False)
    s.learn((smooth + 0.05 * rng.standard_normal((16, 16))).ravel())
    assert 16 <= len(s.leading) < 200
    back = s.restore(s.compress(smooth.ravel()))
    assert np.abs(back - smooth.ravel()).mean() < 0.1 and len(s.variances()) == len(s.leading)
    rows = [(1, "seis", i, [float(v), float(2 * v)]) for i, v in enumerate(smooth.ravel())]
    got = s.compress_members(spark.createDataFrame(rows, "report int, datatype string, comp int, y array<double>"), ["report", "datatype"]).orderBy("idx").collect()
    assert np.allclose([r.y[1] for r in got], 2 * s.compress(smooth.ravel()))


def test_runs_are_kept(spark, tmp_path):
    from murmur.sources import store

    df = spark.createDataFrame([("x", i, float(i)) for i in range(3)], "param string, i int, x double")
    for kind in ("csv", "npy", "npz"):
        store.save_state(df, str(tmp_path / f"s.{kind}"), kind)
    assert np.load(tmp_path / "s.npz")["x"].tolist() == [0, 1, 2] and np.loadtxt(tmp_path / "s.csv").tolist() == [0, 1, 2]
    for n in (1, 2):
        store.checkpoint(str(tmp_path / "c"), n, {"state": df.withColumn("x", df.x + n)}, {"lam": n})
    n, found, settings = store.restart(spark, str(tmp_path / "c"))
    assert n == 2 and settings == {"lam": 2} and [r.x for r in found["state"].orderBy("i").collect()] == [2, 3, 4]
    log = store.RunLog("t", iteration=10, misfit=12)
    assert log.write(iteration=1, misfit=2.5).split() == ["1", "2.5"] and log.table(spark).count() == 1
    store.export_state(spark.createDataFrame([("x", 0, [1.0, 2.0])], "param string, cell int, x array<double>"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    grid = small_grid()
    grids.write(str(tmp_path / "g.grdecl"), grid)
    ni, nj, nk = grid["DIMENS"]
    (tmp_path / "g.egrid").write_bytes(records.encode([("GRIDHEAD", "INTE", np.array([1, ni, nj, nk])), ("COORD", "REAL", grid["COORD"].ravel()), ("ZCORN", "REAL", grid["ZCORN"].ravel()), ("ACTNUM", "INTE", grid["ACTNUM"].ravel())]))
    a, b = (store.read_grid(spark, str(tmp_path / f"g.{x}")) for x in ("grdecl", "egrid"))
    assert sorted(map(tuple, a["corners"].collect())) == sorted(map(tuple, b["corners"].collect()))


def test_first_component(spark):
    from murmur.operators import diagnostics

    rng = np.random.default_rng(7)
    y = np.outer([1.0, 2.0, -1.0], rng.standard_normal(8)) + 0.01 * rng.standard_normal((3, 8))
    d = spark.createDataFrame([(i, "w", float(i), y[i].tolist()) for i in range(3)], "comp int, datatype string, d double, y array<double>")
    got = diagnostics.first_component(d, "w").orderBy("member").collect()
    u = np.linalg.svd(y - y.mean(1, keepdims=True))[0][:, 0]
    a = np.array([r.y for r in got])
    assert np.allclose(np.abs(a), np.abs(u @ y), atol=1e-8) and abs(abs(got[0].d) - abs(u @ np.arange(3.0))) < 1e-8
