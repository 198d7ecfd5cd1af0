"""Localization: which data may change which parameters, and how much."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmur.functions import tapers

from .gram import Grams, _rows, data_grams, projected, transformed


@dataclass(frozen=True)
class Spec:
    """One entry: data of a type (and report, or all) change a parameter within a taper about positions (k, j, i).
    taper: gc, fb or region; a region is a box of inclusive cell ranges."""

    datatype: str
    param: str
    taper: str
    positions: tuple[tuple[int, int, int], ...] = ()
    report: int | None = None
    length: float = 1.0
    aniso: float = 1.0
    angle: float = 0.0
    box: tuple[int, int, int, int, int, int] | None = None


def parse(lines: list[str]) -> list[Spec]:
    """Entries of blank-separated tokens: taper, aniso, range, angle, datatype, report or `all`, param, then either
    `box` and six numbers (k, j, i from and to) or positions k j i."""
    out = []
    for line in lines:
        t = line.split()
        if not t or t[0].startswith("#"):
            continue
        kind, aniso, length, angle, datatype, report, param, *rest = t
        number = None if report == "all" else int(report)
        if rest and rest[0] == "box":
            out.append(Spec(datatype, param, kind, (), number, float(length), float(aniso), float(angle), tuple(int(x) for x in rest[1:7])))
        else:
            p = [int(x) for x in rest]
            out.append(Spec(datatype, param, kind, tuple(zip(p[::3], p[1::3], p[2::3], strict=True)), number, float(length), float(aniso), float(angle)))
    return out


def masks(cells: DataFrame, specs: list[Spec], members: int) -> DataFrame:
    """param, cell, datatype, report (null: all), rho > 0. cells: param, cell, k, j, i, active.

    Of several positions of an entry the largest weight counts; inactive cells and combinations without an entry have
    no row, which means no update."""
    table = [(n, s.datatype, s.param, s.report, s.taper, s.length, s.aniso, float(np.deg2rad(s.angle)), k, j, i) for n, s in enumerate(specs) if not s.box for k, j, i in s.positions]
    boxes = [(s.datatype, s.param, s.report, *s.box) for s in specs if s.box]
    spark = cells.sparkSession
    out = None
    live = cells.where("active")
    if table:
        at = F.broadcast(spark.createDataFrame(table, "entry int, datatype string, param string, report int, taper string, length double, aniso double, angle double, pk int, pj int, pi int"))
        near = live.join(at, "param").where((F.col("k") == F.col("pk")) & (F.abs(F.col("i") - F.col("pi")) <= 2 * F.col("length") * F.greatest("aniso", F.lit(1.0))))
        di, dj = F.col("i") - F.col("pi"), F.col("j") - F.col("pj")
        along, across = F.cos("angle") * di + F.sin("angle") * dj, -F.sin("angle") * di + F.cos("angle") * dj
        dist = F.sqrt(along * along + (across / F.col("aniso")) * (across / F.col("aniso")))
        h = dist / F.col("length")
        fb = tapers.furrer_bengtsson(F.when(h < 1, 1 - 1.5 * h + 0.5 * h * h * h).otherwise(0.0), members)
        rho = F.when(F.col("taper") == "gc", tapers.gaspari_cohn(dist, F.col("length"))).when(F.col("taper") == "fb", fb)
        out = near.withColumn("rho", rho).where("rho > 0").groupBy("param", "cell", "datatype", "report", "entry").agg(F.max("rho").alias("rho")).drop("entry")
    if boxes:
        at = F.broadcast(spark.createDataFrame(boxes, "datatype string, param string, report int, k0 int, k1 int, j0 int, j1 int, i0 int, i1 int"))
        inside = live.join(at, "param").where("k between k0 and k1 and j between j0 and j1 and i between i0 and i1")
        one = inside.select("param", "cell", "datatype", "report", F.lit(1.0).alias("rho"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("param", "cell", "datatype", "report").agg(F.max("rho").alias("rho"))


def nearest(cells: DataFrame, data: DataFrame) -> DataFrame:
    """cell, distance to the nearest datum; both tables have columns i and j, data are few."""
    d = F.sqrt(F.pow(F.col("i") - F.col("di"), F.lit(2)) + F.pow(F.col("j") - F.col("dj"), F.lit(2)))
    at = F.broadcast(data.select(F.col("i").alias("di"), F.col("j").alias("dj")))
    return cells.join(at).groupBy("cell").agg(F.min(d).alias("distance"))


def distance_weight(distances: DataFrame, length: float, kind: str, members: int) -> DataFrame:
    if kind == "gc":
        w = tapers.gaspari_cohn(F.col("distance"), length)
    elif kind == "fb":
        w = tapers.furrer_bengtsson(tapers.spherical(F.col("distance"), length), members)
    else:
        raise ValueError(f"no taper {kind}")
    return distances.withColumn("weight", w)


def within_radius(cells: DataFrame, data: DataFrame, radius: float) -> DataFrame:
    """cell, datum of all pairs at most radius apart: cells are bucketed in squares as wide as the radius, so a datum
    meets only the nine squares around it."""
    side = float(max(radius, 1e-12))
    bucket = lambda c: F.floor(F.col(c) / side).cast("long")
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = data.select("datum", F.col("i").alias("di"), F.col("j").alias("dj"), F.explode(shifts).alias("s"), bucket("i").alias("bi"), bucket("j").alias("bj"))
    spread = spread.select("datum", "di", "dj", (F.col("bi") + F.col("s.a")).alias("bi"), (F.col("bj") + F.col("s.b")).alias("bj"))
    d2 = F.pow(F.col("i") - F.col("di"), F.lit(2)) + F.pow(F.col("j") - F.col("dj"), F.lit(2))
    return cells.withColumn("bi", bucket("i")).withColumn("bj", bucket("j")).join(spread, ["bi", "bj"]).where(d2 <= radius * radius).select("cell", "datum")


def shuffled(long: DataFrame, group: list[str], seed: str = "shuffle") -> DataFrame:
    """long with members dealt anew within each group, alike for all cells: a member takes the values of the one that
    its hash rank points to."""
    members = long.select(*group, "member").distinct()
    key = F.concat_ws("|", F.lit(seed), F.col("member").cast("string"))
    by = W.partitionBy(*group)
    ranked = members.select(*group, "member", F.row_number().over(by.orderBy("member")).alias("a"), F.row_number().over(by.orderBy(F.md5(key), "member")).alias("b"))
    deal = ranked.select(*group, F.col("member").alias("source"), "a").join(ranked.select(*group, F.col("member").alias("target"), F.col("b").alias("a")), [*group, "a"])
    return long.join(deal.select(*group, F.col("source").alias("member"), "target"), [*group, "member"]).withColumn("member", F.col("target")).drop("target")


def noise_cutoff(rho: DataFrame, keys: list[str], times: float = 1.0) -> DataFrame:
    """keys, cutoff: times the median absolute correlation over 0.6745, of correlations known to be noise."""
    return rho.groupBy(*keys).agg((times * F.median(F.abs("rho")) / 0.6745).alias("cutoff"))


def universal_cutoff(rho: DataFrame, keys: list[str]) -> DataFrame:
    """sqrt(2 ln n) times the noise's deviation."""
    return rho.groupBy(*keys).agg((F.sqrt(2 * F.ln(F.count("rho"))) * F.median(F.abs("rho")) / 0.6745).alias("cutoff"))


def correlation_taper(rho: DataFrame, cutoffs: DataFrame, keys: list[str], kind: str = "hard") -> DataFrame:
    """rho with `taper`, by tapers.shrink()."""
    return rho.join(F.broadcast(cutoffs), keys).withColumn("taper", tapers.shrink(F.col("rho"), F.col("cutoff"), kind))


def adaptive_state(state: DataFrame, projections: np.ndarray, times: float = 1.0, kind: str = "hard", seed: int = 0) -> DataFrame:
    """Auto-adaptive localization: state (x: array) with `taper`, an array that weighs each direction of the data for the
    row: by its members' correlation with the direction (a column of the members x directions projections).

    Correlations with the members in shuffled order are noise; their median over all rows gives each direction's
    cutoff."""
    order = np.random.default_rng(seed).permutation(len(projections))
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast((projections, order))
    at = state.columns.index("x")

    def correlations(x: np.ndarray, z: np.ndarray) -> np.ndarray:
        x = x - x.mean(1, keepdims=True)
        z = z - z.mean(0)
        return (x @ z / len(z)) / np.outer(np.maximum(x.std(1), 1e-6), np.maximum(z.std(0), 1e-6))

    def noise_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, o = shared.value
        for batch in batches:
            if batch.num_rows:
                r = np.abs(correlations(_rows(batch.column(0))[:, o], z))
                col, val = np.tile(np.arange(r.shape[1]), len(r)), r.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(col, pa.int32()), pa.array(val)], ["direction", "rho"])

    cut = state.select("x").mapInArrow(noise_of, "direction int, rho double").groupBy("direction").agg((times * F.percentile_approx("rho", 0.5, 10_000) / 0.6745).alias("cutoff")).collect()
    cutoff = np.zeros(projections.shape[1])
    for r in cut:
        cutoff[r["direction"]] = r["cutoff"]
    limits = spark.sparkContext.broadcast(cutoff)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, _ = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(at))
                r = np.abs(correlations(x, z))
                c = limits.value
                t = (r > c).astype(float) if kind == "hard" else np.where(r > c, (r - c) / np.maximum(r, 1e-300), 0.0) if kind == "soft" else 1 / (1 + np.exp(-50 * (r - c)))
                new = t.reshape(len(x), -1)
                offsets = np.arange(0, new.size + 1, new.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(new.ravel()))], [*batch.schema.names, "taper"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return state.mapInArrow(run, StructType([*state.schema.fields, StructField("taper", ArrayType(DoubleType()))]))


#: Cells of a parameter in one tile of a local update.
TILE = 256


def local_update(state: DataFrame, data: DataFrame, mask: DataFrame | None = None, alpha: float = 1.0, keys: tuple[str, ...] = ("datum",)) -> DataFrame:
    """state after an update in which a parameter's row meets a datum with weight rho: the row's step is
    (rho * (xc Yc')) (Yc Yc' + alpha I)^-1 R, of whitened data.

    data: keys, y, e, v; mask: param, cell, keys, rho, absent meaning 0 (no mask: 1 everywhere). The inverse is applied by
    members x members sums (of few data: data x data), (R - Yc (alpha I + Yc' Yc)^-1 Yc' R) / alpha, so a datum's row needs no other. A task holds a
    tile of TILE cells and the data in reach of any of them."""
    grams = data_grams(data)
    inner = grams.solved(alpha)
    if mask is None:
        return transformed(state, inner)
    shared = state.sparkSession.sparkContext.broadcast(inner)
    tile = F.floor(F.col("cell") / TILE).cast("long").alias("__tile")
    reach = mask.select("param", tile, *keys, F.struct("cell", "rho").alias("__at")).groupBy("param", "__tile", *keys).agg(F.collect_list("__at").alias("__reach"))
    near = reach.join(data.select(*keys, "y", "e", "v"), list(keys)).select("param", "__tile", "__reach", "y", "e", "v")
    columns = state.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(columns)
        x, y, e = (_rows(t.column(c).combine_chunks()) for t, c in ((left, "x"), (right, "y"), (right, "e")))
        sd = np.sqrt(right.column("v").to_numpy())[:, None]
        yc = projected(y) / sd
        solved = ((e - y) / sd - yc @ shared.value) / alpha
        cells, at = left.column("cell").to_numpy(), right.column("__reach").combine_chunks()
        hits, datum = at.flatten(), np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
        hit, weight = (hits.field(n).to_numpy(zero_copy_only=False) for n in ("cell", "rho"))
        order = np.argsort(cells)
        spot = order[np.minimum(np.searchsorted(cells, hit, sorter=order), len(cells) - 1)]
        known = cells[spot] == hit
        rho = np.zeros((len(cells), len(yc)))
        rho[spot[known], datum[known]] = weight[known]
        new = x + (rho * (projected(x) @ yc.T)) @ solved
        offsets = np.arange(0, new.size + 1, new.shape[1], dtype=np.int32)
        return left.select(columns).set_column(columns.index("x"), "x", pa.ListArray.from_arrays(pa.array(offsets), pa.array(new.ravel())))

    return state.select("*", tile).groupBy("param", "__tile").cogroup(near.groupBy("param", "__tile")).applyInArrow(run, state.schema)


def adaptive_update(state: DataFrame, grams: Grams, lam: float = 0.0, energy: float = 1.0, times: float = 1.0, kind: str = "hard", seed: int = 0) -> DataFrame:
    """state after an update in which each row meets each singular direction of the data by adaptive_state()'s taper."""
    s, v = grams.leading(energy)
    tapered = adaptive_state(state, v, times, kind, seed)
    shared = state.sparkSession.sparkContext.broadcast((v, grams.toward(v) / (lam + 1 + s**2)[:, None]))
    at, width = state.columns.index("x"), len(state.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, pulls = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(at))
                new = x + (_rows(batch.column(width)) * (projected(x) @ directions)) @ pulls
                offsets = np.arange(0, new.size + 1, new.shape[1], dtype=np.int32)
                yield batch.select(list(range(width))).set_column(at, "x", pa.ListArray.from_arrays(pa.array(offsets), pa.array(new.ravel())))

    return tapered.mapInArrow(run, state.schema)


def by_datum(mask: DataFrame, data: DataFrame, keys: list[str]) -> DataFrame:
    """masks() (report null: all reports) as param, cell, keys, rho for the data present; the larger rho counts."""
    names = data.select(*keys)
    every = mask.where("report is null").drop("report").join(names, "datatype")
    one = mask.where("report is not null").join(names, ["report", "datatype"])
    columns = ["param", "cell", *keys]
    return every.select(*columns, "rho").unionByName(one.select(*columns, "rho")).groupBy(*columns).agg(F.max("rho").alias("rho"))
