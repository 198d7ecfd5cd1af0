"""Corner-point grids as tables.

cells: k, j, i, active and properties; corners: k, b, j, f, i, r, z (b: top 0 or bottom 1; f: front 0 or back 1;
r: left 0 or right 1); pillars: j, i, end (0 top, 1 bottom), x, y, z, one more in j and i than cells.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["k", "j", "i"]
CORNER = ["k", "b", "j", "f", "i", "r"]


class Face(IntEnum):
    DOWN = 0
    UP = 1
    LEFT = 2
    RIGHT = 3
    FRONT = 4
    BACK = 5


class Phase(IntEnum):
    OIL = 1
    WATER = 2
    GAS = 4


#: Which corners a face has: the flag and its value. Fixed by the meaning of b, f and r.
FACES = {Face.UP: ("b", 0), Face.DOWN: ("b", 1), Face.LEFT: ("r", 0), Face.RIGHT: ("r", 1), Face.FRONT: ("f", 0), Face.BACK: ("f", 1)}

def _spread(df: DataFrame, flags: str) -> DataFrame:
    for name in flags:
        df = df.withColumn(name, F.explode(F.array(F.lit(0), F.lit(1))))
    return df


def cell_to_corners(cells: DataFrame, value: str) -> DataFrame:
    """A cell's value at each of its eight corners."""
    return _spread(cells.select(*CELL, value), "bfr").select(*CORNER, value)


def pillar_to_corners(values: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """A value by pillar (j, i) at the four corners of each cell's plane: j, f, i, r, value."""
    plane = _spread(cells.select("j", "i").distinct(), "fr").withColumn("pj", F.col("j") + F.col("f")).withColumn("pi", F.col("i") + F.col("r"))
    return plane.join(values.select(F.col("j").alias("pj"), F.col("i").alias("pi"), value), ["pj", "pi"]).select("j", "f", "i", "r", value)


def corner_number(nk: int, nj: int, ni: int) -> Column:
    """A corner's position in the flat (nk, 2, nj, 2, ni, 2) order."""
    return ((((F.col("k") * 2 + F.col("b")) * nj + F.col("j")) * 2 + F.col("f")) * ni + F.col("i")) * 2 + F.col("r")


def hexahedron(corners: DataFrame, number: Column) -> DataFrame:
    """k, j, i, points: the eight corner numbers in hexahedron order, round the bottom, then round the top."""
    turn = (1 - F.col("b")) * 4 + F.col("f") * 2 + F.when(F.col("f") == 0, F.col("r")).otherwise(1 - F.col("r"))
    pairs = F.array_sort(F.collect_list(F.struct(turn.alias("t"), number.alias("n"))))
    return corners.groupBy(*CELL).agg(F.transform(pairs, lambda p: p["n"]).alias("points"))


def corner_points(corners: DataFrame, pillars: DataFrame) -> DataFrame:
    """corners with x, y: where their depth is on the straight pillar that they are on."""
    top, bottom = (pillars.where(F.col("end") == e).select(F.col("j").alias("pj"), F.col("i").alias("pi"), *[F.col(c).alias(f"{c}{e}") for c in "xyz"]) for e in (0, 1))
    at = corners.withColumn("pj", F.col("j") + F.col("f")).withColumn("pi", F.col("i") + F.col("r"))
    on = at.join(top.join(bottom, ["pj", "pi"]), ["pj", "pi"])
    t = F.when(F.col("z1") != F.col("z0"), (F.col("z") - F.col("z0")) / (F.col("z1") - F.col("z0"))).otherwise(0.0)
    return on.select(*CORNER, (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"), "z")


def face_points(points: DataFrame, face: Face) -> DataFrame:
    flag, side = FACES[face]
    return points.where(F.col(flag) == side)


def filtered(cells: DataFrame, predicate: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Active cells for which the predicate of (i, j, k) holds."""
    live = cells.where("active")
    return live if predicate is None else live.where(predicate(F.col("i"), F.col("j"), F.col("k")))


def horizon(corners: DataFrame, bottom: bool = False) -> DataFrame:
    """k, j, i, z: the mean depth of each cell's top or bottom."""
    return corners.where(F.col("b") == int(bottom)).groupBy(*CELL).agg(F.avg("z").alias("z"))


def reduced(corners: DataFrame, how: str = "avg", values: str = "z") -> DataFrame:
    """k, b, pj, pi, value: corners that meet at a pillar as one, by min, max or avg."""
    at = corners.withColumn("pj", F.col("j") + F.col("f")).withColumn("pi", F.col("i") + F.col("r"))
    return at.groupBy("k", "b", "pj", "pi").agg({"min": F.min, "max": F.max, "avg": F.avg}[how](values).alias(values))


def snug_pillars(pillars: DataFrame, corners: DataFrame) -> DataFrame:
    """Pillars cut to begin at the shallowest and end at the deepest corner on them."""
    at = corners.withColumn("pj", F.col("j") + F.col("f")).withColumn("pi", F.col("i") + F.col("r"))
    ends = at.groupBy(F.col("pj").alias("j"), F.col("pi").alias("i")).agg(F.min("z").alias("low"), F.max("z").alias("high"))
    other = pillars.select("j", "i", (1 - F.col("end")).alias("end"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    both = pillars.join(other, ["j", "i", "end"]).join(ends, ["j", "i"])
    z = F.when(F.col("end") == 0, F.col("low")).otherwise(F.col("high"))
    t = F.when(F.col("z2") != F.col("z"), (z - F.col("z")) / (F.col("z2") - F.col("z"))).otherwise(0.0)
    return both.select("j", "i", "end", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"), z.alias("z"))


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def mass_center(points: DataFrame) -> DataFrame:
    """The mean of the cells' mean corners."""
    return points.groupBy(*CELL).agg(*[F.avg(c).alias(c) for c in "xyz"]).agg(*[F.avg(c).alias(c) for c in "xyz"])


def map_axes(points: DataFrame, origin: tuple[float, float], x_axis: tuple[float, float], y_axis: tuple[float, float]) -> DataFrame:
    """Points turned and moved from a grid's own axes into the map's: the axes are given by a point on each."""
    ux, uy = x_axis[0] - origin[0], x_axis[1] - origin[1]
    vx, vy = y_axis[0] - origin[0], y_axis[1] - origin[1]
    nu, nv = (ux * ux + uy * uy) ** 0.5, (vx * vx + vy * vy) ** 0.5
    x = origin[0] + F.col("x") * (ux / nu) + F.col("y") * (vx / nv)
    y = origin[1] + F.col("x") * (uy / nu) + F.col("y") * (vy / nv)
    return points.withColumns({"x": x, "y": y})


def sector(df: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], pillars: bool = False) -> DataFrame:
    """The cells (or corners, or pillars) of a box of inclusive (i, j, k) from 0, numbered from 0."""
    extra = 1 if pillars else 0
    keep = F.col("i").between(low[0], high[0] + extra) & F.col("j").between(low[1], high[1] + extra)
    if not pillars:
        keep = keep & F.col("k").between(low[2], high[2])
    out = df.where(keep).withColumn("i", F.col("i") - low[0]).withColumn("j", F.col("j") - low[1])
    return out if pillars else out.withColumn("k", F.col("k") - low[2])


def parse_triple(text: str) -> tuple[int, int, int]:
    """`(i, j, k)`, counted from 1, as one from 0."""
    i, j, k = (int(x) for x in text.strip().strip("()").split(","))
    return i - 1, j - 1, k - 1


def above(a: Column, b: Column) -> Column:
    """Whether one ridge (two depths, an array) lies above another: nowhere deeper, somewhere shallower."""
    p, q = (lambda n: F.element_at(a, n)), (lambda n: F.element_at(b, n))
    return (p(1) <= q(1)) & (p(2) <= q(2)) & ((p(1) < q(1)) | (p(2) < q(2)))


def overlap(top: Column, bottom: Column, other_top: Column, other_bottom: Column) -> Column:
    """Whether two faces, each between two ridges, touch."""
    return ~(above(bottom, other_top) | (bottom == other_top) | above(other_bottom, top) | (other_bottom == top))
