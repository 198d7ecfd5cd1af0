"""Corner-point grids in keyword text: reading into tables, writing."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Keywords whose values are whole numbers. Fixed values of the format.
WHOLE = {"ACTNUM", "FACIES", "SATNUM", "PVTNUM", "EQLNUM", "FIPNUM"}
#: Property names in the other dialect. Fixed values of the format.
OTHER_NAMES = {"PORO": "POR", "PERMX": "PERMI", "PERMY": "PERMJ", "PERMZ": "PERMK", "ACTNUM": "NULL", "NTG": "NETGROSS"}


class GridError(ValueError):
    """What is wrong, in which file and line."""


def _words(path: str, seen: tuple[str, ...] = ()) -> Iterator[tuple[str, str, int]]:
    """(word, file, line) of a file and of those that it includes; comments are left out."""
    path = os.path.abspath(path)
    if path in seen:
        raise GridError(f"{path} includes itself")
    include = False
    for number, line in enumerate(open(path, encoding="utf-8", errors="replace"), 1):
        for word in re.findall(r"'[^']*'|/|[^\s/']+(?:/[^\s/']+)*", line.split("--")[0]):
            if include:
                if word == "/":
                    include = False
                else:
                    yield from _words(os.path.join(os.path.dirname(path), word.strip("'")), (*seen, path))
            elif word.upper() == "INCLUDE":
                include = True
            else:
                yield word, path, number


def sections(path: str) -> Iterator[tuple[str, list[str]]]:
    """Each keyword with its words up to the slash; repeats are expanded."""
    name, held = None, []
    for word, file, line in _words(path):
        if name is None:
            if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", word):
                raise GridError(f"{file}:{line}: a keyword should stand where {word!r} does")
            name = word.upper()
            if name in ("ECHO", "NOECHO"):
                name = None
        elif word == "/":
            yield name, held
            name, held = None, []
        elif (m := re.fullmatch(r"(\d+)\*(.*)", word)) and m[2]:
            held += [m[2]] * int(m[1])
        else:
            held.append(word)
    if name is not None:
        raise GridError(f"{path}: {name} has no end")


def read(path: str) -> dict:
    """A grid as arrays: DIMENS (ni, nj, nk), COORD (nj + 1, ni + 1, 2, 3), ZCORN (nk, 2, nj, 2, ni, 2), ACTNUM and
    properties (nk, nj, ni); pillars are turned into the map's axes if MAPAXES gives these."""
    grid: dict = {}
    for name, words in sections(path):
        if name in ("SPECGRID", "DIMENS"):
            grid["DIMENS"] = tuple(int(w) for w in words[:3])
        elif name == "MAPAXES":
            grid[name] = np.array(words, float)
        elif name in ("MAPUNITS", "GRIDUNIT", "COORDSYS", "GDORIENT", "PINCH"):
            grid[name] = [w.strip("'") for w in words]
        else:
            ni, nj, nk = grid["DIMENS"]
            shape = {"COORD": (nj + 1, ni + 1, 2, 3), "ZCORN": (nk, 2, nj, 2, ni, 2)}.get(name, (nk, nj, ni))
            values = np.array(words, float)
            if values.size != np.prod(shape):
                raise GridError(f"{path}: {name} has {values.size} values, not {np.prod(shape)}")
            values = values.reshape(shape)
            grid[name] = values.astype(bool) if name == "ACTNUM" else values.astype(int) if name in WHOLE else values
    if "MAPAXES" in grid and "COORD" in grid:
        y2x, y2y, ox, oy, x2x, x2y = grid["MAPAXES"]
        u, v = np.array([x2x - ox, x2y - oy]), np.array([y2x - ox, y2y - oy])
        a = np.stack([u / np.linalg.norm(u), v / np.linalg.norm(v)], 1)
        grid["COORD"][..., :2] = grid["COORD"][..., :2] @ a.T + (ox, oy)
    return grid


def shape(grid: dict) -> tuple[int, int, int]:
    ni, nj, nk = grid["DIMENS"]
    return nk, nj, ni


def _frame(spark: SparkSession, names: list[str], a: np.ndarray, value: str) -> DataFrame:
    import pyarrow as pa

    at = np.indices(a.shape).reshape(a.ndim, -1).astype(np.int32)
    return spark.createDataFrame(pa.table({**{n: at[k] for k, n in enumerate(names)}, value: a.ravel().astype(float)}))


def tables(spark: SparkSession, grid: dict) -> dict[str, DataFrame]:
    """cells, corners and pillars of a grid; inactive cells' properties are null."""
    import pyarrow as pa

    dims = shape(grid)
    at = np.indices(dims).reshape(3, -1).astype(np.int32)
    active = np.asarray(grid.get("ACTNUM", np.ones(dims, bool)), bool).ravel()
    columns = {"k": at[0], "j": at[1], "i": at[2], "active": active}
    for name, a in grid.items():
        if isinstance(a, np.ndarray) and a.shape == dims and name != "ACTNUM":
            columns[name.lower()] = pa.array(a.ravel().astype(float), mask=~active)
    out = {"cells": spark.createDataFrame(pa.table(columns))}
    if "ZCORN" in grid:
        out["corners"] = _frame(spark, ["k", "b", "j", "f", "i", "r"], grid["ZCORN"], "z")
    if "COORD" in grid:
        c = grid["COORD"]
        p = np.indices(c.shape[:3]).reshape(3, -1).astype(np.int32)
        out["pillars"] = spark.createDataFrame(pa.table({"j": p[0], "i": p[1], "end": p[2], **{n: c[..., k].ravel() for k, n in enumerate("xyz")}}))
    return out


def _write_values(f, values: np.ndarray, compressed: bool) -> None:
    from .tables import runs

    flat = np.nan_to_num(values.ravel())
    words = ["%d" % v for v in flat] if values.dtype.kind in "ib" else ["%.6f" % v for v in flat]
    if compressed:
        words = [w if n == 1 else f"{n}*{w}" for n, w in runs(words)]
    for i in range(0, len(words), 6):
        f.write(" ".join(words[i : i + 6]) + "\n")
    f.write("/\n\n")


def write(path: str, grid: dict, dialect: str = "ecl", multi: bool = False, compressed: bool = True) -> None:
    """A grid as one file, or with a file beside it for each property; the dialect `cmg` renames properties."""
    ni, nj, nk = grid["DIMENS"]
    stem = os.path.splitext(path)[0]
    with open(path, "w", encoding="ascii") as f:
        if dialect == "cmg":
            f.write(f"GRID CORNER {ni} {nj} {nk}\n\n")
        else:
            f.write(f"SPECGRID\n{ni} {nj} {nk} 1 F /\n\n")
        for name, a in grid.items():
            if not isinstance(a, np.ndarray) or name == "MAPAXES":
                continue
            label = OTHER_NAMES.get(name, name) if dialect == "cmg" else name
            if multi and name not in ("COORD", "ZCORN"):
                part = f"{stem}_{name.lower()}.inc"
                f.write(f"INCLUDE\n'{os.path.basename(part)}' /\n\n")
                with open(part, "w", encoding="ascii") as g:
                    g.write(f"{label}\n")
                    _write_values(g, a, compressed)
            else:
                f.write(f"{label}\n")
                _write_values(f, a, compressed)


def masked(values: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Values with what is masked, or no number, as NaN."""
    out = np.asarray(values, float).copy()
    if mask is not None:
        out[~np.asarray(mask, bool)] = np.nan
    return out


def main(argv: list[str]) -> int:
    """Reads a grid and writes it anew: IN OUT [dialect]."""
    write(argv[1], read(argv[0]), *(argv[2:3] or ["ecl"]))
    return 0
