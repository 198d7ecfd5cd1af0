"""Keeping states, forecasts, runs and their logs."""

from __future__ import annotations

import json
import logging
import os
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_state(df: DataFrame, path: str, kind: str = "parquet", order: str = "i", value: str = "x") -> None:
    """A table as Parquet; controls, which are few, also as one .csv, .npy or .npz file."""
    if kind == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    x = np.array([r[0] for r in df.orderBy(order).select(value).collect()], float)
    if kind == "csv":
        np.savetxt(path, x, delimiter=",")
    elif kind == "npy":
        np.save(path, x, allow_pickle=False)
    elif kind == "npz":
        np.savez(path, x=x)
    else:
        raise ValueError(f"no kind of file {kind}")


def checkpoint(folder: str, iteration: int, tables: dict[str, DataFrame], settings: dict) -> None:
    """A run's tables and settings. Every checkpoint has a folder of its own and its manifest row comes last, so one that
    was cut off, or written again after a restart, harms none before it."""
    spark = next(iter(tables.values())).sparkSession
    place = f"{folder}/{iteration}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{place}/{name}")
    row = [(iteration, time.time_ns(), place, sorted(tables), json.dumps(settings, sort_keys=True))]
    spark.createDataFrame(row, "iteration int, at long, place string, tables array<string>, settings string").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def restart(spark: SparkSession, folder: str) -> tuple[int, dict[str, DataFrame], dict]:
    """The checkpoint completed last: iteration, tables, settings."""
    row = spark.read.parquet(f"{folder}/manifest").orderBy(F.desc("at")).first()
    return row["iteration"], {n: spark.read.parquet(f"{row['place']}/{n}") for n in row["tables"]}, json.loads(row["settings"])


def has_checkpoint(spark: SparkSession, folder: str) -> bool:
    """Whether folder, in whatever file system, has a manifest with a row committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/*.parquet")
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def export_state(state: DataFrame, path: str) -> None:
    """A state's array form as long rows, for programs that read one value a row."""
    state.select("param", "cell", F.posexplode("x").alias("member", "x")).write.mode("overwrite").parquet(path)


class RunLog:
    """A line of aligned columns for each iteration, to a logger and kept as rows."""

    def __init__(self, name: str, **columns: int) -> None:
        self.columns, self.rows, self.log = columns, [], logging.getLogger(name)

    def header(self) -> str:
        return " ".join(n.ljust(w) for n, w in self.columns.items())

    def write(self, **values) -> str:
        missing = set(values) - set(self.columns)
        if missing:
            raise ValueError(f"no columns {', '.join(sorted(missing))}")
        show = lambda v: f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v)
        line = " ".join(show(values.get(n)).ljust(w) for n, w in self.columns.items())
        if not self.rows:
            self.log.info(self.header())
        self.log.info(line)
        self.rows.append(values)
        return line

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in self.columns) for r in self.rows], ", ".join(f"{c} string" for c in self.columns))


def read_grid(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cells, corners and pillars of a grid, by the file's suffix: keyword text, or binary records."""
    from . import grids, records

    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".grdecl":
        return grids.tables(spark, grids.read(path))
    if suffix == ".egrid":
        with open(path, "rb") as f:
            found = {name: values for name, _, _, values in records.decode(f.read())}
        ni, nj, nk = (int(v) for v in found["GRIDHEAD"][1:4])
        grid = {
            "DIMENS": (ni, nj, nk), "COORD": found["COORD"].astype(float).reshape(nj + 1, ni + 1, 2, 3), "ZCORN": found["ZCORN"].astype(float).reshape(nk, 2, nj, 2, ni, 2),
            "ACTNUM": found["ACTNUM"].astype(bool).reshape(nk, nj, ni) if "ACTNUM" in found else np.ones((nk, nj, ni), bool),
        }
        return grids.tables(spark, grid)
    raise ValueError(f"no grid has the suffix {suffix}")
