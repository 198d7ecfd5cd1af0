"""Running a simulator over an ensemble, and the built-in models."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import noise

from . import layout


class Simulator(Protocol):
    """A plug-in: predicts from one member's parameters; None or False says that the run failed."""

    def run_fwd_sim(self, state: dict[str, np.ndarray], member: int) -> list[dict[str, np.ndarray]] | None: ...


#: Parts of the ring of donors: the first three hexadecimal digits of a place.
SECTORS = 16**3

PREDICTION = "member long, report int, datatype string, comp int, y double"


def forecast(state: DataFrame, simulator: Simulator, adjoints: bool = False) -> DataFrame:
    """Long predictions of every member of state (param, cell, x: array), a group each: member, report, datatype,
    comp, y. A failed member has no rows. With adjoints the simulator returns (predictions, adjoints) and the rows of
    the second, with param and cell, follow in columns of their own."""
    schema = PREDICTION + (", param string, cell int" if adjoints else "")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        (member,) = key
        frame = frame.sort_values(["param", "cell"])
        got = simulator.run_fwd_sim({p: g["x"].to_numpy() for p, g in frame.groupby("param")}, int(member))
        rows = []
        if got:
            predictions, derivatives = got if adjoints else (got, None)
            for report, by_type in enumerate(predictions):
                for datatype, values in by_type.items():
                    if values is not None:
                        rows += [(member, report, datatype, i, float(v)) + ((None, None) if adjoints else ()) for i, v in enumerate(np.atleast_1d(values))]
            for report, by_type in enumerate(derivatives or []):
                for (datatype, param), values in by_type.items():
                    rows += [(member, report, datatype, i, float(v), param, c) for i, line in enumerate(np.atleast_2d(values)) for c, v in enumerate(line)]
        names = ["member", "report", "datatype", "comp", "y", *(["param", "cell"] if adjoints else [])]
        return pd.DataFrame(rows, columns=names)

    return layout.to_long(state).groupBy("member").applyInPandas(run, schema)


def donors(members: DataFrame, succeeded: DataFrame, seed: str = "donor") -> DataFrame:
    """member, donor: for every failed member the successful one that a hash of the pair's ring position picks.

    Both stand on a ring by hash; a failed member takes the next successful one. No pairs are formed. The ring is dealt by
    the hash's first digits into SECTORS, which are searched apart; a member without a successful one ahead in its sector
    takes the first of the next sector that has one."""
    place = lambda c: F.substring(F.md5(F.concat_ws("|", F.lit(seed), c.cast("string"))), 1, 15)
    ok = succeeded.select("member").distinct()
    failed = members.select("member").join(ok, "member", "left_anti")
    ring = failed.select("member", place(F.col("member")).alias("at"), F.lit(None).cast("long").alias("donor")).unionByName(
        ok.select("member", place(F.col("member")).alias("at"), F.col("member").cast("long").alias("donor")))
    from pyspark.sql import Window as W

    sector = F.conv(F.substring("at", 1, 3), 16, 10).cast("int")
    ring = ring.withColumn("sector", sector)
    # from behind: a frame that ends at the row is carried on, one that begins at the row is read anew for each
    ahead = F.last("donor", ignorenulls=True).over(W.partitionBy("sector").orderBy(F.desc("at"), F.desc("member")).rowsBetween(W.unboundedPreceding, 0))
    found = ring.withColumn("next", ahead).where("donor is null")
    firsts = ring.where("donor is not null").groupBy("sector").agg(F.min_by("donor", F.struct("at", "member")).alias("first"))
    every = members.sparkSession.range(SECTORS).select(F.col("id").cast("int").alias("sector")).join(firsts, "sector", "left")
    behind = F.last("first", ignorenulls=True).over(W.orderBy(F.desc("sector")).rowsBetween(W.unboundedPreceding, -1))
    lowest = F.min_by("first", F.when(F.col("first").isNotNull(), F.col("sector"))).over(W.partitionBy())
    after = every.select("sector", F.coalesce(behind, lowest).alias("after"))  # SECTORS rows, whatever the members' number
    return found.join(F.broadcast(after), "sector").select("member", F.coalesce("next", "after").alias("donor"))


def replaced(long: DataFrame, picks: DataFrame) -> DataFrame:
    """long with the rows of each failed member copied from its donor; state and predictions alike."""
    copies = long.withColumnRenamed("member", "donor").join(F.broadcast(picks), "donor").drop("donor")
    return long.join(picks.select("member"), "member", "left_anti").unionByName(copies.select(*long.columns))


def matrix_of(predictions: DataFrame) -> DataFrame:
    return layout.to_matrix(predictions.select("report", "datatype", "comp", "member", "y"), ["report", "datatype", "comp"], value="y")


def scaled(predictions: DataFrame, factors: dict[str, float], reports: list[int] | None = None, value: str = "y") -> DataFrame:
    """A subset of reports, data types multiplied."""
    if reports is not None:
        predictions = predictions.where(F.col("report").isin(reports))
    table = F.create_map(*[x for k, v in factors.items() for x in (F.lit(k), F.lit(float(v)))]) if factors else None
    return predictions if table is None else predictions.withColumn(value, F.col(value) * F.coalesce(F.element_at(table, F.col("datatype")), F.lit(1.0)))


# -- models -----------------------------------------------------------------------------------------------------------


def linear_model(state: DataFrame, cells: list[int]) -> DataFrame:
    """The values at some cells, as one report's data."""
    return state.where(F.col("cell").isin(cells))


def cubic_model(x):
    """7/12 x^3 - 7/2 x^2 + 8 x, of a Column or an array."""
    return 7.0 / 12.0 * x * x * x - 7.0 / 2.0 * x * x + 8.0 * x


class PointModel:
    """Plug-in: the parameter's values at the given cells, a report each."""

    def __init__(self, param: str, cells: list[int], datatype: str = "value") -> None:
        self.param, self.cells, self.datatype = param, cells, datatype

    def run_fwd_sim(self, state, member):
        return [{self.datatype: np.atleast_1d(state[self.param][c])} for c in self.cells]


class CubicModel:
    def __init__(self, param: str, datatype: str = "value") -> None:
        self.param, self.datatype = param, datatype

    def run_fwd_sim(self, state, member):
        return [{self.datatype: cubic_model(np.atleast_1d(state[self.param]))}]


class IdentityModel:
    def run_fwd_sim(self, state, member):
        return [dict(state)]


class SurfaceModel:
    """Heights of a surface on a regular grid at points that the state holds as two parameters, bilinear between
    nodes and constant outside."""

    def __init__(self, heights: np.ndarray, x: str = "x", y: str = "y") -> None:
        self.heights, self.x, self.y = np.asarray(heights, float), x, y

    def run_fwd_sim(self, state, member):
        h = self.heights
        px, py = np.clip(state[self.x], 0, h.shape[1] - 1), np.clip(state[self.y], 0, h.shape[0] - 1)
        i, j = np.minimum(px.astype(int), h.shape[1] - 2), np.minimum(py.astype(int), h.shape[0] - 2)
        u, v = px - i, py - j
        z = h[j, i] * (1 - u) * (1 - v) + h[j, i + 1] * u * (1 - v) + h[j + 1, i] * (1 - u) * v + h[j + 1, i + 1] * u * v
        return [{"elevation": z}]


#: Environment of executors that run external simulators: one thread for each linear algebra call.
SINGLE_THREAD = {f"spark.executorEnv.{n}": "1" for n in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "NUMEXPR_NUM_THREADS")}


def external(command: Callable[[dict, int, str], list[str]], read: Callable[[str], list[dict]], setup: Callable[[dict, int, str], None]) -> Simulator:
    """A plug-in around a program: setup writes its input into a folder of the run's own, command names the program
    and its arguments, read takes its output; a nonzero exit is a failed run."""
    import subprocess
    import tempfile

    class Program:
        def run_fwd_sim(self, state, member):
            with tempfile.TemporaryDirectory() as folder:  # a run's own; nothing of it is read elsewhere
                setup(state, member, folder)
                done = subprocess.run(command(state, member, folder), cwd=folder, capture_output=True, env=None)
                return read(folder) if done.returncode == 0 else None

    return Program()


def synthetic_truth(cells: int, seed: str, spark) -> DataFrame:
    """cell, x: a reproducible truth for twin experiments."""
    return spark.range(cells).select(F.col("id").cast("int").alias("cell"), noise.normal(F.col("id").cast("string"), seed).alias("x"))
