"""Between long rows, arrays of members, and levels.

A matrix is a table with a row for each parameter or datum and an array column with a value for each member.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_matrix(long: DataFrame, keys: list[str], member: str = "member", value: str = "x") -> DataFrame:
    """Arrays in the order of members; every row of a matrix must have the same members."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(member).alias("m"), F.col(value).alias("v"))))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(value))


def to_long(matrix: DataFrame, value: str = "x", member: str = "member") -> DataFrame:
    rest = [c for c in matrix.columns if c != value]
    return matrix.select(*rest, F.posexplode(value).alias(member, value))


def of_param(matrix: DataFrame, param: str) -> DataFrame:
    return matrix.where(F.col("param") == param)


def of_member(matrix: DataFrame, number: int, value: str = "x") -> DataFrame:
    """One member's column, as a simulator sees it."""
    rest = [c for c in matrix.columns if c != value]
    return matrix.select(*rest, F.element_at(value, number + 1).alias(value))


def split_levels(matrix: DataFrame, sizes: list[int], value: str = "x") -> DataFrame:
    """A row for each level, with the members of that level; a level of size 0 has empty arrays."""
    starts = [0, *accumulate(sizes)]
    cuts = F.array(*[F.struct(F.lit(i).alias("level"), F.slice(value, starts[i] + 1, n).alias("part")) for i, n in enumerate(sizes)])
    rest = [c for c in matrix.columns if c != value]
    return matrix.select(*rest, F.explode(cuts).alias("cut")).select(*rest, "cut.level", F.col("cut.part").alias(value))


def join_levels(levels: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """The inverse of split_levels()."""
    parts = F.array_sort(F.collect_list(F.struct("level", value)))
    return levels.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p[value])).alias(value))


def levels_of_members(long: DataFrame, sizes: list[int], rank: str) -> DataFrame:
    """The level of each long row by the rank (from 0) of its member: cumulative sizes cut the ranks."""
    level = F.lit(len(sizes))
    for i, end in reversed(list(enumerate(accumulate(sizes)))):
        level = F.when(F.col(rank) < end, i).otherwise(level)
    return long.withColumn("level", level)


def augmented(obs: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Observations with their predictions; a datum without an observation, or without a prediction, is left out."""
    return obs.join(pred, keys)


def active_types(obs: DataFrame) -> DataFrame:
    return obs.select("report", "datatype").distinct()


def sizes(obs: DataFrame, pred: DataFrame) -> DataFrame:
    """Observed data of each predicted report and type, 0 if none."""
    n = obs.groupBy("report", "datatype").agg(F.count("d").alias("n"))
    return pred.select("report", "datatype").distinct().join(n, ["report", "datatype"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def scatter(state: DataFrame, update: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """state with the values of update where it has them."""
    new = update.select(*keys, F.col(value).alias("__new"))
    return state.join(new, keys, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def union_params(parts: dict[str, DataFrame]) -> DataFrame:
    """Several parameters as one state, told apart by `param`."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("param", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def pivot_types(pred: DataFrame, value: str = "y", types: list[str] | None = None) -> DataFrame:
    """A column for each data type, a row for each report and component."""
    return pred.groupBy(*[c for c in ("report", "comp") if c in pred.columns]).pivot("datatype", types).agg(F.first(value))


def unpivot_types(wide: DataFrame, ids: list[str], value: str = "y") -> DataFrame:
    return wide.unpivot(ids, [c for c in wide.columns if c not in ids], "datatype", value).where(F.col(value).isNotNull())


def flat(matrix: DataFrame, keys: list[str], order: list[str], value: str = "y") -> DataFrame:
    """The arrays of several rows of a key one behind another, in the order given."""
    parts = F.array_sort(F.collect_list(F.struct(*order, value)))
    return matrix.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p[value])).alias(value))


def assimilation_steps(index: list, sequential: bool) -> list[list[int]]:
    """The report numbers of each step: one step for each entry if sequential, else one step with all."""
    rows = [list(x) if isinstance(x, (list, tuple)) else [x] for x in index]
    return rows if sequential else [[x for row in rows for x in row]]


def element(pairs: list, name: str):
    """The value that a list of [name, value] pairs has for a name."""
    return next((p[1] for p in pairs if p[0] == name), None)


def index2d(number: int, columns: int) -> tuple[int, int]:
    return divmod(number, columns)
