"""Ensemble statistics. Aggregations of long rows, or expressions of arrays of members."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where a lambda in it has the value computed once for a row, not anew for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spread_of(values: Column) -> Column:
    """The sample's standard deviation."""
    squares = once(mean_of(values), lambda m: F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)))
    return F.sqrt(squares / (F.size(values) - 1))


def center(matrix: DataFrame, value: str = "x") -> DataFrame:
    """Members' deviations from their mean over sqrt(members - 1): the projection that makes squares covariances."""
    n = F.size(value)
    return matrix.withColumn(value, once(mean_of(F.col(value)), lambda mean: F.transform(value, lambda v: (v - mean) / F.sqrt(n - 1.0))))


def center_long(long: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    w = W.partitionBy(*keys)
    return long.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.sqrt(F.count(value).over(w) - 1.0))


def whiten(matrix: DataFrame, scale: str, value: str = "x") -> DataFrame:
    """Each row over its standard deviation. For full covariances see gram.whiten_blocks()."""
    return matrix.withColumn(value, F.transform(value, lambda v: v / F.col(scale)))


def moments(long: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    return long.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def cross_covariance(left: DataFrame, right: DataFrame, group: list[str], value: str = "x") -> DataFrame:
    """group, i, j, cov between rows i of left and j of right (columns: group, i or j, member, value), over members."""
    a = left.withColumnRenamed(value, "a")
    b = right.withColumnRenamed(value, "b")
    return a.join(b, [*group, "member"]).groupBy(*group, "i", "j").agg(F.covar_samp("a", "b").alias("cov"))


def correlation(left: DataFrame, right: DataFrame, group: list[str], value: str = "x", floor: float = 1e-6) -> DataFrame:
    """As cross_covariance(), population moments, standard deviations not below the floor."""
    a = left.withColumnRenamed(value, "a")
    b = right.withColumnRenamed(value, "b")
    spread = lambda c: F.greatest(F.stddev_pop(c), F.lit(floor))
    return a.join(b, [*group, "member"]).groupBy(*group, "i", "j").agg((F.covar_pop("a", "b") / (spread("a") * spread("b"))).alias("rho"))


def misfit(residuals: DataFrame) -> DataFrame:
    """member, misfit: squares of y - d over v, summed (columns member, y, d, v)."""
    r = F.col("y") - F.col("d")
    return residuals.groupBy("member").agg(F.sum(r * r / F.col("v")).alias("misfit"))


def misfit_summary(misfits: DataFrame) -> DataFrame:
    return misfits.agg(F.avg("misfit").alias("mean"), F.stddev_pop("misfit").alias("std"))


def outliers(misfits: DataFrame, times: float = 4.0) -> DataFrame:
    """Members whose misfit is further than so many standard deviations from the mean."""
    limits = misfit_summary(misfits)
    return misfits.join(F.broadcast(limits)).where(F.abs(F.col("misfit") - F.col("mean")) > times * F.col("std")).select("member", "misfit")


def screened(data: DataFrame) -> DataFrame:
    """report, datatype, v of data (report, datatype, d, v, y: array): where the observation lies outside the members'
    range, the variance is at least the gap squared."""
    low, high = F.array_min("y"), F.array_max("y")
    gap = F.greatest(low - F.col("d"), F.col("d") - high, F.lit(0.0))
    return data.select("report", "datatype", F.greatest(F.col("v"), gap * gap).alias("v"))


def level_bias(long: DataFrame, keys: list[str], finest: int, value: str = "x") -> DataFrame:
    """Each level's values moved so that its mean is the finest level's."""
    own = F.avg(value).over(W.partitionBy(*keys, "level"))
    fine = F.avg(F.when(F.col("level") == finest, F.col(value))).over(W.partitionBy(*keys))
    return long.withColumn(value, F.col(value) + fine - own)


def cov_to_corr(cov: DataFrame, group: list[str]) -> DataFrame:
    """group, i, j, rho from group, i, j, cov."""
    d = cov.where("i = j")
    a, b = d.select(*group, "i", F.col("cov").alias("vi")), d.select(*group, "j", F.col("cov").alias("vj"))
    return cov.join(a, [*group, "i"]).join(b, [*group, "j"]).select(*group, "i", "j", (F.col("cov") / F.sqrt(F.col("vi") * F.col("vj"))).alias("rho"))


def corr_to_cov(rho: DataFrame, spread: DataFrame, group: list[str]) -> DataFrame:
    """The inverse; spread: group, i, std."""
    a = spread.withColumnRenamed("std", "si")
    b = spread.select(*group, F.col("i").alias("j"), F.col("std").alias("sj"))
    return rho.join(a, [*group, "i"]).join(b, [*group, "j"]).select(*group, "i", "j", (F.col("rho") * F.col("si") * F.col("sj")).alias("cov"))


def time_correlation(spark, a: float, steps: int, dt: float) -> DataFrame:
    """i, j, rho = a ^ |dt (i - j)|."""
    i = spark.range(steps).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("j"))
    return i.withColumn("rho", F.pow(F.lit(float(a)), F.abs(dt * (F.col("i") - F.col("j")))))


def block_diagonal(blocks: dict[str, DataFrame], sizes: dict[str, int]) -> DataFrame:
    """i, j, v of several i, j, v tables along a diagonal."""
    out, at = None, 0
    for name, df in blocks.items():
        one = df.select((F.col("i") + at).alias("i"), (F.col("j") + at).alias("j"), "v")
        out, at = one if out is None else out.unionByName(one), at + sizes[name]
    return out


def blocks_of(corr: DataFrame, owner: str) -> DataFrame:
    """Only the pairs of one variable; owner names the column prefix that holds each index's variable."""
    return corr.where(F.col(f"{owner}_i") == F.col(f"{owner}_j"))


def clip(df: DataFrame, low: str, high: str, value: str = "x") -> DataFrame:
    """Values within limits, by columns; a null limit is none."""
    return df.withColumn(value, F.least(F.greatest(F.col(value), F.col(low)), F.col(high)))


def clip_matrix(matrix: DataFrame, low: float | None, high: float | None, value: str = "x") -> DataFrame:
    limit = lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high))  # noqa: E731  (nulls are skipped)
    return matrix.withColumn(value, F.transform(value, limit))


def running_share(df: DataFrame, value: str, key: str, parts: int = 200) -> DataFrame:
    """df with `share` (of the total, running from the largest value down, ties by key) and `n` (of all rows).

    The rows are dealt into `parts` ranges of the value; each range's sum begins where those of larger values end, so no
    task sorts the whole. What is broadcast is a row for each range."""
    bounds = sorted(set(df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []))
    part = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < F.col(value))) if bounds else F.lit(0)
    ranged = df.withColumn("__part", part)
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("t"), F.count(F.lit(1)).alias("c")).collect()
    rows, before = [], 0.0
    total, count = sum(r["t"] for r in sums), sum(r["c"] for r in sums)
    for r in sorted(sums, key=lambda r: -r["__part"]):
        rows.append((r["__part"], float(before)))
        before += r["t"]
    starts = F.broadcast(df.sparkSession.createDataFrame(rows, "__part int, __before double"))
    within = F.sum(value).over(W.partitionBy("__part").orderBy(F.desc(value), key))
    return ranged.join(starts, "__part").withColumn("share", (F.col("__before") + within) / F.lit(float(total))).withColumn("n", F.lit(count)).drop("__part", "__before")


def numbered(df: DataFrame, order: str, name: str, block: int = 100_000) -> DataFrame:
    """df with `name`, the rows' number from 0 by a whole-number column, counted by blocks of it."""
    blocks = df.withColumn("__block", F.floor(F.col(order) / block).cast("long"))
    counts = blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("c"))
    before = F.broadcast(counts.select("__block", (F.sum("c").over(W.orderBy("__block")) - F.col("c")).alias("__before")))  # a row a block
    within = F.row_number().over(W.partitionBy("__block").orderBy(order))
    return blocks.withColumn("__n", within).join(before, "__block").withColumn(name, (F.col("__before") + F.col("__n") - 1).cast("int")).drop("__block", "__n", "__before")


# -- small matrices, on the driver -----------------------------------------------------------------------------------


def energy_rank(spectrum: np.ndarray, energy: float, rule: str = "below") -> int:
    """How many leading singular values to keep. `below`: those whose cumulative share is below the energy, at least
    one; `upto`: at most it; `reach`: until it is reached."""
    s = np.sort(np.asarray(spectrum, float))[::-1]
    share = np.cumsum(s) / s.sum()
    if rule == "below":
        return max(1, int((share < energy).sum()))
    if rule == "upto":
        return max(1, int((share <= energy).sum()))
    if rule == "reach":
        return min(len(s), int((share < energy).sum()) + 1)
    raise ValueError(f"no energy rule {rule}")


def truncated_svd(a: np.ndarray, energy: float = 1.0, rule: str = "below", rank: int | None = None):
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    k = rank if rank is not None else (len(s) if energy >= 1 else energy_rank(s, energy, rule))
    return u[:, :k], s[:k], vt[:k]


def positive_semidefinite(a: np.ndarray, floor: float = 1e-5) -> np.ndarray:
    """The matrix itself if positive definite; else with eigenvalues not below the floor."""
    a = (a + a.T) / 2
    w, v = np.linalg.eigh(a)
    return a if w.min() > 0 else (v * np.maximum(w, floor)) @ v.T


def resample(mean: np.ndarray, cov: np.ndarray, members: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    w, v = np.linalg.eigh((cov + cov.T) / 2)
    return mean[:, None] + (v * np.sqrt(np.maximum(w, 0))) @ rng.standard_normal((len(mean), members))
