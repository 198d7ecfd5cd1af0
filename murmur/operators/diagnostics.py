"""Quality control of ensembles and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coverage(data: DataFrame, keys: list[str]) -> DataFrame:
    """keys, below, above of long data (keys, member, d, y): the observation lies strictly below, or above, all members."""
    return data.groupBy(*keys).agg(F.every(F.col("d") < F.col("y")).alias("below"), F.every(F.col("d") > F.col("y")).alias("above"))


def coverage_of_levels(data: DataFrame, keys: list[str]) -> DataFrame:
    """A datum is uncovered if it is on one side at every level (columns as coverage(), with level)."""
    return coverage(data, [*keys, "level"]).groupBy(*keys).agg(F.every("below").alias("below"), F.every("above").alias("above"))


def coverage_attribute(data: DataFrame, keys: list[str]) -> DataFrame:
    """keys, attribute: where the observation lies between the smallest member (0) and the largest (1), cut to -1..2."""
    low, high = F.min("y"), F.max("y")
    at = (F.max("d") - low) / F.when(high > low, high - low)
    return data.groupBy(*keys).agg(F.greatest(F.least(at, F.lit(2.0)), F.lit(-1.0)).alias("attribute"))


def mahalanobis(data: DataFrame, top: int = 10) -> DataFrame:
    """Level 1: (d - mean)^2 over the population variance of y + noise e, by datum; the `top` largest.

    data: report, datatype, member, d, y, e (noise)."""
    z = F.col("y") + F.col("e")
    score = data.groupBy("report", "datatype").agg((F.pow(F.max("d") - F.avg("y"), F.lit(2)) / F.var_pop(z)).alias("score"))
    return score.where("score is not null").orderBy(F.desc("score"), "report", "datatype").limit(top)


def mahalanobis_pairs(data: DataFrame, top: int = 10) -> DataFrame:
    """Level 2: half the quadratic form of the residuals of two data under the sample covariance of y + noise, in
    closed form; of the pairs of one report, the `top` largest."""
    one = data.withColumn("z", F.col("y") + F.col("e"))
    a, b = (one.select("report", "member", *[F.col(c).alias(f"{c}{k}") for c in ("datatype", "d", "y", "z")]) for k in "12")
    s = a.join(b, ["report", "member"]).where("datatype1 < datatype2").groupBy("report", "datatype1", "datatype2").agg(
        (F.max("d1") - F.avg("y1")).alias("r1"), (F.max("d2") - F.avg("y2")).alias("r2"), F.var_samp("z1").alias("v1"), F.var_samp("z2").alias("v2"), F.covar_samp("z1", "z2").alias("c"))
    det = F.col("v1") * F.col("v2") - F.col("c") * F.col("c")
    form = (F.col("v2") * F.col("r1") * F.col("r1") - 2 * F.col("c") * F.col("r1") * F.col("r2") + F.col("v1") * F.col("r2") * F.col("r2")) / F.when(det > 0, det)
    return s.select("report", "datatype1", "datatype2", (0.5 * form).alias("score")).where("score is not null").orderBy(F.desc("score"), "report", "datatype1", "datatype2").limit(top)


def mahalanobis_triples(data: DataFrame) -> DataFrame:
    """Level 3: the same of three data of a report, by the inverse of a symmetric 3 x 3 matrix in closed form."""
    one = data.withColumn("z", F.col("y") + F.col("e"))
    a, b, c = (one.select("report", "member", *[F.col(n).alias(f"{n}{k}") for n in ("datatype", "d", "y", "z")]) for k in "123")
    cov = {f"{i}{j}": F.covar_samp(f"z{i}", f"z{j}").alias(f"c{i}{j}") for i in "123" for j in "123" if i <= j}
    s = a.join(b, ["report", "member"]).where("datatype1 < datatype2").join(c, ["report", "member"]).where("datatype2 < datatype3").groupBy("report", "datatype1", "datatype2", "datatype3").agg(
        *[(F.max(f"d{k}") - F.avg(f"y{k}")).alias(f"r{k}") for k in "123"], *cov.values())
    m = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}")

    def cofactor(i: int, j: int) -> Column:
        p, q = [k for k in (1, 2, 3) if k != i], [k for k in (1, 2, 3) if k != j]
        return (m(p[0], q[0]) * m(p[1], q[1]) - m(p[0], q[1]) * m(p[1], q[0])) * (1 if (i + j) % 2 == 0 else -1)

    det = sum((m(1, j) * cofactor(1, j) for j in (2, 3)), m(1, 1) * cofactor(1, 1))
    form = sum((cofactor(i, j) * F.col(f"r{i}") * F.col(f"r{j}") for i in (1, 2, 3) for j in (1, 2, 3) if (i, j) != (1, 1)), cofactor(1, 1) * F.col("r1") * F.col("r1"))
    return s.select("report", "datatype1", "datatype2", "datatype3", (0.5 * form / F.when(det > 0, det)).alias("score"))


def kalman_gain(state: DataFrame, data: DataFrame, group: list[str]) -> DataFrame:
    """group, cell, report, datatype, gain of one scalar datum at a time: cov(x, y) / (var(y) + v).

    state: group, cell, member, x; data: group, report, datatype, member, y, v."""
    both = state.join(data, [*group, "member"])
    return both.groupBy(*group, "cell", "report", "datatype").agg((F.covar_samp("x", "y") / (F.var_samp("y") + F.max("v"))).alias("gain"))


def top_gains(gains: DataFrame, group: list[str], top: int = 10) -> DataFrame:
    """The data with the largest absolute gain, by its maximum over cells; top for each group."""
    each = gains.groupBy(*group, "report", "datatype").agg(F.max(F.abs("gain")).alias("max_gain"), F.avg(F.abs("gain")).alias("mean_gain"))
    order = [F.desc("max_gain"), "report", "datatype"]
    if not group:
        return each.orderBy(*order).limit(top)
    return each.withColumn("turn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("turn") <= top).drop("turn")


def update_statistics(cells: DataFrame, group: list[str]) -> DataFrame:
    """group, per cent of cells whose mean moved by over 1, 2 and 3 prior deviations, mean prior and posterior
    deviation. cells: group, cell, prior_mean, prior_std, post_mean, post_std."""
    moved = F.abs(F.col("post_mean") - F.col("prior_mean"))
    share = lambda k: (100 * F.avg(F.when(moved > k * F.col("prior_std"), 1.0).otherwise(0.0))).alias(f"over{k}")
    return cells.groupBy(*group).agg(share(1), share(2), share(3), F.avg("prior_std").alias("prior_std"), F.avg("post_std").alias("post_std"))


def update_class(cells: DataFrame) -> DataFrame:
    """cells with `change`: -3..3, how many prior deviations the mean moved past, with the direction's sign."""
    moved = (F.col("post_mean") - F.col("prior_mean")) / F.when(F.col("prior_std") > 0, F.col("prior_std"))
    size = F.when(F.abs(moved) > 3, 3).when(F.abs(moved) > 2, 2).when(F.abs(moved) > 1, 1).otherwise(0)
    return cells.withColumn("change", (F.signum(F.coalesce(moved, F.lit(0.0))) * size).cast("int"))


def split_data(sizes: DataFrame) -> DataFrame:
    """report, datatype, kind: scalar data (one value) and vectors."""
    return sizes.withColumn("kind", F.when(F.col("n") == 1, "scalar").otherwise("vector"))


def first_component(data: DataFrame, datatype: str) -> DataFrame:
    """member, y and d of a data type's values projected on the first principal component of its predictions.

    The direction comes from members x members products, so the data stay where they are: with the leading right
    vector q of the centred predictions Yc, the direction is Yc q, normalised."""
    import numpy as np

    from . import gram

    rows = data.where(F.col("datatype") == datatype).withColumn("dev", F.col("d") - F.aggregate("y", F.lit(0.0), lambda a, v: a + v) / F.size("y"))
    g = gram.products(rows, {"y": "center"}, [("y", "y")])["y", "y"]
    w, v = np.linalg.eigh(g)
    q = v[:, -1] * np.sign(v[np.abs(v[:, -1]).argmax(), -1])
    n = len(g)
    mean = F.aggregate("y", F.lit(0.0), lambda a, x: a + x) / F.size("y")
    along = F.aggregate(F.zip_with("y", F.array(*[F.lit(float(x)) for x in q]), lambda y, b: (y - mean) * b), F.lit(0.0), lambda a, x: a + x) / float((n - 1) ** 0.5 * max(w[-1], 0) ** 0.5)
    with_dir = rows.withColumn("u", along)
    each = with_dir.select("u", "d", F.posexplode("y").alias("member", "y"))
    return each.groupBy("member").agg(F.sum(F.col("u") * F.col("y")).alias("y"), F.sum(F.col("u") * F.col("d")).alias("d"))
