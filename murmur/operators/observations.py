"""Observations, their variances and their noise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import noise

#: Smallest variance of a relative error.
FLOOR = 1e-9


def organise(raw: DataFrame, scale: dict[str, float] | None = None) -> DataFrame:
    """report, datatype, comp, d from raw (the same, d a string): not available (`n/a`, empty, null) means no row."""
    text = F.lower(F.trim("d"))
    rows = raw.where(F.col("d").isNotNull() & ~text.isin("n/a", "")).withColumn("d", text.cast("double"))
    if scale:
        factor = F.create_map(*[x for k, v in scale.items() for x in (F.lit(k), F.lit(float(v)))])
        rows = rows.withColumn("d", F.col("d") * F.coalesce(F.element_at(factor, F.col("datatype")), F.lit(1.0)))
    return rows


def variance(kind: Column, value: Column, d: Column, floor: Column | None = None) -> Column:
    """`abs`: the value; `rel`: that per cent of the observation, squared, not below the floor squared, nor FLOOR."""
    relative = F.pow(value * 0.01 * d, F.lit(2))
    least = F.greatest(F.coalesce(floor * floor, F.lit(0.0)), F.lit(FLOOR)) if floor is not None else F.lit(FLOOR)
    return F.when(F.lower(kind) == "abs", value).when(F.lower(kind) == "rel", F.greatest(relative, least))


def empirical_variance(samples: DataFrame, keys: list[str], value: str = "e") -> DataFrame:
    """`emp`: the sample variance of noise samples (long)."""
    return samples.groupBy(*keys).agg(F.var_samp(value).alias("v"))


def perturbed(obs: DataFrame, members: DataFrame, seed: str = "obs") -> DataFrame:
    """obs (report, datatype, d, v) for each member, with e = d + sqrt(v) times its own noise."""
    key = F.concat_ws("|", F.lit(seed), F.col("report").cast("string"), "datatype", F.col("member").cast("string"))
    return obs.join(F.broadcast(members)).withColumn("e", F.col("d") + F.sqrt("v") * noise.normal(key))


def perturbed_matrix(obs: DataFrame, members: int, seed: str = "obs", inflate: float = 1.0) -> DataFrame:
    """obs (any keys, id: its name as a string, d, v) with e: array of the perturbed values of the members."""
    draw = F.transform(F.sequence(F.lit(0), F.lit(members - 1)), lambda m: F.col("d") + F.sqrt(F.lit(inflate) * F.col("v")) * noise.normal(F.concat_ws("|", F.lit(seed), F.col("id"), m.cast("string"))))
    return obs.withColumn("e", draw)


def correlated_noise(cov: np.ndarray, members: int, seed: int) -> np.ndarray:
    """Noise of one covariance block: its Cholesky factor times standard normals."""
    return np.linalg.cholesky(cov) @ np.random.default_rng(seed).standard_normal((len(cov), members))


def covariance_blocks(variances: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """i, j, v by report and datatype: diagonal of the variances (comp), unless full (i, j, v) has the block."""
    diagonal = variances.select("report", "datatype", F.col("comp").alias("i"), F.col("comp").alias("j"), "v")
    if full is None:
        return diagonal
    return diagonal.join(full.select("report", "datatype").distinct(), ["report", "datatype"], "left_anti").unionByName(full.select(*diagonal.columns))


def variances_of(blocks: DataFrame) -> DataFrame:
    """The inverse: the diagonals."""
    return blocks.where("i = j").select("report", "datatype", F.col("i").alias("comp"), "v")


def to_unit(df: DataFrame, value: str = "x") -> DataFrame:
    """Controls from [lb, ub] to [0, 1]; without both bounds they stay."""
    span = F.col("ub") - F.col("lb")
    return df.withColumn(value, F.coalesce((F.col(value) - F.col("lb")) / span, F.col(value)))


def from_unit(df: DataFrame, value: str = "x") -> DataFrame:
    span = F.col("ub") - F.col("lb")
    return df.withColumn(value, F.coalesce(F.col("lb") + F.col(value) * span, F.col(value)))


def expand_models(controls: DataFrame, models: int) -> DataFrame:
    """Each sample for each of several models, numbered together."""
    each = controls.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    return each.withColumn("member", F.col("member") * models + F.col("model"))
