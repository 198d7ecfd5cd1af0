"""Prior ensembles and what the configuration says about them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Prior:
    """One parameter: a mean (value or array by cell), variance, and for a spatial one the grid and the variogram.
    Values given for a single layer hold for all."""

    name: str
    mean: float | tuple[float, ...] = 0.0
    variance: tuple[float, ...] = (1.0,)
    grid: tuple[int, int, int] = (0, 0, 1)
    vario: tuple[str, ...] = ("",)
    length: tuple[float, ...] = (1.0,)
    aniso: tuple[float, ...] = (1.0,)
    angle: tuple[float, ...] = (0.0,)
    limits: tuple[float | None, float | None] = (None, None)
    cells: int = 1

    @property
    def layers(self) -> int:
        return max(1, self.grid[2])

    @property
    def layer_cells(self) -> int:
        return self.grid[0] * self.grid[1] or self.cells

    def of_layer(self, values: tuple, layer: int):
        return values[layer] if len(values) > 1 else values[0]

    def layer_mean(self, layer: int) -> np.ndarray:
        n = self.layer_cells
        mean = np.atleast_1d(np.asarray(self.mean, float))
        if len(mean) == 1:
            return np.full(n, mean[0])
        if len(mean) == n:
            return mean
        return mean[layer * n : (layer + 1) * n]


def prior_of(name: str, options: dict) -> Prior:
    """From the keys of a configuration: vario, mean, var, range, aniso, angle, grid, limits."""
    many = lambda x, kind=float: tuple(kind(v) for v in x) if isinstance(x, (list, tuple, np.ndarray)) else (kind(x),)
    mean = options.get("mean", 0.0)
    if isinstance(mean, str):
        mean = load_array(mean)
    mean = tuple(np.ravel(mean).tolist()) if np.ndim(mean) else float(mean)
    grid = tuple(int(v) for v in many(options.get("grid", (0, 0, 1)), float))
    return Prior(
        name, mean, many(options.get("var", 1.0)), (*grid, 1)[:3] if len(grid) == 2 else grid, many(options.get("vario", ""), str), many(options.get("range", 1.0)),
        many(options.get("aniso", 1.0)), many(options.get("angle", 0.0)), tuple(options.get("limits", (None, None))), len(mean) if isinstance(mean, tuple) else 1,
    )


def load_array(path: str, name: str | None = None) -> np.ndarray:
    """An array of a .npz, .npy or .csv file; nothing is unpickled."""
    if path.endswith(".csv"):
        return np.loadtxt(path, delimiter=",")
    got = np.load(path, allow_pickle=False)
    return got if isinstance(got, np.ndarray) else got[name or got.files[0]]


def variogram_covariance(nx: int, ny: int, variance: float, length: float, aniso: float, angle: float, kind: str) -> np.ndarray:
    """Covariance of the cells of an nx x ny layer (x runs fastest): spherical, exponential or gaussian, reaching
    about zero at the length along the angle (degrees), and at aniso times it across."""
    x, y = np.meshgrid(np.arange(nx), np.arange(ny))
    dx, dy = (np.subtract.outer(v.ravel(), v.ravel()).astype(float) for v in (x, y))
    t = np.deg2rad(angle)
    along, across = dx * np.cos(t) + dy * np.sin(t), -dx * np.sin(t) + dy * np.cos(t)
    h = np.hypot(along, across / aniso) / length
    if kind.lower().startswith("sph"):
        rho = np.where(h < 1, 1 - 1.5 * h + 0.5 * h**3, 0.0)
    elif kind.lower().startswith("exp"):
        rho = np.exp(-3 * h)
    elif kind.lower().startswith("gau"):
        rho = np.exp(-3 * h * h)
    else:
        raise ValueError(f"no variogram {kind}")
    return variance * rho


def sample(spark: SparkSession, priors: list[Prior], members: int, seed: int = 0) -> DataFrame:
    """param, cell, x (array of members): a task for each parameter and layer, each with a seed of its own, so that a
    lost task gives the same draws again."""
    tasks = [(k, layer) for k, p in enumerate(priors) for layer in range(p.layers)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, layer in zip(frame["prior"], frame["layer"], strict=True):
                p = priors[k]
                rng = np.random.default_rng([seed, k, layer])
                n, var = p.layer_cells, p.of_layer(p.variance, layer)
                z = rng.standard_normal((n, members))
                kind = p.of_layer(p.vario, layer)
                if kind:
                    cov = variogram_covariance(p.grid[0], p.grid[1], var, p.of_layer(p.length, layer), p.of_layer(p.aniso, layer), p.of_layer(p.angle, layer), kind)
                    z = np.linalg.cholesky(cov + 1e-10 * var * np.eye(n)) @ z
                else:
                    z *= np.sqrt(var)
                x = p.layer_mean(layer)[:, None] + z
                low, high = p.limits
                if low is not None or high is not None:
                    x = np.clip(x, low, high)
                yield pd.DataFrame({"param": p.name, "cell": np.arange(layer * n, (layer + 1) * n, dtype=np.int32), "x": list(x)})

    return spark.createDataFrame(tasks, "prior int, layer int").repartition(max(1, len(tasks))).mapInPandas(run, "param string, cell int, x array<double>")


def scaling(state: DataFrame, priors: list[Prior]) -> DataFrame:
    """state with `std`, each parameter's and layer's prior standard deviation."""
    rows = [(p.name, layer, float(np.sqrt(p.of_layer(p.variance, layer))), p.layer_cells) for p in priors for layer in range(p.layers)]
    table = state.sparkSession.createDataFrame(rows, "param string, layer int, std double, n int")
    from pyspark.sql import functions as F

    sizes = F.broadcast(table.groupBy("param").agg(F.first("n").alias("n")))
    layered = state.join(sizes, "param").withColumn("layer", F.floor(F.col("cell") / F.col("n")).cast("int")).drop("n")
    return layered.join(F.broadcast(table.drop("n")), ["param", "layer"]).drop("layer")


@dataclass(frozen=True)
class Levels:
    """Fidelity levels: members of each, and weights that sum to 1."""

    members: tuple[int, ...]
    weights: tuple[float, ...] = field(default=())

    def __post_init__(self) -> None:
        w = np.asarray(self.weights or [1.0] * len(self.members), float)
        object.__setattr__(self, "weights", tuple((w / w.sum()).tolist()))


def initial_controls(mean, var, limits: tuple[float | None, float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Controls and their variances: the mean within the limits; var a number, or per cent of the range as "10%"
    (of its standard deviation)."""
    x = np.atleast_1d(np.asarray(load_array(mean) if isinstance(mean, str) else mean, float))
    low, high = limits
    if low is not None or high is not None:
        x = np.clip(x, low, high)
    if isinstance(var, str) and var.strip().endswith("%"):
        if low is None or high is None:
            raise ValueError("a variance in per cent needs both limits")
        var = (float(var.strip()[:-1]) / 100 * (high - low)) ** 2
    return x, np.broadcast_to(np.asarray(var, float), x.shape).copy()


def inflation(steps: int, given: list[float] | None = None) -> list[float]:
    """Inflation factors of the data covariance; their inverses sum to 1."""
    alphas = [float(steps)] * steps if given is None else [float(a) for a in given]
    if len(alphas) != steps or abs(sum(1 / a for a in alphas) - 1) > 1e-9:
        raise ValueError("the inverse inflation factors must number the steps and sum to 1")
    return alphas


def geometric_inflation(spectrum: np.ndarray, steps: int, energy: float = 1.0) -> list[float]:
    """Factors that fall by a constant ratio, the first the mean square of the whitened predictions' leading singular
    values: the ratio solves sum of inverses = 1."""
    from .statistics import energy_rank

    s = np.sort(np.asarray(spectrum, float))[::-1]
    first = max(float(np.mean(s[: energy_rank(s, energy, "reach")]) ** 2), float(steps))
    # (1 / first) * (1 + q + ... + q^(steps - 1)) = 1 with q >= 1 the ratio of inverses
    roots = np.roots([*([1.0] * (steps - 1)), 1.0 - first])
    real = roots[(abs(roots.imag) < 1e-9) & (roots.real >= 1 - 1e-9)].real
    q = float(real.min()) if len(real) else 1.0
    return [first / q**i for i in range(steps)]


def max_iterations(options: dict, default: int = 10) -> int:
    found = dict(options.get("iteration", options.get("mda", [])) or [])
    return int(found.get("max_iter", found.get("tot_assim_steps", options.get("maxiter", default))))
