"""Sparse representation of spatial data by wavelets."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Low-pass filters. The Haar and the four-tap Daubechies wavelet.
FILTERS = {
    "haar": np.array([1.0, 1.0]) / np.sqrt(2),
    "db2": np.array([1 + np.sqrt(3), 3 + np.sqrt(3), 3 - np.sqrt(3), 1 - np.sqrt(3)]) / (4 * np.sqrt(2)),
}


def _split(a: np.ndarray, axis: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level along an axis: the signal, mirrored at both ends, filtered and every second value kept."""
    a = np.moveaxis(a, axis, -1)
    n, k = a.shape[-1], len(low)
    high = low[::-1] * (-1.0) ** np.arange(k)
    at = np.arange(2 - k, n + k - 1)
    period = np.mod(at, 2 * n)
    mirror = np.where(period < n, period, 2 * n - 1 - period)
    wide = a[..., mirror]
    count = (n + k - 1) // 2
    starts = 2 * np.arange(count) + (k % 2)
    taps = starts[:, None] + np.arange(k)
    windows = wide[..., np.minimum(taps, wide.shape[-1] - 1)]
    parts = [np.moveaxis(windows @ f, -1, axis) for f in (low, high)]
    return parts[0], parts[1]


def _join(lo: np.ndarray, hi: np.ndarray, axis: int, low: np.ndarray, n: int) -> np.ndarray:
    lo, hi = np.moveaxis(lo, axis, -1), np.moveaxis(hi, axis, -1)
    k = len(low)
    high = low[::-1] * (-1.0) ** np.arange(k)
    count = lo.shape[-1]
    out = np.zeros((*lo.shape[:-1], 2 * count + k))
    for t in range(k):
        out[..., t : t + 2 * count : 2] += lo * low[t] + hi * high[t]
    return np.moveaxis(out[..., k - 2 : k - 2 + n], -1, axis)


def decompose(a: np.ndarray, levels: int, wavelet: str = "haar") -> tuple[np.ndarray, list[dict[str, np.ndarray]], list[tuple[int, ...]]]:
    """The approximation, the subbands of each level (coarsest first; a name like `da` says detail in the first axis)
    and the shapes that were split."""
    low, details, shapes = FILTERS[wavelet], [], []
    a = np.asarray(a, float)
    for _ in range(levels):
        shapes.append(a.shape)
        parts = {"": a}
        for axis in range(a.ndim):
            parts = {k + n: half for k, v in parts.items() for n, half in zip("ad", _split(v, axis, low), strict=True)}
        a = parts.pop("a" * a.ndim)
        details.append(parts)
    return a, details[::-1], shapes[::-1]


def reconstruct(a: np.ndarray, details: list[dict[str, np.ndarray]], shapes: list[tuple[int, ...]], wavelet: str = "haar") -> np.ndarray:
    low = FILTERS[wavelet]
    for parts, shape in zip(details, shapes, strict=True):
        parts = {"a" * a.ndim: a, **parts}
        for axis in range(a.ndim - 1, -1, -1):
            names = {"".join(x) for x in product("ad", repeat=axis)}
            parts = {k: _join(parts[k + "a"], parts[k + "d"], axis, low, shape[axis]) for k in names}
        a = parts[""]
    return a


def threshold_value(sigma: float, n: int, rule: str, values: np.ndarray | None = None, times: float = 1.0) -> float:
    """`universal`: sqrt(2 ln n) sigma; `bayesian`: sigma^2 over the signal's deviation."""
    if rule == "universal":
        return times * float(np.sqrt(2 * np.log(max(n, 2)))) * sigma
    if rule == "bayesian":
        signal = float(np.sqrt(abs(np.var(values) - sigma**2)))
        return times * (sigma**2 / signal if signal > 0 else float(np.abs(values).max()))
    raise ValueError(f"no threshold rule {rule}")


def noise_level(values: np.ndarray, least: float = 0.0) -> float:
    return max(least, float(np.median(np.abs(values))) / 0.6745)


def shrunk(values: np.ndarray, limit: float, soft: bool = False) -> np.ndarray:
    return np.sign(values) * np.maximum(np.abs(values) - limit, 0) if soft else np.where(np.abs(values) >= limit, values, 0.0)


@dataclass
class Sparse:
    """The leading coefficients of one kind of data, by the union of what each call found to lead."""

    shape: tuple[int, ...]
    levels: int
    wavelet: str = "haar"
    rule: str = "universal"
    colored: bool = True
    soft: bool = False
    times: float = 1.0
    least_noise: float = 0.0
    leading: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    noise: np.ndarray | None = None

    def _flat(self, data: np.ndarray, mask: np.ndarray | None):
        full = np.zeros(int(np.prod(self.shape)))
        full[slice(None) if mask is None else np.flatnonzero(mask)] = data
        a, details, shapes = decompose(full.reshape(self.shape), self.levels, self.wavelet)
        parts = [("", a), *((f"{i}{k}", v) for i, d in enumerate(details) for k, v in sorted(d.items()))]
        return parts, shapes

    def learn(self, data: np.ndarray, mask: np.ndarray | None = None) -> None:
        """Estimates the noise and adds the coefficients above the threshold; the approximation always leads."""
        parts, _ = self._flat(data, mask)
        finest = f"{self.levels - 1}" + "d" * len(self.shape)
        white = noise_level(dict(parts)[finest].ravel(), self.least_noise)
        keep, noise, at = [], [], 0
        for name, v in parts:
            flat = v.ravel()
            sigma = white if not self.colored or not name else noise_level(flat, self.least_noise)
            if not name:
                keep.append(np.arange(len(flat)) + at)
            else:
                limit = threshold_value(sigma, len(flat), self.rule, flat, self.times)
                keep.append(np.flatnonzero(shrunk(flat, limit, self.soft)) + at)
            noise.append(np.full(len(flat), sigma))
            at += len(flat)
        self.leading = np.union1d(self.leading, np.concatenate(keep)).astype(np.int64)
        self.noise = np.concatenate(noise)

    def compress(self, data: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        parts, _ = self._flat(data, mask)
        return np.concatenate([v.ravel() for _, v in parts])[self.leading]

    def variances(self) -> np.ndarray:
        return self.noise[self.leading] ** 2

    def restore(self, values: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        parts, shapes = self._flat(np.zeros(int(np.prod(self.shape)) if mask is None else int(np.sum(mask))), mask)
        flat = np.zeros(sum(v.size for _, v in parts))
        flat[self.leading] = values
        at, arrays = 0, {}
        for name, v in parts:
            arrays[name] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        details = [{k[len(str(i)) :]: v for k, v in arrays.items() if k and k[: len(str(i))] == str(i)} for i in range(self.levels)]
        out = reconstruct(arrays[""], details, shapes, self.wavelet)
        return out.ravel() if mask is None else out.ravel()[np.flatnonzero(mask)]

    def compress_members(self, pred: DataFrame, keys: list[str]) -> DataFrame:
        """keys, idx, y (arrays of members) of the leading coefficients, from keys, comp, y (arrays); a task for each
        key, which is one measured field."""
        import pandas as pd

        me = self

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            y = np.stack(frame.sort_values("comp")["y"].to_numpy())
            c = np.stack([me.compress(y[:, m]) for m in range(y.shape[1])], 1)
            out = pd.DataFrame({"idx": me.leading.astype(np.int32), "y": list(c)})
            for k in keys:
                out[k] = frame[k].iloc[0]
            return out[[*keys, "idx", "y"]]

        names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pred.select(*keys).schema)
        return pred.groupBy(*keys).applyInPandas(run, f"{names}, idx int, y array<double>")


# -- thresholds over tables -----------------------------------------------------------------------------------------


def noise_by_subband(coefficients: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """keys, sigma, n: median absolute coefficient over 0.6745."""
    return coefficients.groupBy(*keys).agg(F.greatest(F.median(F.abs("c")) / 0.6745, F.lit(float(least))).alias("sigma"), F.count("c").alias("n"))


def universal(sigma: Column, n: Column) -> Column:
    return F.sqrt(2 * F.ln(n.cast("double"))) * sigma


def thresholded(coefficients: DataFrame, keys: list[str], least: float = 0.0, soft: bool = False) -> DataFrame:
    limits = noise_by_subband(coefficients, keys, least).withColumn("limit", universal(F.col("sigma"), F.col("n")))
    size = F.abs("c")
    new = F.when(size < F.col("limit"), 0.0).otherwise(F.signum("c") * (size - F.col("limit")) if soft else F.col("c"))
    return coefficients.join(limits, keys).withColumn("kept", new)
