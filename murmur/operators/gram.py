"""Ensemble updates by Gram matrices.

Whatever the numbers of parameters and data, an unlocalized update needs only members x members matrices: they are
summed over the data's rows where these are, solved on the driver, and the resulting weights broadcast to the
parameters' rows. Neither side is shuffled.

With fewer data than members these matrices have at most the data's rank. They are then never formed: the driver takes
the data's rows themselves, and weights are products of members x rank matrices. Memory and work so grow with the smaller
of the two numbers times the members, not with the members squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import energy_rank


def _rows(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float) if n else np.zeros((0, 0))


def projected(a: np.ndarray) -> np.ndarray:
    """Deviations from the members' mean over sqrt(members - 1)."""
    return (a - a.mean(1, keepdims=True)) / np.sqrt(a.shape[1] - 1)


def _summed(parts: DataFrame) -> np.ndarray | None:
    """The sum of one flat array a partition, added up on the executors in two steps, so that the driver receives
    about the square root of the partitions' number."""
    width = max(1, int(parts.rdd.getNumPartitions() ** 0.5))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch.column(0)):
                rows = _rows(batch.column(0)).sum(0)
                total = rows if total is None else total + rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["flat"])

    rows = parts.repartition(width).mapInArrow(add, "flat array<double>").toArrow()["flat"].to_pylist()
    return np.sum(rows, axis=0) if rows else None


def products(rows: DataFrame, columns: dict[str, str], pairs: list[tuple[str, str]]) -> dict[tuple[str, str], np.ndarray]:
    """For arrays of members in each row, sums over rows of their outer products.

    columns: name to kind, `center` (projected first) or `plain`; an optional column `v` whitens: every row is divided
    by its square root. Returns a members x members matrix for each pair of names."""
    names = list(columns)
    white = "v" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            by = {}
            for i, n in enumerate(names):
                a = _rows(batch.column(i))
                a = projected(a) if columns[n] == "center" else a
                by[n] = a / np.sqrt(batch.column(len(names)).to_numpy(zero_copy_only=False))[:, None] if white else a
            flat = np.concatenate([(by[p].T @ by[q]).ravel() for p, q in pairs])
            total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["flat"])

    flat = _summed(rows.select(*names, *(["v"] if white else [])).mapInArrow(run, "flat array<double>"))
    if flat is None:
        raise ValueError("no rows to sum over")
    ne = int(round((len(flat) / len(pairs)) ** 0.5))
    return {p: flat[i * ne * ne : (i + 1) * ne * ne].reshape(ne, ne) for i, p in enumerate(pairs)}


def whiten_blocks(rows: DataFrame, blocks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows whitened by full covariance blocks: every array column is solved with the block's Cholesky factor.

    rows: keys, i, arrays; blocks: keys, i, j, v. A block is a group of one measurement, and so in one task."""
    cov = blocks.groupBy(*keys).agg(F.collect_list(F.struct("i", "j", "v")).alias("__cov"))
    schema = rows.select(*keys, "i", *columns).schema

    def solve(table: pa.Table) -> pa.Table:
        frame = table.sort_by("i").to_pandas()
        at = {i: k for k, i in enumerate(frame["i"])}
        c = np.zeros((len(frame), len(frame)))
        for cell in frame["__cov"].iloc[0]:
            if cell["i"] in at and cell["j"] in at:
                c[at[cell["i"]], at[cell["j"]]] = cell["v"]
        low = np.linalg.cholesky(c)
        for n in columns:
            frame[n] = list(np.linalg.solve(low, np.stack(frame[n].to_numpy())))
        return pa.Table.from_pandas(frame[[*keys, "i", *columns]], preserve_index=False)

    return rows.select(*keys, "i", *columns).join(cov, keys).groupBy(*keys).applyInArrow(solve, schema)


def transformed(state: DataFrame, weights: Weights, kind: str = "step", value: str = "x", base: str | None = None) -> DataFrame:
    """The parameters after an update by members x members weights W.

    `step`: x + projected(x) W; `prior`: base (I + W / sqrt(members - 1)); `mean`: the mean of base and its deviations
    times W; `plain`: base W."""
    shared = state.sparkSession.sparkContext.broadcast(weights)
    base = base or value
    at, of = state.columns.index(value), state.columns.index(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, b = _rows(batch.column(at)), _rows(batch.column(of))
            if kind == "step":
                new = x + projected(x) @ w
            elif kind == "prior":
                new = b + b @ w / np.sqrt(len(w) - 1)
            elif kind == "mean":
                mean = b.mean(1, keepdims=True)
                new = mean + (b - mean) @ w
            else:
                new = b @ w
            offsets = np.arange(0, new.size + 1, new.shape[1], dtype=np.int32)
            yield batch.set_column(at, value, pa.ListArray.from_arrays(pa.array(offsets), pa.array(new.ravel())))

    return state.mapInArrow(run, state.schema)


# -- weights --------------------------------------------------------------------------------------------------------


class LowRank:
    """A members x members matrix base I + left right, of members x rank and rank x members."""

    __array_ufunc__ = None  # so that array @ LowRank comes to __rmatmul__

    def __init__(self, base: float, left: np.ndarray, right: np.ndarray) -> None:
        if left.shape[1] > len(left):
            left, r = np.linalg.qr(left)
            right = r @ right
        self.base, self.left, self.right = base, left, right

    @classmethod
    def unit(cls, members: int, base: float) -> LowRank:
        return cls(base, np.zeros((members, 0)), np.zeros((0, members)))

    def __len__(self) -> int:
        return len(self.left)

    def __rmatmul__(self, x: np.ndarray) -> np.ndarray:
        return self.base * x + (x @ self.left) @ self.right

    def __rmul__(self, factor: float) -> LowRank:
        return LowRank(factor * self.base, self.left, factor * self.right)

    def dense(self) -> np.ndarray:
        return self.base * np.eye(len(self)) + self.left @ self.right


Weights = np.ndarray | LowRank


def _dense(w: Weights) -> np.ndarray:
    return w.dense() if isinstance(w, LowRank) else w


def _about(w: Weights, base: float) -> tuple[np.ndarray, np.ndarray]:
    """left, right with w = base I + left right."""
    if isinstance(w, LowRank) and w.base == base:
        return w.left, w.right
    eye = np.eye(len(w))
    return _dense(w) - base * eye, eye


def _spectral(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The singular value decomposition without null directions."""
    u, s, vt = np.linalg.svd(y, full_matrices=False)
    keep = s**2 > s[0] ** 2 * 1e-14
    return u[:, keep], s[keep], vt[keep].T


@dataclass
class Grams:
    """G = Yc' Yc and H = Yc' R of whitened, projected predictions Yc and residuals R = E - Y; the rest for the
    flavours that need it: YY, YR of predictions centred but not scaled."""

    g: np.ndarray
    h: np.ndarray

    @property
    def members(self) -> int:
        return len(self.g)

    def spectrum(self) -> tuple[np.ndarray, np.ndarray]:
        """Singular values of Yc, falling, without null directions, and their right vectors."""
        w, v = np.linalg.eigh((self.g + self.g.T) / 2)
        w, v = w[::-1], v[:, ::-1]
        keep = w > max(w[0], 0) * 1e-14
        return np.sqrt(w[keep]), v[:, keep]

    def leading(self, energy: float, rule: str = "below") -> tuple[np.ndarray, np.ndarray]:
        """The part of spectrum() that holds the energy."""
        s, v = self.spectrum()
        k = len(s) if energy >= 1 else energy_rank(s, energy, rule)
        return s[:k], v[:, :k]

    def toward(self, v: np.ndarray) -> np.ndarray:
        """V' H."""
        return v.T @ self.h

    def weights(self, left: np.ndarray, v: np.ndarray) -> Weights:
        """left V' H."""
        return left @ self.toward(v)

    def solved(self, alpha: float) -> Weights:
        """(alpha I + G)^-1 H."""
        return np.linalg.solve(alpha * np.eye(self.members) + self.g, self.h)


class FewData(Grams):
    """The same of fewer data than members, kept as the data's rows: Yc and R."""

    def __init__(self, y: np.ndarray, r: np.ndarray) -> None:
        self.y, self.r = y, r

    g = property(lambda self: self.y.T @ self.y)
    h = property(lambda self: self.y.T @ self.r)

    @property
    def members(self) -> int:
        return self.y.shape[1]

    def spectrum(self) -> tuple[np.ndarray, np.ndarray]:
        return _spectral(self.y)[1:]

    def toward(self, v: np.ndarray) -> np.ndarray:
        return (self.y @ v).T @ self.r

    def weights(self, left: np.ndarray, v: np.ndarray) -> Weights:
        return LowRank(0.0, left, self.toward(v))

    def solved(self, alpha: float) -> Weights:
        return LowRank(0.0, self.y.T, np.linalg.solve(alpha * np.eye(len(self.y)) + self.y @ self.y.T, self.r))


def member_misfit(data: DataFrame) -> np.ndarray:
    """Each member's sum of squares of e - y over v, from rows with arrays e and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                r = _rows(batch.column(0)) - _rows(batch.column(1))
                part = (r * r / batch.column(2).to_numpy(zero_copy_only=False)[:, None]).sum(0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["flat"])

    return _summed(data.select("e", "y", "v").mapInArrow(run, "flat array<double>"))


def data_grams(data: DataFrame, kind: str = "center") -> Grams:
    """From rows with arrays y and e (or their difference r) and, unless they are whitened, the variance v. kind: as in
    products(), of y."""
    rows = data if "r" in data.columns else data.withColumn("r", F.zip_with("e", "y", lambda e, y: e - y))
    count, members = rows.agg(F.count("*"), F.max(F.size("y"))).first()
    if not count or count >= members:
        p = products(rows, {"y": kind, "r": "plain"}, [("y", "y"), ("y", "r")])
        return Grams(p["y", "y"], p["y", "r"])
    table = rows.select("y", "r", *(["v"] if "v" in rows.columns else [])).toArrow()
    y, r = (_rows(table[c].combine_chunks()) for c in ("y", "r"))
    sd = np.sqrt(table["v"].to_numpy())[:, None] if "v" in rows.columns else 1.0
    return FewData((projected(y) if kind == "center" else y) / sd, r / sd)


#: Members in a block of gram_rows().
BLOCK = 1024


def gram_rows(data: DataFrame, members: int) -> DataFrame:
    """i, j, g: G of Grams as a row for each pair of members, made where it is written.

    Every datum's row is cut into blocks of BLOCK members; a group is the data of a pair of blocks, so a task holds BLOCK
    columns twice and BLOCK squared results, whatever the number of members."""
    white = "v" in data.columns
    blocks = -(-members // BLOCK)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = projected(_rows(batch.column(0)))
            y = y / np.sqrt(batch.column(1).to_numpy(zero_copy_only=False))[:, None] if white else y
            for row in y:
                parts = [row[k * BLOCK : (k + 1) * BLOCK] for k in range(blocks)]
                for a in range(blocks):
                    columns = [pa.array([a] * blocks, pa.int32()), pa.array(range(blocks), pa.int32()), pa.array([parts[a]] * blocks, pa.list_(pa.float64())), pa.array(parts, pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "left", "right"])

    def multiply(table: pa.Table) -> pa.Table:
        left, right = (_rows(table[c].combine_chunks()) for c in ("left", "right"))
        a, b = (table[c][0].as_py() * BLOCK for c in ("a", "b"))
        g = left.T @ right
        i, j = np.arange(a, a + len(g), dtype=np.int32), np.arange(b, b + g.shape[1], dtype=np.int32)
        return pa.table({"i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "g": g.ravel()})

    cut = data.select("y", *(["v"] if white else [])).mapInArrow(split, "a int, b int, left array<double>, right array<double>")
    # the number of parts is given, as they are small before they are multiplied and would be put into one
    return cut.repartition(min(1000, blocks * blocks), "a", "b").groupBy("a", "b").applyInArrow(multiply, "i int, j int, g double")


def approx_weights(m: Grams, lam: float, energy: float = 1.0, rule: str = "below") -> Weights:
    """V (lam + 1 + s^2)^-1 V' H over the leading singular directions."""
    s, v = m.leading(energy, rule)
    return m.weights(v / (lam + 1 + s**2), v)


def full_weights(m: Grams, lam: float, prior_gram: np.ndarray, cross_gram: np.ndarray, moved_gram: np.ndarray, energy: float = 1.0) -> np.ndarray:
    """approx_weights() and the pull of the prior, for parameters scaled by their prior deviations.

    prior_gram = D0' D0 of the projected prior D0, cross_gram = Xc' D0 with the projected present state Xc, moved_gram
    = D0' (X - X0); the prior's inverse covariance is the pseudo-inverse of D0 D0'."""
    step = _dense(approx_weights(m, lam, energy))
    w, u = np.linalg.eigh((prior_gram + prior_gram.T) / 2)
    keep = w > w[-1] * 1e-12
    w, u = w[keep], u[:, keep]
    pull = cross_gram @ (u / w**2) @ (u.T @ moved_gram)  # Xc' (D0 D0')^+ (X - X0)
    s, v = m.leading(energy)
    return step - (v / (lam + 1 + s**2)) @ (v.T @ pull)


def subspace_weights(m: Grams, w: Weights, lam: float) -> Weights:
    """The new W of the ensemble subspace scheme: predictions are regressed on the present anomalies, directions
    without data are dropped. Posterior: base (I + W / sqrt(members - 1))."""
    ne = m.members
    if isinstance(m, FewData):
        a, b = _about(w, 0.0)
        bc = b - b.mean(1, keepdims=True)
        sens = m.y - (m.y @ a) @ np.linalg.solve(np.sqrt(ne - 1) * np.eye(len(b)) + bc @ a, bc)  # Y (I + W / sqrt)^-1
        u, s, v = _spectral(sens)
        wanted = (s / (1 + s**2))[:, None] * (u.T @ ((sens @ a) @ b + m.r))
        return LowRank(0.0, np.hstack([a, v]), np.vstack([b * (lam / (1 + lam)), wanted / (1 + lam)]))
    w = _dense(w)
    centred = np.eye(ne) - np.ones((ne, ne)) / ne
    omega = np.eye(ne) + (w @ centred) / np.sqrt(ne - 1)
    inv = np.linalg.inv(omega)
    g, h = inv.T @ m.g @ inv, inv.T @ m.h
    s2, v = np.linalg.eigh((g + g.T) / 2)
    keep = s2 > max(s2[-1], 0) * 1e-14
    s2, v = s2[keep], v[:, keep]
    wanted = (v / (1 + s2)) @ (v.T @ (g @ w + h))  # S' (S S' + I)^-1 (S W + E - Y)
    return w - (w - wanted) / (1 + lam)


def subspace2_weights(m: Grams, w: Weights, lam: float) -> Weights:
    """The new transform of the Gauss-Newton scheme in ensemble space; begins at the identity. Posterior: mean of the
    base and its deviations times the transform."""
    ne = m.members
    scale = np.sqrt(ne - 1.0)
    if isinstance(m, FewData):
        a, b = _about(w, 1.0)
        sens = m.y - (m.y @ a) @ (np.linalg.pinv(np.eye(len(b)) + b @ a) @ b)  # Y w^-1
        wanted = np.linalg.solve(sens @ sens.T + np.eye(len(sens)), (sens @ a) @ b + m.r / scale)
        return LowRank(1.0, np.hstack([a, sens.T]), np.vstack([b * (lam / (1 + lam)), wanted / (1 + lam)]))
    w = _dense(w)
    inv = np.linalg.pinv(w)
    y = inv.T @ (m.g * (ne - 1)) @ inv  # of the predictions' sensitivities
    grad = (ne - 1) * (np.eye(ne) - w) + inv.T @ (m.h * scale)
    return w + np.linalg.solve(y + (ne - 1) * np.eye(ne), grad) / (1 + lam)


def marginal_ratio(data: DataFrame, nu: float = 1.0) -> DataFrame:
    """data with v for noise of unknown size marginalised out: an inverse-gamma prior of nu degrees about v gives each
    datum the effective variance (chi + nu v) / (members + nu), chi being its members' squared residuals summed."""
    chi = F.aggregate(F.zip_with("e", "y", lambda e, y: (e - y) * (e - y)), F.lit(0.0), lambda a, r: a + r)
    return data.withColumn("v", (chi + nu * F.col("v")) / (F.size("y") + nu))


def hybrid_weights(levels: dict[int, Grams], level_weights: list[float], lam: float, energy: float = 1.0) -> dict[int, Weights]:
    """Each level's weights, times the level's own weight: the multilevel step is their sum over levels."""
    return {k: level_weights[k] * approx_weights(m, lam, energy) for k, m in levels.items()}


def rlmmac_weights(m: Grams, lam: float, localized: bool = False, energy: float = 1.0) -> Weights:
    """Regularised Levenberg-Marquardt of minimum average cost: the damping is lam times the mean squared singular
    value, or as in approx_weights() without localization."""
    s, v = m.leading(energy, "upto")
    return m.weights(v / ((lam * float(np.mean(s**2)) if localized else lam + 1) + s**2), v)


# -- gains, for few data ----------------------------------------------------------------------------------------------


def kalman_gain(c_xy: np.ndarray, c_yy: np.ndarray, c_d: np.ndarray, cholesky: bool = False) -> np.ndarray:
    c = c_yy + c_d
    if cholesky:
        low = np.linalg.cholesky(c)
        return np.linalg.solve(low.T, np.linalg.solve(low, c_xy.T)).T
    return np.linalg.solve(c, c_xy.T).T


def subspace_gain(x: np.ndarray, y: np.ndarray, c_d: np.ndarray, energy: float = 1.0) -> np.ndarray:
    """The gain with the data covariance projected on the predictions' leading left singular vectors."""
    from .statistics import truncated_svd

    u, s, vt = truncated_svd(projected(y), energy, "upto")
    inner = np.diag(s**2) + u.T @ c_d @ u
    return projected(x) @ (vt.T * s) @ np.linalg.solve(inner, u.T)


def innovations(y: np.ndarray, c_d: np.ndarray, r: np.ndarray) -> np.ndarray:
    """(Yc Yc' + C_d)^-1 R."""
    yc = projected(y)
    return np.linalg.solve(yc @ yc.T + c_d, r)


def kalman_update(x: np.ndarray, gain: np.ndarray, d: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x + gain @ (d - y)
