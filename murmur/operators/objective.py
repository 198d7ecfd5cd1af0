"""Objectives, and derivatives estimated from ensembles, as aggregations of long rows.

Controls: member, i, x; values: member, f."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quadratic(controls: DataFrame) -> DataFrame:
    """member, f: half the squared distance from ones."""
    return controls.groupBy("member").agg(F.sum(0.5 * (F.col("x") - 1) * (F.col("x") - 1)).alias("f"))


def rosenbrock(controls: DataFrame) -> DataFrame:
    after = F.lead("x").over(W.partitionBy("member").orderBy("i"))
    one = controls.withColumn("after", after).where("after is not null")
    gap = F.col("after") - F.col("x") * F.col("x")
    return one.groupBy("member").agg(F.sum(100 * gap * gap + (1 - F.col("x")) * (1 - F.col("x"))).alias("f"))


def exterior_penalty(constraints: DataFrame, r: float) -> DataFrame:
    """member, f: r/2 of the squares of equalities c (kind `eq`) and of what inequalities c >= 0 (kind `iq`) lack."""
    short = F.greatest(-F.col("c"), F.lit(0.0))
    return constraints.groupBy("member").agg((r / 2 * F.sum(F.when(F.col("kind") == "eq", F.col("c") * F.col("c")).otherwise(short * short))).alias("f"))


def gradient(controls: DataFrame, values: DataFrame, group: list[str] | None = None) -> DataFrame:
    """i, g: mean over members of (f - mean f)(x - mean x), the ensemble gradient times the sampling covariance."""
    keys = [*(group or []), "i"]
    both = controls.join(values, [*(group or []), "member"])
    return both.groupBy(*keys).agg(F.covar_pop("f", "x").alias("g"))


def hessian(controls: DataFrame, values: DataFrame, cov: DataFrame) -> DataFrame:
    """i, j, h: mean of (f - mean f)((x - mean x)(x - mean x)' - C); cov: i, j, c."""
    means = controls.groupBy("i").agg(F.avg("x").alias("m"))
    dev = controls.join(F.broadcast(means), "i").select("member", "i", (F.col("x") - F.col("m")).alias("dx"))
    df = values.join(values.agg(F.avg("f").alias("fm"))).select("member", (F.col("f") - F.col("fm")).alias("df"))
    a = dev.join(df, "member")
    b = dev.select("member", F.col("i").alias("j"), F.col("dx").alias("dy"))
    s = a.join(b, "member").groupBy("i", "j").agg(F.avg(F.col("df") * F.col("dx") * F.col("dy")).alias("h"), F.avg("df").alias("d"))
    return s.join(cov, ["i", "j"], "left").select("i", "j", (F.col("h") - F.col("d") * F.coalesce("c", F.lit(0.0))).alias("h"))


def level_gradient(gradients: DataFrame, weights: list[float]) -> DataFrame:
    """i, g of level, i, g, the levels weighed."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("level") + 1)
    return gradients.groupBy("i").agg(F.sum(w * F.col("g")).alias("g"))


def smc_weights(values: DataFrame, beta: float, group: list[str] | None = None) -> DataFrame:
    """member, w: exp of at most 10 of -beta (f - min f), plus 1e-6, normalised; within each group if given. The least
    value and the sum are aggregated first and joined back."""
    keys = group or []
    join = lambda a, b: a.join(F.broadcast(b), keys) if keys else a.join(F.broadcast(b))
    least = values.groupBy(*keys).agg(F.min("f").alias("__least"))
    raw = join(values, least).withColumn("__raw", F.exp(F.least(-(F.col("f") - F.col("__least")) * beta, F.lit(10.0))) + 1e-6)
    total = raw.groupBy(*keys).agg(F.sum("__raw").alias("__total"))
    return join(raw, total).withColumn("w", F.col("__raw") / F.col("__total")).select(*keys, "member", "w")


def weighted_mean(controls: DataFrame, weights: DataFrame, group: list[str] | None = None) -> DataFrame:
    return controls.join(weights, [*(group or []), "member"]).groupBy(*(group or []), "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def best_member(values: DataFrame) -> DataFrame:
    return values.orderBy("f", "member").limit(1)


def survivors(weights: DataFrame, count: int, draw) -> DataFrame:
    """turn, member: draws by inverse cumulative weight; draw: a number in (0, 1) from the turn, a Column function.

    The members' cumulative weights are the ranges; weights are a row for each member and so are broadcast."""
    upto = F.sum("w").over(W.orderBy("member"))
    ranges = weights.select("member", (upto - F.col("w")).alias("low"), upto.alias("high"))
    turns = weights.sparkSession.range(count).select(F.col("id").alias("turn"), draw(F.col("id").cast("string")).alias("u"))
    return turns.join(F.broadcast(ranges), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("turn", "member")


def epsilon_transform(x: Column, low: Column, high: Column, eps: Column) -> Column:
    """From the box to one widened by eps on either side, linearly: what is sampled outside falls inside."""
    return low - eps + (x - low) / (high - low) * (high - low + 2 * eps)


# -- marginals, on numpy arrays ---------------------------------------------------------------------------------------


class Gaussian:
    def __init__(self, mean, std) -> None:
        self.mean, self.std = np.asarray(mean, float), np.asarray(std, float)

    def pdf(self, x):
        from murmur.functions.special import norm_pdf

        return norm_pdf((x - self.mean) / self.std) / self.std

    def ppf(self, u):
        from murmur.functions.special import norm_ppf

        return self.mean + self.std * norm_ppf(u)

    def grad_log(self, x):
        return -(x - self.mean) / self.std**2

    def hess_log(self, x):
        return -1 / self.std**2 + 0 * x


class Logistic:
    def __init__(self, mean, scale) -> None:
        self.mean, self.scale = np.asarray(mean, float), np.asarray(scale, float)

    def pdf(self, x):
        e = np.exp(-np.abs(x - self.mean) / self.scale)
        return e / (self.scale * (1 + e) ** 2)

    def ppf(self, u):
        return self.mean + self.scale * np.log(u / (1 - u))

    def grad_log(self, x):
        return -np.tanh((x - self.mean) / (2 * self.scale)) / self.scale

    def hess_log(self, x):
        return -1 / (2 * self.scale**2 * np.cosh((x - self.mean) / (2 * self.scale)) ** 2)


class TruncatedGaussian:
    def __init__(self, mean, std, low, high) -> None:
        from murmur.functions.special import norm_cdf

        self.mean, self.std, self.low, self.high = (np.asarray(v, float) for v in (mean, std, low, high))
        self.a, self.b = norm_cdf((self.low - self.mean) / self.std), norm_cdf((self.high - self.mean) / self.std)

    def pdf(self, x):
        inside = (x >= self.low) & (x <= self.high)
        return np.where(inside, Gaussian(self.mean, self.std).pdf(x) / (self.b - self.a), 0.0)

    def ppf(self, u):
        return np.clip(Gaussian(self.mean, self.std).ppf(self.a + u * (self.b - self.a)), self.low, self.high)

    def grad_log(self, x):
        return -(x - self.mean) / self.std**2

    def hess_log(self, x):
        return -1 / self.std**2 + 0 * x


class Beta:
    """On [low, high], with shapes a and b."""

    def __init__(self, a, b, low=0.0, high=1.0) -> None:
        self.a, self.b, self.low, self.high = (np.asarray(v, float) for v in (a, b, low, high))

    def _unit(self, x):
        return (x - self.low) / (self.high - self.low)

    def pdf(self, x):
        from murmur.functions.special import beta_pdf

        return beta_pdf(self._unit(x), self.a, self.b) / (self.high - self.low)

    def ppf(self, u):
        from murmur.functions.special import beta_ppf

        return self.low + (self.high - self.low) * beta_ppf(u, self.a, self.b)

    def grad_log(self, x):
        y = self._unit(x)
        return ((self.a - 1) / y - (self.b - 1) / (1 - y)) / (self.high - self.low)

    def hess_log(self, x):
        y = self._unit(x)
        return (-(self.a - 1) / y**2 - (self.b - 1) / (1 - y) ** 2) / (self.high - self.low) ** 2

    def grad_shapes(self, x):
        """Derivatives of the log density by a and by b."""
        from murmur.functions.special import digamma

        y = self._unit(x)
        both = digamma(self.a + self.b)
        return both - digamma(self.a) + np.log(y), both - digamma(self.b) + np.log1p(-y)

    def fisher(self) -> np.ndarray:
        """Information about (a, b), for scalar shapes."""
        from murmur.functions.special import trigamma

        both = trigamma(self.a + self.b)
        return np.array([[trigamma(self.a) - both, -both], [-both, trigamma(self.b) - both]])


def beta_of_mode(mode, concentration, low=0.0, high=1.0) -> Beta:
    """The Beta with this mode and concentration a + b >= 2."""
    y = (np.asarray(mode, float) - low) / (np.asarray(high) - low)
    k = np.asarray(concentration, float) - 2
    return Beta(1 + y * k, 1 + (1 - y) * k, low, high)


def concentration_of(mode: float, variance: float) -> float:
    """The concentration k > 2 of a Beta on [0, 1] with this mode and variance: a root of a cubic."""
    w, v = mode, variance
    # a = 1 + w (k - 2), b = k - a; a b = v k^2 (k + 1)
    a1, a0 = w, 1 - 2 * w
    b1, b0 = 1 - w, 2 * w - 1
    roots = np.roots([-v, a1 * b1 - v, a1 * b0 + a0 * b1, a0 * b0])
    real = roots[np.abs(roots.imag) < 1e-9].real
    good = real[real > 2]
    if not len(good):
        raise ValueError("no Beta has this mode and variance")
    return float(good.max())


def copula_sample(marginals: list, corr: np.ndarray, members: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (members x controls) with these marginals under a Gaussian copula, and the normals behind them."""
    from murmur.functions.special import norm_cdf

    z = np.random.default_rng(seed).standard_normal((members, len(marginals))) @ np.linalg.cholesky(corr).T
    u = np.clip(norm_cdf(z), 1e-12, 1 - 1e-12)
    return np.stack([m.ppf(u[:, k]) for k, m in enumerate(marginals)], 1), z


def copula_score(marginals: list, corr: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The gradient of the log density at samples, members x controls: marginal part, and the copula's by the chain
    rule through z = ppf(cdf(x)), dz/dx = pdf(x) / phi(z)."""
    from murmur.functions.special import norm_pdf

    pull = z @ (np.eye(len(corr)) - np.linalg.inv(corr))
    out = np.empty_like(x)
    for k, m in enumerate(marginals):
        out[:, k] = m.grad_log(x[:, k]) + pull[:, k] * m.pdf(x[:, k]) / np.maximum(norm_pdf(z[:, k]), 1e-300)
    return out


def stein_gradient(score: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The gradient of the mean objective by the controls' location: minus the mean of (f - mean f) times the score."""
    return -((f - f.mean())[:, None] * score).mean(0)


def stein_hessian(score: np.ndarray, curvature: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The same of second order: mean of (f - mean f)(score score' + curvature); curvature by control."""
    d = f - f.mean()
    outer = np.einsum("n,ni,nj->ij", d, score, score) / len(f)
    return outer + np.diag((d[:, None] * curvature).mean(0))


def shape_gradient(marginals: list[Beta], x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """By each marginal's shapes (a, b), natural: preconditioned by their Fisher information."""
    d = f - f.mean()
    out = []
    for k, m in enumerate(marginals):
        ga, gb = m.grad_shapes(x[:, k])
        out.append(np.linalg.solve(m.fisher(), np.array([(d * ga).mean(), (d * gb).mean()])))
    return np.array(out)


def correlation_gradient(corr: np.ndarray, z: np.ndarray, f: np.ndarray) -> np.ndarray:
    """By the copula's correlations: symmetric, zero on the diagonal."""
    inv = np.linalg.inv(corr)
    d = f - f.mean()
    g = 0.5 * (inv @ np.einsum("n,ni,nj->ij", d, z, z) @ inv / len(f))
    np.fill_diagonal(g, 0)
    return g
