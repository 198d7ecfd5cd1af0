"""Localization tapers as expressions of a distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaspari_cohn(distance: Column, length: Column | float) -> Column:
    """The fifth-order compactly supported correlation: 1 at 0, 0 from twice the length on."""
    r = F.abs(distance) / length
    near = -(r**5) / 4 + r**4 / 2 + 5 * r**3 / 8 - 5 * r**2 / 3 + 1
    far = r**5 / 12 - r**4 / 2 + 5 * r**3 / 8 + 5 * r**2 / 3 - 5 * r + 4 - 2 / (3 * r)
    return F.when(r <= 1, near).when(r < 2, far).otherwise(0.0)


def sigmoid_taper(distance: Column, length: float) -> Column:
    """A logistic step at 1 - length of steepness 50."""
    return 1 / (1 + F.exp(-50.0 * (distance - (1 - length))))


def spherical(distance: Column, length: float) -> Column:
    h = F.abs(distance) / length
    return F.when(h < 1, 1 - 1.5 * h + 0.5 * h**3).otherwise(0.0)


def furrer_bengtsson(correlation: Column, members: int) -> Column:
    """The taper that is best for a sample of so many members at this true correlation."""
    c2 = correlation * correlation
    return F.when(c2 > 0, members * c2 / ((members + 1) * c2 + 1)).otherwise(0.0)


def anisotropic_distance(di: Column, dj: Column, ratio: float, angle: float) -> Column:
    """Distance with the minor axis stretched by ratio, axes turned by angle (radians)."""
    c, s = F.cos(F.lit(angle)), F.sin(F.lit(angle))
    along, across = c * di + s * dj, -s * di + c * dj
    return F.sqrt(along * along + (across * ratio) * (across * ratio))


def shrink(rho: Column, cutoff: Column, kind: str) -> Column:
    """Correlations below a cutoff: `hard` drops them, `soft` also lowers the rest, `sigm` is a smooth hard."""
    size = F.abs(rho)
    if kind == "hard":
        return F.when(size > cutoff, 1.0).otherwise(0.0)
    if kind == "soft":
        return F.when(size > cutoff, (size - cutoff) / size).otherwise(0.0)
    if kind == "sigm":
        return 1 / (1 + F.exp(-50.0 * (size - cutoff)))
    raise ValueError(f"no taper of kind {kind}")
