"""Noise that any engine can draw again: decided by a key, uniform from its MD5, normal by Box and Muller."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, salt: str) -> Column:
    """In (0, 1): 32 bits of the MD5 of key and salt."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{salt}"))), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(key: Column, salt: str = "n") -> Column:
    """Standard normal."""
    return F.sqrt(-2 * F.ln(uniform(key, f"{salt}1"))) * F.cos(2 * math.pi * uniform(key, f"{salt}2"))


def uniform_sql(key: str, salt: str) -> str:
    return f"((('0x' || substr(md5({key} || '|{salt}'), 1, 8))::bigint)::double + 0.5) / {float(1 << 32)!r}"


def normal_sql(key: str, salt: str = "n") -> str:
    return f"(sqrt(-2 * ln({uniform_sql(key, salt + '1')})) * cos({2 * math.pi!r} * ({uniform_sql(key, salt + '2')})))"
