"""Small documents with every awkward case, and DuckDB over a Spark result."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"


def awkward() -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "Epsilon", "zeta", "eta", "theta", "iota", "kappa", "été", "naïve", "中文", "🎉", "42", "x-y"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(60)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "  \t\n", None, "a", 4), (4, "one", "en", "b", 3), (5, base, "en", "a", len(base)),
        (6, base, "fr", "b", len(base)), (7, base.upper(), "en", "a", 1), (8, base + " tail", "en", "a", 1), (9, base.replace("alpha", "omega", 1), "en", "a", 1),
        (None, base, "en", "a", 1), (10, prose(9000), "en", "a", 1), (11, "x" * 100_000, "de", "c", 1), (12, prose(3), "en", "a", 1), (12, prose(3), "en", "a", 1),
        (13, "one", "en", "b", 3), (13, "one", "en", "b", 3), (-5, prose(40), "es", "a", 1), (14, "\x00 \x1f\u0085  odd", "en", "a", 1),
    ]
    rows += [(20 + i, prose(5 + i * 3), "en", "a", 1) for i in range(20)]
    return [(*r, "clash", "clash") for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def saved(spark, tmp_path, rows=None, name="documents"):
    """A folder with the rows as a table, for the queries."""
    path = str(tmp_path / "sf")
    frame(spark, rows).coalesce(2).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return path
