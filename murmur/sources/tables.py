"""Observations and variances from delimited files, property files and arrays."""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_AVAILABLE = "n/a"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line number, cells of one delimited file; such a file has a line for each report."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).where(F.trim("text") != "")
    return lines.select("line", F.transform(F.split("text", ","), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', ""))).alias("cells"))


def array_of(text: Column) -> Column:
    """`[1 2 3]` or a number as an array of doubles; what is no number is null."""
    inner = F.trim(F.regexp_replace(text, r"[\[\],]", " "))
    return F.transform(F.split(inner, r"\s+"), lambda x: x.try_cast("double"))


def _layout(rows: DataFrame, types: list[str]) -> str:
    first = rows.orderBy("line").first()
    if first is None:
        return "none"
    names = [c.lower() for c in first["cells"]]
    if names[0] == "header_both":
        return "both"
    return "columns" if any(t.lower() in names for t in types) else "none"


def _table(rows: DataFrame, types: list[str], reports: list[int], width: int) -> DataFrame:
    """report, datatype and `width` cells of each datum, whatever the header says."""
    kind = _layout(rows, types)
    head = [c.lower() for c in rows.orderBy("line").first()["cells"]] if kind != "none" else None
    body = rows if kind == "none" else rows.where(F.col("line") > rows.agg(F.min("line")).first()[0])
    from pyspark.sql import Window as W

    turn = F.row_number().over(W.orderBy("line"))  # a line for each report
    first = 1 if kind == "both" else 0
    points = F.array(*[F.lit(r) for r in reports])
    report = F.element_at("cells", 1).cast("int") if kind == "both" else F.try_element_at(points, turn)
    parts = []
    for n, t in enumerate(types):
        at = head.index(t.lower()) if head else first + n * width
        parts.append(F.struct(F.lit(t).alias("datatype"), *[F.try_element_at("cells", F.lit(at + k + 1)).alias(f"c{k}") for k in range(width)]))
    body = body.select(report.cast("int").alias("report"), "cells").where(F.col("report").isin(reports))
    out = body.select("report", F.explode(F.array(*parts)).alias("p"))
    return out.select("report", "p.*")


def observations(spark: SparkSession, path: str, types: list[str], reports: list[int]) -> DataFrame:
    """report, datatype, comp, d: lines are reports, columns data types, with a header of types, of both (first cell
    `header_both`) or none. A cell may hold an array; `n/a` means no row."""
    table = _table(_lines(spark, path), types, reports, 1)
    return table.where(F.lower("c0") != NOT_AVAILABLE).select("report", "datatype", F.posexplode(array_of(F.col("c0"))).alias("comp", "d")).where("d is not null")


def variances(spark: SparkSession, path: str, types: list[str], reports: list[int]) -> DataFrame:
    """report, datatype, kind, value, floor from alternating columns of kind and value; a value may be an array of the
    value and a floor."""
    table = _table(_lines(spark, path), types, reports, 2)
    values = array_of(F.col("c1"))
    return table.where(F.lower("c0") != NOT_AVAILABLE).select("report", "datatype", F.lower("c0").alias("kind"), F.element_at(values, 1).alias("value"), F.try_element_at(values, F.lit(2)).alias("floor"))


def from_frame(spark: SparkSession, frame, index: str = "report") -> DataFrame:
    """report, datatype, comp, d from a pandas frame with data types as columns, reports as index, cells numbers,
    sequences or text arrays."""
    rows = []
    for report, line in frame.iterrows():
        for name, cell in line.items():
            text = str(cell).strip()
            if cell is None or text.lower() in ("", "nan", NOT_AVAILABLE, "none"):
                continue
            values = np.atleast_1d(np.array(text.strip("[]").replace(",", " ").split(), float) if isinstance(cell, str) else np.asarray(cell, float))
            rows += [(int(report), str(name if not isinstance(name, tuple) else "|".join(map(str, name))), i, float(v)) for i, v in enumerate(values.ravel())]
    return spark.createDataFrame(rows, f"{index} int, datatype string, comp int, d double")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """name, row, x (array) of the arrays of a .npz or .npy file; nothing is unpickled."""
    got = np.load(path, allow_pickle=False)
    named = {"": got} if isinstance(got, np.ndarray) else {k: got[k] for k in got.files}
    rows = [(k, i, [float(v) for v in np.atleast_1d(line)]) for k, a in named.items() for i, line in enumerate(np.atleast_1d(a))]
    return spark.createDataFrame(rows, "name string, row int, x array<double>")


def properties(spark: SparkSession, path: str, keyword: str | None = None) -> DataFrame:
    """path, kw, idx, v of keyword property files (path may name many): `--` comments, `N*value` repeats, `/` ends a
    keyword. A file is one task; its values are expanded as rows."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"--[^\n]*", "").alias("text"))
    blocks = whole.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)([A-Za-z][A-Za-z0-9_]*)\s([^/]*)/"), F.lit(0))).alias("block"))
    words = blocks.select("path", F.filter(F.split("block", r"[\s/]+"), lambda w: w != "").alias("w")).select("path", F.upper(F.element_at("w", 1)).alias("kw"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("w"))
    if keyword:
        words = words.where(F.col("kw") == keyword.upper())

    def expand(w: Column) -> Column:
        parts = F.split(w, r"\*")
        return F.when(F.size(parts) == 2, F.array_repeat(F.element_at(parts, 2).try_cast("double"), F.element_at(parts, 1).try_cast("int"))).otherwise(F.array(F.element_at(parts, 1).try_cast("double")))

    return words.select("path", "kw", F.posexplode(F.flatten(F.transform("w", expand))).alias("idx", "v"))


def runs(values: list) -> list[tuple[int, object]]:
    return [(len(list(g)), k) for k, g in groupby(values)]


def write_property(df: DataFrame, path: str, keyword: str, compressed: bool = False, form: str = "%g", order: str = "idx", value: str = "v") -> None:
    """Values in order as a keyword property file, null as 0, with runs as `N*value` if compressed; streamed through
    the driver, as one file has one writer."""

    def words():
        held, n = None, 0
        for row in df.select(value).orderBy(order).toLocalIterator():
            text = form % (row[0] if row[0] is not None else 0)
            if not compressed:
                yield text
            elif text == held:
                n += 1
            else:
                if n:
                    yield held if n == 1 else f"{n}*{held}"
                held, n = text, 1
        if n:
            yield held if n == 1 else f"{n}*{held}"

    with open(path, "w", encoding="ascii") as f:
        f.write(f"{keyword.upper()}\n")
        for i, w in enumerate(words()):
            f.write(w + ("\n" if i % 6 == 5 else " "))
        f.write("\n/\n")


def run_lengths(df: DataFrame, order: list[str], value: str, group: list[str]) -> DataFrame:
    """group, run, value, n: stretches of equal values in order, numbered from 1 within a group."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*group).orderBy(*order)
    begins = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__b", begins).withColumn("run", F.sum("__b").over(w).cast("int"))
    return marked.groupBy(*group, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))
