"""Binary simulation records: typed blocks with length markers, big-endian."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.statistics import numbered

#: Numpy types of the record types, and values in one block. Fixed values of the format.
TYPES = {"INTE": (">i4", 1000), "REAL": (">f4", 1000), "DOUB": (">f8", 1000), "LOGI": (">i4", 1000), "CHAR": ("S8", 105), "MESS": ("S1", 1)}
SCHEMA = "path string, kwd string, seq int, typ string, idx int, num double, text string"


def decode(data: bytes) -> Iterator[tuple[str, int, str, np.ndarray]]:
    """(keyword, how many of that name came before, type, values) of each record."""
    at, seen = 0, {}

    def block() -> bytes:
        nonlocal at
        (n,) = struct.unpack_from(">i", data, at)
        part = data[at + 4 : at + 4 + n]
        (m,) = struct.unpack_from(">i", data, at + 4 + n)
        if n != m:
            raise ValueError(f"length markers at {at} differ")
        at += n + 8
        return part

    while at < len(data):
        head = block()
        name, count, kind = head[:8].decode("ascii").strip(), struct.unpack(">i", head[8:12])[0], head[12:16].decode("ascii")
        form, _ = TYPES[kind]
        size, parts, held = np.dtype(form).itemsize * count, [], 0
        while held < size:
            parts.append(block())
            held += len(parts[-1])
        seq = seen.get(name, 0)
        seen[name] = seq + 1
        yield name, seq, kind, np.frombuffer(b"".join(parts), form, count)


def encode(records: list[tuple[str, str, np.ndarray]]) -> bytes:
    """The inverse: (keyword, type, values)."""
    out = bytearray()

    def block(part: bytes) -> None:
        out.extend(struct.pack(">i", len(part)) + part + struct.pack(">i", len(part)))

    for name, kind, values in records:
        form, most = TYPES[kind]
        block(name.ljust(8).encode("ascii") + struct.pack(">i", len(values)) + kind.encode("ascii"))
        a = np.array([str(v).ljust(8).encode("ascii") for v in values], "S8") if kind == "CHAR" else np.asarray(values).astype(form)
        for i in range(0, len(a), most):
            part = a[i : i + most]
            block(b"".join(v.ljust(8) for v in part.tolist()) if kind == "CHAR" else part.tobytes())
    return bytes(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, kwd, seq, typ, idx, num, text of every value of the files; a file is one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for kwd, seq, kind, values in decode(raw.as_py()):
                    n = len(values)
                    text = kind in ("CHAR", "MESS")
                    num = pa.nulls(n, pa.float64()) if text else pa.array(values.astype(float))
                    words = pa.array([v.decode("latin-1").rstrip() for v in values.tolist()], pa.string()) if text else pa.nulls(n, pa.string())
                    same = lambda v, t, n=n: pa.array([v] * n, t)
                    yield pa.RecordBatch.from_arrays(
                        [same(name, pa.string()), same(kwd, pa.string()), same(seq, pa.int32()), same(kind, pa.string()), pa.array(np.arange(n, dtype=np.int32)), num, words],
                        ["path", "kwd", "seq", "typ", "idx", "num", "text"],
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def catalog(records: DataFrame) -> DataFrame:
    return records.groupBy("path", "kwd", "seq", "typ").agg(F.count("idx").alias("n"))


def values(records: DataFrame, kwd: str, seq: int = 0) -> DataFrame:
    return records.where((F.col("kwd") == kwd) & (F.col("seq") == seq)).select("idx", "num", "text")


def header(records: DataFrame, seq: int = 0) -> dict[int, int]:
    """Words of the integer header; a few hundred."""
    return {r["idx"]: int(r["num"]) for r in values(records, "INTEHEAD", seq).collect()}


def dimensions(records: DataFrame) -> tuple[int, int, int]:
    h = header(records)
    return h[8], h[9], h[10]


def phases(records: DataFrame) -> list[str]:
    bits = header(records)[14]
    return [name for name, bit in (("OIL", 1), ("WAT", 2), ("GAS", 4)) if bits & bit]


def report_dates(records: DataFrame) -> DataFrame:
    """seq, day: the date of every report, from words 64 to 66 (day, month, year) of its header."""
    heads = records.where("kwd = 'INTEHEAD' and idx in (64, 65, 66)").groupBy("seq").pivot("idx", [64, 65, 66]).agg(F.first("num"))
    return heads.select("seq", F.make_date(F.col("66").cast("int"), F.col("65").cast("int"), F.col("64").cast("int")).alias("day"))


def at(dates: DataFrame, when: dt.date) -> int:
    """The report of a date."""
    row = dates.where(F.col("day") == F.lit(when)).orderBy("seq").first()
    if row is None:
        raise ValueError(f"no report at {when}")
    return row["seq"]


def active_cells(init: DataFrame) -> DataFrame:
    """cell, active_idx: cells with pore volume, numbered among themselves by position."""
    return numbered(values(init, "PORV").where("num > 0").select(F.col("idx").alias("cell")), "cell", "active_idx")


def cell_data(records: DataFrame, kwd: str, cells: int, live: DataFrame, seq: int = 0) -> DataFrame:
    """cell, v: a property on the full grid; one written for active cells only is null elsewhere."""
    v = values(records, kwd, seq).select("idx", F.col("num").alias("v"))
    if v.count() == cells:
        return v.select(F.col("idx").alias("cell"), "v")
    every = records.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell"))
    return every.join(live.join(v, live["active_idx"] == v["idx"]).select("cell", "v"), "cell", "left")


def property_name(prop: str, component: int | None = None) -> str:
    """The record's keyword of a property, or of a component's mole fraction."""
    return prop if component is None else f"{prop}{component}"


def summary(spec: DataFrame, data: DataFrame, kwd: str, well: str | None = None) -> DataFrame:
    """step, v: a vector of the summary; of each report step the last ministep."""
    names = values(spec, "KEYWORDS").select("idx", F.col("text").alias("kwd")).join(values(spec, "WGNAMES").select("idx", F.col("text").alias("well")), "idx", "left")
    found = names.where(F.col("kwd") == kwd)
    if well is not None:
        found = found.where(F.col("well") == well)
    params = data.where("kwd = 'PARAMS'").select(F.col("seq").alias("step"), "idx", F.col("num").alias("v"))
    return params.join(F.broadcast(found.select("idx")), "idx").select("step", "v")


def well_log(rft: DataFrame, well: str, prop: str) -> DataFrame:
    """seq, idx, v: a property along a well in the log file, whose records come in groups headed by WELLETC."""
    group = rft.where((F.col("kwd") == "WELLETC") & (F.col("idx") == 1) & (F.col("text") == well)).select("path", "seq")
    return rft.where(F.col("kwd") == prop).join(F.broadcast(group), ["path", "seq"]).select("seq", "idx", F.col("num").alias("v"))
