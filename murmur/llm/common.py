"""What the corpus operators share: the cluster's scratch folder and small native expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and ASCII 9 to 13. Fixed value of the word contracts.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only a session in one JVM (local mode, as in tests) may lack the setting; it gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="murmur-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/murmur/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, and has a known size,
    so that Spark broadcasts it only below spark.sql.autoBroadcastJoinThreshold."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables as by written(), all deleted on leaving: for steps whose result is complete by then."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, scratch_path(spark, name)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete_path(self.spark, self.path)


#: Bytes of the batches that go to Python workers, in place of Spark's default.
BATCH_BYTES, _KEY, _DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", ("64MB", "67108864b", "64m")


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers batches of some MB, unless it has a setting of its own: a batch is
    held by the executor and the worker at once, and texts are long."""
    if spark.conf.get(_KEY, "67108864b") in _DEFAULT:
        spark.conf.set(_KEY, BATCH_BYTES)


def release(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage and give back the memory: a heap that earlier steps have filled stays
    as large as it got, and Python workers need the room. For between the stages of a long session."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any], *, beside: bool = False) -> Any:
    """What a worker keeps between tasks: one thing, such as the last vocabulary, so that a reused worker does not
    gather all that it ever needed; and the small ones that are to stand beside it."""
    if key not in _held:
        if not beside:
            _held.clear()
        _held[key] = make()
    return _held[key]


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that the operators have left in the shared folder: for callers who have their results."""
    delete_path(spark, f"{shared_dir(spark)}/murmur")


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch path on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def uniform(key: Column) -> Column:
    """A number in (0, 1) decided by the string key: the first 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def id_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("null"))


def sections(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of rows of about `most` in size."""
    begin = total = 0
    for i, s in enumerate(sizes):
        if i > begin and total + s > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += s
    if begin < len(sizes):
        yield slice(begin, len(sizes))
