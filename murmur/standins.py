"""The generic test tables in the roles of the data model, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 8  # cells 0..63 lie on a square grid


def state_long(spark, sf_dir: str) -> DataFrame:
    """label, cell, member, x: the embeddings, a member each, grouped by label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("label", F.col("vec_id").alias("member"), F.posexplode("embedding").alias("cell", "x")).select("label", "cell", "member", F.col("x").cast("double").alias("x"))


def _sums(spark, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    report = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("report")
    return li.select(report, F.col("l_returnflag").alias("datatype"), F.col("l_suppkey").alias("member"), "l_quantity").groupBy("report", "datatype", "member").agg(F.sum("l_quantity").alias("y"))


def predictions(spark, sf_dir: str) -> DataFrame:
    """report, datatype, member, y: monthly quantities by flag, a member for each supplier but 0; months without a
    supplier's sales count as 0, those without any are absent."""
    there = _sums(spark, sf_dir).where("member <> 0")
    reports = there.select("report", "datatype").distinct()
    members = there.select("member").distinct()
    return reports.crossJoin(F.broadcast(members)).join(there, ["report", "datatype", "member"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def observations(spark, sf_dir: str) -> DataFrame:
    """report, datatype, d: the same of supplier 0."""
    return _sums(spark, sf_dir).where("member = 0").select("report", "datatype", F.col("y").alias("d"))


STATE_SQL = """state as (
  select label, (i - 1)::int as cell, vec_id as member, embedding[i]::double as x
  from (select *, unnest(generate_series(1, len(embedding))) as i from embeddings)
)"""
DATA_SQL = """sums as (
  select (year(l_shipdate) * 100 + month(l_shipdate))::int as report, l_returnflag as datatype, l_suppkey as member, sum(l_quantity) as y
  from lineitem group by all
), pred as (
  select report, datatype, member, coalesce(y, 0.0) as y
  from (select distinct report, datatype from sums where member <> 0) cross join (select distinct member from sums where member <> 0)
  left join sums using (report, datatype, member)
), obs as (select report, datatype, y as d from sums where member = 0)"""
