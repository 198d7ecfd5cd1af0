"""More operators over the stand-in tables: single steps whose results SQL has in closed form, layouts and geometry.

They join the queries of murmur.queries.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import noise
from murmur.operators import diagnostics, gram, grid, layout, objective, observations, prior, statistics
from murmur.plans import assimilation
from murmur.queries import _CORNER_SQL, OBSERVED, SIGMA, _corner_tables, _each_label, _problem, query, r, rounded
from murmur.standins import DATA_SQL, STATE_SQL, state_long
from murmur.standins import observations as obs_of
from murmur.standins import predictions as pred_of

# -- whole updates by one datum ---------------------------------------------------------------------------------------

#: A label's members but the first, which is the truth, numbered from 0; the datum and its errors by step.
_TWIN = f"""{STATE_SQL}, numbered as (select *, row_number() over (partition by label, cell order by member) - 2 as n from state),
truth as (select label, x as d from numbered where n = -1 and cell = {OBSERVED}), s0 as (select label, cell, n, x from numbered where n >= 0)"""


def _updates(alphas: list[float]) -> str:
    """CTEs s1, s2, ...: each updates the one before by the datum with an inflated error."""
    out = ""
    for i, a in enumerate(alphas):
        z = noise.normal_sql(f"('noise|mda{i}|{OBSERVED}|value|0|' || n)")
        out += f""", y{i} as (select label, n, x as y, d + sqrt({a * SIGMA**2!r}) * {z} as e from s{i} join truth using (label) where cell = {OBSERVED}),
k{i} as (select label, cell, covar_samp(x, y) / (var_samp(y) + {a * SIGMA**2!r}) as k from s{i} join y{i} using (label, n) group by all),
s{i + 1} as (select label, cell, n, x + k * (e - y) as x from s{i} join y{i} using (label, n) join k{i} using (label, cell))"""
    return out


def _moments_sql(alphas: list[float]) -> str:
    return f"with {_TWIN}{_updates(alphas)} select label, cell, {r('avg(x)')} as mean, {r('stddev_samp(x)')} as std from s{len(alphas)} group by all"


def _run(spark, sf, alphas: list[float], flavour: str) -> DataFrame:
    def one(label):
        state = assimilation.esmda(_problem(spark, sf, label, [OBSERVED]), alphas, flavour).state
        x = F.col("x")
        return rounded(state.select("cell", statistics.mean_of(x).alias("mean"), statistics.spread_of(x).alias("std")))

    return _each_label(spark, sf, one)


@query(_moments_sql([1.0]))
def es_datum_approx(spark, sf):
    return _run(spark, sf, [1.0], "approx")


@query(_moments_sql([1.0]))
def es_datum_subspace(spark, sf):
    return _run(spark, sf, [1.0], "subspace")


@query(_moments_sql([2.0, 4.0, 4.0]))
def esmda_datum_approx(spark, sf):
    return _run(spark, sf, prior.inflation(3, [2.0, 4.0, 4.0]), "approx")


# -- statistics ---------------------------------------------------------------------------------------------------------


@query(f"""with {STATE_SQL}, s as (select label, cell, stddev_pop(x) as s from state group by all)
select label, cell, (row_number() over (partition by label, cell order by member) - 1)::int as member, {r('x / s')} as x from state join s using (label, cell)""")
def whitened_state(spark, sf):
    x = state_long(spark, sf)
    rows = layout.to_matrix(x, ["label", "cell"]).join(statistics.moments(x, ["label", "cell"]).drop("mean"), ["label", "cell"])
    return rounded(layout.to_long(statistics.whiten(rows, "std").drop("std")))


@query(f"""with {STATE_SQL} select (label * 64 + a.cell)::int as i, (label * 64 + b.cell)::int as j, {r('covar_samp(a.x, b.x)', 9)} as v
from state a join state b using (label, member) group by label, a.cell, b.cell""")
def block_diagonal(spark, sf):
    x = state_long(spark, sf)
    cov = statistics.cross_covariance(x.withColumnRenamed("cell", "i"), x.withColumnRenamed("cell", "j"), ["label"]).withColumnRenamed("cov", "v")
    labels = sorted(k[0] for k in x.select("label").distinct().collect())
    blocks = {str(k): cov.where(F.col("label") == k).select("i", "j", "v") for k in range(max(labels, default=-1) + 1)}
    out = statistics.block_diagonal(blocks, dict.fromkeys(blocks, 64))
    return rounded(out.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "v"), 9)


@query(f"""with {STATE_SQL} select label, a.cell as i, b.cell as j, {r('covar_samp(a.x, b.x)', 9)} as cov
from state a join state b using (label, member) where a.cell // 16 = b.cell // 16 group by all""")
def variable_blocks(spark, sf):
    x = state_long(spark, sf)
    cov = statistics.cross_covariance(x.withColumnRenamed("cell", "i"), x.withColumnRenamed("cell", "j"), ["label"])
    owned = cov.withColumn("param_i", F.floor(F.col("i") / 16)).withColumn("param_j", F.floor(F.col("j") / 16))
    return rounded(statistics.blocks_of(owned, "param").select("label", "i", "j", "cov"), 9)


@query(f"""with {STATE_SQL}, m as (select label, cell, avg(x) as d, count(*) as n from state group by all),
chi as (select label, cell, d, n, sum(pow(0.5 * x + 0.1 - x, 2)) as chi from state join m using (label, cell) group by all)
select label, cell, {r('(chi + 3.0 * 0.04) / (n + 3.0)', 9)} as v from chi""")
def marginal_noise(spark, sf):
    y = layout.to_matrix(state_long(spark, sf), ["label", "cell"]).withColumnRenamed("x", "y")
    data = y.withColumn("e", F.transform("y", lambda v: 0.5 * v + 0.1)).withColumn("v", F.lit(0.04))
    return rounded(gram.marginal_ratio(data, 3.0).select("label", "cell", "v"), 9)


@query(f"""with {STATE_SQL} select cell as i, {r('sum(a / (label + 1.0))', 9)} as g from (select label, cell, avg(x) as a from state group by all) group by cell""")
def level_gradient(spark, sf):
    x = state_long(spark, sf)
    g = x.groupBy(F.col("label").cast("int").alias("level"), F.col("cell").alias("i")).agg(F.avg("x").alias("g"))
    top = g.agg(F.max("level")).first()[0]
    return rounded(objective.level_gradient(g, [1 / (k + 1.0) for k in range((top if top is not None else 0) + 1)]), 9)


@query(f"""with {STATE_SQL} select label, cell, member, {r('-0.5 - 0.05 + (x + 0.5) / 1.0 * (1.0 + 2 * 0.05)')} as x from state""")
def epsilon_box(spark, sf):
    moved = objective.epsilon_transform(F.col("x"), F.lit(-0.5), F.lit(0.5), F.lit(0.05))
    return rounded(state_long(spark, sf).withColumn("x", moved))


# -- layouts --------------------------------------------------------------------------------------------------------------


@query(f"""with {STATE_SQL} select label, cell, member, {r('case when cell % 3 = 0 then 2 * x + 1 else x end')} as x from state""")
def scattered_state(spark, sf):
    x = state_long(spark, sf)
    return rounded(layout.scatter(x, x.where("cell % 3 = 0").withColumn("x", 2 * F.col("x") + 1), ["label", "cell", "member"]))


@query(f"""with {STATE_SQL} select label, (row_number() over (partition by label order by cell, member) - 1)::int as place, {r('x')} as x from state""")
def flat_state(spark, sf):
    rows = layout.flat(layout.to_matrix(state_long(spark, sf), ["label", "cell"]), ["label"], ["cell"], "x")
    return rounded(rows.select("label", F.posexplode("x").alias("place", "x")))


@query(f"""with {STATE_SQL} select label, cell, {r('x')} as x from (select *, row_number() over (partition by label, cell order by member) as n from state) where n = 4""")
def one_member(spark, sf):
    return rounded(layout.of_member(layout.to_matrix(state_long(spark, sf), ["label", "cell"]), 3))


@query(f"""with {STATE_SQL} select case when cell < 32 then 'low' else 'high' end as param, label, cell, member, {r('x')} as x from state where cell < 32 or cell >= 48""")
def joined_params(spark, sf):
    x = state_long(spark, sf)
    return rounded(layout.union_params({"low": x.where("cell < 32"), "high": x.where("cell >= 48")}).select("param", "label", "cell", "member", "x"))


@query(f"""with {STATE_SQL} select cell as i, m::int as model, (member * 3 + m)::bigint as member, {r('x')} as x from state, generate_series(0, 2) g(m)""")
def expanded_models(spark, sf):
    x = state_long(spark, sf).select(F.col("cell").alias("i"), F.col("member").cast("long").alias("member"), "x")
    return rounded(observations.expand_models(x, 3).select("i", "model", "member", "x"))


@query(f"""with c as (select c_nationkey as report, c_mktsegment as datatype, c_custkey as comp, case when c_custkey % 5 = 0 then ' N/a ' when c_custkey % 7 = 0 then '' else c_acctbal::varchar end as d from customer)
select report, datatype, comp, {r("d::double * case when datatype = 'BUILDING' then 2.5 else 1.0 end", 4)} as d from c where lower(trim(d)) not in ('n/a', '')""")
def organised_data(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    text = F.when(F.col("c_custkey") % 5 == 0, " N/a ").when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_acctbal").cast("string"))
    raw = c.select(F.col("c_nationkey").alias("report"), F.col("c_mktsegment").alias("datatype"), F.col("c_custkey").alias("comp"), text.alias("d"))
    return rounded(observations.organise(raw, {"BUILDING": 2.5}), 4)


_BLOCKS = f"""with {DATA_SQL}, v as (select report, datatype, n::int as comp, 1 + 0.01::double * d * (n + 1) as v from obs, generate_series(0, 1) g(n)),
blocks as (select report, datatype, comp as i, comp as j, v from v where datatype <> 'R' union all
  select report, datatype, a.n::int as i, b.n::int as j, case when a.n = b.n then 2.0::double else 0.5 end as v from obs, generate_series(0, 1) a(n), generate_series(0, 1) b(n) where datatype = 'R')"""


def _blocks(spark, sf) -> DataFrame:
    v = obs_of(spark, sf).withColumn("comp", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("v", 1 + 0.01 * F.col("d") * (F.col("comp") + 1))
    both = functools.reduce(lambda df, c: df.withColumn(c, F.explode(F.array(F.lit(0), F.lit(1)))), "ij", obs_of(spark, sf).where("datatype = 'R'"))
    full = both.select("report", "datatype", "i", "j", F.when(F.col("i") == F.col("j"), 2.0).otherwise(0.5).alias("v"))
    return observations.covariance_blocks(v, full)


@query(_BLOCKS + f" select report, datatype, i, j, {r('v')} as v from blocks")
def data_covariance(spark, sf):
    return rounded(_blocks(spark, sf))


@query(_BLOCKS + f" select report, datatype, i as comp, {r('v')} as v from blocks where i = j")
def data_variances(spark, sf):
    return rounded(observations.variances_of(_blocks(spark, sf)))


@query(f"""with {DATA_SQL}, p as (select distinct report, datatype from pred), n as (select report, datatype, count(d) as n from obs group by all)
select report, datatype, coalesce(n, 0) as n, case when coalesce(n, 0) = 1 then 'scalar' else 'vector' end as kind from p left join n using (report, datatype)""")
def data_kinds(spark, sf):
    return diagnostics.split_data(layout.sizes(obs_of(spark, sf), pred_of(spark, sf)))


@query(f"with {STATE_SQL} select distinct label, 'poro' as param, cell, case when cell < 32 then 0.1::double else 0.2 end as std from state")
def prior_scaling(spark, sf):
    p = prior.Prior("poro", 0.2, (0.01, 0.04), (8, 4, 2), ("sph", "sph"), (4.0, 4.0))
    cells = state_long(spark, sf).select("label", "cell").distinct().withColumn("param", F.lit("poro"))
    return rounded(prior.scaling(cells, [p]).select("label", "param", "cell", "std"))


# -- geometry ---------------------------------------------------------------------------------------------------------------


@query("""select (n // 4)::int as j, f::int as f, (n % 4)::int as i, r::int as r, ((n // 4) + f) * 10.0::double + (n % 4) + r as depth
from generate_series(0, 11) g(n), generate_series(0, 1) y(f), generate_series(0, 1) w(r)""")
def pillar_corners(spark, sf):
    cells, _, _ = _corner_tables(spark)
    values = spark.range(20).select((F.col("id") / 5).cast("int").alias("j"), (F.col("id") % 5).cast("int").alias("i")).withColumn("depth", F.col("j") * 10.0 + F.col("i"))
    return grid.pillar_to_corners(values, cells, "depth")


_NUMBER = "((((k * 2 + b) * 3 + j) * 2 + f) * 4 + i) * 2 + r"


@query(f"""with {_CORNER_SQL}, t as (select k, j, i, (1 - b) * 4 + f * 2 + case when f = 0 then r else 1 - r end as t, {_NUMBER} as n from c)
select k, j, i, string_agg(n, ',' order by t) as points from t group by all""")
def cell_corners(spark, sf):
    _, corners, _ = _corner_tables(spark)
    return grid.hexahedron(corners, grid.corner_number(2, 3, 4)).withColumn("points", F.array_join(F.transform("points", lambda n: n.cast("string")), ","))


_POINTS = f"{_CORNER_SQL}, p as (select k, b, j, f, i, r, 100.0 * (i + r) + 5 * (z - 1000) / 40 as x, 50.0::double * (j + f) as y, z from c)"


@query(f"with {_POINTS} select k, b, j, f, i, r, {r('x')} as x, {r('y')} as y, {r('z')} as z from p where r = 1")
def face_right(spark, sf):
    _, corners, pillars = _corner_tables(spark)
    return rounded(grid.face_points(grid.corner_points(corners, pillars), grid.Face.RIGHT))


@query(f"with {_POINTS} select {', '.join(f'{r(f + chr(40) + c + chr(41))} as {f}_{c}' for c in 'xyz' for f in ('min', 'max'))} from p")
def grid_box(spark, sf):
    _, corners, pillars = _corner_tables(spark)
    return rounded(grid.bounding_box(grid.corner_points(corners, pillars)))


@query(f"""with {_CORNER_SQL}, e as (select (j + f)::int as j, (i + r)::int as i, min(z) as low, max(z) as high from c group by all),
z as (select j, i, 0 as "end", low as z from e union all select j, i, 1, high from e)
select j, i, "end", {r('100.0 * i + 5 * (z - 1000) / 40')} as x, {r('50.0::double * j')} as y, {r('z')} as z from z""")
def snug_pillars(spark, sf):
    _, corners, pillars = _corner_tables(spark)
    return rounded(grid.snug_pillars(pillars, corners))


@query("select (n // 12)::int as k, ((n // 4) % 3)::int as j, (n % 4)::int as i from generate_series(0, 23) g(n) where n % 5 <> 0 and (n % 4) + (n // 12) >= 2")
def filtered_cells(spark, sf):
    cells, _, _ = _corner_tables(spark)
    number = F.col("k") * 12 + F.col("j") * 4 + F.col("i")
    return grid.filtered(cells.withColumn("active", number % 5 != 0), lambda i, j, k: i + k >= 2).select("k", "j", "i")


_RIDGES = "select p_partkey, p_size % 7 as a1, p_size % 5 as a2, p_partkey % 7 as b1, p_partkey % 4 as b2 from part"


@query(f"""with t as ({_RIDGES}) select p_partkey, a1 <= b1 and a2 <= b2 and (a1 < b1 or a2 < b2) as higher,
  not ((a1 + 2 <= b1 and a2 + 2 <= b2 and (a1 + 2 < b1 or a2 + 2 < b2)) or (a1 + 2 = b1 and a2 + 2 = b2)
    or (b1 + 1 <= a1 and b2 + 1 <= a2 and (b1 + 1 < a1 or b2 + 1 < a2)) or (b1 + 1 = a1 and b2 + 1 = a2)) as touching from t""")
def ridge_order(spark, sf):
    """Ridges of two depths, and faces 2 and 1 high under them."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    down = lambda a, n: F.transform(a, lambda v: v + n)
    t = p.select("p_partkey", F.array(F.col("p_size") % 7, F.col("p_size") % 5).cast("array<long>").alias("a"), F.array(F.col("p_partkey") % 7, F.col("p_partkey") % 4).cast("array<long>").alias("b"))
    a, b = F.col("a"), F.col("b")
    return t.select("p_partkey", grid.above(a, b).alias("higher"), grid.overlap(a, down(a, 2), b, down(b, 1)).alias("touching"))

