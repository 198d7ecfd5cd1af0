"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked in turn to the wanted marginals of each until all hold;
documents are then drawn by the probability that their cell's raked weight calls for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, id_text, uniform, written

DIMENSIONS = ("source", "lang", "topic")

#: Topics by what a text contains, the first that fits; `prose` if none does, `empty` for a text without a word.
TOPICS = (
    ("licence", ("icensed under", "icense, ", " License")),
    ("contact", ("@", "+1 (")),
    ("table", (" | ",)),
    ("code", ("();", "{}", " = \"")),
)


@dataclass(frozen=True)
class Settings:
    """Targets by dimension: an exponent, to which the present shares are raised (1: as they are, 0: all equal), or
    shares by name; names that are not given share what is left as they do now. Raking ends when no marginal is off by
    more than the tolerance, or after so many rounds if the targets contradict each other; keep: share of all tokens
    that the sample should have; seed: of the draws; max_cells: up to which the cells are raked on the driver, some 100
    bytes each; beyond, the same steps are done by DataFrames."""

    targets: dict[str, float | dict[str, float]] = field(default_factory=lambda: {"source": 0.7, "lang": 0.6, "topic": 0.8})
    tolerance: float = 1e-10
    rounds: int = 200
    keep: float = 0.5
    seed: str = "mix"
    max_cells: int = 100_000


def topic(text: Column) -> Column:
    found = F.lit("prose")
    for name, marks in reversed(TOPICS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(text, F.lit(m))
        found = F.when(hit, name).otherwise(found)
    return found


def cells_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __source, __lang, __topic and __tokens (words); a null name is the empty one, a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumn("__tokens", F.regexp_count(text, F.lit(WORD)).cast("long"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.withColumns({"__source": name("source"), "__lang": name("lang"), "__topic": F.when(F.col("__tokens") == 0, "empty").otherwise(topic(text))})


def target_shares(names: list[str], tokens: np.ndarray, target: float | dict[str, float]) -> np.ndarray:
    """The wanted shares of the names, which have so many tokens now; they sum to 1."""
    if isinstance(target, dict):
        given = np.array([target.get(n, -1.0) for n in names])
        rest = max(0.0, 1.0 - given[given >= 0].sum())
        other = np.where(given < 0, tokens, 0.0)
        share = np.where(given < 0, rest * other / max(other.sum(), 1e-300), given)
    else:
        share = tokens.astype(float) ** target
    return share / share.sum()


def rake(index: list[np.ndarray], tokens: np.ndarray, shares: list[np.ndarray], rounds: int, tolerance: float = 0.0) -> np.ndarray:
    """Weights of the cells, summing to 1: index gives each cell's name by dimension, shares the wanted marginals. It
    ends when all marginals hold within the tolerance, or after so many rounds."""
    weight = tokens / tokens.sum()
    for _ in range(rounds):
        off = 0.0
        for names, share in zip(index, shares, strict=True):
            now = np.bincount(names, weight, len(share))
            off = max(off, float(np.abs(now - share).max()))
            weight = weight * (share / np.where(now > 0, now, 1))[names]
        if off <= tolerance:
            break
    return weight


def probabilities(weight: np.ndarray, tokens: np.ndarray, keep: float) -> np.ndarray:
    """Of drawing a document of each cell: in proportion to the cell's weight over its tokens, and at most 1, so that
    the expected tokens are `keep` of all, or what the cells with any weight have."""
    ratio = weight * tokens.sum() / tokens
    order = np.argsort(-ratio, kind="stable")
    t, r = tokens[order].astype(float), ratio[order]
    wanted = keep * tokens.sum()
    full = np.cumsum(t) - t  # tokens of the cells before, all kept
    open_ = np.cumsum((r * t)[::-1])[::-1]  # raked tokens of this and the rest
    scale = (wanted - full) / np.maximum(open_, 1e-300)
    fits = np.flatnonzero(scale * r <= 1)
    out = np.ones(len(t))
    if len(fits):
        k = fits[0]
        out[k:] = np.clip(scale[k] * r[k:], 0, 1)
    p = np.empty(len(t))
    p[order] = out
    return p


def _on_driver(counts: DataFrame, s: Settings) -> DataFrame:
    """cell names and p, from the counts of at most max_cells cells with tokens."""
    rows = sorted((tuple(r[f"__{d}"] for d in DIMENSIONS), r["tokens"]) for r in counts.collect())
    tokens = np.array([t for _, t in rows], float)
    index, shares = [], []
    for i, d in enumerate(DIMENSIONS):
        names, at = np.unique(np.array([c[i] for c, _ in rows], dtype=object).astype(str), return_inverse=True)
        index.append(at)
        shares.append(target_shares(names.tolist(), np.bincount(at, tokens), s.targets[d]))
    p = np.round(probabilities(rake(index, tokens, shares, s.rounds, s.tolerance), tokens, s.keep), 6)
    schema = ", ".join([*(f"__{d} string" for d in DIMENSIONS), "p double"])
    return counts.sparkSession.createDataFrame([(*c, float(x)) for (c, _), x in zip(rows, p, strict=True)], schema)


def _on_executors(counts: DataFrame, s: Settings) -> DataFrame:
    """As _on_driver(), for any number of cells: marginals are pre-aggregated and joined back. The shared scale rises
    until it takes no more cells to a probability of 1, which ends in the same scale."""
    cells = written(counts, "mix-cells")
    total = float(cells.agg(F.sum("tokens")).first()[0])
    for d in DIMENSIONS:
        target = s.targets[d]
        marginal = cells.groupBy(f"__{d}").agg(F.sum("tokens").cast("double").alias("t"))
        if isinstance(target, dict):
            given = F.element_at(F.create_map(*[F.lit(x) for kv in target.items() for x in kv]), F.col(f"__{d}"))
            marginal = marginal.withColumn("given", given)
            sums = marginal.agg(F.sum("given"), F.sum(F.when(F.col("given").isNull(), F.col("t")))).first()
            share = F.coalesce("given", F.lit(max(0.0, 1.0 - (sums[0] or 0.0))) * F.col("t") / F.lit(sums[1] or 1.0))
        else:
            share = F.pow("t", F.lit(float(target)))
        marginal = written(marginal.select(f"__{d}", share.alias("share")), "mix-shares")
        whole = marginal.agg(F.sum("share")).first()[0]
        cells = cells.join(marginal.select(f"__{d}", (F.col("share") / whole).alias(f"{d}_share")), f"__{d}")
    cells = written(cells.withColumn("weight", F.col("tokens") / total), "mix-cells")
    for _ in range(s.rounds):
        off = []
        for d in DIMENSIONS:
            sums = written(cells.groupBy(f"__{d}").agg(F.sum("weight").alias("sum"), F.first(f"{d}_share").alias("share")), "mix-sums")
            off.append(float(sums.agg(F.max(F.abs(F.col("sum") - F.col("share")))).first()[0]))
            cells = cells.join(sums.drop("share"), f"__{d}").withColumn("weight", F.when(F.col("sum") > 0, F.col("weight") * (F.col(f"{d}_share") / F.col("sum"))).otherwise(0.0)).drop("sum")
        cells = written(cells, "mix-cells")
        if max(off) <= s.tolerance:
            break
    ratio = F.col("weight") * total / F.col("tokens")
    high, before = 0.0, -1.0
    while high > before:  # each step solves the scale for the cells that were below 1 with the last one
        full = ratio * high >= 1
        sums = cells.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, ratio * F.col("tokens")))).first()
        before, high = high, high if not sums[1] else max(high, (s.keep * total - (sums[0] or 0.0)) / sums[1])
    return written(cells.select(*[f"__{d}" for d in DIMENSIONS], F.round(F.least(ratio * high, F.lit(1.0)), 6).alias("p")), "mix-p")


def mix(docs: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __source, __lang, __topic, __tokens, __p (the probability) and __kept (the draw).

    The draw is decided by the id and the seed, so rows that repeat an id are drawn together if their cell is the
    same. A document without a word has no weight and is kept with the share `keep`. Null sources and languages are
    names of their own. An empty table gives no rows.
    """
    s = settings
    rows = cells_of(docs, text_col)
    names = [f"__{d}" for d in DIMENSIONS]
    counts = written(rows.where("__tokens > 0").groupBy(*names).agg(F.sum("__tokens").alias("tokens")), "mix-counts")
    number = counts.count()
    if number == 0:
        p = counts.select(*names, F.lit(None).cast("double").alias("p"))
    elif number <= s.max_cells:
        p = F.broadcast(_on_driver(counts, s))  # max_cells rows at most
    else:
        p = _on_executors(counts, s)
    drawn = uniform(F.concat(F.lit(f"{s.seed}|"), id_text(F.col(id_col))))
    joined = rows.join(p.withColumnRenamed("p", "__p"), names, "left").withColumn("__p", F.coalesce("__p", F.lit(s.keep)))
    return joined.withColumn("__kept", drawn < F.col("__p"))


def calibration(mixed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """dimension, name, tokens, target, expected, drawn of a result of mix(): a name's wanted share of the tokens, that
    which the probabilities give, and that of the documents drawn. Expected differs from the target where cells have
    too few tokens: their probability is 1 at most."""
    out, whole = None, W.partitionBy(F.lit(0))  # over tables of a row for each name
    for d in DIMENSIONS:
        target = settings.targets[d]
        sums = mixed.where("__tokens > 0").groupBy(F.col(f"__{d}").alias("name")).agg(
            F.sum("__tokens").alias("tokens"), F.sum(F.col("__tokens") * F.col("__p")).alias("e"), F.sum(F.when(F.col("__kept"), F.col("__tokens"))).alias("k"))
        if isinstance(target, dict):
            given = F.element_at(F.create_map(*[F.lit(x) for kv in target.items() for x in kv]), F.col("name")) if target else F.lit(None).cast("double")
            rest = F.when(given.isNull(), F.col("tokens"))
            left = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum(given).over(whole), F.lit(0.0)))
            share = F.coalesce(given, left * rest / F.sum(rest).over(whole))
        else:
            share = F.pow(F.col("tokens").cast("double"), F.lit(float(target)))
        sums = sums.withColumn("share", share)
        part = lambda c: F.coalesce(F.col(c) / F.sum(c).over(whole), F.lit(0.0))
        one = sums.select(F.lit(d).alias("dimension"), "name", "tokens", part("share").alias("target"), part("e").alias("expected"), part("k").alias("drawn"))
        out = one if out is None else out.union(one)
    return out


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return found.select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"), F.col("__p").alias("probability"), F.col("__kept").alias("kept"),
    )


#: Rounds that the SQL has; by then the operator has ended on the test tables.
ROUNDS = 30


def _sql(s: Settings) -> str:
    """The same in SQL, its rounds written out."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    cases = "\n".join(f"    when {' or '.join(f'contains(t, {quote(m)})' for m in marks)} then '{name}'" for name, marks in TOPICS)
    steps, at = [], "base"
    for r in range(ROUNDS):
        for d in DIMENSIONS:
            steps.append(f"r{r}_{d} as (select * replace (w * {d}_share / sum(w) over (partition by {d}) as w) from {at})")
            at = f"r{r}_{d}"
    shares = ", ".join(f"{d}_m as (select {d}, pow(sum(tok), {s.targets[d]}) / sum(pow(sum(tok), {s.targets[d]})) over () as {d}_share from cells group by {d})" for d in DIMENSIONS)
    return f"""
with texts as (
  select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as t,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as n_tokens
  from documents
), docs as (
  select doc_id, source, lang, n_tokens, case when n_tokens = 0 then 'empty'
{cases}
    else 'prose' end as topic
  from texts
), cells as (
  select source, lang, topic, sum(n_tokens)::double as tok from docs where n_tokens > 0 group by all
), {shares}, base as (
  select cells.*, tok / sum(tok) over () as w, {", ".join(f"{d}_share" for d in DIMENSIONS)}
  from cells {" ".join(f"join {d}_m using ({d})" for d in DIMENSIONS)}
), {", ".join(steps)}, ratios as (
  select source, lang, topic, tok, w * sum(tok) over () / tok as ratio, {s.keep} * sum(tok) over () as wanted from {at}
), running as (
  select *, sum(tok) over (order by ratio desc, source, lang, topic rows unbounded preceding) - tok as before,
         sum(ratio * tok) over (order by ratio desc, source, lang, topic rows between current row and unbounded following) as open,
         row_number() over (order by ratio desc, source, lang, topic) as k
  from ratios
), scaled as (select *, (wanted - before) / open as scale from running),
first_open as (select k as k0, scale as s0 from scaled where scale * ratio <= 1 order by k limit 1),
p as (
  select source, lang, topic, round(case when k < k0 then 1 else least(1, s0 * ratio) end, 6) as p from scaled, first_open
)
select doc_id, docs.source, docs.lang, docs.topic, n_tokens, coalesce(p, {s.keep}) as probability,
       ((('0x' || substr(md5('{s.seed}|' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint)::double + 0.5) / {float(1 << 52)} < coalesce(p, {s.keep}) as kept
from docs left join p using (source, lang, topic)
"""


OP3_SQL = _sql(Settings())
