"""Personal data: fixed patterns, and terms that give the protected entities away.

Patterns find the protected entities. A term in an entity's document discloses it by their pointwise mutual information,
estimated from how many documents of the corpus hold both; as a share of the entity's own information (1: who sees
the term knows the entity) it decides whether the term stays, is generalised or is removed. Everything is DataFrame
expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_text, written

#: The kinds in their order, with patterns for Java. They match what the plain patterns of the contract match; the
#: look-behinds and possessive repeats only keep the search linear. A card's pattern takes the maximal runs of digits
#: that have 12 or more.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}[\p{L}\p{N}]*+"

#: Lengths of the parts in which running values are built, and of those in which a long text is cut (code points).
PART, PIECE = 256, 4096
#: Different texts in which an entity, and a term with it, must occur for the estimate to count: the text that is judged
#: and another. Of an entity in a single text nothing else in the corpus says what its terms disclose.
SUPPORT = 2
#: Shares of an entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Distinct terms up to which they are broadcast (some 30 bytes each); beyond, terms are counted before the join.
BROADCAST_TERMS = 200_000


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row, however often body has it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """step's inclusive running results over an array of longs, from 0 on, in parts, so that long arrays don't cost their square."""
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")

    def plain(xs: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), none.alias("out"))
        one = lambda a, v: bound(step(a["at"], v), lambda x: F.struct(x.alias("at"), F.concat(a["out"], F.array(x)).alias("out")))
        return F.aggregate(xs, start, one, lambda a: a["out"])

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda b: F.slice(v, b * PART + 1, F.lit(PART)))
        begins = lambda xs: F.concat(F.array(zero), plain(F.transform(xs, lambda x: F.aggregate(x, zero, step)), zero))
        return bound(parts, lambda xs: bound(begins(xs), lambda at: F.flatten(F.transform(xs, lambda x, i: plain(x, F.get(at, i))))))

    return bound(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def running_sum(values: Column) -> Column:
    """The inclusive running sums of an array of longs."""
    return _running(values, lambda a, v: a + v)


def running_max(values: Column) -> Column:
    """The inclusive running maxima, 0 at least, of an array of longs."""
    return _running(values, lambda a, v: F.greatest(a, v))


def occurrences(text: Column, pattern: str, gate: Column) -> Column:
    """The matches of pattern in a text as array<struct<start, end, value>>, positions in code points. Rows that fail
    the gate have none and are not searched."""
    long = lambda c: F.length(c).cast("bigint")

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), long)
        ends = bound(gaps, lambda g: running_sum(F.transform(found, lambda v, i: long(v) + F.get(g, i))))
        return F.zip_with(found, ends, lambda v, e: F.struct((e - long(v)).alias("start"), e.alias("end"), v.alias("value")))

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    found = F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return bound(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(none))


def _covers(spans: Column) -> Column:
    """Sorted spans as disjoint ones: of spans that overlap the first stands for all, and ends where the last one does."""

    def disjoint(s: Column, reach: Column) -> Column:
        each = F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["value"].alias("value"), F.coalesce(F.get(reach, i - 1), F.lit(0).cast("bigint")).alias("before")))
        heads = F.filter(each, lambda x: x["start"] >= x["before"])
        end = lambda hs, i: F.coalesce(F.get(hs, i + 1)["before"], F.get(reach, F.size(reach) - 1))
        return bound(heads, lambda hs: F.transform(hs, lambda h, i: F.struct(h["start"].alias("start"), end(hs, i).alias("end"), h["kind"].alias("kind"), h["value"].alias("value"))))

    return bound(spans, lambda s: bound(running_max(F.transform(s, lambda x: x["end"])), lambda reach: disjoint(s, reach)))


def _rewritten(text: Column, covers: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with mark(span) in place of each of the disjoint spans. The text is cut into pieces once, so that a
    span costs a piece and not the text before it."""
    number = lambda c: F.floor(c / PIECE).cast("int")

    def part(pieces: Column, a: Column, b: Column) -> Column:
        i, j = number(a), number(b - 1)
        begin = F.substring(F.get(pieces, i), (a % PIECE + 1).cast("int"), F.least(b - a, F.lit(PIECE)).cast("int"))
        between = F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        return F.when(b <= a, "").when(i == j, begin).otherwise(F.concat(begin, between, F.substring(F.get(pieces, j), F.lit(1), (b - j.cast("bigint") * PIECE).cast("int"))))

    def whole(pieces: Column, c: Column) -> Column:
        after = lambda i: F.coalesce(F.get(c, i)["end"], F.lit(0).cast("bigint"))
        each = F.transform(c, lambda s, i: F.concat(part(pieces, after(i - 1), s["start"]), mark(s)))
        return F.concat(F.array_join(each, ""), part(pieces, after(F.size(c) - 1), F.length(text).cast("bigint")))

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: bound(covers, lambda c: whole(pieces, c)))


def _blanked(text: Column, base: Column) -> Column:
    """The text with blanks in place of its entities."""
    return F.when(F.size(base) == 0, text).otherwise(_rewritten(text, _covers(base), lambda s: F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int"))))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + weigh(i)) % 10 == 0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The entities that the patterns find, as array<struct<start, rank, end, kind, value>> in order; a match that
    fails its kind's test is dropped, and nothing inside it is looked for."""
    digit = text.rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}

    def valid(rank: int, kind: str) -> Column:
        held = F.filter(occurrences(text, PATTERNS[kind], gates[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(held, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))

    return F.array_sort(F.concat(*[valid(i, k) for i, k in enumerate(PATTERNS)]))


def _holders(held: DataFrame, scratch: Scratch) -> DataFrame:
    """__id, __hash, kind, entity, w, n_e for each entity that occurs in SUPPORT different texts, and each id and text
    that holds it; w: the rows of this id and text, n_e: all rows that hold the entity. held: the rows with entities."""
    entity = lambda s: F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"]))
    each = F.array_distinct(F.transform("__base", lambda s: F.struct(s["kind"].alias("kind"), entity(s).alias("entity"))))
    one = held.select("__id", "__hash", F.inline(each)).groupBy("__id", "__hash", "kind", "entity").agg(F.count(F.lit(1)).alias("w"))
    one = scratch.written(one, "entities")
    strong = one.groupBy("kind", "entity").agg(F.countDistinct("__hash").alias("texts"), F.sum("w").alias("n_e")).where(F.col("texts") >= SUPPORT)
    return scratch.written(one.join(strong.drop("texts"), ["kind", "entity"]).select("__id", "__hash", "kind", "entity", "w", "n_e"), "holders")


def _terms(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosing(rows: DataFrame, holders: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """__hash, term, value for every term of a text that discloses an entity of it, with the action; rows: all documents,
    with __text and __base; texts: __hash and __rest, the texts with holders' entities without their entities.

    share is the mutual information of term and entity over the entity's information, log2 of inverse frequencies of
    documents. All of them (n documents, n_e with the entity, n_t with the term outside entities, n_te with both) are
    counted over all documents, whole. Entities and pairs in fewer than SUPPORT different texts give no estimate.

    As n_te is n_e at most, a share of GENERALISE takes n_t <= n_e (n / n_e) ** (1 - GENERALISE): terms are counted before
    they meet entities, and only those pairs are made that can disclose.
    """
    n = float(max(rows.count(), 1))
    most = lambda n_e: n_e * F.pow(F.lit(n) / n_e, F.lit(1 - GENERALISE)) * (1 + 1e-6)
    entities = holders.groupBy("__hash", "kind", "entity", "n_e").agg(F.sum("w").alias("w"))
    each = scratch.written(texts.select("__hash", F.explode(_terms(F.col("__rest"))).alias("term")), "terms")
    wanted = scratch.written(each.groupBy("term").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT).select("term"), "wanted")
    every = rows.select(F.explode(_terms(_blanked(F.col("__text"), F.col("__base")))).alias("term"))
    count = lambda w: w.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    few = wanted.count()
    if few == 0:
        seen = wanted.withColumn("n_t", F.lit(0).cast("long"))
    elif few <= BROADCAST_TERMS:
        seen = count(every.join(F.broadcast(wanted), "term", "left_semi"))
    else:
        seen = count(every).join(wanted, "term", "left_semi")
    top = holders.agg(F.max(most(F.col("n_e")))).first()[0] or 0.0
    rare = scratch.written(seen.where(F.col("n_t") <= top), "rare")
    rare = F.broadcast(rare) if rare.count() <= BROADCAST_TERMS else rare
    met = each.join(rare, "term").join(entities, "__hash").where(F.col("n_t") <= most(F.col("n_e")))
    met = scratch.written(met, "met")
    pairs = met.groupBy("kind", "entity", "n_e", "term", "n_t").agg(F.count(F.lit(1)).alias("texts"), F.sum("w").alias("n_te")).where(F.col("texts") >= SUPPORT)
    own = F.log2(F.lit(n) / F.col("n_e"))
    mutual = F.log2(F.lit(n) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    share = F.when(own > 0, mutual / own)
    action = F.when(share >= REMOVE, "remove").when(share >= GENERALISE, "generalise")
    found = pairs.select("kind", "entity", "term", action.alias("value")).where("value is not null")
    # a term that discloses several of a document's entities takes the stronger action
    return met.select("__hash", "kind", "entity", "term").join(found, ["kind", "entity", "term"]).groupBy("__hash", "term").agg(F.max("value").alias("value"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __text (the text, null as empty), __base and __terms, both array<struct<start, rank, end, kind,
    value>>: the entities, and the terms that disclose them; a term's value is the action.

    The texts are searched once; rows and entities are kept as a table in the shared folder. Terms are those of the
    text with its entities blanked out; where one discloses an entity of the document, it is marked wherever it stands.
    Rows are told apart by id and text; rows that repeat both get the same spans. A null id is an id of its own. An
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__id": id_text(F.col(id_col)), "__hash": F.xxhash64(text), "__base": base_spans(text)})
    rows = written(keyed, "pii-rows").withColumn("__text", text)
    held = rows.where(F.size("__base") > 0)
    with Scratch(docs.sparkSession, "pii") as scratch:
        holders = _holders(held.select("__id", "__hash", "__base"), scratch)
        some = held.select("__id", "__hash", "__text", "__base").join(holders.select("__id", "__hash").distinct(), ["__id", "__hash"], "left_semi")
        # equal texts have the same entities and terms: from here on a text stands for all rows that hold it
        once = some.groupBy("__hash").agg(F.first("__text").alias("__text"), F.first("__base").alias("__base"))
        texts = scratch.written(once.select("__hash", _blanked(F.col("__text"), F.col("__base")).alias("__rest")), "texts")
        told = scratch.written(disclosing(rows, holders, texts, scratch), "told")
        place = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lower(m["value"]).alias("value"))
        words = texts.join(told.select("__hash").distinct(), "__hash", "left_semi")
        words = words.select("__hash", F.explode(F.transform(occurrences(F.col("__rest"), TERM, F.lit(True)), place)).alias("t"))
        words = words.withColumn("term", F.col("t.value")).join(told, ["__hash", "term"])
        span = F.struct(F.col("t.start").alias("start"), F.lit(len(PATTERNS)).alias("rank"), F.col("t.end").alias("end"), F.lit("term").alias("kind"), F.col("value"))
        extra = written(words.select("__hash", span.alias("span")).groupBy("__hash").agg(F.array_sort(F.collect_list("span")).alias("__terms")), "pii-spans")
    none = F.array().cast(extra.schema["__terms"].dataType)
    marked = held.join(extra, "__hash", "left").withColumn("__terms", F.coalesce("__terms", none))
    plain = rows.where(F.size("__base") == 0).withColumn("__terms", none)
    return marked.select(*plain.columns).union(plain).drop("__id", "__hash")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, their columns as they are but the text: entities become [EMAIL], [IP], [CARD], [PHONE], generalised terms
    [TERM], removed terms nothing. Of overlapping spans the first stands for all. A null text stays null."""
    found = find(docs, id_col=id_col, text_col=text_col)
    spans = F.array_sort(F.concat("__base", "__terms"))
    mark = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"] == "generalise", "[TERM]").otherwise("")
    clean = F.when(F.size("__base") == 0, F.col(text_col)).otherwise(_rewritten(F.col("__text"), _covers(spans), mark))
    return found.withColumn(text_col, clean).select(*docs.columns)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[number(k) for k in PATTERNS], F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("__base", "__terms"))).alias("spans"), F.size("__base").cast("long").alias("n_personal"),
    )


#: The contract's plain patterns; RE2 searches them in linear time as they are.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _sql() -> str:
    """The same in SQL."""

    def places(source: str, text: str, pattern: str) -> str:
        """source's columns with s, e, v of each match."""
        found = f"(select *, regexp_extract_all({text}, '{pattern}', 0) as f, regexp_split_to_array({text}, '{pattern}') as g from {source})"
        one = f"(select *, unnest(generate_series(1, len(f))) as m from {found} where len(f) > 0)"
        begin = "list_sum(list_transform(g[1:m], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:m - 1], lambda x: length(x))), 0)"
        return f"(select * exclude (f, g, m), ({begin})::bigint as s, ({begin} + length(f[m]))::bigint as e, f[m] as v from {one})"

    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    digit = "substr(reverse(d), i, 1)::int"
    luhn = f"list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 1 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end)) % 10 = 0"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(ltrim(x, '0') as int), 0) > 255)) = 0",
        "card": f"length(d) between 12 and 19 and {luhn}",
        "phone": "length(d) between 9 and 15",
    }
    base = " union all ".join(
        f"select id, t, '{k}' as kind, {i} as rank, s, e, v from (select *, {digits} as d from {places('keyed', 't', p)}) where {valid[k]}" for i, (k, p) in enumerate(PLAIN.items()))
    term = TERM.replace("*+", "*")
    spelt = "string_agg(kind || ':' || s || ':' || e, ',' order by s, rank, e)"
    return f"""
with docs as (select doc_id, coalesce(doc_id::varchar, 'null') as id, coalesce(text, '') as t from documents),
keyed as (select id, t, count(*) as w from docs group by all), base as ({base}),
blanked as (
  select id, t, keyed.w, l is not null as held, case when l is null then t else array_to_string(list_transform(regexp_extract_all(t, '(?s).'),
         lambda c, i: case when len(list_filter(l, lambda x: x.s < i and i <= x.e)) > 0 then ' ' else c end), '') end as u
  from keyed left join (select id, t, list({{'s': s, 'e': e}}) as l from base group by all) using (id, t)
), entities as (
  select distinct id, t, w, kind, case when kind in ('card', 'phone') then {digits} else lower(v) end as entity from base join keyed using (id, t)
), strong as (
  select kind, entity, sum(w)::double as n_e from entities group by all having count(distinct t) >= {SUPPORT}
), words as (
  select id, t, w, s, e, lower(v) as term from {places("(select * from blanked where held)", "u", term)}
), pairs as (
  select kind, entity, n_e, term, sum(w)::double as n_te from (select distinct id, t, term from words) join entities using (id, t) join strong using (kind, entity)
  group by all having count(distinct t) >= {SUPPORT}
), seen as (
  select term, sum(w)::double as n_t from (select w, unnest(list_distinct(list_transform(regexp_extract_all(u, '{term}'), lambda x: lower(x)))) as term from blanked)
  where term in (select term from pairs) group by term
), shares as (
  select *, log2((select count(*) from docs) * n_te / (n_t * n_e)) / nullif(log2((select count(*) from docs) / n_e), 0) as share from pairs join seen using (term)
), told as (
  select id, t, s, e from (select distinct id, t, s, e, term from words) join entities using (id, t) join shares using (kind, entity, term)
  where share >= {GENERALISE} and n_e < (select count(*) from docs) group by all
), base_text as (
  select id, t, {spelt} as spelt, count(*) as n_personal, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in PLAIN)} from base group by all
), all_text as (
  select id, t, {spelt} as spelt from (select id, t, kind, rank, s, e from base union all select id, t, 'term', {len(PLAIN)}, s, e from told) group by all
)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in PLAIN)}, sha256(coalesce(b.spelt, '')) as base_sha256, coalesce(a.spelt, '') as spans, coalesce(n_personal, 0) as n_personal
from docs left join base_text b using (id, t) left join all_text a using (id, t)
"""


OP10_SQL = _sql()
