"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node every child draws -ln(u) / weight, u being decided by the
child's name and the row's key alone, and the smallest draw wins. A child's share is its weight's share, and a change
of one child's weight changes no other child's draw: rows move only into a child that gained weight or out of one that
lost it, and below an unchanged child nothing moves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_text, uniform, written


@dataclass(frozen=True)
class Node:
    """A region, rack or (with a shard number) leaf. An inner node weighs what its children weigh together."""

    name: str
    shard: int | None = None
    own_weight: float = 0.0
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    @property
    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves] if self.children else [self]


def plan_tree(regions: int, racks: int, shards: int, weight: float = 1.0) -> Node:
    """regions x racks x shards leaves of equal weight, numbered from 0 in that order."""
    numbers = iter(range(regions * racks * shards))
    return Node("", children=tuple(
        Node(f"r{i}", children=tuple(
            Node(f"r{i}.k{j}", children=tuple(Node(f"s{n}", n, weight) for n in (next(numbers) for _ in range(shards))))
            for j in range(racks)))
        for i in range(regions)))


def add_shard(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard in a region of its own, so that no existing subtree changes weight and rows move
    only into the new shard."""
    n = max(x.shard for x in tree.leaves) + 1
    leaf = Node(f"s{n}", n, weight)
    return Node(tree.name, children=(*tree.children, Node(f"g{n}", children=(Node(f"g{n}.k0", children=(leaf,)),))))


def place(key: Column, tree: Node) -> Column:
    """The shard (int) of a key (string) in a tree whose leaves are all equally deep. Children of weight 0 get nothing."""
    level, at = [tree], F.lit(0)
    while level[0].children:
        below = [c for n in level for c in n.children if c.weight > 0]
        number = {c.name: i for i, c in enumerate(below)}
        options = F.array(*[F.array(*[F.struct(F.lit(number[c.name]).alias("i"), F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("w")) for c in n.children if c.weight > 0]) for n in level])
        draws = F.transform(F.element_at(options, at + 1), lambda c: F.struct((-F.ln(uniform(F.concat(c["name"], F.lit("|"), key))) / c["w"]).alias("draw"), c["i"].alias("i")))
        level, at = below, F.array_min(draws)["i"]
    return F.element_at(F.array(*[F.lit(n.shard) for n in level]), at + 1).cast("int")


#: Equal rows that are numbered as one step.
STEP = 65_536


def shard(docs: DataFrame, tree: Node, grown: Node, *, id_col: str = "doc_id", text_col: str = "text", pieces: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard. The law is `key`.

    Slots are gapless from 0 in each shard. A shard's rows are numbered in `pieces` parts by a hash of id and text, each
    part starting where the counts of those before it end, so no task sorts a whole shard, nor the rows of one id; the
    counts are at most shards x pieces rows and so are broadcast. Equal rows are counted before the shuffle and
    numbered as one, then dealt out again in steps.

    A null text has size 16 and crc 0, as the empty one. A null id is a key of its own. Repeated rows get slots of
    their own. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), id_text(F.col(id_col)).alias("key"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ).groupBy("doc_id", "key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    part = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("slot"), "key", F.col("text_crc32").cast("string"), F.col("size").cast("string"))), 1, 5), 16, 10).cast("int") % pieces
    placed = written(rows.select("doc_id", "size", "text_crc32", "n", part.alias("piece"), place(F.col("key"), tree).alias("shard"), place(F.col("key"), grown).alias("grown_shard")), "sharding")
    ends = (
        placed.groupBy("shard", "piece").agg(F.sum("n").alias("m"))
        .select("shard", "piece", (F.sum("m").over(W.partitionBy("shard").orderBy("piece")) - F.col("m")).alias("before"))
    )
    until = F.sum("n").over(W.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0))
    begun = placed.withColumn("turn", until - F.col("n")).join(F.broadcast(ends), ["shard", "piece"])
    at = (F.col("before") + F.col("turn")).cast("long")
    one = begun.where("n = 1").withColumn("slot", at)
    steps = begun.where("n > 1").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STEP).cast("long"))))
    several = steps.repartition("shard", "piece", "turn", "step").withColumn("i", F.explode(F.sequence("step", F.least(F.col("step") + STEP, F.col("n")) - 1))).withColumn("slot", at + F.col("i"))
    columns = ["doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"]
    return one.select(*columns).union(several.select(*columns))


#: Production tree of the query: 40 shards.
PLANNED = plan_tree(2, 4, 5)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), PLANNED, add_shard(PLANNED))


#: CRC-32 in SQL: the table by its polynomial, then a step for each byte. Fixed value: the reversed polynomial.
_CRC = """tab as (select list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as tab),
bytes as (select doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint) as b from docs),
crc as (select doc_id, text, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)))::bigint as text_crc32 from bytes, tab)"""


def _sql(tree: Node, grown: Node, pieces: int = 256) -> str:
    """The same in SQL: a table of each tree's nodes, and the smallest draw among the children at each level."""

    def nodes(root: Node) -> tuple[list[tuple], int]:
        rows, level, depth = [], [root], 0
        while level[0].children:
            depth += 1
            rows += [(depth, n.name, c.name, float(c.weight), -1 if c.shard is None else c.shard) for n in level for c in n.children if c.weight > 0]
            level = [c for n in level for c in n.children if c.weight > 0]
        return rows, depth

    parts = []
    for label, root in (("a", tree), ("g", grown)):
        rows, depth = nodes(root)
        values = ", ".join(f"({d}, '{p}', '{n}', {w!r}, {s})" for d, p, n, w, s in rows)
        parts.append(f"{label}_nodes(depth, parent, name, w, shard) as (values {values})")
        parts.append(f"{label}0 as (select key, '{root.name}' as name, -1 as shard from keys)")
        for d in range(1, depth + 1):
            draw = f"-ln(((('0x' || substr(md5(n.name || '|' || key), 1, 13))::bigint)::double + 0.5) / {float(1 << 52)!r}) / n.w"
            parts.append(
                f"{label}{d} as (select key, arg_min(n.name, {draw}) as name, arg_min(n.shard, {draw}) as shard from {label}{d - 1} t join {label}_nodes n on n.depth = {d} and n.parent = t.name group by key)")
    last = {label: f"{label}{nodes(root)[1]}" for label, root in (("a", tree), ("g", grown))}
    return f"""
with docs as (select doc_id, coalesce(text, '') as text from documents), keys as (select distinct coalesce(doc_id::varchar, 'null') as key from docs),
{_CRC}, {", ".join(parts)},
rows as (
  select doc_id, (strlen(text) + 16)::bigint as size, text_crc32, {last["a"]}.shard::int as shard, {last["g"]}.shard::int as grown_shard,
         ('0x' || substr(md5('slot|' || key || '|' || text_crc32 || '|' || strlen(text) + 16), 1, 5))::bigint % {pieces} as piece
  from crc join {last["a"]} on {last["a"]}.key = coalesce(doc_id::varchar, 'null') join {last["g"]} using (key)
)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by piece, doc_id, text_crc32, size) - 1 as slot, grown_shard from rows
"""


OP8_SQL = _sql(PLANNED, add_shard(PLANNED))
