"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles keeps both its smallest and its largest value, so one evaluation gives two signature
values that agree with the probability of the sets' similarity. Smallest and largest values are banded apart; two
documents that share a band are candidates, and every link is confirmed on the full sets.

With 304 permutations in bands of 8 values there are 76 bands, and a pair at a similarity of 0.8 shares none with
probability (1 - 0.8^8)^76, below one in a million; a pair at 0.3 shares one with probability 0.005.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, sections, small_batches, written
from .components import components

#: Bytes of text per chunk; bounds a worker's memory, not its results.
BYTES_AT_ONCE = 500_000
ROWS, GROUPS = 8, 38

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles of many texts at once, from their UTF-8 bytes."""

    #: Words longer than this are hashed one by one, by BLAKE2b.
    LONG = 256

    def __init__(self, words: int) -> None:
        self.words = words
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def word_hashes(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The hash of each word of the lower-cased data: its length and its bytes, 8 at a time, each mixed in."""
        size = stop - start
        value = _mix(size.astype(np.uint64) * _ODD)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        todo, k = np.flatnonzero(size <= self.LONG), 0
        while len(todo):
            block = padded[(start[todo] + 8 * k)[:, None] + np.arange(8)].view("<u8")[:, 0]
            left = size[todo] - 8 * k
            value[todo] = _mix(value[todo] * _ODD + (block & self.mask[np.minimum(left, 8)]) + np.uint64(k + 1))
            todo, k = todo[left > 8], k + 1
        for i in np.flatnonzero(size > self.LONG).tolist():
            digest = hashlib.blake2b(data[start[i] : stop[i]].tobytes(), digest_size=8).digest()
            value[i] = int.from_bytes(digest, "little")
        return value

    def sets(self, data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The sorted distinct shingles (uint64) of each text; data: all texts' bytes, ends: where each ends."""
        n, texts = len(data), len(ends)
        if not n:
            return [np.zeros(0, np.uint64)] * texts
        begins = np.concatenate([[0], ends[:-1]])
        is_word = ~self.space[data]
        edge = np.zeros(n + 1, bool)  # positions where a text begins, so that no word crosses
        edge[begins[begins < n]] = True
        before = np.concatenate([[False], is_word[:-1]])
        start = np.flatnonzero(is_word & (~before | edge[:-1]))
        after = np.concatenate([is_word[1:], [False]])
        stop = np.flatnonzero(is_word & (~after | edge[1:])) + 1
        word = self.word_hashes(self.lower[data], start, stop)
        first = np.searchsorted(start, begins)
        last = np.append(first[1:], len(start))
        count = last - first
        # chained over 1, 2, ... words from each position on
        chain = _mix(word + np.uint64(1))
        short = {}
        for k in range(1, self.words):
            short[k] = chain
            following = np.concatenate([word[k:], np.zeros(min(k, len(word)), np.uint64)])
            chain = _mix(chain * _ODD + following)
        out = []
        for a, b, m in zip(first.tolist(), last.tolist(), count.tolist(), strict=True):
            if m >= self.words:
                out.append(np.unique(chain[a : b - self.words + 1]))
            else:
                out.append(short[m][a : a + 1] if m else np.zeros(0, np.uint64))
        return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow text column's bytes one after another, and where each row ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sections(pa.compute.binary_length(batch.column(1)).to_pylist(), BYTES_AT_ONCE):
            yield batch.slice(part.start, part.stop - part.start)


class MinMax:
    """Signatures of both extremes of x * a + b modulo 2^32, for GROUPS groups of ROWS odd a's."""

    def __init__(self) -> None:
        draw = _mix(np.arange(1, 2 * ROWS * GROUPS + 1, dtype=np.uint64) * _ODD)
        self.a = (draw[: ROWS * GROUPS] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.b = (draw[ROWS * GROUPS :] >> np.uint64(32)).astype(np.uint32)[:, None]

    def signature(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = high = None
        for i in range(0, len(x), 2048):
            y = x[None, i : i + 2048] * self.a + self.b
            p, q = y.min(1), y.max(1)
            low, high = (p, q) if low is None else (np.minimum(low, p), np.maximum(high, q))
        return low, high

    def bands(self, sets: list[np.ndarray]) -> np.ndarray:
        """The 2 x GROUPS band hashes (int64) of each set."""
        values = np.array([np.concatenate(self.signature(s)) for s in sets], np.uint64).reshape(len(sets), 2 * GROUPS, ROWS)
        out = np.broadcast_to(_mix(np.arange(2 * GROUPS, dtype=np.uint64) + _ODD), (len(sets), 2 * GROUPS))
        for r in range(ROWS):
            out = _mix(out * _ODD + values[:, :, r])
        return out.view(np.int64)


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, two halves of a digest of the set (null if it is empty) and the band hashes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minmax = Shingler(words), MinMax()
        for batch in _chunks(batches):
            sets = shingler.sets(*_bytes(batch.column(1)))
            size = np.array([len(s) for s in sets])
            full = np.flatnonzero(size)
            a, b = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            band = np.zeros((0, 2 * GROUPS), np.int64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.cumsum(size[full]) - size[full]
                a[full] = np.add.reduceat(_mix(flat ^ _ODD), at).view(np.int64)
                b[full] = np.add.reduceat(_mix(flat + _ODD), at).view(np.int64)
                band = minmax.bands([sets[i] for i in full])
            offsets = np.concatenate([[0], np.cumsum((size > 0) * 2 * GROUPS)]).astype(np.int32)
            none = size == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(a, mask=none), pa.array(b, mask=none), pa.ListArray.from_arrays(pa.array(offsets), pa.array(band.ravel()))],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _sets(ids: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id and shingles (array<long>) of the documents in ids, built again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in _chunks(batches):
            sets = shingler.sets(*_bytes(batch.column(1)))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "shingles"])

    return _texts(docs, id_col, text_col).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(100 * both >= percent * (F.size("a_set") + F.size("b_set") - both)).select("a", "b").distinct()
    )


#: Counters by which shingles are ordered from rare to common; what the driver gathers is one number for each.
COUNTERS = 1 << 20


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, token, place: the rarest shingles of each set, so many that two sets that are similar enough share one.

    Any order that all sets agree on is right; rare first makes shared ones few. Shingles are ordered by how often
    their counter (one of COUNTERS, by hash) occurs in these sets, then by value."""
    spark = sets.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["counter", "n"])

    counts = sets.select("shingles").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)
    often[np.asarray(counts["counter"])] = np.asarray(counts["n"])
    shared = spark.sparkContext.broadcast(often)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens, places = [], [], []
            for key, xs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = xs.values.to_numpy()
                n = len(x) + (-percent * len(x)) // 100 + 1
                tokens.append(x[np.lexsort((x, shared.value[x & (COUNTERS - 1)]))[:n]])
                ids.append(np.full(n, key))
                places.append(np.arange(n))
            join = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))
            yield pa.RecordBatch.from_arrays([join(ids), join(tokens), join(places)], ["doc_id", "token", "place"])

    return sets.mapInArrow(pick, "doc_id long, token long, place long")


def _in_runs(banded: DataFrame) -> DataFrame:
    """band, doc_id, n, hub, hub_n, prev, prev_n, border of the rows (band, doc_id, n) whose band has several, with some
    that are alone in theirs: hub is the first of the band's rows (by id) in a range, prev the one before.

    Rows are dealt by ranges of band and id, so that a band of any size is spread over as many tasks as its rows call
    for. Where a range begins or ends within a band (border), the band's hubs are to be held against each other."""

    names = ["band", "doc_id", "n", "hub", "hub_n", "prev", "prev_n", "border"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = np.zeros((8, 0), np.int64), None  # the last row, kept back until the next is known, and whether it goes on its band
        for batch in batches:
            if not len(batch):
                continue
            rows = np.concatenate([held[:3], np.array([np.asarray(c) for c in batch.columns])], 1)
            first = rows[0, 0] if first is None else first
            goes_on = np.concatenate([[False], rows[0, 1:] == rows[0, :-1]])
            at = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(goes_on))))
            hub, prev = rows[1:, at], np.where(goes_on, np.roll(rows[1:], 1, 1), rows[1:])
            if held.shape[1]:
                hub[:, at == 0], prev[:, 0], goes_on[0] = held[3:5], held[5:7, 0], held[7, 0]
            border = rows[0] == first
            out = np.concatenate([rows, hub, prev, [np.where(np.arange(len(border)) < len(border) - 1, border, goes_on)]])
            several = (goes_on | np.append(goes_on[1:], False) | border)[:-1]
            held = out[:, -1:]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out[:7, :-1][:, several]), pa.array(out[7, :-1][several].astype(bool))], names)
        if held.shape[1]:
            yield pa.RecordBatch.from_arrays([*map(pa.array, held[:7]), pa.array([True])], names)

    spark = banded.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = banded.select("band", "doc_id", "n").repartitionByRange(parts, "band", "doc_id").sortWithinPartitions("band", "doc_id")
    return dealt.mapInArrow(run, "band long, doc_id long, n long, hub long, hub_n long, prev long, prev_n long, border boolean")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents link if 100 x the intersection of their shingle sets is at least percent x the union; a component is
    what links reach, its id the smallest doc_id in it, and kept is the row of that id.

    Documents with equal sets stand as one, the one of the smallest id. In each band bucket every member is compared
    with the smallest member and with the one before it, in the part of the bucket that its task has, and the parts'
    smallest with the smallest of all. Then, of buckets whose members are still in several
    components, the members outside the most frequent one are held against all members of such buckets by exact
    prefix filtering: similar sets share one of their rarest shingles, early enough in both that the rest suffices.
    So no link between components is left unseen, whatever a bucket's size, and the pairs inside a group of near
    copies are not written out.

    A null or blank text has an empty set and links with nothing. A text of fewer words than a shingle is one shingle.
    A row with a null id links with nothing, has a null component and is kept. Rows that repeat an id are one document
    whatever text links it: with equal texts they get the same component each, with several texts each gets that of its
    own. Other columns are ignored; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession, "near") as scratch:
        small_batches(docs.sparkSession)
        compatible = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
        found = scratch.written(signatures(docs, words, id_col, text_col), "signatures")
        sets = found.where(F.col("set_a").isNotNull() & F.col("doc_id").isNotNull())
        groups = scratch.written(sets.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("stand"), F.max("doc_id").alias("last")).where("stand <> last"), "groups")
        copies = scratch.written(sets.select("doc_id", "set_a", "set_b").join(groups.drop("last"), ["set_a", "set_b"]).where("doc_id <> stand").distinct(), "copies")
        banded = sets.join(copies, ["doc_id", "set_a", "set_b"], "left_anti").select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))

        members = scratch.written(_in_runs(banded), "members")
        # a band that ranges part has a hub in each; all are held against the first of them
        parted = members.where("border").select("band", "hub", "hub_n").distinct()
        hubs = parted.groupBy("band").agg(F.min(F.struct("hub", "hub_n")).alias("first"))
        between = parted.join(hubs, "band").select(F.col("first.hub").alias("a"), F.col("first.hub_n").alias("a_n"), F.col("hub").alias("b"), F.col("hub_n").alias("b_n"))
        within = [members.select(F.col(c).alias("a"), F.col(f"{c}_n").alias("a_n"), F.col("doc_id").alias("b"), F.col("n").alias("b_n")) for c in ("hub", "prev")]
        tried = between.union(within[0]).union(within[1]).where(F.col("a") != F.col("b")).where(compatible(F.col("a_n"), F.col("b_n"))).select("a", "b").distinct()
        tried = scratch.written(tried, "pairs")
        ids = lambda pairs: scratch.written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "near-ids")
        links = scratch.written(_confirmed(tried, scratch.written(_sets(ids(tried), docs, words, id_col, text_col), "near-sets"), percent), "links")
        labels = components(links, scratch)

        known = members.select("band", "doc_id", "n").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        known = known.select("band", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
        counts = known.groupBy("band", "component").agg(F.count(F.lit(1)).alias("m"))
        open_bands = counts.groupBy("band").agg(F.max(F.struct("m", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m")).where("parts > 1 and m > 2")
        inside = known.join(open_bands.select("band", "main"), "band").groupBy("doc_id").agg(
            F.max("n").alias("n"), F.max("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("odd"))
        inside = scratch.written(inside, "open")
        if not inside.isEmpty():
            sets = scratch.written(_sets(inside.select("doc_id"), docs, words, id_col, text_col), "near-sets")
            tokens = _prefixes(sets, percent).join(inside, "doc_id").withColumn("left", F.col("n") - F.col("place"))
            odd = tokens.where("odd").select("token", *[F.col(c).alias(f"odd_{c}") for c in ("doc_id", "n", "left", "component")])
            enough = F.least("left", "odd_left") * (100 + percent) >= percent * (F.col("n") + F.col("odd_n"))
            rest = tokens.join(odd, "token").where((F.col("component") != F.col("odd_component")) & compatible(F.col("n"), F.col("odd_n")) & enough)
            rest = rest.select(F.least("odd_doc_id", "doc_id").alias("a"), F.greatest("odd_doc_id", "doc_id").alias("b")).distinct()
            more = scratch.written(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
            extra = scratch.written(_confirmed(more, sets, percent), "links")
            if not extra.isEmpty():
                labels = components(links.union(extra), scratch)

        result = (
            found.select("doc_id", "n_shingles", "set_a", "set_b").join(copies, ["doc_id", "set_a", "set_b"], "left").withColumn("stand", F.coalesce("stand", "doc_id"))
            .join(labels.select(F.col("node").alias("stand"), "component"), "stand", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "stand").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        )
        return written(result, "near-duplicates")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


_UPPER = "".join(map(chr, range(65, 91)))
OP9_SQL = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) when len(w) = 1 then [w[1]] else [] end) as s from w
), n as (
  select doc_id, count(s) as n from (select doc_id from documents) left join s using (doc_id) group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), e as (select a, b from l union all select b, a from l),
reach as (select doc_id as node, doc_id as other from documents union select node, b from reach join e on other = a)
select doc_id, n as n_shingles, min(other) as component_id, doc_id = min(other) as kept from n join reach on node = doc_id group by doc_id, n
"""
