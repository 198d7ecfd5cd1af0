"""Document fingerprints from a text's most improbable byte windows.

Every window of bytes has an entropy; windows whose entropy is rare come first. Of each run of neighbouring windows the
rarest gets a vote, and windows with enough votes are the document's features. Their hashes go into a chain of Bloom
filters, a new one whenever the last is full. Two fingerprints are compared filter by filter by the bits they share,
from 0 for what chance alone explains to 1 for the smaller filter being contained in the other.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, sections, small_batches

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Settings:
    """window: bytes of a feature; run: neighbouring windows of which the rarest gets a vote; votes: that make a
    feature; bits, hashes, fill: of a Bloom filter, and the features that fill it; usual, spread: mean and deviation,
    in bits, of the entropies that are taken as common; least: entropy below which a window says nothing."""

    window: int = 32
    run: int = 32
    votes: int = 8
    bits: int = 2048
    hashes: int = 5
    fill: int = 160
    usual: float = 3.6
    spread: float = 0.3
    least: float = 1.5


class Fingerprinter:
    """Fingerprints of many texts at once. A text's depends on its bytes alone."""

    #: Stripes of the joined texts that the sliding histograms walk side by side.
    STRIPES = 2048

    def __init__(self, s: Settings) -> None:
        self.s = s
        c = np.arange(s.window + 1)
        #: c log2 c in 2^-16 bits, as integers, so that sliding sums are exact
        self.weight = np.rint(c * np.log2(np.maximum(c, 1)) * 65536).astype(np.int32)
        self.up = np.diff(self.weight, append=0)  # gained by one more of a byte that is there c times
        # rank of an entropy, by how common it is; 0 is the rarest. Entropies are told apart in 1000 steps.
        top = np.log2(s.window)
        level = np.arange(1001) / 1000 * top
        self.rank = np.rint(60000 * np.exp(-0.5 * ((level - s.usual) / s.spread) ** 2)).astype(np.int64)
        self.rank[level < s.least] = 1 << 20  # never a feature
        self.top = top

    def entropy_ranks(self, data: np.ndarray) -> np.ndarray:
        """The rank of each window of the data, by its begin."""
        w, n = self.s.window, len(data) - self.s.window + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        stripes = min(self.STRIPES, n)
        length = -(-n // stripes)
        total = np.zeros(stripes * length + w - 1, np.uint8)
        total[: len(data)] = data
        view = np.lib.stride_tricks.as_strided(total, (length + w - 1, stripes), (1, length))  # [step, stripe]
        steps = np.ascontiguousarray(view).astype(np.intp) + np.arange(stripes) * 256
        hist = np.zeros(stripes * 256, np.int16)
        acc = np.zeros(stripes, np.int32)
        out = np.empty((length, stripes), np.int32)
        for t in range(length + w - 1):
            i = steps[t]
            c = hist[i]
            acc += self.up[c]
            hist[i] = c + 1
            if t >= w - 1:
                out[t - w + 1] = acc
                o = steps[t - w + 1]
                c = hist[o] - 1
                acc -= self.up[c]
                hist[o] = c
        entropy = self.top - out.T.reshape(-1)[:n] / (65536.0 * w)
        return self.rank[np.rint(entropy * (1000 / self.top)).astype(np.int64)]

    def features(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the features of the texts in data, and the text each is of, both in order of appearance.

        A text shorter than a window, unless empty, is one feature; one with fewer windows than a run is one run.
        """
        w, run = self.s.window, self.s.run
        begins = np.concatenate([[0], ends[:-1]])
        rank = self.entropy_ranks(data)
        windows = np.maximum(0, ends - begins - w + 1)
        if rank.size:
            # smallest rank, then position, of each run that begins at a window; runs are cut at the text's last one
            limit = np.repeat(begins + windows, ends - begins)[: len(rank)]  # behind the last window of the text
            inside = np.arange(len(rank)) < limit
            key = np.where(inside, (rank << 40) | np.arange(len(rank)), np.int64(1) << 62)
            low, span = key, 1
            while span < run:
                step = min(span, run - span)
                low = np.concatenate([np.minimum(low[:-step], low[step:]), low[-step:]])
                span += step
            # a run that would go past the text's end is left out, save a short text's only one
            at = np.arange(len(rank))
            full = inside & (at + run <= limit)
            short = np.flatnonzero((windows > 0) & (windows < run))
            votes = np.bincount(low[full] & ((1 << 40) - 1), minlength=len(rank))
            chosen = votes >= self.s.votes
            for i in short:  # fewer windows than a run
                k = key[begins[i] : begins[i] + windows[i]].min()
                chosen[k & ((1 << 40) - 1)] = True
            chosen &= rank < (1 << 20)
            # a text none of whose windows was chosen keeps its rarest
            held = np.add.reduceat(np.append(chosen, False).astype(np.int64), begins[windows > 0]) if (windows > 0).any() else np.zeros(0)
            # reduceat runs to the next text that has windows; those between have none
            for i in np.flatnonzero(windows > 0)[held == 0]:
                chosen[key[begins[i] : begins[i] + windows[i]].min() & ((1 << 40) - 1)] = True
            pos = np.flatnonzero(chosen)
        else:
            pos = np.zeros(0, np.int64)
        parts = data[pos[:, None] + np.arange(w)].reshape(-1).view(np.uint64).reshape(len(pos), w // 8) if len(pos) else np.zeros((0, w // 8), np.uint64)
        value = np.full(len(pos), _ODD)
        for k in range(w // 8):
            value = _mix(value * _ODD + parts[:, k])
        text = np.searchsorted(ends, pos, side="right")
        tiny = np.flatnonzero((ends > begins) & (windows == 0))
        if len(tiny):
            extra = []
            for i in tiny:
                b = data[begins[i] : ends[i]].tobytes()
                v = np.array([len(b)], np.uint64)
                for k in np.frombuffer(b + b"\0" * (-len(b) % 8), np.uint64):
                    v = _mix(v * _ODD + k)
                extra.append(v)
            value, text = np.concatenate([value, *extra]), np.concatenate([text, tiny])
            order = np.argsort(text, kind="stable")
            value, text = value[order], text[order]
        return value, text

    def filters(self, value: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bloom filters as rows of 64-bit words, the features in each, and where each text's filters begin."""
        s = self.s
        each = np.bincount(text, minlength=texts)
        first = np.cumsum(each) - each
        chained = -(-each // s.fill)
        begin = np.concatenate([[0], np.cumsum(chained)])
        row = begin[text] + (np.arange(len(text)) - first[text]) // s.fill
        bits = np.zeros((begin[-1], s.bits), bool)
        width = np.uint64(int(np.log2(s.bits)))
        for k in range(s.hashes):
            bits[row, ((value >> (width * np.uint64(k))) & np.uint64(s.bits - 1)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        return packed, np.bincount(row, minlength=begin[-1]), begin

    def likeness(self, f: np.ndarray, f_n: np.ndarray, g: np.ndarray, g_n: np.ndarray) -> float:
        """From 0 to 1. Each filter of the shorter chain is held against all of the other; its best match counts by
        its features. Two empty fingerprints are alike, an empty and another are not."""
        if not len(f) or not len(g):
            return float(len(f) == len(g))
        if len(f) > len(g) or (len(f) == len(g) and f_n.sum() > g_n.sum()):
            f, f_n, g, g_n = g, g_n, f, f_n
        m, k = self.s.bits, self.s.hashes
        free = (1 - 1 / m) ** k  # that a feature leaves a bit unset
        g_set = np.bitwise_count(g).sum(1, dtype=np.int64)
        total = 0.0
        for row, n in zip(f, f_n.tolist(), strict=True):
            mine = int(np.bitwise_count(row).sum())
            common = np.bitwise_count(g & row).sum(1, dtype=np.int64)
            most = np.minimum(mine, g_set)
            chance = mine * g_set / m
            score = np.where(most > chance, (common - chance) / np.maximum(most - chance, 1e-9), common == most)
            total += n * float(np.clip(score, 0, 1).max())
        return total / float(f_n.sum())

    def write(self, rows: np.ndarray, counts: np.ndarray) -> str:
        """Filters as text: features in each, colon, bits in base64; commas between."""
        return ",".join(f"{n}:{base64.b64encode(r.tobytes()).decode()}" for r, n in zip(rows, counts.tolist(), strict=True))

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        parts = [p.split(":") for p in text.split(",") if p]
        rows = np.array([np.frombuffer(base64.b64decode(b), np.uint64) for _, b in parts]).reshape(len(parts), self.s.bits // 64)
        return rows, np.array([int(n) for n, _ in parts], np.int64)

    def of(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The filters and their counts of features, for each text."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        value, text = self.features(data, ends)
        rows, counts, begin = self.filters(value, text, len(texts))
        return [(rows[a:b], counts[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _fingerprinter(s: Settings) -> Fingerprinter:
    return held(s, lambda: Fingerprinter(s))


# -- over a table --------------------------------------------------------------------------------------------------


def beside_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, text, bucket, ahead of every row, dealt by ranges of the id and sorted within a partition by bucket,
    ahead, doc_id (falling) and text, so that the row behind each with ahead = 0 is its next one: rows go by falling
    id (null last), those of one id by text, and behind the last comes the first. Rows with ahead = 1 are copies of
    the first row of the next range, one a range (or those of its id that begin alike).

    The ranges come from quantiles of the ids and, of an id that has the rows of several ranges, of how its texts begin.
    To the driver come the ranges' bounds, sizes and first rows' beginnings, a few for each partition of a shuffle;
    ranges are dealt to the partitions by size.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = buckets or 3 * parts
    least = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("key"))
    accuracy = lambda n: max(10_000, 10 * n)
    quantiles = sorted(rows.agg(F.percentile_approx("key", [i / number for i in range(1, number)] or [0.5], accuracy(number))).first()[0] or [])
    bounds = sorted(set(quantiles))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<long>")
    # an id that is several quantiles has as many ranges, by the first 7 bytes of its texts
    front = F.conv(F.hex(F.rpad(F.substring(F.encode("text", "UTF-8"), 1, 7), 7, F.lit(b"\0"))), 16, 10).cast("long")
    heavy = {k: n for k in bounds if (n := quantiles.count(k)) > 1}
    cuts: dict[int, list[int]] = {}
    if heavy:
        most = max(heavy.values())
        found = rows.where(F.col("key").isin(list(heavy))).groupBy("key").agg(F.percentile_approx(front, [i / most for i in range(1, most)], accuracy(most)).alias("cuts")).collect()
        cuts = {r["key"]: sorted(set(r["cuts"])) for r in found}
    # the bucket is the number of bounds below the key, counted in two steps, and of an id's cuts not below the text
    group = max(1, round(len(bounds) ** 0.5))
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("key")))
    whole = F.greatest(below(longs(bounds[::group])) - 1, F.lit(0)) * group
    place = whole + below(F.slice(longs(bounds), whole + 1, group))
    begin = [0]
    for k in bounds:
        begin.append(begin[-1] + 1 + (len(cuts[k]) + 1 if k in cuts else 0))
    inner = F.lit(0)
    for k, c in cuts.items():
        inner = F.when(F.col("key") == k, 1 + F.size(F.filter(longs(c), lambda x: x >= front))).otherwise(inner)
    bucket = (F.get(longs(begin), place) + inner).cast("int")
    first = F.struct(F.bitwise_not("key").alias("turn"), F.substring("text", 1, 64).alias("front"))
    heads = {r["bucket"]: r for r in rows.select(bucket.alias("bucket"), first.alias("first")).groupBy("bucket").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n")).collect()}
    held = sorted(heads)
    above = {b: held[(i + 1) % len(held)] for i, b in enumerate(held)}  # the range whose last row is followed by b's first
    total, before, part = sum(r["n"] for r in heads.values()), 0, {}
    for b in held:
        part[b] = before * parts // total
        before += heads[b]["n"]
    every = range(max(held, default=0) + 1)
    texts = F.array(*[F.lit(heads[b]["first"]["front"] if b in heads else "") for b in every])
    by_bucket = lambda xs: F.get(longs(xs), F.col("bucket"))
    is_head = (F.col("key") == by_bucket([~heads[b]["first"]["turn"] if b in heads else least for b in every])) & (F.substring("text", 1, 64) == F.get(texts, F.col("bucket")))
    to = F.when(is_head, by_bucket([above.get(b, 0) for b in every]).cast("int"))
    places = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead")), F.struct(to.alias("bucket"), F.lit(1).alias("ahead")))
    dealt = rows.withColumn("bucket", bucket).withColumn("place", F.explode(places)).where("place.bucket is not null")
    return (
        dealt.select("doc_id", "text", "key", "place.bucket", "place.ahead").repartitionById(parts, by_bucket([part.get(b, 0) for b in every]).cast("int"))
        .sortWithinPartitions("bucket", "ahead", F.desc("key"), "text").select("doc_id", "text", "bucket", "ahead")
    )


def edited(text: str, following: str) -> str:
    """The text with its last half of code points replaced by as many, or all, of the following one's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: doc_id, n_chars, fingerprint; the edited text (see edited()), its fingerprint and
    near_edited, the likeness of both; and near_next, the likeness to the next document's fingerprint (see
    beside_next()). A null text is empty; two empty texts are alike. Other columns are ignored; an empty table gives
    no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _fingerprinter(settings)
        held: list[tuple] = []

        def result(rows: list[tuple]) -> pa.RecordBatch:
            """Of all rows but the last, which only follows."""
            todo = [i for i in range(len(rows) - 1) if not rows[i][3]]
            changed = [edited(rows[i][1], rows[i + 1][1]) for i in todo]
            prints = f.of([r[1].encode() for r in rows])
            changed_prints = f.of([t.encode() for t in changed])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][0] for i in todo], pa.int64()), pa.array([len(rows[i][1]) for i in todo], pa.int64()), pa.array(changed, pa.string()),
                    pa.array([f.write(*prints[i]) for i in todo], pa.string()), pa.array([f.write(*p) for p in changed_prints], pa.string()),
                    pa.array([f.likeness(*prints[i], *p) for i, p in zip(todo, changed_prints, strict=True)], pa.float64()),
                    pa.array([f.likeness(*prints[i], *prints[i + 1]) for i in todo], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for part in sections(pa.compute.binary_length(batch.column(1)).to_pylist(), 2_000_000):
                cut = batch.slice(part.start, part.stop - part.start)
                held.extend(zip(*[c.to_pylist() for c in cut.columns], strict=True))
                yield result(held)
                del held[:-1]

    small_batches(docs.sparkSession)
    return beside_next(docs, id_col=id_col, text_col=text_col).mapInArrow(
        run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
