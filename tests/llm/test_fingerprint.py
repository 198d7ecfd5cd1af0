import hashlib
import math
from collections import Counter

import numpy as np

from murmur.llm import fingerprint as fp

from .helpers import awkward, saved


def brute_features(f, data: bytes):
    """Positions of the features of one text, by the definition."""
    s = f.s
    n = len(data) - s.window + 1
    ranks = []
    for p in range(n):
        c = Counter(data[p : p + s.window])
        h = math.log2(s.window) - sum(round(v * math.log2(v) * 65536) for v in c.values()) / (65536 * s.window)
        ranks.append(int(f.rank[round(h * 1000 / f.top)]))
    votes = Counter()
    for i in range(n - s.run + 1):
        votes[min(range(i, i + s.run), key=lambda p: (ranks[p], p))] += 1
    chosen = {p for p, v in votes.items() if v >= s.votes and ranks[p] < 1 << 20}
    if not chosen and n > 0:
        chosen = {min(range(n), key=lambda p: (ranks[p], p))}
    return sorted(chosen)


def test_features_by_the_definition():
    f = fp.Fingerprinter(fp.Settings())
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 97 + k, n).astype(np.uint8)) for k, n in ((3, 200), (20, 700), (26, 64), (26, 33), (26, 32), (26, 10), (2, 150))] + [b"", b"a" * 300]
    data = np.frombuffer(b"".join(texts), np.uint8)
    value, text = f.features(data, np.cumsum([len(t) for t in texts]))
    for i, t in enumerate(texts):
        want = brute_features(f, t) if len(t) >= f.s.window else ([0] if t else [])
        assert (text == i).sum() == len(want), i
        alone, _ = f.features(np.frombuffer(t, np.uint8), np.array([len(t)]))
        assert alone.tolist() == value[text == i].tolist()


def test_likeness():
    f = fp.Fingerprinter(fp.Settings())
    rng = np.random.default_rng(5)
    a, b = (bytes(rng.integers(97, 123, 20_000).astype(np.uint8)) for _ in range(2))
    x, y, half, none = f.of([a, b, a[:10_000] + b[:10_000], b""])
    assert f.likeness(*x, *x) == 1 and f.likeness(*x, *y) < 0.1 and 0.35 < f.likeness(*x, *half) < 0.75
    assert f.likeness(*none, *none) == 1 and f.likeness(*none, *x) == 0
    again = f.read(f.write(*x))
    assert np.array_equal(again[0], x[0]) and np.array_equal(again[1], x[1])


def check(spark, path, rows):
    got = fp.op7_fingerprints(spark, path).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1].encode()))
    f = fp.Fingerprinter(fp.Settings())
    want = []
    for i, (key, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        changed = fp.edited(text, following)
        p, q, r = f.of([text.encode(), changed.encode(), following.encode()])
        want.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), f.write(*p), f.write(*q), f.likeness(*p, *q), f.likeness(*p, *r)))
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_query(spark, tmp_path):
    check(spark, saved(spark, tmp_path), awkward())


def test_few_rows(spark, tmp_path):
    for n in (0, 1, 2, 3):
        rows = awkward()[4 : 4 + n]
        check(spark, saved(spark, tmp_path, rows), rows)


def test_one_id_of_many_rows(spark, tmp_path):
    """A third of the rows without an id, and a third with one: their ranges are parted by how the texts begin."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(c) for c in rng.integers(97, 123, 9))
    keys = [None] * 40 + [7] * 40 + list(range(100, 140))
    rows = [(k, " ".join(word() for _ in range(12)), "en", "a", 1, "", "") for k in keys]
    rows += [(None, rows[0][1], "en", "a", 1, "", "")] * 3
    check(spark, saved(spark, tmp_path, rows), rows)
    dealt = fp.beside_next(spark.read.parquet(f"{tmp_path}/sf/documents.parquet"))
    from pyspark.sql import functions as F

    n = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(n) == 4 and max(n) < 60
