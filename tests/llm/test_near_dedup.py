import random
import re
from itertools import combinations

import pytest

from murmur.llm import near_dedup
from murmur.llm.common import Scratch
from murmur.llm.components import components

from .helpers import awkward, frame


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t, k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_awkward_rows(spark, k):
    rows = [(r[0], r[1]) for r in awkward()]
    want = brute(rows, k)
    got = near_dedup.near_duplicates(frame(spark), words=k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id)
        if r.doc_id != 12:  # the id of two different texts
            assert r.n_shingles == len(shingles(next(t for i, t in rows if i == r.doc_id), k))
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_families_of_near_copies(spark):
    """Copies at similarities about the threshold, so that buckets hold several components."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for family in range(4):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for _ in range(60):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((n * 7 % 1009 + 1, " ".join(text)))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, words=2).collect()}
    want = brute(rows, 2)
    assert got == want
    assert 4 < len(set(want.values())) < len(rows)


def test_share_of_agreeing_values_is_the_similarity():
    import numpy as np

    m = near_dedup.MinMax()
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 500, dtype=np.uint64)
        a, b = m.signature(x[:450]), m.signature(x[50:])
        agree.append([(p == q).mean() for p, q in zip(a, b, strict=True)])
    assert np.abs(np.mean(agree, 0) - 0.8).max() < 0.02


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000), (1500, 2000), (7, 7)], "a long, b long")
    with Scratch(spark, "test") as scratch:
        got = dict(components(links, scratch).collect())
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1500: 1000, 2000: 1000}


def test_runs_of_a_band_that_ranges_part(spark):
    rng = random.Random(3)
    sizes = {5: 1, 7: 4000, 8: 2, 11: 1, 12: 900, 20: 1}
    rows = [(b, i, 10 + i % 7) for b, m in sizes.items() for i in rng.sample(range(10_000), m)]
    got = near_dedup._in_runs(spark.createDataFrame(rows, "band long, doc_id long, n long")).collect()
    n = {(b, i): k for b, i, k in rows}
    seen = [(r.band, r.doc_id) for r in got]
    assert len(set(seen)) == len(seen) and {(b, i) for b, i, _ in rows if sizes[b] > 1} <= set(seen) <= set(n)
    assert all((r.n, r.hub_n, r.prev_n) == (n[r.band, r.doc_id], n[r.band, r.hub], n[r.band, r.prev]) and r.hub <= r.prev <= r.doc_id for r in got)
    for band in sizes:
        mine = sorted((r.doc_id, r.hub, r.prev, r.border) for r in got if r.band == band)
        hubs = sorted({h for _, h, _, _ in mine})
        assert not mine or hubs[0] == mine[0][0]
        assert len(hubs) < 2 or {h for _, h, _, b in mine if b} == set(hubs)  # each range's hub shows at its border
        for (before, h, _, _), (_, k, p, _) in zip(mine, mine[1:]):
            assert p == before if h == k else k > before


def test_one_family_of_many_near_copies(spark):
    """50,000 texts that differ in one word, or two, of 60, beside others."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:20], f"n{i}", *base[20:]])) for i in range(1, 50_001)]
    rows += [(60_000 + i, " ".join(rng.choice(base) for _ in range(60))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, words=2).select("doc_id", "component_id").collect()}
    assert all(got[i] == (1 if i < 60_000 else i) for i, _ in rows)


def test_words_that_a_polynomial_hash_confuses():
    """Words of two letters in Thue-Morse order and their complements differ."""
    import numpy as np

    bits = "ab"
    while len(bits) < 4096:
        bits += bits.translate(str.maketrans("ab", "ba"))
    words = [bits[:k] for k in (64, 200, 256, 257, 1024, 4096)]
    words += [w.translate(str.maketrans("ab", "ba")) for w in words]
    raw = [w.encode() for w in words]
    sets = near_dedup.Shingler(2).sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
    assert len({int(s[0]) for s in sets}) == len(words)
