import hashlib

import numpy as np
import pytest

from murmur.llm import mixing

from .helpers import awkward, frame, saved


def test_raking_reaches_the_marginals():
    rng = np.random.default_rng(1)
    index = [np.repeat(np.arange(5), 12), np.tile(np.repeat(np.arange(4), 3), 5), np.tile(np.arange(3), 20)]
    tokens = rng.integers(1, 1000, 60).astype(float)
    shares = [rng.dirichlet(np.ones(k)) for k in (5, 4, 3)]
    w = mixing.rake(index, tokens, shares, 200)
    for at, share in zip(index, shares, strict=True):
        assert np.allclose(np.bincount(at, w), share, atol=1e-9)


@pytest.mark.parametrize("keep", [0.01, 0.3, 0.9, 1.0])
def test_expected_tokens(keep):
    rng = np.random.default_rng(2)
    tokens, weight = rng.integers(1, 1000, 50).astype(float), rng.dirichlet(np.ones(50))
    p = mixing.probabilities(weight, tokens, keep)
    assert p.min() >= 0 and p.max() <= 1 and np.isclose((p * tokens).sum(), keep * tokens.sum())
    ratio = weight / tokens
    free = p < 1
    if free.any():
        assert np.allclose(p[free] / ratio[free], (p[free] / ratio[free])[0]) and (ratio[~free].min(initial=np.inf) >= ratio[free].max())


def test_both_ways_agree(spark):
    docs = frame(spark)
    for targets in ({"source": 0.5, "lang": 0.3, "topic": 1.0}, {"source": {"a": 0.6, "b": 0.3}, "lang": {"en": 0.5, "xx": 0.2}, "topic": 0.0}):
        got = [{(r.doc_id, r.text): r for r in mixing.mix(docs, mixing.Settings(targets=targets, max_cells=m, rounds=12)).collect()} for m in (1000, 0)]
        assert got[0].keys() == got[1].keys()
        for k, r in got[0].items():
            assert r["__p"] == got[1][k]["__p"] and r["__kept"] == got[1][k]["__kept"]


def test_awkward_rows(spark, tmp_path):
    got = mixing.op3_mixing(spark, saved(spark, tmp_path)).collect()
    assert len(got) == len(awkward())
    for r in got:
        u = (int(hashlib.md5(f"mix|{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert r.kept == (u < r.probability)
    assert {r.topic for r in got if r.doc_id in (1, 2, 3)} == {"empty"}
    assert mixing.op3_mixing(spark, saved(spark, tmp_path, [])).count() == 0


def test_sampled_marginals(spark, sf):
    got = mixing.op3_mixing(spark, sf).toPandas()
    s = mixing.Settings()
    expected = (got.n_tokens * got.probability).groupby(got.lang).sum() / (got.n_tokens * got.probability).sum()
    tokens = got.n_tokens.groupby(got.lang).sum()
    target = tokens ** s.targets["lang"] / (tokens ** s.targets["lang"]).sum()
    before = tokens / tokens.sum()
    assert (expected - target).abs().max() < (before - target).abs().max()
    assert abs((got.n_tokens * got.probability).sum() / got.n_tokens.sum() - s.keep) < 1e-4


def test_raking_ends(spark):
    """At the tolerance where the targets agree, after the last round where they can't all hold."""
    at = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    tokens = np.array([5.0, 1.0, 2.0, 9.0])
    w = mixing.rake(at, tokens, [np.array([0.5, 0.5]), np.array([0.2, 0.8])], 1000, 1e-12)
    assert np.allclose(np.bincount(at[0], w), 0.5, atol=1e-12) and np.allclose(np.bincount(at[1], w), [0.2, 0.8], atol=1e-12)
    diagonal = [np.array([0, 1]), np.array([0, 1])]  # the other two cells are empty
    w = mixing.rake(diagonal, np.array([1.0, 1.0]), [np.array([0.5, 0.5]), np.array([0.2, 0.8])], 50, 1e-12)
    assert np.allclose(w, [0.2, 0.8])


def test_calibration(spark, sf):
    mixed = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), mixing.Settings(keep=0.02))
    rows = mixing.calibration(mixed, mixing.Settings(keep=0.02)).collect()
    for d in mixing.DIMENSIONS:
        mine = [r for r in rows if r.dimension == d]
        assert all(np.isclose(sum(r[c] for r in mine), 1) for c in ("target", "expected", "drawn"))
    full = mixed.where("__tokens > 0").selectExpr("max(__p)").first()[0]
    assert full == 1 or max(abs(r.target - r.expected) for r in rows) < 1e-3
