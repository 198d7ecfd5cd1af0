import hashlib
import random

import numpy as np
import pytest

from murmur.llm import bpe

from .helpers import awkward, frame, saved


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_equals_the_library_on_random_texts(reference):
    rng = random.Random(3)
    pool = list("abcdefgh EIOU  '''\n\n\t\r019!?.,-_=") + ["é", "中", "\u0085", " ", " ", "\x1c", "\x00", "🎉", "　", "½", "<|endoftext|>", "the", "ing", "aaaa", "----"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 90))) for _ in range(3000)]
    texts += ["a" * 1000, "-" * 5000, "ab" * 3000, "", " ", "x" + "é" * 70]
    mine = bpe.load(bpe.vocabulary_path()).encode(texts)
    for got, want in zip(mine, reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids
    back = bpe.load(bpe.vocabulary_path()).decode(mine)
    assert back == texts


def test_long_texts_are_cut_between_words(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHARS_AT_ONCE", 50)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 7)
    text = "The quick brown fox, 42 times!  " * 30
    assert bpe.load(bpe.vocabulary_path()).encode([text])[0].tolist() == reference.encode(text, add_special_tokens=False).ids


def test_compatibility_is_what_merging_says():
    b = bpe.load(bpe.vocabulary_path())
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 50_000, 3000), rng.integers(0, 50_000, 3000)
    want = [b._merge_one(b.bytes_of[i] + b.bytes_of[j]) == [i, j] for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert b.compatible(x, y).tolist() == want


def test_invalid_ids_decode_with_replacements(spark):
    ids = np.array([0x61, 255, 5], "<u4").tobytes()
    rows = spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids binary")
    b = bpe.load(bpe.vocabulary_path())
    got = dict(bpe.decode(rows, bpe.vocabulary_path()).collect())
    assert got == {1: b"".join(b.bytes_of[i] for i in (0x61, 255, 5)).decode("utf-8", "replace"), 2: ""}


def test_query(spark, tmp_path, reference):
    path = saved(spark, tmp_path)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op6_bpe(spark, path).collect())
    want = []
    for row in awkward():
        ids = reference.encode(row[1] or "", add_special_tokens=False).ids
        want.append((str(row[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode(frame(spark, []), bpe.vocabulary_path()).count() == 0
