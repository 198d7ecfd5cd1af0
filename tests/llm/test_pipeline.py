"""Every stage against brute force on its own input, and run() against the stages in turn."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from murmur.llm import bpe, mixing, pii

from .helpers import frame
from .test_near_dedup import brute
from .test_pii import corpus, plain


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """The documents, and what each stage returns, written and reread."""
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[1:-1])


def test_language_keeps_what_has_letters(steps):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in steps[:2])
    assert after.keys() <= before.keys() and all(before[i] == t for i, t in after.items())
    assert all(not re.search(r"[^\W\d_]", before[i] or "") for i in before.keys() - after.keys())


def test_near_dedup_keeps_one_of_each_group(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    groups = brute(rows, 5)
    assert {r.doc_id: r.text for r in steps[2].collect()} == {i: t for i, t in rows if groups[i] == i}


def test_personal_data_is_replaced(spark, steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[2:4])
    assert before.keys() == after.keys()
    terms = {r.doc_id: r["__terms"] for r in pii.find(steps[2]).collect()}
    some = 0
    for i, r in before.items():
        text = r.text or ""
        marks = [(a, rank, b, f"[{kind.upper()}]") for a, rank, b, kind in plain(text)] + [(t.start, 4, t.end, "[TERM]" if t.value == "generalise" else "") for t in terms[i]]
        out, at = "", 0
        for a, _, b, mark in sorted(marks):
            if a >= at:
                out += text[at:a] + mark
            at = max(at, b)
        out += text[at:]
        some += bool(marks)
        assert after[i].text == out
        assert plain(text) or not terms[i]
        assert after[i].n_chars == len(after[i].text) and not plain(after[i].text)
    assert some


def test_mixing_draws_by_the_probability(steps):
    p = {r.doc_id: r["__p"] for r in mixing.mix(steps[3]).collect()}
    u = {i: (int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in p}
    assert {r.doc_id for r in steps[4].collect()} == {i for i in p if u[i] < p[i]}


def test_encoding_is_the_library_s(steps):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.vocabulary_path())
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    got = steps[5].collect()
    assert Counter(r.doc_id for r in got) == Counter(list(texts))
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run(spark, sf, steps):
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(steps[-1])


def test_stages_on_awkward_rows(spark, sf, tmp_path):
    for rows in (None, [], corpus()):
        docs = frame(spark, rows)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{'x' if rows is None else len(rows)}-{i}")
            stage(spark, docs, sf).write.parquet(path)
            new = spark.read.parquet(path)
            assert i == len(corpus_pipeline.STAGES) - 1 or new.columns == docs.columns
            docs = new
