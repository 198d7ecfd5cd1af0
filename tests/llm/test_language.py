import itertools
import math
import zlib

import numpy as np

from murmur.llm import language

from .helpers import frame, saved


def brute(pieces: dict[str, float], word: str) -> float:
    """The sum over all segmentations, written out."""
    n, total = len(word), 0.0
    for cuts in itertools.product([0, 1], repeat=n - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1]):
            if c:
                parts.append(word[at : i + 1])
                at = i + 1
        total += math.prod(pieces.get(p, language.UNKNOWN if len(p) == 1 else 0.0) for p in parts)
    return total


def test_forward_sums_all_segmentations():
    p = language.load(language.pieces_path())
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=language.pieces_path())
    rng = np.random.default_rng(0)
    chance = rng.random((p.size + 1, 2)) * 1e-3
    chance[p.size] = language.UNKNOWN
    names = {model.id_to_piece(i): i for i in range(p.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    words = ["the", "nation", "straße", "a", "中文x", "zzq"]
    got = language.word_scores(p, words, chance)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            assert math.isclose(row[k], math.log(brute({t: chance[i, k] for t, i in names.items()}, "▁" + w)), rel_tol=1e-9)
    lang = np.zeros(len(words), int)
    counts = language.expected_counts(p, words, lang, np.ones(len(words)), chance)
    text = sum(len(w) + 1 for w in words)
    length = np.array([len(model.id_to_piece(i)) for i in range(p.size)] + [1])
    assert math.isclose((counts.sum(1) * length).sum(), text, rel_tol=1e-9)  # the pieces used make up the words


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.op5_language(spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_awkward_rows(spark, tmp_path):
    got = language.op5_language(spark, saved(spark, tmp_path)).collect()
    assert len(got) == frame(spark).count()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[5].lang_pred == by[6].lang_pred and by[5].score == by[6].score and not by[None].held_out


def test_empty_and_unlabelled(spark, tmp_path):
    assert language.op5_language(spark, saved(spark, tmp_path, [])).count() == 0
    rows = [(i, "some words", None, None, 1, "", "") for i in range(4)]
    assert {r.lang_pred for r in language.op5_language(spark, saved(spark, tmp_path, rows)).collect()} == {"und"}


def test_filter_keeps_columns(spark):
    docs = frame(spark)
    path = language.pieces_path()
    kept = language.keep_identified(docs, language.learn(docs, path), path)
    assert kept.schema == docs.schema
    assert {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())


def test_long_runs_of_rare_letters():
    """Sums over runs of letters with no piece, or with improbable ones, stay numbers."""
    p = language.load(language.pieces_path())
    rng = np.random.default_rng(1)
    chance = rng.random((p.size + 1, 3)) * 1e-3
    chance[p.size] = language.UNKNOWN
    odd = "ሀለሐመሠረሰ"  # no piece has these
    words = [odd * 20, "a" + (odd * 14)[:95], "the" + (odd * 13)[:89] + "tion", "abcdefgh" * 12]
    words = [w[:96] for w in words]
    got = language.word_scores(p, words, chance)
    assert np.isfinite(got).all()
    begin = language.word_scores(p, [""], chance)[0]
    np.testing.assert_allclose(got[0], begin + 96 * np.log(language.UNKNOWN), rtol=1e-12)
    parts = language.word_scores(p, [words[2][:3]], chance)[0]  # the rare letters part the rest, so the sums multiply
    end = language.word_scores(p, [words[2][:3] + odd[:1] + "tion"], chance)[0] - parts - np.log(language.UNKNOWN)
    np.testing.assert_allclose(got[2], parts + (len(words[2]) - 7) * np.log(language.UNKNOWN) + end, rtol=1e-12)
    low = np.full_like(chance, 1e-12)
    assert np.isfinite(language.word_scores(p, words, low)).all()
    for table in (chance, low):
        counts = language.expected_counts(p, words, np.arange(4) % 3, np.ones(4), table)
        assert np.isfinite(counts).all() and counts.min() >= 0
    length = np.array([len(t) for t in piece_texts(p)] + [1])
    counts = language.expected_counts(p, words, np.arange(4) % 3, np.ones(4), chance)
    assert math.isclose((counts.sum(1) * length).sum(), sum(len(w) + 1 for w in words), rel_tol=1e-9)
    model = (["a", "b", "c"], chance)
    name, score = language._predict(["a long clean page " * 50 + words[0]], *model, p)
    assert name[0] in "abc" and 0 < score[0] <= 1


def piece_texts(p):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=language.pieces_path())
    return [model.id_to_piece(i) for i in range(p.size)]


def test_long_words_are_summed_whole():
    """Long words give the sums of the many-at-once way; parts between rare letters multiply."""
    p = language.load(language.pieces_path())
    rng = np.random.default_rng(4)
    chance = rng.random((p.size + 1, 3)) * 1e-3
    chance[p.size] = language.UNKNOWN
    words = ["internationalisation" * 4, "漢字仮名交文章" * 14, "ภาษาไทยเป็นภาษา" * 9, "ሀለሐመሠረሰ" * 30, "a" * 65, "the" * 30]
    whole = language.word_scores(p, words, chance)
    counts = language.expected_counts(p, words, np.array([0, 1, 2, 0, 1, 2]), np.arange(1.0, 7.0), chance)
    assert np.isfinite(whole).all() and np.isfinite(counts).all() and counts.min() >= 0
    before, language.LONG = language.LONG, 10**9
    try:
        np.testing.assert_allclose(whole, language.word_scores(p, words, chance), rtol=1e-9)
        np.testing.assert_allclose(counts, language.expected_counts(p, words, np.array([0, 1, 2, 0, 1, 2]), np.arange(1.0, 7.0), chance), rtol=1e-7, atol=1e-12)
    finally:
        language.LONG = before
    before, language.BLOCK = language.BLOCK, 50
    try:
        np.testing.assert_allclose(whole, language.word_scores(p, words, chance), rtol=1e-12)
        np.testing.assert_allclose(counts, language.expected_counts(p, words, np.array([0, 1, 2, 0, 1, 2]), np.arange(1.0, 7.0), chance), rtol=1e-9, atol=1e-15)
    finally:
        language.BLOCK = before


def test_long_runs_are_learned_and_predicted(spark):
    """Runs of 1 to 10,000 letters of Han, Ethiopic and Thai, learned from and predicted, spoil no score."""
    path = language.pieces_path()
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 3, "en", "a", 1, "", "") for i in range(30)]
    rows += [(100 + i, "le renard brun saute par dessus le chien paresseux " * 3, "fr", "a", 1, "", "") for i in range(30)]
    n = 200
    for letters, lang in (("漢字仮名交文章", "en"), ("ሀለሐመሠረሰ", "fr"), ("ภาษาไทย", "en")):
        for size in (1, 60, 96, 97, 10_000):
            rows.append((n, (letters * size)[:size] + " the lazy dog", lang, "a", 1, "", ""))
            n += 1
    docs = frame(spark, rows)
    model = language.learn(docs, path)
    assert np.isfinite(model.chance).all() and model.chance.min() >= 0
    got = {r.doc_id: r for r in language.identify(docs, model, path).collect()}
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr") for r in got.values())
    assert all(got[r[0]].lang_pred == r[2] for r in rows if r[0] < 200)
    assert language.keep_identified(docs, model, path).count() == len(rows)
