"""Language identification by unigrams over pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A text is its runs of letters in lower
case, each with the vocabulary's word-begin mark before it. The probability of a word is the sum over all ways to cut
it into pieces of the product of their probabilities, which the forward algorithm finds in one pass. The probabilities
are learned by expectation-maximisation over the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held, sections, small_batches, uniform
from .tables import Table

LETTERS = regex.compile(r"[\p{L}\p{M}]+")
HAS_LETTER = regex.compile(r"\p{L}")

#: Longer words are summed position by position, in logarithms; shorter ones many at once. The sums are the same.
LONG = 64
#: Positions of a long word whose pieces are looked up at once.
BLOCK = 4096
#: Characters per chunk of texts; bounds a worker's memory, not its results.
CHARS_AT_ONCE = 2_000_000
#: Each character's factor in the forward sums, about the inverse of its usual probability: keeps them within doubles.
SCALE = 64.0
#: Sums that are all below this are scaled up, which long runs of rare characters need in spite of SCALE.
SMALL = 1e-100
#: Probability of a character that is in no piece, in every language.
UNKNOWN = 1e-7


class Pieces:
    """The pieces of a SentencePiece vocabulary as a trie over code points."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        texts = {model.id_to_piece(i): i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        nodes, ends = {"": 0}, [-1]
        for text in sorted(texts, key=len):
            for i in range(1, len(text) + 1):
                if text[:i] not in nodes:
                    nodes[text[:i]] = len(ends)
                    ends.append(-1)
            ends[nodes[text]] = texts[text]
        self.longest = max(map(len, texts), default=1)
        self.ends = np.array(ends, np.int64)
        inner = {t for t in nodes if t}
        self.steps = Table(np.array([(nodes[t[:-1]] << 21) | ord(t[-1]) for t in inner], np.int64), np.array([nodes[t] for t in inner], np.int32))

    def lattice(self, codes: np.ndarray) -> list[list[tuple[np.ndarray, int, np.ndarray]]]:
        """For words of one length (rows of code points): by start, the (rows, end, pieces) that fit there. A character
        with no piece of its own gets the id `size`, so every word has a segmentation."""
        n, length = codes.shape
        out = []
        for i in range(length):
            rows, node, found = np.arange(n), np.zeros(n, np.int64), []
            for j in range(i, length):
                step = self.steps.get((node << 21) | codes[rows, j])
                piece = np.where(step >= 0, self.ends[step], -1)
                if j == i:
                    found.append((rows, j + 1, np.where(piece >= 0, piece, self.size)))
                elif (hit := piece >= 0).any():
                    found.append((rows[hit], j + 1, piece[hit]))
                live = step >= 0
                rows, node = rows[live], step[live].astype(np.int64)
                if not len(rows):
                    break
            out.append(found)
        return out

    def ending(self, codes: np.ndarray, begin: int, stop: int) -> np.ndarray:
        """For a word's code points: the piece that ends before position j and is d + 1 characters long, at
        [j - begin - 1, d], for begin < j <= stop; -1 where there is none."""
        first = max(0, begin - self.longest + 1)
        out = np.full((stop - begin, self.longest), -1, np.int64)
        start, node = np.arange(first, stop), np.zeros(stop - first, np.int64)
        for d in range(self.longest):
            inside = start + d < stop
            start, node = start[inside], node[inside]
            step = self.steps.get((node << 21) | codes[start + d])
            piece = np.where(step >= 0, self.ends[step], -1)
            if d == 0:
                piece = np.where(piece >= 0, piece, self.size)
            at = start + d - begin
            put = (piece >= 0) & (at >= 0)
            out[at[put], d] = piece[put]
            live = step >= 0
            start, node = start[live], step[live].astype(np.int64)
        return out


def load(path: str) -> Pieces:
    return held(("pieces", path), lambda: Pieces(path))


def words_of(text: str) -> list[str]:
    """The runs of letters in lower case."""
    return LETTERS.findall(text.lower())


def _codes(words: list[str], n: int) -> np.ndarray:
    """Code points of words of n letters, with the word-begin mark."""
    return np.array(["▁" + w for w in words], dtype=f"<U{n + 1}").view(np.uint32).reshape(len(words), n + 1).astype(np.int64)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and code points of the words of each length up to LONG."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length[length <= LONG]):
        at = np.flatnonzero(length == n)
        for some in np.array_split(at, 1 + len(at) * (n + 1) // 500_000):
            yield some, _codes([words[i] for i in some], n)


def _long(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Number and code points of each word longer than LONG."""
    for i, w in enumerate(words):
        if len(w) > LONG:
            yield i, _codes([w], len(w))[0]


def _log_sum(x: np.ndarray) -> np.ndarray:
    most = x.max(0)
    return most + np.log(np.exp(x - most).sum(0))


def _log_forward(pieces: Pieces, codes: np.ndarray, log_chance: np.ndarray) -> np.ndarray:
    """The log probability of each beginning of a word in each language: (positions + 1, languages)."""
    n, depth = len(codes), pieces.longest
    out = np.full((depth + n + 1, log_chance.shape[1]), -np.inf)  # `depth` rows before position 0
    out[depth] = 0
    none = np.full((1, log_chance.shape[1]), -np.inf)
    chance = np.concatenate([log_chance, none])  # the last row is that of no piece
    for begin in range(0, n, BLOCK):
        ends = pieces.ending(codes, begin, min(n, begin + BLOCK))
        weight = chance[ends]  # [position, d, language]; -1 is the last row
        for k in range(len(ends)):
            j = depth + begin + k + 1
            out[j] = _log_sum(out[j - 1 : j - 1 - depth : -1] + weight[k])
    return out[depth:]


def _scaled_up(sums: np.ndarray, i: int) -> np.ndarray | None:
    """Divides the sums from position i on, where all of them are below SMALL, by the largest; the divisors' logs."""
    if not (low := sums[i] < SMALL).any():
        return None
    by = np.ones(low.shape)
    most = sums[i:, low].max(0)
    by[low] = np.where((most > 0) & (most < SMALL), most, 1)
    sums[i:] /= by
    return np.log(by)


def word_scores(pieces: Pieces, words: list[str], chance: np.ndarray) -> np.ndarray:
    """The log probability of each word (rows) in each language; chance: (pieces + 1, languages)."""
    out = np.empty((len(words), chance.shape[1]))
    for at, codes in _by_length(words):
        length = codes.shape[1]
        forward = np.zeros((length + 1, len(at), chance.shape[1]))
        forward[0] = 1
        log = 0.0
        for i, found in enumerate(pieces.lattice(codes)):
            if (by := _scaled_up(forward, i)) is not None:
                log = log + by
            for rows, j, piece in found:
                forward[j][rows] += forward[i][rows] * chance[piece] * SCALE ** (j - i)
        out[at] = np.log(forward[length]) + log - length * np.log(SCALE)
    for i, codes in _long(words):
        out[i] = _log_forward(pieces, codes, np.log(chance))[-1]
    return out


def expected_counts(pieces: Pieces, words: list[str], lang: np.ndarray, count: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """How often each piece is used in each language, expected over the segmentations of count copies of each word."""
    out = np.zeros(chance.size)
    k = chance.shape[1]
    for at, codes in _by_length(words):
        length, l = codes.shape[1], lang[at]
        edges = pieces.lattice(codes)
        forward = np.zeros((length + 1, len(at)))
        backward = np.zeros((length + 1, len(at)))
        forward[0] = backward[length] = 1
        log = np.zeros((length + 1, len(at)))  # of the divisors at each position; the backward sums take the same
        for i, found in enumerate(edges):
            if (by := _scaled_up(forward, i)) is not None:
                log[i] = by
            for rows, j, piece in found:
                forward[j][rows] += forward[i][rows] * chance[piece, l[rows]] * SCALE ** (j - i)
        scaled, log = log.any(), log.cumsum(0)
        lifted = lambda i, j, rows: np.exp(log[i, rows] - log[j, rows]) if scaled else 1.0
        for i in range(length - 1, -1, -1):
            for rows, j, piece in edges[i]:
                backward[i][rows] += backward[j][rows] * chance[piece, l[rows]] * SCALE ** (j - i) * lifted(i, j, rows)
        weight = count[at] / forward[length]
        for i, found in enumerate(edges):
            for rows, j, piece in found:
                w = weight[rows] * forward[i][rows] * chance[piece, l[rows]] * SCALE ** (j - i) * lifted(i, j, rows) * backward[j][rows]
                out += np.bincount(piece * k + l[rows], w, out.size)
    for at, codes in _long(words):
        l, n, depth = lang[at], len(codes), pieces.longest
        log_chance = np.append(np.log(chance[:, l]), -np.inf)
        forward = _log_forward(pieces, codes, log_chance[:-1, None])[:, 0]
        backward = np.full(n + 1 + depth, -np.inf)  # `depth` positions behind the last
        backward[n] = 0
        for begin in reversed(range(0, n, BLOCK)):
            stop = min(n, begin + BLOCK)
            # pieces by where they begin, from those that end in this block or up to `depth` behind it
            until = min(n, stop + depth - 1)
            ends = pieces.ending(codes, begin, until)
            starts = np.full((stop - begin, depth), -1)
            for d in range(depth):
                j = np.arange(begin + d, min(stop + d, until))
                starts[j - d - begin, d] = ends[j - begin, d]
            weight = log_chance[starts]
            for i in range(stop - 1, begin - 1, -1):
                backward[i] = _log_sum(backward[i + 1 : i + 1 + depth] + weight[i - begin])
            i, d = np.nonzero(starts >= 0)
            w = np.exp(forward[begin + i] + weight[i, d] + backward[begin + i + d + 1] - forward[n])
            out += np.bincount(starts[i, d] * k + l, w * count[at], out.size)
    return out.reshape(chance.shape)


def held_out(id_col: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is 2 modulo 4. A null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, langs: list[str], chance: np.ndarray) -> None:
        self.langs, self.chance = langs, chance


def learn(docs: DataFrame, path: str, *, per_lang: int = 1500, rounds: int = 3, smooth: float = 0.02) -> Model:
    """Piece probabilities per language, from documents with a language, an id and text that are not held out.

    It learns from a bounded sample: of each language, the documents whose id hashes below per_lang over their number,
    about per_lang of them, whole. The words are counted and the expected counts summed on the executors; what comes
    to the driver is a number for each language and piece. The sums are of integers (counts in 2^-20), so that the
    order of tasks does not show.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(there)
    pieces = load(path)
    usable = np.zeros(pieces.size + 1, bool)
    usable[pieces.ends[pieces.ends >= 0]] = True
    k = len(langs)
    if not k:
        return Model([], np.zeros((pieces.size + 1, 0)))
    share = F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(per_lang / there[l]))])
    number = F.create_map(*[x for i, l in enumerate(langs) for x in (F.lit(l), F.lit(i))])
    sample = rows.where(uniform(F.concat(F.lit("learn|"), F.col("doc_id").cast("string"))) < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sections(pa.compute.binary_length(batch.column(1)).to_pylist(), CHARS_AT_ONCE):
                lang = np.asarray(batch.column(0)[part.start : part.stop])
                some = [words_of(t) for t in batch.column(1)[part.start : part.stop].to_pylist()]
                coded = pa.array([w for x in some for w in x], pa.string()).dictionary_encode()
                code = np.repeat(lang.astype(np.int64), [len(x) for x in some]) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
                each, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(each // max(1, len(coded.dictionary)), pa.int32()), coded.dictionary.take(pa.array(each % max(1, len(coded.dictionary)))), pa.array(n, pa.int64())], ["lang", "word", "n"]
                )

    small_batches(docs.sparkSession)
    counted = sample.select(F.element_at(number, F.col("lang")).alias("lang"), "text").mapInArrow(count, "lang int, word string, n long")
    with Scratch(docs.sparkSession, "language") as scratch:
        words = scratch.written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
        chance = np.where(usable, 1 / usable.sum(), UNKNOWN)[:, None].repeat(k, 1)
        for _ in range(rounds):
            shared = docs.sparkSession.sparkContext.broadcast(chance)  # (pieces + 1) x languages doubles

            def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(shared.value.shape)
                for batch in batches:
                    total += expected_counts(load(path), batch.column(1).to_pylist(), np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(2)).astype(float), shared.value)
                piece, lang = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(np.rint(total[piece, lang] * 2**20).astype(np.int64))], ["piece", "lang", "n"])

            sums = words.mapInArrow(expect, "piece int, lang int, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
            got = np.zeros_like(chance)
            got[np.asarray(sums["piece"]), np.asarray(sums["lang"])] = np.asarray(sums["n"]) / 2**20
            shared.unpersist()
            got = np.where(usable[:, None], got + smooth, 0)
            chance = got / got.sum(0)
            chance[pieces.size] = UNKNOWN
    return Model(langs, chance)


def _predict(texts: list[str | None], langs: list[str], chance: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Predicted language and score of each text."""
    names = np.array([*langs, "und"], dtype=object)
    some = [words_of(t) if t and langs and HAS_LETTER.search(t) else [] for t in texts]
    n = np.array([len(x) for x in some])
    coded = pa.array([w for x in some for w in x], pa.string()).dictionary_encode()
    each = word_scores(pieces, coded.dictionary.to_pylist(), chance)
    has = np.flatnonzero(n)
    best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
    if len(has):
        ends = np.cumsum(n[has])
        log = np.add.reduceat(each[coded.indices.to_numpy()], ends - n[has], axis=0) / np.sqrt(n[has])[:, None]
        best[has] = log.argmax(1)
        score[has] = np.round(1 / np.exp(log - log.max(1, keepdims=True)).sum(1), 9)
    return names[best], score


def identify(docs: DataFrame, model: Model, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for each row of docs, from its whole text alone.

    score is the predicted language's share of the languages' probabilities, each to the power 1 / sqrt(words): 1 over
    their number says nothing, 1 is certain. A null text, or one without a letter, is `und` with score 0, as is every
    text when no language was learned. Of languages that score the same, the first by name is taken. Rows that repeat
    give equal rows; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sections(pa.compute.binary_length(batch.column(1)).to_pylist(), CHARS_AT_ONCE):
                name, score = _predict(batch.column(1)[part.start : part.stop].to_pylist(), *shared.value, load(path))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(name, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, path: str, *, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is identified with a score of `least` or more; those
    that are `und` go. With at most three languages every text with a letter stays."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.chance))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sections([x or 0 for x in pa.compute.binary_length(batch.column(at)).to_pylist()], CHARS_AT_ONCE):
                cut = batch.slice(part.start, part.stop - part.start)
                name, score = _predict(cut.column(at).to_pylist(), *shared.value, load(path))
                yield cut.filter(pa.array((name != "und") & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def pieces_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_language(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = path or pieces_path()
    return identify(docs, learn(docs, path), path).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
