"""Byte-level BPE by speculation and verification.

Greedy longest match proposes the tokens of a word. A proposal is the true encoding exactly if every two neighbours
are compatible: undoing their merges from the latest on, no merge across their border would have come first. Arrays of
proposals are checked at once; only words with a failing pair are merged exactly, also as arrays.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, sections, small_batches
from .tables import Table

#: Fixed value: the public byte-level pre-tokenizer's pattern, its \s and \S written as the Unicode property.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Bytes of words beyond which a word is speculated and merged on its own instead of in arrays.
LONG = 64
#: Words that are encoded at once, and characters of text per scan; they bound a worker's memory, not its results.
WORDS_AT_ONCE, CHARS_AT_ONCE = 400_000, 2_000_000


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: its own if it has one, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary of the tokenizers library's JSON form."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, byte = spec["model"], _byte_of_symbol()
        vocab = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for k, v in [*vocab.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.bytes_of[v] = k
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_id = np.array([vocab[bytes([b])] for b in range(256)], np.int32)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.scan = regex.compile(WORDS)
        # merges: by rank, the token on the left, on the right and the one they form
        text = {k: v for k, v in model["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([text[m[i]] for m in pairs], np.int64) for i in (0, 1))
        made = np.array([text[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int32)
        self.made, self.size = made, size
        self.pairs = Table(left * size + right, rank)
        # a token's own rank, -1 if no merge makes it; and its halves
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        self.rank[made], self.left[made], self.right[made] = rank, left, right
        whole = self.compatible(left, right, rank.astype(np.int64))
        self.sound = np.zeros(size, bool)
        self.sound[self.byte_id] = True
        for t, a, b, ok in zip(made.tolist(), left.tolist(), right.tolist(), whole.tolist(), strict=True):
            self.sound[t] = ok and self.sound[a] and self.sound[b]
        self._grow_trie({k: v for k, v in vocab.items()})

    def _grow_trie(self, vocab: dict[bytes, int]) -> None:
        nodes, ends = {b"": 0}, [-1]
        for k in sorted(vocab, key=len):
            for i in range(1, len(k) + 1):
                if k[:i] not in nodes:
                    nodes[k[:i]] = len(ends)
                    ends.append(-1)
            ends[nodes[k]] = vocab[k]
        steps = [(nodes[k[:-1]] * 256 + k[-1], n) for k, n in nodes.items() if k]
        self.ends = np.array(ends, np.int32)
        self.steps = Table(np.array([s for s, _ in steps], np.int64), np.array([n for _, n in steps], np.int32))
        self.first = self.steps.get(np.arange(256, dtype=np.int64))

    @cached_property
    def rank_of(self) -> dict[int, int]:
        """The ranks of merges by left * size + right; only words merged on their own need it."""
        return self.pairs.items()

    @cached_property
    def step_of(self) -> dict[int, int]:
        """The trie's steps by node * 256 + byte, for the same words."""
        return self.steps.items()

    # -- verification ------------------------------------------------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For arrays of tokens a, b side by side: whether BPE leaves both as they are.

        The merges inside a and b are undone from the latest on. What touches the border then is the pair that stood
        there before that merge; if that pair merges at a rank that comes first, it would have. Among equal ranks the
        left one comes first. below: only merges of a lower rank count at the start.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), len(self.made), np.int64) if below is None else below.copy()
        at = np.arange(len(a))
        while len(at):
            rank = self.pairs.get(a * self.size + b)
            clash = (rank >= 0) & (rank < limit)
            ok[at[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~clash & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    # -- words -------------------------------------------------------------------------------------------------

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of distinct words, one after another, and how many each word has."""
        n = len(words)
        length = np.fromiter((len(w) for w in words), np.int64, n)
        short = np.flatnonzero((length <= LONG) & (length > 0))
        token, word = self._propose([words[i] for i in short], length[short])
        token, word = [token], [short[word]]
        for i in np.flatnonzero(length > LONG):
            token.append(np.array(self._propose_one(words[i]), np.int32))
            word.append(np.full(len(token[-1]), i))
        token, word = np.concatenate(token), np.concatenate(word)
        order = np.argsort(word, kind="stable")
        token, word = token[order], word[order]
        same = word[1:] == word[:-1]
        code = token[:-1][same].astype(np.int64) * self.size + token[1:][same]
        each, back = np.unique(code, return_inverse=True)
        bad_pair = ~self.compatible(each // self.size, each % self.size)[back]
        bad = np.zeros(n, bool)
        bad[word[1:][same][bad_pair]] = True
        bad[word[~self.sound[token]]] = True
        if bad.any():
            keep = ~bad[word]
            again = np.flatnonzero(bad)
            few = again[length[again] <= LONG]
            t, w = self._merge([words[i] for i in few], length[few])
            token, word = [token[keep], t], [word[keep], few[w]]
            for i in again[length[again] > LONG]:
                token.append(np.array(self._merge_one(words[i]), np.int32))
                word.append(np.full(len(token[-1]), i))
            token, word = np.concatenate(token), np.concatenate(word)
            order = np.argsort(word, kind="stable")
            token, word = token[order], word[order]
        return token.astype(np.int32), np.bincount(word, minlength=n)

    def _propose(self, words: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over all words at once, a byte of each per round: tokens and the words they are in."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        pool = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        end = np.cumsum(length)
        at = end - length
        word, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        pos, best, best_end = at.copy(), np.full(len(words), -1, np.int32), at.copy()
        tokens, owners = [], []
        while len(word):
            step = self.steps.get(node * 256 + pool[pos])
            step[pos >= end] = -1
            dead = step < 0
            if dead.any():  # the longest match is known; go on behind it
                d = np.flatnonzero(dead)
                tokens.append(best[d])
                owners.append(word[d])
                pos[d] = best_end[d]
                live = pos < end
                nxt = d[live[d]]
                step[nxt] = self.first[pool[pos[nxt]]]
                if not live[d].all():
                    keep = ~dead | live
                    word, end, pos, best, best_end, step = word[keep], end[keep], pos[keep], best[keep], best_end[keep], step[keep]
            node = step.astype(np.int64)
            pos = pos + 1
            hit = self.ends[node] >= 0
            best, best_end = np.where(hit, self.ends[node], best), np.where(hit, pos, best_end)
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return token[order], owner[order]

    def _propose_one(self, word: bytes) -> list[int]:
        out, at = [], 0
        while at < len(word):
            node, pos, best = 0, at, (-1, at)
            while pos < len(word) and (node := self.step_of.get(node * 256 + word[pos], -1)) >= 0:
                pos += 1
                if self.ends[node] >= 0:
                    best = int(self.ends[node]), pos
            out.append(best[0])
            at = best[1]
        return out

    def _merge(self, words: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging over all words at once: each round, every word's leftmost pair of its lowest rank."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        token = self.byte_id[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(words)), length)
        done_t, done_w = [], []
        none = len(self.made)
        while len(word):
            rank = np.full(len(word), none, np.int64)
            same = np.flatnonzero(word[1:] == word[:-1])
            got = self.pairs.get(token[same] * self.size + token[same + 1])
            rank[same] = np.where(got < 0, none, got)
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            key = rank * (len(word) + 1) + np.arange(len(word))
            low = np.minimum.reduceat(key, begin)
            low_rank, low_at = low // (len(word) + 1), low % (len(word) + 1)
            go = low_rank < none
            counts = np.diff(np.append(begin, len(word)))
            if not go.all():
                over = np.repeat(~go, counts)
                done_t.append(token[over])
                done_w.append(word[over])
            at = low_at[go]
            token[at] = self.made[low_rank[go]]
            keep = np.repeat(go, counts)
            keep[at + 1] = False
            token, word = token[keep], word[keep]
        token, word = np.concatenate(done_t), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return token[order].astype(np.int32), word[order]

    def _merge_one(self, word: bytes) -> list[int]:
        """Exact merging of one word by a heap of pairs over a linked list."""
        token = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(token)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := self.rank_of.get(token[i] * self.size + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j], after[i] = int(self.made[r]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := self.rank_of.get(token[x] * self.size + token[y])) is not None:
                    heapq.heappush(heap, (q, x, token[x], token[y]))
        return [t for t in token if t >= 0]

    # -- texts -------------------------------------------------------------------------------------------------

    def _pieces(self, text: str) -> Iterator[tuple[list[str], int]]:
        """A text's words in lists, each with the special token that follows it or -1."""
        parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
        for i in range(0, len(parts), 2):
            then = self.special[parts[i + 1]] if i + 1 < len(parts) else -1
            if len(parts[i]) <= CHARS_AT_ONCE:
                yield self.scan.findall(parts[i]), then
                continue
            some: list[str] = []
            for m in self.scan.finditer(parts[i]):
                some.append(m.group())
                if len(some) >= WORDS_AT_ONCE:
                    yield some, -1
                    some = []
            yield some, then

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids (uint32) of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        words: list[str] = []
        held: list[tuple[int, int, int]] = []  # text, words, special token behind them

        def flush() -> None:
            if held:
                coded = pa.array(words, pa.string()).dictionary_encode()
                number = coded.indices.to_numpy().astype(np.int64)
                token, count = self.encode_words(coded.dictionary.cast(pa.binary()).to_pylist())
                start = np.cumsum(count) - count
                n = count[number]
                begin = np.cumsum(n) - n
                ids = token[np.repeat(start[number] - begin, n) + np.arange(n.sum())].astype("<u4")
                ends = np.concatenate([[0], np.cumsum(n)])
                w = 0
                for i, k, then in held:
                    out[i].append(ids[ends[w] : ends[w + k]])
                    w += k
                    if then >= 0:
                        out[i].append(np.array([then], "<u4"))
            words.clear()
            held.clear()

        for i, text in enumerate(texts):
            for some, then in self._pieces(text):
                words.extend(some)
                held.append((i, len(some), then))
                if len(words) >= WORDS_AT_ONCE:
                    flush()
        flush()
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, "<u4"), *x]) for x in out]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each array of ids; bytes that are no UTF-8 become U+FFFD."""
        flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        n = self.lengths[flat]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = self.pool[np.repeat(self.starts[flat] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        edges = ends[np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]


def load(path: str) -> Bpe:
    return held(("bpe", path), lambda: Bpe(path))


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and, if asked for, decoded (string), which is
    decoded from those ids. One row per row of docs; path names the vocabulary's file, which every executor has.

    A null text is encoded as the empty one: no ids. Rows are independent: repeated rows give equal rows, other
    columns are ignored, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            sizes = pa.compute.binary_length(text).to_pylist() if len(text) else []
            for part in sections(sizes, CHARS_AT_ONCE):
                texts = text[part.start : part.stop].to_pylist()
                ids = bpe.encode(texts)
                columns = [key[part.start : part.stop], pa.array([x.tobytes() for x in ids], pa.binary())]
                if decoded:
                    columns.append(pa.array(bpe.decode(ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary" + ", decoded string" * decoded)


def decode(rows: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows whose ids are binary as encode() makes them; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            key, ids = batch.column(0), batch.column(1)
            sizes = pa.compute.binary_length(ids).to_pylist() if len(ids) else []
            for part in sections(sizes, CHARS_AT_ONCE):
                some = [np.frombuffer(x, "<u4") for x in ids[part.start : part.stop].to_pylist()]
                yield pa.RecordBatch.from_arrays([key[part.start : part.stop], pa.array(bpe.decode(some), pa.string())], ["doc_id", "text"])

    small_batches(rows.sparkSession)
    picked = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return picked.mapInArrow(run, "doc_id long, text string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or vocabulary_path(), decoded=True)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
