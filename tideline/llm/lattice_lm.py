"""Language-model scores: marginal probability of every word over all its subword segmentations.

The vocabulary is an existing one and its own scores weight the pieces.  A word is a piece that
opens it and further pieces until a stop; log-space forward recursion sums over all segmentations.
A text is its words and one end, whose share is learned.  As words are independent, every distinct
word of the corpus is scored once.  ``score`` is this probability.

Two further columns learn more from the training rows: ``tuned_score`` weights the pieces by expected
counts over the distinct training words (forward-backward, weighted by word counts), starting from the
vocabulary's scores; ``mixed_score`` gives, besides, every word seen in training an edge over its whole
length with its discounted relative frequency, the mass taken off paying for the lattice.

Cases: a null text counts as empty (one token, the end); every row is scored, also those that share a
key; a null key is a key; no rows give none; with no training rows the vocabulary's own weights score
and nothing is known; other columns are ignored whatever their names.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .shared import crc_mod, materialize

MARK = "▁"  # opens a word in sentencepiece vocabularies
END = "\n"  # stands for a text's end in the word table; no word holds white space
_HASH = 0x9E3779B97F4A7C15
HEAD_WORDS = 50_000


class Lattice:
    """Piece weights: ``first`` and ``rest`` map pieces to numbers of ``weight`` (natural logs); ``stop`` is the chance to end after a piece.

    Words are handled in batches on flat arrays: node ``i`` of a word stands before its character
    ``i``, an edge is a piece that leads from one node to a later one (from -1 where it opens the
    word), and the recursions take one character position of all words of a batch at a time.
    """

    def __init__(self, first: dict[str, int], rest: dict[str, int], byte: list[int], weight: np.ndarray, stop: float = 0.4):
        self.first, self.rest, self.byte = first, rest, byte
        self.weight, self.stop = weight, stop
        self._tables()

    def _tables(self) -> None:
        """Per length the sorted hashes of all beginnings of pieces, and the pieces (or -1) that they are."""
        levels: list[dict[int, list[int]]] = []
        for column, pieces in enumerate((self.first, self.rest)):
            for piece, number in pieces.items():
                h, level = 0, {}
                for n, char in enumerate(piece):
                    h = ((h ^ ord(char)) * _HASH) & 0xFFFFFFFFFFFFFFFF
                    h ^= h >> 29
                    if n == len(levels):
                        levels.append({})
                    level = levels[n].setdefault(h, [-1, -1])
                if piece:
                    level[column] = number
        self.levels = []
        for level in levels:
            order = sorted(level)
            self.levels.append((np.array(order, np.uint64), np.array([level[h] for h in order], np.int64)))

    @classmethod
    def load(cls, path: str) -> Lattice:
        """From a sentencepiece model: scores that are merge ranks become Zipf weights, log probabilities stay."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        first, rest, byte, prior = {}, {}, [0] * 256, []
        scores = [model.get_score(i) for i in range(model.get_piece_size())]
        ranked = min(scores) < -1000
        for i, score in enumerate(scores):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte[int(piece[3:5], 16)] = len(prior)
                prior.append(1e-4)
            elif not model.is_control(i) and not model.is_unknown(i) and MARK not in piece[1:]:
                if piece.startswith(MARK):
                    first[piece[1:]] = len(prior)
                else:
                    rest[piece] = len(prior)
                prior.append(1 / (10 - score) if ranked else math.exp(score))
        if "" not in first:
            first[""] = len(prior)
            prior.append(1e-3)
        out = cls(first, rest, byte, np.zeros(len(prior)))
        out.reweigh(np.zeros(len(prior)), 0.0, 0.0, np.array(prior))
        return out

    def reweigh(self, counts: np.ndarray, words: float, pieces: float, prior: np.ndarray | None = None, strength: float = 1000.0) -> None:
        """Weights from expected counts, with ``strength`` counts spread as the present weights (or ``prior``)."""
        base = np.exp(self.weight) if prior is None else prior
        weight = np.empty(len(base))
        for group in ([*self.first.values()], [*self.rest.values(), *self.byte]):
            own = np.array(sorted(set(group)))
            share = 0.9 * base[own] / base[own].sum() + 0.1 / len(own)
            weight[own] = np.log((counts[own] + strength * share) / (counts[own].sum() + strength))
        self.weight = weight
        self.stop = min(0.99, max(0.01, (words + 40.0) / (pieces + 100.0)))

    def _edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """``start, end, weight, piece, word, position of end`` of all edges; piece -2 - c spells the character c in bytes."""
        more = math.log1p(-self.stop)
        size = np.fromiter(map(len, words), np.int64, len(words))
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), size)
        begin = np.cumsum(size) - size
        inner = np.arange(len(cp)) - begin[word]
        node = np.arange(len(cp)) + word
        wide = cp.astype(np.uint64)
        start, piece, length, chars = [], [], [], []

        def add(at: np.ndarray, opening: bool, pieces: np.ndarray, n: int) -> None:
            chars.append(at)
            start.append(np.full(len(at), -1) if opening else node[at])
            piece.append(pieces)
            length.append(np.full(len(at), n))

        at, h = np.arange(len(cp)), np.zeros(len(cp), np.uint64)
        spell = np.ones(len(cp), bool)
        for n, (hashes, pieces) in enumerate(self.levels, 1):
            fits = inner[at] + n <= size[word[at]]
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = (h ^ wide[at + (n - 1)]) * np.uint64(_HASH)
            h ^= h >> np.uint64(29)
            slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[slot] == h
            at, h, slot = at[known], h[known], slot[known]
            opens = (pieces[slot, 0] >= 0) & (inner[at] == 0)
            add(at[opens], True, pieces[slot[opens], 0], n)
            goes = pieces[slot, 1] >= 0
            add(at[goes], False, pieces[slot[goes], 1], n)
            if n == 1:
                spell[at[goes]] = False
        lone = np.flatnonzero(spell)
        add(lone, False, -2 - cp[lone].astype(np.int64), 1)
        start, piece, length, chars = map(np.concatenate, (start, piece, length, chars))
        owner = word[chars]
        end, position = node[chars] + length, inner[chars] + length
        weight = np.empty(len(piece))
        plain = piece >= 0
        weight[plain] = self.weight[piece[plain]] + np.where(start[plain] >= 0, more, 0.0)
        spelled, which = np.unique(piece[~plain], return_inverse=True)
        weight[~plain] = np.array([self._spelled(chr(-2 - p)) for p in spelled.tolist()])[which] if len(spelled) else 0.0
        if "" in self.first:
            k = len(words)
            start, end = np.append(start, np.full(k, -1)), np.append(end, begin + np.arange(k))
            weight, piece = np.append(weight, np.full(k, self.weight[self.first[""]])), np.append(piece, np.full(k, self.first[""]))
            owner, position = np.append(owner, np.arange(k)), np.append(position, np.zeros(k, np.int64))
        order = np.lexsort((end, position))
        return tuple(x[order] for x in (start, end, weight, piece, owner, position))

    @property
    def w_first(self) -> dict[str, float]:
        return {p: float(self.weight[i]) for p, i in self.first.items()}

    @property
    def w_rest(self) -> dict[str, float]:
        return {p: float(self.weight[i]) + math.log1p(-self.stop) for p, i in self.rest.items()}

    def _bytes(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")]

    def _spelled(self, char: str) -> float:
        return sum(float(self.weight[b]) + math.log1p(-self.stop) for b in self._bytes(char))

    @staticmethod
    def _forward(start: np.ndarray, end: np.ndarray, weight: np.ndarray, position: np.ndarray, nodes: int) -> np.ndarray:
        """Log probability to reach each node; the last entry is that of starting, 0."""
        alpha = np.full(nodes + 1, -np.inf)
        alpha[-1] = 0.0
        _steps(alpha, start, end, weight, position)
        return alpha

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Natural log of the probability of each non-empty word, summed over all its segmentations."""
        out = []
        for batch in _by_length(words):
            start, end, weight, _, _, position = self._edges(batch)
            sizes = np.fromiter(map(len, batch), np.int64, len(batch))
            alpha = self._forward(start, end, weight, position, int(sizes.sum()) + len(batch))
            out.append(alpha[np.cumsum(sizes + 1) - 1] + math.log(self.stop))
        return np.concatenate(out) if out else np.empty(0)

    def log_prob(self, word: str) -> float:
        return float(self.log_probs([word])[0])

    def expect_all(self, words: list[str], count: np.ndarray, counts: np.ndarray) -> float:
        """Add the expected uses of each piece in words that occur ``count`` times; returns the expected number of pieces."""
        used, done = 0.0, 0
        for batch in _by_length(words):
            times, done = count[done : done + len(batch)], done + len(batch)
            start, end, weight, piece, owner, position = self._edges(batch)
            sizes = np.fromiter(map(len, batch), np.int64, len(batch))
            last = np.cumsum(sizes + 1) - 1
            alpha = self._forward(start, end, weight, position, int(sizes.sum()) + len(batch))
            beta = np.full(len(alpha), -np.inf)
            beta[last] = 0.0
            inside = np.flatnonzero(start >= 0)
            back = start[inside] - (last - sizes)[owner[inside]]
            inside = inside[np.lexsort((start[inside], -back))]
            _steps(beta, end[inside], start[inside], weight[inside], start[inside] - (last - sizes)[owner[inside]])
            reach = alpha[start] + weight + beta[end] - alpha[last][owner]
            share = times[owner] * np.exp(np.minimum(0.0, reach))
            plain = piece >= 0
            counts += np.bincount(piece[plain], share[plain], len(counts))
            used += float(share[plain].sum())
            spelled, which = np.unique(piece[~plain], return_inverse=True)
            for p, x in zip(spelled.tolist(), np.bincount(which, share[~plain], len(spelled)).tolist()):
                for b in self._bytes(chr(-2 - p)):
                    counts[b] += x
                    used += x
        return used

    def expect(self, word: str, count: float, counts: np.ndarray) -> float:
        return self.expect_all([word], np.array([count]), counts)


def _by_length(words: list[str], chars: int = 1 << 18) -> Iterator[list[str]]:
    """Consecutive words of about ``chars`` characters in all, one at least."""
    at, held = 0, 0
    for i, word in enumerate(words):
        if i > at and held + len(word) > chars:
            yield words[at:i]
            at, held = i, 0
        held += len(word)
    if at < len(words):
        yield words[at:]


def _steps(value: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray, position: np.ndarray) -> None:
    """Log-space recursion: ``value[end]`` sums ``value[start] + weight`` over its edges, which lie grouped by position, then end."""
    if not len(end):
        return
    cuts = np.flatnonzero(np.diff(position)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(end)]):
        to = end[a:b]
        head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        value[to[head]] = np.logaddexp.reduceat(value[start[a:b]] + weight[a:b], head)


def _postings(rows: DataFrame, key: str, text: str, limit: int = 8 << 20) -> DataFrame:
    """``word, docs, tfs, keys, train``: per slice of the corpus, each distinct word with the numbers of its rows; the end is a word, and has their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in ragged.slices(batches, text, limit):
            keys = part.column(key)
            numbers = part.column("number").to_numpy(zero_copy_only=False)
            train = part.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
            low, starts, ends, per_text = ragged.words(buf, offs)
            codes, found = ragged.distinct(low, starts, ends, pa.large_string())
            n = len(numbers)
            pair, tf = np.unique(codes.astype(np.int64) * n + np.repeat(np.arange(n), per_text), return_counts=True)
            code, doc = pair // n, pair % n
            begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
            learned = np.add.reduceat(tf * train[doc], begin) if len(begin) else begin
            edge = np.concatenate([begin, [len(code), len(code) + n]]).astype(np.int32)
            word = pa.concat_arrays([found.take(pa.array(code[begin])).cast(pa.string()), pa.array([END])])
            docs, tfs = np.concatenate([numbers[doc], numbers]), np.concatenate([tf, np.ones(n, np.int64)]).astype(np.int32)
            only = pa.array(np.append(np.zeros(len(word), np.int32), n).astype(np.int32))
            lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x)) for x in (docs, tfs)]
            yield pa.record_batch([word, *lists, pa.ListArray.from_arrays(only, keys), pa.array(np.append(learned, train.sum()))], ["word", "docs", "tfs", "keys", "train"])

    return rows.mapInArrow(run, "word string, docs array<long>, tfs array<int>, keys array<long>, train long")


def _learn(lattice: Lattice, counted: DataFrame, rounds: int) -> None:
    """Expectation-maximisation of the piece weights over ``word, c``; only per-piece sums reach the driver."""
    spark = counted.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(lattice)  # its size is the vocabulary's

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            counts, words, pieces = np.zeros(len(model.weight)), 0.0, 0.0
            for batch in batches:
                c = batch.column("c").to_numpy(zero_copy_only=False).astype(float)
                pieces += model.expect_all(batch.column("word").to_pylist(), c, counts)
                words += float(c.sum())
            some = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([counts[some], [words, pieces]]))], ["piece", "n"])

        sums = {r.piece: r.n for r in counted.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        counts = np.zeros(len(lattice.weight))
        for p, n in sums.items():
            if p >= 0:
                counts[p] = n
        lattice.reweigh(counts, sums.get(-1, 0.0), sums.get(-2, 0.0))


def lattice_scores(docs: DataFrame, vocabulary: str | Lattice, *, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, rounds: int = 2, head: int = HEAD_WORDS) -> DataFrame:
    """Score all texts with a model of those whose key's checksum modulo ``folds`` is not ``held``.

    Columns: ``key, held_out, n_tokens, n_known, train_tokens, base_score, score, tuned_score, mixed_score`` (log10).
    ``vocabulary`` is a sentencepiece file or a ``Lattice``.  Words in over 1 / ``head`` of all postings
    are joined by broadcast, ``head`` words at most, so no word's postings meet in one task.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    rows = rows.withColumns({"train": crc_mod(key, folds) != held, "number": F.monotonically_increasing_id()})
    postings = materialize(_postings(rows, key, text), "lm-postings")
    counted = materialize(postings.groupBy("word").agg(F.sum("train").alias("c"), F.sum(F.size("docs")).alias("df")), "lm-words")
    seen, one = counted.filter("c > 0"), lambda k: F.count_if(F.col("c") == k)
    n, v, ends, n1, n2 = (int(x or 0) for x in seen.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == END, F.col("c"))), one(1), one(2)).first())

    own = vocabulary if isinstance(vocabulary, Lattice) else Lattice.load(vocabulary)
    lattice = copy.copy(own)
    if n:
        _learn(lattice, seen.filter(F.col("word") != END), rounds)
    shared = docs.sparkSession.sparkContext.broadcast((own, lattice))  # their size is the vocabulary's
    words, kinds = n - ends, v - (ends > 0)
    mass = (n1 + 1) / max(kinds, 1)  # few words seen once: little is left to new ones
    discount = min(0.9, mass, n1 / (n1 + 2 * n2) if n1 else 0.5)
    p_end = (ends + 1) / (n + 2)
    lattice_share = discount * kinds / words if words else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            ends_here = np.array(texts) == END
            c = batch.column("c").to_numpy(zero_copy_only=False)
            seen = c > 0
            first, tuned = (model.log_probs(texts) for model in shared.value)
            mixed = tuned + math.log(lattice_share)
            mixed[seen] = np.logaddexp(np.log((c[seen] - discount) / max(words, 1)), mixed[seen])
            out = [pa.array(np.where(ends_here, math.log10(p_end), (lp + math.log1p(-p_end)) / math.log(10)), pa.float64()) for lp in (first, tuned, mixed)]
            yield pa.record_batch([batch.column("word"), batch.column("c"), batch.column("df"), *out], ["word", "c", "df", "own", "tuned", "mixed"])

    scored = materialize(counted.mapInArrow(run, "word string, c long, df long, own double, tuned double, mixed double"), "lm-scored")
    least = (counted.agg(F.sum("df")).first()[0] or 0) // head
    common, other = scored.filter(F.col("df") > least).drop("df"), scored.filter(F.col("df") <= least).drop("df")
    met = postings.drop("train").join(F.broadcast(common), "word", "left")
    rare = met.filter("c is null").select("word", "docs", "tfs", "keys").join(other, "word")
    weights = ["c", "own", "tuned", "mixed"]
    each = met.filter("c is not null").select(*weights, "docs", "tfs", "keys").union(rare.select(*weights, "docs", "tfs", "keys"))
    each = each.select(*weights, F.explode(F.arrays_zip("docs", "tfs", "keys")).alias("x")).select(*weights, F.col("x.docs").alias("doc"), F.col("x.tfs").alias("tf"), F.col("x.keys").alias("id"))
    sums = each.groupBy("doc").agg(
        F.max("id").alias(key),
        F.sum("tf").alias("n_tokens"),
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("known_score"),
        *(F.sum(F.col("tf") * F.col(w)).alias(w) for w in ("own", "tuned", "mixed")),
    )
    return sums.select(
        key,
        (crc_mod(key, folds) == held).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("known_score") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        F.col("own").alias("score"),
        F.col("tuned").alias("tuned_score"),
        F.col("mixed").alias("mixed_score"),
    )
