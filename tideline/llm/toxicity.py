"""Toxicity scores by weak supervision.

1. Terms (words and word beginnings) that labelled training rows hold far more or less often than
   the other class are counted over a bounded sample of labelled rows; the strongest become voters
   besides fixed lexicons and patterns.
2. A generative label model (expectation-maximisation) estimates how each voter votes in either
   class and how voters correlate within a class; correlated voters share their weight.  The label
   marks themselves are one more voter with an accuracy of its own.
3. A linear classifier on the terms is trained on the posterior labels and scores every whole text
   in one narrow pass.

Cases: a null or empty text has a score like any other (that of no terms); repeated rows each give
a row; a null key is held out by the checksum of the empty text; without labelled rows of both
classes the fixed lexicons alone give the score; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import ragged
from .shared import crc_mod, materialize

#: Bytes of text that a task works on at a time; its arrays take some 50 times as many.
SLICE_BYTES = 1 << 20
SAMPLE_ROWS = 20_000  # labelled rows that the model is fitted on, at most
TERMS = 4096
_EDGE = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_BEGINNINGS = range(4, 10)  # bytes of a word's beginning

#: Common words of abuse by kind.
LEXICONS = {
    "insult": "idiot moron stupid fool dumb imbecile clown loser",
    "contempt": "pathetic worthless disgusting useless",
    "filth": "trash scum garbage filth vermin",
}


def word_terms(token: bytes) -> list[bytes]:
    """The word without outer punctuation, and its beginnings."""
    word = token.strip(_EDGE)
    return [b"w:" + word, *(b"b:" + word[:n] for n in _BEGINNINGS if n < len(word))] if word else []


def slice_terms(buf: np.ndarray, offs: np.ndarray, known: dict[bytes, int] | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(text, term)`` of a slice with their counts; terms are numbers of the first list (or of ``known``)."""
    low, starts, ends, per_text = ragged.words(buf, offs)
    codes, found = ragged.distinct(low, starts, ends)
    used = np.zeros(len(found), bool)
    used[codes] = True
    number: dict[bytes, int] = known if known is not None else {}
    size, flat = np.zeros(len(found), np.int64), []
    for c, token in zip(np.flatnonzero(used).tolist(), found.filter(pa.array(used)).to_pylist()):
        own = [number[t] for t in word_terms(token) if t in number] if known is not None else [number.setdefault(t, len(number)) for t in word_terms(token)]
        size[c] = len(own)
        flat += own
    start = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(per_text)), per_text)
    hit = np.flatnonzero(size[codes]) if len(codes) else np.empty(0, np.int64)
    term = np.array(flat, np.int64)[ragged.spread(start[codes[hit]], size[codes[hit]])] if len(hit) else np.empty(0, np.int64)
    width = max(len(number), 1)
    pair, count = np.unique(np.repeat(doc[hit], size[codes[hit]]) * width + term, return_counts=True)
    return list(number), pair // width, pair % width, count


def pattern_votes(text: str) -> list[int]:
    """Votes of the patterns: shouting, piled exclamation marks, abuse in the second person."""
    low = text.lower()
    upper = sum(c.isupper() for c in text)
    return [int(upper > 20 and 2 * upper > sum(c.isalpha() for c in text)), int("!!" in text), int(any(f"you {w}" in low or f"you are {w}" in low for words in LEXICONS.values() for w in words.split()))]


@dataclass
class LabelModel:
    """Class-conditional vote tables of each voter, with weights that correlated voters share; the last voter is the marks."""

    voters: list[str]
    prior: float = 0.1
    tables: np.ndarray = field(default_factory=lambda: np.empty(0))  # voter, class, vote
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    correlations: np.ndarray = field(default_factory=lambda: np.empty(0))
    accuracies: np.ndarray = field(default_factory=lambda: np.empty(0))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic class for rows of votes 0, 1 or 2."""
        at = np.arange(len(self.voters))
        log = [np.log(self.tables[at, c, votes]) @ self.weights for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - self.prior) / self.prior), -500, 500)))

    def _maximise(self, votes: np.ndarray, n: np.ndarray, q: np.ndarray) -> None:
        self.prior = float(np.clip((n @ q + 1) / (n.sum() + 10), 1e-4, 0.9))
        for c, p in ((0, 1 - q), (1, q)):
            for v in range(3):
                self.tables[:, c, v] = (((votes == v) * (n * p)[:, None]).sum(0) + 0.5) / ((n * p).sum() + 1.5)

    def fit(self, votes: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int = 25) -> LabelModel:
        """EM over distinct vote rows with their numbers, beginning at posteriors ``start``.

        Correlations are taken at the start: once EM has settled, voters that agree by habit have
        become the class and look independent.
        """
        self.tables = np.full((len(self.voters), 2, 3), 1 / 3)
        self.correlations = self._correlate(votes > 0, n, start)
        self.weights = 1 / (1 + np.clip(self.correlations, 0, 1).sum(1))
        self.weights /= max(self.weights.max(), 1e-9)
        self.weights[-1] = 1.0  # the marks are what the class means; they share with none
        q = start
        for _ in range(rounds):
            self._maximise(votes, n, q)
            q = self.posterior(votes)
        right = np.where(votes > 0, q[:, None], 1 - q[:, None])
        self.accuracies = (right * n[:, None]).sum(0) / n.sum()
        return self

    @staticmethod
    def _correlate(hits: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Correlation of hits within the classes, averaged over both."""
        out = np.zeros((hits.shape[1], hits.shape[1]))
        for p in (q, 1 - q):
            w = n * p
            mean = w @ hits / max(w.sum(), 1e-9)
            off = hits - mean
            cov = (off * w[:, None]).T @ off / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            out += 0.5 * cov / np.outer(sd, sd)
        np.fill_diagonal(out, 0)
        return out


@dataclass
class Classifier:
    """Linear in the presence of a term and in its third occurrence."""

    terms: dict[bytes, int]
    once: np.ndarray
    often: np.ndarray
    bias: float

    @classmethod
    def of_lexicons(cls) -> Classifier:
        terms = {b"w:" + w.encode(): i for i, w in enumerate(w for words in LEXICONS.values() for w in words.split())}
        return cls(terms, np.full(len(terms), 2.0), np.zeros(len(terms)), -2.5)

    @classmethod
    def train(cls, terms: list[bytes], rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 400, penalty: float = 2e-4) -> Classifier:
        """Logistic regression on soft targets by Adam steps over all rows."""
        size, m = np.array([len(t) for t, _ in rows]), len(terms)
        doc, term, count = np.repeat(np.arange(len(rows)), size), np.concatenate([t for t, _ in rows]).astype(np.int64), np.concatenate([c for _, c in rows])
        doc, col = np.concatenate([doc, doc[count > 2]]), np.concatenate([term, m + term[count > 2]])
        w, bias = np.zeros(2 * m), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
        first, second = np.zeros(2 * m + 1), np.zeros(2 * m + 1)
        for step in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[col], len(rows)) + bias, -30, 30)))
            off = (p - target) / len(rows)
            slope = np.append(np.bincount(col, off[doc], 2 * m) + penalty * w, off.sum())
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            w, bias = w - move[:-1], bias - move[-1]
        return cls({t: i for i, t in enumerate(terms)}, w[:m], w[m:], float(bias))

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        _, doc, term, count = slice_terms(buf, offs, self.terms)
        total = np.bincount(doc, self.once[term] + np.where(count > 2, self.often[term], 0.0), len(offs) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


@dataclass
class ToxicityModel:
    classifier: Classifier
    label_model: LabelModel | None = None


def labelled_sample(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, folds: int, held: int, sample_rows: int) -> DataFrame:
    """Texts of at most ``sample_rows`` labelled training rows, those with the least hashes of their key."""
    known = labels.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)").filter(crc_mod("_id", folds) != held)
    picked = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows)
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sample = materialize(rows.join(F.broadcast(picked), "_id").select("_id", "_label", "_text"), "toxicity-sample")
    place = F.xxhash64("_id", "_text")
    if sample.count() > sample_rows:  # documents share keys: the rows of the least hashes stay
        last = sample.select(place.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
        sample = materialize(sample.filter(place <= last).dropDuplicates(), "toxicity-sample")
    return sample


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS, max_terms: int = TERMS) -> ToxicityModel:
    sample = labelled_sample(docs, labels, key=key, text=text, label=label, folds=folds, held=held, sample_rows=sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in ragged.slices(batches, "_text"):
            names, doc, term, _ = slice_terms(buf, offs)
            toxic = part.column("_label").to_numpy(zero_copy_only=False)[doc] if len(doc) else np.empty(0, np.int64)
            n = [np.bincount(term[toxic == c], minlength=len(names)) for c in (0, 1)]
            yield pa.record_batch([pa.array(names, pa.binary()), *(pa.array(x.astype(np.int64)) for x in n)], ["term", "clean", "bad"])

    totals = Counter({r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()})
    if not totals[0] or not totals[1]:
        return ToxicityModel(Classifier.of_lexicons())
    odds = F.log((F.col("bad") + 0.5) / F.lit(totals[1] + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(totals[0] + 1.0))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("clean") + 0.5))
    counted = sample.mapInArrow(count, "term binary, clean long, bad long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    strong = counted.filter(F.col("clean") + F.col("bad") >= 4).select("term", (odds / spread).alias("z")).filter("abs(z) > 2.5").orderBy(F.abs("z").desc(), "term").limit(max_terms).collect()
    if not strong:
        return ToxicityModel(Classifier.of_lexicons())
    terms = [bytes(r.term) for r in strong]
    mined = [i for i, r in enumerate(strong) if r.z > 4][:48]
    voters = [*LEXICONS, "shouting", "exclamations", "second person", *(f"mined {k}" for k in range(8)), "mark"]
    group = {i: len(LEXICONS) + 3 + k % 8 for k, i in enumerate(mined)}
    lexicon = {b"w:" + w.encode(): g for g, words in enumerate(LEXICONS.values()) for w in words.split()}
    known = {t: i for i, t in enumerate(dict.fromkeys([*terms, *lexicon]))}
    vote_of = np.full(len(known), -1)
    for t, i in known.items():
        vote_of[i] = lexicon.get(t, group.get(i, -1))
    shared = docs.sparkSession.sparkContext.broadcast(known)  # bounded by max_terms

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in ragged.slices(batches, "_text", SLICE_BYTES):
            _, doc, term, n = slice_terms(buf, offs, shared.value)
            votes = np.zeros((part.num_rows, len(voters)), np.int64)
            own = vote_of[term] >= 0
            np.add.at(votes, (doc[own], vote_of[term[own]]), n[own])
            votes = np.minimum(votes, 2)
            for d, t in enumerate(part.column("_text").to_pylist()):
                votes[d, len(LEXICONS) : len(LEXICONS) + 3] = pattern_votes(t)
            votes[:, -1] = part.column("_label").to_numpy(zero_copy_only=False)
            edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
            keep = term < len(terms)
            rows = [(term[a:b][keep[a:b]].astype(np.int32).tobytes(), np.minimum(n[a:b][keep[a:b]], 255).astype(np.uint8).tobytes()) for a, b in zip(edge[:-1], edge[1:])]
            yield pa.record_batch([pa.array([v.astype(np.uint8).tobytes() for v in votes], pa.binary()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1))], ["votes", "terms", "counts"])

    rows = sample.mapInArrow(vote, "votes binary, terms binary, counts binary").collect()  # at most sample_rows
    votes = np.array([np.frombuffer(r.votes, np.uint8) for r in rows]).astype(np.int64)
    distinct, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = LabelModel(voters).fit(distinct, n.astype(float), np.where(distinct[:, -1] == 1, 0.95, 0.02))
    target = model.posterior(distinct)[back.ravel()]
    return ToxicityModel(Classifier.train(terms, [(np.frombuffer(r.terms, np.int32), np.frombuffer(r.counts, np.uint8)) for r in rows], target), model)


def _scored(docs: DataFrame, model: ToxicityModel, rest: Column, text: str) -> DataFrame:
    """``rest, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.classifier)  # bounded by max_terms
    rows = docs.select(rest.alias("rest"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in ragged.slices(batches, "text", SLICE_BYTES):
            yield pa.record_batch([part.column("rest"), pa.array(shared.value.score(buf, offs))], ["rest", "score"])

    return rows.mapInArrow(run, StructType([rows.schema["rest"], StructField("score", DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held: int = 2, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``key, held_out, score, predicted`` of every row."""
    model = fit(docs, labels, key=key, text=text, label=label, folds=folds, held=held, sample_rows=sample_rows)
    scored = _scored(docs, model, F.col(key), text)
    return scored.select(F.col("rest").alias(key), (crc_mod("rest", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held: int = 2, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under ``threshold``."""
    model = fit(docs, labels, key=key, text=text, label=label, folds=folds, held=held, sample_rows=sample_rows)
    scored = _scored(docs, model, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), text)
    return scored.filter(F.col("score") < threshold).select("rest.*")
