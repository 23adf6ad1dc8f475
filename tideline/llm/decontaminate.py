"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment on words.

1. One pass over the corpus finds every occurrence of a benchmark n-gram (blocks of benchmark
   n-grams of bounded size are broadcast, one pass each) and keeps the words around it.
2. Seeds join passages to items.  They are an item's n-grams that are not far more frequent in the
   corpus than its median one, and besides, in every passage, those of each unbroken run of known
   n-grams that are not far more frequent than the run's rarest.  So an item that leaked into a third
   of all documents keeps its seeds, and a passage that holds nothing but hot ones has seeds too.
   Only an item whose n-grams in a run are all far more frequent than both is not compared.
3. Each candidate passage is aligned with its items (match +1, mismatch and gap -1); the similarity
   is the best local score over the item's words.

Cases: a null text counts as empty and matches nothing; items of fewer than ``n`` words are too
short to tell and take no part; repeated items or documents each match on their own; rows with a
null key are matched and keep the null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ragged
from .shared import materialize, texts

BLOCK_GRAMS = 2 << 20
GRAM = 5
SIMILARITY = 0.5


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two sequences of word hashes: score, and the passage words it spans (end exclusive).

    Gaps along the passage are closed by a running maximum, so that a row takes a few array steps.
    """
    n = len(passage)
    at = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), at.copy()
    best = (0, 0, 0)
    for word in item:
        step = np.where(passage == word, 1, -1)
        new, start = np.zeros(n + 1, np.int64), at.copy()
        diagonal, above = row[:-1] + step, row[1:] - 1
        take = np.maximum(diagonal, above)
        new[1:] = np.maximum(take, 0)
        start[1:] = np.where(take > 0, np.where(diagonal >= above, begin[:-1], begin[1:]), at[1:])
        lifted = new + at  # a gap of k words costs k
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, at, 0))
        score = top - at
        row, begin = score, np.where(score > 0, start[source], at)
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k)
    return best


def _word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, starts, ends, per_text = ragged.words(buf, offs)
    codes, found = ragged.distinct(low, starts, ends)
    return (ragged.hash_words(found)[codes] if len(codes) else np.empty(0, np.uint64)), per_text


def _grams(hashes: np.ndarray, per_text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word runs; texts of fewer words have none."""
    full = np.maximum(per_text - n + 1, 0)
    at = ragged.spread((np.cumsum(per_text) - per_text)[full > 0], full[full > 0])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = ragged.mix(out * np.uint64(3) + hashes[at + k]) if len(at) else out
    return out, full


def item_grams(items: DataFrame, item_key: str, text: str, n: int) -> DataFrame:
    """``item, gram, words`` (the item's word hashes) for every distinct n-gram of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in ragged.slices(batches, text):
            hashes, per_text = _word_hashes(buf, offs)
            grams, count = _grams(hashes, per_text, n)
            edge, gram_edge = np.concatenate([[0], np.cumsum(per_text)]), np.concatenate([[0], np.cumsum(count)])
            keep = [d for d in range(part.num_rows) if count[d]]
            yield pa.record_batch([part.column(item_key).take(pa.array(keep, pa.int64())), pa.array([np.unique(grams[gram_edge[d] : gram_edge[d + 1]]).view(np.int64).tolist() for d in keep], pa.list_(pa.int64())), pa.array([hashes[edge[d] : edge[d + 1]].tobytes() for d in keep], pa.binary())], ["item", "grams", "words"])

    rows = texts(items, F.col(item_key).cast("long").alias(item_key), text=text)
    return rows.mapInArrow(run, "item long, grams array<long>, words binary")


def _passages(rows: DataFrame, key: str, text: str, known: np.ndarray, n: int, reach: int) -> DataFrame:
    """Runs of words around occurrences of ``known`` n-grams: ``doc, start, words, runs``; what overlaps is one passage, ``runs`` its n-grams by unbroken run."""
    shared = rows.sparkSession.sparkContext.broadcast(known)  # at most BLOCK_GRAMS hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for part, buf, offs in ragged.slices(batches, text):
            hashes, per_text = _word_hashes(buf, offs)
            grams, count = _grams(hashes, per_text, n)
            if not len(grams) or not len(wanted):
                continue
            at = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == grams)
            if not len(hit):
                continue
            doc = np.repeat(np.arange(part.num_rows), count)[hit]
            first, gram_first = np.cumsum(per_text) - per_text, np.cumsum(count) - count
            word = hit - gram_first[doc]
            apart = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] - word[:-1] > 2 * reach)]))
            stop = np.append(apart[1:], len(hit))
            docs, starts, words, own = [], [], [], []
            for a, b in zip(apart.tolist(), stop.tolist()):
                d = doc[a]
                low, high = max(0, int(word[a]) - reach), min(int(per_text[d]), int(word[b - 1]) + n + reach)
                docs.append(int(d))
                starts.append(low)
                words.append(hashes[first[d] + low : first[d] + high].tobytes())
                own.append([np.unique(g).view(np.int64).tolist() for g in np.split(grams[hit[a:b]], np.flatnonzero(np.diff(word[a:b]) > 1) + 1)])
            yield pa.record_batch([part.column(key).take(pa.array(docs)), pa.array(starts), pa.array(words, pa.binary()), pa.array(own, pa.list_(pa.list_(pa.int64())))], ["doc", "start", "words", "runs"])

    return rows.mapInArrow(run, "doc long, start long, words binary, runs array<array<long>>")


def find_leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", item_key: str = "item_id", text: str = "text", n: int = GRAM, similarity: float = SIMILARITY, common: float = 20.0, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``key, item_key, similarity, start_word, end_word``: the best passage of each document for each item it holds."""
    spark = docs.sparkSession
    known = materialize(item_grams(items, item_key, text, n), "leak-items")
    listed = known.select("item", F.explode("grams").alias("gram")).distinct()
    total, longest = known.select(F.coalesce(F.sum(F.size("grams")), F.lit(0)), F.coalesce(F.max(F.length("words") / 8), F.lit(0))).first()
    rows = texts(docs, F.col(key).cast("long").alias(key), text=text)
    blocks = max(1, -(-int(total) // block_grams))
    found = None
    for b in range(blocks):  # one pass for each block of benchmark n-grams
        part = listed.select("gram").distinct().filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b)
        grams = np.sort(np.array([r.gram for r in part.collect()], np.int64).view(np.uint64))
        one = _passages(rows, key, text, grams, n, int(longest))
        found = one if found is None else found.unionByName(one)
    passages = materialize(found.withColumn("passage", F.monotonically_increasing_id()), "leak-passages")

    hits = passages.select("passage", F.posexplode("runs").alias("run", "grams")).select("passage", "run", F.explode("grams").alias("gram"))
    frequency = materialize(hits.select("passage", "gram").distinct().groupBy("gram").agg(F.count("*").alias("df")), "leak-grams")
    rated = listed.join(frequency, "gram")
    usual = rated.groupBy("item").agg(F.percentile("df", F.lit(0.5)).alias("usual"))
    seeds = rated.join(usual, "item").filter(F.col("df") <= common * F.col("usual")).select("item", "gram")
    run_of = Window.partitionBy("passage", "run")  # a run is part of one text
    rarest = hits.join(frequency, "gram").withColumn("least", F.min("df").over(run_of)).filter(F.col("df") <= common * F.col("least"))
    joined = hits.join(seeds, "gram").select("passage", "item").union(rarest.join(listed, "gram").select("passage", "item"))
    pairs = materialize(joined.distinct(), "leak-pairs")
    passage, item = passages.select("passage", "doc", "start", "words"), known.select("item", F.col("words").alias("own")).distinct()
    candidates = pairs.join(passage, "passage").join(item, "item").select("doc", "start", "words", "item", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, start, words, i, own in zip(*(batch.column(c).to_pylist() for c in ("doc", "start", "words", "item", "own"))):
                target = np.frombuffer(own, np.uint64)
                score, a, b = align(target, np.frombuffer(words, np.uint64))
                if score >= similarity * len(target):
                    out.append((doc, i, score / len(target), start + a, start + b))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc", "item", "similarity", "a", "b"])

    aligned = candidates.repartition(F.xxhash64("doc", "start", "item")).mapInArrow(run, "doc long, item long, similarity double, a long, b long")
    best = aligned.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("a")).alias("before"), "b")).alias("m"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item_key), F.col("m.similarity").alias("similarity"), (-F.col("m.before")).alias("start_word"), F.col("m.b").alias("end_word"))
