"""Importance resampling towards a target: documents are drawn by how much likelier a target makes their features.

Features are runs of words, hashed into buckets.  Two Arrow passes:

1. every task counts its documents' buckets into one vector (``bincount``), and ``treeReduce`` adds the
   vectors up, for the documents and for the target; each bucket has a gain, the log ratio of its shares;
2. the gains (one vector of the buckets' number) go to every task, which adds them up per document.

Gumbel noise from a hash of the key turns the weights into a draw without replacement: the highest
scores are drawn.  Ranks come from a range sort whose partitions are counted, so no task holds more than its range.

Cases: a null or empty text has no features, weight 0 and no rank; a null key is hashed as the empty
text and comes last among equals; repeated rows are documents each; an empty target or table leaves
the gains to the smoothing; empty documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ragged
from .shared import materialize, texts

BUCKETS = 10_000

#: Bytes outside words: ASCII but for digits and letters.
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_GAP[0x41:0x5B] = False  # letters are lowered


def feature_buckets(buf: np.ndarray, offs: np.ndarray, longest: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every run of one to ``longest`` words, joined by one space, and the words of every text."""
    low, starts, ends, per_text = ragged.words(buf, offs, _GAP)
    code, spelled = ragged.distinct(low, starts, ends)
    spelled = spelled.to_pylist()
    crc = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(spelled))[code] if len(code) else np.empty(0, np.uint32)
    text = np.repeat(np.arange(len(per_text)), per_text)
    found, owner = [crc], [text]
    for k in range(1, longest):
        at = np.flatnonzero(text[k:] == text[:-k]) if len(text) > k else np.empty(0, np.int64)
        pairs, which = np.unique((crc[at].astype(np.uint64) << np.uint64(32)) | code[at + k].astype(np.uint64), return_inverse=True)
        longer = [zlib.crc32(b" " + spelled[p & 0xFFFFFFFF], p >> 32) for p in pairs.tolist()]
        crc = np.zeros(len(text), np.uint32)
        crc[at] = np.array(longer, np.uint32)[which]
        found.append(crc[at]), owner.append(text[at])
    return (np.concatenate(found) % np.uint32(size)).astype(np.int64), np.concatenate(owner), per_text


def bucket_counts(docs: DataFrame, *, text: str = "text", longest: int = 1, size: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: one vector per task, added up in a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, buf, offs in ragged.slices(batches, text):
            total += np.bincount(feature_buckets(buf, offs, longest, size)[0], minlength=size)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts(docs, text=text).mapInArrow(count, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(size, np.int64)
    # the driver adds up as many vectors as the depth-th root of the tasks
    depth = 2 if vectors.getNumPartitions() < 10_000 else 3
    return vectors.map(lambda r: np.frombuffer(r["counts"], np.int64)).treeReduce(np.add, depth)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))`` of every bucket."""
    s, t, size = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))))


def weigh(docs: DataFrame, gain: np.ndarray, *, key: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """``key, n_features, weight, words`` of every document, by the broadcast ``gain``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in ragged.slices(batches, text):
            bucket, owner, words = feature_buckets(buf, offs, longest, len(shared.value))
            n = part.num_rows
            weight = np.bincount(owner, shared.value[bucket], n).astype(np.int64)
            columns = [part.column(key), np.bincount(owner, minlength=n), weight, words.astype(np.int64)]
            yield pa.record_batch([columns[0], *map(pa.array, columns[1:])], [key, "n_features", "weight", "words"])

    rows = texts(docs, F.col(key).cast("long").alias(key), text=text)
    return rows.mapInArrow(add, f"`{key}` long, n_features long, weight long, words long")


def numbered(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Numbers from 1 over all rows in ``order``: a range sort, and the counts of the ranges before."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_place", F.monotonically_increasing_id()), "importance-order")
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(offsets, "_part")
    return joined.select(*rows.columns, (F.col("_before") + inside + 1).alias(name))


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", longest: int = 1, size: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``key, n_features, weight, score, rank`` of every document; ``rank`` of the drawn ``percent`` of those of ``least_words`` or more."""
    gain = gains(*(bucket_counts(d, text=text, longest=longest, size=size) for d in (docs, target)))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weigh(docs, gain, key=key, text=text, longest=longest).withColumn("score", F.col("weight") + noise)
    scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "importance-scores")
    able = F.col("words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("_row")]  # the row number splits ties over ranges
    ranked = numbered(scored.filter(able), *order)
    drawn = ranked.count() * percent // 100
    out = [key, "n_features", "weight", "score"]
    return ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(scored.filter(~able).select(*out, F.lit(None).cast("long").alias("rank")))
