"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

1. Coarse centroids and residual codebooks are fitted on a bounded sample of distinct vectors.
2. Every vector is assigned to its nearest centroid's list and its residual coded, one byte for
   each group of components.  Of equal vectors only as many as an answer can hold are indexed.
3. A query visits its nearest lists, as many as a trial asks for: the true neighbours of a bounded
   number of queries are found by one exact pass over all vectors, and the lists that hold them are
   ranked by distance from the query; the least number of probes, ``probes`` at least, under which
   ``RECALL`` of these neighbours lie is used for every query.  Lists are dealt in blocks, queries of a list too, so that no
   task meets an unbounded group.  In a block, distance tables of the query's residual give the
   asymmetric distance of each code, and with the vector's quantising error a bound on the true one
   from either side.  No vector that the bounds leave in the running is dropped; these are measured
   exactly on the original vectors, so a visited list loses none of its nearest.
4. The best of all blocks are merged per query, ties to the smaller id.

Cases: rows with a null key take no part, nor do vectors that are null, zero, of another length
than the sample's most common one, or hold null or non-finite components; rows that repeat a
query's id are its own row; repeated candidates are answers each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

SAMPLE_ROWS = 16_384
LISTS = 1024
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 4096
TRIAL_QUERIES, RECALL = 256, 0.99


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most ``k`` centroids; empty ones are moved to the points farthest from theirs."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = _squared(x, centers)
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centers[empty] = x[np.argsort(-d.min(1), kind="stable")[: len(empty)]]
    return centers


@dataclass
class Quantiser:
    centroids: np.ndarray
    groups: list[np.ndarray]  # component numbers of each code
    books: list[np.ndarray]
    shift: np.ndarray  # taken off before squares are summed, so that vectors far from 0 keep their digits

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, codes: int = 16, seed: int = 7) -> Quantiser:
        shift = x.mean(0)
        centroids = k_means(x - shift, lists, 12, seed)
        residual = x - shift - centroids[_squared(x - shift, centroids).argmin(1)]
        groups = [g for g in np.array_split(np.arange(x.shape[1]), min(codes, x.shape[1])) if len(g)]
        return cls(centroids, groups, [k_means(residual[:, g], 256, 8, seed + j) for j, g in enumerate(groups)], shift)

    def to_lists(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to all centroids."""
        return _squared(x - self.shift, self.centroids)

    def residuals(self, x: np.ndarray, at: int | np.ndarray) -> np.ndarray:
        return x - self.shift - self.centroids[at]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantising error of each vector."""
        own = self.to_lists(x).argmin(1)
        residual = self.residuals(x, own)
        codes = np.column_stack([_squared(residual[:, g], b).argmin(1).astype(np.uint8) for g, b in zip(self.groups, self.books)])
        left = sum(((residual[:, g] - b[codes[:, j]]) ** 2).sum(1) for j, (g, b) in enumerate(zip(self.groups, self.books)))
        return own, codes, np.sqrt(left)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        d = self.to_lists(x)
        n = min(n, d.shape[1])
        return np.argpartition(d, n - 1, axis=1)[:, :n]

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Approximate squared distances of queries to the coded vectors of list ``at``, by table look-up."""
        residual = self.residuals(queries, at)
        out = np.zeros((len(queries), len(codes)))
        for j, (g, book) in enumerate(zip(self.groups, self.books)):
            out += _squared(residual[:, g], book)[:, codes[:, j]]
        return out


def _in_running(quantiser: Quantiser, at: int, queries: np.ndarray, v: np.ndarray, codes: np.ndarray, error: np.ndarray, open_: np.ndarray, k: int) -> np.ndarray:
    """Which of the ``open_`` vectors can be among a query's ``k`` nearest of a block; a superset, from bounds with room for rounding."""
    k = min(k, len(v))
    near, own = quantiser.residuals(queries, at), quantiser.residuals(v, at)
    long = (near * near).sum(1)[:, None] + (own * own).sum(1)[None, :]
    slack, rough = 1e-12 * 4 * long, quantiser.distances(queries, at, codes)
    high = np.where(open_, np.sqrt(rough + slack) + error, np.inf)
    stay = open_ & (np.sqrt(np.maximum(rough - slack, 0)) - error <= np.partition(high, k - 1, axis=1)[:, k - 1, None] * (1 + 1e-9))
    used = np.flatnonzero(stay.any(0))
    d = np.where(stay[:, used], _squared(near, own[used]), np.inf)
    slack = slack[:, used]
    least = min(k, len(used))
    worst = np.partition(d + slack, least - 1, axis=1)[:, least - 1, None] if least else d
    out = np.zeros_like(stay)
    out[:, used] = stay[:, used] & (d - slack <= worst)
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def needed_probes(indexed: DataFrame, trial: np.ndarray, own: np.ndarray, quantiser, k: int, least: int, recall: float) -> int:
    """The lists to visit so that ``recall`` of the true ``k`` nearest of the trial queries lie in them.

    Every batch of vectors keeps its best ``k`` per query, so what is sent on does not grow with the rows of a batch.
    """
    asked = indexed.sparkSession.sparkContext.broadcast((trial, own, quantiser.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, shift = asked.value
        best = np.full((len(x), 0), 0.0), np.full((len(x), 0), 0, np.int64), np.full((len(x), 0), 0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            found, at = batch.column("id").to_numpy(), batch.column("list").to_numpy().astype(np.int64)
            d = np.where(found[None, :] == ids[:, None], np.inf, _squared(x - shift, _matrix(batch.column("v")) - shift))
            d, found, at = (np.hstack([a, np.broadcast_to(b, d.shape)]) for a, b in zip(best, (d, found, at)))
            few = np.lexsort((found, d))[:, :k] if d.shape[1] > k else np.broadcast_to(np.arange(d.shape[1]), d.shape)
            best = tuple(np.take_along_axis(a, few, 1) for a in (d, found, at))
        q = np.repeat(np.arange(len(x)), best[0].shape[1])
        fine = np.isfinite(best[0].ravel())
        yield pa.record_batch([pa.array(c.ravel()[fine]) for c in (q, *best)], ["q", "d", "id", "list"])

    found = indexed.select("id", "v", "list").mapInArrow(run, "q long, d double, id long, list long")
    order = Window.partitionBy("q").orderBy("d", "id")
    true = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("q", "list").collect()  # at most k a trial query
    rank = np.argsort(np.argsort(quantiser.to_lists(trial), axis=1, kind="stable"), axis=1, kind="stable")
    places = np.sort([rank[r.q, r.list] for r in true])
    return max(least, int(places[int(np.ceil(recall * len(places))) - 1]) + 1) if len(places) else least


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & whole & F.exists(vector, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, probes: int = 48, sample_rows: int = SAMPLE_ROWS, lists: int = LISTS, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES, trial_queries: int = TRIAL_QUERIES, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score`` (Euclidean distance) of the ``k`` nearest found for each query row."""
    plain = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sample = plain.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample_rows).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    sizes = np.bincount([len(r.v) for r in sample])
    width = int(sizes.argmax())
    x = np.unique(np.array([r.v for r in sample if len(r.v) == width]), axis=0)
    plain = plain.filter(F.size("v") == width)
    total = plain.count()
    quantiser = vectors.sparkSession.sparkContext.broadcast(Quantiser.fit(x, min(lists, max(1, round(total**0.5)), max(1, len(x) // 8))))

    same = Window.partitionBy("v").orderBy("id")
    kept = plain.select("id", "v").withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, codes, error = quantiser.value.encode(_matrix(batch.column("v")))
                yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["id", "v", "list", "codes", "error"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = quantiser.value.probes(_matrix(batch.column("v")), probes)
                yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(found.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["id", "v", "lists"])

    indexed = materialize(kept.select("id", "v").mapInArrow(code, "id long, v array<double>, list int, codes binary, error double"), "ann-index")
    trial = plain.filter("q").select("id", "v").distinct().orderBy(F.xxhash64("id", F.lit(5)), "id", "v").limit(trial_queries).collect()
    if trial and len(quantiser.value.centroids) > probes:
        x, own = np.array([r.v for r in trial]), np.array([r.id for r in trial], np.int64)
        probes = needed_probes(indexed, x, own, quantiser.value, k, probes, recall)
    asked = plain.filter("q").select("id", "v").distinct().mapInArrow(probe, "id long, v array<double>, lists array<int>")
    asked = materialize(asked.select("id", "v", F.explode("lists").alias("list")), "ann-queries")
    blocks = indexed.groupBy("list").agg(F.ceil(F.count("*") / block_vectors).cast("int").alias("blocks")).join(asked.groupBy("list").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("parts")), "list")
    blocks = F.broadcast(blocks)  # a row per list, of which there are at most ``lists``
    salt = F.xxhash64("id")
    left = asked.join(blocks, "list").select("id", "v", "list", F.pmod(salt, "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = indexed.join(blocks, "list").select("id", "v", "codes", "error", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(salt, "blocks").cast("int").alias("block"))

    def search(queries: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and found.num_rows:
            ids = found.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], _matrix(found.column("v"))[order]
            codes = np.frombuffer(b"".join(found.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            error = found.column("error").to_numpy()[order]
            at = queries.column("list")[0].as_py()
            asking, q = queries.column("id").to_numpy(), _matrix(queries.column("v"))
            for a in range(0, len(q), 256):
                others = ids[None, :] != asking[a : a + 256, None]
                few = _in_running(quantiser.value, at, q[a : a + 256], v, codes, error, others, k)
                for i, row in enumerate(map(np.flatnonzero, few)):
                    exact = np.sqrt(((v[row] - q[a + i]) ** 2).sum(1))
                    top = np.lexsort((ids[row], exact))[:k]
                    out.append((np.full(len(top), asking[a + i]), ids[row][top], exact[top]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    found = left.groupBy("list", "part", "block").cogroup(right.groupBy("list", "part", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
