"""Lexical retrieval packing: documents fill sequences together with their nearest neighbours.

1. Documents become token ids and the end id.  A scan task deals its documents, in order, into
   shards of bounded tokens, which are written to the shared folder.
2. Document frequencies of the tokens are summed over all shards (their number is the vocabulary's).
3. Every shard builds a BM25 inverted index of its documents.  The first unused document seeds a
   sequence; its best-scoring unused neighbours follow until the window is full, and what the last
   one has left over stays unused.  Longer documents fill whole windows first.
The rest of a shard closes with sequences of powers of two, which need no padding.

Cases: a null or empty text is its end id alone; repeated rows are packed each; a null key stays
null; an empty table gives no rows; other columns are ignored; a shard holds one document at least,
however long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .bpe_ids import byte_pair_ids
from .shared import materialize, texts

WINDOW = 2048
SHARD_TOKENS = 4 << 20
K1, B = 1.2, 0.75


def token_shards(docs: DataFrame, tokenizer: str, key: str, text: str, end_id: int, shard_tokens: int) -> DataFrame:
    """``shard, key, ids`` (unsigned little-endian 32 bits); the rows of a shard lie together in one partition."""
    rows = texts(docs, F.col(key).cast("long").alias(key), text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, held = byte_pair_ids(tokenizer), TaskContext.get().partitionId() << 24, 0
        for part, buf, offs in ragged.slices(batches, text):
            ids, n = encoder.encode(buf, offs)
            ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
            edge = np.concatenate([[0], np.cumsum(n + 1)])
            number = []
            for size in (n + 1).tolist():
                if held and held + size > shard_tokens:
                    shard, held = shard + 1, 0
                held += size
                number.append(shard)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((4 * edge).astype(np.int64)), pa.py_buffer(ids)])
            yield pa.record_batch([pa.array(number, pa.int64()), part.column(key), raw.cast(pa.binary())], ["shard", key, "ids"])

    return rows.mapInArrow(run, f"shard long, `{key}` long, ids binary")


def document_frequencies(shards: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents that hold each token id, documents, and tokens: one small row per task and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, last, docs, tokens = np.zeros(1, np.int64), np.zeros(1, np.int32), 0, 0
        for batch in batches:
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), "<u4")
                docs, tokens = docs + 1, tokens + len(ids)
                if len(ids) and ids.max() >= len(df):
                    df, last = (np.concatenate([x, np.zeros(int(ids.max()) + 1 - len(df), x.dtype)]) for x in (df, last))
                at = np.arange(len(ids), dtype=np.int32)
                last[ids] = at  # of equal ids one place stays
                df[ids[last[ids] == at]] += 1
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([df[some], [docs, tokens]]))], ["id", "n"])

    sums = {r.id: r.n for r in shards.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(max([0, *sums]) + 1, np.int64)
    for i, n in sums.items():
        if i >= 0:
            df[i] = n
    return df, sums.get(-1, 0), sums.get(-2, 0)


class ShardIndex:
    """BM25 inverted index of the documents of one shard; ``nearest`` ranks the unused ones."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs))
        size = np.fromiter(map(len, terms), np.int64, len(docs))
        doc, term, tf = np.repeat(np.arange(len(docs), dtype=np.int32), size), np.concatenate(terms), np.concatenate(counts).astype(np.float32)
        length = (K1 * (1 - B + B * np.fromiter(map(len, docs), np.float32, len(docs)) / mean)).astype(np.float32)
        score = idf[term] * tf * np.float32(K1 + 1) / (tf + length[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.score = doc[order], score[order]
        names, at = np.unique(term[order], return_index=True)
        self.at = np.append(at, len(order))
        self.edge = np.concatenate([[0], np.cumsum(size)])
        self.query = np.searchsorted(names, term).astype(np.int32)  # the places of every document's terms, document by document
        self.n = len(docs)
        df = np.diff(self.at)
        common = np.flatnonzero(df * 4 > self.n)  # their rows take at most 16 bytes a posting
        self.row = np.full(len(df), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        for r, c in enumerate(common.tolist()):
            own = slice(self.at[c], self.at[c + 1])
            self.dense[r, self.doc[own]] = self.score[own]

    def scores(self, seed: int) -> np.ndarray:
        q = self.query[self.edge[seed] : self.edge[seed + 1]]
        row = self.row[q]
        held = np.zeros(len(self.dense), np.float32)
        held[row[row >= 0]] = 1
        total = held @ self.dense
        q = q[row < 0]
        at = ragged.spread(self.at[q], self.at[q + 1] - self.at[q])
        return total + np.bincount(self.doc[at], self.score[at], self.n)


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """``document, start, length, sequence, offset`` of every piece."""
    sequence, used = 0, np.zeros(len(docs), np.int64)
    sizes = np.array([len(d) for d in docs])
    for d, size in enumerate(sizes.tolist()):
        while size - used[d] >= window:
            yield d, int(used[d]), window, sequence, 0
            used[d] += window
            sequence += 1
    open_docs = sizes > used
    if not open_docs.any():
        return
    index = ShardIndex(docs, idf, mean)
    offset, left = 0, int((sizes - used).sum())
    seed = 0
    room = window if left >= window else 1 << (left.bit_length() - 1)
    while left:
        while not open_docs[seed]:
            seed += 1
        score = np.where(open_docs, index.scores(seed), -1.0)
        score[seed] = np.inf
        rank, todo = None, seed
        best = iter(())
        while room and left:
            take = min(room, int(sizes[todo] - used[todo]))
            yield todo, int(used[todo]), take, sequence, offset
            used[todo] += take
            room, offset, left = room - take, offset + take, left - take
            open_docs[todo] = used[todo] < sizes[todo]
            if not room or not left:
                break
            if rank is None:
                few = min(64, len(score))
                rank = np.argpartition(-score, few - 1)[:few] if len(score) > few else np.arange(len(score))
                rank = rank[np.lexsort((rank, -score[rank]))]
                best = iter(rank.tolist())
            todo = next((d for d in best if open_docs[d]), -1)
            if todo < 0:  # the nearest are used up: rank what is left
                score = np.where(open_docs, score, -1.0)
                rank, best = None, iter(())
                todo = int(np.argmax(score))
        sequence, offset = sequence + 1, 0
        room = window if left >= window else 1 << (left.bit_length() - 1) if left else 0


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece."""
    shards = materialize(token_shards(docs, tokenizer, key, text, end_id, shard_tokens), "packing-ids")
    df, n, tokens = document_frequencies(shards)
    idf = docs.sparkSession.sparkContext.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32))  # the vocabulary's size
    mean = max(1.0, tokens / max(n, 1))

    def close(shard: int, keys: list, held: list[np.ndarray]) -> pa.RecordBatch:
        rows = list(pack_shard(held, idf.value, mean, window))
        crc = [zlib.crc32(held[d][a : a + size].tobytes()) for d, a, size, _, _ in rows]
        columns = [[keys[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows], crc, [len(held[r[0]]) for r in rows], [(shard << 24) + r[3] for r in rows], [r[4] for r in rows]]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, held = None, [], []
        task, closed = TaskContext.get().partitionId(), 0
        for batch in batches:
            for shard, k, raw in zip(batch.column("shard").to_pylist(), batch.column(key).to_pylist(), batch.column("ids").to_pylist()):
                if shard != at and held:
                    yield close((task << 16) + closed, keys, held)
                    keys, held, closed = [], [], closed + 1
                at = shard
                keys.append(k)
                held.append(np.frombuffer(raw, "<u4"))
        if held:
            yield close((task << 16) + closed, keys, held)

    return shards.mapInArrow(run, f"`{key}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
