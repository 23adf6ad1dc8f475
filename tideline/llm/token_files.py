"""Token-ID files: ids of fixed bit width in blocks, in ascending document order.

A shard file holds a header, three index sections and the packed ids (all little-endian):

    magic "TLIDS001" | bits u4 | block_ids u4 | n_docs u8 | n_ids u8
    doc keys   i8[n_docs]          key of each document
    doc starts u8[n_docs + 1]      its first id within the shard, and the end
    blocks     u8[n_blocks + 1]    byte offset of each block in the payload, and the end
    payload                        every block: its ids in ``bits`` bits each, padded to a byte

A block starts on a byte, so any run of ids is read by seeking to its first block and unpacked
with numpy.  Files are written by tasks under a name of their attempt; the manifest, a table
written by Spark, names those of the attempts that succeeded, so retries and lost executors
leave stray files but never wrong ones.

Cases: a null text has only the end id; repeated keys are ordered by text and each is a document
of its own; a null key sorts first and is read back as null; no rows give no files and no rows
back; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ragged
from .bpe_ids import byte_pair_ids
from .shared import fresh_path, texts

MAGIC = b"TLIDS001"
_HEAD = struct.Struct("<8sIIQQ")
_NULL_KEY = np.iinfo(np.int64).min
BLOCK_IDS = 4096  # divisible by 8, so that full blocks end on a byte
SHARD_IDS = 4 << 20


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, low bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(flags[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def write_shard(filesystem: pafs.FileSystem, path: str, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> None:
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    edges = np.append(np.arange(0, len(ids), block), len(ids))
    block_at = ((edges * bits + 7) // 8).astype("<u8")
    with filesystem.open_output_stream(path) as out:
        out.write(_HEAD.pack(MAGIC, bits, block, len(keys), len(ids)))
        out.write(keys.astype("<i8").tobytes())
        out.write(starts.tobytes())
        out.write(block_at.tobytes())
        for a in range(0, len(ids), block * 64):
            out.write(pack(ids[a : a + block * 64], bits))


class Shard:
    """Random access to one file."""

    def __init__(self, uri: str):
        filesystem, path = pafs.FileSystem.from_uri(uri)
        self.file = filesystem.open_input_file(path)
        magic, self.bits, self.block, self.n_docs, self.n_ids = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token-id shard")
        at = _HEAD.size
        self.keys, at = self._section("<i8", self.n_docs, at)
        self.starts, at = self._section("<u8", self.n_docs + 1, at)
        self.block_at, self.payload = self._section("<u8", -(-self.n_ids // self.block) + 1, at)

    def _section(self, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
        return np.frombuffer(self.file.read_at(8 * n, at), kind).astype(np.int64), at + 8 * n

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard, from the blocks that hold them."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        low, high = int(self.block_at[first]), int(self.block_at[last])
        n = min(last * self.block, self.n_ids) - first * self.block
        return unpack(self.file.read_at(high - low, self.payload + low), n, self.bits)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_token_files(docs: DataFrame, tokenizer: str, path: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2, shard_ids: int = SHARD_IDS, block: int = BLOCK_IDS) -> DataFrame:
    """Tokenise all texts in key order and write shards to the shared folder ``path``.

    Returns the manifest ``task, nth, file, n_docs, n_ids, start``: shards in order, ``start``
    being the ids of all shards before.  One range shuffle of the texts; a task holds the ids of
    one shard, or of one document if that is longer.
    """
    spark = docs.sparkSession
    rows = texts(docs, key, text=text).repartitionByRange(F.col(key), F.xxhash64(text)).sortWithinPartitions(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, attempt, nth = byte_pair_ids(tokenizer), TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        bits = bits_for(max(encoder.vocab_size, end_id + 1))
        filesystem, root = pafs.FileSystem.from_uri(path)
        filesystem.create_dir(root, recursive=True)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal nth, held
            keys, counts, ids = (np.concatenate(x) for x in zip(*held))
            name = f"part-{task:06d}-{nth:05d}-{attempt}.ids"
            write_shard(filesystem, f"{root}/{name}", keys, counts, ids, bits, block)
            row = pa.record_batch([pa.array([x]) for x in (task, nth, f"{path}/{name}", len(keys), len(ids))], ["task", "nth", "file", "n_docs", "n_ids"])
            held, nth = [], nth + 1
            return row

        size = 0
        for part, buf, offs in ragged.slices(batches, text):
            ids, n = encoder.encode(buf, offs)
            ids = np.insert(ids, np.cumsum(n), end_id)
            keys = part.column(key).cast(pa.int64()).fill_null(_NULL_KEY).to_numpy(zero_copy_only=False)
            if held and size + len(ids) > shard_ids:
                yield flush()
                size = 0
            held.append((keys, n + 1, ids))
            size += len(ids)
        if held:
            yield flush()

    rows.mapInArrow(run, "task long, nth long, file string, n_docs long, n_ids long").write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.schema("task long, nth long, file string, n_docs long, n_ids long").parquet(f"{path}/manifest")
    before = Window.orderBy("task", "nth").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"])
                raw = memoryview(shard.ids(0, shard.n_ids).astype("<u4").tobytes())
                edge = 4 * shard.starts
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(edge[:-1], edge[1:])]
                yield pa.record_batch([pa.array(shard.keys, mask=shard.keys == _NULL_KEY), pa.array(shard.starts[:-1] + row["start"]), pa.array(np.diff(shard.starts)), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "start").repartition(F.col("file"))
    return files.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def token_id_files(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Write the files to a fresh shared folder and read them back."""
    manifest = write_token_files(docs, tokenizer, fresh_path(docs.sparkSession, "token-ids"), key=key, text=text, end_id=end_id)
    return read_token_files(manifest, key=key)
