"""Set-similarity join on word shingles: signature trees over exact candidate blocks.

1. Every text becomes its set of 64-bit shingle hashes; equal sets form one class by fingerprint.
2. Texts whose sets differ in at most d shingles agree on one of more than d hash ranges, so classes
   that share a range's content (within neighbouring size bands) are put in one block; blocks that
   overlap are merged.  This loses no pair at the threshold, and the merged blocks are disjoint.
3. Each block builds a signature tree: leaves are sets, inner nodes hold the OR of their token
   bitmaps and the range of their sizes.  A dual traversal discards node pairs whose largest
   possible overlap is too small, or whose sets are all linked already, and verifies the leaf
   pairs that remain on the exact sets.
A block of very many distinct sets is dealt to several tasks as pairs of tiles.

Cases: a null text or one without words has no shingles and is linked with nothing; repeated rows
each give a row, with one component; a row with a null key takes no part and has a null
component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ragged
from .components import connected_components
from .shared import materialize, texts

TILE_SHINGLES = 4 << 20
_EMPTY_SEED = np.uint64(0x51ED270B7A14C8D3)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their number."""
    low, starts, ends, per_text = ragged.words(buf, offs)
    codes, found = ragged.distinct(low, starts, ends)
    hashes = ragged.hash_words(found)[codes] if len(codes) else np.empty(0, np.uint64)
    h, count = ragged.grams(hashes, per_text, n)
    edge = np.concatenate([[0], np.cumsum(count)])
    sets = [np.unique(h[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    return np.concatenate(sets) if sets else h, np.fromiter(map(len, sets), np.int64, len(sets))


class SizeBands:
    """Bands of set sizes such that linked sets lie in one band or in neighbours, and the hash ranges of each."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] <= largest:
            edges.append(edges[-1] * den // num + 1)
        self.edges = np.array(edges, np.int64)
        top = self.edges[1:] - 1
        self.apart = (top + top * den // num) * (den - num) // (den + num)  # most shingles in which a pair differs whose smaller set is in the band
        self.ranges = self.apart * 11 // 10 + 2

    def signatures(self, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range signatures of each set, end to end, and their number.  Bands where only equal sets can link give none.

        A set that fills more ranges than a pair can differ in shares a filled range with every
        partner, so it needs no signature for its empty ranges, in which unlike sets would meet.
        """
        band = np.searchsorted(self.edges, count, "right") - 1
        out, doc = [], []
        scrambled = ragged.mix(h)
        first = np.cumsum(count) - count
        for back in (0, 1):
            own = np.flatnonzero((count > 0) & (band - back >= 0))
            own = own[self.apart[band[own] - back] > 0]
            if not len(own):
                continue
            group = band[own] - back
            parts = self.ranges[group]
            at = ragged.spread(first[own], count[own])
            row = np.repeat(np.arange(len(own)), count[own])
            slot = (((h[at] >> np.uint64(32)) * parts[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + (np.cumsum(parts) - parts)[row]
            begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            total = np.zeros(parts.sum(), np.uint64)
            total[slot[begin]] = np.add.reduceat(scrambled[at], begin)
            part = ragged.spread(np.zeros(len(own), np.int64), parts)
            label = ragged.mix((np.repeat(group, parts).astype(np.uint64) << np.uint64(32)) + part.astype(np.uint64) + _EMPTY_SEED)
            filled = np.zeros(len(total), bool)
            filled[slot[begin]] = True
            few = np.add.reduceat(filled.astype(np.int64), np.cumsum(parts) - parts) <= self.apart[group]
            kept = filled | np.repeat(few, parts)
            out.append(ragged.mix(total ^ label)[kept])
            doc.append(np.repeat(own, parts)[kept])
        if not out:
            return np.empty(0, np.uint64), np.zeros(len(count), np.int64)
        sig, doc = np.concatenate(out), np.concatenate(doc)
        order = np.argsort(doc, kind="stable")
        return sig[order], np.bincount(doc, minlength=len(count))


class _Node:
    __slots__ = ("bits", "low", "high", "slack", "kids", "first", "last", "uniform")

    def __init__(self, bits: int, low: int, high: int, slack: int, kids: list, first: int, last: int):
        self.bits, self.low, self.high, self.slack = bits, low, high, slack
        self.kids, self.first, self.last, self.uniform = kids, first, last, not kids


class SignatureTree:
    """Links all pairs of ``sets`` (sorted, distinct) with ``den * overlap >= num * union``; ``roots`` labels them."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, fanout: int = 8):
        self.num, self.den = num, den
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.sets = [sets[i] for i in self.order]
        self.parent = list(range(len(sets)))
        self.verified = 0
        largest = len(self.sets[-1]) if sets else 1
        width = min(max(512, 1 << (8 * largest - 1).bit_length()), 1 << 17)
        level = [self._leaf(i, s, width) for i, s in enumerate(self.sets)]
        while len(level) > 1:
            level = [self._join(level[i : i + fanout]) for i in range(0, len(level), fanout)]
        if level:
            self._inside(level[0])

    @staticmethod
    def _leaf(i: int, s: np.ndarray, width: int) -> _Node:
        flags = np.zeros(width, bool)
        flags[(s % np.uint64(width)).astype(np.int64)] = True
        bits = int.from_bytes(np.packbits(flags).tobytes(), "big")
        return _Node(bits, len(s), len(s), len(s) - bits.bit_count(), [], i, i + 1)

    @staticmethod
    def _join(kids: list[_Node]) -> _Node:
        bits = 0
        for k in kids:
            bits |= k.bits
        return _Node(bits, kids[0].low, kids[-1].high, max(k.slack for k in kids), kids, kids[0].first, kids[-1].last)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _is_uniform(self, p: _Node) -> bool:
        if not p.uniform:
            root = self.find(p.first)
            p.uniform = all(self.find(i) == root for i in range(p.first + 1, p.last))
        return p.uniform

    def _inside(self, p: _Node) -> None:
        for k in p.kids:
            self._inside(k)
        for i, a in enumerate(p.kids):
            for b in p.kids[i + 1 :]:
                self._across(a, b)

    def _across(self, p: _Node, q: _Node) -> None:
        if min(p.high, q.high) * self.den < self.num * max(p.low, q.low):
            return
        need = -(-self.num * (p.low + q.low) // (self.num + self.den))
        if (p.bits & q.bits).bit_count() + min(p.slack, q.slack) < need:
            return
        if self._is_uniform(p) and self._is_uniform(q) and self.find(p.first) == self.find(q.first):
            return
        if not p.kids and not q.kids:
            a, b = self.sets[p.first], self.sets[q.first]
            self.verified += 1
            both = len(np.intersect1d(a, b, assume_unique=True))
            if self.den * both >= self.num * (len(a) + len(b) - both):
                x, y = self.find(p.first), self.find(q.first)
                self.parent[max(x, y)] = min(x, y)
        elif not q.kids or p.kids and p.last - p.first >= q.last - q.first:
            for k in p.kids:
                self._across(k, q)
        else:
            for k in q.kids:
                self._across(p, k)

    def roots(self) -> list[int]:
        """For each input set, the number of a set of its component (the same for all of it)."""
        out = [0] * len(self.sets)
        for i, original in enumerate(self.order):
            out[original] = self.order[self.find(i)]
        return out


def similar_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, num: int = 90, den: int = 100, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """``key, n_shingles, component_id`` of every row; linked when ``den * overlap >= num * union``."""
    rows = texts(docs, F.col(key).cast("long").alias(key), text=text)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = SizeBands(num, den, 1 << 34)
        for part, buf, offs in ragged.slices(batches, text):
            h, count = shingle_sets(buf, offs, shingle)
            edge = np.concatenate([[0], np.cumsum(count)])
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(ragged.mix(h ^ seed))])[edge] for seed in (np.uint64(0), _EMPTY_SEED)]
            sig, n_sig = bands.signatures(h, count)
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_sig)])), pa.array(sig.view(np.int64)))
            yield pa.record_batch([part.column(key), pa.array(count), *(pa.array((s[1:] - s[:-1]).view(np.int64)) for s in sums), lists.cast(pa.list_(pa.int64()))], [key, "n_shingles", "fp1", "fp2", "sigs"])

    described = materialize(rows.mapInArrow(describe, f"`{key}` long, n_shingles long, fp1 long, fp2 long, sigs array<long>"), "jaccard-sets")
    sets = described.filter(f"n_shingles > 0 and `{key}` is not null")
    prints = ["n_shingles", "fp1", "fp2"]
    classes = materialize(sets.groupBy(*prints).agg(F.min(key).alias("rep")), "jaccard-classes")

    reps = sets.filter(F.size("sigs") > 0).join(classes.select(F.col("rep").alias(key)), key, "left_semi")
    by_sig = Window.partitionBy("sig")
    blocks = reps.select(F.col(key).alias("a"), F.explode("sigs").alias("sig")).withColumn("b", F.min("a").over(by_sig)).filter("a > b").select("a", "b").distinct()
    blocked = connected_components(blocks)

    linked, tiled = _link_blocks(rows, classes, blocked, key, text, shingle, num, den, tile_shingles)
    if tiled:
        component = connected_components(linked).withColumnRenamed("node", "rep").withColumnRenamed("component", "component_id")
    else:
        component = linked.select(F.col("a").alias("rep"), F.col("b").alias("component_id"))
    named = classes.join(component, "rep", "left").select(*prints, F.coalesce("component_id", "rep").alias("component_id"))
    return described.select(key, *prints).join(named, prints, "left").select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)).alias("component_id"))


def _link_blocks(rows: DataFrame, classes: DataFrame, blocked: DataFrame, key: str, text: str, shingle: int, num: int, den: int, tile_shingles: int) -> tuple[DataFrame, bool]:
    """``a, b``: class representative and the least representative it is linked with in its block; whether blocks were tiled."""
    members = blocked.join(classes, F.col("node") == F.col("rep")).select("rep", F.col("component").alias("block"), "n_shingles")
    tiles = members.groupBy("block").agg(F.ceil(F.sum("n_shingles") / F.lit(tile_shingles)).cast("int").alias("tiles"))
    members = materialize(members.join(tiles, "block").select("rep", "block", "tiles", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int").alias("tile")), "jaccard-blocks")
    tiled = bool(members.filter("tiles > 1").take(1))
    pairs = F.when(F.col("tiles") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: j != F.col("tile")), lambda j: F.struct(F.least("tile", j).alias("i"), F.greatest("tile", j).alias("j")))
    )

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in ragged.slices(batches, text):
            h, count = shingle_sets(buf, offs, shingle)
            edge = 8 * np.concatenate([[0], np.cumsum(count)])
            raw = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(h))])
            yield pa.record_batch([*(part.column(c) for c in ("rep", "block", "tiles", "tile")), raw.cast(pa.binary()), pa.array(count)], ["rep", "block", "tiles", "tile", "hashes", "n"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []

        def close() -> pa.RecordBatch:
            tree = SignatureTree(sets, num, den)
            least: dict[int, int] = {}
            roots = tree.roots()
            for i, r in zip(ids, roots):
                least[r] = min(i, least.get(r, i))
            moved = [(i, least[r]) for i, r in zip(ids, roots) if least[r] != i]
            return pa.record_batch([pa.array([m[k] for m in moved], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "i", "j", "rep", "hashes")]
            for block, i, j, rep, raw in zip(*columns):
                if (block, i, j) != group:
                    if len(ids) > 1:
                        yield close()
                    group, ids, sets = (block, i, j), [], []
                ids.append(rep)
                sets.append(np.frombuffer(raw, np.uint64))
        if len(ids) > 1:
            yield close()

    texts_of = rows.join(members, rows[key] == members["rep"]).select("rep", "block", "tiles", "tile", text)
    hashed = texts_of.mapInArrow(hash_sets, "rep long, block long, tiles int, tile int, hashes binary, n long")
    dealt = hashed.select("rep", "block", F.explode(pairs).alias("pair"), "hashes").select("rep", "block", "pair.i", "pair.j", "hashes")
    linked = dealt.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(link, "a long, b long")
    return materialize(linked.distinct(), "jaccard-links"), tiled
