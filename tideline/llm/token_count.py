"""Token counts: byte-pair merges of a word-level vocabulary on ragged arrays, all words at once.

Rank-synchronous array merging: distinct pre-tokens of a slice lie end to end in one symbol
array; in every round each word applies its own lowest-ranked pair wherever it occurs, and
words without a known pair leave with their number of symbols.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; other
columns are ignored whatever their names; a null key stays null; special strings of the
vocabulary inside a text count as one token each, as the library has it by default.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .shared import texts

_NEVER = np.int64(1) << 40


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the symbols that survive all merges; ``cap`` bounds the words remembered between calls."""

    def __init__(self, path: str, cap: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"].get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.base = np.int64(max(vocab.values()) + 1)
        symbols = _byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + end] for c in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.cap = cap
        self.known: dict[bytes, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], _NEVER)

    def merge(self, buf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Surviving symbols of each word; the words' bytes lie end to end in ``buf`` and none is empty."""
        count = sizes.copy()
        sym = self.inner[buf]
        last = np.cumsum(sizes) - 1
        sym[last] = self.final[buf[last]]
        word = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(sym), _NEVER)
        within = np.flatnonzero(word[:-1] == word[1:])
        rank[within] = self._ranks(sym[within], sym[within + 1])
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(sym)))
            count[word[begin]] = size
            alive = best < _NEVER
            if not alive.all():
                stay = np.repeat(alive, size)
                sym, word, rank = sym[stay], word[stay], rank[stay]
                best, size = best[alive], size[alive]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            # of overlapping occurrences (aaa) the first, third, ... are merged
            run = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
            offset = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[offset % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            hit = hit - np.arange(len(hit))
            sym, word, rank = sym[stay], word[stay], rank[stay]
            again = np.unique(np.concatenate([hit, hit[hit > 0] - 1]))
            rank[again] = _NEVER
            again = again[again + 1 < len(sym)]
            again = again[word[again] == word[again + 1]]
            rank[again] = self._ranks(sym[again], sym[again + 1])
        return count

    def _counts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        cp, at, cp_offs = ragged.code_points(buf, offs)
        starts, ends = ragged.split_word_level(cp, cp_offs)
        starts, ends = at[starts], at[ends]
        codes, found = ragged.distinct(buf, starts, ends)
        used = np.zeros(len(found), bool)
        used[codes] = True
        tokens = found.filter(pa.array(used)).to_pylist()
        if len(self.known) > self.cap:
            self.known.clear()
        new = [t for t in tokens if t not in self.known]
        if new:
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            self.known.update(zip(new, self.merge(np.frombuffer(b"".join(new), np.uint8), sizes).tolist()))
        of_code = np.zeros(len(found), np.int64)
        of_code[used] = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        upto = np.concatenate([[0], np.cumsum(of_code[codes])])
        return np.diff(upto[np.searchsorted(starts, offs)])

    def count(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        cut = ragged.cut_specials(buf, offs, self.specials)
        if cut is not None:
            part, part_offs, owner, special = cut
            each = np.where(special >= 0, 1, self._normal_counts(part, part_offs))
            return np.bincount(owner, each, len(offs) - 1).astype(np.int64)
        return self._normal_counts(buf, offs)

    def _normal_counts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if not len(buf):
            return np.zeros(len(offs) - 1, np.int64)
        if buf.max() < 0x80:
            return self._counts(ragged._LOWER[buf], offs)
        raw = buf.tobytes()
        plain = [self._normal(raw[a:b]) for a, b in zip(offs[:-1], offs[1:])]
        new_offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))])
        return self._counts(np.frombuffer(b"".join(plain), np.uint8), new_offs)

    @staticmethod
    def _normal(raw: bytes) -> bytes:
        text = unicodedata.normalize("NFC", raw.decode("utf-8"))
        return text.replace("Σ", "σ").lower().encode("utf-8")  # no final sigma: letters are lowered one by one


@lru_cache(2)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row; one narrow pass, nothing is shuffled."""
    rows = texts(docs, key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(vocabulary)
        for part, buf, offs in ragged.slices(batches, text):
            n = counter.count(buf, offs)
            yield pa.record_batch([part.column(key), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean").select(F.col(key), "n_bytes", "n_tokens", "over_limit")
