"""Token ids of whole texts by the tokenizers library, each distinct pre-token encoded once per worker.

The library's byte-level pattern is applied to a whole slice at a time on numpy arrays; the
library itself encodes the distinct pre-tokens, which it leaves whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

from . import ragged


class BytePairIds:
    """``encode`` gives the ids of texts; ``cap`` bounds the pre-tokens held between calls, some 25 bytes each.

    A pre-token is held as its 128-bit hash in two sorted columns, not as a string.
    """

    def __init__(self, path: str, cap: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError(f"{path} does not split texts by the plain byte-level pattern")
        self.tokenizer = Tokenizer.from_file(path)
        self.cap = cap
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.vocab_size <= 1 << 16 else np.uint32
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = [t.content for t in added.values()]
        self.special_ids = np.array(list(added), np.int32)
        self._clear()

    def _clear(self) -> None:
        self.low, self.high, self.entry = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32)
        self.start, self.ids = np.zeros(1, np.int64), np.empty(0, self.kind)

    def _places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes belong, and whether they are there."""
        at = np.searchsorted(self.low, low)
        held = np.minimum(at, max(len(self.low) - 1, 0))
        return at, (self.low[held] == low) & (self.high[held] == high) if len(self.low) else np.zeros(len(low), bool)

    def _find(self, tokens: pa.Array) -> np.ndarray:
        """The entry of every distinct pre-token, learnt where it is new."""
        if len(self.low) > self.cap:
            self._clear()
        raw = tokens.to_pylist()
        digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), ">u8").astype(np.uint64).reshape(-1, 2)
        high, low = digest[:, 0], digest[:, 1]
        at, known = self._places(low, high)
        new = np.flatnonzero(~known)
        if len(new):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([raw[i].decode("utf-8") for i in new.tolist()], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            order = new[np.argsort(low[new], kind="stable")]
            names = np.empty(len(raw), np.int32)
            names[new] = len(self.start) - 1 + np.arange(len(new))
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), self.kind, int(sizes.sum()))])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.low, self.high, self.entry = (np.insert(x, at[order], y[order]) for x, y in ((self.low, low), (self.high, high), (self.entry, names)))
            at, _ = self._places(low, high)
        return self.entry[at]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and their number per text; special strings become their own ids."""
        cut = ragged.cut_specials(buf, offs, self.specials)
        if cut is None:
            return self._encode(buf, offs)
        buf, seg_offs, owner, special = cut
        ids, count = self._encode(buf, seg_offs)
        where = np.flatnonzero(special >= 0)
        ids = np.insert(ids, np.cumsum(count)[where], self.special_ids[special[where]])
        count[where] = 1
        return ids, np.bincount(owner, count, len(offs) - 1).astype(np.int64)

    def _encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.empty(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        cp, at, cp_offs = ragged.code_points(buf, offs)
        starts = at[ragged.split_byte_level(cp, cp_offs)]
        codes, tokens = ragged.distinct(buf, starts, np.append(starts[1:], len(buf)))
        entry = self._find(tokens)
        first, size = self.start[entry], self.start[entry + 1] - self.start[entry]
        size = size[codes]
        ids = self.ids[ragged.spread(first[codes], size)].astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(upto[np.searchsorted(starts, offs)])


@lru_cache(2)
def byte_pair_ids(path: str) -> BytePairIds:
    """One per Python worker."""
    return BytePairIds(path)
