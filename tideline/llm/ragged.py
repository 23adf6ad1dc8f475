"""Texts, words and pre-tokens as ragged numpy arrays over Arrow string buffers.

A slice of an Arrow batch is one flat byte buffer with document offsets; everything below
marks boundaries in that buffer, so that no Python object is made per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash

SLICE_BYTES = 4 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

OTHER, LETTER, NUMBER, SPACE = range(4)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and the offsets of each; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in groups of about ``limit`` bytes (one row at least), each with its flat texts."""
    for batch in batches:
        _, offs = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            part = batch.slice(at, to - at)
            yield part, *flat(part.column(column))
            at = to


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z: the lowered bytes, word starts, ends, and words per text; ``gap`` marks other bytes between words."""
    low = _LOWER[buf]
    ink = ~gap[buf]
    before, after = np.zeros_like(ink), np.zeros_like(ink)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    inner = offs[(offs > 0) & (offs < len(buf))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return low, starts, ends, np.diff(np.searchsorted(starts, offs))


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> tuple[np.ndarray, pa.Array]:
    """Code of each byte range and the distinct ranges; codes index the latter, which may hold unused gaps."""
    kind = kind or pa.large_binary()
    if not len(starts):
        return np.empty(0, np.int32), pa.array([], kind)
    if np.array_equal(ends[:-1], starts[1:]):
        offsets, step = np.append(starts, ends[-1]), 1
    else:
        offsets, step = np.empty(2 * len(starts), np.int64), 2
        offsets[::2], offsets[1::2] = starts, ends
    offsets = np.ascontiguousarray(offsets, np.int64)
    values = pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False)[::step], coded.dictionary


def hash_words(distinct_words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct_words.to_pylist()), np.uint64, len(distinct_words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(word_hash: np.ndarray, per_text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of every text and their number per text; fewer words give one shingle of all, none give none."""
    if not len(word_hash):
        return np.empty(0, np.uint64), np.zeros(len(per_text), np.int64)
    first = np.cumsum(per_text) - per_text
    full = np.maximum(per_text - n + 1, 0)
    at = spread(first[full > 0], full[full > 0])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(3) + word_hash[at + k])
    count = full.copy()
    short = np.flatnonzero((per_text > 0) & (per_text < n))
    if not len(short):
        return out, count
    count[short] = 1
    whole = np.empty(len(short), np.uint64)
    for k, d in enumerate(short):
        h = np.zeros(1, np.uint64)
        for x in word_hash[first[d] : first[d] + per_text[d]]:
            h = mix(h * np.uint64(3) + x)
        whole[k] = mix(h + np.uint64(per_text[d]))[0]
    merged = np.empty(count.sum(), np.uint64)
    is_short = np.repeat((per_text > 0) & (per_text < n), count)
    merged[is_short], merged[~is_short] = whole, out
    return merged, count


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point: other, letter, number or white space, by the regex library's Unicode tables."""
    table = np.full(0x110000, OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        chars = "".join(map(chr, range(low, high)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, chars):
                table[low + m.start() : low + m.end()] = kind
    return table


def code_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the byte offset of each (and of the end), and the text offsets in code points."""
    if not len(buf) or buf.max() < 0x80:
        return buf.astype(np.uint32), np.arange(len(buf) + 1), offs
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
    return cp, at, np.searchsorted(at, offs)


def _contractions(cp: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
    """Apostrophe tokens 's 't 'm 'd 're 've 'll begin where a run of other characters would and take their letters along."""
    q = np.flatnonzero((cp == 39) & start)
    q = q[q + 1 < len(cp)]
    q = q[~first[q + 1]]
    one = np.isin(cp[q + 1], [ord(x) for x in "stmd"])
    two = np.zeros_like(one)
    more = np.flatnonzero(q + 2 < len(cp))
    more = more[~first[q[more] + 2]]
    a, b = cp[q[more] + 1], cp[q[more] + 2]
    two[more] = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    for hit, size in ((q[one], 2), (q[two], 3)):
        start[hit + 1] = False
        after = hit + size
        start[after[after < len(cp)]] = True


def _run_starts(cp: np.ndarray, cp_offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = char_classes()[cp]
    first = np.zeros(len(cp), bool)
    first[cp_offs[:-1][np.diff(cp_offs) > 0]] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    return kind, first, start


def split_byte_level(cp: np.ndarray, cp_offs: np.ndarray) -> np.ndarray:
    """Starts of byte-level BPE pre-tokens: one blank joins the token after it, other white space stands alone."""
    kind, first, start = _run_starts(cp, cp_offs)
    blank = kind == SPACE
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:])
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    _contractions(cp, start, first)
    return np.flatnonzero(start)


def split_word_level(cp: np.ndarray, cp_offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens that drop white space and hold one number character each."""
    kind, first, start = _run_starts(cp, cp_offs)
    start |= kind == NUMBER
    _contractions(cp, start, first)
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(cp))[: len(starts)]
    keep = kind[starts] != SPACE
    return starts[keep], ends[keep]


def cut_specials(buf: np.ndarray, offs: np.ndarray, specials: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Texts cut at special strings: bytes without them, segment offsets, segments' texts, and (special number or -1) per segment.

    None if no special string occurs.
    """
    raw = buf.tobytes()
    marks = [s.encode() for s in specials]
    if not any(m in raw for m in marks):
        return None
    pattern = re.compile(b"|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)))
    out, sizes, owner, special = [], [], [], []
    for d, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
        at = a
        for m in pattern.finditer(raw, a, b):
            for piece, number in ((raw[at : m.start()], -1), (b"", marks.index(m[0]))):
                out.append(piece), sizes.append(len(piece)), owner.append(d), special.append(number)
            at = m.end()
        out.append(raw[at:b]), sizes.append(b - at), owner.append(d), special.append(-1)
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array(owner), np.array(special)
