"""Words of many texts at once, as numpy arrays over the Arrow buffers.

A batch of texts is one run of UTF-8 bytes. Words are found with byte masks and
hashed eight bytes at a time, all words at once, so only very long words are
looped over. Word *n* of the batch is the bytes ``start[n]:end[n]``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)

BLANK_BYTES = np.zeros(256, bool)
BLANK_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: What is not in an alphanumeric word: ASCII other than digits and letters.
SYMBOL_BYTES = np.zeros(256, bool)
SYMBOL_BYTES[:128] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    SYMBOL_BYTES[_a:_b] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    data: np.ndarray  # uint8, the texts one after another
    offsets: np.ndarray  # of texts in data
    start: np.ndarray  # of words in data
    end: np.ndarray
    first: np.ndarray  # number of words before each text, and of all at the end

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return data, offsets - lo


def words_of(texts: pa.Array, gap: np.ndarray = BLANK_BYTES, lower: bool = False) -> Words:
    data, offsets = text_buffers(texts)
    if lower:
        data = LOWER[data]
    inside = ~gap[data]
    heads = np.zeros(len(data) + 1, bool)
    heads[offsets] = True  # a text's beginning parts words
    heads = heads[:-1]
    begin = inside.copy()
    begin[1:] &= gap[data[:-1]] | heads[1:]
    last = inside.copy()
    last[:-1] &= gap[data[1:]] | heads[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: Low bytes of a lane of eight, for words that end inside it.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LANE, _STATE = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
#: Longer words are digested one by one; there is at most one in so many bytes.
_LONG = 64


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words, equal for equal bytes; those of two seeds are independent.

    Eight bytes at a time are mixed into a state that the seed and the word's length
    begin, with shifts and products in turn, so that no algebra of bytes makes words collide.
    """
    size = w.end - w.start
    out = mix(size.astype(np.uint64) * _MULT + mix(np.full(1, seed ^ 0x2545F4914F6CDD1D, np.uint64)))
    if not len(size):
        return out
    data = np.concatenate([w.data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(w.data) + 1,), (1,))
    out = mix(out ^ (lanes[w.start] & _LOW[np.minimum(size, 8)]) * _LANE)
    at, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(at):
        left = size[at] - done
        out[at] = mix(out[at] * _STATE ^ (lanes[w.start[at] + done] & _LOW[np.minimum(left, 8)]) * _LANE)
        at, done = at[left > 8], done + 8
    salt = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(blake2b(w.data[w.start[i] : w.end[i]], digest_size=8, salt=salt).digest(), "little")
    return out


def grams(h: np.ndarray, k: int, mult: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of all runs of ``k`` values, across texts too: ``len(h) - k + 1`` of them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    q, n = _U(mult), len(h)
    # By doubling: hashes of 2, 4, 8, ... values, put together by k's binary digits.
    part, size, factor = h.copy(), 1, q
    acc, done, accf = None, 0, None
    bits = k
    while True:
        if bits & 1:
            if acc is None:
                acc, done = part.copy(), size
            else:
                # acc covers `done` values; put `part` after it.
                m = n - (done + size) + 1
                acc = acc[:m] * factor + part[done : done + m]
                done += size
        bits >>= 1
        if not bits:
            break
        m = n - 2 * size + 1
        part = part[:m] * factor + part[size : size + m]
        size *= 2
        factor = _U(int(factor) ** 2 % (1 << 64))
    return mix(acc)


def within(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the runs of ``k`` words lie in one text."""
    m = max(n - k + 1, 0)
    ok = np.ones(m, bool)
    if k > 1 and m:
        bad = np.zeros(m + 1, np.int64)
        edges = first[1:-1]  # a run may not cross the beginning of a text
        lo, hi = np.clip(edges - k + 1, 0, m), np.clip(edges, 0, m)
        np.add.at(bad, lo, 1)
        np.add.at(bad, hi, -1)
        ok = np.cumsum(bad)[:-1] == 0
    return ok


def slices(batch: pa.RecordBatch, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have about ``size`` bytes; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0]+1, ...`` for ``lengths[0]`` values, then those of the next run."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the runs."""
    d = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(d)[:n] > 0
