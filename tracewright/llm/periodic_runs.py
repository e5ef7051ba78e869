"""Periodic runs of words, by Karp-Miller-Rosenberg names and candidates on a grid.

All words of a batch of texts are numbered. Equal blocks of 1, 2, 4, ... words get equal names: the name of a block
is the rank of the pair of names of its halves, so equality is exact, and neither hashes nor sorted suffixes
are used. How far two places agree is read from the names, from the longest blocks down.

A run of period p and a length of 2p or more has at least p places in a row that agree with the place p further on. Every p-th
place is a candidate for p, so one of them lies in the run; from there the run is extended both ways. A
text of n words has n/1 + n/2 + ... candidates, and all but a few fall with the first comparisons of names: only
texts in which some are left get the names of longer blocks.

A null text has no words. Rows do not depend on each other: repeated rows and keys are treated alike.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import map_arrow
from tracewright.llm.tokens import covered, ragged, slices

#: Runs have at least so many words, and twice their period.
SHORTEST = 12
#: Names of blocks up to 2 ** _QUICK words are made for all texts.
_QUICK = 2
#: Candidates that are looked at together.
_BLOCK = 1 << 20
#: Bytes of text that are numbered together.
_SLICE = 1 << 20


@dataclass
class Names:
    """``level[k][i]`` names the block of 2 ** k words from place i; blocks that leave their text, ``end[i]``, do not count."""

    level: list[np.ndarray]
    begin: np.ndarray  # of the text of each place
    end: np.ndarray

    def ahead(self, a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
        """In how many words the places from a and b on agree, below 2 ** (top + 1); a is before b in one text."""
        done = np.zeros(len(a), np.int64)
        stop = self.end[a] if len(a) else a
        for k in range(top, -1, -1):
            at = np.flatnonzero(b + done + (1 << k) <= stop)
            at = at[self.level[k][a[at] + done[at]] == self.level[k][b[at] + done[at]]]
            done[at] += 1 << k
        return done

    def back(self, a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
        """In how many words the places before a and b agree, going back."""
        done = np.zeros(len(a), np.int64)
        first = self.begin[a] if len(a) else a
        for k in range(top, -1, -1):
            at = np.flatnonzero(a - done - (1 << k) >= first)
            at = at[self.level[k][a[at] - done[at] - (1 << k)] == self.level[k][b[at] - done[at] - (1 << k)]]
            done[at] += 1 << k
        return done


def name_blocks(words: np.ndarray, first: np.ndarray, top: int) -> Names:
    """Names of all blocks up to 2 ** top words, of texts that begin at ``first`` (and end at its last value)."""
    size = np.diff(first)
    out = Names([words.astype(np.int64)], np.repeat(first[:-1], size), np.repeat(first[1:], size))
    for k in range(top):
        last, half = out.level[-1], 1 << k
        whole = np.flatnonzero(np.arange(len(words)) + 2 * half <= out.end)
        names = np.full(len(words), -1, np.int64)
        if len(whole):
            pairs = last[whole] * (int(last.max()) + 1) + last[whole + half]
            names[whole] = np.unique(pairs, return_inverse=True)[1]
        out.level.append(names)
    return out


def _grid(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of all candidates, in blocks.

    A run of period p and 12 words or more has max(p, 12 - p) agreeing places in a row, so every so many-th
    place is enough.
    """
    size = np.diff(first)
    half = size // 2
    text = np.repeat(np.arange(len(size)), half)
    period = ragged(np.ones(len(size), np.int64), half)
    step = np.maximum(period, SHORTEST - period)
    count = np.where(size[text] >= SHORTEST, (size[text] - period - 1) // step + 1, 0)
    sums = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + _BLOCK, side="right")) - 1)
        # One text and period with more candidates than a block are dealt in parts.
        for a in range(0, int(count[lo]) if hi == lo + 1 else 1, _BLOCK):
            n = np.minimum(count[lo:hi] - a, _BLOCK) if hi == lo + 1 else count[lo:hi]
            steps = ragged(np.full(hi - lo, a, np.int64), n)
            which = np.repeat(np.arange(lo, hi), n)
            yield first[text[which]] + steps * step[which], period[which]
        lo = hi


def find_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs of all texts, by start, then period; ``words`` are numbers, equal for equal words."""
    quick = name_blocks(words, first, _QUICK)
    far = (2 << _QUICK) - 1  # as far as the quick names see
    left_at, left_p = [], []
    for at, p in _grid(first):
        same = quick.level[0][at] == quick.level[0][at + p]
        at, p = at[same], p[same]
        ahead, back = quick.ahead(at, at + p, _QUICK), quick.back(at, at + p, _QUICK)
        keep = (ahead == far) | (back == far) | (ahead + back >= np.maximum(p, SHORTEST - p))
        left_at.append(at[keep])
        left_p.append(p[keep])
    at, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left_at, left_p))
    if not len(at):
        return at, at, at
    # Only texts with candidates get the names of longer blocks.
    text = np.searchsorted(first, at, side="right") - 1
    mine = np.unique(text)
    size = np.diff(first)[mine]
    own = np.concatenate([[0], np.cumsum(size)])
    shift = np.zeros(len(first), np.int64)
    shift[mine] = first[mine] - own[:-1]
    top = max(int(size.max()).bit_length() - 1, 0)
    names = name_blocks(words[ragged(first[mine], size)], own, top)
    found = []
    for lo in range(0, len(at), _BLOCK):
        q, moved = p[lo : lo + _BLOCK], shift[text[lo : lo + _BLOCK]]
        a = at[lo : lo + _BLOCK] - moved
        begin, end = a - names.back(a, a + q, top), a + q + names.ahead(a, a + q, top)
        ok = end - begin >= np.maximum(2 * q, SHORTEST)
        found.append(np.unique(np.stack([(begin + moved)[ok], (end + moved)[ok], q[ok]], 1), axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    # Multiples of the smallest period give the same stretch; the smallest comes first.
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    start, end, period = rows[new].T
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def number_words(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of texts, their numbers one text after another, and where texts begin."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    split = [t.split() for t in texts]  # bytes are split at the six ASCII blanks
    first = np.concatenate([[0], np.cumsum([len(w) for w in split], dtype=np.int64)]).astype(np.int64)
    numbers = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(first[-1]))
    return split, numbers, first


def repeat_words(key: int | None, words: list[bytes], numbers: np.ndarray) -> bool:
    """Plant a repetition, as the contract of ``op13`` has it, in one of ten texts; null keys have none."""
    n = len(words)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return False
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    source = np.arange(n)
    source[a:] = a + (source[a:] - a) % p
    numbers[:] = numbers[source]
    words[:] = [words[i] for i in source.tolist()]
    return True


SCHEMA = "key long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
DIGESTS = "key long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _solve(batches: Iterator[pa.RecordBatch], plant: bool):
    """``(key, words, starts, ends, periods, kept words)`` of each text."""
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            keys = part.column(0).to_pylist()
            split, numbers, first = number_words([t.encode() for t in part.column(1).to_pylist()])
            if plant:
                for i, key in enumerate(keys):
                    repeat_words(key, split[i], numbers[first[i] : first[i + 1]])
            start, end, period = find_runs(numbers, first)
            bounds = np.searchsorted(start, first)
            rows = []
            for i, key in enumerate(keys):
                lo, hi = bounds[i], bounds[i + 1]
                s, e, p = start[lo:hi] - first[i], end[lo:hi] - first[i], period[lo:hi]
                kept = split[i]
                if hi > lo:
                    gone = covered(len(kept), s + p, e - s - p)
                    kept = [kept[j] for j in np.flatnonzero(~gone).tolist()]
                rows.append((key, len(split[i]), s, e - s, p, kept))
            yield rows


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _solve(batches, False):
        runs = [[{"start": a, "length": b, "period": c} for a, b, c in zip(s.tolist(), n.tolist(), p.tolist())] for _, _, s, n, p, _ in rows]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array([b" ".join(r[5]).decode() for r in rows], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "runs", "text"])


def _digests(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _solve(batches, plant):
            out = []
            for key, _, s, n, p, kept in rows:
                best = (None,) * 4
                if len(s):
                    i = int(np.lexsort((p, s, -n))[0])
                    best = (int(s[i]), int(n[i]), int(p[i]), int(1000 * n[i] // p[i]))
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), n.tolist(), p.tolist()))
                out.append((key, len(s), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in DIGESTS.split(", ")])

    return run


def _input(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, runs, text)`` of each document: its periodic runs, and the text with one period of each left.

    A run has a start (number of the word), a length and a period in words; it is as long as its period lasts. Words
    are parted by blanks, and the text left has its words joined by one space. Nothing is shuffled.
    """
    return map_arrow(_input(docs, key, text), _runs, SCHEMA)


def digest_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """The number of runs, the longest one, and digests of all runs and of the text left.

    ``plant`` first writes a repetition into one of ten texts, to have some to find.
    """
    return map_arrow(_input(docs, key, text), _digests(plant), DIGESTS)


#: CRC-32 of ASCII text, bit by bit: a byte is mixed in, then eight times a bit is shifted out.
CRC32_MACRO = """list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length({s}) + 1), lambda i: [ascii(substring({s}, i::int, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
 lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)"""

ORACLE = f"""
with t0 as (select row_number() over () as row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
 xor({CRC32_MACRO.format(s="doc_id::varchar")}, 4294967295) as h from documents),
t1 as (select *, len(w) as n, (h // 10) % greatest(len(w), 1) as a, h % 10 = 0 and len(w) > 0 as planted from t0),
t as (select row, doc_id, n, case when planted then list_transform(range(0, n), lambda i: w[(case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) end)::int + 1]) else w end as w from t1),
p as (select row, unnest(w) as word, unnest(range(0, n)) as i from t),
same as (select x.row, y.i - x.i as q, x.i as i from p x join p y on x.row = y.row and x.word = y.word and y.i > x.i),
island as (select row, q, i, i - row_number() over (partition by row, q order by i) as g from same),
stretch as (select row, q, min(i) as s, count(*) + q as len from island group by row, q, g having count(*) >= greatest(q, 12 - q)),
runs as (select row, s, len, min(q) as q from stretch group by 1, 2, 3),
best as (select * from runs qualify row_number() over (partition by row order by len desc, s, q) = 1),
listed as (select row, count(*) as n, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as said from runs group by 1),
gone as (select distinct row, unnest(range(s + q, s + len)) as i from runs),
kept as (select row, string_agg(word, ' ' order by i) as said from p anti join gone using (row, i) group by 1)
select t.doc_id, coalesce(l.n, 0) as n_runs, b.s as start, b.len as length, b.q as period, 1000 * b.len // b.q as exponent_milli,
 sha256(coalesce(l.said, '')) as runs_sha256, sha256(coalesce(k.said, '')) as collapsed_sha256
from t left join listed l using (row) left join best b using (row) left join kept k using (row)
"""
