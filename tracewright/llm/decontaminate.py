"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ``window`` benchmark words is a pattern. For the patterns of one
length *m*, a table indexed by the hash of a block of two words says how far the
search may move: the distance from the block's last place in any pattern to the
pattern's end, or ``m - 1`` where no pattern has it. A shift of 0 leads to the
bucket of patterns that end with the block; there the whole pattern is looked up
and its words are compared byte by byte. The words of a batch are searched in
many lanes at once, each moving by its own shifts.

Patterns are compiled on the driver and broadcast, in blocks of a bounded number of benchmark
words (``block_words``), for which long items are cut into pieces that overlap by a window less a
word. Each block is a pass over the rows, which carry the findings of those before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import durable, map_arrow
from tracewright.llm.tokens import SYMBOL_BYTES, covered, grams, ragged, slices, within, word_hashes, words_of

_BITS = 18
_LANE = 256


class Patterns:
    """Patterns of one length: shift table, suffix buckets and the words to compare."""

    def __init__(self, m: int, hashes: np.ndarray, words: list[list[bytes]], items: list[list[int]]):
        self.m, self.block = m, min(2, m)
        mask = np.uint64((1 << _BITS) - 1)
        self.shift = np.full(1 << _BITS, m - self.block + 1, np.int64)
        for q in range(self.block, m + 1):
            at = (grams_rows(hashes[:, q - self.block : q]) & mask).astype(np.int64)
            np.minimum.at(self.shift, at, m - q)
        # Buckets: sorted by suffix block, then by the whole pattern's hash.
        suffix, whole = grams_rows(hashes[:, m - self.block :]) & mask, grams_rows(hashes)
        order = np.lexsort((whole, suffix))
        self.whole, self.suffix = whole[order], suffix[order].astype(np.int64)
        self.bucket = np.searchsorted(self.suffix, np.arange((1 << _BITS) + 1))
        texts = [words[i] for i in order]
        self.lengths = np.array([[len(x) for x in p] for p in texts], np.int64).reshape(len(texts), m)
        self.bytes = np.frombuffer(b"".join(b"".join(p) for p in texts), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.lengths.sum(1))])
        self.items = [items[i] for i in order]

    def search(self, w, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and pattern numbers of all occurrences."""
        n, m = len(h), self.m
        if n < m or not len(self.whole):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        mask = np.uint64((1 << _BITS) - 1)
        blocks = (grams(h, self.block) & mask).astype(np.int64)
        shift = self.shift[blocks[m - self.block :]]  # of the window that starts at each position
        pos = np.arange(0, n - m + 1, _LANE)
        stop = np.minimum(pos + _LANE, n - m + 1)
        found = []
        while len(pos):
            s = shift[pos]
            zero = s == 0
            if zero.any():
                found.append(pos[zero])
            pos = pos + np.maximum(s, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.sort(np.concatenate(found))
        at = at[within(w.first, m, n)[at]]
        whole = grams_rows(h[at[:, None] + np.arange(m)])
        lo, hi = self.bucket[blocks[at + m - self.block]], self.bucket[blocks[at + m - self.block] + 1]
        # The place of the whole hash in its bucket, by bisection in all buckets at once.
        left, right = lo.copy(), hi.copy()
        while (left < right).any():
            mid = (left + right) // 2
            less = np.zeros(len(at), bool)
            ok = left < right
            less[ok] = self.whole[mid[ok]] < whole[ok]
            left, right = np.where(ok & less, mid + 1, left), np.where(ok & ~less, mid, right)
        # Patterns of one hash follow each other; all of them are compared.
        places, patterns = [at[:0]], [lo[:0]]
        while len(at):
            hit = left < hi
            hit[hit] = self.whole[left[hit]] == whole[hit]
            at, left, hi, whole = at[hit], left[hit], hi[hit], whole[hit]
            places.append(at)
            patterns.append(left)
            left = left + 1
        at, which = np.concatenate(places), np.concatenate(patterns)
        order = np.argsort(at, kind="stable")
        return self.confirmed(w, at[order], which[order])

    def confirmed(self, w, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places and patterns those whose words are the same bytes."""
        if not len(at):
            return at, which
        place = at[:, None] + np.arange(self.m)
        lengths = w.end[place] - w.start[place]
        same = (lengths == self.lengths[which]).all(1)
        at, which, place, lengths = at[same], which[same], place[same], lengths[same]
        total = lengths.sum(1)
        mine = w.data[ragged(w.start[place].ravel(), lengths.ravel())]
        theirs = self.bytes[ragged(self.at[which], total)]
        wrong = np.add.reduceat(mine != theirs, np.concatenate([[0], np.cumsum(total)[:-1]])) if len(at) else np.zeros(0)
        return at[wrong == 0], which[wrong == 0]


def grams_rows(h: np.ndarray) -> np.ndarray:
    """One hash a row, equal to that of :func:`grams` over the same words."""
    n, k = h.shape
    return grams(np.ascontiguousarray(h).ravel(), k)[::k] if n else np.zeros(0, np.uint64)


def compile_patterns(items: list[tuple[str, str]], window: int) -> tuple[list[Patterns], list[str]]:
    """Search tables for the windows of the items' words, and the item ids."""
    names = [i for i, _ in items]
    w = words_of(pa.array([t for _, t in items], pa.string()), SYMBOL_BYTES, True)
    h, by_length = word_hashes(w), {}
    for k in range(len(items)):
        lo, hi = int(w.first[k]), int(w.first[k + 1])
        m = min(window, hi - lo)
        for p in range(lo, hi - m + 1) if m else ():
            text = tuple(bytes(w.data[w.start[i] : w.end[i]]) for i in range(p, p + m))
            by_length.setdefault(m, {}).setdefault(text, (p, set()))[1].add(k)
    made = []
    for m, found in sorted(by_length.items()):
        rows = np.array([h[p : p + m] for p, _ in found.values()], np.uint64)
        made.append(Patterns(m, rows, [list(t) for t in found], [sorted(s) for _, s in found.values()]))
    return made, names


def _searcher(compiled):
    """``compiled``: search tables and item ids, broadcast."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = compiled.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield findings(part, tables, names)

    return search


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def findings(part: pa.RecordBatch, tables: list[Patterns], names: list[str]) -> pa.RecordBatch:
    """Rows of ``(key, text, n_words, spans, items)`` with what the tables find added."""
    w = words_of(part.column("text"), SYMBOL_BYTES, True)
    h, n = word_hashes(w), part.num_rows
    before = part.column("spans").to_pylist()
    known = [(int(lo) + s["start"], s["end"] - s["start"]) for lo, some in zip(w.first, before) for s in some]
    starts, lengths = (np.array(x, np.int64) for x in (zip(*known) if known else ((), ())))
    starts, lengths, found = [starts], [lengths], [set(x) for x in part.column("items").to_pylist()]
    for t in tables:
        at, which = t.search(w, h)
        doc = np.searchsorted(w.first, at, side="right") - 1
        starts.append(at)
        lengths.append(np.full(len(at), t.m))
        for d, p in np.unique(np.stack([doc, which], 1), axis=0) if len(at) else ():
            found[d].update(names[i] for i in t.items[p])
    hit = covered(len(h), np.concatenate(starts), np.concatenate(lengths))
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    # Spans end with their text.
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans = [[] for _ in range(n)]
    for a, b in zip(lo.tolist(), hi.tolist()):
        d = int(np.searchsorted(w.first, a, side="right")) - 1
        while a < b:
            c = min(b, int(w.first[d + 1]))
            if c > a:
                spans[d].append({"start": a - int(w.first[d]), "end": c - int(w.first[d])})
            a, d = c, d + 1
    return pa.RecordBatch.from_arrays(
        [part.column("key"), part.column("text"), pa.array(w.count, pa.int64()), pa.array(spans, _SPANS), pa.array([sorted(f) for f in found], pa.list_(pa.string()))],
        names=["key", "text", "n_words", "spans", "items"],
    )


def _cut(window: int, size: int):
    """Items in pieces with ``size`` windows at most: their words with blanks between, and how many those are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"item": [], "text": [], "n": []}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words_of(pa.array([text.as_py()], pa.string()), SYMBOL_BYTES, True)
                words = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)]
                for lo in range(0, max(len(words) - window + 1, 1) if words else 0, size):
                    some = words[lo : lo + size + window - 1]
                    for c, v in zip(out, (item, b" ".join(some).decode(), len(some))):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["item"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["n"], pa.int64())], names=list(out))

    return run


def _blocks(benchmark: DataFrame, item: str, item_text: str, window: int, block_words: int) -> Iterator:
    """Compiled patterns of the benchmark's items, about ``block_words`` words each, broadcast; the driver holds one block at a time."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull())
    pieces = durable(map_arrow(items, _cut(window, max(1, block_words // 8)), "item string, text string, n long"))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    for b in range(blocks):
        mine = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(compile_patterns([(r[0], r[1]) for r in mine], window))


#: Blocks whose tables executors hold at a time.
AT_ONCE = 4


def _in_turn(rows: DataFrame, blocks: Iterator, step) -> DataFrame:
    """``step(rows, compiled)`` for each block. After a few blocks what there is is written, and their tables leave the executors."""
    held: list = []
    for compiled in blocks:
        if len(held) == AT_ONCE:
            rows = durable(rows)
            for old in held:
                old.unpersist()
            held = []
        rows = step(rows, compiled)
        held.append(compiled)
    return rows


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_words: int = 200_000,
) -> DataFrame:
    """Benchmark passages in documents: ``(key, n_words, spans, items)``, one row for each row.

    ``spans`` are the covered word ranges (end exclusive, merged), ``items`` the ids (as
    strings, sorted) of items with an occurring window. Words are runs of letters,
    digits and non-ASCII characters, A-Z lower-cased. Items shorter than
    ``window`` are one window; items and documents without words (null too) match
    nothing. Repeated items all count, and so do repeated rows. Rows with a null key are ignored. A
    benchmark beyond ``block_words`` words is searched in blocks, with the same
    result. Empty tables give empty, respectively clean results; other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("key").isNotNull())
    schema = f"key {rows.schema['key'].dataType.simpleString()}, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    out = rows.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    out = _in_turn(out, _blocks(benchmark, item, item_text, window, block_words), lambda rows, compiled: map_arrow(rows, _searcher(compiled), schema))
    return out.select(F.col("key").alias(key), "n_words", "spans", "items")


def _keeper(compiled):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, _ = compiled.value
        for batch in batches:
            for part in slices(batch, "_text"):
                w = words_of(part.column(0), SYMBOL_BYTES, True)
                h = word_hashes(w)
                clean = np.ones(part.num_rows, bool)
                for t in tables:
                    at, _ = t.search(w, h)
                    clean[np.searchsorted(w.first, at, side="right") - 1] = False
                yield part.filter(pa.array(clean))

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = 200_000
) -> DataFrame:
    """The documents, all columns whatever their names, that hold no benchmark window; one pass over them a block, and no shuffle.

    Documents and items are read as in :func:`find_contamination`; documents with null or
    empty texts stay, and equal rows stay or go together. An empty table gives an empty result, an empty
    benchmark leaves all.
    """
    names = [f"_k{i}" for i in range(len(docs.columns))]
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    kind = rows.schema
    rows = _in_turn(rows, _blocks(benchmark, item, item_text, window, block_words), lambda some, compiled: map_arrow(some, _keeper(compiled), kind))
    return rows.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents where doc_id is not null)
), b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null and item_id is not null
), bw as (
  select item_id, least(10, len(w)) as m, unnest(range(1, greatest(2, len(w) - 8))) as i, w from b where len(w) > 0
), p as (
  select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as win from bw where i + m - 1 <= len(w)
), lens as (select distinct m from p),
dw as (
  select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as win
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, lens where len(w) >= m)
), hits as (
  select dw.doc_id, dw.i, dw.m, p.item_id from dw join p on dw.m = p.m and dw.win = p.win
), cov as (
  select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + m)) as pos from hits) group by doc_id
), its as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select cast(d.doc_id as bigint) as doc_id, cast(len(d.w) as bigint) as n_words, coalesce(cov.n_hit, 0) as n_hit,
       coalesce(its.n_items, 0) as n_items, sha256(coalesce(its.items, '')) as items_sha256, coalesce(cov.n_hit, 0) > 0 as contaminated
from d left join cov using (doc_id) left join its using (doc_id)
"""
