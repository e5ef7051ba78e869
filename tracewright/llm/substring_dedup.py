"""Substring dedup by relative Lempel-Ziv parsing.

The corpus is its own reference. Documents are packed, a few MB of text each, and parsed
against every reference block that can hold one of their phrases (runs of ``window`` words):

1. *own block*: a pack is the first reference of its documents;
2. *anchors*: each phrase is named by the smallest hash of its 10-word runs. Packs send their
   distinct anchors out, and hear which of them other packs have, too;
3. *content blocks*: passages whose anchor recurs are sent, as text, to the reference block of
   that anchor, each distinct phrase once a pack. An anchor with very many phrases is dealt
   over all blocks, by whole phrases. A block indexes its passages and parses each of them
   against those that are earlier;
4. *parsing* is greedy, from left to right: a factor starts at the next phrase that occurs
   earlier, and copies from its earliest occurrence for as long as the words agree. At the
   boundary behind a factor the phrases that reach across it are looked up, too, so the next
   factor may start before it. Factors have at least ``window`` words.

The words of all factors go, and all others stay. Hashes only find candidates: words have exact
numbers in each block, and phrases and factors are compared word by word.

A phrase that very many documents share costs one row a pack in its block, and the number of
blocks follows the number of packs, so no task follows the size of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.packs import pack_documents, unpack
from tracewright.llm.shared import map_arrow, parallelism
from tracewright.llm.tokens import Words, covered, grams, mix, ragged, within, word_hashes, words_of

_U = np.uint64
_SECOND = _U(0x5851F42D4C957F2D)
_STEP = 1 << 16


def equal_words(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words numbered ``a`` and ``b`` are the same bytes."""
    size = w.end[a] - w.start[a]
    same = size == w.end[b] - w.start[b]
    for k in range(int(size[same].max()) if same.any() else 0):
        at = np.flatnonzero(same & (size > k))
        if len(at) < 64:  # few and long: one by one
            for i in at.tolist():
                x, y = w.start[a[i]], w.start[b[i]]
                same[i] = np.array_equal(w.data[x + k : x + size[i]], w.data[y + k : y + size[i]])
            break
        same[at] = w.data[w.start[a[at]] + k] == w.data[w.start[b[at]] + k]
    return same


def word_numbers(w: Words, h: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words and only for those."""
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    every = np.arange(len(h))
    wrong = every[~equal_words(w, every, first[number])]
    more: dict[bytes, int] = {}
    for i in wrong.tolist():
        number[i] = len(first) + more.setdefault(w.data[w.start[i] : w.end[i]].tobytes(), len(more))
    return number


def first_equal(number: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """For each phrase the first one with the same words; phrases are given by their first words."""
    if not len(start):
        return np.zeros(0, np.int64)
    digest = grams(mix(number.astype(np.uint64)), window)[start]
    _, first, group = np.unique(digest, return_index=True, return_inverse=True)
    at, run = first[group], np.arange(window)
    late = np.flatnonzero(at != np.arange(len(start)))
    seen: dict[bytes, int] = {}
    for lo in range(0, len(late), _STEP):
        some = late[lo : lo + _STEP]
        mine = number[start[some][:, None] + run]
        differ = (mine != number[start[at[some]][:, None] + run]).any(1)
        for i, words in zip(some[differ].tolist(), mine[differ]):
            at[i] = seen.setdefault(words.tobytes(), i)
    return at


def parse(number: np.ndarray, bounds: np.ndarray, start: np.ndarray, source: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors ``(start, length, source)`` of many passages, in word positions.

    Passage *i* has the words ``bounds[i]:bounds[i + 1]``, phrase *k* begins at word
    ``start[k]``, in order, and occurs first at ``source[k]``. All passages are parsed side by side.
    """
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none
    last = len(start)
    copy = np.where(source != start, np.arange(last), last)
    following = np.append(np.minimum.accumulate(copy[::-1])[::-1], last)  # the next phrase that is a copy
    place = np.append(start, np.iinfo(np.int64).max)
    stop = bounds[1:]
    at = following[np.searchsorted(start, bounds[:-1])]
    live = place[at] < stop
    at, stop = at[live], stop[live]
    out = []
    while len(at):
        p, r = start[at], source[at]
        most = np.minimum(stop - p, bounds[np.searchsorted(bounds, r, side="right")] - r)
        length = _agreement(number, p, r, window, most)
        out.append((p, length, r))
        at = following[np.searchsorted(start, p + length - window + 1)]
        live = place[at] < stop
        at, stop = at[live], stop[live]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def _agreement(number: np.ndarray, p: np.ndarray, r: np.ndarray, least: int, most: np.ndarray) -> np.ndarray:
    """How many words from ``p`` and ``r`` on are the same, ``most`` at most; ``least`` are known to be."""
    length, open_, step = np.full(len(p), least, np.int64), np.arange(len(p)), 8
    while len(open_):
        ahead = length[open_][:, None] + np.arange(step)
        inside = ahead < most[open_][:, None]
        ahead = np.where(inside, ahead, 0)
        same = inside & (number[p[open_][:, None] + ahead] == number[r[open_][:, None] + ahead])
        count = np.where(same.all(1), step, same.argmin(1))
        length[open_] += count
        open_ = open_[count == step]
        step = min(2 * step, 4096) if len(open_) * step < _STEP else step
    return length


class Pack:
    """A pack's documents as words, phrases and anchors."""

    def __init__(self, body: bytes, window: int):
        t = unpack(body)
        self.keys = t.column("key").to_numpy()
        self.words = w = words_of(t.column("text"))
        self.hashes = h = word_hashes(w)
        self.window = window
        self.start = np.flatnonzero(within(w.first, window, len(h)))  # first word of every phrase
        self.doc = np.searchsorted(w.first, self.start, side="right") - 1
        run = max(1, window // 2)
        small = grams(h, run)
        self.anchor = _smallest(small, window - run + 1)[self.start] if len(self.start) else np.zeros(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order, and how often each occurs."""
        a = self.anchor
        if not len(a):
            return a, np.zeros(0, np.int64)
        # One occurrence is a run of phrases that follow each other under one anchor.
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (np.diff(self.start) != 1)])
        return np.unique(a[fresh], return_counts=True)

    def firsts(self) -> np.ndarray:
        """For each phrase the first one here with the same words."""
        self.number = word_numbers(self.words, self.hashes)
        return first_equal(self.number, self.start, self.window)


def _smallest(a: np.ndarray, k: int) -> np.ndarray:
    """The minimum of each run of ``k`` values."""
    size, best = 1, a
    while 2 * size <= k:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    rest = k - size
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def _block(anchor: np.ndarray, blocks: int) -> np.ndarray:
    # Anchors are minima, so their own order says little; mixed, they are even.
    return (mix(anchor ^ _SECOND) >> _U(33)).astype(np.int64) * blocks >> 31


def _rows(columns: dict) -> pa.RecordBatch:
    types = {"pack": pa.int64(), "block": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.binary())) for k, v in columns.items()], names=list(columns))


def _groups(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The positions of each block, in order."""
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(block[part[0]]), part


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueeze(b: bytes) -> bytes:
    return pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def _numbers(*columns: np.ndarray) -> bytes:
    """Columns of equally many integers, as differences."""
    return _squeeze(b"".join(np.diff(c.astype(np.int64), prepend=np.int64(0)).tobytes() for c in columns))


def _columns(b: bytes, count: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(_unsqueeze(b), np.int64).reshape(count, -1), axis=1)


def _send_anchors(window: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, count = Pack(body.as_py(), window).anchors()
                count = np.minimum(count, 65_535).astype(np.uint16)
                out = {"block": [], "pack": [], "anchors": [], "counts": []}
                for b, at in _groups(_block(found, blocks)):
                    out["block"].append(b)
                    out["pack"].append(pack)
                    out["anchors"].append(found[at].tobytes())
                    out["counts"].append(_squeeze(count[at].tobytes()))
                yield _rows(out)

    return run


def _by_block(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each block; a partition has few blocks."""
    rows: dict[int, list[tuple]] = {}
    for x in batches:
        for block, *rest in zip(*(x.column(i).to_pylist() for i in range(columns))):
            rows.setdefault(block, []).append(tuple(rest))
    while rows:
        yield rows.popitem()


def _answer_anchors(hot: int):
    """To every pack, two bits for each of its anchors: other packs have it, and it has more than ``hot`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_block(batches, 4):
            anchors = [np.frombuffer(a, np.uint64) for _, a, _ in rows]
            counts = np.concatenate([np.frombuffer(_unsqueeze(c), np.uint16) for _, _, c in rows])
            _, group = np.unique(np.concatenate(anchors), return_inverse=True)
            shared = (np.bincount(group) > 1)[group]
            heavy = (np.bincount(group, counts) > hot)[group]
            cut = np.cumsum([len(a) for a in anchors])[:-1]
            bits = [_squeeze(np.packbits(np.stack([s, v])).tobytes()) for s, v in zip(np.split(shared, cut), np.split(heavy, cut))]
            for i in range(0, len(rows), 4096):
                yield _rows({"pack": [r[0] for r in rows[i : i + 4096]], "block": [block] * len(rows[i : i + 4096]), "bits": bits[i : i + 4096]})

    return run


def _send_passages(window: int, anchor_blocks: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, body, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                p = Pack(body.as_py(), window)
                found, _ = p.anchors()
                told = np.zeros((2, len(found)), bool)
                said = {a["block"]: a["bits"] for a in answers or ()}
                for b, at in _groups(_block(found, anchor_blocks)):
                    told[:, at] = np.unpackbits(np.frombuffer(_unsqueeze(said[b]), np.uint8), count=2 * len(at)).reshape(2, -1)
                shared, heavy = told[:, np.searchsorted(found, p.anchor)]
                if not shared.any():
                    continue
                first = p.firsts()
                mine = np.flatnonzero(shared & (first == np.arange(len(first))))
                whole = grams(p.hashes, window)[p.start[mine]]
                block = _block(np.where(heavy[mine], whole, p.anchor[mine]), blocks)
                # A passage is a run of phrases of a document that follow each other in one block.
                fresh = np.ones(len(mine), bool)
                fresh[1:] = (np.diff(p.start[mine]) != 1) | (block[1:] != block[:-1]) | (np.diff(p.doc[mine]) != 0)
                head = np.flatnonzero(fresh)
                size = np.diff(np.append(head, len(mine))) + window - 1
                begin, doc = p.start[mine[head]], p.doc[mine[head]]
                out = {"block": [], "pack": [], "about": [], "text": []}
                for b, at in _groups(block[head]):
                    out["block"].append(b)
                    out["pack"].append(pack)
                    out["about"].append(_numbers(begin[at], p.keys[doc[at]], begin[at] - p.words.first[doc[at]], size[at]))
                    out["text"].append(_squeeze(_words_text(p.words, ragged(begin[at], size[at]))))
                yield _rows(out)

    return run


def _words_text(w: Words, at: np.ndarray) -> bytes:
    """The numbered words, a blank after each."""
    length = w.end[at] - w.start[at]
    out = np.full(int(length.sum()) + len(at), 0x20, np.uint8)
    ends = np.cumsum(length + 1)
    out[ragged(ends - length - 1, length)] = w.data[ragged(w.start[at], length)]
    return out.tobytes()


def _parse_block(window: int):
    """Factors of every pack's passages against the block's earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_block(batches, 4):
            about = [_columns(a, 4) for _, a, _ in rows]
            pack = np.repeat([r[0] for r in rows], [a.shape[1] for a in about])
            local, key, start, size = np.concatenate(about, axis=1)
            w = words_of(pa.array([b"".join(_unsqueeze(t) for _, _, t in rows)], pa.large_binary()).cast(pa.large_string()))
            number = word_numbers(w, word_hashes(w))
            order = np.lexsort((pack, start, key))  # so that what is earlier in the corpus is earlier here
            number = number[ragged((np.cumsum(size) - size)[order], size[order])]
            pack, local, key, start, size = (x[order] for x in (pack, local, key, start, size))
            bounds = np.concatenate([[0], np.cumsum(size)])
            phrase = ragged(bounds[:-1], size - window + 1)
            at, length, source = parse(number, bounds, phrase, phrase[first_equal(number, phrase, window)], window)
            mine, theirs = (np.searchsorted(bounds, x, side="right") - 1 for x in (at, source))
            found = (local[mine] + at - bounds[mine], length, key[theirs], start[theirs] + source - bounds[theirs])
            for p, some in _groups(pack[mine]):
                yield _rows({"pack": [p], "found": [_numbers(*(x[some] for x in found))]})

    return run


def _parse(window: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ref_key", pa.int64()), ("ref_start", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, found in zip(batch.column(1), batch.column(2).to_pylist()):
                p = Pack(body.as_py(), window)
                spans, removed, texts = parse_pack(p, found or ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.keys).cast(pa.int64()), pa.array(p.words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), texts],
                    names=["key", "n_words", "n_removed", "spans", "kept_text"],
                )

    return run


def parse_pack(p: Pack, found) -> tuple[list, np.ndarray, pa.Array]:
    """Factors, removed words and kept text of each document of a pack; ``found`` are factors from other blocks."""
    w = p.words
    first = p.firsts()
    at, length, source = parse(p.number, w.first, p.start, p.start[first], p.window)
    doc = np.searchsorted(w.first, source, side="right") - 1
    own = np.stack([at, length, p.keys[doc], source - w.first[doc]]) if len(at) else np.zeros((4, 0), np.int64)
    at, length, key, start = np.concatenate([own, *(_columns(f, 4) for f in found)], axis=1)
    drop = covered(len(p.hashes), at, length)
    spans = [[] for _ in range(len(p.keys))]
    # Factors of different blocks that go on copying from the same place are one; what is inside another one goes.
    order = np.lexsort((-length, at))
    at, end, key, start = at[order], (at + length)[order], key[order], start[order]
    owner = np.searchsorted(w.first, at, side="right") - 1
    reach, open_, open_doc = -1, None, -1
    for a, e, k, s, d in zip(at.tolist(), end.tolist(), key.tolist(), start.tolist(), owner.tolist()):
        lo = int(w.first[d])
        if d == open_doc and a <= reach and open_["ref_key"] == k and open_["ref_start"] - open_["start"] == s - (a - lo):
            open_["end"] = max(open_["end"], e - lo)
        elif e > reach:
            open_ = {"start": a - lo, "end": e - lo, "ref_key": k, "ref_start": s}
            open_doc = d
            spans[d].append(open_)
        else:
            continue
        reach = max(reach, e)
    removed = np.add.reduceat(np.concatenate([drop, [False]]).astype(np.int64), w.first[:-1]) if len(p.keys) else np.zeros(0, np.int64)
    removed[w.count == 0] = 0
    return spans, removed, _joined(p, ~drop)


def _joined(p: Pack, keep: np.ndarray) -> pa.Array:
    """Each document's kept words with one blank between them."""
    w = p.words
    start, end, doc = w.start[keep], w.end[keep], w.doc[keep]
    length = end - start + 1  # a blank after each word
    data = np.full(int(length.sum()), 0x20, np.uint8)
    into = np.concatenate([[0], np.cumsum(length)])
    # Bytes of kept words, in order; the gaps stay blanks.
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    source = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    slot = np.ones(len(data), bool)
    slot[into[1:] - 1] = False
    data[slot] = w.data[source]
    count = np.bincount(doc, minlength=len(p.keys))
    upto = into[np.concatenate([[0], np.cumsum(count)])]
    # The blank after a document's last word is left out by cutting it from the text.
    last = upto[1:][count > 0] - 1
    mask = np.ones(len(data), bool)
    mask[last] = False
    offsets = upto - np.concatenate([[0], np.cumsum(count > 0)])
    return pa.LargeStringArray.from_buffers(len(p.keys), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[mask].tobytes())).cast(pa.string())


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, blocks: int | None = None, hot: int = 2000) -> DataFrame:
    """Every document without the passages that occur earlier.

    Returns ``(key, n_words, n_removed, spans, kept_text)``, one row a document.
    Words are separated by blanks. A run of ``window`` words is repeated if it also
    starts earlier: in a document with a smaller (integer) key, or before in the same
    document; all words of repeated runs go. ``spans`` are the factors: word range
    (end exclusive), and key and word number of what it copies. ``kept_text`` has
    the other words, one blank between them. Anchors with more than ``hot`` occurrences are
    dealt by whole phrases, which has no influence on the words that go.

    Null and empty texts have no words; texts below ``window`` words are never
    touched; of rows with equal keys and texts one stays whole. Rows with a null key
    are ignored. An empty table gives an empty result; other columns are not looked at.
    """
    kind = docs.schema[key].dataType.simpleString()
    packs = pack_documents(docs, key, text)
    blocks = blocks or max(4 * parallelism(docs.sparkSession), packs.count() // 8)
    sent = map_arrow(packs, _send_anchors(window, blocks), "block int, pack long, anchors binary, counts binary")
    answers = map_arrow(sent.repartition(blocks, "block"), _answer_anchors(hot), "pack long, block int, bits binary")
    by_pack = answers.groupBy("pack").agg(F.collect_list(F.struct("block", "bits")).alias("answers"))
    passages = map_arrow(packs.join(by_pack, "pack"), _send_passages(window, blocks, blocks), "block int, pack long, about binary, text binary")
    factors = map_arrow(passages.repartition(blocks, "block"), _parse_block(window), "pack long, found binary")
    found = factors.groupBy("pack").agg(F.collect_list("found").alias("found"))
    out = map_arrow(
        packs.join(found, "pack", "left"),
        _parse(window),
        "key long, n_words long, n_removed long, spans array<struct<start:long,end:long,ref_key:long,ref_start:long>>, kept_text string",
    )
    return out.select(F.col("key").cast(kind).alias(key), "n_words", "n_removed", "spans", "kept_text")


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null
), runs as (
  select doc_id, i, array_to_string(w[i:i + 19], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)
), late as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by run order by doc_id, i) as no from runs) where no > 1
), gone as (
  select distinct doc_id, pos from (select doc_id, unnest(range(i, i + 20)) as pos from late)
), words as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d
), kept as (
  select words.doc_id, string_agg(word, ' ' order by words.pos) as t from words anti join gone on words.doc_id = gone.doc_id and words.pos = gone.pos group by words.doc_id
), lost as (
  select doc_id, count(*) as n from gone group by doc_id
)
select cast(d.doc_id as bigint) as doc_id, cast(len(w) as bigint) as n_words, coalesce(lost.n, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join kept using (doc_id) left join lost using (doc_id)
"""
