"""Line dedup with a log-template tree.

Lines are parsed down a tree of fixed depth: the number of tokens, then the leading
tokens; tokens with a digit are variable fields (``<*>``) from the start. In a leaf
that enough documents reach, a token is constant at its place if enough documents have
it there, and a variable field otherwise. Constants and fields make the line's
template; it needs constants for ``constant_share`` of the tokens without digits, so that prose with a common
beginning is none. A template that occurs in ``min_docs`` documents or more is
boilerplate, and its lines are dropped everywhere but in the document with the smallest key.

Documents are counted exactly, for leaves and for every token at its place in a leaf, by their
64-bit hashes in sums that combine before they are shuffled. So that ordinary prose is
not shuffled too, tasks hold a bit table of the leaves that enough documents reach, and then one
of the constants; their width grows with what they hold (to at most ``1 << MOST_BITS``
bits), and what they let through in vain is turned away by joins with the exact counts. Lines are
joined once for each distinct content. Templates are counted exactly too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.shared import durable, free_name, map_arrow
from tracewright.llm.tokens import Words, mix, slices, word_hashes, words_of

_U = np.uint64
_FIELD = _U(0x3C6EF372FE94F82B)  # stands for a variable field
_SALT = _U(0xD1B54A32D192ED03)
_NEWLINE = 0x0A
#: Widest bit table, 16 MB; beyond about four million entries it only lets more through to the joins.
MOST_BITS = 27


class Lines:
    """The lines of many texts that have tokens: bounds in words, document, number in the document."""

    def __init__(self, texts: pa.Array):
        self.words = w = words_of(texts)
        n = len(w.start)
        breaks = np.concatenate([[0], np.cumsum(w.data == _NEWLINE)])
        number = breaks[w.start] if n else np.zeros(0, np.int64)
        doc = w.doc
        fresh = np.ones(n, bool)
        fresh[1:] = (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])
        self.first = np.concatenate([np.flatnonzero(fresh), [n]])
        self.doc = doc[self.first[:-1]]
        self.number = (number[self.first[:-1]] - breaks[w.offsets[:-1]][self.doc]).astype(np.int64)
        self.size = np.diff(self.first)
        self.total = np.array([int(breaks[b] - breaks[a]) + 1 for a, b in zip(w.offsets[:-1], w.offsets[1:])], np.int64)
        self.masked = _masked(w)

    def leaf(self, lead: int) -> np.ndarray:
        """A hash of the token count and the leading tokens of each line."""
        h = mix(self.size.astype(np.uint64) ^ _SALT)
        for k in range(lead):
            has = self.size > k
            token = self.masked[np.minimum(self.first[:-1] + k, max(len(self.masked) - 1, 0))] if len(self.size) else self.masked
            h = np.where(has, mix(h * _U(0x9E3779B97F4A7C15) + token), h)
        return h

    def places(self, leaf: np.ndarray) -> np.ndarray:
        """A hash of leaf, place and token for each word."""
        line = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(self.masked)) - self.first[:-1][line]
        return mix(leaf[line] + mix(self.masked + place.astype(np.uint64) * _SALT))


def _masked(w: Words) -> np.ndarray:
    """Hashes of the words, one for all that have a digit."""
    digit = np.concatenate([[0], np.cumsum((w.data >= 0x30) & (w.data <= 0x39))])
    return np.where(digit[w.end] > digit[w.start], _FIELD, word_hashes(w))


def _distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hashes, each once for a document."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return v[fresh]


def _leaves(lead: int):
    """The leaves of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = Lines(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(_distinct(x.doc, x.leaf(lead)).view(np.int64))], names=["h"])

    return run


def _tokens(lead: int, leaves: bytes):
    """The tokens without digits, at their places, of each document, in the leaves whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = Lines(part.column("text"))
                leaf = x.leaf(lead)
                word = np.repeat(_bit(leaves, leaf), x.size) & (x.masked != _FIELD)
                found = _distinct(np.repeat(x.doc, x.size)[word], x.places(leaf)[word])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    return run


def _bit(table: bytes, h: np.ndarray) -> np.ndarray:
    t = np.frombuffer(table, np.uint8)
    at = (h >> _U(62 - len(table).bit_length())).astype(np.int64)  # 8 * len(table) is a power of two
    return (t[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _frequent(hashes: DataFrame, least: int) -> DataFrame:
    """``h`` of those that occur ``least`` times."""
    return durable(hashes.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h"))


def _bits_of(hashes: DataFrame, bits: int | None) -> bytes:
    """A bit for each hash, by its leading ``bits`` bits; 32 to 64 bits a hash if not given."""
    if bits is None:
        bits = min(max((32 * hashes.count()).bit_length(), 16), MOST_BITS)
    counters = hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("counter"))
    # Words of 64 bits are put together on the executors: the driver gets at most ``1 << (bits - 6)`` rows.
    word = F.expr("bit_or(shiftleft(1L, cast(63 - counter % 64 as int)))")
    packed = counters.groupBy(F.shiftright("counter", 6).alias("at")).agg(word.alias("v")).toPandas()
    table = np.zeros((1 << bits) // 64, ">i8")  # big-endian: a word's first counter is its first byte's first bit
    table[packed["at"].to_numpy(np.int64)] = packed["v"].to_numpy(np.int64)
    return table.tobytes()


def _parse(lead: int, leaves: bytes, tokens: bytes, constant_share: float):
    """Lines that can have enough constants: document, number, content, and for one of each content its possible constants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = Lines(part.column("text"))
                leaf = x.leaf(lead)
                alive = _bit(leaves, leaf)
                if not alive.any():
                    continue
                place = x.places(leaf)
                constant = (x.masked != _FIELD) & _bit(tokens, place)
                upto = np.concatenate([[0], np.cumsum(constant)])
                count = upto[x.first[1:]] - upto[x.first[:-1]]
                words = np.add.reduceat((x.masked != _FIELD).astype(np.int64), x.first[:-1])
                some = np.flatnonzero(alive & (count > 0) & (count >= constant_share * words))
                content = np.bitwise_xor.reduceat(place, x.first[:-1])[some]
                _, heads = np.unique(content, return_index=True)
                fresh = np.zeros(len(some), bool)
                fresh[heads] = True
                line = np.repeat(np.arange(len(x.size)), x.size)
                keep = np.zeros(len(x.size), bool)
                keep[some[fresh]] = True
                ends = np.cumsum(np.where(fresh, count[some], 0))
                constants = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(place[constant & keep[line]].view(np.int64))
                )
                doc = pa.array(x.doc[some])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(doc), part.column("mark").take(doc), pa.array(x.number[some]), pa.array(content.view(np.int64)), pa.array(words[some]), constants],
                    names=["key", "mark", "line", "content", "words", "constants"],
                )

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, drops = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, total = [], []
        for t, d in zip(texts, drops):
            lines = t.split("\n") if t is not None else []
            total.append(len(lines))
            gone = set(d or ())
            out.append(t if t is None or not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone))
        columns = [pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array([len(d or ()) for d in drops], pa.int64()), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, names=["_text", "_lines", "_dropped", *batch.schema.names[2:]])


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 8, lead: int = 2, constant_share: float = 0.6, bits: int | None = None
) -> DataFrame:
    """The documents, all columns, with their boilerplate lines cut, and ``n_lines`` and ``n_dropped`` (before, and cut).

    Lines are separated by newlines, tokens by blanks; lines without tokens are never
    cut, nor are those of whose tokens without digits none or less than ``constant_share`` are constant. A
    template's lines stay in the document with the smallest key that has them, as often as
    they are there; rows with that key all keep them. Null texts stay null and
    have no lines; an empty text has one. Equal rows are cut alike. An empty table gives
    an empty result. Other columns are passed on, whatever their names; where ``n_lines`` or ``n_dropped`` is
    one of them, underscores are added to the new one. Rows with a null key are passed on uncut. ``bits`` sets the
    width of the bit tables, which has no influence on the result.
    """
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))  # tells apart texts under one key
    rows = docs.select(F.col(key).alias("key"), mark.alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("key").isNotNull())
    plain = rows.select("text")
    leaves = _bits_of(_frequent(map_arrow(plain, _leaves(lead), "h long"), min_docs), bits)
    constants = _frequent(map_arrow(plain, _tokens(lead, leaves), "h long"), min_docs)
    kind = rows.schema["key"].dataType.simpleString()
    parse = _parse(lead, leaves, _bits_of(constants, bits), constant_share)
    lines = durable(map_arrow(rows, parse, f"key {kind}, mark long, line long, content long, words long, constants array<long>"))
    # A token that enough documents have at its place is in a leaf that they reach, so leaves need no join.
    words = lines.select("content", "words", F.explode("constants").alias("h")).distinct().join(constants, "h")
    parsed = words.groupBy("content").agg(F.count("*").alias("n"), F.max("words").alias("words"), F.expr("bit_xor(h)").alias("template"))
    parsed = durable(parsed.where(F.col("n") >= constant_share * F.col("words")).select("content", "template"))
    found = durable(lines.drop("words", "constants").join(parsed, "content").drop("content"))
    per_doc = found.select("template", "key", "mark").distinct()
    recurring = per_doc.groupBy("template").agg(F.count("*").alias("docs"), F.min("key").alias("head")).where(F.col("docs") >= min_docs)
    recurring = durable(recurring)  # so that both sides of the join are dealt anew, and a hot template can be split
    drops = found.join(recurring.select("template", "head"), "template").where(F.col("key") != F.col("head"))
    drops = drops.select("key", "mark", "line").distinct().groupBy("key", "mark").agg(F.collect_list("line").alias("drop"))
    names = [f"_k{i}" for i in range(len(docs.columns))]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.col(key).alias("_key"), mark.alias("_mark"))
    joined = inner.join(drops, (F.col("_key") == F.col("key")) & (F.col("_mark") == F.col("mark")), "left")
    body = names[docs.columns.index(text)]
    rest = [n for n in names if n != body]
    schema = T.StructType(
        [T.StructField("_text", T.StringType()), T.StructField("_lines", T.LongType()), T.StructField("_dropped", T.LongType())] + [inner.schema[n] for n in rest]
    )
    out = map_arrow(joined.select(body, "drop", *rest), _without, schema)
    back = [F.col("_text" if n == body else n).alias(c) for c, n in zip(docs.columns, names)]
    fresh = [F.col(c).alias(free_name(n, docs.columns)) for c, n in (("_lines", "n_lines"), ("_dropped", "n_dropped"))]
    return out.select(*back, *fresh)


ORACLE = r"""
with d as (
  select doc_id, text, string_split(text, chr(10)) as ls from documents where doc_id is not null
), l as (
  select doc_id, unnest(ls) as line, unnest(range(0, len(ls))) as no from d
), w as (
  select doc_id, no, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: case when regexp_matches(x, '[0-9]') then null else x end) as w from l
), leafed as materialized (
  select doc_id, no, w, len(w)::varchar || ':' || coalesce(w[1], '0') || ' ' || coalesce(w[2], '0') as leaf from w where len(w) > 0
), tokens as materialized (
  select doc_id, no, leaf, unnest(w) as token, unnest(range(0, len(w))) as place from leafed
), constants as materialized (
  select leaf, place, token from tokens where token is not null group by all having count(distinct doc_id) >= 8
), forms as (
  select doc_id, no, leaf, count(token) as words, count(c) as n, string_agg(coalesce(c, '0'), ' ' order by place) as form
  from (select t.*, c.token as c from tokens t left join constants c on t.leaf = c.leaf and t.place = c.place and t.token = c.token) group by all
), templates as materialized (
  select * from forms where n > 0 and n >= 0.6::double * words
), recurring as (
  select leaf, form, min(doc_id) as head from templates group by all having count(distinct doc_id) >= 8
), gone as materialized (
  select doc_id, no from templates join recurring using (leaf, form) where doc_id <> head
), kept as (
  select doc_id, string_agg(line, chr(10) order by no) as t from l anti join gone using (doc_id, no) group by doc_id
), lost as (
  select doc_id, count(*) as n from gone group by doc_id
)
select cast(d.doc_id as bigint) as doc_id, coalesce(len(ls), 0) as n_lines, coalesce(lost.n, 0) as n_dropped, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join kept using (doc_id) left join lost using (doc_id)
"""
