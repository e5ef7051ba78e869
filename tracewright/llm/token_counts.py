"""Token counts at every prefix of a text, by dynamic programming over byte-level BPE.

The last token of a prefix's encoding decides the rest: the encoding of the first *i* bytes is that of
the first *i - len(t)* bytes and *t*, where *t* is the one token that ends there and may stand behind the
last token before it. Two tokens may stand side by side if encoding their bytes together gives just
these two. So one pass over the tokens that end at each byte (an Aho-Corasick automaton finds them)
gives ``count[i] = count[i - len(t)] + 1`` for all prefixes, in time that follows the length.

Texts are split into pieces as the tokenizer splits them, and tokens do not cross pieces; each
distinct piece is solved once a worker. Two things are special in a prefix that ends inside a text: a white space that
ends it joins the white space before, and half a contraction (``'r`` of ``'re``) is two pieces.

A null text is empty: no bytes, no tokens. Rows do not depend on each other, so repeated rows and keys, and null keys, are
counted like all others; all columns are passed on, and added ones get another name where one is taken.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.shared import free_name, ship_package, text_of

#: How the tokenizer splits texts into pieces, and contractions of which a half is no piece.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HALVED = ("'re", "'ve", "'ll")

#: Code points from here on are split by the library itself.
_KNOWN = 0x20000
#: Distinct pieces that a worker keeps, and the longest of them in characters.
_KEPT, _KEPT_LENGTH = 1_000_000, 32
#: Longer texts are not held as lists of pieces.
_LONG = 1 << 20


def _alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if it is printable in Latin-1, else the next one from 256."""
    out, spare = {}, 256
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 255 and b != 173
        out[chr(b if shown else spare)] = b
        spare += not shown
    return out


def _odd(splitter) -> str:
    """Characters, as ranges of a set, whose class in the library's Unicode tables is not that of the regular expressions used here."""
    import regex

    pieces, points = regex.compile(PIECES), [c for c in range(_KNOWN) if not 0xD800 <= c < 0xE000]
    odd: set[int] = set()
    for beside in "x1.":  # a letter, digit or symbol joins its neighbour of the same class; what joins none is white space
        text = "".join(beside + chr(c) for c in points)
        theirs = {a for _, (a, _) in splitter.pre_tokenize_str(text)}
        ours = {m.start() for m in pieces.finditer(text)}
        odd |= {points[a // 2] for a in theirs ^ ours}
    runs: list[list[int]] = []
    for c in sorted(odd):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + f"\\U{_KNOWN:08x}-\\U0010ffff"


@lru_cache(maxsize=4)
def load_tokenizer(path: str) -> bytes:
    """What workers need of a tokenizer file, about 2 MB whatever the input. Only byte-level BPE with plain added tokens is taken."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec["normalizer"]
    odd_model = model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
    if not plain or odd_model or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    added = [t["content"] for t in spec["added_tokens"]]
    return json.dumps({"vocab": model["vocab"], "merges": merges, "added": added, "odd": _odd(Tokenizer.from_file(path).pre_tokenizer)}).encode()


class _Totals(dict):
    """Pieces and their numbers of tokens, solved when first met."""

    def __init__(self, solve):
        self.solve = solve

    def __missing__(self, piece: str) -> int:
        n = self.solve(piece)[-1]
        if len(piece) <= _KEPT_LENGTH:
            self[piece] = n
        return n


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes."""

    def __init__(self, spec: bytes):
        import re

        import ahocorasick
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        said = json.loads(spec)
        byte = _alphabet()
        ids = {bytes(byte[c] for c in token): i for token, i in said["vocab"].items() if token not in said["added"]}
        self.token = {i: b for b, i in ids.items()}
        self.rank, self.made = {}, {}
        for n, (a, b) in enumerate(said["merges"]):
            left, right = (bytes(byte[c] for c in x) for x in (a, b))
            self.rank[ids[left], ids[right]] = (n, ids[left + right])
            self.made.setdefault(ids[left + right], (n, ids[left], ids[right]))
        self.single = [ids.get(bytes([b]), -1) for b in range(256)]
        self.ends = ahocorasick.Automaton()
        for b, i in ids.items():
            self.ends.add_word(b.decode("latin-1"), (i, len(b)))
        self.ends.make_automaton()
        self.widest = max(map(len, [*ids, *said["added"]]))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PIECES)
        self.odd = re.compile(f"[{said['odd']}]")
        self.special = re.compile("|".join(re.escape(x) for x in sorted(said["added"], key=len, reverse=True))) if said["added"] else None
        self.splitter = ByteLevel(add_prefix_space=False)
        self.totals = _Totals(self.solve)

    # --- one piece

    def _encode(self, data: bytes) -> list[int]:
        """Plain BPE: of all neighbours the first of lowest rank is merged, again and again."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def _begins(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as this token."""
        known = self.pairs.get((-1, token))
        if known is None:
            known = self.pairs[-1, token] = self._encode(self.token[token]) == [token]
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side.

        Going back in time, the later of the two merges that made them is undone, and what then meets at the
        border must not have had a merge of its own before that. Of equal merges, the left one comes first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > _KEPT:
                self.pairs.clear()
            a, b, until, never = left, right, len(self.rank), (-1, -1, -1)
            while True:
                meet = self.rank.get((a, b))
                if known := not (meet and meet[0] < until):
                    (i, _, inner), (j, outer, _) = self.made.get(a, never), self.made.get(b, never)
                    if i < 0 and j < 0:
                        break
                    if i > j:
                        until, a = i, inner
                    else:
                        until, b = j + 1, outer
                else:
                    break
            self.pairs[left, right] = known
        return known

    def solve(self, piece: str) -> list[int]:
        """The token counts of a piece's prefixes of 0, 1, ... characters, as pieces of their own."""
        data = piece.encode()
        count, last = [0] * (len(data) + 1), [-1] * (len(data) + 1)
        done, may_follow, begins = 0, self._may_follow, self._begins
        for end, (token, size) in self.ends.iter(data.decode("latin-1")):
            at = end + 1
            if at > done:
                before = at - size
                if may_follow(last[before], token) if before else begins(token):
                    count[at], last[at], done = count[before] + 1, token, at
        if len(data) == len(piece):
            return count
        return [0, *(n for n, b in zip(count[1:], [*data[1:], 0]) if b & 0xC0 != 0x80)]

    # --- texts without added tokens

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.odd.search(text):
            return self.pieces.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _count(self, text: str) -> int:
        if len(self.totals) > _KEPT:
            self.totals.clear()
        if len(text) > _LONG and (text.isascii() or not self.odd.search(text)):
            return sum(self.totals[m[0]] for m in self.pieces.finditer(text))
        return sum(map(self.totals.__getitem__, self.split(text)))

    def _prefixes(self, text: str) -> list[int]:
        out, base, before = [0], 0, None  # before: the piece before, and the count before it, if it is white space
        for piece in self.split(text):
            inner = self.solve(piece)
            mine = [base + n for n in inner[1:]]
            if piece in HALVED:
                mine[1] = base + self.totals[piece[0]] + self.totals[piece[1]]
            blank = self._blank(piece[0])
            if before and blank:
                mine[0] = before[1] + self.totals[before[0] + piece[0]]
            out += mine
            before = (piece, base) if blank and all(map(self._blank, piece)) else None
            base += inner[-1]
        return out

    def _blank(self, c: str) -> bool:
        return len(self.split(f".{c}.")) == 3 and len(self.split(f"x{c}x")) == 3 and len(self.split(f"1{c}1")) == 3 if c != " " else True

    # --- whole texts

    def count(self, text: str) -> int:
        """The number of tokens of a text; strings of added tokens are one each."""
        if self.special is None or not self.special.search(text):
            return self._count(text)
        parts = self.special.split(text)
        return sum(map(self._count, parts)) + len(parts) - 1

    def prefixes(self, text: str) -> list[int]:
        """The number of tokens of the first 0, 1, ... characters, each as if it were a text of its own."""
        if self.special is None:
            return self._prefixes(text)
        out, at = [0], 0
        for m in self.special.finditer(text):
            part = text[at : m.start()]
            base = out[-1]
            out += [base + n for n in self._prefixes(part)[1:]]
            # Until it is complete, the added token's string is more text behind the last piece.
            pieces = self.split(part)
            tail = pieces[-1] if pieces else ""
            base = out[-1] - (self.totals[tail] if tail else 0)
            out += [base + self._count(tail + text[m.start() : k]) for k in range(m.start() + 1, m.end())]
            out.append(out[m.start()] + 1)
            at = m.end()
        base = out[-1]
        return out + [base + n for n in self._prefixes(text[at:])[1:]]

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """A text's number of tokens, and the number of characters of its longest prefix with at most ``limit`` tokens."""
        if len(text) > _LONG:
            total = self.count(text)
            return total, len(text) if total <= limit else self._longest(text, limit)
        if self.special is not None and self.special.search(text):
            counts = self.prefixes(text)
            return counts[-1], max(k for k, n in enumerate(counts) if n <= limit)
        if len(self.totals) > _KEPT:
            self.totals.clear()
        pieces = self.split(text)
        each = list(map(self.totals.__getitem__, pieces))
        total = sum(each)
        return total, len(text) if total <= limit else self._cut(pieces, each, limit)

    def _cut(self, pieces: list[str], each: list[int], limit: int) -> int:
        """The longest prefix within the limit, of a text without added tokens that is beyond it."""
        sums = [0]
        for n in accumulate(each):
            sums.append(n)
            if n > limit:
                break
        # White space at the end of a prefix joins that before it, so the pieces beside the first one beyond are looked at, too.
        over = len(sums) - 2
        lo, hi = max(over - 1, 0), over + 2
        near = self._prefixes("".join(pieces[lo:hi]))
        return sum(map(len, pieces[:lo])) + max(k for k, n in enumerate(near) if sums[lo] + n <= limit)

    def _longest(self, text: str, limit: int) -> int:
        """The same for a very long text: no token has more than so many characters, so no longer prefix can be within."""
        counts = self.prefixes(text[: limit * self.widest])
        return max(k for k, n in enumerate(counts) if n <= limit)


_COUNTERS: dict[str, PrefixCounter] = {}


def _counter(spec: bytes) -> PrefixCounter:
    """One for each worker and tokenizer."""
    name = hashlib.sha256(spec).hexdigest()
    if name not in _COUNTERS:
        _COUNTERS[name] = PrefixCounter(spec)
    return _COUNTERS[name]


def _udf(spark: SparkSession, path: str, kind: T.DataType, arrow: pa.DataType, answer):
    """``answer(counter, text)`` of each text, in the workers; the tokenizer is broadcast."""
    ship_package(spark)
    spec = spark.sparkContext.broadcast(load_tokenizer(path))

    def run(texts: pa.Array) -> pa.Array:
        counter = _counter(spec.value)
        return pa.array([answer(counter, t.as_py() or "") for t in texts], arrow)

    return F.arrow_udf(run, kind)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """The documents with ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` and ``within``.

    ``within`` is the number of characters of the longest prefix with at most ``limit`` tokens: the text to keep
    where it has to be cut. ``tokenizer`` is the path of a byte-level BPE file, on the driver. Nothing is shuffled.
    """
    names = []
    for n in ("n_bytes", "n_tokens", "over_limit", "within", "_counted"):
        names.append(free_name(n, [*docs.columns, *names]))
    n_bytes, n_tokens, over, within, counted = names

    def answer(counter: PrefixCounter, body: str) -> dict:
        return dict(zip(("n", "within"), counter.measure(body, limit)))

    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("within", T.LongType())])
    solved = _udf(docs.sparkSession, tokenizer, kind, pa.struct([("n", pa.int64()), ("within", pa.int64())]), answer)
    out = docs.withColumn(counted, solved(text_of(f"`{text}`")))
    return (
        out.withColumn(n_bytes, F.octet_length(text_of(f"`{text}`")).cast("long"))
        .withColumn(n_tokens, F.col(f"`{counted}`.n"))
        .withColumn(over, F.col(f"`{counted}`.n") > limit)
        .withColumn(within, F.col(f"`{counted}`.within"))
        .drop(counted)
    )


def prefix_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The documents with ``prefix_tokens``: the token counts of the first 0, 1, ... characters, each exact.

    Written once, it answers :func:`tokens_of_prefix` and :func:`longest_prefix` for any length and budget.
    """
    solved = _udf(docs.sparkSession, tokenizer, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), lambda counter, body: counter.prefixes(body))
    return docs.withColumn(free_name("prefix_tokens", docs.columns), solved(text_of(f"`{text}`")))


def tokens_of_prefix(counts: Column, characters: Column) -> Column:
    """How many tokens the first so many characters have; of all, if there are fewer."""
    return F.get(counts, F.least(F.greatest(characters, F.lit(0)), F.size(counts) - 1))


def longest_prefix(counts: Column, budget: Column) -> Column:
    """How many characters the longest prefix within a budget of tokens has; null if the budget is negative."""
    fits = F.transform(counts, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits)
