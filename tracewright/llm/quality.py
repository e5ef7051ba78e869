"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on statistics of labelled texts; each path from a root is a
conjunctive rule. A lasso logistic regression over the rules keeps few of them,
and what is kept is compiled into one Spark column expression over the
statistics. Fitting takes a bounded sample of labelled rows (``max_rows``); statistics and
scores are computed for every document from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.shared import free_name, map_arrow
from tracewright.llm.tokens import slices, word_hashes, words_of

STATS = (
    "log_words",
    "word_length",
    "upper",
    "capital_words",
    "digits",
    "marks",
    "odd_marks",
    "odd_words",
    "bars",
    "bangs",
    "stops",
    "commas",
    "distinct",
    "top_word",
    "repeats",
    "short_words",
    "words_per_line",
    "line_repeats",
)


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _bytes("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _bytes("0123456789")
_COMMON = _bytes(".,;:'\"-?()")
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK &= ~(_UPPER | _LOWER | _DIGIT)
_ODD = _MARK & ~_COMMON
_STOP, _COMMA, _BAR, _BANG, _LINE = (_bytes(c) for c in (".", ",", "|", "!", "\n"))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (upto[offsets[1:]] - upto[offsets[:-1]]).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of :data:`STATS` for each text; an empty text is all zeros."""
    w = words_of(texts)
    n, size, o = w.count.astype(float), np.diff(w.offsets).astype(float), w.offsets
    h, doc = word_hashes(w), w.doc
    per = lambda a, b: np.divide(a, b, out=np.zeros(len(n)), where=b > 0)
    count = lambda table: _per_text(table[w.data], o)
    by_word = lambda flags: np.bincount(doc, flags, minlength=len(n))
    upper, lower = count(_UPPER), count(_LOWER)
    odd = np.concatenate([[0], np.cumsum(_ODD[w.data], dtype=np.int64)])
    odd_word = (odd[w.end] - odd[w.start]) > 0
    capital = _UPPER[w.data[w.start]] if len(h) else np.zeros(0, bool)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    distinct, top = np.zeros(len(n)), np.zeros(len(n))
    for d in range(len(n)):
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        if hi > lo:
            s = np.sort(h[lo:hi])
            cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            distinct[d], top[d] = len(cut) - 1, np.diff(cut).max()
    lines, unique = _lines(w, o)
    return np.stack(
        [
            np.log1p(n),
            per(by_word((w.end - w.start).astype(float)), n),
            per(upper, upper + lower),
            per(by_word(capital.astype(float)), n),
            per(count(_DIGIT), size),
            per(count(_MARK), size),
            per(count(_ODD), size),
            per(by_word(odd_word.astype(float)), n),
            per(count(_BAR), n),
            per(count(_BANG), n),
            per(count(_STOP), n),
            per(count(_COMMA), n),
            per(distinct, n),
            per(top, n),
            per(by_word(same.astype(float)), n),
            per(by_word((w.end - w.start <= 3).astype(float)), n),
            per(n, lines),
            1 - per(unique, lines) * (lines > 0) - (lines == 0),
        ],
        axis=1,
    )


def _lines(w, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty lines of each text, and how many of them differ."""
    count, unique = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    data = w.data.tobytes()
    for d in range(len(offsets) - 1):
        some = [x for x in data[offsets[d] : offsets[d + 1]].split(b"\n") if x.strip()]
        count[d], unique[d] = len(some), len(set(some))
    return count, unique


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of the documents, and their statistics under ``_s_`` names, which columns kept must not have."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = [rows.schema[i] for i in range(len(keep))] + [T.StructField(f"_s_{s}", T.DoubleType()) for s in STATS]
    count = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                stats = statistics(part.column(count))
                columns = [part.column(i) for i in range(count)] + [pa.array(stats[:, i]) for i in range(len(STATS))]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:count] + [f"_s_{s}" for s in STATS])

    out = map_arrow(rows, run, T.StructType(fields))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[f"_s_{s}" for s in STATS])


@dataclass
class Rules:
    """A fitted ensemble: ``rules`` are lists of ``(statistic, above, threshold)``, all of which must hold."""

    bias: float
    rules: list[list[tuple[str, bool, float]]]
    weights: list[float]

    def score(self) -> Column:
        """Probability of label 1, over the columns of :func:`with_statistics`."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for stat, above, at in rule:
                c = F.col(f"_s_{stat}")
                holds = holds & ((c > at) if above else (c <= at))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-4, seed: int = 7) -> Rules:
    """Grow the trees, take their paths, and fit the lasso logistic weights."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1.0) / (len(y) + 2.0) if len(y) else 0.5
        return Rules(float(np.log(rate / (1 - rate))), [], [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 50))) for f in range(x.shape[1])]
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple, np.ndarray] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        some = rng.random(len(y)) < 0.5
        features = rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False)
        for path, holds, step in _tree(x, y - p, p * (1 - p) + 1e-6, some, features, cuts, depth):
            rules.setdefault(path, holds)
            if step is not None:
                margin[holds] += 0.3 * step
    paths = [r for r in rules if 0 < rules[r].sum() < len(y)]
    m = np.stack([rules[r] for r in paths], 1).astype(float) if paths else np.zeros((len(y), 0))
    weights, bias = _lasso(m, y.astype(float), penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    named = [[(STATS[f], bool(above), float(at)) for f, above, at in paths[i]] for i in kept]
    return Rules(float(bias), named, [float(weights[i]) for i in kept])


def _tree(x, gradient, hessian, some, features, cuts, depth, path=(), holds=None):
    """Paths of a regression tree: ``(conditions, rows, leaf value or None)``."""
    holds = np.ones(len(x), bool) if holds is None else holds
    rows = np.flatnonzero(holds & some)
    best = None
    if len(path) < depth and len(rows) >= 20:
        g, h = gradient[rows], hessian[rows]
        base = g.sum() ** 2 / (h.sum() + 1)
        for f in features:
            at = np.searchsorted(cuts[f], x[rows, f], side="left")  # values <= cuts[f][k] have at <= k
            gl = np.cumsum(np.bincount(at, g, len(cuts[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(at, h, len(cuts[f]) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
            k = int(np.argmax(gain))
            if best is None or gain[k] > best[0]:
                best = (gain[k], int(f), float(cuts[f][k]))
    if best is None or best[0] < 1e-3:
        if path:
            yield path, holds, gradient[rows].sum() / (hessian[rows].sum() + 1) if len(rows) else 0.0
        return
    if path:
        yield path, holds, None
    _, f, at = best
    for above in (False, True):
        side = holds & ((x[:, f] > at) == above)
        yield from _tree(x, gradient, hessian, some, features, cuts, depth, (*path, (f, above, at)), side)


def _lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient steps."""
    n, k = m.shape
    scale = max(1e-9, 0.25 * _norm(m) / n)
    w, b, z, zb, t = np.zeros(k), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(k), 0.0, 1.0
    zb = b
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(m @ z + zb))) - y
        step = z - m.T @ r / n / scale
        new = np.sign(step) * np.maximum(np.abs(step) - penalty / scale, 0)
        nb = zb - r.mean() / scale
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, b


def _norm(m: np.ndarray) -> float:
    """The largest eigenvalue of ``m' m`` with a column of ones beside it, by power steps."""
    v = np.ones(m.shape[1] + 1)
    for _ in range(20):
        u = m @ v[:-1] + v[-1]
        v = np.concatenate([m.T @ u, [u.sum()]])
        size = np.linalg.norm(v)
        v /= size
    return float(size)


def held_out(key: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the key as text is 2 modulo 4."""
    return F.crc32(key.cast("string")) % 4 == 2


def fit_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", label_key: str = "doc_id", max_rows: int = 12_000
) -> Rules:
    """Fit on at most ``max_rows`` labelled rows, in the order of an MD5 of their keys, held-out rows left out.

    Null labels and keys are left out; of several labels of a key the mean counts, rounded, and of
    several texts one (by a hash).
    """
    known = labels.select(F.col(label_key).alias("_key"), F.col(label).cast("double").alias("_label")).where(F.col("_key").isNotNull() & F.col("_label").isNotNull())
    known = known.where(~held_out(F.col("_key"))).groupBy("_key").agg(F.round(F.avg("_label")).alias("_label"))
    sample = known.orderBy(F.md5(F.col("_key").cast("string"))).limit(max_rows)
    # The sample is bounded by max_rows, whatever the table's size.
    rows = docs.join(F.broadcast(sample), docs[key] == sample["_key"]).select(docs[key].alias("_id"), docs[text].alias("_body"), "_label")
    rows = rows.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_body").alias("h"), F.col("_body").alias("body"))).alias("x")).select("_id", "_label", F.col("x.body").alias("_body"))
    found = with_statistics(rows, "_body", ["_id", "_label"]).toPandas()
    found = found.sort_values(["_id", *[f"_s_{s}" for s in STATS]], kind="stable")
    return fit_rules(found[[f"_s_{s}" for s in STATS]].to_numpy(float), found["_label"].to_numpy(float))


def score_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7, keep: list[str] | None = None, rules: Rules | None = None, **fit
) -> DataFrame:
    """``keep`` columns (the key) of every document with ``held_out``, ``score`` and ``predicted``.

    ``score`` (0 to 1) is higher where label 1 is likelier; ``predicted`` is 1 from
    ``threshold`` on. Null and empty texts are scored by their statistics, which are all 0.
    Without labels of both kinds the score is the labels' rate (0.5 without any).
    Repeated rows are scored alike. An empty table gives an empty result; columns other
    than key and text are never inputs of the score. A null key is scored like any other, and is not held out.
    """
    rules = rules or fit_quality(docs, labels, key, text, **fit)
    keep = [key] if keep is None else keep
    names = [f"_c{i}" for i in range(len(keep) + 1)]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip([key, *keep], names)], F.col(text).alias("_text"))
    scored = with_statistics(rows, "_text", names).withColumn("_score", rules.score())
    out = [F.coalesce(held_out(F.col("_c0")), F.lit(False)), F.col("_score"), (F.col("_score") >= threshold).cast("int")]
    fresh = [c.alias(free_name(n, keep)) for c, n in zip(out, ("held_out", "score", "predicted"))]
    return scored.select(*[F.col(n).alias(c) for c, n in zip(keep, names[1:])], *fresh)


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7, **fit) -> DataFrame:
    """The documents, all columns whatever their names, whose predicted label is 1.

    Null and empty texts are judged by their statistics, equal rows alike; an empty table
    gives an empty result.
    """
    rules = fit_quality(docs, labels, key, text, **fit)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    kept = with_statistics(rows, names[docs.columns.index(text)]).where(rules.score() >= threshold)
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
