"""Masked pseudo-likelihood of documents under a network trained on the corpus.

The network predicts a word from the two words on either side: four embeddings, one
table for each place, are added up and squashed to a hidden vector, and a
two-level softmax gives the probability of the word's class (group, then class within
the group); the word's probability within its class comes from exact counts. A document's score
is the sum of the logarithms of all its words' probabilities, each word hidden in its turn.

* Classes come from word counts over the whole corpus, kept in ``1 << 16`` hashed
  counters: the most frequent counters are classes of their own, all others share the
  remaining classes evenly.
* A word with count *n* has the probability *n / (N + S + 0.01)* in its class, where *N* words
  are, *S* of them of a count of one. The rest of the mass is dealt evenly to one more unseen word
  than the class has words. Counts are of 64-bit hashes, in a table that grows with the corpus; the
  most frequent words, at most ``HEAD``, travel to the tasks, all others are joined by hash.
* Training is in numpy, on all documents: in each round every partition starts from
  the same parameters, trains on its own masked positions (a hash deals all positions to
  ``ceil(1 / mask)`` rounds, so that each is masked, and a target, in exactly one), and the
  parameters are averaged, weighted by positions. What a round gathers are parameters of a fixed size from every
  partition, added up in Spark in slices. So parameters depend on how rows are dealt to partitions: the
  same files read in the same way give the same scores, other layouts slightly different ones.
* Parameters travel to the tasks with the function; they take about 0.5 MB.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import durable, map_arrow, parallelism
from tracewright.llm.tokens import mix, slices, word_hashes, words_of

_U = np.uint64
COUNTERS = 1 << 16
GROUPS = 32
CLASSES = GROUPS * GROUPS
WINDOW = 2
HEAD = 1 << 16
UNSEEN = 0.01
_PLACES = [k for k in range(-WINDOW, WINDOW + 1) if k]
_SLICE = 8192
_FIXED = float(1 << 32)  # logarithms are added up as integers, in whatever order


@dataclass
class Network:
    """``place``: (4, classes + 1, hidden); the last row stands for the text's ends."""

    place: np.ndarray
    bias: np.ndarray  # (hidden,)
    group: np.ndarray  # (hidden, groups)
    group_bias: np.ndarray
    inner: np.ndarray  # (groups, hidden, groups)
    inner_bias: np.ndarray  # (groups, groups)

    NAMES = ("place", "bias", "group", "group_bias", "inner", "inner_bias")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def like(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for n in self.NAMES:
            a = getattr(self, n)
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)


def fresh(counts: np.ndarray, hidden: int, seed: int) -> Network:
    """Small random weights, and output biases that give the classes' own frequencies."""
    rng = np.random.default_rng(seed)
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    c = counts.reshape(GROUPS, GROUPS).astype(float) + 0.5
    return Network(
        small(len(_PLACES), CLASSES + 1, hidden),
        np.zeros(hidden, np.float32),
        small(hidden, GROUPS),
        np.log(c.sum(1) / c.sum()).astype(np.float32),
        small(GROUPS, hidden, GROUPS),
        np.log(c / c.sum(1, keepdims=True)).astype(np.float32),
    )


def class_table(counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each counter, and the classes' counts."""
    own = CLASSES // 2
    order = np.lexsort((np.arange(COUNTERS), -counters))
    table = np.empty(COUNTERS, np.int16)
    table[order[:own]] = np.arange(own)
    # Dealt in turns by frequency, so the shared classes weigh about the same.
    table[order[own:]] = own + np.arange(COUNTERS - own) % (CLASSES - own)
    # Groups mix frequent and rare classes.
    table = (table % GROUPS) * GROUPS + table // GROUPS
    return table.astype(np.int16), np.bincount(table, counters, CLASSES)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> _U(48)).astype(np.int64)


def _contexts(w, classes: np.ndarray) -> np.ndarray:
    """Classes at the four places around each word."""
    n = len(classes)
    doc = w.doc
    out = np.full((len(_PLACES), n), CLASSES, np.int64)
    for i, k in enumerate(_PLACES):
        lo, hi = max(0, -k), min(n, n - k)
        if lo < hi:
            np.copyto(out[i, lo:hi], classes[lo + k : hi + k], where=doc[lo:hi] == doc[lo + k : hi + k])
    return out


def _hidden(net: Network, context: np.ndarray) -> np.ndarray:
    total = net.place[0].take(context[0], axis=0)
    for i in range(1, len(_PLACES)):
        total += net.place[i].take(context[i], axis=0)
    total += net.bias
    return np.tanh(total, out=total)


_ONES = np.ones((GROUPS, 1), np.float32)


def _lowered(z: np.ndarray) -> np.ndarray:
    """Rows less one value for all, in place, so that exponentials neither overflow nor vanish; less their own maxima where values are far apart."""
    top = z.max()
    z -= top if top - z.min() < 60 else z.max(1, keepdims=True)  # maxima of short rows are slow
    return z


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of rows, up to a factor for each row, in place, and their sums."""
    np.exp(_lowered(z), out=z)
    return z, z @ _ONES


def _sorted(values: np.ndarray) -> np.ndarray:
    """Where classes are in their order, equal ones as they come; 16 bits are sorted by radix."""
    return np.argsort(values.astype(np.int16), kind="stable")


def _inner(inner: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Products of rows, which are in the order of their groups, with their groups' weights, and where each group begins."""
    at = np.searchsorted(g, np.arange(GROUPS + 1)).tolist()
    z = np.empty((len(h), GROUPS), np.result_type(h, inner))
    for i, (lo, hi) in enumerate(zip(at, at[1:])):
        if lo < hi:
            np.dot(h[lo:hi], inner[i], out=z[lo:hi])
    return z, at


def log_probabilities(net: Network, context: np.ndarray, classes: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    out = np.empty(len(classes))
    # Hidden values are within 1, so this bounds what exponentials are taken of. Rows do not depend on those beside them: equal texts score alike.
    far = max((np.abs(w).sum(-2) + np.abs(b)).max() for w, b in ((net.group, net.group_bias), (net.inner, net.inner_bias))) > 60
    for lo in range(0, len(classes), step):
        order = _sorted(classes[lo : lo + step])  # classes of a group follow each other
        c = classes[lo : lo + step][order]
        h = _hidden(net, context[:, lo : lo + step].take(order, axis=1))
        g, k, row = c // GROUPS, c % GROUPS, np.arange(len(c))
        score = np.zeros(len(c))
        for z, b, j in ((h @ net.group, net.group_bias, g), (_inner(net.inner, h, g)[0], net.inner_bias.take(g, axis=0), k)):
            z += b
            if far:
                z -= z.max(1, keepdims=True)
            picked = z[row, j].astype(float)
            score += picked - np.log(np.einsum("ij->i", np.exp(z, out=z)).astype(float))
        out[lo : lo + step][order] = score
    return out


class Trainer:
    """Steps of Adagrad on mini-batches.

    Biases are kept as rows below their weights, so that products give their values and gradients as well; ``net`` has views of both.
    """

    def __init__(self, net: Network, rate: float):
        own = net.like(net.flat())
        self.group, self.inner = np.vstack([own.group, own.group_bias]), np.concatenate([own.inner, own.inner_bias[:, None]], axis=1)
        self.net = Network(own.place, own.bias, self.group[:-1], self.group[-1], self.inner[:, :-1], self.inner[:, -1])
        self.rate = rate
        self.seen = {n: np.full(getattr(net, n).shape, 0.1, np.float32) for n in net.NAMES}
        self.cell = np.arange(own.place[0].size).reshape(own.place[0].shape)  # numbers of one place's weights

    def _move(self, name: str, gradient: np.ndarray, at=()) -> None:
        weights, seen = getattr(self.net, name)[at], self.seen[name][at]
        step = gradient * gradient
        seen += step
        np.sqrt(seen, out=step)
        np.divide(gradient, step, out=step)
        step *= self.rate
        weights -= step

    def step(self, context: np.ndarray, classes: np.ndarray) -> None:
        net, n = self.net, len(classes)
        order = _sorted(classes)  # rows of a group are then a slice
        context, classes = context.take(order, axis=1), classes.take(order)
        hidden = _hidden(net, context)
        h = np.ones((n, len(net.bias) + 1), np.float32)  # with a column for the biases
        h[:, :-1] = hidden
        g, k, row = classes // GROUPS, classes % GROUPS, np.arange(n)
        dz, total = _exp(h @ self.group)
        dz /= total * n
        dz[row, g] -= np.float32(1 / n)
        d, at = _inner(self.inner, h, g)
        d, total = _exp(d)
        d /= total * n
        d[row, k] -= np.float32(1 / n)
        dh, d_inner = np.empty_like(hidden), np.zeros_like(self.inner)
        for i, (lo, hi) in enumerate(zip(at, at[1:])):
            if lo < hi:
                some = d[lo:hi]
                np.dot(some, net.inner[i].T, out=dh[lo:hi])
                np.dot(h[lo:hi].T, some, out=d_inner[i])
        dh += dz @ net.group.T
        d_group = h.T @ dz
        self._move("inner", d_inner[:, :-1])
        self._move("inner_bias", d_inner[:, -1])
        self._move("group", d_group[:-1])
        self._move("group_bias", d_group[-1])
        da = dh * (1 - hidden * hidden)
        self._move("bias", np.ones(n, np.float32) @ da)
        # Gradients of contexts are added up weight by weight, without a sort; weights without any stay as they are.
        values = da.ravel().astype(float)
        for i in range(len(_PLACES)):
            d_place = np.bincount(self.cell.take(context[i], axis=0).ravel(), values, self.cell.size)
            self._move("place", d_place.astype(np.float32).reshape(self.cell.shape), i)


def _targets(w, h: np.ndarray, share: int, shares: int) -> np.ndarray:
    """The positions that are masked in round ``share`` of ``shares``."""
    # By a hash of word and place in the text: no order of rows matters.
    place = np.arange(len(h)) - np.repeat(w.first[:-1], w.count)
    draw = mix(h + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return np.flatnonzero(draw % _U(shares) == _U(share))


def _trainer(net: Network, table: np.ndarray, share: int, shares: int, rate: float, batch_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer, done = Trainer(net, rate), 0
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column("text"))
                h = word_hashes(w)
                classes = table[_counter(h)].astype(np.int64)
                chosen = _targets(w, h, share, shares)
                if not len(chosen):
                    continue
                context = _contexts(w, classes)
                for lo in range(0, len(chosen), batch_size):
                    some = chosen[lo : lo + batch_size]
                    trainer.step(context.take(some, axis=1), classes.take(some))
                done += len(chosen)
        if done:
            flat, me = trainer.net.flat().astype(np.float32).astype(float) * done, TaskContext.get().partitionId()
            parts = [flat[i : i + _SLICE].tobytes() for i in range(0, len(flat), _SLICE)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([me] * n, pa.int64()), pa.array([done] * n, pa.int64()), pa.array(parts, pa.binary())], names=["part", "who", "n", "body"]
            )

    return run


#: So many partitions' slices are added one after another, on each of two levels.
FAN_IN = 1024
SLICES = "part int, who long, n long, body binary"


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of consecutive rows with one part and ``who``, whose bodies are weighted already; only the running sum is held."""
    now, total, weight = None, None, 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "who", "n", "body"])

    for x in batches:
        for part, who, n, body in zip(*(x.column(i) for i in range(4))):
            key, values = (part.as_py(), who.as_py()), np.frombuffer(body.as_py(), float)
            if key != now:
                if now is not None:
                    yield row()
                now, total, weight = key, np.zeros(len(values)), 0
            total, weight = total + values, weight + n.as_py()
    if now is not None:
        yield row()


def add_slices(sent: DataFrame) -> DataFrame:
    """``(part, who, n, body)``: the sums of each slice over all partitions (``who``), in their order.

    Partitions are added in groups of :data:`FAN_IN`, then those groups: one row of each slice is left for up to a million partitions.
    A group's slices stream through one task, which holds the running sum alone.
    """
    n = parallelism(sent.sparkSession)
    for _ in range(2):
        # By group first, then in the order of those who sent: sums do not depend on how rows arrive.
        grouped = sent.withColumn("group", F.floor(F.col("who") / FAN_IN))
        dealt = grouped.repartition(n, "part", "group").sortWithinPartitions("part", "group", "who")
        sent = map_arrow(dealt.select("part", F.col("group").alias("who"), "n", "body"), _add, SLICES)
    return sent


def train(
    docs: DataFrame, text: str = "text", hidden: int = 24, mask: float = 0.5, rate: float = 0.3, batch_size: int = 1024, seed: int = 11, counts: DataFrame | None = None
) -> tuple[Network, np.ndarray]:
    """The network and the table of classes, from all positions of all documents; ``counts`` are those of :func:`count_words`, if they are there."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = count_words(docs, text) if counts is None else counts
    by_counter = counts.groupBy(F.shiftrightunsigned("h", 64 - COUNTERS.bit_length() + 1).alias("counter")).agg(F.sum("n").alias("n")).toPandas()  # at most COUNTERS rows
    counters = np.zeros(COUNTERS, np.int64)
    counters[by_counter["counter"].to_numpy(np.int64)] = by_counter["n"].to_numpy(np.int64)
    table, by_class = class_table(counters)
    net = fresh(by_class, hidden, seed)
    rounds = math.ceil(1 / mask)
    for r in range(rounds):
        sent = map_arrow(rows, _trainer(net, table, r, rounds, rate, batch_size), SLICES)
        sums: dict[int, list] = {}  # one network
        for x in sorted(add_slices(sent).collect(), key=lambda x: (x["part"], x["who"])):
            sums.setdefault(x["part"], []).append((np.frombuffer(x["body"], float), x["n"]))
        if sums:
            mean = [sum(b for b, _ in some) / sum(n for _, n in some) for some in sums.values()]
            net = net.like(np.concatenate(mean).astype(np.float32))
    return net, table


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h, n = np.unique(word_hashes(words_of(part.column("text"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(h, n)``: how often each word is in the corpus, by its hash."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    return durable(map_arrow(rows, _words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))


@dataclass
class Inside:
    """Logarithms for words in their classes; a word's is ``log(n) - below``, or ``unseen - below`` without a count."""

    below: np.ndarray  # of classes
    unseen: np.ndarray  # of classes
    head: np.ndarray  # hashes of the most frequent words, in order
    head_log: np.ndarray


def word_model(counts: DataFrame, table: np.ndarray) -> Inside:
    counter = F.shiftrightunsigned("h", 48).alias("counter")
    sums = counts.groupBy(counter).agg(F.sum("n").alias("n"), F.count("*").alias("words"), F.count_if(F.col("n") == 1).alias("once")).toPandas()  # at most COUNTERS rows
    at = table[sums["counter"].to_numpy(np.int64)]
    n, words, once = (np.bincount(at, sums[c].to_numpy(float), CLASSES) for c in ("n", "words", "once"))
    # By a histogram of counts: a sort with a limit sends the driver rows of every partition.
    step = F.floor(F.log2("n") * 16)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).toPandas().sort_values("step", ascending=False)
    fit = steps["step"][steps["words"].cumsum() <= HEAD]
    top = counts.where(step >= int(fit.min()) if len(fit) else F.lit(False)).toPandas()  # at most HEAD rows
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Inside(np.log(n + once + UNSEEN), np.log((once + UNSEEN) / (words + 1)), h[order], np.log(top["n"].to_numpy(float))[order])


def _find(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the hashes are, and which of them are there."""
    if not len(sorted_hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == h


def _lifts(inside: Inside, table: np.ndarray):
    """By how much a word's count puts it above an unseen one, for words that tasks do not have at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            tail = ~_find(inside.head, h)[1]
            lift = np.log(n[tail]) - inside.unseen[table[_counter(h[tail])]]
            yield pa.RecordBatch.from_arrays([pa.array(h[tail].view(np.int64)), pa.array(np.rint(lift * _FIXED).astype(np.int64))], names=["h", "lift"])

    return run


def _scorer(net: Network, table: np.ndarray, inside: Inside):
    """Scores in which all words but the most frequent are unseen in their classes, and those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column("text"))
                h = word_hashes(w)
                classes = table[_counter(h)].astype(np.int64)
                lp = log_probabilities(net, _contexts(w, classes), classes) - inside.below[classes]
                at, known = _find(inside.head, h)
                lp += inside.unseen[classes] if not len(inside.head) else np.where(known, inside.head_log[at], inside.unseen[classes])
                upto = np.concatenate([[0.0], np.cumsum(lp)])
                tails = np.concatenate([[0], np.cumsum(~known)])[w.first]
                tail = pa.ListArray.from_arrays(pa.array(tails, pa.int32()), pa.array(h[~known].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(w.count, pa.int64()), pa.array(upto[w.first[1:]] - upto[w.first[:-1]]), tail], names=["key", "n_tokens", "score", "tail"]
                )

    return run


def score_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: tuple[Network, np.ndarray] | None = None, counts: DataFrame | None = None, **options
) -> DataFrame:
    """``(key, n_tokens, log_likelihood, mean_log_likelihood)`` for every document.

    ``log_likelihood`` sums the log-probabilities of all words (separated by
    blanks) given the words around them; the mean is over words, and null without
    any. Null and empty texts have no words and a sum of 0. Repeated rows are
    scored alike. The model is trained on all documents unless given, and words are counted
    in them unless ``counts`` (see :func:`count_words`) are given. An empty
    table gives an empty result; other columns are not looked at. A null key stays null, and
    its row is scored like all others.
    """
    counts = count_words(docs, text) if counts is None else counts
    net, table = model or train(docs, text, counts=counts, **options)
    inside = word_model(counts, table)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = map_arrow(rows, _scorer(net, table, inside), f"key {kind}, n_tokens long, score double, tail array<long>")
    out = durable(out.withColumn("row", F.monotonically_increasing_id()))  # rows keep their numbers from here
    lifts = map_arrow(counts.select("h", "n"), _lifts(inside, table), "h long, lift long")
    tails = out.select("row", F.explode("tail").alias("h")).join(lifts, "h").groupBy("row").agg(F.sum("lift").alias("lift"))
    out = out.drop("tail").join(tails, "row", "left")
    out = out.withColumn("log_likelihood", F.col("score") + F.coalesce(F.col("lift") / F.lit(_FIXED), F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select(F.col("key").alias(key), "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))
