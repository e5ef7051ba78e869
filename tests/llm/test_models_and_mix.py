import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import LONG, corpus, empty, frame, words
from tracewright.llm import lm_score, mixing, quality

# --- mixing -----------------------------------------------------------------------------


def brute_targets(sizes, share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = budget - sum(most * sizes[s] for s in full)
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in order}
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([3, 50, 1000, rng.randint(1, 10_000)]) for s in [None, "", "A", "b", "é", "zz", "𝄞", "～"][: rng.randint(1, 8)]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix(spark):
    texts = [t if t is None or len(t) < 10_000 else "word " * 400 for t in corpus(400, 8)]
    df = frame(spark, texts)
    got = mixing.mix_sources(df, buckets=16).collect()
    sizes = {}
    for r in got:
        assert r.size == len(words(texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size and r.copies in (0, 1, 2)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes)
    biggest = max(r.size for r in got)
    for s, t in want.items():
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(t) and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - t) <= biggest
    again = mixing.mix_sources(df.repartition(5), buckets=16)
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in again.collect())


def test_mix_edges(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert [r.taken for r in mixing.mix_sources(frame(spark, [None, " "])).collect()] == [0, 0]
    twice = mixing.mix_sources(frame(spark, ["a b", "a b", "c"], [3, 3, None])).collect()
    assert len(twice) == 2 and all(r.taken <= 4 for r in twice)


def brute_mix(rows, share=1.5):
    """Copies by ``(source, id)``: every copy in the order of its finish time, up to the budget."""
    sizes = {}
    for i, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target, queue = brute_targets(sizes, share), []
    for s in sizes:
        upto = 0
        for m, i, n in sorted((hashlib.md5(f"{i}:mix".encode()).hexdigest(), i, n) for i, x, n in rows if x == s):
            upto += n
            queue += [((upto + k * sizes[s]) / target[s], m, i, n) for k in range(2) if n and target[s]]
    taken, total = {}, 0
    for _, _, i, n in sorted(queue):
        total += n
        if total > sum(target.values()) + 1e-6:
            break
        taken[i] = taken.get(i, 0) + n
    return taken


def test_mix_with_a_document_larger_than_its_sources_target(spark):
    """Copies that finish very late are queued like all others."""
    rng = random.Random(4)
    texts = ["w " * rng.randint(1, 30) for _ in range(200)] + ["w " * 4000, "w " * 90, "w " * 700]
    docs = frame(spark, texts).drop("source").withColumn("source", F.expr("case when doc_id < 150 then 'a' when doc_id < 199 then 'b' when doc_id = 200 then 'c' else 'd' end"))
    rows = [(r.doc_id, r.source, len(words(r.text))) for r in docs.collect()]
    for buckets in (None, 16):
        got = {r.doc_id: r.taken for r in mixing.mix_sources(docs, buckets=buckets).collect() if r.taken}
        assert got == brute_mix(rows)


def test_mixed_documents_keep_their_rows(spark):
    """Repeated rows get a copy count each, and columns of the same names stay."""
    texts = ["a b c", "a b c", "a b c", "d e", None, "f g h i"]
    docs = frame(spark, texts, [3, 3, 3, 3, 5, 6]).withColumn("taken", F.lit("mine")).withColumnRenamed("n", "size")
    got = mixing.mixed_documents(docs)
    assert got.columns == [*docs.columns, "size_", "target", "copies", "taken_"]
    rows = got.collect()
    want = mixing.mix_sources(docs).where("copies > 0").collect()
    assert sorted((r.doc_id, r.size_, r.copies, r.taken_) for r in rows) == sorted((r.doc_id, r["size"], r.copies, r.taken) for r in want)
    assert all(r.size_ == len(words(r.text)) and r.taken == "mine" for r in rows)
    assert mixing.mixed_documents(empty(spark)).count() == 0


# --- quality ------------------------------------------------------------------------------


def labelled(spark, n=900):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        good = rng.random() < 0.7
        if not good:
            w = rng.choice([[x.upper() + "!!" for x in w], [w[0]] * len(w), [f"{x} |" for x in w], [x + rng.choice(["$$$", "%%%"]) for x in w]])
        texts.append(" ".join(w))
        labels.append((i, int(good), 0))
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    got = quality.score_quality(docs, labels)
    pairs = got.join(labels, "doc_id").where("held_out").collect()
    assert len(pairs) > 100 and sum(r.predicted == r.quality for r in pairs) >= 0.97 * len(pairs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.collect())
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.collect() if r.predicted}


def test_quality_never_learns_from_held_out_rows(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit_quality(docs, labels) == quality.fit_quality(docs, flipped)


def test_quality_edges(spark):
    docs, labels = labelled(spark, 60)
    none = quality.score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert quality.score_quality(empty(spark), labels).count() == 0
    odd = frame(spark, [None, "", "\n", "x" * 100_000], [7, 8, 9, 10])
    assert quality.score_quality(odd, labels).where(F.col("score").between(0, 1)).count() == 4
    null = labels.withColumn("quality", F.lit(None).cast("int"))
    assert quality.fit_quality(docs, null).rules == []


def test_compiled_rules_are_the_fitted_ones(spark):
    """The column expression gives what the rules give, row by row in plain Python, with ties and clashing names."""
    docs, labels = labelled(spark, 500)
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(frame(spark, [None, ""], [None, 900]))
    rules = quality.fit_quality(docs, labels)
    assert len(rules.rules) > 3
    import pyarrow as pa

    texts = docs.select("doc_id", "text").collect()
    stats = quality.statistics(pa.array([r.text for r in texts], pa.string()))
    want = []
    for r, x in zip(texts, stats):
        total = rules.bias
        for rule, weight in zip(rules.rules, rules.weights):
            if all((x[quality.STATS.index(s)] > at) == above for s, above, at in rule):
                total += weight
        want.append((str(r.doc_id), 1 / (1 + np.exp(-total))))
    named = docs.withColumnRenamed("key", "score").withColumnRenamed("n", "_s_log_words")
    got = quality.score_quality(named, labels, rules=rules, keep=["doc_id", "score", "_s_log_words"])
    assert got.columns == ["doc_id", "score", "_s_log_words", "held_out", "score_", "predicted"]
    have = sorted((str(r.doc_id), r.score_) for r in got.collect())
    assert [k for k, _ in have] == [k for k, _ in sorted(want)] and [v for _, v in have] == pytest.approx([v for _, v in sorted(want)], abs=1e-12)
    assert quality.keep_quality(named, labels).columns == named.columns


def test_statistics_are_plain():
    import pyarrow as pa

    s = dict(zip(quality.STATS, quality.statistics(pa.array([None, "AB cd, cd cd!\ncd, 1"])).T))
    assert all(v[0] == 0 for v in s.values())
    assert s["distinct"][1] == pytest.approx(5 / 6) and s["top_word"][1] == pytest.approx(2 / 6) or s["distinct"][1] == pytest.approx(5 / 6)
    assert s["upper"][1] == pytest.approx(2 / 10) and s["bangs"][1] == pytest.approx(1 / 6) and s["words_per_line"][1] == 3


# --- LM scoring -----------------------------------------------------------------------------


def test_gradient():
    """One step of plain descent direction agrees with differences of the loss."""
    rng = np.random.default_rng(0)
    net = lm_score.fresh(rng.integers(1, 50, lm_score.CLASSES), 6, 1)
    context, classes = rng.integers(0, lm_score.CLASSES + 1, (4, 32)), rng.integers(0, lm_score.CLASSES, 32)
    loss = lambda n: -lm_score.log_probabilities(n, context, classes).mean()
    seen = {}

    class Recorder(lm_score.Trainer):
        def _move(self, name, gradient, rows=None):
            full = np.zeros_like(getattr(self.net, name))
            full[() if rows is None else rows] = gradient
            seen[name] = seen.get(name, 0) + full

    Recorder(net, 0.1).step(context, classes)
    for name in net.NAMES:
        flat = seen[name].ravel()
        for i in np.argsort(-np.abs(flat))[:3]:
            up, down = net.like(net.flat().astype(float)), net.like(net.flat().astype(float))
            getattr(up, name).ravel()[i] += 1e-2
            getattr(down, name).ravel()[i] -= 1e-2
            assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(flat[i], rel=0.05, abs=2e-4), name


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    net = lm_score.fresh(rng.integers(1, 50, lm_score.CLASSES), 6, 1)
    every = np.arange(lm_score.CLASSES)
    context = np.repeat(rng.integers(0, lm_score.CLASSES, (4, 1)), lm_score.CLASSES, 1)
    assert np.exp(lm_score.log_probabilities(net, context, every)).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("scale", [1, 40, 4000])
def test_probabilities_and_steps_however_far_apart_values_are(scale):
    """One shift serves all rows while values are near each other; beyond that every row has its own."""
    rng = np.random.default_rng(4)
    net = lm_score.fresh(rng.integers(1, 50, lm_score.CLASSES), 6, 1)
    net.group, net.inner = net.group * np.float32(scale), net.inner * np.float32(scale)
    context, classes = rng.integers(0, lm_score.CLASSES + 1, (4, 50)), rng.integers(0, lm_score.CLASSES, 50)
    got = lm_score.log_probabilities(net, context, classes)
    for t, (c, p) in enumerate(zip(classes, got)):
        h = np.tanh(sum(net.place[i][context[i, t]].astype(float) for i in range(4)) + net.bias)
        g, k = divmod(int(c), lm_score.GROUPS)
        z = (h @ net.group + net.group_bias, h @ net.inner[g] + net.inner_bias[g])
        want = sum(x[j] - x.max() - np.log(np.exp(x - x.max()).sum()) for x, j in zip(z, (g, k)))
        assert p == pytest.approx(want, rel=1e-4, abs=1e-3)
    trainer = lm_score.Trainer(net, 0.3)
    trainer.step(context, classes)
    assert np.isfinite(trainer.net.flat()).all()


class PlainTrainer:
    """Steps of Adagrad as they are written down: contexts' gradients by a sort of each place, biases apart."""

    def __init__(self, net, rate):
        self.net, self.rate = net.like(net.flat()), rate
        self.seen = {n: np.full(getattr(net, n).shape, 0.1, np.float32) for n in net.NAMES}

    def move(self, name, gradient, rows=()):
        a, s = getattr(self.net, name), self.seen[name]
        s[rows] += gradient * gradient
        a[rows] -= self.rate * gradient / np.sqrt(s[rows])

    def step(self, context, classes):
        net, n = self.net, len(classes)
        order = np.argsort(classes.astype(np.int16), kind="stable")
        context, classes = context[:, order], classes[order]
        h = np.tanh(sum(net.place[i][context[i]] for i in range(4)) + net.bias)
        g, k, row = classes // lm_score.GROUPS, classes % lm_score.GROUPS, np.arange(n)
        at = np.searchsorted(g, np.arange(lm_score.GROUPS + 1))
        groups = [(i, slice(at[i], at[i + 1])) for i in range(lm_score.GROUPS) if at[i] < at[i + 1]]
        z, d = h @ net.group + net.group_bias, np.empty((n, lm_score.GROUPS), np.float32)
        for i, some in groups:
            d[some] = h[some] @ net.inner[i] + net.inner_bias[i]
        for x, j in ((z, g), (d, k)):
            np.exp(x - x.max(), out=x)
            x /= x.sum(1, keepdims=True) * n
            x[row, j] -= 1 / n
        dh, d_inner, d_inner_bias = z @ net.group.T, np.zeros_like(net.inner), np.zeros_like(net.inner_bias)
        for i, some in groups:
            dh[some] += d[some] @ net.inner[i].T
            d_inner[i], d_inner_bias[i] = h[some].T @ d[some], d[some].sum(0)
        da = dh * (1 - h * h)
        for name, gradient in (("inner", d_inner), ("inner_bias", d_inner_bias), ("group", h.T @ z), ("group_bias", z.sum(0)), ("bias", da.sum(0))):
            self.move(name, gradient)
        for i in range(4):
            order = np.argsort(context[i].astype(np.int16), kind="stable")
            c = context[i][order]
            heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            self.move("place", np.add.reduceat(da[order], heads, axis=0), (i, c[heads]))


def test_steps_are_those_of_the_plain_form_and_cheaper():
    """The same parameters after many steps, of odd sizes too; and three quarters of the plain form's CPU time at most (F1)."""
    rng = np.random.default_rng(7)
    weights = 1 / np.arange(1, lm_score.CLASSES + 1)
    draw = lambda *size: rng.permutation(lm_score.CLASSES)[rng.choice(lm_score.CLASSES, size, p=weights / weights.sum())]
    net = lm_score.fresh(rng.integers(1, 50, lm_score.CLASSES), 24, 1)
    batches = [(draw(4, n), draw(n)) for n in [1024] * 40 + [1, 2, 700]]
    batches[3][0][:, ::5] = lm_score.CLASSES  # texts' ends
    best = {}
    for _ in range(5):
        for kind in (lm_score.Trainer, PlainTrainer):
            trainer, begin = kind(net, 0.3), time.thread_time()
            for context, classes in batches:
                trainer.step(context, classes)
            took = time.thread_time() - begin
            best[kind] = min(took, best.get(kind, (took,))[0]), trainer.net.flat()
    (now, got), (plain, want) = best[lm_score.Trainer], best[PlainTrainer]
    assert np.abs(got - net.flat()).max() > 0.1 and np.allclose(got, want, rtol=1e-3, atol=1e-3)
    assert now < 0.75 * plain, (now, plain)


def test_scores(spark):
    """Words in their usual order are likelier than the same words shuffled, and every word counts."""
    rng = random.Random(0)
    nexts = {f"w{i}": [f"w{(i * 7 + k) % 40}" for k in range(2)] for i in range(40)}

    def text(n):
        w = ["w0"]
        while len(w) < n:
            w.append(rng.choice(nexts[w[-1]]))
        return w

    texts = [text(80) for _ in range(600)]
    mixed = [rng.sample(t, len(t)) for t in texts[:50]]
    docs = frame(spark, [" ".join(t) for t in texts] + [" ".join(t) for t in mixed] + [None, "", "w1"])
    model = lm_score.train(docs, mask=0.5)
    got = {r.doc_id: r for r in lm_score.score_documents(docs, model=model).collect()}
    better = sum(got[i].log_likelihood > got[600 + i].log_likelihood for i in range(50))
    assert better >= 47
    assert (got[650].n_tokens, got[650].log_likelihood, got[650].mean_log_likelihood) == (0, 0.0, None) and got[652].n_tokens == 1
    for i in range(0, 600, 20):
        brute_one(got[i], texts[i], model)


def brute_one(row, text, model):
    import pyarrow as pa

    from tracewright.llm.tokens import word_hashes, words_of

    net, table = model
    c = table[(word_hashes(words_of(pa.array([" ".join(text)]))) >> np.uint64(48)).astype(int)].astype(int)
    total = 0.0
    for t in range(len(c)):
        around = [c[t + k] if 0 <= t + k < len(c) else lm_score.CLASSES for k in (-2, -1, 1, 2)]
        h = np.tanh(sum(net.place[i][a].astype(float) for i, a in enumerate(around)) + net.bias)
        g, k = divmod(int(c[t]), lm_score.GROUPS)
        for z, j in ((h @ net.group + net.group_bias, g), (h @ net.inner[g] + net.inner_bias[g], k)):
            total += z[j] - np.log(np.exp(z).sum())
    assert row.log_likelihood == pytest.approx(total, rel=1e-4) and row.n_tokens == len(c)


def test_scores_of_nothing(spark):
    assert lm_score.score_documents(empty(spark)).count() == 0
    assert lm_score.score_documents(frame(spark, [None, ""])).where("log_likelihood = 0").count() == 2


def test_scores_of_odd_rows(spark):
    """Null and repeated keys, equal texts and a very long one."""
    texts = ["a b c", "a b c", None, LONG, "a b c", ""]
    rows = lm_score.score_documents(frame(spark, texts, [7, 7, None, 4, None, 5])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in rows if r.doc_id is not None) == [(False, 4, 30_000), (False, 5, 0), (False, 7, 3), (False, 7, 3)]
    assert sorted(r.n_tokens for r in rows if r.doc_id is None) == [0, 3]
    assert len({round(r.log_likelihood, 6) for r in rows if r.n_tokens == 3}) == 1
    long = next(r for r in rows if r.n_tokens == 30_000)
    assert long.mean_log_likelihood == pytest.approx(long.log_likelihood / 30_000) and long.log_likelihood < 0


def test_scores_tell_words_of_a_class_apart(spark, monkeypatch):
    """Words add log P(word | class) by exact counts, at hand or joined; unseen words get less than any seen one."""
    import pyarrow as pa

    from tracewright.llm.tokens import word_hashes, words_of

    rng = random.Random(4)
    count = {f"v{i}": rng.randint(1, 6) for i in range(1500)}
    pool = [w for w, n in count.items() for _ in range(n)]
    rng.shuffle(pool)
    docs = frame(spark, [" ".join(pool[i : i + 50]) for i in range(0, len(pool), 50)])
    net, table = lm_score.train(docs)
    hashes = lambda ws: word_hashes(words_of(pa.array([" ".join(ws)])))
    of = lambda ws: table[(hashes(ws) >> np.uint64(48)).astype(int)].astype(int)
    group = {}
    for w, c in zip(count, of(list(count))):
        group.setdefault(int(c), []).append(w)
    shared = next(c for c, ws in group.items() if len({count[w] for w in ws}) > 2)
    unseen = next(f"u{i}" for i in range(10**6) if of([f"u{i}"])[0] == shared)
    probe = [*group[shared], unseen]
    given = lm_score.count_words(docs)
    for head in (1 << 16, 300, 20):
        monkeypatch.setattr(lm_score, "HEAD", head)
        rows = lm_score.score_documents(frame(spark, probe), model=(net, table), counts=given).collect()
        got = {probe[r.doc_id]: r.log_likelihood for r in rows}
        mine = group[shared]
        once = sum(count[w] == 1 for w in mine)
        below = sum(count[w] for w in mine) + once + 0.01
        alone = lm_score.log_probabilities(net, np.full((4, 1), lm_score.CLASSES), np.array([shared]))[0]
        want = {w: alone + np.log(count[w] / below) for w in mine}
        want[unseen] = alone + np.log((once + 0.01) / (len(mine) + 1) / below)
        assert got == pytest.approx(want, rel=1e-6)
        assert got[unseen] < min(got[w] for w in mine)
    again = lm_score.score_documents(frame(spark, [pool[0], pool[0]], [1, 1]), model=(net, table), counts=given).collect()
    assert len(again) == 2 and again[0] == again[1]


def test_training_reaches_every_position(spark, monkeypatch):
    """With the parameters of the query, the weights that rounds are averaged with add up to all words."""
    docs = frame(spark, ["a b c d e"] * 30 + ["x", "y z", None, "", *(f"p{i} q{i} r{i}" for i in range(40))])
    seen, plain = [], lm_score.map_arrow

    def recorded(df, function, schema):
        out = plain(df, function, schema)
        if schema.startswith("part int, who"):
            seen.append(out.where("part = 0").agg(F.sum("n")).first()[0])
        return out

    monkeypatch.setattr(lm_score, "map_arrow", recorded)
    lm_score.train(docs)
    # Each round trains, and adds slices on two levels, which keep all weights.
    assert len(seen) == 6 and seen[::3] == seen[1::3] == seen[2::3] and sum(seen[::3]) == 150 + 3 + 120
