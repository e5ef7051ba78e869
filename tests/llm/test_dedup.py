import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import corpus, empty, frame, lower, words
from tracewright.llm import components, exact_dedup, near_dedup, substring_dedup, tokens
from tracewright.llm.components import connected, forest


def brute_exact(ids, texts):
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(norm.encode()).hexdigest()) for norm, g in groups.items() for _, i in g)


def test_exact(spark):
    texts = corpus() + ["a b", "ab", "a  b", "𝄞 x", "𝄞x"]
    got = sorted(tuple(r) for r in exact_dedup.dedup_exact(frame(spark, texts)).collect())
    assert got == brute_exact(range(len(texts)), texts)


def test_exact_edges(spark):
    assert exact_dedup.dedup_exact(empty(spark)).count() == 0
    got = exact_dedup.dedup_exact(frame(spark, ["a", "a", "a"], [4, 4, None])).collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in got] == [(4, 4, 2)] * 2
    big = 2**62
    got = {r.doc_id: r.keep_id for r in exact_dedup.dedup_exact(frame(spark, ["a", "a "], [-big, big])).collect()}
    assert got == {-big: big, big: big}
    with pytest.raises(ValueError):
        exact_dedup.dedup_exact(empty(spark), salts=63)


def test_exact_by_content_where_digests_collide(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda norm: F.substr(F.sha2(norm, 256), F.lit(1), F.lit(1)))
    texts = corpus(80) + ["a b", "ab", "a  b"]
    got = sorted(tuple(r)[:4] for r in exact_dedup.dedup_exact(frame(spark, texts)).collect())
    assert got == [r[:4] for r in brute_exact(range(len(texts)), texts)]


def test_word_hashes():
    """Equal for equal bytes only, also for words that make polynomials collide."""
    thue = ["ab", "ba"]
    while len(thue[0]) < 2048:
        thue = [thue[0] + thue[1], thue[1] + thue[0]]
    some = [*thue, "x" * 63, "x" * 64, "x" * 65, "abcdefgh", "abcdefghi", "é", *(f"w{i}" for i in range(20_000))]
    for seed in (0, 1):
        h = tokens.word_hashes(tokens.words_of(pa.array([" ".join(some) + " "])), seed)
        assert len(set(h.tolist())) == len(some)
        alone = [tokens.word_hashes(tokens.words_of(pa.array(["q " + x])), seed)[1] for x in some[:8]]
        assert alone == h[:8].tolist()
    values, bounds = near_dedup.shingle_sets(pa.array(thue), 4)
    assert bounds.tolist() == [0, 1, 2] and values[0] != values[1]


def brute_substring(ids, texts, k=20):
    seen, out = set(), {}
    for i, t in sorted(zip(ids, texts), key=lambda x: x[0]):
        w, gone = words(t), set()
        for p in range(len(w) - k + 1):
            run = tuple(w[p : p + k])
            if run in seen:
                gone.update(range(p, p + k))
            seen.add(run)
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("window", [20, 3])
def test_substring(spark, window):
    texts = corpus(160, 9)
    got = substring_dedup.dedup_substrings(frame(spark, texts), window=window).collect()
    want = brute_substring(range(len(texts)), texts, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want
    at = {i: words(t) for i, t in enumerate(texts)}
    for r in got:  # factors copy what they say, from an earlier place
        for s in r.spans:
            n = s.end - s.start
            assert n >= window and at[r.doc_id][s.start : s.end] == at[s.ref_key][s.ref_start : s.ref_start + n]
            assert (s.ref_key, s.ref_start) < (r.doc_id, s.start)
        assert len({p for s in r.spans for p in range(s.start, s.end)}) == r.n_removed


def packed(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] or "" for r in rows])], names=["key", "text"]).sort_by("key")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def parsed(texts, window, packs=3, blocks=5, hot=2000, seed=0):
    """The steps of substring dedup without Spark, over packs of shuffled rows."""
    batch = lambda *columns: pa.RecordBatch.from_arrays(list(columns), names=[str(i) for i in range(len(columns))])

    def by_pack(batches, columns):
        out = {}
        for b in batches:
            for p, *x in zip(*(b.column(i).to_pylist() for i in range(columns))):
                out.setdefault(p, []).append(x)
        return out

    rows = list(enumerate(texts))
    random.Random(seed).shuffle(rows)
    number, bodies = pa.array(range(packs), pa.int64()), pa.array([packed(rows[i::packs]) for i in range(packs)], pa.binary())
    said = by_pack(substring_dedup._answer_anchors(hot)(substring_dedup._send_anchors(window, blocks)(iter([batch(number, bodies)]))), 3)
    answers = pa.array([[{"block": b, "bits": x} for b, x in said.get(p, [])] or None for p in range(packs)])
    found = by_pack(substring_dedup._parse_block(window)(substring_dedup._send_passages(window, blocks, blocks)(iter([batch(number, bodies, answers)]))), 2)
    factors = pa.array([[f for (f,) in found.get(p, [])] for p in range(packs)], pa.list_(pa.binary()))
    return {r["key"]: r for b in substring_dedup._parse(window)(iter([batch(number, bodies, factors)])) for r in b.to_pylist()}


@pytest.mark.parametrize("window", [20, 3, 1])
def test_factors_are_exact_however_anchors_are_dealt_and_hashes_collide(window, monkeypatch):
    texts = corpus(160, 10)
    want = brute_substring(range(len(texts)), texts, window)
    at = {i: words(t) for i, t in enumerate(texts)}
    hashes = substring_dedup.word_hashes
    for hot, bad in ((2000, False), (3, False), (2000, True), (3, True)):
        monkeypatch.setattr(substring_dedup, "word_hashes", (lambda w: hashes(w) % np.uint64(5)) if bad else hashes)
        got = parsed(texts, window, hot=hot)
        assert {k: (r["n_words"], r["n_removed"], r["kept_text"]) for k, r in got.items()} == want
        for k, r in got.items():
            for s in r["spans"]:
                n = s["end"] - s["start"]
                assert n >= window and at[k][s["start"] : s["end"]] == at[s["ref_key"]][s["ref_start"] : s["ref_start"] + n]
            assert len({p for s in r["spans"] for p in range(s["start"], s["end"])}) == r["n_removed"]


def test_substring_edges(spark):
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0
    text = " ".join(map(str, range(30)))
    got = substring_dedup.dedup_substrings(frame(spark, [text, text, text], [7, 7, None])).collect()
    assert sorted(r.n_removed for r in got) == [0, 30]


def sets_of(texts, k):
    out = []
    for t in texts:
        w = words(lower(t))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute_near(texts, k, ids=None):
    s = sets_of(texts, k)
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in range(len(s))}


@pytest.mark.parametrize("shingle", [4, 5])
def test_near(spark, shingle):
    texts = corpus(200, 3, vocabulary=200)
    got = near_dedup.find_near_duplicates(frame(spark, texts), shingle=shingle).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(texts, shingle)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def chain(n, length, step):
    """Each text differs a little from the one before, so the ends are linked only by way of the others."""
    w = [f"w{i}" for i in range(length)]
    out = []
    for i in range(n):
        out.append(" ".join(w))
        for j in range(step):
            w[(i * step + j) * 17 % length] += "x"
    return out


def test_near_large_group_in_blocks(spark):
    """Large nodes branch, large clusters are compared block by block, and nothing is lost."""
    texts = chain(60, 200, 4) + [f"alone {i} {i * i} {i + 1} {i - 1}" for i in range(20)]
    got = near_dedup.find_near_duplicates(frame(spark, texts), shingle=4, small=8, deeper=1, block_shingles=900).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(texts, 4)


def variants(rng, n, length, edits):
    """Texts of ``length`` words that differ from one text in ``edits`` words each."""
    base = [f"b{i}" for i in range(length)]
    out = []
    for i in range(n):
        w = list(base)
        for p in rng.choice(length, edits, replace=False):
            w[p] = f"e{i}x{p}"
        out.append(" ".join(w))
    return out


def test_near_large_groups_are_settled_by_pivots(spark):
    """A large group of near copies, texts that share a passage with it and are no copies, and one copy of a copy."""
    rng = np.random.default_rng(2)
    texts = variants(rng, 400, 120, 2)
    passage = " ".join(texts[0].split()[:60])
    texts += [passage + " " + " ".join(f"o{i}y{j}" for j in range(40)) for i in range(150)]
    texts.append(texts[7].replace("b3 ", "b3 z "))
    want = brute_near(texts, 4)
    got = near_dedup.find_near_duplicates(frame(spark, texts), shingle=4, small=32, deeper=2, block_shingles=4000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_sketches_are_moved_once_however_many_rounds(spark):
    """Large nodes need several rounds; representatives are read twice for the roots of the trees, and once for all rounds."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, near_dedup.SKETCH).astype(np.uint16)
    rows, read = [], spark.sparkContext.accumulator(0)
    for uid in range(400):
        s = base.copy() if uid < 200 else rng.integers(0, 1 << 16, near_dedup.SKETCH).astype(np.uint16)
        s[rng.integers(0, near_dedup.SKETCH, 6)] = uid
        rows.append((uid, bytearray(s.tobytes())))

    def counted(batches):
        for x in batches:
            read.add(x.num_rows)
            yield x

    reps = spark.createDataFrame(rows, "uid long, sketch binary").repartition(3).mapInArrow(counted, "uid long, sketch binary")
    links = near_dedup._candidates(reps, 12, 32, 2).select(F.col("a").cast("long"), F.col("b").cast("long"))
    a, b = (np.array(c) for c in zip(*links.collect()))
    v, root = components.forest(a, b)
    assert sorted(v) == list(range(1, 200)) and set(root) == {0}
    assert read.value == 3 * len(rows)


@pytest.mark.parametrize("most", [0, 1 << 17])
def test_near_packs_stay_where_few_rows_are_wanted(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "BROADCAST_WANTED", most)
    packs = spark.createDataFrame([(p, b"x%d" % p) for p in range(4)], "pack long, body binary")
    rows = spark.createDataFrame([(p << near_dedup.ROW_BITS | r, r) for p in (1, 3) for r in range(p)], "uid long, cluster long")
    out = near_dedup._by_pack(packs, rows, "uid", "cluster")
    assert sorted((bytes(r.body), sorted(w.uid & 0xFFFF for w in r.wanted)) for r in out.collect()) == [(b"x1", [0]), (b"x3", [0, 1, 2])]
    assert ("ResolvedHint" in out._jdf.queryExecution().analyzed().toString()) == (most > 0)


def test_near_recall_at_the_threshold(spark):
    """Planted pairs at similarities of 0.80 to 0.82, each of its own words, and some a little below."""
    rng, texts = np.random.default_rng(3), []
    for i in range(1500):
        e = int(rng.integers(2, 5))
        # A word in the middle is in 4 of the shingles: e edits leave n - 3 - 4 e of n - 3 + 4 e.
        n = 3 + 36 * e + int(rng.integers(-1, 2 * e))
        w = [f"p{i}q{j}" for j in range(n)]
        other = list(w)
        for k in range(e):
            other[5 + 30 * k] += "x"
        texts += [" ".join(w), " ".join(other)]
    sets = sets_of(texts, 4)
    close = [i for i in range(0, len(texts), 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])]
    assert len(close) > 1000 and np.mean([len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in close]) < 0.82 and len(close) < 1500
    got = {r.doc_id: r.component_id for r in near_dedup.find_near_duplicates(frame(spark, texts), shingle=4).collect()}
    assert sum(got[i + 1] == i for i in close) >= len(close) - 1
    assert all(got[i + 1] == i + 1 for i in range(0, len(texts), 2) if i not in set(close))


def test_near_edges(spark):
    assert near_dedup.find_near_duplicates(empty(spark)).count() == 0
    got = near_dedup.find_near_duplicates(frame(spark, ["A b", "a B", "a", None, "", "x"], [5, 3, 9, 1, 2, None])).collect()
    assert {r.doc_id: (r.component_id, r.kept) for r in got} == {5: (3, False), 3: (3, True), 9: (9, True), 1: (1, True), 2: (2, True)}
    assert {r.doc_id for r in near_dedup.dedup_near(frame(spark, ["A b", "a B", "a"], [5, 3, 9])).collect()} == {3, 9}
    kept = near_dedup.dedup_near(frame(spark, ["A b", "a b", "a", None], [3, 3, None, 4]))
    assert kept.columns == frame(spark, ["x"]).columns and kept.count() == 4
    assert near_dedup.dedup_near(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        near_dedup.find_near_duplicates(empty(spark), percent=70)


@pytest.mark.parametrize("bits", [20, 6])
def test_components(spark, bits, monkeypatch):
    monkeypatch.setattr(components, "TASK_BITS", bits)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 400, 350), rng.integers(0, 400, 350)
    links = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)] + [(i, i + 1) for i in range(1000, 1100)], "a long, b long").repartition(5)
    got = {r.v: r.root for r in connected(links).collect()}
    v, r = forest(np.concatenate([a, np.arange(1000, 1100)]), np.concatenate([b, np.arange(1001, 1101)]))
    assert got == dict(zip(v.tolist(), r.tolist())) and got[1100] == 1000
    assert connected(links.limit(0)).count() == 0
