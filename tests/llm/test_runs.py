"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import LONG, corpus, empty, frame, words
from tracewright.llm import periodic_runs


def plain_runs(w):
    """All runs of a list, by trying every period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i >= max(p, 12 - p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((i, j - i, p) for (i, j), p in found.items())


def planted(key, w):
    n = len(w)
    h = zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def kept(w, runs):
    gone = {j for s, n, p in runs for j in range(s + p, s + n)}
    return [x for j, x in enumerate(w) if j not in gone]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        size = rng.choice([2, 2, 3, 5, 30])
        w = [rng.randrange(size) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 3)):
            if w:
                a, p = rng.randrange(len(w)), rng.randint(1, 12)
                w[a:a] = w[a : a + p] * rng.randint(1, 6)
        yield w


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_all_runs(block, monkeypatch):
    monkeypatch.setattr(periodic_runs, "_BLOCK", block)
    texts = [*sequences(1, 400), [0] * 500, [0, 1] * 130, list(range(100)) * 3, [0] * 11, [0] * 12]
    first = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
    start, end, period = periodic_runs.find_runs(np.concatenate([np.array(w, np.int64) for w in texts]), first)
    got = [[] for _ in texts]
    for s, e, p in zip(start.tolist(), end.tolist(), period.tolist()):
        t = int(np.searchsorted(first, s, side="right")) - 1
        got[t].append((s - int(first[t]), e - s, p))
    assert got == [plain_runs(w) for w in texts]
    assert sum(map(len, got)) > 300


def test_words_are_parted_by_ascii_blanks_only():
    split, numbers, first = periodic_runs.number_words(["a\x0bb　c\xa0 a\x1c\x85 ".encode(), b""])
    assert [x.decode() for x in split[0]] == words("a\x0bb　c\xa0 a\x1c\x85 ") and first.tolist() == [0, 3, 3] and numbers.tolist() == [0, 1, 2]


def rows_of(spark, texts, ids=None):
    docs = frame(spark, texts, ids)
    return docs, periodic_runs.digest_runs(docs, plant=True).collect()


def test_digests(spark):
    texts = [*corpus(150, vocabulary=6), "a b " * 30, "x y z " * 9 + "x", "tail " + "q " * 11, "tail " + "q " * 12, LONG]
    _, rows = rows_of(spark, texts)
    assert len(rows) == len(texts)
    for r in rows:
        w = planted(r.key, words(texts[r.key]))
        runs = plain_runs(w) if len(w) < 5_000 else [(r.start, r.length, r.period)]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r.collapsed_sha256 == sha(" ".join(kept(w, runs)))
    long = next(r for r in rows if r.key == len(texts) - 1)
    assert (long.n_runs, long.period) == (1, 1)


def test_keys_and_empty_tables(spark):
    text = "one two three " * 8
    _, rows = rows_of(spark, [text, text, text, None], [None, 5, 5, None])
    assert sorted((r.key is None, r.n_runs, r.period) for r in rows) == sorted([(True, 1, 3), (True, 0, None), *[(False, len(plain_runs(planted(5, words(text)))), 3)] * 2])
    assert periodic_runs.digest_runs(empty(spark)).count() == 0


def test_collapsed_texts(spark):
    texts = ["a b c " * 6 + "end", "  nothing\nrepeats ", None]
    rows = {r.key: r for r in periodic_runs.collapse_runs(frame(spark, texts)).collect()}
    assert [(x.start, x.length, x.period) for x in rows[0].runs] == [(0, 18, 3)] and rows[0].text == "a b c end" and rows[0].n_words == 19
    assert rows[1].runs == [] and rows[1].text == "nothing repeats" and (rows[2].n_words, rows[2].text) == (0, "")
