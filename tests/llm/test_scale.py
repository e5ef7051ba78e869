"""Sums and tables that must not grow with partitions or blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame
from tracewright.llm import decontaminate, lm_score
from tracewright.llm.tokens import SYMBOL_BYTES, word_hashes, words_of


@pytest.mark.parametrize("fan_in", [1024, 8])
def test_slices_of_many_partitions(spark, monkeypatch, fan_in):
    monkeypatch.setattr(lm_score, "FAN_IN", fan_in)
    rng = np.random.default_rng(1)
    values = rng.normal(size=(300, 3, 5))
    rows = [(part, who, who + 1, values[who, part].tobytes()) for who in range(300) for part in range(3)]
    rng.shuffle(rows := [rows[i] for i in rng.permutation(len(rows))])
    sent = spark.createDataFrame([(int(p), int(w), int(n), b) for p, w, n, b in rows], lm_score.SLICES).repartition(7)
    out = lm_score.add_slices(sent).collect()
    assert len(out) == (3 if fan_in == 1024 else 3 * 5)
    for part in range(3):
        mine = [r for r in out if r.part == part]
        assert sum(r.n for r in mine) == sum(range(1, 301))
        np.testing.assert_allclose(sum(np.frombuffer(r.body, float) for r in mine), values[:, part].sum(0))
    again = lm_score.add_slices(sent.repartition(3)).collect()
    assert {(r.part, r.who): bytes(r.body) for r in out} == {(r.part, r.who): bytes(r.body) for r in again}


def test_one_slice_is_held(monkeypatch):
    """Ten thousand slices stream through one running sum."""
    seen = []

    def batches():
        for i in range(100):
            body = np.full(8, 1.0).tobytes()
            seen.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([0] * 100, pa.int32()), pa.array([i // 50] * 100, pa.int64()), pa.array([1] * 100, pa.int64()), pa.array([body] * 100, pa.binary())], names=["part", "who", "n", "body"])

    out = lm_score._add(batches())
    assert (first := next(out)).column(2).to_pylist() == [5000] and len(seen) == 51  # the sum is given out as soon as the next group begins
    assert np.frombuffer(first.column(3)[0].as_py(), float).tolist() == [5000.0] * 8 and next(out).column(1).to_pylist() == [1]


def test_all_patterns_of_one_hash(monkeypatch):
    """Were all hashes of patterns equal, every pattern would still be found."""
    words = [[b"a", b"b"], [b"c", b"d"], [b"e", b"f"]]
    hashes = np.array([word_hashes(words_of(pa.array([b" ".join(p).decode()]), SYMBOL_BYTES, True)) for p in words])
    monkeypatch.setattr(decontaminate, "grams_rows", lambda h: np.zeros(len(h), np.uint64))
    monkeypatch.setattr(decontaminate, "grams", lambda h, k: np.zeros(max(len(h) - k + 1, 0), np.uint64))
    patterns = decontaminate.Patterns(2, hashes, words, [[0], [1], [2]])
    w = words_of(pa.array(["x a b c d", "e f a b"]), SYMBOL_BYTES, True)
    nothing = words_of(pa.array(["a", "b", None]), SYMBOL_BYTES, True)  # windows only across texts
    assert [len(x) for x in patterns.search(nothing, word_hashes(nothing))] == [0, 0]
    at, which = patterns.search(w, word_hashes(w))
    assert [(int(p), patterns.items[i]) for p, i in zip(at, which)] == [(1, [0]), (3, [1]), (5, [2]), (7, [0])]


def test_tables_leave_executors(spark, monkeypatch):
    """A benchmark of many blocks: few tables at a time, the same result."""
    from pyspark import Broadcast

    words = [f"w{i}" for i in range(400)]
    bench = spark.createDataFrame([(i, " ".join(words[i : i + 12])) for i in range(0, 360, 12)], "item_id long, text string")
    texts = [" ".join(words[i : i + 30]) for i in range(0, 360, 24)] + ["clean text", None]
    result = lambda blocks: sorted((r.doc_id, r.n_words, [(s.start, s.end) for s in r.spans], list(r["items"])) for r in decontaminate.find_contamination(frame(spark, texts), bench, block_words=blocks).collect())
    whole, gone = result(200_000), []
    plain = Broadcast.unpersist
    monkeypatch.setattr(Broadcast, "unpersist", lambda self, *a: gone.append(self) or plain(self, *a))
    assert result(36) == whole and len(gone) >= decontaminate.AT_ONCE
    kept = decontaminate.decontaminate(frame(spark, texts), bench, block_words=36).select(F.col("doc_id")).collect()
    assert {r.doc_id for r in kept} == {d for d, _, spans, _ in whole if not spans}
