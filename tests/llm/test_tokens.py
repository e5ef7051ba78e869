"""Token counts at every prefix against the library itself."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import LONG, empty, frame
from tracewright.llm import catalog, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "e", "th", " ", "  ", "\n", "\t", "'re", "'", "'l", "l", "s", "1", "23", "!", "--", "日", "本", "é", "<|endoftext|>", "<|endo", " the", "ing", "　", "\xa0", "ʼ", "՘", "࢏", "😀", "  \n", "ll", "zq", "\U00030000"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(token_counts.load_tokenizer(PATH))


@pytest.mark.parametrize("parts, longest", [(PARTS, 25), ("abcdehinorst -=.", 60), ("ab", 40), (" \n-=", 150)])
def test_every_prefix(counter, library, parts, longest):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, longest)))
        want = [library(text[:k]) for k in range(len(text) + 1)]
        assert counter.prefixes(text) == want and counter.count(text) == want[-1], text
        limit = rng.randint(0, 20)
        assert counter.measure(text, limit) == (want[-1], max(k for k, n in enumerate(want) if n <= limit)), text


def test_long_pieces_and_texts(counter, library, monkeypatch):
    rng = random.Random(4)
    for text in ("a" * 100_000, "日本語の" * 30_000, " " * 50_001, LONG, "".join(rng.choice("abst") for _ in range(100_000))):
        assert counter.count(text) == library(text)
    text = " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 9))) for _ in range(3_000))
    short = counter.measure(text, 100)
    monkeypatch.setattr(token_counts, "_LONG", 1_000)
    assert counter.measure(text, 100) == short == (library(text), short[1])
    assert library(text[: short[1]]) <= 100 < library(text[: short[1] + 1])


def test_unusual_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_count_tokens(spark, library):
    texts = [None, "", " \n", LONG, "<|endoftext|>x<|endoftext|>", "same", "same", *["word " * n for n in (511, 512, 513)]]
    docs = frame(spark, texts, [0, 1, 2, 3, 4, 5, 5, None, 7, 8]).withColumn("N_TOKENS", F.lit("mine"))
    rows = token_counts.count_tokens(docs, PATH).collect()
    assert len(rows) == len(texts) and all(r.N_TOKENS == "mine" for r in rows)
    for r in rows:
        text = r.text or ""
        assert (r.n_bytes, r.n_tokens_, r.over_limit) == (len(text.encode()), library(text), library(text) > 512)
        assert library(text[: r.within]) <= 512 and (r.within == len(text) or library(text[: r.within + 1]) > 512)
    assert token_counts.count_tokens(empty(spark), PATH).count() == 0


def test_questions_to_stored_counts(spark, library):
    texts = [None, "", "I'red  of\n\n<|endoftext|> it!", "日本 語"]
    rows = token_counts.prefix_counts(frame(spark, texts), PATH).withColumn("p", F.col("prefix_tokens"))
    asked = rows.select(F.coalesce("text", F.lit("")).alias("text"), *[token_counts.tokens_of_prefix(F.col("p"), F.lit(k)).alias(f"t{k}") for k in (0, 3, 99)], *[token_counts.longest_prefix(F.col("p"), F.lit(b)).alias(f"c{b}") for b in (0, 3, 99)])
    for r in asked.collect():
        counts = [library(r.text[:k]) for k in range(len(r.text) + 1)]
        assert [r.t0, r.t3, r.t99] == [counts[min(k, len(r.text))] for k in (0, 3, 99)]
        assert [r.c0, r.c3, r.c99] == [max(k for k, n in enumerate(counts) if n <= b) for b in (0, 3, 99)]


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalog.QUERIES["op11_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    assert all((r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), library(t), library(t) > 512) for r in rows for t in [texts[r.doc_id]])
