import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import LONG, corpus, empty, frame, lower
from tracewright.llm import decontaminate, line_dedup, pii, url_filter
from tracewright.llm.pii import KINDS

# --- benchmark decontamination ---------------------------------------------------


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_contamination(texts, items, window):
    patterns = {}
    for name, t in items:
        w = tokens(t)
        m = min(window, len(w))
        for p in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[p : p + m]), set()).add(name)
    out = {}
    for i, t in enumerate(texts):
        w, hit, found = tokens(t), set(), set()
        for run, names in patterns.items():
            for p in range(len(w) - len(run) + 1):
                if tuple(w[p : p + len(run)]) == run:
                    hit.update(range(p, p + len(run)))
                    found |= names
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_contamination(spark, block_words):
    texts = corpus(60, 4, 25)[:3] + ["word " * 3000] + corpus(60, 4, 25)[4:]
    texts += ["Été-ABC 12 x " * 40, "one two three four five six seven eight nine ten eleven"]
    bench = [("b", "two THREE, four five six seven eight nine-ten eleven twelve"), ("a", "abc 12"), ("c", None), ("d", "!!"), ("e", texts[10]), ("e2", texts[10]), ("f", " ".join((texts[20] or "q").split()[:14])), ("g", "x")]
    b = spark.createDataFrame(bench, "item_id string, text string")
    got = decontaminate.find_contamination(frame(spark, texts), b, block_words=block_words).collect()
    have = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in got}
    want = brute_contamination(texts, [x for x in bench if x[1]], 10)
    assert have == want
    clean = {r.doc_id for r in decontaminate.decontaminate(frame(spark, texts), b, block_words=block_words).collect()}
    assert clean == {i for i, x in want.items() if not x[1]}


def test_contamination_edges(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    one = spark.createDataFrame([("a", "x y")], "item_id string, text string")
    assert decontaminate.find_contamination(empty(spark), one).count() == 0
    got = decontaminate.find_contamination(frame(spark, ["x y", None], [3, 4]), none).collect()
    assert {(r.doc_id, r.n_words, len(r.spans), len(r["items"])) for r in got} == {(3, 2, 0, 0), (4, 0, 0, 0)}
    kept = decontaminate.decontaminate(frame(spark, ["x y", None, "q", "q"], [1, 2, 3, 3]), one)
    assert kept.columns == ["doc_id", "text", "source", "key", "n", "_text"] and sorted(r.doc_id for r in kept.collect()) == [2, 3, 3]
    assert decontaminate.decontaminate(empty(spark), one).count() == 0


def test_contamination_of_a_very_long_text(spark):
    bench = spark.createDataFrame([("a", "one two three four five six seven eight nine ten"), ("w", "word word word")], "item_id string, text string")
    passage = " one two three four five six seven eight nine ten "
    texts = [LONG, LONG + passage + LONG, passage + "word " * 2]
    got = {r.doc_id: r for r in decontaminate.find_contamination(frame(spark, texts), bench).collect()}
    assert {i: (r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for i, r in got.items()} == {0: (30_000, 30_000, ["w"]), 1: (60_010, 60_010, ["a", "w"]), 2: (12, 10, ["a"])}


def test_repeated_rows_are_searched_one_by_one_whatever_the_blocks(spark):
    words = [f"w{i}" for i in range(400)]
    bench = spark.createDataFrame([("long", " ".join(words)), ("b", " ".join(words[100:130]))], "item_id string, text string")
    docs = frame(spark, [" ".join(words[95:140]), " ".join(words[95:140]), "w1 w2"], [7, 7, 7])
    for block_words in (200_000, 50):
        got = sorted((r.n_words, [(s.start, s.end) for s in r.spans], list(r["items"])) for r in decontaminate.find_contamination(docs, bench, block_words=block_words).collect())
        assert got == [(2, [], []), (45, [(0, 45)], ["b", "long"]), (45, [(0, 45)], ["b", "long"])]


# --- personal data ------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def base_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if passes(k, m[0])] for k, p in PATTERNS.items()}


def test_base_spans(spark):
    rng = random.Random(3)
    alphabet = "0123456789.+- ()@aé𝄞\n"
    texts = [None, "", "4041894974608795", "x 4041-8949 7460-8795.", "𝄞ab@c.de", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.1.1.1", "+1 (988) 555-2485", "+1234567", "9" * 300, "a@b.c_d@e.f", "a@b@c.d", "a@b.c.d@e.f", "a@b..c", "1.2.3.4.", "1.2.3 4.5.6.7"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    got = {r.doc_id: r for r in pii.find_private(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert {k: [(p.start, p.end) for p in got[i][k]] for k in KINDS} == base_spans(t), t


def brute_terms(texts, disclosure=0.6, support=5, z=3.0):
    """Spans of disclosing terms of every text, by counting over all texts."""
    bare, has = [], []
    for t in texts:
        t = t or ""
        has.append({k for k, some in base_spans(t).items() if some})
        for k in KINDS:
            t = re.sub(PATTERNS[k], lambda m, k=k: " " * len(m[0]) if passes(k, m[0]) else m[0], t)
        bare.append(t)
    seen, joint = {}, {}
    for t, kinds in zip(bare, has):
        for w in set(re.findall(r"[^\x20\x09-\x0D]+", t.lower())):
            seen[w] = seen.get(w, 0) + 1
            for k in kinds:
                joint[w, k] = joint.get((w, k), 0) + 1
    told = set()
    for (w, k), n in joint.items():
        share, p, m = sum(k in x for x in has) / len(has), n / seen[w], seen[w]
        low = (p + z * z / 2 / m - z * math.sqrt(p * (1 - p) / m + z * z / 4 / m / m)) / (1 + z * z / m)
        if n >= support and share < low and share < 1 and math.log(low / share) >= disclosure * -math.log(share):
            told.add(w)
    return told, [[(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if m[0].lower() in told] for t in bare]


@pytest.mark.parametrize("broadcast_terms", [200_000, 1])
def test_disclosing_terms(spark, broadcast_terms, monkeypatch):
    """Terms of all kinds, glued to their entity or far from it, wherever they occur; ties and chance do not tell."""
    rng = random.Random(5)
    words = ["the", "river", "boats", "by", "slow", "Été", "𝄞x", "sincerelyx", "$1|(\\E"]
    texts = [None, "", "Mailto: nothing here"]
    for i in range(400):
        t = [rng.choice(words) for _ in range(rng.randint(3, 12))]
        if i % 12 == 0:
            t += [f"mailto:u{i}@x.org", *[rng.choice(words) for _ in range(6)], rng.choice(["Sincerely", "sincerely"]), "[x]*\\Ey\\Q|"]
        if i % 15 == 0:
            t += ["call", f"+1 (988) 555-{2000 + i}", "card", "4041894974608795", "at", f"10.0.0.{i % 250}"]
        if i in (0, 12, 24):
            t.append("rare")
        texts.append(rng.choice([" ", "\n"]).join(t))
    told, want = brute_terms(texts)
    if broadcast_terms == 1:
        monkeypatch.setattr(pii, "BROADCAST_CHARS", 0)
    assert {"mailto:", "sincerely", "call", "card", "[x]*\\ey\\q|"} <= told and "rare" not in told and "the" not in told
    got = {r.doc_id: r for r in pii.find_private(frame(spark, texts), broadcast_terms=broadcast_terms).collect()}
    assert [[(p.start, p.end) for p in got[i].term] for i in range(len(texts))] == want


def test_sanitise(spark):
    texts = [f"note{i} mailto: u{i}@x.org the end" if i % 3 == 0 else f"plain{i} the end of it" for i in range(120)]
    docs = frame(spark, [*texts, texts[0], "b a@b.cc", None], [*range(120), 7, 7, 8]).withColumnRenamed("_text", "_spans")
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    rows = clean.collect()
    assert {r.text for r in rows if r.doc_id in (0, 1)} == {"note0 [TERM] [EMAIL] the end", texts[1]}
    assert sorted(r.text for r in rows if r.doc_id == 7) == ["b [EMAIL]", "note0 [TERM] [EMAIL] the end", texts[7]]
    assert len(rows) == 123 and sum(r.text is None for r in rows) == 1
    assert pii.sanitise(empty(spark)).count() == 0


def test_texts_of_a_megabyte_take_seconds(spark):
    n = 1 << 20
    texts = ["9" * n, "a@b" + ".c" * (n // 2), "A" * n + " x@", "1 " * (n // 2), "1.1.1.1 " * (n // 16), "+1 " + "-" * n, "a@b.cc " * (n // 14), "+" * n, "1." * (n // 2)]
    begun = time.time()
    got = {r.doc_id: {k: len(r[k]) for k in KINDS} for r in pii.find_private(frame(spark, texts)).collect()}
    assert time.time() - begun < 120
    assert [got[i]["email"] for i in range(9)] == [0, 1, 0, 0, 0, 0, n // 14, 0, 0]
    assert got[4]["ip"] == n // 16 and got[8]["ip"] == n // 8 and sum(x["card"] + x["phone"] for x in got.values()) == 0


def test_private_edges(spark):
    assert pii.find_private(empty(spark)).count() == 0
    got = pii.find_private(frame(spark, ["a@b.cc", "a@b.cc", "x"], [1, 1, None])).collect()
    assert [(r.doc_id, len(r.email)) for r in got] == [(1, 1)] * 2


def test_op4_digest(spark):
    from tracewright.llm import catalog

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalog.QUERIES["op4_pii"](spark, sf).collect():
        b = base_spans(texts[r.doc_id])
        s = ",".join(f"{k}:{x}:{y}" for k in KINDS for x, y in b[k])
        assert r.base_sha256 == hashlib.sha256(s.encode()).hexdigest() and r.spans.startswith(s)
        assert [r[f"n_{k}"] for k in KINDS] == [len(b[k]) for k in KINDS]


# --- URLs -----------------------------------------------------------------------------

URLS = [
    (None, "", "", None),
    ("no scheme", "", "", None),
    ("http://Example.ORG/es/x?q#f", "example.org", "/es/x", "example.org/es/"),
    ("https://a.b.example.org/en/12", "a.b.example.org", "/en/12", "example.org/en/1"),
    ("x://example.org", "example.org", "", None),
    ("x://notexample.org/es/", "notexample.org", "/es/", "org/"),
    ("https://q.com/fr/a", "q.com", "/fr/a", "com/fr/"),
    ("https://q.com?/de/", "q.com", "", None),
    ("https://q.com/de/://z", "q.com", "/de/://z", "com/de/"),
    ("http://É.Net/#a", "É.net", "/", None),
    ("://h/p", "h", "/p", None),
]


def test_urls(spark):
    rows = spark.createDataFrame([(i, u[0], None, 5) for i, u in enumerate(URLS)], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in url_filter.judge_urls(rows).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(URLS))] == [u[1:] for u in URLS]
    assert [got[i].verdict for i in (0, 2, 3, 5, 6, 8)] == ["allow", "block", "block", "allow", "allow", "block"]
    assert url_filter.judge_urls(rows.limit(0)).count() == 0


def test_odd_pages(spark):
    """Null and repeated keys, repeated rows, a very long URL and very long HTML."""
    long = "http://a.example.org/es/" + "x" * 300_000
    rows = [(None, long, None), (None, None, None), (1, "https://q.com/de/1", "<a href='http://z.net/'>" * 20_000), (1, "https://q.com/de/1", "<a href='http://z.net/'>" * 20_000), (1, "http://z.net/", "")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.host, len(r.path), r.verdict) for r in got) == [(0, "", 0, "allow"), (0, "a.example.org", 300_004, "block"), (1, "q.com", 5, "block"), (1, "q.com", 5, "block"), (1, "z.net", 1, "allow")]


def brute_walks(edges, trust, block, steps=8, d=0.85):
    def walk(links, seed):
        total = sum(seed.values())
        base = {h: n / total for h, n in seed.items()}
        out = {}
        for a, b, n in links:
            out[a] = out.get(a, 0) + n
        rank = dict(base)
        for _ in range(steps):
            new = {h: v * (1 - d) for h, v in base.items()}
            for a, b, n in links:
                new[b] = new.get(b, 0.0) + d * rank.get(a, 0.0) * n / out[a]
            rank = new
        return {h: v / sum(rank.values()) for h, v in rank.items()}

    return walk(edges, trust), walk([(b, a, n) for a, b, n in edges], block)


def test_link_graph(spark):
    """A host that links to blocked ones is blocked, one that trusted ones link to is allowed."""
    link = lambda h: f'<a href="http://{h}/x">'
    pages = [
        (1, "http://good.org/a", link("friend.net") + link("good.org") + "<a href='/local'>"),
        (2, "http://bad.com/de/a", link("other.net")),
        (3, "http://spam.net/a", link("bad.com") * 3 + link("friend.net")),
        (4, "http://friend.net/a", link("BAD.com")),
        (5, "http://farm.net/", link("spam.net")),
        (6, "http://nobody.net/", ""),
    ]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    edges = [("good.org", "friend.net", 1), ("bad.com", "other.net", 1), ("spam.net", "bad.com", 3), ("spam.net", "friend.net", 1), ("friend.net", "bad.com", 1), ("farm.net", "spam.net", 1)]
    trust, distrust = brute_walks(edges, {"good.org": 1}, {"bad.com": 1})
    for r in got.values():
        assert r.trust == pytest.approx(trust.get(r.host, 0.0)) and r.distrust == pytest.approx(distrust.get(r.host, 0.0))
    assert {i: got[i].verdict for i in got} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow"}


# --- lines ------------------------------------------------------------------------------


def brute_lines(ids, texts, min_docs, lead, share):
    mask = lambda t: "<*>" if re.search("[0-9]", t) else t
    parsed = []
    for i, t in zip(ids, texts):
        for n, line in enumerate((t or "").split("\n")):
            w = [mask(x) for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
            if w:
                parsed.append((i, n, w, (len(w), tuple(w[:lead]))))
    docs = {}
    for i, n, w, leaf in parsed:
        docs.setdefault(leaf, set()).add(i)
    at = {}
    for i, n, w, leaf in parsed:
        for p, x in enumerate(w):
            at.setdefault((leaf, p, x), set()).add(i)
    found = {}
    for i, n, w, leaf in parsed:
        if len(docs[leaf]) >= min_docs:
            form = [x if x != "<*>" and len(at[leaf, p, x]) >= min_docs else "<*>" for p, x in enumerate(w)]
            if any(x != "<*>" for x in form) and sum(x != "<*>" for x in form) >= share * sum(x != "<*>" for x in w):
                found.setdefault((leaf, tuple(form)), []).append((i, n))
    gone = set()
    for rows in found.values():
        if len({i for i, _ in rows}) >= min_docs:
            first = min(i for i, _ in rows)
            gone |= {(i, n) for i, n in rows if i != first}
    return {i: (len(t.split("\n")) if t is not None else 0, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in zip(ids, texts)}


def test_lines(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(["on", "the", "river", "boats", "go", "by", "slow"]) for _ in range(rng.randint(3, 9)))
    texts = [None, "", "\n\n"]
    for i in range(60):
        lines = [prose() + f" {rng.choice('abcdefghij')}{rng.choice('klmnop')}" for _ in range(4)]
        if i % 2:
            lines.insert(rng.randint(0, 4), "All rights reserved.")
        if i % 3 == 0:
            lines.append(f"Page {i} of {i + 3} printed by user {rng.choice(['ann', 'bo', 'cy', 'dee', 'eli', 'fay', 'gus'])}")
        texts.append("\n".join(lines))
    got = line_dedup.dedup_lines(frame(spark, texts), min_docs=8).collect()
    want = brute_lines(range(len(texts)), texts, 8, 2, 0.6)
    assert {r.doc_id: (r.n_lines, r.text) for r in got} == want
    assert sum(t is not None and "All rights reserved." in t for _, t in want.values()) == 1
    assert sum(t is not None and "Page" in t for _, t in want.values()) == 1


def test_lines_edges(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    docs = frame(spark, ["same line here\nown a b c"] * 3 + ["same line here\nx"], [2, 2, 5, 9])
    got = line_dedup.dedup_lines(docs, min_docs=2)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_dropped) for r in got.collect()) == [(2, 0), (2, 0), (5, 2), (9, 1)]
    assert got.where(F.col("text") == "x").count() == 1


def test_lines_fields_are_found_however_full_the_bit_tables_are(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    texts = ["\n".join([f"Written in our blog by {word()} for you", *(" ".join(word() for _ in range(rng.randint(3, 9))) for _ in range(5))]) for _ in range(80)]
    want = brute_lines(range(len(texts)), texts, 8, 2, 0.6)
    assert sum("Written" in t for _, t in want.values()) == 1
    for bits in (6, None):
        got = line_dedup.dedup_lines(frame(spark, texts), bits=bits).collect()
        assert {r.doc_id: (r.n_lines, r.text) for r in got} == want


def test_walks_settle(spark):
    """Hosts many links away from a seed get their verdict, and ranks on a cycle are the converged ones."""
    names = ["bad.com", *(f"h{i}.net" for i in range(12))]
    edges = [(b, a, 1) for a, b in zip(names, names[1:])] + [("h1.net", "h5.net", 1), ("good.org", "h5.net", 1)]
    pages = [(0, "http://bad.com/de/a", ""), (1, "http://good.org/a", '<a href="http://h5.net/">')]
    for i, h in enumerate(names[1:]):
        pages.append((i + 2, f"http://{h}/", " ".join(f'<a href="http://{b}/">' for a, b, _ in edges if a == h)))
    got = {r.host: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    trust, distrust = brute_walks(edges, {"good.org": 1}, {"bad.com": 1}, 1000)
    for h, r in got.items():
        assert abs(r.trust - trust.get(h, 0.0)) < 1e-7 and abs(r.distrust - distrust.get(h, 0.0)) < 1e-7
    assert got["h11.net"].verdict == "block"
