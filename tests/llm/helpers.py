"""Small document tables with every awkward case, and words as the contracts define them."""

import random
import re

LONG = "word " * 30_000


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(n=120, seed=5, vocabulary=40):
    """Texts with copies, near copies, shared passages, nulls, blanks and one very long one."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6)))
    vocab = [word() for _ in range(vocabulary)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts = [None, "", "  \n\t ", LONG]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.15 and len(texts) > 6:
            texts.append(rng.choice(texts[4:]))
        elif kind < 0.35 and len(texts) > 6:
            w = words(rng.choice(texts[4:]))
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "  ", "\n"]).join(w))
        elif kind < 0.5:
            texts.append(" ".join(rng.choice(vocab) for _ in range(20)) + "\n" + passage + " " + rng.choice(vocab))
        else:
            texts.append(" ".join(rng.choice(vocab) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(1, 150))))
    return texts


def frame(spark, texts, ids=None):
    """Documents with columns whose names could clash with those that operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "src%d" % (i % 3) if i is not None and i % 7 else None, "k", 1, None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, n long, _text string").repartition(3)


def empty(spark):
    return frame(spark, ["x"]).limit(0)
