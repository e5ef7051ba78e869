"""Conversation repair against plain search and a plain walk over rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tracewright.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, copies string, mark string"


def plain_cheapest(symbols):
    """Least cost and ASCII-least edits of ``(initial, fault)`` rows, by trying all of them: suffixes are remembered."""
    known = {}

    def best(i, roles, inserted):
        """roles: what has been given so far, as far as it matters."""
        state = roles
        if (i, state, inserted) in known:
            return known[i, state, inserted]
        out = [(0, "")] if i == len(symbols) and re.fullmatch("(s?(ua)+)?", state) else []
        nxt = [c for c in "sua" if re.match(r"s?(ua)*u?\Z", state + c)]

        def cut(roles):  # pairs in the middle do not matter
            return re.sub(r"(ua)+", "ua", roles)

        if inserted < 2:
            for c in nxt:
                if c != "s":
                    cost, edits = best(i, cut(state + c), inserted + 1)
                    out.append((cost + 3, "I" + edits))
        if i < len(symbols):
            role, fault = symbols[i]
            cost, edits = best(i + 1, state, 0)
            out.append((cost + 4, "D" + edits))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for c in nxt:
                    cost, edits = best(i + 1, cut(state + c), 0)
                    if c == role:
                        out.append((cost + more, "K" + edits))
                    if c != "s":
                        out.append((cost + more + 3, "R" + edits))
        known[i, state, inserted] = min(out, default=(10**9, ""))
        return known[i, state, inserted]

    return best(0, "", 0)


def symbol(role, fault):
    return cr.INITIALS.index(role) * 4 + cr.FAULTS.index(fault)


def test_edits_of_all_short_signatures():
    kinds = list(itertools.product(cr.INITIALS, cr.FAULTS))
    some = [s for n in range(4) for s in itertools.product(kinds, repeat=n)]
    rng = random.Random(2)
    some += [tuple(rng.choice(kinds) for _ in range(rng.randint(4, 14))) for _ in range(1500)]
    by_signature = {bytes(symbol(*x) for x in s): s for s in some}
    for signature, cost, audit in cr.solve_sorted(iter(sorted(by_signature))):
        assert (cost, audit) == plain_cheapest(by_signature[signature]), by_signature[signature]


def test_shared_beginnings_are_solved_once(monkeypatch):
    calls = []
    plain = cr.next_layer
    monkeypatch.setattr(cr, "next_layer", lambda layer, x: calls.append(x) or plain(layer, x))
    words = sorted([b"\4\10" * 50 + bytes([k]) for k in range(16)] + [b"\4\10" * 20])
    assert len(list(cr.solve_sorted(iter(words)))) == 17 and len(calls) == 100 + 16


def damaged(rows):
    """The contract's damage in plain Python."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def mark(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain_audit(rows):
    """The facts of one conversation's rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], mark(r[2], r[3])))
    seen, symbols = set(), []
    for _, _, role, text in rows:
        inner = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "none"
        seen.add((role, text))
        symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "-", fault))
    turns = [r[1] for r in rows if r[1] is not None]
    counts = [sum(f == x for _, f in symbols) for x in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
    cost, audit = plain_cheapest(symbols)
    lines, left, want = [], iter(rows), "user"
    for e in audit:
        role, text = ("", "") if e == "I" else next(left)[2:]
        if e != "D":
            role = role if e == "K" else want
            lines.append(f"{role}:{text}")
            want = "assistant" if role[0] == "u" else "user"
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed=7, n=150):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            text = rng.choice(["Yes.", "No!", "why", "", " \n", None, "Well... ", "é?\t", "long " * 50 + "."])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows += [(conv, rng.choice([turn, turn + 1, turn * 2, None]), role, text)] * rng.choice([1, 1, 1, 1, 2])
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("damage", [True, False])
def test_audit(spark, damage):
    rows = conversations()
    got = {r.conv_id: tuple(r)[1:] for r in cr.audit_conversations(frame(spark, rows), damage).collect()}
    after = by_conversation(damaged(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    want = {c: plain_audit(after.get(c, [])) for c in by_conversation(rows)}
    assert got == want
    assert not damage or any(c not in after for c in want) and any(w[5] > 6 for w in want.values())


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (2, 0, "user", ""), (3, None, None, None)]
    got = sorted(tuple(r) for r in cr.repair_conversations(frame(spark, rows)).collect())
    assert got == [(1, 0, "system", "Be kind."), (1, 1, "user", ""), (1, 2, "assistant", "Hi.")]
    assert cr.audit_conversations(frame(spark, rows).limit(0)).count() == cr.repair_conversations(frame(spark, rows).limit(0)).count() == 0


def test_long_and_common_conversations(spark):
    """One of 20,000 turns with a very long text, and thousands that are alike."""
    turns = [(-1, t, ("user", "assistant")[t % 2], f"Turn {t}." if t else "x" * 2_000_000 + ".") for t in range(20_000)]
    rows = frame(spark, turns).unionByName(spark.range(3_000).selectExpr("id as conv_id", "0L as turn", "'user' as role", "'Hello.' as text", "'c' as copies", "'m' as mark"))
    got = {r.conv_id: r for r in cr.audit_conversations(rows).collect()}
    assert len(got) == 3_001 and {(r.cost, r.audit) for c, r in got.items() if c >= 0} == {(3, "KI")}
    long = got[-1]
    assert (long.cost, long.audit, long.illegal, long.gaps) == (0, "K" * 20_000, 0, 0)
    assert long.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in turns).encode()).hexdigest()


def test_rows_that_repeat_in_any_number(spark):
    rows = frame(spark, [(1, 1, "user", "Same.")]).crossJoin(spark.range(500)).drop("id").withColumn("turn", F.lit(3))
    r = cr.audit_conversations(rows).first()
    assert (r.duplicate, r.cost, r.audit) == (499, 499 * 4 + 3, "K" + "D" * 499 + "I")
