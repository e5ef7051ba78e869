"""Repairing the structure of conversations by the cheapest edits, solved once for each shared beginning.

A conversation becomes a signature: one symbol a row, of its role's initial and its fault. Equal signatures are
counted before they move. The distinct ones are sorted and dealt by ranges, and each task inserts its range into a prefix
trie, in order, so that only the path to the newest leaf is held. Each trie node has one layer of a dynamic programme: the least
cost of editing the rows so far into an accepted beginning, for each state of the automaton of ``(s?(ua)+)?``. Signatures
with a common beginning share its layers. At a terminal node the cheapest edits are read off, the ASCII-least
on ties, and go back to the conversations by their signature.

Two passes over the rows: a light one without texts gives signatures (a text is blank, truncated or known by its
SHA-256), a second one streams the rows past their conversation's edits and hashes what is left.

What is heavy, and how it is dealt with: conversations of one signature meet it in a plain join, which adaptive execution may split; rows
that are alike in all that counts are one row with a number before they move; a conversation of very many rows
is sorted by Spark, with spilling, and streams through a task that keeps a byte a row. It cannot be split further,
as its digest is one chain over its rows.

Rows of one turn are taken by role, then by the digest of role and text; nulls in any column read as one space, but
null turns come first and do not count as turns. Rows with a null ``conv_id`` are a conversation of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.periodic_runs import CRC32_MACRO
from tracewright.llm.shared import durable, map_arrow, parallelism

INITIALS = "sua-"
FAULTS = ("none", "blank", "duplicate", "truncated")
#: Costs of edits, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# --- the automaton and the layers -------------------------------------------------

#: States: nothing yet, ``s``, a ``u`` without its ``a``, and complete.
_NOTHING, _SYSTEM, _OPEN, _COMPLETE = range(4)
_ACCEPTED = (_NOTHING, _COMPLETE)
_AFTER = {(_NOTHING, "s"): _SYSTEM, (_NOTHING, "u"): _OPEN, (_SYSTEM, "u"): _OPEN, (_COMPLETE, "u"): _OPEN, (_OPEN, "a"): _COMPLETE}
_FAR = 1 << 60


def _edits(symbol: int) -> list[tuple[str, int, int, int]]:
    """``(initial, cost, state, next state)`` of all edits that take a row of this symbol."""
    role, fault = INITIALS[symbol >> 2], FAULTS[symbol & 3]
    out = [("D", DELETE, s, s) for s in range(4)]
    if fault in ("blank", "duplicate"):
        return out
    more = TRUNCATED if fault == "truncated" else 0
    out += [("K", more, s, to) for (s, r), to in _AFTER.items() if r == role]
    return out + [("R", REROLE + more, s, to) for (s, r), to in _AFTER.items() if r in "ua"]


EDITS = [_edits(x) for x in range(16)]
_INSERTS = [("I", INSERT, s, to) for (s, r), to in _AFTER.items() if r in "ua"]


def _inserted(layer: list[int]) -> tuple[int, ...]:
    """The layer after any insertions; two in a row are enough, as they lead back to a complete state."""
    for _ in range(2):
        for _, cost, s, to in _INSERTS:
            layer[to] = min(layer[to], layer[s] + cost)
    return tuple(layer)


FIRST_LAYER = _inserted([0, _FAR, _FAR, _FAR])


def next_layer(layer: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Least costs by state after one more row."""
    out = [_FAR] * 4
    for _, cost, s, to in EDITS[symbol]:
        out[to] = min(out[to], layer[s] + cost)
    return _inserted(out)


def read_edits(signature: bytes, layers: list[tuple[int, ...]]) -> tuple[int, str]:
    """Least cost, and of the cheapest edits the ASCII-least initials, from the layers along a signature."""
    n = len(signature)
    cost = min(layers[n][s] for s in _ACCEPTED)
    # Which states lie on a cheapest way, from the end back.
    good: list[set[int]] = [set() for _ in range(n + 1)]
    good[n] = {s for s in _ACCEPTED if layers[n][s] == cost}
    for i in range(n, -1, -1):
        layer, here = layers[i], good[i]
        if i < n:
            here |= {s for _, c, s, to in EDITS[signature[i]] if to in good[i + 1] and layer[s] + c == layers[i + 1][to]}
        for _ in range(2):
            here |= {s for _, c, s, to in _INSERTS if to in here and layer[s] + c == layer[to]}
    # All states that the least initials so far can lead to.
    out, i, states = [], 0, {_NOTHING}
    while i < n or not any(s in _ACCEPTED and layers[n][s] == cost for s in states):
        layer = layers[i]
        steps: dict[str, set[int]] = {}
        for name, c, s, to in _INSERTS:
            if s in states and to in good[i] and layer[s] + c == layer[to]:
                steps.setdefault(name, set()).add(to)
        if i < n:
            for name, c, s, to in EDITS[signature[i]]:
                if s in states and to in good[i + 1] and layer[s] + c == layers[i + 1][to]:
                    steps.setdefault(name, set()).add(to)
        name = min(steps)
        out.append(name)
        states = steps[name]
        i += name != "I"
    return cost, "".join(out)


def solve_sorted(signatures: Iterator[bytes]) -> Iterator[tuple[bytes, int, str]]:
    """Signatures in order with their least cost and edits; the layers on the path to the newest one are the trie's open nodes."""
    path, layers = b"", [FIRST_LAYER]
    for signature in signatures:
        shared = 0
        most = min(len(path), len(signature))
        while shared < most and path[shared] == signature[shared]:
            shared += 1
        del layers[shared + 1 :]
        for symbol in signature[shared:]:
            layers.append(next_layer(layers[-1], symbol))
        path = signature
        yield (signature, *read_edits(signature, layers))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def stream():
        for batch in batches:
            yield from batch.column(0).to_pylist()

    out: list = []
    size = 0
    for row in solve_sorted(stream()):
        out.append(row)
        size += len(row[0])
        if size > 1 << 20:
            yield _table(out, SOLVED)
            out, size = [], 0
    if out:
        yield _table(out, SOLVED)


# --- damage, faults and signatures --------------------------------------------------

_CONTENT = r"[^\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
SOLVED = [("signature", pa.binary()), ("cost", pa.int64()), ("audit", pa.string())]
FACTS = [("conv_id", pa.int64()), ("signature", pa.binary()), ("gaps", pa.int64())]
REPAIRED = [("conv_id", pa.int64()), ("repaired_sha256", pa.string())]
TEXTS = [("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())]
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _table(rows: list, columns: list) -> pa.RecordBatch:
    values = zip(*rows) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, columns)], names=[n for n, _ in columns])


def _schema(columns: list) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in columns)


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))


def read_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` and ``copies``, 1: rows as they are, nulls in role and text as a space."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"), _or_space("text").alias("text"), F.lit(1).alias("copies"))


def damage_turns(conversations: DataFrame) -> DataFrame:
    """The same with faults planted by the CRC-32 of ``conv_id:turn``; dropped rows have no copies, but keep their conversation."""
    rows = read_turns(conversations)
    kind = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _mark() -> Column:
    """What tells rows of a conversation apart: the digest of role and text."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _order() -> list[Column]:
    """Rows of a conversation in order."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]


def _symbols(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, mark, symbol, copies``: alike rows once, with how often they come, and whether role and text came before."""
    last = F.right(F.rtrim(F.col("text"), F.lit(_BLANKS)), F.lit(1))
    fault = F.when(~F.regexp_like("text", F.lit(_CONTENT)), FAULTS.index("blank")).when(~last.isin(".", "!", "?"), FAULTS.index("truncated")).otherwise(0)
    rows = turns.select("conv_id", "turn", "role", _mark().alias("mark"), (_initial() * 4 + fault).alias("symbol"), "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "mark", "symbol").agg(F.sum("copies").alias("copies"))
    # The first turn of each repeated text; a turn that is null comes before all others.
    turn = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    firsts = rows.where("copies > 0").groupBy("conv_id", "mark").agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = firsts.select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), "first")
    met = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")), "left")
    known = F.coalesce(turn > F.col("first"), F.lit(False))
    return met.select("conv_id", "turn", "role", "mark", "symbol", "copies", known.alias("known"))


def _initial() -> Column:
    first = F.left("role", F.lit(1))
    return reduce(lambda out, k: F.when(first == INITIALS[k], k).otherwise(out), range(3), F.lit(3))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its sorted rows: the signature, and how many turns are missing between the first and the last."""
    now: list = [False, None]  # whether there is one, and its id
    symbols, turns, low, high, before = bytearray(), 0, None, None, None

    def facts():
        gaps = high - low + 1 - turns if turns else 0
        return (now[1], bytes(symbols), gaps)

    for batch in batches:
        out = []
        for conv, turn, symbol, copies, known in zip(*(c.to_pylist() for c in batch.columns)):
            if not now[0] or conv != now[1]:
                if now[0]:
                    out.append(facts())
                now = [True, conv]
                symbols, turns, low, high, before = bytearray(), 0, None, None, None
            if not copies:
                continue
            if symbol & 3 == FAULTS.index("blank"):
                symbols += bytes([symbol]) * copies
            else:
                again = symbol & 12 | FAULTS.index("duplicate")
                symbols += bytes([again if known else symbol]) + bytes([again]) * (copies - 1)
            if turn is not None:
                turns += turn != before
                low, high, before = turn if low is None else low, turn, turn
        if out:
            yield _table(out, FACTS)
    if now[0]:
        yield _table([facts()], FACTS)


def _streamed(rows: DataFrame, function, keys: list, columns: list) -> DataFrame:
    """Rows of a conversation next to each other in one task, in order, through a function of batches."""
    dealt = rows.repartition(parallelism(rows.sparkSession), "conv_id")
    return map_arrow(dealt.sortWithinPartitions("conv_id", *keys).select(*columns), *function)


# --- edits applied --------------------------------------------------------------------


def apply_edits(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired rows: ``(role, text)``."""
    expected = "user"
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        role = role if edit == "K" else expected
        yield role, text
        expected = "assistant" if role[:1] == "u" else "user"


def _walk(batches: Iterator[pa.RecordBatch]):
    """``(conv_id, repaired rows)`` of each conversation; its first row has the edits. Rows are read as they are needed."""
    stream = (row for batch in batches for part in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(part, 256).columns)))
    held = next(stream, None)
    while held is not None:
        conv, audit = held[0], held[1]

        def rows():
            nonlocal held
            while (held := next(stream, None)) is not None and held[1] is None:
                for _ in range(held[4]):
                    yield held[2], held[3]

        mine = rows()
        yield conv, apply_edits(audit, mine)
        for _ in mine:  # nothing is left but rows without copies
            pass


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for conv, rows in _walk(batches):
        digest, mark = hashlib.sha256(), b""
        for role, text in rows:
            digest.update(mark + f"{role}:{text}".encode())
            mark = b"\n"
        out.append((conv, digest.hexdigest()))
        if len(out) == 4096:
            yield _table(out, REPAIRED)
            out = []
    if out:
        yield _table(out, REPAIRED)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for conv, rows in _walk(batches):
        for position, (role, text) in enumerate(rows):
            out.append((conv, position, role, text))
            size += len(text) + 32
            if size > 1 << 20:
                yield _table(out, TEXTS)
                out, size = [], 0
    if out:
        yield _table(out, TEXTS)


# --- the operator ---------------------------------------------------------------------


def find_edits(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row a conversation of :func:`read_turns`, checkpointed."""
    rows = _streamed(_symbols(turns), (_signatures, _schema(FACTS)), _order(), ["conv_id", "turn", "symbol", "copies", "known"])
    facts = durable(rows)
    ranges = parallelism(turns.sparkSession)
    distinct = facts.groupBy("signature").agg(F.count("*").alias("n")).repartitionByRange(ranges, "signature").sortWithinPartitions("signature")
    solved = map_arrow(distinct.select("signature"), _solve, _schema(SOLVED))
    symbols = F.hex("signature")  # two digits a symbol, the first is 0
    faults = [F.regexp_count(symbols, F.lit(f"0[{''.join(f'{r * 4 + FAULTS.index(f):X}' for r in range(4))}]")).cast("long").alias(f) for f in FAULTS[1:]]
    role = F.translate(F.regexp_replace(symbols, "0(.)", "$1"), "0123456789ABCDEF", "ssssuuuuaaaa----")
    # Pairs of neighbours, by their first: all but the last, less su, ua and au.
    legal = F.regexp_count(role, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    illegal = (F.greatest(F.length(role) - 1, F.lit(0)) - legal).cast("long").alias("illegal")
    counted = solved.select("signature", "cost", "audit", *faults, illegal)
    return durable(facts.join(counted, "signature").select("conv_id", "gaps", *FAULTS[1:], "illegal", "cost", "audit"))


def _with_edits(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows and, before those of each conversation, its edits."""
    nothing = lambda kind: F.lit(None).cast(kind)
    heads = edits.select("conv_id", "audit", nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), nothing("binary").alias("mark"), F.lit(0).alias("copies"))
    rows = turns.where("copies > 0").select("conv_id", nothing("string").alias("audit"), "turn", "role", "text", _mark().alias("mark"), "copies")
    return heads.unionByName(rows)


def _heads_first() -> list[Column]:
    return [F.col("audit").isNull(), *_order()]


_READ = ["conv_id", "audit", "role", "text", "copies"]


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)``: the repaired rows of all conversations, positions from 0."""
    turns = read_turns(conversations)
    rows = _with_edits(turns, find_edits(turns))
    return _streamed(rows, (_texts, _schema(TEXTS)), _heads_first(), _READ)


def audit_conversations(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """One row a conversation: faults, missing turns, cheapest edits and the digest of what they leave; ``damage`` plants faults first."""
    turns = damage_turns(conversations) if damage else read_turns(conversations)
    edits = find_edits(turns)
    digests = _streamed(_with_edits(turns, edits), (_digest, _schema(REPAIRED)), _heads_first(), _READ)
    digests = digests.withColumnRenamed("conv_id", "c")
    return edits.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


# --- in SQL -----------------------------------------------------------------------------


def _sql_step(cost: str, edit: str, line: str | None, rest: str) -> str:
    kept = f"list_prepend({line}, {rest}.r)" if line else f"{rest}.r"
    return f"{{'c': {rest}.c + {cost}, 'a': '{edit}' || {rest}.a, 'r': {kept}}}"


def _sql_least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _sql_row(state: int) -> str:
    """Of the edits of one row in a state, the best with what follows: ``w0`` to ``w3`` by the state after it."""
    line = "(role || ':' || text)"
    out = [_sql_step("4", "D", None, f"w{state}")]
    keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    out += [f"case when stays and initial = '{i}' then {_sql_step('late', 'K', line, f'w{to}')} end" for i, to in keep.items()]
    to, role = (3, "assistant") if state == 2 else (2, "user")
    return _sql_least(*out, f"case when stays then {_sql_step('3 + late', 'R', f"'{role}:' || text", f'w{to}')} end")


def _sql_insert(of: str, then: str) -> str:
    """All states with the better of what they have, and an insertion and then what the next state has."""
    goes = {0: (2, "user:"), 1: (2, "user:"), 2: (3, "assistant:"), 3: (2, "user:")}
    step = {s: _sql_step("3", "I", f"'{said}'", f"{then}{to}") for s, (to, said) in goes.items()}
    return ", ".join(f"{_sql_least(f'{of}{s}', step[s])} as {{0}}{s}" for s in goes)


def _sql_inserted(of: str) -> tuple[str, str]:
    return _sql_insert(of, of).replace("{0}", "v"), _sql_insert(of, "v").replace("{0}", "w")


_ROW = ", ".join(f"{_sql_row(s)} as b{s}" for s in range(4))
_END = ", ".join(f"{{'c': {0 if s in (0, 3) else 1_000_000_000_000}::bigint, 'a': '', 'r': []::varchar[]}} as b{s}" for s in range(4))
_V, _W = _sql_inserted("b")
ORACLE = f"""
with recursive src as (select dense_rank() over (order by conv_id nulls first) as c, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
 xor({CRC32_MACRO.format(s="(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")}, 4294967295) % 20 as k from conversations),
dam as (select c, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
 unnest(range(case when k = 3 then 2 else 1 end)) as copy from src where k <> 0),
num as (select *, row_number() over (partition by c order by turn nulls first, role, sha256(length(role) || ':' || role || text), copy) as i from dam),
fl as (select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when row_number() over (partition by c, role, text order by i) > 1 then 'duplicate'
  when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'truncated' else 'none' end as fault, left(role, 1) as initial,
 lag(left(role, 1)) over (partition by c order by i) as before from num),
st as (select *, fault not in ('blank', 'duplicate') as stays, case when fault = 'truncated' then 3 else 0 end as late from fl),
facts as (select c, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
 count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from fl group by c),
ends as (select c, n + 1 as i, {_END} from facts),
e1 as (select *, {_V} from ends), e2 as (select c, i, {_W} from e1),
rec as (select * from e2 union all select c, i, w0, w1, w2, w3 from (select *, {_W} from (select *, {_V} from (
  select st.c, st.i, {_ROW} from rec join st on st.c = rec.c and st.i = rec.i - 1)))),
ids as (select distinct c, conv_id from src)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
 coalesce(w0.c, 0) as cost, coalesce(w0.a, '') as audit, sha256(coalesce(array_to_string(w0.r, chr(10)), '')) as repaired_sha256
from ids left join facts using (c) left join rec on rec.c = ids.c and rec.i = 1
"""
