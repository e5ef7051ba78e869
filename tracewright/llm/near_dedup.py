"""Near duplicates by a chosen-path set similarity join.

A document is the set of its word shingles. Equal sets are one *class*; everything
after that works on one representative a class.

* *Chosen paths*: a representative has a minwise sketch. In each of ``trees``
  independent trees it descends from the root: at every node, a hash of the node picks one
  or two sketch positions (1.25 = 1/0.8 in the mean), and the sketch's tokens there name the
  children it goes to. So two sets with similarity *s* share ``(1.25 s)^depth`` nodes in
  the mean: pairs at 0.8 keep up with the branching, others die out.
* *Small nodes* are compared exhaustively on sketches. Nodes of different trees with the
  same members are compared once.
* *Large nodes* are first measured against a few of their members, the *pivots*. Sketches
  that agree with a pivot which many agree with are settled: they, and all whose sketches
  can agree with theirs by the triangle inequality, are linked to that pivot. So a large
  group of near copies costs one comparison with each pivot. Only the others branch further,
  twice over, for ``deeper`` rounds; a node that is large to the end has all members linked.
* *Full sets*: links on sketches make loose clusters. A cluster of a bounded weight is
  compared exhaustively. A larger one is measured against pivots, too, now
  on full sets, which confirms most members. *Open* are those that no pivot confirms, and
  those near a pivot whose component they are not in; by the triangle inequality all
  links that are still missing have an open end, so open members are compared with all
  others in blocks, a task seeing two blocks at a time. Blocks return a spanning forest of
  the confirmed links, whose components are the result.

A pair at similarity 0.8 shares no node of depth 3 with a probability of 0.357 for a tree; over
all 12 trees, which read the same sketch, that is about 3e-5, and 1e-5 are lost to the limit on
sketches. A pair that only shares large nodes in which no pivot settles it is lost with
about 1e-3. More similar pairs are lost more rarely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.components import connected, forest
from tracewright.llm.packs import ROW_BITS, pack_documents, unpack
from tracewright.llm.shared import durable, map_arrow, parallelism
from tracewright.llm.tokens import BLANK_BYTES, grams, mix, word_hashes, words_of

_U = np.uint64
SKETCH = 128
#: Sketches agree here or above for pairs that matter: 0.8 is over four standard deviations away.
LOOSE = 0.64
_STEP = 3
PIVOTS = 8
#: What a set weighs in a block beside its shingles, so that blocks of short texts are bounded as well.
SET_WEIGHT = 128
#: Full sets of pivots travel to the tasks up to so many bytes, and are joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20
#: So many wanted rows at most, of 100 bytes or less, travel to the packs; for more, packs are shuffled.
BROADCAST_WANTED = 1 << 17


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, one text after another, and their bounds."""
    w = words_of(texts, BLANK_BYTES, True)
    h = word_hashes(w)
    g = grams(h, k)
    short = {c: grams(h, c) for c in range(1, k) if (w.count == c).any()}
    sets = []
    for d in range(len(w.first) - 1):
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        if hi - lo >= k:
            sets.append(np.unique(g[lo : hi - k + 1]))
        elif hi > lo:
            sets.append(short[hi - lo][lo : lo + 1] + _U(hi - lo))
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of minwise tokens, 16 bits each, for every set; zeros for empty ones."""
    n = len(bounds) - 1
    out = np.zeros((n, SKETCH), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        starts = bounds[full]
        v, step = mix(values ^ _U(0x1234567)), mix(values ^ _U(0x9ABCDEF01)) | _U(1)
        for i in range(SKETCH):
            out[full, i] = (mix(np.minimum.reduceat(v, starts)) >> _U(48)).astype(np.uint16)
            v += step
    return out


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = unpack(body.as_py())
                values, bounds = shingle_sets(t.column("text"), k)
                n = np.diff(bounds)
                sums = []
                for c in (0x51ED270B, 0xC2B2AE3D27D4EB4F):
                    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ _U(c)))])
                    sums.append((upto[bounds[1:]] - upto[bounds[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((np.int64(pack) << ROW_BITS) + np.arange(len(n))),
                        t.column("key").combine_chunks().cast(pa.int64()),
                        pa.array(n),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.array([r.tobytes() for r in sketches(values, bounds)], pa.binary()),
                    ],
                    names=["uid", "key", "n", "f1", "f2", "sketch"],
                )

    return run


def descend(sketch: np.ndarray, row: np.ndarray, node: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and nodes ``levels`` deeper. ``row`` indexes ``sketch``; a row may be in many nodes."""
    for _ in range(levels):
        pick = mix(node ^ _U(0xA5A5A5A5))
        two = (pick >> _U(60)) < _U(4)  # a second child in a quarter of the nodes
        first = (pick % _U(SKETCH)).astype(np.int64)
        second = ((pick >> _U(20)) % _U(SKETCH - 1)).astype(np.int64)
        second += second >= first

        def child(at, where):
            token = sketch[row[where], at[where]].astype(np.uint64)
            return mix(node[where] + _U(0x9E3779B97F4A7C15) * (token + (at[where].astype(np.uint64) << _U(16)) + _U(1)))

        every = np.ones(len(row), bool)
        row, node = np.concatenate([row, row[two]]), np.concatenate([child(first, every), child(second, two)])
    return row, node


def _nodes(uid, row, node) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(node.view(np.int64))], names=["uid", "node"])


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(values.to_pylist()), np.uint16).reshape(-1, SKETCH)


def _roots(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            uid, sketch = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for t in range(trees):
                row, node = descend(sketch, np.arange(len(uid)), np.full(len(uid), mix(np.array([t + 1], np.uint64))[0]), _STEP)
                yield _nodes(uid, row, node)

    return run


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two independent subtrees below each node."""
    for batch in batches:
        if batch.num_rows:
            uid, node = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            sketch = _matrix(batch.column(2))
            for t in (1, 2):
                row, below = descend(sketch, np.arange(len(uid)), mix(node + _U(t)), _STEP)
                yield _nodes(uid, row, below)


def _links(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compare_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row is a small node with its members; returns a forest of the pairs that may be similar."""
    least = int(np.ceil(LOOSE * SKETCH))
    for batch in batches:
        out_a, out_b = [], []
        for members in batch.column(0).to_pylist():
            uid = np.array([m["uid"] for m in members], np.int64)
            s = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint16).reshape(-1, SKETCH)
            a, b = [], []
            for i in range(len(uid) - 1):
                j = np.flatnonzero((s[i + 1 :] == s[i]).sum(1) >= least) + i + 1
                a.append(np.full(len(j), i))
                b.append(j)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                v, r = forest(uid[a], uid[b])
                out_a.append(v)
                out_b.append(r)
        if out_a:
            yield _links(np.concatenate(out_a), np.concatenate(out_b))


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are parts of large nodes, with the node's pivots; returns which pivots each member agrees with, and may be near to."""
    least = int(np.ceil(LOOSE * SKETCH))
    for batch in batches:
        for node, members, pivots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            s, p = (np.frombuffer(b"".join(m["sketch"] for m in x), np.uint16).reshape(-1, SKETCH) for x in (members, pivots))
            same = np.stack([(s == q).sum(1) for q in p], 1)
            bit = 1 << np.array([x["slot"] for x in pivots], np.int64)
            # Where two sketches agree in `least` places each with a third, they do in this many.
            near = same >= 2 * least - SKETCH
            uid = pa.array([m["uid"] for m in members], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([node] * len(s), pa.int64()), uid, pa.array((same >= least) @ bit, pa.int32()), pa.array(near @ bit, pa.int32())], names=["node", "uid", "agrees", "near"]
            )


def _to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are members, the pivots that they may be near to, as bits, and the pivots by slot; returns a forest."""
    for batch in batches:
        if not batch.num_rows:
            continue
        uid, near = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        slots = np.array(batch.column(2).to_pylist(), np.int64).reshape(-1, PIVOTS)
        row, slot = np.nonzero((near[:, None] >> np.arange(PIVOTS)) & 1)
        a, b = uid[row], slots[row, slot]
        if (a != b).any():
            yield _links(*forest(a, b))


def _wanted_sets(k: int):
    """Rows are packs with their wanted documents: one row for each tile of blocks that a document is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                values, bounds = _sets_in(body, [w["uid"] for w in wanted], k)
                out = {c: [] for c in _TILE}
                size = 0
                for d, w in enumerate(wanted):
                    body_bytes = values[bounds[d] : bounds[d + 1]].tobytes()
                    tiles = {(x, w["block"]): False for x in range(w["opens"])}
                    tiles |= {(w["open"], y): True for y in range(w["blocks"])} if w["open"] is not None else {}
                    for (x, y), left in tiles.items():
                        for name, v in zip(out, (w["cluster"], x, y, w["uid"], left, y == w["block"], body_bytes)):
                            out[name].append(v)
                        size += len(body_bytes)
                        if size > 8 << 20:
                            yield _set_rows(out)
                            out, size = {c: [] for c in out}, 0
                if out["uid"]:
                    yield _set_rows(out)

    return run


#: A tile is an open block and a block of a cluster; a set may be on either side, or both.
_TILE = {"cluster": pa.int64(), "x": pa.int32(), "y": pa.int32(), "uid": pa.int64(), "left": pa.bool_(), "right": pa.bool_(), "values": pa.binary()}


def _set_rows(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _TILE[c]) for c, v in out.items()], names=list(out))


def _sets_in(body, uids: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    at = [u & ((1 << ROW_BITS) - 1) for u in uids]
    return shingle_sets(unpack(body.as_py()).column("text").take(pa.array(at, pa.int64())), k)


def _full_sets(k: int):
    """Rows are packs with their wanted documents; returns their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                uids = [w["uid"] for w in wanted]
                for lo in range(0, len(uids), 512):
                    values, bounds = _sets_in(body, uids[lo : lo + 512], k)
                    sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                    some = [pa.array([w["cluster"] for w in wanted[lo : lo + 512]], pa.int64()), pa.array(uids[lo : lo + 512], pa.int64()), pa.array(sets, pa.binary())]
                    yield pa.RecordBatch.from_arrays(some, names=["cluster", "uid", "values"])

    return run


def _meet(percent: int):
    """Rows are sets, and the pivots of their cluster; returns the pairs that are near, and if they are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uid, values, pivots in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                mine = np.frombuffer(values.as_py(), np.uint64)
                for p in pivots:
                    its = np.frombuffer(p["values"], np.uint64)
                    if p["pivot"] == uid or 100 * min(len(mine), len(its)) < (2 * percent - 100) * max(len(mine), len(its)):
                        continue
                    both = int((its[np.minimum(np.searchsorted(its, mine), len(its) - 1)] == mine).sum())
                    union = len(mine) + len(its) - both
                    if 100 * both >= (2 * percent - 100) * union:
                        out.append((uid, p["pivot"], 100 * both >= percent * union))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_()))], names=["uid", "pivot", "similar"])

    return run


def _confirm(percent: int):
    """Rows are tiles with their sets; returns a forest of the pairs that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                members = members.as_py()
                uid = np.array([m["uid"] for m in members], np.int64)
                left, right = (np.array([m[c] for m in members], bool) for c in ("left", "right"))
                a, b = similar_pairs([np.frombuffer(m["values"], np.uint64) for m in members], left, right, percent)
                if len(a):
                    yield _links(*forest(uid[a], uid[b]))

    return run


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs, one marked ``left`` and one ``right``, with ``100 |a & b| >= percent |a | b|``."""
    left, right = np.flatnonzero(left), np.flatnonzero(right)
    n = np.array([len(s) for s in sets], np.int64)
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.zeros((len(left), len(right)), np.float32)  # counts below 1 << 24 are exact
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    token = np.cumsum(fresh) - 1
    shared = np.bincount(token)[token] > 1  # others add nothing to an intersection
    token, owner = token[shared], owner[shared]
    token = np.unique(token, return_inverse=True)[1] if len(token) else token
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    for lo in range(0, int(token.max()) + 1 if len(token) else 0, 4096):
        s, e = np.searchsorted(token, [lo, lo + 4096])
        t, o = token[s:e] - lo, owner[s:e]
        side = []
        for k, size in ((0, len(left)), (1, len(right))):
            m = np.zeros((size, 4096), np.float32)
            mine = place[k, o] >= 0
            m[place[k, o[mine]], t[mine]] = 1
            side.append(m)
        both += side[0] @ side[1].T
    found = []
    for lo in range(0, len(left), 256):
        common, mine = both[lo : lo + 256].astype(np.int64), left[lo : lo + 256]
        ok = 100 * common >= percent * (n[mine][:, None] + n[right][None, :] - common)
        i, j = np.nonzero(ok & (mine[:, None] != right[None, :]))
        found.append((mine[i], right[j]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _settled(large: DataFrame, sketched: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Large nodes, as ``(uid, node, members)``, against their pivots: links, and ``(uid, node)`` of members that no pivot of note agrees with."""
    held = large.select("uid", "node", "members").join(sketched, "uid")
    drawn = F.xxhash64("uid", "node")
    pivots = large.groupBy("node", F.pmod(drawn, F.lit(PIVOTS)).cast("int").alias("slot"))
    pivots = pivots.agg(F.min_by("uid", drawn).alias("uid")).join(sketched, "uid")
    pivots = durable(pivots.groupBy("node").agg(F.collect_list(F.struct("slot", "uid", "sketch")).alias("pivots")))  # PIVOTS at most
    part = F.pmod(F.xxhash64("uid"), F.ceil(F.col("members") / small))
    parts = held.groupBy("node", part.alias("part")).agg(F.collect_list(F.struct("uid", "sketch")).alias("held"))
    seen = durable(map_arrow(parts.join(pivots, "node").select("node", "held", "pivots"), _cover, "node long, uid long, agrees int, near int"))
    agree = [F.sum(F.shiftright("agrees", i).bitwiseAND(1)) for i in range(PIVOTS)]
    note = sum((F.when(c * 2 >= small, 1 << i).otherwise(0) for i, c in enumerate(agree)), F.lit(0)).cast("int")
    by_slot = F.transform(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda i: F.element_at(F.map_from_arrays(F.col("pivots.slot"), F.col("pivots.uid")), i))
    noted = durable(seen.groupBy("node").agg(note.alias("note")).join(pivots, "node").select("node", "note", F.transform(by_slot, lambda u: F.coalesce(u, F.lit(0))).alias("slots")))
    seen = seen.join(noted, "node")
    near = F.col("near").bitwiseAND(F.col("note"))
    links = durable(map_arrow(seen.select("uid", near.alias("near"), "slots").where("near <> 0"), _to_pivots, "a long, b long"))
    return links, seen.where(F.col("agrees").bitwiseAND(F.col("note")) == 0).select("uid", "node")


def _candidates(reps: DataFrame, trees: int, small: int, deeper: int) -> DataFrame:
    """Links ``(a, b)`` such that similar representatives are in one component."""
    nodes = map_arrow(reps.select("uid", "sketch"), _roots(trees), "uid long, node long")
    links = sketched = None
    for k in range(deeper + 1):
        counts = durable(nodes.groupBy("node").agg(F.count("*").alias("members")).where("members > 1"))  # most nodes have one member
        shared = durable(nodes.join(counts, "node"))
        same = [F.bit_xor(F.xxhash64("uid", F.lit(salt))).alias(f"m{salt}") for salt in (1, 2)]
        few = shared.where(F.col("members") <= small).groupBy("node", "members").agg(*same)
        few = few.groupBy("members", "m1", "m2").agg(F.min("node").alias("node")).select("node")
        full, large = shared.select("uid", "node").join(few, "node"), shared.where(F.col("members") > small)
        if sketched is None:
            # Sketches of what shares a node are fetched once, for all rounds; those of the others stay where they are.
            full = durable(full)
            met = full.select("uid").unionByName(large.select("uid")).distinct()
            sketched = durable(reps.select("uid", "sketch").join(met, "uid", "left_semi"))
        groups = full.join(sketched, "uid").groupBy("node").agg(F.collect_list(F.struct("uid", "sketch")).alias("members")).select("members")
        found = durable(map_arrow(groups, _compare_nodes, "a long, b long"))
        links = found if links is None else links.unionByName(found)
        if not large.take(1):
            break
        if k < deeper:
            near, rest = _settled(large, sketched, small)
            links, rest = links.unionByName(near), durable(rest)
            left = durable(rest.groupBy("node").agg(F.count("*").alias("members")).where(F.col("members") > 1))
            again = rest.join(left.where(F.col("members") <= small).select("node"), "node").select("uid", "node")
            more = rest.join(left.where(F.col("members") > small).select("node"), "node").join(sketched, "uid")
            nodes = durable(map_arrow(more.select("uid", "node", "sketch"), _deeper, "uid long, node long").unionByName(again))
        else:
            star = large.join(large.groupBy("node").agg(F.min("uid").alias("head")), "node").where(F.col("uid") != F.col("head"))
            star = star.select(F.col("uid").alias("a"), F.col("head").alias("b"))
            links = links.unionByName(star.distinct())
    return durable(links)


def _by_pack(packs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``(body, wanted)``: the packs of the rows' ``uid``, each with its rows."""
    wanted = durable(rows.groupBy(F.shiftright("uid", ROW_BITS).alias("pack")).agg(F.collect_list(F.struct(*columns)).alias("wanted")))
    if (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_WANTED:
        wanted = F.broadcast(wanted)
    return packs.join(wanted, "pack").select("body", "wanted")


def _measured(sets: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """``(uid, pivot, similar)``: members of clusters, as ``(cluster, uid, values)``, and the chosen of their cluster that they are near to."""
    pivots = durable(sets.select("uid", "values").join(chosen.select("cluster", F.col("pivot").alias("uid")), "uid"))
    size = pivots.agg(F.sum(F.length("values"))).first()[0] or 0
    pivots = pivots.groupBy("cluster").agg(F.collect_list(F.struct(F.col("uid").alias("pivot"), "values")).alias("pivots"))  # a few a cluster
    if size <= BROADCAST_BYTES:
        pivots = F.broadcast(pivots)
    return durable(map_arrow(sets.join(pivots, "cluster").select("uid", "values", "pivots"), _meet(percent), "uid long, pivot long, similar boolean"))


def _confirmed(packs: DataFrame, members: DataFrame, k: int, percent: int, block: int, rounds: int, pivots: int) -> DataFrame:
    """Links whose components are those of all similar pairs within the clusters of ``members (uid, cluster, n)``."""
    weigh = lambda rows: rows.groupBy("cluster").agg(F.sum(F.col("n") + SET_WEIGHT).alias("weight")).where(F.col("weight") > block).select("cluster")
    live = durable(weigh(members))
    opened, sure = members.withColumn("open", F.lit(True)), None
    if live.take(1):
        held = durable(members.join(live, "cluster"))
        sets = durable(map_arrow(_by_pack(packs, held, "uid", "cluster"), _full_sets(k), "cluster long, uid long, values binary"))
        bare, seen = held, None
        for r in range(rounds):
            drawn = F.xxhash64("uid", F.lit(r))
            chosen = bare.join(live, "cluster").groupBy("cluster", F.pmod(drawn, F.lit(pivots)).alias("slot")).agg(F.min_by("uid", drawn).alias("pivot"))
            chosen = durable(chosen.select("cluster", "pivot"))
            new = _measured(sets, chosen, percent)
            seen = new if seen is None else seen.unionByName(new)
            met = new.where("similar").select("uid").unionByName(chosen.select(F.col("pivot").alias("uid"))).distinct()
            bare = durable(bare.join(met, "uid", "left_anti"))
            live = durable(weigh(bare))
            if not live.take(1):
                break
        sure = seen.where("similar").select(F.col("uid").alias("a"), F.col("pivot").alias("b"))
        of = durable(connected(sure))
        root = lambda c, name: of.select(F.col("v").alias(c), F.col("root").alias(name))
        edge = seen.where(~F.col("similar")).join(root("uid", "mine"), "uid", "left").join(root("pivot", "its"), "pivot", "left")
        edge = edge.where(F.coalesce("mine", "uid") != F.coalesce("its", "pivot")).select("uid")
        settled = held.select("uid").join(bare.select("uid").unionByName(edge).distinct(), "uid", "left_anti").select("uid", F.lit(False).alias("said"))
        opened = members.join(settled, "uid", "left").withColumn("open", F.coalesce("said", F.lit(True)))
    opened = durable(opened.select("uid", "cluster", "n", "open"))
    weight = F.col("n") + SET_WEIGHT
    count = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / block).cast("int")
    blocks = opened.groupBy("cluster").agg(count(F.sum(weight)).alias("blocks"), count(F.sum(F.when(F.col("open"), weight))).alias("opens")).where(F.col("opens") > 0)
    place = lambda salt, c: F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(c)).cast("int")
    dealt = opened.join(blocks, "cluster").select("uid", "cluster", "opens", "blocks", place(0, "blocks").alias("block"), F.when(F.col("open"), place(1, "opens")).alias("open"))
    bodies = _by_pack(packs, dealt, "uid", "cluster", "block", "blocks", "open", "opens")
    shipped = map_arrow(bodies, _wanted_sets(k), "cluster long, x int, y int, uid long, left boolean, right boolean, values binary")
    tiles = shipped.groupBy("cluster", "x", "y").agg(F.collect_list(F.struct("uid", "left", "right", "values")).alias("members")).select("members")
    found = durable(map_arrow(tiles, _confirm(percent), "a long, b long"))
    return found if sure is None else found.unionByName(sure)


def find_near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = 80,
    trees: int = 12,
    small: int = 512,
    deeper: int = 3,
    block_shingles: int = 1 << 19,
    pivots: int = 4,
    rounds: int = 6,
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for every document.

    Words are separated by blanks, A-Z lower-cased. A document's set is its
    distinct ``shingle``-word runs, or all its words as one if it has fewer.
    Documents are linked if ``100 * |intersection| >= percent * |union|``, which is
    decided on full sets; ``component_id`` is the smallest (integer) key that
    links lead to, ``kept`` whether it is the document's own. Null and
    empty texts have an empty set and are linked with nothing. Rows with equal
    keys are compared like any others. Rows with a null key are ignored. An
    empty table gives an empty result; other columns are not looked at.
    """
    if percent < 80:
        raise ValueError("trees, branching and sketch are laid out for similarities of 0.8 and more")
    kind = docs.schema[key].dataType.simpleString()
    spark = docs.sparkSession
    packs = pack_documents(docs, key, text)
    about = durable(map_arrow(packs, _describe(shingle), "uid long, key long, n long, f1 long, f2 long, sketch binary"))
    sets = ["f1", "f2", "n"]
    classes = about.where(F.col("n") > 0).groupBy(*sets).agg(F.min("uid").alias("uid"), F.min("key").alias("least"))
    reps = durable(classes.join(about.select("uid", "sketch"), "uid").select("uid", *sets, "least", "sketch"))
    cluster = connected(_candidates(reps, trees, small, deeper))
    root = cluster.select("root").distinct().select(F.col("root").alias("uid"), F.col("root").alias("cluster"))
    members = durable(cluster.select(F.col("v").alias("uid"), F.col("root").alias("cluster")).unionByName(root).join(reps.select("uid", "n"), "uid"))
    links = connected(_confirmed(packs, members, shingle, percent, block_shingles, rounds, pivots))
    labelled = reps.select("uid", *sets, "least").join(links.select(F.col("v").alias("uid"), "root"), "uid", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "uid"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    found = labelled.join(smallest, "root").select(*sets, "component_id")
    out = about.select("key", *sets).join(found, sets, "left")
    component = F.coalesce("component_id", "key")
    return out.select(
        F.col("key").cast(kind).alias(key), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), (component == F.col("key")).alias("kept")
    )


def dedup_near(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, less all but the smallest key of each component.

    Documents without words are kept. Rows whose key and component occur more than once are kept or dropped together.
    """
    gone = find_near_duplicates(docs, key, text, **options).where(~F.col("kept")).select(key)
    return docs.join(gone, key, "left_anti")


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents where doc_id is not null
), s as materialized (
  select doc_id, hash(array_to_string(w[i:i + 3], ' ')) as h from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as i from d where len(w) > 0) group by all
), n as materialized (
  select doc_id, count(*) as n from s group by doc_id
), i as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by all
), l as materialized (
  select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)
), e as materialized (
  select a, b from l union select b, a from l
), r as (
  with recursive reach(doc_id, to_id) as (
    select doc_id, doc_id from d union select reach.doc_id, e.b from reach join e on reach.to_id = e.a
  ) select doc_id, min(to_id) as component_id from reach group by doc_id
)
select cast(d.doc_id as bigint) as doc_id, coalesce(n.n, 0) as n_shingles, cast(component_id as bigint) as component_id, d.doc_id = component_id as kept
from d left join n using (doc_id) join r using (doc_id)
"""
