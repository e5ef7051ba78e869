import math
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tracewright.functions import numeric
from tracewright.operators import joins, metrics, packing, rewards, select, validate
from tracewright.plans import selection
from tracewright.streaming import judge


def test_best_of_n_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", 0, -1.0), ("a", 1, -1.0), ("a", 2, None), ("b", 3, None), ("c", 4, float("nan")), ("c", 5, -9.0)], "source_id string, raw_index long, score double")
    assert {(r.source_id, r.raw_index) for r in select.best_of_n(rows, strict=False).collect()} == {("a", 0), ("c", 5)}
    with pytest.raises(Exception, match="no row with a score in b"):
        select.best_of_n(rows).collect()
    assert [r[0] for r in select.groups_without_score(rows).collect()] == ["b"]


def test_diverse_n_keeps_first(spark):
    rows = spark.createDataFrame([("a", 2, 0, "x  y"), ("a", 1, 1, "x\ny"), ("a", 3, 2, "z")], "source_id string, sample_idx int, raw_index long, target string")
    assert {r.raw_index for r in select.diverse_n(rows).collect()} == {1, 2}


def test_fixed_groups_raise(spark):
    rows = spark.range(7).select(F.col("id").alias("i"), F.lit("s").alias("sig"))
    with pytest.raises(Exception, match="incomplete"):
        select.fixed_groups(rows, "i", 4, ["sig"]).collect()


def test_fixed_groups_keep_short_and_mixed_ones(spark, tmp_path):
    """13 documents, one without an id: the query gives the short groups that its SQL has."""
    ids = spark.range(13).select(F.when(F.col("id") < 12, F.col("id")).alias("doc_id"))
    ids.select("doc_id", F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("select 3L as doc_id, 1 as quality, 0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    same(spark, connect(str(tmp_path)), selection.fixed_groups, selection.ORACLES["fixed_groups"], str(tmp_path))
    rows = spark.range(10).select(F.col("id").alias("i"), (F.col("id") == 5).alias("sig"))
    out = select.fixed_groups(rows, "i", 4, ["sig"], strict=False).select("group_id", "whole").distinct().collect()
    assert sorted(map(tuple, out)) == [(0, True), (1, False), (2, False)]


def packed_by_a_loop(sizes, most):
    out, batch, used = [], 0, 0
    for n in sizes:
        if used and used + n > most:
            batch, used = batch + 1, 0
        out.append(batch)
        used += n
    return out


def test_pack_groups(spark):
    got = lambda sizes, most: [r.batch for r in packing.pack_groups(spark.createDataFrame(list(enumerate(sizes)), "g int, n int"), ["g"], "n", most).orderBy("g").collect()]
    assert got([3, 3, 9, 1], 6) == [0, 0, 1, 2] and got([], 5) == [] and got([7], 3) == [0] and got([1] * 10, 1) == list(range(10))
    rng = random.Random(1)
    sizes = [rng.choice([1, 1, 2, 3, 8, 30]) for _ in range(80)]
    assert got(sizes, 9) == packed_by_a_loop(sizes, 9)
    with pytest.raises(Exception, match="row breaks size"):
        got([1, 0], 5)


def test_pack_many_groups(spark):
    """A hundred thousand groups, as a loop packs them; nothing goes through the driver."""
    groups = spark.range(100_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(20)) + F.when(F.col("id") % 997 == 0, 3_000).otherwise(1)).alias("n"))
    rows = packing.pack_groups(groups, ["id"], "n", 2_000).orderBy("id").collect()
    assert [r.batch for r in rows] == packed_by_a_loop([r.n for r in rows], 2_000)


def test_packed_rows_are_judged_in_whole_batches(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("judge_id"), F.col("id").cast("string").alias("prompt"), F.when(F.col("id") < 50, F.floor(F.col("id") / 7)).alias("source_id"), "id")
    packed = packing.pack_rows(rows, "source_id", "id", 16)
    calls = judge.judge(packed, lambda prompts: [" ".join(sorted(prompts)) for _ in prompts], bool, whole="batch", carried="batch long").collect()
    by_batch = {}
    for r in packed.collect():
        by_batch.setdefault(r.batch, []).append(r.judge_id)
    assert len(calls) == 60 and {r.raw_output for r in calls} == {" ".join(sorted(x)) for x in by_batch.values()}
    assert [len(by_batch[b]) for b in sorted(by_batch)] == [14, 14, 14, 8, 10]



def test_samples(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 10).alias("g"), (F.col("id") % 2).alias("y"))
    s = select.balanced_sample(rows, "y", "k", 5).collect()
    assert sorted(r.y for r in s) == [0] * 5 + [1] * 5
    with pytest.raises(ValueError):
        select.balanced_sample(rows, "y", "k", 60)
    c = select.cluster_sample(rows, "g", "k", 3, 2).collect()
    assert len(c) == 6 and len({r.g for r in c}) == 3
    d = select.disjoint_sample(rows.withColumn("ok", F.col("k") % 3 == 0), "g", "k", "ok", 3).collect()
    assert len({r.g for r in d}) == 6
    with pytest.raises(ValueError, match="wrong rows"):
        select.disjoint_sample(rows.withColumn("ok", F.col("k") % 3 == 0), "g", "k", "ok", 6)
    pooled = rows.withColumn("split", F.when(F.col("k") < 50, "x").otherwise("y"))
    assert len(select.cluster_sample(pooled, ["split", "g"], "k", 0, 2).collect()) == 40
    assert select.cluster_sample(pooled, "g", "k", 0, 0).count() == 100


def test_ordinals(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    out = validate.with_ordinal(rows, ["k"], "n").collect()
    assert all(r.k == r.n for r in out) and len(out) == 1000


def test_align_and_coverage(spark):
    a = spark.createDataFrame([("x", 0, 1), ("y", 1, 0)], "source_id string, row_index long, gold int")
    b = spark.createDataFrame([("y", 0, 1), ("x", 1, 0)], "source_id string, row_index long, pred int")
    out, how = joins.align(a, b)
    assert how == "key" and {(r.gold, r.p_pred) for r in out.collect()} == {(1, 0), (0, 1)}
    out, how = joins.align(a, b.withColumn("source_id", F.lit(None).cast("string")))
    assert how == "position" and {(r.gold, r.p_pred) for r in out.collect()} == {(1, 1), (0, 0)}
    with pytest.raises(ValueError):
        joins.align(a, b.limit(1))
    assert {tuple(r) for r in joins.coverage(a, spark.createDataFrame([("x",), ("q",)], "source_id string"), "source_id").collect()} == {("y", "missing"), ("q", "extra")}
    with pytest.raises(KeyError):
        joins.listed(a, "source_id", ["x", "nope"])


def test_unique_keys(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    assert validate.unique_keys(rows, ["k"]).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        validate.unique_keys(rows.union(rows), ["k"]).collect()


def test_metrics_edges(spark):
    rows = spark.createDataFrame([(1, None), (0, 0), (1, 1), (1, 0)], "gold int, prediction int")
    m = metrics.binary_metrics(rows).first()
    assert (m.tn, m.fp, m.fn, m.tp, m.invalid_pos, m.accuracy, m.parse_rate) == (1, 0, 1, 1, 1, 0.5, 0.75)
    assert metrics.binary_metrics(rows.limit(0)).first().accuracy == 0.0
    one = spark.createDataFrame([(1, 1, True)], "gold int, prediction int, complete boolean")
    assert metrics.teacher_metrics(one).first().macro_f1 == 1.0
    assert metrics.agreement(one.select(F.col("gold").alias("human"), F.col("prediction").alias("pred"))).first().kappa is None


def test_trust(spark):
    rows = spark.createDataFrame(
        [(0, False, 1.0), (0, False, 0.0), (1, True, 1.0), (1, True, 1.0), (2, True, 0.9), (2, False, 0.2), (3, True, 0.1), (3, False, 0.2), (4, True, None), (4, False, 0.2)],
        "group_id long, correct boolean, raw double",
    )
    kinds = {r.group_id: r.group_type for r in rewards.trust_groups(rows).collect()}
    assert kinds == {0: "all_wrong", 1: "all_correct", 2: "trusted", 3: "untrusted", 4: "unscorable"}
    paid = {(r.group_id, r.correct): r.trust_reward for r in rewards.trust_reward(rows, 0.5).collect()}
    assert paid[2, True] == 0.45 and sum(paid.values()) == 0.45


def test_schedule():
    assert [numeric.linear_factor(s, 100, 0.1, 0.3) for s in (0, 10, 20, 30, 99)] == [0.0, 0.0, pytest.approx(0.5), 1.0, 1.0]
    with pytest.raises(ValueError):
        numeric.linear_factor(1, 100, 0.5, 0.5)


def test_logprob(spark):
    rows = spark.createDataFrame([([-1.0, None, -3.0],), ([],), ([math.inf, -1.0],), (None,)], "t array<double>")
    assert [tuple(r[0]) for r in rows.select(numeric.mean_logprob(F.col("t"))).collect()] == [(-2.0, 3), (None, 0), (None, 2), (None, 0)]


def test_sft_row(spark):
    rows = spark.createDataFrame([([("user", "q"), ("assistant", "a")],), ([("user", "q")],)], "m array<struct<role:string,content:string>>")
    got = [[tuple(x) for x in r[0]] for r in rows.select(validate.sft_row(F.col("m"), F.lit("T"))).collect()]
    assert got == [[("user", "q"), ("assistant", "T")], [("user", "q"), ("assistant", "T")]]
    leaked = {"gold", "prediction", "integration", "answer"}
    assert not leaked & set(validate.PROMPT_COLUMNS)


def test_labels_must_match_their_pool(spark):
    from tracewright.operators import labels

    pool = spark.createDataFrame([("1",), ("2",)], "judge_id string")
    rows = [(k, c, 1) for k in ("1", "2") for c in ("text", "audio", "visual", "integration")]
    schema = "judge_id string, component string, grounded int"
    whole = spark.createDataFrame(rows, schema)
    assert [r.all_grounded for r in labels.merge_labels(pool, whole).collect()] == [True, True]
    cases = {"missing": rows[1:], "extra": [*rows, ("3", "text", 0)], "repeated": [*rows, ("1", "audio", 0)]}
    for problem, some in cases.items():
        long = spark.createDataFrame(some, schema)
        assert [r.problem for r in labels.label_problems(pool, long).collect()].count(problem) == 1
        with pytest.raises(Exception, match="differ at|repeated label"):
            labels.merge_labels(pool, long).collect()
    assert labels.merge_labels(pool, spark.createDataFrame(cases["missing"], schema), strict=False).count() == 1


def test_lookup_that_must_hit(spark):
    a, b = (spark.createDataFrame([(x,) for x in some], "k string") for some in ("xy", "x"))
    assert joins.lookup(a, b.withColumn("v", F.lit(1)), "k").where("found").count() == 1
    with pytest.raises(Exception, match="no match for k y"):
        joins.lookup(a, b, "k", required=True).collect()
    with pytest.raises(ValueError, match="'y', 'missing'"):
        joins.require_coverage(a, b, "k")
    assert [r.k for r in joins.excluded(a, b, "k").collect()] == ["y"]


def test_patterns_tie_by_first_appearance(spark):
    rows = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 1), (4, 1, 0)], "i int, a int, b int")
    assert [r.pattern for r in metrics.patterns(rows, ("a", "b")).collect()] == ["01", "10"]
    assert [r.pattern for r in metrics.patterns(rows, ("a", "b"), seen="i").collect()] == ["10", "01"]


def test_reward_plugins(spark):
    rows = spark.createDataFrame([(1.0, "a"), (2.5, "bcd"), (None, "")], "x double, s string")
    rewards.register("double", lambda x: x * 2, ("x",))
    rewards.register("lengths", lambda frame: [len(s) + (0 if x != x else x) for x, s in zip(frame["x"], frame["s"])], ("x", "s"), batch=True)
    rewards.register("short", lambda frame: [1.0] * 99, ("s",), batch=True)
    with pytest.raises(ValueError):
        rewards.register("double", abs, ("x",))
    with pytest.raises(KeyError):
        rewards.rewarded(rows, ["nope"])
    assert [(r.double, r.lengths) for r in rewards.rewarded(rows, ["double", "lengths"]).collect()] == [(2.0, 2.0), (5.0, 5.5), (None, 0.0)]
    with pytest.raises(Exception, match="99 rewards for"):
        rewards.rewarded(rows, ["short"]).collect()


def test_checks_of_rows(spark):
    rows = spark.createDataFrame([("a", 2), ("b", 5)], "name string, n int")
    assert validate.expect_counts(rows, {"a": 2, "c": 0}) == {} and validate.expect_counts(rows, {"b": 4}, strict=False) == {"b": 5}
    with pytest.raises(ValueError):
        validate.expect_counts(rows, {"b": 4})
    one = rows.select(validate.first_present(rows, ["gone", "name"]).alias("x")).collect()
    assert [r.x for r in one] == ["a", "b"]
    validate.same_run({"a": 1}, {"a": 1})
    with pytest.raises(ValueError, match="b"):
        validate.same_run({"a": 1}, {"a": 1, "b": 2})
    with pytest.raises(Exception, match="row breaks label"):
        validate.sft_rows(spark.sql("select array(named_struct('role', 'user', 'content', 'q')) as messages, 't' as target, 's' as source_id, int(null) as label"), "v").collect()
    with pytest.raises(ValueError, match="name"):
        validate.refuse_leaks(rows)
    assert validate.refuse_leaks(validate.prompt_columns(rows.withColumn("id", F.lit(1)))).columns == ["id"]
    assert [r.k for r in validate.unique_keys(rows.withColumnRenamed("name", "k"), ["k"]).collect()] == ["a", "b"]


def test_small_functions(spark):
    from tracewright.functions import text as tx

    row = spark.sql("select '12.0' as a, array(named_struct('type', 'text', 'text', 'x'), named_struct('type', 'image', 'text', string(null))) as parts, 'Tell me' as m")
    got = row.select(tx.numeric_id(F.col("a")).alias("a"), tx.content_text(F.col("parts")).alias("t"), tx.transcript(F.col("m")).alias("none")).first()
    assert tuple(got) == ("12", "x", None)
    with pytest.raises(Exception, match="no transcript in: Tell me"):
        row.select(tx.transcript(F.col("m"), required=True)).collect()


def test_user_turns_are_searched_together(spark):
    """A transcript may be in any user message, and parts of messages count."""
    from tracewright.functions import records
    from tracewright.functions import text as tx

    record = '{"messages": [{"role": "user", "content": "Judge this."}, {"role": "assistant", "content": "Transcript: no"}, {"role": "user", "content": [{"type": "text", "text": "Transcript:"}, {"type": "text", "text": "so it is"}]}]}'
    row = spark.createDataFrame([(record,)], "r string").select(F.parse_json("r").alias("r"))
    got = row.select(records.user_text(F.col("r")).alias("m")).select("m", tx.transcript(F.col("m")).alias("t")).first()
    assert tuple(got) == ("Judge this.\n\nTranscript:\nso it is", "so it is")
    with pytest.raises(Exception, match="none of source_id"):
        row.select(records.required_alias(F.col("r"), "source_id")).collect()
    with pytest.raises(Exception, match="cannot tell the source"):
        row.select(records.sampled_source_id(F.col("r"))).collect()
