"""Personal data: patterns, and terms that give protected entities away.

Four patterns find the protected entities. For every kind of entity and every term (a word
of the text outside of entities, lower-cased), the corpus then tells how strongly the term reveals
that there is an entity: with ``P(c)`` the share of documents that hold an entity of kind *c*, and
``P(c|t)`` that share among the documents with term *t*, the term discloses

    log(P(c|t) / P(c)) / -log P(c)

of the information that the entity carries (1: it never occurs without). For ``P(c|t)`` the
lower end of Wilson's interval counts, so that a few documents in a row are no proof. Terms that
reach ``disclosure`` in at least ``support`` documents with the entity are private
wherever they occur. Counts are taken over all documents and whole texts.

All of it is DataFrame functions: a pattern's matches come with their places by
cutting the text at the matches and adding up lengths. The patterns never go back
over what they have read, so texts of any kind take time in proportion to their length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.shared import BLANK, WORD, durable

KINDS = ("email", "ip", "card", "phone")
#: A run that is no match from its first character on is none from a later one either; a match may begin where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
#: Single digits match, too; they fail the test of lengths.
CARD = r"[0-9](?:[\x20-]?+[0-9])*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Patterns of texts' disclosing terms travel to the tasks up to so many characters, and are joined by a shuffle beyond.
BROADCAST_CHARS = 32 << 20
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))

_PLACE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("m", T.StringType())])
_PLACES = T.ArrayType(_PLACE)


def _parts(text: Column, pattern: str | Column) -> Column:
    """The text as an array of ``(gap, m)``: what stands before each match, and the match; null behind the last one."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))


def located(text: Column, pattern: str | Column) -> Column:
    """All matches, leftmost and non-overlapping: array of ``(start, end, m)`` in code points.

    Places are added up in two levels, as every step copies the array that it extends.
    """
    parts = F.transform(_parts(text, pattern), lambda p: F.struct(F.length(p["gap"]).alias("gap"), p["m"].alias("m")))
    none = F.array().cast(_PLACES)

    def add(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["gap"]
        end = start + F.length(part["m"])
        place = F.struct(start.alias("start"), end.alias("end"), part["m"].alias("m"))
        more = F.struct(end.alias("at"), F.concat(acc["out"], F.array(place)).alias("out"))
        return F.when(part["m"].isNull(), acc).otherwise(more)

    def level(every: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(every))).cast("int")

        def stretch(acc: Column, i: Column) -> Column:
            begin = F.struct(acc["at"].alias("at"), none.alias("out"))
            return F.aggregate(F.slice(every, i + 1, step), begin, add, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), F.size(every) - 1, step), F.struct(F.lit(0).alias("at"), none.alias("out")), stretch, lambda acc: acc["out"])

    # A lambda's variable is computed once, an expression wherever it is named.
    return F.get(F.transform(F.array(parts), level), F.lit(0))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _octets(m: Column) -> Column:
    def small(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(m, r"\."), small)


#: What a match must pass, by kind.
TESTS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: _octets(m),
    "card": lambda m: F.length(digits(m)).between(16, 19) & luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(8, 15),
}


def _plausible(text: Column) -> dict[str, Column]:
    """Kind to a cheap test that a text with an entity of that kind passes."""
    digit = F.regexp_like(text, F.lit("[0-9]"))
    return {"email": text.contains("@"), "ip": digit & F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), "card": digit, "phone": text.contains("+")}


def entities(text: Column) -> dict[str, Column]:
    """Kind to array of ``(start, end, m)``: matches of the pattern that pass the kind's test."""
    none, plausible = F.array().cast(_PLACES), _plausible(text)

    def passing(kind: str):
        return lambda p: TESTS[kind](p["m"])

    return {k: F.when(plausible[k], F.filter(located(text, PATTERNS[k]), passing(k))).otherwise(none) for k in KINDS}


def without_entities(text: Column) -> Column:
    """The text with blanks in place of entities, so that places stay as they are."""

    def blanked(kind: str):
        def kept(p: Column) -> Column:
            blanks = F.when(TESTS[kind](p["m"]), F.repeat(F.lit(" "), F.length(p["m"]))).otherwise(p["m"])
            return F.concat(p["gap"], F.coalesce(blanks, F.lit("")))

        return lambda t: F.when(_plausible(t)[kind], F.array_join(F.transform(_parts(t, PATTERNS[kind]), kept), "")).otherwise(t)

    out = F.array(text)
    for kind in KINDS:
        out = F.transform(out, blanked(kind))
    return F.get(out, F.lit(0))


def whole_words(words: Column) -> Column:
    """A pattern for any of the words, as written, between blanks or ends."""
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit(f"(?<!{WORD[:-1]})(?:"), F.array_join(quoted, "|"), F.lit(f")(?!{WORD[:-1]})"))


def disclosing_terms(found: DataFrame, disclosure: float, support: int, z: float) -> DataFrame:
    """``term`` of all that disclose an entity of some kind, for ``found (bare, and an array for each kind)``."""
    total = found.agg(F.count("*").alias("n"), *[F.count_if(F.size(k) > 0).alias(k) for k in KINDS]).first()
    holds = [k for k in KINDS if 0 < total[k] < total["n"]]
    terms = found.select(*[(F.size(k) > 0).alias(k) for k in KINDS], F.explode(F.array_distinct(F.split(F.lower("bare"), BLANK + "+"))).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("seen"), *[F.count_if(k).alias(k) for k in KINDS]).where(F.col("term") != "")

    def tells(kind: str) -> Column:
        n, p, share = F.col("seen"), F.col(kind) / F.col("seen"), total[kind] / total["n"]
        low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        return (F.col(kind) >= support) & (low > share) & (F.log(low / share) / -F.log(F.lit(share)) >= disclosure)

    return counts.where(reduce(lambda a, b: a | b, [tells(k) for k in holds], F.lit(False))).select("term")


def find_private(
    docs: DataFrame, key: str = "doc_id", text: str = "text", disclosure: float = 0.6, support: int = 5, z: float = 3.0, broadcast_terms: int = 200_000
) -> DataFrame:
    """Private spans of every document: ``(key, email, ip, card, phone, term)``.

    Each column is an array of ``(start, end)`` in code points, end exclusive, by
    start. The first four are the patterns' matches, whatever else is found; ``term``
    has every occurrence of a disclosing term, as a whole word outside of entities. Null texts count as
    empty and have no spans. Repeated rows are separate documents; rows with a null key are ignored.
    A kind that all documents hold, or none, has no disclosing terms. An empty table gives an empty result;
    other columns are not looked at. Disclosing terms are broadcast, ``broadcast_terms`` at a
    time. Texts of millions of entities take memory in proportion.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("key").isNotNull())
    found = rows.select("key", "text", *[c.alias(k) for k, c in entities(F.col("text")).items()])
    some = reduce(lambda a, b: a | b, [F.size(k) > 0 for k in KINDS])
    bare = F.when(some, without_entities(F.col("text"))).otherwise(F.col("text"))
    # Patterns are looked for once; later steps read this.
    found = durable(found.select(F.monotonically_increasing_id().alias("row"), "key", *KINDS, bare.alias("bare")))
    terms = durable(disclosing_terms(found, disclosure, support, z))
    blocks = -(-terms.count() // broadcast_terms)
    out = found.drop("bare")
    if blocks:
        words = found.select("row", F.explode(F.array_distinct(F.split("bare", BLANK + "+"))).alias("word")).withColumn("term", F.lower("word"))
        block = F.pmod(F.xxhash64("term"), F.lit(blocks))
        met = [words.join(F.broadcast(terms.where(block == b)), "term").select("row", "word") for b in range(blocks)]
        held = durable(reduce(DataFrame.unionByName, met).groupBy("row").agg(whole_words(F.collect_set("word")).alias("pattern")))
        if (held.agg(F.sum(F.length("pattern"))).first()[0] or 0) <= BROADCAST_CHARS:
            held = F.broadcast(held)
        # Only texts with such a word are cut at it.
        places = found.select("row", "bare").join(held, "row").select("row", located(F.col("bare"), F.col("pattern")).alias("term"))
        out = out.join(places, "row", "left")
    bare = lambda c: F.transform(c, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    term = F.coalesce(bare(F.col("term")), none) if blocks else none
    return out.select(F.col("key").alias(key), *[bare(F.col(k)).alias(k) for k in KINDS], term.alias("term"))


def span_text(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, by kind as listed and start, comma-joined."""

    def named(kind: str):
        return lambda p: F.concat_ws(":", F.lit(kind), p["start"].cast("string"), p["end"].cast("string"))

    return F.array_join(F.concat(*[F.transform(F.col(k), named(k)) for k in kinds]), ",")


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, with their spans generalised: ``[EMAIL]``, ``[TERM]`` and so on.

    Spans that overlap are replaced together, under the first one's kind. Documents without spans
    keep their text as it is; null stays null. Of rows with equal keys each has its own text cleaned. An
    empty table gives an empty result. Other columns are passed on, whatever their names.
    """
    names = [f"_k{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    body, mark = F.col(names[docs.columns.index(text)]), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    marked = docs.select(F.struct(F.col(key).alias("k"), mark.alias("m")).alias("id"), F.col(text).alias("text")).where(F.col(key).isNotNull()).dropDuplicates(["id"])
    spans = find_private(marked, "id", "text", **options)

    def tag(kind: str):
        return lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag"))

    tagged = [F.transform(F.col(k), tag(k)) for k in (*KINDS, "term")]
    spans = spans.select("id", F.array_sort(F.concat(*tagged)).alias("_spans")).where(F.size("_spans") > 0)

    def add(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substr(body, acc["at"] + 1, s["start"] - acc["at"]), s["tag"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"),
        )

    clean = F.aggregate(
        F.col("_spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1, F.length(body)))
    )
    own = F.col(names[docs.columns.index(key)])
    joined = rows.join(spans, (own == F.col("id.k")) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("id.m")), "left")
    fixed = F.when(F.col("_spans").isNull(), body).otherwise(clean)
    return joined.select(*[(fixed if c == text else F.col(n)).alias(c) for c, n in zip(docs.columns, names)])


def _oracle() -> str:
    pattern = dict(zip(KINDS, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")))
    count = "len(regexp_replace({m}, '[^0-9]', '', 'g'))"
    at = "cast(reverse(regexp_replace({m}, '[^0-9]', '', 'g'))[j + 1] as int)"
    passes = {
        "email": "true",
        "ip": "len(list_filter(string_split({m}, '.'), lambda x: cast(x as hugeint) > 255)) = 0",
        "card": f"{count} between 16 and 19 and list_sum(list_transform(range(0, {count}), lambda j: case when j % 2 = 0 then {at} when {at} > 4 then 2 * {at} - 9 else 2 * {at} end)) % 10 = 0",
        "phone": f"{count} between 8 and 15",
    }
    pieces = lambda source, text, p, more: (
        f"select doc_id, {more} unnest(regexp_split_to_array({text}, '{p}')) as gap, unnest(regexp_extract_all({text}, '{p}')) as m, unnest(range(0, len(regexp_split_to_array({text}, '{p}')))) as i from {source}"
    )
    place = "cast(sum(len(gap) + coalesce(len(m), 0)) over (partition by doc_id, no order by i rows unbounded preceding) as bigint) as e"
    cut = " union all ".join(pieces("d", "t", pattern[k], f"{no} as no,") for no, k in enumerate(KINDS))
    tests = " or ".join(f"no = {no} and {passes[k].format(m='m')}" for no, k in enumerate(KINDS))
    bare = "t"
    steps = []
    for no, k in enumerate(KINDS):
        zipped = f"list_zip(regexp_split_to_array(t, '{pattern[k]}'), regexp_extract_all(t, '{pattern[k]}'))"
        kept = f"x[1] || coalesce(case when {passes[k].format(m='x[2]')} then repeat(' ', len(x[2])) else x[2] end, '')"
        steps.append(f"), t{no} as (\n  select doc_id, array_to_string(list_transform({zipped}, lambda x: {kept}), '') as t from {'d' if no == 0 else f't{no - 1}'}\n")
    return rf"""
with d as (
  select doc_id, coalesce(text, '') as t from documents where doc_id is not null
), cut as (
  {cut}
), base as materialized (
  select doc_id, no, e - len(m) as s, e from (select *, {place} from cut) where m is not null and ({tests})
{''.join(steps)}), terms as materialized (
  select doc_id, e - len(m) as s, e, lower(m) as term from (select *, {place} from ({pieces('t3', bare, WORD, '0 as no,')})) where m is not null
), has as (
  select d.doc_id, {', '.join(f'coalesce(bool_or(no = {no}), false) as k{no}' for no in range(4))} from d left join base using (doc_id) group by d.doc_id
), total as (
  select unnest([0, 1, 2, 3]) as no, unnest([avg(k0::int), avg(k1::int), avg(k2::int), avg(k3::int)]) as share from has
), seen as (
  select term, count(*)::double as n, unnest([0, 1, 2, 3]) as no, unnest([count_if(k0), count_if(k1), count_if(k2), count_if(k3)]) as joint
  from (select distinct doc_id, term from terms) join has using (doc_id) group by term
), low as (
  select term, share, (joint / n + 9.0::double / (2 * n) - 3.0::double * sqrt(joint / n * (1 - joint / n) / n + 9.0::double / (4 * n * n))) / (1 + 9.0::double / n) as low
  from seen join total using (no) where share > 0 and share < 1 and joint >= 5
), told as (
  select distinct term from low where low > share and ln(low / share) / -ln(share) >= 0.6::double
), spans as (
  select doc_id, no, s, e from base union all select doc_id, 4, s, e from terms join told using (term)
), named as (
  select *, ['email', 'ip', 'card', 'phone', 'term'][no + 1] || ':' || s || ':' || e as x from spans
)
select cast(d.doc_id as bigint) as doc_id, {', '.join(f'count(*) filter (no = {no}) as n_{k}' for no, k in enumerate(KINDS))},
       sha256(coalesce(string_agg(x, ',' order by no, s) filter (no < 4), '')) as base_sha256, coalesce(string_agg(x, ',' order by no, s), '') as spans
from d left join named using (doc_id) group by d.doc_id
"""


ORACLE = _oracle()
