"""URL filters: path rules, and link-graph propagation where no rule fits.

Rules judge URLs. The hosts they allow and block are the seeds of two walks over
the graph of host-to-host links: trust flows along links from allowed hosts
(personalised PageRank), distrust flows against them from blocked hosts. A host whose
distrust exceeds ``margin`` times its trust is blocked.

Everything is DataFrame operations. Links are counted per pair of hosts before the
walks, which therefore only see the host graph, and a step of the walks is one join and
one pre-aggregated sum over hosts, with both walks in one table. What a walk loses at hosts without
links onwards goes back to its seeds; that only scales its settled values, so they are
divided by their sum at the end. A host without any links is in a walk only as a seed.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import durable

#: Host and path, as text, and the verdict.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute link.
LINK = r"""href\s*=\s*["']?(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#"'\s<>]*)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        h, p = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, links)``: links from pages of one host to another host; needs ``host`` and ``html``."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return found.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(links: DataFrame, seeds: DataFrame, steps: int | None = None, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """``(host, trust, distrust)`` after ``steps`` steps of both walks, or else when they have settled.

    They have if four steps changed all values by less than ``tolerance`` in the sum. Values
    of a walk add up to 1.
    ``seeds``: ``(walk, host, v)``, with walk 0 trust and walk 1 distrust, each summing to 1.
    """
    one = links.select(F.lit(0).alias("walk"), F.col("src").alias("a"), F.col("dst").alias("b"), "links")
    other = links.select(F.lit(1).alias("walk"), F.col("dst").alias("a"), F.col("src").alias("b"), "links")
    both = one.unionByName(other)
    out = both.groupBy("walk", "a").agg(F.sum("links").alias("_all"))
    edges = durable(both.join(out, ["walk", "a"]).select("walk", "a", "b", (F.col("links") / F.col("_all")).alias("w")))
    base = seeds.select("walk", "host", (F.col("v") * (1 - damping)).alias("v"))
    rank = seeds.select("walk", "host", "v")
    settled = durable(rank) if steps is None else None
    for k in itertools.count() if steps is None else range(steps):
        moved = edges.join(rank.withColumnRenamed("host", "a"), ["walk", "a"]).select("walk", F.col("b").alias("host"), (F.col("v") * F.col("w") * damping).alias("v"))
        rank = moved.unionByName(base).groupBy("walk", "host").agg(F.sum("v").alias("v"))
        if k % 4 == 3:
            rank = durable(rank)
            if steps is None:
                change = rank.unionByName(settled.withColumn("v", -F.col("v"))).groupBy("walk", "host").agg(F.sum("v").alias("v")).agg(F.sum(F.abs("v"))).first()[0]
                if (change or 0.0) < tolerance:
                    break
                settled = rank
    total = rank.groupBy(F.col("walk").alias("_w")).agg(F.sum("v").alias("_all"))
    rank = durable(rank.join(total, F.col("walk") == F.col("_w")).select("walk", "host", (F.col("v") / F.col("_all")).alias("v")))
    pick = lambda walk: F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("v"))), F.lit(0.0))
    return rank.groupBy("host").agg(pick(0).alias("trust"), pick(1).alias("distrust"))


def judge_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    rules=RULES,
    steps: int | None = None,
    damping: float = 0.85,
    margin: float = 2.0,
    broadcast_hosts: int = 500_000,
    salts: int = 64,
) -> DataFrame:
    """A verdict for every page: ``(key, host, path, rule, trust, distrust, verdict)``.

    The verdict is the longest fitting rule's; without one, that of the page's
    host, which is blocked if ``distrust > margin * trust`` once both walks have settled (or after
    ``steps`` steps). Null URLs and
    those without ``://`` have an empty host and path, fit no rule and are
    allowed. Null HTML has no links; links within a host do not count.
    Repeated rows are judged one by one. An empty table gives an empty result; other
    columns are not looked at. A null key stays null. Hosts with a value are broadcast up to
    ``broadcast_hosts`` of them; beyond, pages are joined with them on host and one of ``salts`` salts.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = rows.select("key", "host", "path", rule.alias("rule"), verdict.alias("said"))
    counts = durable(
        judged.where(F.col("said").isNotNull())
        .groupBy(F.when(F.col("said") == "allow", 0).otherwise(1).alias("walk"), "host")
        .agg(F.count("*").cast("double").alias("n"))
    )
    total = counts.groupBy(F.col("walk").alias("_w")).agg(F.sum("n").alias("_n"))
    seeds = counts.join(total, F.col("walk") == F.col("_w")).select("walk", "host", (F.col("n") / F.col("_n")).alias("v"))
    scores = durable(propagate(host_links(rows), seeds, steps, damping))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    if scores.count() <= broadcast_hosts:
        out = judged.join(F.broadcast(scores), "host", "left")
    else:
        salted = judged.withColumn("_salt", F.pmod(F.xxhash64("key", "path"), F.lit(salts)))
        copied = scores.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("long"))
        out = salted.join(copied, ["host", "_salt"], "left")
    method = F.when(distrust > margin * trust, "block").otherwise("allow")
    return out.select(F.col("key").alias(key), "host", "path", "rule", trust.alias("trust"), distrust.alias("distrust"), F.coalesce("said", method).alias("verdict"))


#: Pages with one more link each, to another page of the table: links between hosts, which the bundled pages lack.
LINKED = """select p.page_id, p.url, concat(coalesce(p.html, ''), ' <a href="', coalesce(q.url, ''), '">') as html
 from pages p left join (select url, row_number() over (order by page_id) - 1 as place from pages) q on q.place = (p.page_id * 7 + 3) % (select count(*) from pages)"""


def oracle(steps: int = 8, pages: str = "pages") -> str:
    walk = "\n".join(
        f"""), r{k + 1} as materialized (
  select walk, host, sum(v) as v from (
    select e.walk, e.b as host, r.v * e.w * 0.85::double as v from e join r{k} r on e.walk = r.walk and e.a = r.host
    union all select walk, host, v * (1 - 0.85::double) from r0
  ) group by walk, host"""
        for k in range(steps)
    )
    return rf"""
with u as (
  select page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from {pages}
), j as (
  select page_id, host, path, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule from u
), s as (
  select *, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' end as said from j
), c as (
  select case when said = 'allow' then 0 else 1 end as walk, host, cast(count(*) as double) as n from s where said is not null group by 1, 2
), r0 as materialized (
  select walk, host, n / sum(n) over (partition by walk) as v from c
), l as (
  select src, dst, count(*) as links from (
    select host as src, translate(unnest(regexp_extract_all(coalesce(html, ''), 'href\s*=\s*["'']?(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#"''\s<>]*)', 1)), '{UPPER}', '{LOWER}') as dst from u
  ) where src <> '' and dst <> '' and src <> dst group by 1, 2
), g as (
  select 0 as walk, src as a, dst as b, links from l union all select 1, dst, src, links from l
), e as materialized (
  select walk, a, b, links / cast(sum(links) over (partition by walk, a) as double) as w from g
{walk}
), t as (
  select host, coalesce(sum(v) filter (walk = 0), 0.0) as trust, coalesce(sum(v) filter (walk = 1), 0.0) as distrust
  from (select walk, host, v / sum(v) over (partition by walk) as v from r{steps}) group by host
)
select page_id, s.host, s.path, s.rule,
       coalesce(said, case when coalesce(distrust, 0.0) > 2.0 * coalesce(trust, 0.0) then 'block' else 'allow' end) as verdict
from s left join t on s.host = t.host
"""


ORACLE = oracle()
ORACLE_LINKED = oracle(8, f"({LINKED}) as linked")
