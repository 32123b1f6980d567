"""URL filter: host and path rules, and trust and distrust spread over the link graph of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import ascii_lower, same, sized, stored

# The rules of the query (host and path prefix, verdict).
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
# Follow 85 of 100. Whole units of the mass of a kind, so that sums do not depend on their
# order; rounds between two stored tables; share of a seed's mass that may be left to move.
FOLLOW, UNITS, BATCH, TOLERANCE = 85, 10**30, 8, 1e-9
# Units and rounds of the SQL twin, which stops there.
MASS, ROUNDS = 10**12, 8


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def _ordered(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(rule, host, path, verdict), longest rule first."""
    cut = [(r, r[: r.index("/")], r[r.index("/") :], v) for r, v in rules]
    return sorted(cut, key=lambda x: (-len(x[0]), x[0]))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict; NULL where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, rule_host, rule_path, says in reversed(_ordered(rules)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts: src, dst."""
    targets = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))))
    links = pages.select(host_of(F.col("url")).alias("src"), targets.alias("dst"))
    links = links.select("src", ascii_lower(F.col("dst")).alias("dst"))
    return links.where("src <> '' AND src <> dst").distinct()


def spread(seeds: DataFrame, links: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: trust along links, distrust against them.

    ``seeds`` has kind (``allow`` or ``block``), host and n; the mass of a kind is shared
    among its seeds by n. Whole units (38 digits) make the result independent of task order.
    A passed share is rounded up, so a host that can be reached never has 0, however many
    seeds share the mass. Mass is added along paths of growing length until nothing moves, or
    until every seed has less than ``tolerance`` of its own mass to move and the last round
    reached no host for the first time. Both limits hold seed by seed, so a neighbourhood
    gets the same rounds in a small and in a large table. Returns kind, host, mass.
    """
    big = "decimal(38,0)"
    totals = seeds.groupBy("kind").agg(F.sum("n").cast(big).alias("total"))
    # floor(n * units / total) without a product of more than 38 digits
    units = UNITS * (100 - FOLLOW) // 100
    first = seeds.join(F.broadcast(totals), "kind").select("kind", "host", F.col("n").cast(big).alias("n"), "total", F.expr(f"cast({units} % total as {big})").alias("rest"))
    share = f"cast(n * cast(({units} - rest) / total as {big}) + floor(n * rest / total) as {big})"
    start = first.select("kind", "host", F.expr(share).alias("mass")).withColumn("moving", F.col("mass"))
    both = links.select(F.lit("allow").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("next")).unionByName(
        links.select(F.lit("block").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("next"))
    )
    degree = both.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("degree"))
    out = both.join(degree, ["kind", "host"]).select("kind", "host", "next", "degree")
    # the row of a host to itself (degree 0) keeps what has arrived
    stay = both.select("kind", "host").union(both.select("kind", F.col("next").alias("host"))).union(seeds.select("kind", "host")).distinct()
    hops = stored(out.unionByName(stay.select("kind", "host", F.col("host").alias("next"), F.lit(0).cast("long").alias("degree"))), "url-hops")
    part = f"cast(greatest(ceil(moving * {FOLLOW} / cast(100 * degree as decimal(20,0))), 1) as {big})"
    ranks, done = stored(start, "url-seeds"), 0
    while True:
        for _ in range(BATCH):
            moved = ranks.join(hops, ["kind", "host"]).where("degree = 0 OR moving > 0").select(
                "kind", F.col("next").alias("host"),
                F.expr(f"if(degree = 0, mass, {part})").alias("mass"), F.expr(f"if(degree = 0, cast(0 as {big}), {part})").alias("moving"),
            )
            ranks = moved.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("moving").alias("moving"))
        ranks, done = stored(ranks, "url-ranks"), done + BATCH
        at = ranks.agg(F.count_if(F.col("moving") > 0).alias("moving"), F.count_if(F.col("mass") == F.col("moving")).alias("new")).first()
        if at.moving == 0 or (at.new == 0 and (FOLLOW / 100) ** done <= tolerance):
            return ranks.select("kind", "host", "mass")


def distrusted_hosts(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """Hosts that receive more distrust than trust: host."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(host.alias("host"), rule_of(host, path, rules)[1].alias("kind")).where("kind IS NOT NULL")
    seeds = judged.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("n"))
    ranks = spread(seeds, host_links(pages), tolerance)
    mass = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0))
    return ranks.groupBy("host").agg(mass("block").alias("distrust"), mass("allow").alias("trust")).where("distrust > trust").select("host")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """Verdict for every page: page_id, host, path, rule, verdict.

    The longest fitting rule decides. Pages that no rule fits get the verdict of their
    host: ``block`` if more distrust than trust reaches it from the hosts of blocked and of
    allowed pages over any number of links (``spread`` says when it stops), else ``allow``
    (ties and hosts that neither reaches, too). Links are absolute or protocol-relative ``href``, ``src`` and
    ``action`` values; links within a host do not count. Mass of hosts without links is
    not passed on.

    NULL urls, and urls without ``://``, have an empty host and path and no rule. NULL html
    has no links. Repeated rows are judged alike, and count again as seeds; an empty table
    gives an empty result. Only page_id, url and html are read. A host with a third of all
    pages is one counted row; pages join the list of distrusted hosts by broadcast when it
    is short, else by an adaptive (skew-splitting) join.
    """
    bad = stored(distrusted_hosts(pages, rules, tolerance), "url-hosts").withColumn("_bad", F.lit(True))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    cut = cut.select("*", rule.alias("rule"), verdict.alias("_says"))
    joined = cut.alias("p").join(sized(bad).alias("b"), same("p", "b", "host"), "left")
    found = F.when(F.col("_bad"), "block").otherwise("allow")
    return joined.select("page_id", F.col("p.host").alias("host"), "path", "rule", F.coalesce("_says", found).alias("verdict"))


def sql(rules: Sequence[tuple[str, str]] = RULES, rounds: int = ROUNDS) -> str:
    rule = verdict = ""
    for name, host, path, says in _ordered(rules):
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN"
        rule, verdict = f"{rule} {fits} '{name}'", f"{verdict} {fits} '{says}'"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = LINK.replace("'", "''")
    steps = "".join(
        f""",
r{k + 1} AS (
  SELECT kind, host, CAST(sum(mass) AS BIGINT) AS mass FROM (
    SELECT r.kind, next AS host, r.mass * {FOLLOW} // (100 * degree) AS mass FROM r{k} r JOIN hops h ON r.kind = h.kind AND r.host = h.host
    UNION ALL SELECT kind, host, mass * {100 - FOLLOW} // 100 FROM r0) GROUP BY kind, host)"""
        for k in range(rounds)
    )
    return f"""
WITH cut AS (
  SELECT page_id, html, coalesce({lower.format(f"regexp_extract(url, '{HOST}', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '{PATH}', 1), '') AS path FROM pages),
judged AS (SELECT *, CASE{rule} END AS rule, CASE{verdict} END AS says FROM cut),
seeds AS (SELECT says AS kind, host, count(*) AS n FROM judged WHERE says IS NOT NULL GROUP BY 1, 2),
r0 AS (SELECT kind, host, CAST(n * ({MASS} // sum(n) OVER (PARTITION BY kind)) AS BIGINT) AS mass FROM seeds),
targets AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS dst FROM cut),
links AS (SELECT DISTINCT src, {lower.format('dst')} AS dst FROM targets WHERE src <> '' AND src <> {lower.format('dst')}),
both_ways AS (SELECT 'allow' AS kind, src AS host, dst AS next FROM links UNION ALL SELECT 'block', dst, src FROM links),
hops AS (SELECT *, count(*) OVER (PARTITION BY kind, host) AS degree FROM both_ways){steps},
bad AS (
  SELECT host FROM r{rounds} GROUP BY host
  HAVING sum(CASE WHEN kind = 'block' THEN mass ELSE 0 END) > sum(CASE WHEN kind = 'allow' THEN mass ELSE 0 END))
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""
