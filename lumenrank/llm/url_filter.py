"""URL filters: fixed host rules, and link-graph propagation of trust and distrust. Native operations only.

Rules. A rule is (host, path prefix, verdict); it fits its host and all
subdomains if the URL's path starts with the prefix, and the longest one wins.

Propagation. URLs without a rule are judged by their host. Hosts of pages that a
rule allows are trusted seeds and hosts of blocked ones distrusted seeds, each by
the share of its pages. Trust runs along host edges (personalised PageRank),
distrust against them, since linking to a bad host is what marks a host. Trust
is split over a host's out-links; distrust isn't split over the hosts that link
to a bad one, which would shrink it with their number: a host takes over the
mean distrust of its own out-links, so a farm's size doesn't matter. A host
is blocked if its distrust reaches ``FLOOR`` and its part of both exceeds
``SHARE``. Edges are host pairs with a count, taken from absolute links.

Everything is host-sized after one aggregation that is partial before its
shuffle, so a host with a third of all pages is one row. Each round is one join
and one aggregation; scores are cut by checkpoints, and one number a round tells
the driver when to stop. Host verdicts are broadcast if there are at most
``BROADCAST_HOSTS``, else joined by shuffle, of which AQE splits hot hosts.

Defined cases: a null url or one without ``://`` has empty host and path, no rule
and the verdict ``allow``; null html has no links; repeated pages count as pages;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Fixed values of the contract: (host, path prefix, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DAMPING = 0.85
TOLERANCE = 1e-6
#: A bound only: DAMPING**200 is 8e-15, so TOLERANCE is reached before it even where a hundred million seeds lead to one host.
ROUNDS = 200
#: A seed that is all bad has distrust 1 - DAMPING by itself; half of that is the floor, up to four links away if all links lead there.
FLOOR = 0.075
SHARE = 0.5
BROADCAST_HOSTS = 100_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = None
    for name, prefix, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        value = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts of the absolute URLs in href attributes."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?(https?://[^\s"'<>]+)"""), F.lit(1))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(hrefs).alias("link"))
    return links.select("src", host_of(F.col("link")).alias("dst")).filter("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE, back: bool = False) -> DataFrame:
    """(host, score) from ``seeds`` (host, seed) over ``edges`` (src, dst, n), each weighed by its share of src's links.

    Personalised PageRank along the edges; with ``back``, against them.
    """
    start = cut(seeds.select("host", ((1 - damping) * F.col("seed")).alias("base")))
    now = start.select("host", F.col("base").alias("score"))
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    ends = (F.col("dst").alias("src"), F.col("src").alias("dst")) if back else (F.col("src"), F.col("dst"))
    steps = cut(edges.join(out, "src").select(*ends, (damping * F.col("n") / F.col("total")).alias("w")))
    if not steps.take(1):
        return now
    for _ in range(rounds):
        moved = steps.join(now, steps["src"] == now["host"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("w") * F.col("score")).alias("score"))
        nxt = cut(moved.unionByName(start.select("host", F.col("base").alias("score"))).groupBy("host").agg(F.sum("score").alias("score")))
        both = nxt.select("host", "score").unionByName(now.select("host", (-F.col("score")).alias("score")))
        change = both.groupBy("host").agg(F.abs(F.sum("score")).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0.0))).first()[0]
        now = nxt
        if change < tolerance:
            break
    return now


def judge_hosts(pages: DataFrame, rules=RULES, floor: float = FLOOR, share: float = SHARE) -> DataFrame:
    """host, trust, distrust, host_verdict of every host with a seed or a propagated score."""
    url = F.col("url")
    verdict = rule_of(F.col("host"), F.col("path"), rules)["verdict"]
    ruled = pages.select(host_of(url).alias("host"), path_of(url).alias("path")).filter("host != ''").select("host", verdict.alias("verdict"))
    part = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    hosts = cut(ruled.groupBy("host").agg(part("allow").alias("good"), part("block").alias("bad")))
    edges = cut(host_edges(pages))
    trust = propagate(hosts.filter("good > 0").select("host", F.col("good").alias("seed")), edges)
    distrust = propagate(hosts.filter("bad > 0").select("host", F.col("bad").alias("seed")), edges, back=True)
    both = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    scored = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    bad = (F.col("distrust") >= floor) & (F.col("distrust") > share * (F.col("trust") + F.col("distrust")))
    return scored.withColumn("host_verdict", F.when(bad, "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES, floor: float = FLOOR, share: float = SHARE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust."""
    hosts = cut(judge_hosts(pages, rules, floor, share))
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    url = F.col("url")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = split.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    met = ruled.join(F.broadcast(hosts) if few else hosts, "host", "left")
    return met.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
