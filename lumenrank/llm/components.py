"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: A node with more than one of this many links is a hub. There are at most twice as many hubs, whatever the input.
HUBS = 1000


def _with_least(rows: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``rows`` (u, v) with the least neighbour m of u, from ``least`` (u, m, n).

    Hubs, with over ``most`` links of their own, are broadcast, and their rows are
    dealt by v as well, so that no task gets all links of one; the others meet by u.
    """
    hubs = least.filter(F.col("n") > most).select("u", F.col("m").alias("hub_m"))
    deal = F.when(F.col("hub_m").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) + 1)
    marked = rows.join(F.broadcast(hubs), "u", "left").withColumn("deal", deal)
    own = least.select("u", F.col("m").alias("own_m"), F.lit(0).cast("long").alias("deal"))
    return marked.join(own, ["u", "deal"], "left").select("u", "v", F.coalesce("hub_m", "own_m").alias("m"))


def _stars(links: DataFrame, most: int) -> DataFrame:
    """Large-star, then small-star, over links (u, v) with u > v."""
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = links.select(F.inline(ends).alias("u", "v"))  # one pass over the links, and no union, which would double the tasks
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    large = _with_least(both.filter("v > u"), least, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = cut(large.filter("u > v").distinct())
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    # A row that holds the least neighbour stays, and the others link theirs to it.
    moved = _with_least(large, least, most).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u > v").distinct()


def _state(links: DataFrame) -> tuple:
    """The number of distinct links and two sums of their hashes, which tell whether a round changed any."""
    key = F.xxhash64("u", "v")
    sums = (F.sum(F.pmod(h, F.lit((1 << 31) - 1))) for h in (key, F.xxhash64(key)))
    return tuple(links.agg(F.count("*"), *sums).first())


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node with a link; root is the least node of its component.

    ``links`` has columns u and v of one orderable type; order, repeats and loops
    don't matter. Links stay in the cluster: each round is two aggregations and
    two joins, each with a checkpoint, and only counters reach the driver. The
    number of links never grows, and the rounds end when every link points from a
    node to a root and none changes. A node with over 1 / ``HUBS`` of the links is
    joined by broadcast, and its links are aggregated before any shuffle.
    """
    now = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    state = _state(now)
    for _ in range(most_rounds):
        now = cut(_stars(now, max(16, state[0] // HUBS)))
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
