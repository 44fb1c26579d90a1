"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, its target share of the output divided
by its share of the input. A document appears as often as a Poisson variable of
that mean says, drawn by inversion from a hash of the seed and the document's id:
no state, no order, so a lost task gives the same copies when it runs again. The
copies are then dealt out by a hash of (seed, id, copy) and sorted by it, which
shuffles all of them globally.

The only aggregate is one count per source, partial before its shuffle. A rate
above ``PART`` is the sum of several equal Poisson parts, each with a seed of its
own, so the inversion tables stay short whatever the rate. The table of sources
is broadcast only if its inversion tables hold at most ``BROADCAST_CELLS`` cells
in all; beyond that it's an ordinary join, of which AQE splits hot sources.

Defined cases: a null source is a source of its own; a null id draws as the empty
string; rows that repeat an id repeat its draw; a source without a weight in an
explicit table has rate zero, so its documents don't appear; an empty table gives
an empty result. Texts aren't looked at, so nulls and long ones pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_name

SEED = "mix-1"
#: Target weight of a source: (its documents) ** ALPHA, which lifts small sources.
ALPHA = 0.5
#: Largest mean of one Poisson part.
PART = 32
BROADCAST_CELLS = 500_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 over the parts."""
    seed = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(seed, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def inversion_table(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson variable, as far as 48 bits can tell."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 25).cast("int")
    first = F.struct((-mean).alias("log_p"), F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("table"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(mean / k)
        p = acc["p"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), p.alias("p"), F.array_append(acc["table"], p).alias("table"))

    table = F.aggregate(F.sequence(F.lit(1), last), first, step, lambda acc: acc["table"])
    return F.when(mean > 0, table).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, size: float = 1.0, source_col: str = "source") -> DataFrame:
    """source, n_docs, rate. The rates bring ``size`` times as many documents in all, shared out by weight."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(alpha))
    else:
        named = [F.when(F.col("source") == F.lit(k), F.lit(float(v))) for k, v in weights.items()]
        weight = F.coalesce(*named, F.lit(0.0))
    counts = cut(counts.select("source", "n_docs", weight.alias("weight")))
    docs_in, weight_in = counts.agg(F.sum("n_docs"), F.sum("weight")).first()  # two numbers
    share = F.coalesce(F.try_divide(F.col("weight") * F.lit(float(docs_in or 0)), F.lit(float(weight_in or 0)) * F.col("n_docs")), F.lit(0.0))
    return counts.select("source", "n_docs", (share * size).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, size: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(row, copy, copies, rate, shuffle_key): ``row`` holds a document's columns, once per copy."""
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    table = rates(docs, weights, alpha, size, source_col).withColumn("parts", parts)
    table = cut(table.withColumn("table", inversion_table(F.col("rate") / F.col("parts"))).select(F.col("source").alias("of"), "rate", "parts", "table"))
    cells = table.agg(F.coalesce(F.sum(F.size("table") + 4), F.lit(0))).first()[0]
    row = fresh_name("row")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(row))
    near = F.broadcast(table) if cells <= BROADCAST_CELLS else table
    met = packed.join(near, packed[row][source_col].eqNullSafe(table["of"]))
    ident = F.coalesce(F.col(row)[id_col].cast("string"), F.lit(""))
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("parts") - 1),
        F.lit(0),
        lambda acc, j: acc + F.size(F.filter("table", lambda p: p < uniform(F.lit(seed), j.cast("string"), ident))),
    )
    copies = met.select(F.col(row).alias("row"), "rate", drawn.cast("long").alias("copies"), ident.alias("ident")).filter("copies > 0")
    each = copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "copies", "rate", "ident")
    return each.select("row", "copy", "copies", "rate", F.md5(F.concat_ws("|", F.lit(seed), F.lit("at"), "ident", F.col("copy").cast("string"))).alias("shuffle_key"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The replicated documents in a global random order, with the columns of ``docs``."""
    copies = replicate(docs, **options)
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select("row.*")
