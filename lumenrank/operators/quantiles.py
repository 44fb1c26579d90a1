"""Exact quantiles of any number of rows: counts of ranges, narrowed until few values are left, in bounded memory."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import written

#: Ranges of a pass, and the rows of a range at most that are looked at one by one.
RANGES, ROWS = 1024, 10_000


def quantile(df: DataFrame, value: Column, p: float, by: list[str] | None = None) -> DataFrame:
    """``by`` and ``quantile`` as ``percentile`` defines it, between the order statistics around (n - 1) * p; null where a group has no value.

    Each pass counts a group's values by RANGES of equal width, with their ends, and goes on in the range that holds
    the wanted rank; the ends of what is left are values of it, so every pass narrows it. With ROWS values or fewer
    left, or a single one, they are ranked. A task only adds up counts; no buffer holds a group's values.
    """
    by = list(by or [])
    keys = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    key = [f"__by{i}" for i in range(len(by))]
    rows = df.select(*keys, value.cast("double").alias("__v"))
    ends = rows.groupBy(*key).agg(F.count("__v").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    at = (F.col("n") - 1) * F.lit(float(p))
    picks = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), f(at).cast("long").alias("k")) for i, f in enumerate((F.floor, F.ceil))]))
    state = ends.filter("n > 0").select(*key, picks.alias("x"), "lo", "hi", F.col("n").alias("inside"), F.lit(0).cast("long").alias("below")).select(*key, "x.which", "x.k", "lo", "hi", "inside", "below")
    group = [*key, "which"]
    # two rows for each group
    state = written(state, "quantiles")
    while state.filter((F.col("inside") > ROWS) & (F.col("lo") < F.col("hi"))).limit(1).count():
        share = F.when(F.col("lo") < F.col("hi"), (F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
        state = written(_picked(_inside(rows, state, key), group, F.least(F.lit(RANGES - 1), F.floor(share * RANGES))), "quantiles")
    found = _picked(_inside(rows, state, key), group, F.col("__v")).select(*group, "k", F.col("lo").alias("value"))
    both = found.groupBy(*key).agg(*[F.max(F.when(F.col("which") == i, F.col("value"))).alias(f"v{i}") for i in (0, 1)])
    out = _joined(ends, both, key, "left")
    share = at - F.floor(at)
    between = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise((1 - share) * F.col("v0") + share * F.col("v1"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(key, by)], between.alias("quantile"))


def _joined(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """A join by keys of which nulls are equal; without keys each side is a single group."""
    names = {k: f"{k}_r" for k in key}
    right = right.withColumnsRenamed(names)
    on = reduce(Column.__and__, [left[k].eqNullSafe(right[r]) for k, r in names.items()], F.lit(True))
    return left.join(F.broadcast(right) if not key else right, on, how).drop(*names.values())


def _inside(rows: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    met = _joined(rows.filter("__v is not null"), state, key)
    return met.filter(F.col("__v").between(F.col("lo"), F.col("hi")))


def _picked(rows: DataFrame, group: list[str], part: Column) -> DataFrame:
    """Of each group, the part that holds its wanted rank, as its new state. Parts are in the order of their values."""
    counts = rows.groupBy(*group, "k", "below", part.alias("__part")).agg(F.count("*").alias("inside"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    before = F.coalesce(F.sum("inside").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("below", F.col("below") + before)
    return counts.filter((F.col("below") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("inside"))).drop("__part")
