"""Bayesian quality of items, and the ratings overlay."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clip
from .quantiles import quantile


def effective(external: Column, native: Column) -> Column:
    """The external value where there is one above zero."""
    return F.when(external > 0, external).otherwise(native)


def add_quality(items: DataFrame, rating: str = "rating", votes: str = "votes", native: str | None = None) -> DataFrame:
    """bayesian, reliability, consensus of each item. Corpus statistics are found within the plan, the 0.7 quantile of votes in bounded memory.

    The prior is the mean of ratings above zero, else that of the ``native`` column, else 6.
    """
    r, v = clip(F.coalesce(F.col(rating).cast("double"), F.lit(0.0)), 0.0, 10.0), F.greatest(F.coalesce(F.col(votes).cast("double"), F.lit(0.0)), F.lit(0.0))
    base = items.withColumn("__r", r).withColumn("__v", v)
    own = F.col(native).cast("double") if native else F.lit(None).cast("double")
    told = base.agg(F.avg(F.nullif("__r", F.lit(0.0))).alias("own"), F.avg(F.nullif(clip(own, 0.0, 10.0), F.lit(0.0))).alias("native"), F.max("__v").alias("top"))
    c = told.select(F.coalesce("own", F.nullif("native", F.lit(0.0)), F.lit(6.0))).scalar()
    top = told.select(F.coalesce("top", F.lit(0.0))).scalar()
    m = F.greatest(F.lit(300.0), F.coalesce(quantile(base, F.col("__v"), 0.7).scalar(), F.lit(0.0)))
    v, r = F.col("__v"), F.col("__r")
    bayes = v / (v + m) * r + m / (v + m) * c
    reliability = clip(F.log1p(v) / F.greatest(F.log1p(top), F.lit(1.0)), 0.0, 1.0)
    return base.withColumn("bayesian", bayes).withColumn("reliability", reliability).withColumn("consensus", 0.72 * bayes / 10 + 0.28 * reliability).drop("__r", "__v")


def apply_overlay(base: DataFrame, overlay: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Upsert of the non-blank overlay fields by key, and whether any changed. Overlay keys are unique."""
    new = overlay.select(key, *[F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias(f"__{f}") for f in fields])
    met = base.join(new, key, "left")
    value = {f: F.coalesce(F.col(f"__{f}"), F.col(f).cast("string")) for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~value[f].eqNullSafe(F.col(f).cast("string"))
    return met.withColumn("changed", changed).withColumns(value).drop(*[f"__{f}" for f in fields])


def overlay_of(items: DataFrame, ratings: DataFrame, key: str = "tmdb_id", join: str = "imdb_id") -> DataFrame:
    """(key, join, rating fields): ratings of the items that share the joining id; blank ids meet nothing, and of several ids of a key the greatest counts."""
    ids = items.select(F.trim(F.col(key).cast("string")).alias(key), F.trim(F.col(join).cast("string")).alias(join)).filter(f"{key} <> '' and {join} <> ''")
    met = ids.join(ratings, join)
    rest = [c for c in met.columns if c != key]
    return met.groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def overlay_status(base: DataFrame, overlay: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: total, overlay, current, needing and unmatched rows. A row is current if every non-blank overlay field stands in the base already."""
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    new = overlay.select(key, *[blank(F.col(f)).alias(f"__{f}") for f in fields], F.lit(True).alias("__new"))
    old = base.select(key, *fields, F.lit(True).alias("__old"))
    met = old.join(new, key, "full_outer")
    says, same = F.lit(False), F.lit(True)
    for f in fields:
        says = says | F.col(f"__{f}").isNotNull()
        same = same & (F.col(f"__{f}").isNull() | F.col(f"__{f}").eqNullSafe(blank(F.col(f))))
    has, held = F.col("__new").isNotNull() & says, F.col("__old").isNotNull()
    return met.agg(
        F.count("__old").alias("total"),
        F.count("__new").alias("overlay"),
        F.count_if(has & held & same).alias("current"),
        F.count_if(has & held & ~same).alias("needing"),
        F.count_if(has & ~held).alias("unmatched"),
    )
