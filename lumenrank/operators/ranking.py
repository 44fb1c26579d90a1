"""Fusion, de-duplication, guards, diversification and the additive source score."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import RRF


def fuse(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of two hit lists by (request_id, doc); vote is also given over its maximum."""
    both = lexical.join(dense, ["request_id", "doc"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0))
    both = both.withColumn("vote", part("bm25_rank") + part("sem_rank"))
    top = F.max("vote").over(Window.partitionBy("request_id"))
    return both.withColumn("vote_score", F.col("vote") / top).na.fill(0.0, ["bm25_score", "sem_score"])


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in a total order (keep-first or keep-last is the order's direction)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).filter("__n = 1").drop("__n")


def _enough(keep: Column, least: int, by: list[str], present: Column) -> Column:
    """Whether at least min(least, present rows) of a group, and at least one, are kept."""
    w = Window.partitionBy(*by)
    n, ok = F.count_if(present).over(w), F.count_if(present & keep).over(w)
    return (ok > 0) & (ok >= F.least(F.lit(least), n))


def diversify(df: DataFrame, root: str, by: list[str], order: list[Column], k: int) -> DataFrame:
    """Top ``k`` per group with the first row of each root before its further ones; blank roots never wait."""
    again = F.row_number().over(Window.partitionBy(*by, root).orderBy(*order)) > 1
    late = df.withColumn("__late", F.when(F.coalesce(F.col(root), F.lit("")) == "", False).otherwise(again))
    late = late.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__late", *order))).filter(F.col("__n") <= k)
    return late.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).drop("__late", "__n")


def score_gaps(df: DataFrame, by: list[str], order: list[Column], score: str) -> DataFrame:
    """Per group: the top score and its distances to the second and fifth."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n <= 5")
    at = lambda k: F.max(F.when(F.col("__n") == k, F.col(score)))
    return ranked.groupBy(*by).agg(at(1).alias("top"), (at(1) - at(2)).alias("gap2"), (at(1) - at(5)).alias("gap5"))


#: What a met wish adds to an item's score.
MATCH = {"genre_match": 0.10, "person_match": 0.22, "year_match": 0.08, "runtime_match": 0.06, "avoid_hit": -0.35}


def consensus_weight(f: dict[str, Column]) -> Column:
    """How much an item's consensus counts for a request; less where a sub-genre is asked."""
    sub = f.get("subgenre_request", f.get("subgenre_overlap", F.lit(0)) > 0)
    return (
        F.when(f["quality_request"], F.when(sub, 0.28).otherwise(0.35))
        .when(f["broad_request"], F.when(sub, 0.18).otherwise(0.25))
        .when(f["needs_backup"], F.when(sub, 0.12).otherwise(0.18))
        .otherwise(0.08)
    )


def source_score(f: dict[str, Column]) -> Column:
    """The additive score; ``f`` names its inputs, all of which are columns (boolean unless numeric).

    Excluded rows score -10000 and rows of a wrong language or certificate -5000, whatever else they have.
    """
    yes = lambda k, v: F.when(F.coalesce(f[k], F.lit(False)), v).otherwise(0.0)
    rank = lambda k: F.coalesce(30.0 / (RRF + f[k]), F.lit(0.0))
    seed = F.when(f["seed_relation"] == "similar", 0.65).when(f["seed_relation"] == "recommended", 0.5).when(f["similar_request"] & f["seed_overlap"], 0.12).otherwise(0.0)
    source = F.when(f["constraint_source"] == "quality", F.when(f["needs_backup"], 0.45).otherwise(0.35)).when(f["constraint_source"] != "", 0.18).otherwise(0.0)
    weight = consensus_weight(f)
    match = sum((yes(k, v) for k, v in MATCH.items()), F.lit(0.0))
    total = rank("bm25_rank") + rank("sem_rank") + F.coalesce(seed, F.lit(0.0)) + F.coalesce(source, F.lit(0.0)) + match + 0.12 * F.least(F.lit(3), f["subgenre_overlap"]) + weight * f["consensus"]
    wrong = F.coalesce(f["wrong_language"], F.lit(False)) | F.coalesce(f["wrong_certificate"], F.lit(False))
    return F.when(F.coalesce(f["excluded"], F.lit(False)), -10000.0).when(wrong, -5000.0).otherwise(total)


def tag_or_append(df: DataFrame, matches: Column, source: str, order: list[Column], most: int | None = 20) -> DataFrame:
    """Present rows that match and have no source yet get ``source``; up to ``most`` matching absent rows of each request come in under it.

    ``df`` has request_id, present, constraint_source and recall columns; rows that come
    in have no recall. A request's rows are bounded, so its window is too.
    """
    match = F.coalesce(matches, F.lit(False))
    df = df.withColumn("__in", match).withColumn("__new", match & ~F.col("present"))
    if most is not None:
        n = F.row_number().over(Window.partitionBy("request_id", "__new").orderBy(*order))
        df = df.withColumn("__new", F.col("__new") & (n <= most))
    new = F.col("__new")
    tag = F.when(new | (F.lit(most is not None) & F.col("__in") & F.col("present") & (F.col("constraint_source") == "")), source).otherwise(F.col("constraint_source"))
    gone = {c: F.when(~new, F.col(c)) for c in ("bm25_rank", "sem_rank")} | {c: F.when(new, 0.0).otherwise(F.col(c)) for c in ("bm25_score", "sem_score", "vote_score")}
    return df.withColumns(gone | {"constraint_source": tag, "present": F.col("present") | new}).drop("__in", "__new")


def narrow(df: DataFrame, keep: Column, least: int, when: Column) -> DataFrame:
    """Present rows that don't pass leave, if at least min(least, present) of their request do, and ``when`` holds."""
    keep = F.coalesce(keep, F.lit(False))
    enough = _enough(keep, least, ["request_id"], F.col("present")) & F.coalesce(when, F.lit(False))
    return df.withColumn("__enough", enough).withColumn("present", F.col("present") & (keep | ~F.col("__enough"))).drop("__enough")


def second_stage(pool: DataFrame, order: list[Column], most: int, k: int) -> DataFrame:
    """The first ``most`` rows of each request, of them the first ``k``, and the three best lexical hits where a person is named."""
    at = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    first = pool.withColumn("__n", at).filter(F.col("__n") <= most)
    return first.filter((F.col("__n") <= k) | (F.col("has_people") & (F.col("bm25_rank") <= 3))).drop("__n")


def only(items: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """The items that ``ids`` names."""
    return items.join(ids.select(*on), on, "left_semi")


def without(items: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """The items that ``ids`` doesn't name."""
    return items.join(ids.select(*on), on, "left_anti")


def evidence(df: DataFrame) -> DataFrame:
    """The match flags of scored rows: what wasn't asked, or the catalogue can't have, counts as met; so does the constraint that brought a row in."""
    c = F.col
    met = {
        "genre_match": c("asked_genre") | ~c("has_genres"),
        "person_match": c("asked_person") | ~c("has_people"),
        "year_match": c("asked_year") | ~c("has_year") | ~c("year_available") | (c("constraint_source") == "year"),
        "runtime_match": c("asked_runtime") | ~c("has_runtime") | ~c("runtime_available") | (c("constraint_source") == "runtime"),
        "seed_match": ~c("similar_request") | (c("seed_relation") != "") | c("seed_overlap"),
    }
    return df.withColumns(met)
