"""Rows that a request's people, quality, years or running time call for, best first, without pairing requests with the catalogue.

Lists. Every item stands in the lists of its year, its minutes, its people, the rating
floors it reaches and the whole catalogue, and in the parts of those that one genre,
language or certificate makes up. Lists don't depend on requests. They are cut into levels
by consensus, the only number of an item in an unrecalled row's score: the first level has about FIRST rows, each
further one makes what came so far four times as many.

Rounds. A request reads its lists level by level. What is left of a list can score at
most the request's weight times the consensus where the next level begins, plus the bonuses
that the list's rows can have. A request is done when its last kept row scores above that for all its
lists, or nothing is left. So the result is exact, and the rows scored for a request follow what it asks, not the size of the catalogue.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import matching, ranking
from ..operators.blockmax import levels
from ..sources.stages import release, written

#: Rows of a list's first level, about; and how many times as many rows each further level leads to.
FIRST, GROWTH = 256, 4
#: Steps of consensus by which levels are cut.
STEPS = 1000
FLOORS = (8.0, 7.4, 7.2)
#: Scores are rounded to six digits.
SLACK = 2e-6
WRONG = -5000.0
PAIR = ["request_id", "doc", "kind"]


def keys(items: DataFrame) -> DataFrame:
    """(list, doc, step): the lists that each item stands in."""
    texts = lambda *xs: F.array(*xs).cast("array<string>")
    said = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}:"), c.cast("string")))
    good = F.col("votes") >= 1000
    base = texts(F.lit("all:"), said("year", F.col("year_n")), said("minute", F.col("runtime_n")), *[F.when(good & (F.col("rating") >= f), f"floor:{f}") for f in FLOORS])
    marks = F.concat(
        texts(F.lit("*"), F.concat(F.lit("l:"), normalize(F.coalesce("original_language", F.lit("")))), F.concat(F.lit("c:"), normalize(F.coalesce("us_rating", F.lit(""))))),
        F.transform("genre_set", lambda g: F.concat(F.lit("g:"), g)),
    )
    lists = F.flatten(F.transform(F.array_compact(base), lambda b: F.transform(marks, lambda m: F.concat(b, F.lit("|"), m))))
    people = F.transform("people", lambda p: F.concat(F.lit("person:"), p, F.lit("|*")))
    step = F.floor(F.col("consensus") * STEPS).cast("int")
    return items.select("doc", step.alias("step"), F.explode(F.array_distinct(F.concat(lists, people))).alias("list"))


def levelled(entries: DataFrame) -> DataFrame:
    """(list, doc, level, ceiling): entries with their level, and the consensus that none of its rows exceeds."""
    cut = levels(entries, "list", F.col("step"), FIRST, GROWTH).withColumn("ceiling", (F.max("step").over(Window.partitionBy("list", "level")) + 1) / STEPS)
    return entries.join(cut.drop("through"), ["list", "step"]).select("list", "doc", "level", "ceiling")


def best(cursors: DataFrame, items: DataFrame, scored: Callable[[DataFrame], DataFrame], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows by ``order`` of each (request_id, kind), exactly.

    ``cursors``: request_id, kind, list, weight, bonus; a row of a list scores at most
    weight * consensus + bonus. ``scored`` turns (request_id, doc, kind) into rows with ``score`` and
    what ``order`` names, and leaves out rows that may not come. ``order`` begins with the score.
    """
    active = written(cursors, "cursors")
    if not active.limit(1).count():
        none = active.select("request_id", F.lit(None).cast(items.schema["doc"].dataType).alias("doc"), "kind")
        return active.sparkSession.createDataFrame([], scored(none).schema)
    asked = keys(items).join(active.select("list").distinct(), "list", "left_semi")
    entries = written(levelled(written(asked, "entries")), "lists")
    ceilings = written(entries.groupBy("list", "level").agg(F.max("ceiling").alias("ceiling")), "ceilings")
    group, kept, level = ["request_id", "kind"], None, 0
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    while level is not None:
        new = active.join(entries.filter(F.col("level") == level), "list").select(*PAIR).distinct()
        if kept is not None:
            new = new.join(kept.select(*PAIR), PAIR, "left_anti")
        rows = scored(new)
        if kept is not None:
            rows = rows.unionByName(kept)
        rows = written(rows.withColumn("__n", n).filter(F.col("__n") <= k).drop("__n"), "best")
        last = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("score").alias("last"))
        left = active.join(ceilings.filter(F.col("level") > level), "list")
        bound = left.groupBy(*group).agg(F.max(F.col("weight") * F.col("ceiling") + F.col("bonus") + SLACK).alias("bound"))
        open_ = bound.join(last, group, "left").filter("n is null or n < {k} or last <= bound".format(k=k)).select(*group)
        active = written(left.select(*active.columns).distinct().join(open_, group, "left_semi"), "cursors")
        kept = rows
        level = active.join(ceilings.filter(F.col("level") > level), "list").agg(F.min("level")).first()[0]
    release(entries, ceilings, active)
    return kept


def bonus(asked: DataFrame) -> Column:
    """The most that an unrecalled row without a seed's relation can add to its weighed consensus."""
    some = lambda c, v: F.when(c, v).otherwise(0.0)
    size = lambda c: F.size(c) > 0
    runtime = F.col("runtime.min").isNotNull() | F.col("runtime.max").isNotNull()
    return some(F.col("similar_request"), 0.12) + some(size("genres"), ranking.MATCH["genre_match"]) + some(size("people"), ranking.MATCH["person_match"]) + some(F.col("year").isNotNull(), ranking.MATCH["year_match"]) + some(runtime, ranking.MATCH["runtime_match"]) + 0.12 * F.least(F.lit(3), F.size("subgenre_keywords"))


def cursors(asked: DataFrame, items: DataFrame, narrowed: DataFrame) -> DataFrame:
    """(request_id, kind, list, weight, bonus): the lists that requests read.

    Where languages or certificates are asked, rows outside their lists are wrong and score -5000;
    else, where genres are asked, rows outside theirs lack that bonus. ``narrowed`` has the requests for quality that keep to their genres.
    """
    years = items.select(F.col("year_n").alias("y")).filter("y is not null").distinct()
    minutes = items.select(F.col("runtime_n").alias("m")).filter("m is not null").distinct()
    base = told(asked)
    span = lambda c: F.concat(F.lit(f"{c}:"), F.col(c[0]).cast("string"))
    by_year = base.filter("year is not null").join(years, F.col("y").between(F.col("year.min"), F.col("year.max"))).withColumns({"kind": F.lit("year"), "stem": span("year")}).drop("y")
    fits = (F.col("m") >= F.coalesce("runtime.min", F.lit(0))) & (F.col("m") <= F.coalesce("runtime.max", F.lit(10**6)))
    by_time = base.filter("runtime.min is not null or runtime.max is not null").join(minutes, fits).withColumns({"kind": F.lit("runtime"), "stem": span("minute")}).drop("m")
    floor = base.filter("needs_backup").withColumns({"kind": F.lit("quality"), "stem": F.concat(F.lit("floor:"), F.col("quality_floor").cast("string"))})
    aimed = floor.join(narrowed, "request_id", "left_semi").select(*_CURSOR, F.explode(F.transform("target_genres", lambda g: F.concat("stem", F.lit("|g:"), g))).alias("list"), "bonus")
    rest = floor.join(narrowed, "request_id", "left_anti")
    person = base.select("request_id", F.lit("person").alias("kind"), "weight", F.explode(F.transform("people", lambda p: F.concat(F.lit("person:"), p, F.lit("|*")))).alias("list"), "bonus")
    return reduce(DataFrame.unionByName, (person, aimed, *[marked(x) for x in (by_year, by_time, rest)])).distinct()


_CURSOR = ("request_id", "kind", "weight")


def told(asked: DataFrame) -> DataFrame:
    """Of requests, what their lists follow from."""
    f = {"quality_request": F.col("wants_quality"), "broad_request": F.col("broad_request"), "needs_backup": F.col("needs_backup"), "subgenre_request": F.size("subgenre_keywords") > 0}
    return asked.select("request_id", "year", "runtime", "people", "genres", "language", "certificates", "needs_backup", "quality_floor", "target_genres", ranking.consensus_weight(f).alias("weight"), bonus(asked).alias("bonus"))


def marked(rows: DataFrame) -> DataFrame:
    """The parts of the list ``stem`` that a request reads, and what their rows can score."""
    one = lambda m, w, b: F.struct(m.alias("mark"), w.alias("w"), b.alias("b"))
    whole, wrong = (lambda b: F.array(one(F.lit("*"), F.col("weight"), b))), F.array(one(F.lit("*"), F.lit(0.0), F.lit(WRONG)))
    parts = lambda prefix, xs: F.transform(xs, lambda x: one(F.concat(F.lit(prefix), x), F.col("weight"), F.col("bonus")))
    codes = F.col("language.codes")
    lists = (
        F.when(F.size(codes) > 0, F.concat(parts("l:", codes), wrong))
        .when(F.size("certificates") > 0, F.concat(parts("c:", F.col("certificates")), wrong))
        .when(F.size("genres") > 0, F.concat(parts("g:", F.col("genres")), whole(F.col("bonus") - ranking.MATCH["genre_match"])))
        .otherwise(whole(F.col("bonus")))
    )
    out = rows.select("request_id", "kind", "stem", F.explode(lists).alias("x"))
    return out.select("request_id", "kind", F.col("x.w").alias("weight"), F.concat("stem", F.lit("|"), "x.mark").alias("list"), F.col("x.b").alias("bonus"))


def seen(asked: DataFrame) -> DataFrame:
    """(request_id, doc): what must not come back, a row each."""
    return asked.select("request_id", F.explode("seen").alias("doc"))


def narrowed(asked: DataFrame, items: DataFrame) -> DataFrame:
    """(request_id): requests for quality of whose good rows at least min(5, all) have a wanted genre. Five of each are looked for, not all counted."""
    floor = asked.filter("needs_backup and size(target_genres) > 0")
    stem = F.concat(F.lit("floor:"), F.col("quality_floor").cast("string"))
    row = lambda kind, lists: floor.select("request_id", F.lit(kind).alias("kind"), F.explode(lists).alias("list"), F.lit(0.0).alias("weight"), F.lit(-1.0).alias("bonus"))
    every = row("any", F.array(F.concat(stem, F.lit("|*")))).unionByName(row("aimed", F.transform("target_genres", lambda g: F.concat(stem, F.lit("|g:"), g))))
    limits, genres, known = floor.select("request_id", "blocked_genres"), items.select("doc", "genre_set"), seen(floor)

    def eligible(pairs: DataFrame) -> DataFrame:
        rows = ranking.without(pairs, known, ["request_id", "doc"]).join(genres, "doc").join(limits, "request_id").filter(~matching.overlaps(F.col("genre_set"), F.col("blocked_genres")))
        return rows.select(*PAIR, F.lit(0.0).alias("score"))

    found = best(every, items, eligible, [F.desc("score"), F.col("doc")], 5)
    counts = found.groupBy("request_id").agg(F.count_if(F.col("kind") == "any").alias("n"), F.count_if(F.col("kind") == "aimed").alias("aimed"))
    return counts.filter("aimed >= n").select("request_id")
