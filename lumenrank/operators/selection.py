"""Confidence routing, deterministic choice and text, and evaluation summaries."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .quantiles import quantile


def confidence(df: DataFrame) -> DataFrame:
    """convergence, contradictions, fulfilment, confidence and route of each request's leading row.

    ``df`` has one row per request: the profile, the row's evidence, scores, ``top``
    and ``gap1``. A contradiction makes confidence low; a vague wish is never ``high``.
    """
    c = F.col
    misses = {
        "genre_miss": c("has_genres") & ~c("genre_match"),
        "avoid_hit": c("has_avoid") & c("avoid_hit"),
        "person_miss": c("has_people") & ~c("person_match"),
        "year_miss": c("has_year") & c("year_available") & ~c("year_match"),
        "runtime_miss": c("has_runtime") & c("runtime_available") & ~c("runtime_match"),
        "seed_miss": c("similar_request") & ~c("seed_match"),
    }
    clashes = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in misses.items()]))
    rating, votes = F.coalesce("rating", F.lit(0.0)), F.coalesce("votes", F.lit(0.0))
    safe = F.when(c("wants_quality"), (rating >= 6.8) & (votes >= 500) & (c("consensus") >= 0.60)).otherwise((rating >= 6.4) & (votes >= 120) & (c("consensus") >= 0.55))
    lexical, dense = F.coalesce(c("bm25_score") > 0, F.lit(False)), F.coalesce(c("sem_score") > 0, F.lit(False))
    df = df.withColumns({"contradictions": clashes, "convergence": F.when(lexical & dense, "strong").when(lexical | dense, "partial").otherwise("weak")})
    calm, top = F.size("contradictions") == 0, c("top")
    high = calm & (top >= 0.5) & (c("gap1") >= 0.05) & safe & ~c("fuzzy") & ~(c("wants_quality") & c("has_genres")) & (c("min_rating").isNull() | (rating >= c("min_rating")))
    level = F.when(high, "high").when(calm & (top >= 0.28), "medium").otherwise("low")
    done = df.withColumns({"fulfilment": F.when(calm & (top >= 0.5), "high").when(calm & (top >= 0.28), "medium").otherwise("low"), "confidence": level})
    return done.withColumn("route", F.when(c("confidence") == "high", "description_only").when((c("confidence") == "medium") & ~c("fuzzy"), "judge_5").otherwise("judge_8"))


def routed(shortlist: DataFrame, routes: DataFrame) -> DataFrame:
    """The rows of each request that its route hands on: one, five or eight."""
    most = F.create_map(*[F.lit(x) for kv in V.ROUTES.items() for x in kv])
    return shortlist.join(routes.select("request_id", "route"), "request_id").filter(F.col("rank") <= F.coalesce(F.element_at(most, F.col("route")), F.lit(1)))


#: Rating and votes from which a row counts as good.
GOOD_RATING, GOOD_VOTES = 6.5, 500
MATCHES = ("genre_match", "person_match", "year_match", "runtime_match", "seed_match")


def choose(shortlist: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: the best rated good one of the first three viable rows, else of the first five, else the first viable one with a rating.

    Viable rows meet all that was asked and nothing that was refused; where there are
    none, those without a refused hit are, else all. Without any rating the top row is it.
    ``shortlist`` has rank, rating, votes, avoid_hit and the match flags.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))
    hit = F.coalesce(F.col("avoid_hit"), F.lit(False))
    every = F.lit(True)
    for c in MATCHES:
        every = every & yes(c)
    group = Window.partitionBy(*by)
    df = shortlist.withColumn("__v", F.when(~hit & every, 0).when(~hit, 1).otherwise(2))
    df = df.withColumn("__viable", F.col("__v") == F.min("__v").over(group))
    df = df.withColumn("__at", F.row_number().over(Window.partitionBy(*by, "__viable").orderBy("rank")))
    rating, votes, viable = F.coalesce("rating", F.lit(0.0)), F.floor(F.coalesce("votes", F.lit(0.0))), F.col("__viable")
    good = viable & (rating >= GOOD_RATING) & (votes >= GOOD_VOTES)
    df = df.withColumn("__tier", F.when(good & (F.col("__at") <= 3), 0).when(good & (F.col("__at") <= 5), 1).when(viable & (rating > 0), 2).otherwise(3))
    order = ["__tier", F.when(F.col("__tier") < 2, -rating), F.when(F.col("__tier") < 2, -votes), "rank"]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__v", "__viable", "__at", "__tier", "__n")


def _listed(items: Column, most: int) -> Column:
    return T.natural_list(F.slice(items, 1, most))


def clipped(c: Column, n: int = 500, least: int = 260) -> Column:
    """At most ``n`` characters: up to the last sentence that ends past ``least``, else up to the last word, with a full stop."""
    head = F.rtrim(F.substring(c, 1, n))
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?]) ", 1)
    word = F.concat(F.regexp_replace(F.regexp_replace(head, r"(?s) [^ ]*$", ""), r"[ ,.;:]+$", ""), F.lit("."))
    return F.when(F.char_length(c) <= n, c).when(F.char_length(sentence) > least, sentence).otherwise(word)


def describe(df: DataFrame) -> Column:
    """A deterministic blurb of at most 500 characters: an opening, praise if quality was asked for, and why the item fits.

    ``df`` has title, genres, keywords and overview (comma lists and text), rating, votes,
    target_genres, tone, setting, wants_quality, min_rating, year_label, year_missing and
    open_request. The opening owns up to an era or genre that is missing; else its form varies with the title.
    """
    c = F.col
    blank = F.lit("")
    words = T.csv_list(c("keywords"))
    plain = F.filter(words, lambda k: ~F.contains(F.lower(k), F.lit("based on")))
    themes = F.when(F.size(plain) > 0, plain).otherwise(words)
    kinds = F.transform(T.csv_list(c("genres")), F.lower)
    targets = F.transform(F.slice(F.sort_array("target_genres"), 1, 4), F.lower)
    story = F.trim(F.coalesce(c("overview"), blank))
    told = F.concat(F.lit(" "), T.first_sentence(story))
    has_story, has_themes = story != "", F.size(themes) > 0
    appeal = F.when(has_themes, _listed(themes, 3)).otherwise(_listed(kinds, 2))
    asked = F.when(F.size("tone") > 0, _listed(c("tone"), 2)).when(c("setting") != "", c("setting")).otherwise(_listed(targets, 2))
    strengths = F.when(F.size(kinds) > 0, _listed(kinds, 2)).when(has_themes, F.concat(_listed(themes, 2), F.lit(" themes"))).otherwise("something new")
    missed_era = c("year_missing") & (F.coalesce(c("year_label"), blank) != "")
    missed_genre = (F.size(targets) > 0) & ~F.arrays_overlap(targets, kinds)
    form = T.checksum(c("title"), 4)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    title, lure = c("title"), F.when(appeal != "", appeal).otherwise("favourite")
    hook = (
        F.when(missed_era & has_story, say("Nothing from ", c("year_label"), " is in this catalogue, but ", title, " comes close in spirit.", told))
        .when(missed_era, say("Nothing from ", c("year_label"), " is in this catalogue, but ", title, " has the feel that you asked for."))
        .when(missed_genre & has_story, say("There is little pure ", _listed(targets, 2), " to offer, but ", title, " mixes ", _listed(kinds, 2), " in a way that may suit you.", told))
        .when(missed_genre, say(title, " is not strictly ", _listed(targets, 2), ", but its ", strengths, " could do as well."))
        .when(has_story & c("open_request"), say("As you are open to anything, take ", T.article(lure), " ", lure, ": ", title, ".", told))
        .when(has_story & (form == 0) & (asked != ""), say("If ", asked, " is the mood, look at ", title, ".", told))
        .when(has_story & (form == 1) & (appeal != ""), say(title, " is all about ", appeal, ".", told))
        .when(has_story & (form == 2), say(title, " could be one that you love.", told))
        .when(has_story, say("Consider ", title, ".", told))
        .when(has_themes, say(title, " lives on ", appeal, "."))
        .otherwise(say("Try ", title, "."))
    )
    rating, votes = F.coalesce("rating", F.lit(0.0)), F.coalesce("votes", F.lit(0.0))
    praise = (
        F.when((rating >= 8) & (votes >= 100_000), "Few films are as widely loved.")
        .when((rating >= 8) & (votes >= 10_000), "Those who know it rate it very highly.")
        .when((rating >= 7.2) & (votes >= 25_000), "It is popular with good reason.")
        .when((rating >= 7.2) & (votes >= 1_000), "Its viewers mostly like it a lot.")
        .when((rating > 0) & (votes > 0), "It is a lesser known pick.")
    )
    praise = F.when(c("wants_quality") | c("min_rating").isNotNull(), praise)
    pick = lambda *forms: F.element_at(F.array(*forms), (T.checksum(title, 3) + 1).cast("int"))
    mood, goal, kind = _listed(c("tone"), 2), _listed(targets, 2), _listed(kinds, 2)
    fit = (
        F.when(F.size("tone") > 0, pick(say("The feeling is ", mood, " throughout."), say("It suits a wish for something ", mood, "."), say("On the ", mood, " side it keeps its word.")))
        .when(c("setting") != "", say("The ", c("setting"), " is well drawn."))
        .when(F.size(targets) > 0, pick(say("A sound choice for ", goal, "."), say("Among ", goal, " it stands out."), say("For ", goal, " it does the job.")))
        .when(F.size(kinds) > 0, say("Good for ", T.article(kind), " ", kind, " evening."))
    )
    return clipped(F.concat_ws(" ", hook, praise, fit))


def evaluate(df: DataFrame, checks: list[str]) -> DataFrame:
    """checked, passed and match_score (1.0 where nothing is checked); a null check isn't counted."""
    checked = sum((F.col(c).isNotNull().cast("int") for c in checks), F.lit(0))
    passed = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in checks), F.lit(0))
    return df.withColumn("checked", checked).withColumn("passed", passed).withColumn("match_score", F.when(F.col("checked") == 0, 1.0).otherwise(F.round(F.col("passed") / F.col("checked"), 2)))


def with_median(df: DataFrame, value: Column, by: list[str] | None) -> DataFrame:
    """The rows with the median of their group, or of all, as ``__median``."""
    found = quantile(df, value, 0.5, by)
    if not by:
        return df.withColumn("__median", found.scalar())
    found = found.select(*[F.col(c).alias(f"__m{i}") for i, c in enumerate(by)], F.col("quantile").alias("__median"))
    return df.join(found, reduce(Column.__and__, [df[c].eqNullSafe(found[f"__m{i}"]) for i, c in enumerate(by)])).drop(*[f"__m{i}" for i in range(len(by))])


def summary(df: DataFrame, seconds: str, match: str, errors: Column, by: list[str] | None = None) -> DataFrame:
    """Counts, seconds and match scores of evaluated answers, in all or by group."""
    s, m = F.col(seconds), F.col(match)
    return with_median(df, s, by).groupBy(*(by or [])).agg(
        F.count("*").alias("n_cases"),
        F.count_if(errors).alias("n_errors"),
        F.round(F.avg(s), 6).alias("mean_s"),
        F.round(F.max("__median"), 6).alias("median_s"),
        F.min(s).alias("min_s"),
        F.max(s).alias("max_s"),
        F.round(F.avg(m), 6).alias("mean_match"),
        F.count_if(m == 1.0).alias("n_perfect"),
        F.count_if((m > 0) & (m < 1)).alias("n_partial"),
        F.count_if(m == 0).alias("n_zero"),
    )


CHECKS = ("genre_match", "person_match", "year_match", "language_match")


def report(df: DataFrame, by: list[str] | None = None, limit: float = V.BUDGET) -> DataFrame:
    """The whole summary of a run's results: seconds of answered cases, use of the model, repeats, and match scores of cases with something to check.

    ``df`` has error, runtime_s, used_llm, history_repeat, has_history, match_score,
    checked and the four check columns, null where a check doesn't apply.
    """
    fine, checked = F.coalesce(F.col("error"), F.lit("")) == "", F.col("checked") > 0
    s, m = F.when(fine, F.col("runtime_s").cast("double")), F.when(checked, F.col("match_score").cast("double"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return with_median(df, s, by).groupBy(*(by or [])).agg(
        F.count("*").alias("n_cases"),
        F.count_if(~fine).alias("n_errors"),
        F.round(F.avg(s), 6).alias("mean_s"),
        F.round(F.max("__median"), 6).alias("median_s"),
        F.min(s).alias("min_s"),
        F.max(s).alias("max_s"),
        share(s < limit).alias("share_in_time"),
        yes("used_llm").alias("n_llm"),
        yes("history_repeat").alias("n_repeats"),
        yes("has_history").alias("n_with_history"),
        F.count_if(checked).alias("n_constrained"),
        F.round(F.avg(m), 6).alias("mean_match"),
        F.count_if(m == 1).alias("n_perfect"),
        F.count_if((m > 0) & (m < 1)).alias("n_partial"),
        F.count_if(m == 0).alias("n_zero"),
        *[share(F.when(checked, F.col(c))).alias(f"{c}_rate") for c in CHECKS],
    )
