"""Whether answers meet what their prompts plainly ask for. Its rules are coarser than those of request parsing, on purpose."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import csv_set, let
from . import parsing


def plain(c: Column) -> Column:
    """Lower case with single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def asked_years(text: Column) -> Column:
    """struct(min, max) by the evaluator's rules: decades from the fifties on, open ends at 1900 and 2030."""
    return let(plain(text), _years_of)


def _years_of(t: Column) -> Column:
    part = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("int")
    pair = lambda a, b: F.struct(F.lit(a).cast("int").alias("min"), F.lit(b).cast("int").alias("max"))
    decade, short = part(V.bordered(r"\b(19[5-9]0|20[0-2]0)s\b")), part(V.bordered(r"\b([5-9]0)s\b")) + 1900
    after, before, exact = (part(V.bordered(rf"\b{w}\s+(19\d\d|20\d\d)\b")) for w in ("after", "before", "(?:from|released in|in)"))
    rules = [(x.isNotNull(), pair(x, x + 9)) for x in (decade, short)]
    rules += [(after.isNotNull(), pair(after + 1, 2030)), (before.isNotNull(), pair(1900, before - 1)), (exact.isNotNull(), pair(exact, exact))]
    rules += [(t.contains("recent") | t.contains("new"), pair(2020, 2030)), (t.contains("classic") | t.contains("old"), pair(1900, 2000))]
    years = F
    for met, value in rules:
        years = years.when(met, value)
    return years


def asked_language(text: Column) -> Column:
    """The first term of the language table that stands anywhere in the text."""
    return let(plain(text), lambda t: F.coalesce(*[F.when(t.contains(k), F.lit(k)) for k in V.LANGUAGES]))


def repeats(item_id: Column, title: Column, history: Column) -> Column:
    """Whether an answer's id or title stands in a history of struct(id, name)."""
    same = lambda h: F.coalesce(h["id"] == item_id, F.lit(False)) | ((plain(h["name"]) != "") & (plain(h["name"]) == plain(title)))
    return F.coalesce(F.exists(history, same), F.lit(False))


def people_asked(prompts: DataFrame, items: DataFrame) -> DataFrame:
    """(request_id, people): names of the catalogue of more than three characters that stand in the prompt as whole words."""
    names = items.select(F.explode(F.array_union(csv_set(F.col("director")), csv_set(F.col("top_cast")))).alias("name")).filter("char_length(name) > 3")
    return parsing.named_from(prompts, names, 2**31 - 1).withColumnRenamed("names", "people")


def checks(df: DataFrame) -> DataFrame:
    """genre_match, person_match, year_match, language_match and match_details of answered prompts.

    ``df`` has text and people beside the answer's genres, director, top_cast, year,
    spoken_languages and production_countries. What isn't asked for is null.
    """
    genres = parsing.genres(plain(F.col("text")))
    cast = plain(F.concat_ws(" ", "director", "top_cast"))
    year = F.col("year").cast("string").try_cast("int")
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(*[F.array(*map(F.lit, v)).cast("array<string>").alias(n) for n, v in zip(("codes", "countries"), x)]) for kv in V.LANGUAGES.items() for x in kv])
    lang = F.element_at(table, asked_language(F.col("text")))
    spoken, places = plain(F.col("spoken_languages")), plain(F.col("production_countries"))
    found = F.exists(lang["codes"], lambda x: F.contains(spoken, x)) | F.exists(lang["countries"], lambda x: F.contains(places, x))
    span = asked_years(F.col("text"))
    out = {
        "genre_match": F.when(F.size(genres) > 0, F.arrays_overlap(genres, csv_set(F.col("genres")))),
        "person_match": F.when(F.size(F.coalesce("people", F.array().cast("array<string>"))) > 0, F.exists("people", lambda p: F.contains(cast, p))),
        "year_match": F.when(span.isNotNull() & year.isNotNull(), year.between(span["min"], span["max"])),
        "language_match": F.when(lang.isNotNull(), found),
    }
    df = df.withColumns(out)
    said = [F.when(F.col(k).isNotNull(), F.concat(F.lit(label + ":"), F.when(F.col(k), "Y").otherwise("N"))) for k, label in zip(out, ("genre", "person", "year", "lang"))]
    return df.withColumn("match_details", F.coalesce(F.nullif(F.concat_ws("|", *said), F.lit("")), F.lit("no_constraints")))


def timing(df: DataFrame, seconds: str, limit: float, by: list[str] | None = None) -> DataFrame:
    """Runs, mean, least and most seconds, and runs over a limit."""
    s = F.col(seconds).cast("double")
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n_runs"), F.round(F.avg(s), 6).alias("mean_s"), F.min(s).alias("min_s"), F.max(s).alias("max_s"), F.count_if(s >= limit).alias("n_over"))
