"""Texts for a language model: one row per request, projected and aggregated from its shortlist."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import catalogue

PEOPLE_WORDS = "actor actors actress actresses cast star stars starring".split()
DIRECTOR_WORDS = ["director", "filmmaker"]
ANSWER = 'Answer with one JSON object and nothing else: {"tmdb_id": <id>, "description": "<at most 220 characters>"}'


def quality_signal(rating: Column, votes: Column) -> Column:
    r, v = F.coalesce(rating, F.lit(0.0)), F.coalesce(votes, F.lit(0.0))
    return F.when((r >= 8) & (v >= 100_000), "very strong").when((r >= 7.2) & (v >= 25_000), "strong").when((r >= 6.2) & (v >= 1000), "acceptable").when((r > 0) & (v > 0), "limited").otherwise("unknown")


def premise(c: Column, n: int) -> Column:
    """At most ``n`` characters; cut at a word's end if that keeps more than half of them."""
    whole = F.trim(F.coalesce(c, F.lit("")))
    head = F.rtrim(F.substring(whole, 1, n))
    kept = F.regexp_replace(head, r" [^ ]*$", "")
    cut = F.when((F.char_length(whole) > n) & (F.char_length(kept) > max(20, n // 2)) & (kept != head), kept).otherwise(head)
    return F.regexp_replace(cut, r"[ ,.;:]+$", "")


def selection(asked: DataFrame, shortlist: DataFrame, notes: Column | None = None) -> DataFrame:
    """(request_id, prompt) to choose one row of each shortlist.

    ``asked``: request_id, text and perhaps setting. ``shortlist``: request_id, doc,
    rank, rating, votes and the catalogue's text columns. Directors, cast and
    countries are told only where the request is about them: its words or names say so,
    or its profile holds ``people`` or ``countries``. A ``note`` column of ``asked`` is told as well.
    """
    low = T.normalize(F.coalesce("text", F.lit("")))
    words = T.tokens(F.col("text"))
    about = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    some = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0 if c in asked.columns else F.lit(False)
    rows = shortlist.join(asked.select("request_id", "text", (F.col("setting") if "setting" in asked.columns else F.lit("")).alias("setting"), low.alias("low"), (about(DIRECTOR_WORDS) | some("people")).alias("d"), (about(PEOPLE_WORDS) | some("people")).alias("c"), some("countries").alias("p"), (F.col("note") if "note" in asked.columns else F.lit("")).alias("__note")), "request_id")
    named = lambda c: F.exists(T.csv_set(F.col(c)), lambda x: F.contains("low", x))
    told = rows.groupBy("request_id").agg(*[F.coalesce(F.max(named(c)), F.lit(False)).alias(f"m_{c}") for c in ("director", "top_cast", "production_countries")])
    rows = rows.join(told, "request_id")
    field = lambda label, value, when=F.lit(True): F.when(when & (F.coalesce(value, F.lit("")) != ""), F.concat(F.lit(label), value))
    year = F.when(F.col("year").isNotNull() & (F.trim(F.col("year").cast("string")) != ""), F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise("")
    line = F.concat_ws(
        " | ",
        F.col("doc").cast("string"),
        F.concat("title", year),
        field("genres: ", T.csv_head(F.col("genres"), 2)),
        field("director: ", premise(F.col("director"), 40), F.col("d") | F.col("m_director")),
        field("cast: ", T.csv_head(F.col("top_cast"), 1), F.col("c") | F.col("m_top_cast")),
        field("keywords: ", T.csv_head(F.col("keywords"), 5)),
        field("country: ", T.csv_head(F.col("production_countries"), 2), F.col("p") | F.col("m_production_countries")),
        F.concat(F.lit("quality signal: "), quality_signal(F.col("rating"), F.col("votes"))),
        F.concat(F.lit("premise: "), F.coalesce(F.nullif(premise(F.col("overview"), 56), F.lit("")), F.lit("clear premise"))),
    )
    note = F.coalesce(F.col("__note") if notes is None else notes, F.lit(""))
    rows = rows.select("request_id", "text", "setting", note.alias("note"), F.struct("rank", line.alias("line")).alias("l"))
    one = rows.groupBy("request_id").agg(*[F.first(c).alias(c) for c in ("text", "setting", "note")], F.sort_array(F.collect_list("l")).alias("ls"))
    told_of = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    head = F.concat(F.lit("Choose one item for: "), F.coalesce("text", F.lit("")))
    return one.select("request_id", F.concat_ws("\n", head, told_of("Note: ", "note"), told_of("Setting: ", "setting"), F.lit(ANSWER), F.lit("Candidates:"), F.col("ls.line")).alias("prompt"))


def description(asked: DataFrame, chosen: DataFrame) -> DataFrame:
    """(request_id, prompt) to describe the row that is already chosen for each request."""
    rows = chosen.join(asked.select("request_id", "text"), "request_id")
    facts = [F.concat(F.lit(f"{label}: "), F.nullif(v, F.lit(""))) for label, v in (("Genres", T.csv_head(F.col("genres"), 3)), ("Director", F.trim("director")), ("Cast", T.csv_head(F.col("top_cast"), 2)), ("Keywords", T.csv_head(F.col("keywords"), 6)), ("Premise", premise(F.col("overview"), 220)))]
    asks = F.concat(F.lit("Say in one or two sentences why this item suits the request: "), F.coalesce("text", F.lit("")))
    return rows.select("request_id", F.concat_ws("\n", asks, F.concat(F.lit("Item: "), "title"), *facts, F.lit('Answer with one JSON object: {"description": "<at most 220 characters>"}')).alias("prompt"))


def profile_of(asked: DataFrame) -> DataFrame:
    """What prompts and routing need of a profile: four genres, three tones, five hints, six refusals, and what else the request speaks of."""
    return asked.select(
        "request_id",
        F.slice(F.sort_array("genres"), 1, 4).alias("target_genres"),
        F.slice("tone", 1, 3).alias("tone"),
        F.slice(F.array_distinct("hints"), 1, 5).alias("keyword_hints"),
        F.slice("avoid_phrases", 1, 6).alias("avoid"),
        (F.col("year").isNotNull() | F.col("year_said")).alias("year_relevant"),
        "year",
        "runtime",
        "min_rating",
        F.col("wants_quality").alias("quality_preference"),
        F.col("setting").alias("setting_period"),
        (F.size("countries") > 0).alias("country_relevant"),
    )


def baseline(asked: DataFrame, items: DataFrame, most: int = 5) -> DataFrame:
    """(request_id, prompt): the plain recommender, which shows every request the same ``most`` items of most votes.

    ``asked``: request_id, text and history array<struct<id, name>>. ``items``: tmdb_id, title, year, genres, overview, vote_count.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    best = catalogue.most_voted(items, most).withColumn("__v", F.col("vote_count").cast("string").try_cast("double"))
    line = F.concat(F.lit("- "), text("tmdb_id"), F.lit(" | "), text("title"), F.lit(" ("), text("year"), F.lit(") | genres: "), text("genres"), F.lit(" | overview: "), F.substring(text("overview"), 1, 200))
    shown = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("__v")).alias("v"), "tmdb_id", line.alias("line")))).alias("ls")).select(F.array_join(F.col("ls.line"), "\n").alias("lines"))
    past = F.array_join(F.transform("history", lambda h: F.concat(F.coalesce(h["name"], F.lit("")), F.lit(" ("), F.coalesce(h["id"].cast("string"), F.lit("?")), F.lit(")"))), ", ")
    asks = F.concat(F.lit("Choose one item for: "), F.coalesce("text", F.lit("")))
    seen = F.concat(F.lit("Already seen: "), F.coalesce(F.nullif(past, F.lit("")), F.lit("none")))
    return asked.crossJoin(F.broadcast(shown)).select("request_id", F.concat_ws("\n", asks, seen, F.lit(ANSWER), F.lit("Candidates:"), "lines").alias("prompt"))
