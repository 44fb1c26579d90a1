"""A model's free-form answers to rows of their shortlists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_object import extract_object
from ..functions.text import normalize

#: Where a title may stand, in order of trust.
TITLE_KEYS = ("title", "movie", "name", "choice")


def field(column: str, key: str) -> Column:
    """A field of the answer's JSON object, also of one nested under ``selection``."""
    o = F.coalesce(extract_object(F.col(column)), F.lit("{}"))
    return F.coalesce(F.get_json_object(o, f"$.selection.{key}"), F.get_json_object(o, f"$.{key}"))


def resolve(answers: DataFrame, shortlist: DataFrame) -> DataFrame:
    """(request_id, doc, how) of every answer (request_id, answer); doc is null and how ``none`` where it names nothing.

    By id; else by each title key in turn, an equal title before the only one that
    holds or is held by it; else by the only title that the description mentions.
    ``shortlist`` has request_id, doc, title and rank. An answer meets its own
    shortlist's few rows alone. Of equal titles the last ranked counts.
    """
    parsed = answers.withColumn("o", F.coalesce(extract_object(F.col("answer")), F.lit("{}")))
    parsed = parsed.withColumn("o", F.coalesce(F.when(F.get_json_object("o", "$.selection").startswith("{"), F.get_json_object("o", "$.selection")), "o"))
    field = lambda k: F.get_json_object("o", f"$.{k}")
    parsed = parsed.select("request_id", field("tmdb_id").try_cast("double").cast("bigint").alias("id"), F.array(*[normalize(F.coalesce(field(k), F.lit(""))) for k in TITLE_KEYS]).alias("targets"), normalize(F.coalesce(field("description"), F.lit(""))).alias("told"))
    key = normalize(F.coalesce("title", F.lit("")))
    met = parsed.join(shortlist.select("request_id", "doc", "rank", key.alias("key")), "request_id", "left")
    target = lambda i: F.get("targets", F.lit(i))
    only = lambda c: F.when(F.count_if(c) == 1, F.max(F.when(c, F.col("doc"))))
    found = [F.max(F.when(F.col("doc") == F.col("id"), F.col("doc"))).alias("by_id")]
    for i in range(len(TITLE_KEYS)):
        named = target(i) != ""
        equal = F.max_by("doc", F.when(named & (F.col("key") == target(i)), F.col("rank")))
        part = named & (F.contains(target(i), "key") | F.contains("key", target(i)))
        found.append(F.coalesce(equal, only(part)).alias(f"by_title_{i}"))
    found.append(only((F.col("key") != "") & F.contains("told", "key")).alias("by_mention"))
    one = met.groupBy("request_id").agg(*found)
    titled = F.coalesce(*[F.col(f"by_title_{i}") for i in range(len(TITLE_KEYS))])
    how = F.when(F.col("by_id").isNotNull(), "id").when(titled.isNotNull(), "title").when(F.col("by_mention").isNotNull(), "mention").otherwise("none")
    return one.select("request_id", F.coalesce("by_id", titled, "by_mention").alias("doc"), how.alias("how"))
