"""Ends of texts, borders of words and positions of rows: what odd letters and second runs of a plan may not change."""

from pyspark.sql import functions as F

from lumenrank.functions import sql
from lumenrank.functions import text as T
from lumenrank.operators import parsing
from lumenrank.sources import catalogue


def test_chunks_of_many_rows_are_those_of_their_order(spark):
    """Ranges are drawn from samples, so that a second run of the plan has other borders."""
    df = spark.range(0, 300_000, 1, 7).select(F.xxhash64("id").alias("key"), "id")
    rows = sorted((r.key, r.chunk) for r in catalogue.chunked(df, [F.col("key")], 10).collect())
    assert [c for _, c in rows] == [i // 10 for i in range(300_000)]


def test_sql_names_keep_letters_at_the_ends(spark):
    sql.register(spark)
    df = spark.createDataFrame([("f for half of",), ("\f\x0b if \f",), ("fff",)], "t string")
    df.createOrReplaceTempView("ends")
    named = [r[0] for r in spark.sql("SELECT rank_normalize(t) FROM ends").collect()]
    assert named == [r[0] for r in df.select(T.normalize(F.col("t"))).collect()] == ["f for half of", "if", "fff"]


def test_word_borders_are_those_of_ascii(spark):
    """As in SQL: a letter beyond ASCII ends a word."""
    texts = ["übest film", "bestü", "sobest", "best1", "shorté", "éthis decade", "score>=7 rating", "above 7 rating", "ünon-war", "under 2 hoursé"]
    df = spark.createDataFrame(list(enumerate(texts)), "request_id int, text string")
    got = parsing.profile(df).orderBy("request_id").collect()
    assert [r.wants_quality for r in got] == [True, True, False, False] + [False] * 6
    assert got[4].short_requested and got[5].year.min == 2020 and got[6].min_rating == 7 and got[7].min_rating == 7
    assert got[8].blocked_genres == ["War"] or "non" in got[8].avoid_tokens
    assert got[9].runtime.max == 120
