"""The SQL names against the functions they stand for."""

from pyspark.sql import functions as F

from lumenrank.functions import sql
from lumenrank.functions import text as T
from lumenrank.operators.lexical import bm25
from lumenrank.sources.stages import timings, written

TEXTS = ["  SciFi and sci-fi, Sci Fi \t", "stories ties classes boxes watches glass bus this cats heroes", "Saga - The Return: Part 1", "Kill Bill: Vol. 2", "X 3", "it's o'clock", "", None, " A, b ,,a", "c++ and c", "1917"]


def test_sql_names_equal_functions(spark):
    assert set(sql.register(spark)) == set(sql.FUNCTIONS)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    df.createOrReplaceTempView("texts")
    t = F.col("t")
    mine = df.select(T.normalize(t), T.term_list(t), T.tokens(t), F.transform(T.term_list(t), T.stem), T.csv_set(t), T.csv_head(t, 2), T.title_root(t), T.mentions(t, F.lit("c++")), bm25(F.lit(3.0), F.lit(9.0), F.lit(7.0), F.lit(1.5)))
    named = spark.sql(
        "SELECT rank_normalize(t), rank_term_list(t), rank_tokens(t), transform(ws, w -> CASE WHEN false THEN w ELSE w END), rank_csv_set(t), rank_csv_head(t, 2), rank_title_root(t), rank_mentions(t, 'c++'), rank_bm25(3D, 9D, 7D, 1.5D) FROM (SELECT t, rank_term_list(t) AS ws FROM texts)"
    )
    got, want = ([tuple(r) for r in x.collect()] for x in (named, mine))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    words = spark.sql("SELECT w, rank_stem(w) AS s FROM (SELECT explode(ws) AS w FROM (SELECT rank_term_list(t) AS ws FROM texts))")
    assert all(r.s == r.f for r in words.withColumn("f", T.stem(F.col("w"))).collect())


def test_stages_are_timed(spark):
    timings()
    written(spark.range(7), "some")
    (name, seconds, rows), = timings()
    assert (name, rows) == ("some", 7) and seconds > 0 and timings() == []
