"""Hand-derived cases of single operators."""

import pytest
from pyspark.sql import functions as F

from lumenrank.functions import numbers as N
from lumenrank.functions import text as T
from lumenrank.functions.json_object import first_object
from lumenrank.operators import lexical, parsing, quality, ranking, selection


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column.alias("y")).collect()]


def test_stem(spark):
    assert values(spark, ["stories", "boxes", "glass", "bus", "cats", "war", "ties", "classes"], T.stem(F.col("x"))) == ["story", "box", "glass", "bus", "cat", "war", "tie", "class"]


def test_title_root(spark):
    assert values(spark, ["X: Part 2", "X 3", "A-B"], T.title_root(F.col("x"))) == ["x", "x", "a-b"]


def test_votes(spark):
    assert values(spark, ["12k", "3.4m", "1,234", "", None], N.votes(F.col("x"))) == [12000.0, 3400000.0, 1234.0, None, None]


def test_json_ints(spark):
    assert values(spark, ['[1,"2","x",3.5]', "nonsense", None], N.json_ints(F.col("x"))) == [[1, 2, 3], [], []]


def test_mentions(spark):
    assert values(spark, ["a war film", "warm film", "war"], T.mentions(F.col("x"), F.lit("war"))) == [True, False, True]


def test_bm25(spark):
    row = spark.range(1).select(lexical.bm25(F.lit(4.0), F.lit(10.0), F.lit(10.0), F.lit(1.0))).first()
    assert row[0] == pytest.approx(4 * 2.45 / 5.45)


def test_min_max_of_hits(spark):
    df = spark.createDataFrame([(1, 1, 9.0), (1, 2, 5.0), (1, 3, 1.0), (2, 1, 4.0)], "request_id int, doc int, x_raw double")
    got = {(r.request_id, r.doc): r.x_score for r in lexical.ranked(df, "x", 80).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.5, (1, 3): 0.0, (2, 1): 0.0}


def test_bayes(spark):
    df = spark.createDataFrame([(6.0, 0.0), (6.0, 0.0)], "rating double, votes double")
    assert [r.bayesian for r in quality.add_quality(df).collect()] == [6.0, 6.0]


def test_fusion(spark):
    hits = spark.createDataFrame([(1, 7, 1, 1.0)], "request_id int, doc int, bm25_rank int, bm25_score double")
    near = spark.createDataFrame([(1, 7, 1, 1.0)], "request_id int, doc int, sem_rank int, sem_score double")
    assert ranking.fuse(hits, near).first().vote == pytest.approx(2 / 61)


def test_narrow_keeps_a_group_without_enough(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(2)], "request_id string, v int").withColumn("present", F.lit(True))
    got = ranking.narrow(df, F.col("v") < 3, 8, F.lit(True)).filter("present").groupBy("request_id").count().collect()
    assert {r.request_id: r["count"] for r in got} == {"a": 10, "b": 2}


def test_years(spark):
    asked = ["after 2010", "since 2010", "between 2010 and 2005", "the 90s", "the 70s", "something set in the 1970s"]
    got = [(y["min"], y["max"]) if y else None for y in values(spark, asked, parsing.year_range(F.col("x")))]
    assert got == [(2011, 9999), (2010, 9999), (2005, 2010), (1990, 1999), None, None]


def test_runtimes(spark):
    got = [(r["min"], r["max"]) for r in values(spark, ["under 2.5 hours", "over 2.5 hours - epic length", "light-hearted"], parsing.runtime_range(F.col("x")))]
    assert got == [(None, 150), (150, None), (None, 110)]


def test_negations(spark):
    assert values(spark, ["comedy without any romance", "no war, please"], parsing.negations(F.col("x"))) == [["any romance"], ["war"]]


def test_longest_term_wins(spark):
    df = parsing.profile(spark.createDataFrame([("pg-13 korean film, horror but not scary",), (None,)], "text string")).collect()
    assert df[0].certificates == ["pg-13"] and df[0].language.codes == ["ko"] and df[0].genres == []
    assert df[1].language is None and df[1].genres == []


def test_evaluate(spark):
    df = spark.createDataFrame([(True, None), (None, None), (True, False)], "a boolean, b boolean")
    assert [r.match_score for r in selection.evaluate(df, ["a", "b"]).collect()] == [1.0, 1.0, 0.5]


def test_first_object():
    assert first_object('say {no} ```{"a": {"b": 1}}``` {"c": 2}') == '{"a": {"b": 1}}'
    assert first_object('{"a": ') is None and first_object(None) is None
