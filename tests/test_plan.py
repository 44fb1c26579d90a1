"""The whole plan, over a small catalogue, and resumable enrichment."""

import os

from pyspark.sql import functions as F

from lumenrank.operators import parsing
from lumenrank.plans.recommend import recommend, shortlist
from lumenrank.sources import catalogue as C
from lumenrank.sources import stages

ROWS = [
    (1, "Storm Race", "Action", "a fast race in the desert", "2020", "100", "8.1", "250000"),
    (2, "Storm Race: Part 2", "Action", "another race through the storm", "2021", "110", "7.2", "90000"),
    (3, "Quiet Rain", "Drama, Romance", "rain over a small town", "1994", "95", "7.9", "12k"),
    (4, "Night Clown", "Horror", "a clown in the rain at night", "2019", "88", "6.1", "3000"),
    (5, "Old Court", "Drama", "a trial and a verdict", "1957", "96", "9.0", "1.1m"),
]


def items(spark):
    df = spark.createDataFrame(ROWS, "tmdb_id long, title string, genres string, overview string, year string, runtime_min string, vote_average string, vote_count string")
    return C.ensure_columns(df)


def asked(spark):
    rows = [(1, "a race action movie since 2018", [(None, "Storm Race")]), (2, "drama with rain, no horror", []), (3, "", []), (4, None, [])]
    return spark.createDataFrame(rows, "request_id int, text string, history array<struct<id:bigint,name:string>>")


def test_shortlist(spark):
    before = set(os.listdir(stages.folder(spark)))
    rows = shortlist(items(spark), asked(spark)).collect()
    left = set(os.listdir(stages.folder(spark))) - before
    assert len(left) == 1 and left.pop().endswith("shortlist"), "the tables of earlier stages are gone"
    by = {}
    for r in rows:
        by.setdefault(r.request_id, []).append(r)
    assert 1 not in {r.doc for r in by[1]}, "the history's title must not come back"
    assert all(r.year_n >= 2018 for r in by[1])
    assert 4 not in {r.doc for r in by[2]}, "horror is blocked"
    for found in by.values():
        found.sort(key=lambda r: r.rank)
        assert len(found) <= 10 and [r.rank for r in found] == list(range(1, len(found) + 1))
        assert all(a.score >= b.score for a, b in zip(found, found[1:]))


def test_recommend(spark):
    got = {r.request_id: r for r in recommend(items(spark), asked(spark)).collect()}
    assert got[1].doc == 2 and got[2].doc == 5, "the best rated viable item of the top three"
    assert all(len(r.description) <= 500 and r.route in ("description_only", "judge_5", "judge_8") for r in got.values())


def test_ratings_last_wins(spark):
    t = spark.createDataFrame([("t1 ", "7", "1"), (" t1", "8", "2"), ("", "9", "3")], "tconst string, averageRating string, numVotes string").coalesce(1)
    assert [tuple(r) for r in C.ratings(t).collect()] == [("t1", "8", "2")]


def test_seeds_pull_their_neighbours(spark):
    df = items(spark).drop("similar_tmdb_ids").withColumn("similar_tmdb_ids", F.when(F.col("tmdb_id") == 1, "[5]").otherwise(""))
    ask = spark.createDataFrame([(1, "something like Storm Race", [])], "request_id int, text string, history array<struct<id:bigint,name:string>>")
    got = {r.doc: r for r in shortlist(df, ask).collect()}
    assert 1 not in got and got[5].constraint_source == "seed" and got[5].score > 0.65


def test_subgenre_keywords(spark):
    row = spark.createDataFrame([("a courtroom drama",)], "text string").select(parsing.subgenre_keywords(F.col("text")).alias("k")).first()
    assert "verdict" in row.k
