"""Readers of files, and a stream of requests."""

import json

from pyspark.sql import functions as F
from test_plan import items

from lumenrank.sources import catalogue as C
from lumenrank.sources import vectors
from lumenrank.streaming.requests import answer_stream


def test_catalogue_files(spark, tmp_path):
    base, better = tmp_path / "base.csv", tmp_path / "enriched.csv"
    base.write_text('tmdb_id,title,overview\n1,"A ""big"", film","two\nlines"\n2,,\n')
    rows = C.read_catalogue(spark, str(better), str(base)).orderBy("tmdb_id").collect()
    assert [(r.tmdb_id, r.title, r.overview, r.genres) for r in rows] == [("1", 'A "big", film', "two\nlines", ""), ("2", "", "", "")]
    assert set(C.CATALOGUE) <= set(rows[0].asDict())
    better.write_text("tmdb_id,title\n7,New\n")
    assert [r.title for r in C.read_catalogue(spark, str(better), str(base)).collect()] == ["New"]
    assert C.active_path(spark, str(better), str(base)) == str(better) and not C.exists(spark, str(tmp_path / "no"))
    found = C.lookup(C.read_catalogue(spark, str(base)), spark.createDataFrame([(1,), (5,)], "doc long"))
    assert {r.doc: r.title for r in found.collect()} == {1: 'A "big", film', 5: "Unknown"}


def test_ratings_files(spark, tmp_path):
    file = tmp_path / "title.ratings.tsv"
    file.write_text("tconst\taverageRating\tnumVotes\ntt1\t7.5\t100\n tt1\t8.0\t200\n\t1\t1\n")
    row, = C.read_ratings(spark, str(file)).collect()
    assert (row.imdb_id, row.imdb_rating, row.imdb_votes, row.imdb_source, row.updated_at) == ("tt1", "8.0", "200", "title.ratings.tsv", "")
    assert C.read_ratings(spark, str(tmp_path / "none.tsv")).collect() == []
    file.write_text("a\tb\n1\t2\n")
    assert C.read_ratings(spark, str(file)).collect() == []


def test_most_voted_and_prompts(spark, tmp_path):
    votes = spark.createDataFrame([(1, "10"), (2, "x"), (3, "30"), (4, "30"), (5, None)], "tmdb_id long, vote_count string")
    assert [r.tmdb_id for r in C.most_voted(votes, 2).collect()] == [3, 4]
    (tmp_path / "p.csv").write_text('# a remark\npreference,watch_history\n"a, b",x\n')
    assert [tuple(r) for r in C.read_prompts(spark, str(tmp_path / "p.csv")).collect()] == [("a, b", "x")]


def test_json_objects_of_any_layout(spark, tmp_path):
    vectors.write_json(spark, str(tmp_path / "meta"), {"b": 1, "a": [2]})
    assert vectors.read_json(spark, str(tmp_path / "meta")) == {"a": [2], "b": 1}
    (tmp_path / "own.json").write_text('{\n "rows": 3\n}\n')
    assert vectors.read_json(spark, str(tmp_path / "own.json")) == {"rows": 3}
    assert vectors.metadata(spark, str(tmp_path / "nothing")) == {}


def test_answers_of_a_stream(spark, tmp_path):
    inbox, got = tmp_path / "inbox", []
    inbox.mkdir()
    (inbox / "1.json").write_text(json.dumps({"request_id": 4, "text": "drama with rain, no horror", "history": []}) + "\n")
    requests = spark.readStream.schema("request_id int, text string, history array<struct<id:bigint,name:string>>").json(str(inbox))
    query = answer_stream(requests, items(spark), lambda answers, n: got.extend(answers.select("request_id", "doc", F.lit(n).alias("batch")).collect()), str(tmp_path / "checkpoint"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [tuple(r) for r in got] == [(4, 5, 0)]
