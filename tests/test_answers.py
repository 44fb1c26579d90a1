"""Prompts, answers and their evaluation, on rows small enough to read."""

from pyspark.sql import functions as F

from lumenrank.operators import answers, evaluation, parsing, prompts

LIST = [(1, 10, "Storm Race", 1), (1, 11, "Quiet Rain", 2), (1, 12, "Rain", 3)]


def shortlist(spark):
    return spark.createDataFrame(LIST, "request_id int, doc long, title string, rank int")


def test_answers(spark):
    cases = {
        '{"tmdb_id": "11"}': (11, "id"),
        'I say {"tmdb_id": 99, "title": "storm race"}': (10, "title"),
        '```json\n{"choice": "Storm"}\n```': (10, "title"),
        '{"title": "rain"}': (12, "title"),
        '{"title": "ai"}': (None, "none"),
        '{"description": "go and see Storm Race."}': (10, "mention"),
        '{"description": "Quiet Rain"}': (None, "none"),
        "nothing": (None, "none"),
    }
    told = spark.createDataFrame([(i, a) for i, a in enumerate(cases)], "request_id int, answer string").unionByName(spark.createDataFrame([(99, None)], "request_id int, answer string"))
    lists = told.select("request_id").join(shortlist(spark).drop("request_id"), how="cross")
    got = {r.request_id: (r.doc, r.how) for r in answers.resolve(told, lists).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] == (None, "none")


def test_evaluation(spark):
    rows = [
        ("a korean drama from the 90s with jo mill", ["jo mill"], "Drama", "Jo Mill", "", "1994", "ko", "South Korea", "genre:Y|person:Y|year:Y|lang:Y"),
        ("something new and scary", None, "Comedy", "", "", "1994", "", "", "genre:N|year:N"),
        ("anything", [], "Comedy", "", "", "", "", "", "no_constraints"),
        (None, None, None, None, None, None, None, None, "no_constraints"),
    ]
    df = spark.createDataFrame(rows, "text string, people array<string>, genres string, director string, top_cast string, year string, spoken_languages string, production_countries string, want string")
    assert all(r.match_details == r.want for r in evaluation.checks(df).collect())


def test_repeats(spark):
    df = spark.createDataFrame([(1, "A  b", [(None, "a B")]), (2, "x", [(2, None)]), (3, "y", [(4, "")]), (4, "", None)], "id long, title string, history array<struct<id:bigint,name:string>>")
    assert [r[0] for r in df.orderBy("id").select(evaluation.repeats(F.col("id"), F.col("title"), F.col("history"))).collect()] == [True, True, False, False]


def test_prompts(spark):
    rows = [(1, 10, "Storm Race", 1, 8.2, 200000.0, "Action, Drama, War", "Jo Mill", "Al Fa, Be Ta", "race", "Spain", "2020", "a fast race in the desert where " + "x" * 60)]
    df = spark.createDataFrame(rows, "request_id int, doc long, title string, rank int, rating double, votes double, genres string, director string, top_cast string, keywords string, production_countries string, year string, overview string")
    asked = spark.createDataFrame([(1, "a race by Jo Mill")], "request_id int, text string")
    said = prompts.selection(asked, df).first().prompt
    assert "10 | Storm Race (2020) | genres: Action, Drama | director: Jo Mill | keywords: race | quality signal: very strong | premise: a fast race in the desert where" in said
    assert "cast:" not in said and "country:" not in said and "xxx" not in said
    assert "Cast: Al Fa, Be Ta" in prompts.description(asked, df).first().prompt


def test_override(spark):
    rows = [(1, "a drama", (["Scary"], ["long  scenes"], ["Jo"], (1990, None), (None, None, True), " paris ", ["calm"], None, True, None)), (2, "a drama", None)]
    df = spark.createDataFrame(rows, f"request_id int, text string, override {parsing.OVERRIDE}")
    got = {r.request_id: r for r in parsing.profile(df).collect()}
    assert set(got[1].genres) == {"drama", "horror"} and got[1].avoid_phrases == ["long scenes"] and got[1].said_people == ["jo"]
    assert tuple(got[1].year) == (1990, 9999) and tuple(got[1].runtime) == (None, 110) and got[1].setting == "paris" and got[1].wants_quality
    assert got[2].genres == ["drama"] and got[2].year is None and got[2].tone == [] and not got[2].wants_quality
