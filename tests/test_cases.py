"""Cases of scalar functions with the results that their rules demand, written by hand."""

import pytest
from pyspark.sql import functions as F

from lumenrank.functions import numbers as N
from lumenrank.functions import text as T
from lumenrank.functions import values as V
from lumenrank.operators import enrichment, hooks, parsing, selection
from lumenrank.plans import service
from lumenrank.sources.package import ship


def _list(c):
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def _joined(c):
    return F.array_join(c, "|")


_LONG = "word " * 40
_DETAIL = (
    '{"belongs_to_collection":{"id":10,"name":"Saga"},"similar":{"results":[{"id":1,"title":"A"},{"id":2},{"title":"C"}]},"recommendations":{"results":[{"id":9,"original_title":"Orig"},{"id":8,"title":"","original_title":"Alt"}]},'
    '"alternative_titles":{"titles":[{"title":"X"},{"title":"x"},{"title":" Y "}]},"spoken_languages":[{"english_name":"French"},{"name":"Deutsch"},{"english_name":"french"}],'
    '"release_dates":{"results":[{"iso_3166_1":"FR","release_dates":[{"certification":"12"}]},{"iso_3166_1":"us","release_dates":[{"certification":" "},{"certification":"PG-13"}]}]}}'
)
_INTENT = (
    'Sure {"genres":["drama","sci-fi","nope"],"avoid":[" a  b ","c","d","e"],"release_year":{"min":1980,"max":1989},"runtime":{"max":100},"setting_period":" in  paris ","tone_modifiers":["dark"],'
    '"quality_preference":true,"country_or_language":["Korean"]}'
)


def _metadata(c):
    return F.concat_ws("~", *enrichment.flat_metadata(c).values())


def _intent(c):
    return F.to_json(hooks.sanitised(c, F.array(*map(F.lit, ("Drama", "Science Fiction", "War")))))


#: title, genres, keywords, overview, rating, votes, target genres, tone, setting, wants_quality, year label, open request; and what is said of it
_BLURBS = [
    (("Storm", "Action, War", "race, based on a book, desert", "A fast race in the desert. It ends badly.", 8.2, 200000.0, ["action"], [], "", False, "", False), "Storm is all about race and desert. A fast race in the desert. It ends badly. For action it does the job."),
    (("Rain", "Drama", "", "", 8.1, 20000.0, ["drama"], [], "", True, "", False), "Try Rain. Those who know it rate it very highly. Among drama it stands out."),
    (("Old", "Drama, War", "trial", "A trial.", 7.0, 10.0, ["drama"], [], "", True, "1950s", False), "Nothing from 1950s is in this catalogue, but Old comes close in spirit. A trial. It is a lesser known pick. For drama it does the job."),
    (("Old", "Drama", "", None, 0.0, 0.0, [], [], "", True, "1950s", False), "Nothing from 1950s is in this catalogue, but Old has the feel that you asked for. Good for a drama evening."),
    (("Clown", "Horror", "night, rain", "A clown.", 6.0, 5.0, ["comedy", "animation"], [], "", False, "", False), "There is little pure animation and comedy to offer, but Clown mixes horror in a way that may suit you. A clown. For animation and comedy it does the job."),
    (("Clown", None, "night, rain", "", 6.0, 5.0, ["comedy"], [], "", False, "", False), "Clown is not strictly comedy, but its night and rain themes could do as well. For comedy it does the job."),
    (("Anna", "Adventure", "", "She walks.", 7.5, 30000.0, [], [], "", False, "", True), "As you are open to anything, take an adventure: Anna. She walks. Good for an adventure evening."),
    (("Alba", "Drama", "sea", "A sea.", 7.3, 26000.0, [], ["calm", "warm", "x"], "", True, "", False), "If calm and warm is the mood, look at Alba. A sea. It is popular with good reason. On the calm and warm side it keeps its word."),
    (("D", "Drama", "", "A day.", 0.0, 0.0, [], [], "set in 1990", False, "", False), "If set in 1990 is the mood, look at D. A day. The set in 1990 is well drawn."),
    (("E", "Drama", "a, b, c, d", "An end.", 0.0, 0.0, [], [], "", False, "", False), "E is all about a, b, and c. An end. Good for a drama evening."),
    (("G", "", "", "A gap.", 0.0, 0.0, [], [], "", False, "", False), "Consider G. A gap."),
    (("Rain", "Drama", "", "It rains.", 0.0, 0.0, [], [], "", False, "", False), "Rain could be one that you love. It rains. Good for a drama evening."),
    (("G", "", "sea", "", 0.0, 0.0, [], [], "", False, "", False), "G lives on sea."),
]
_BLURB = "title string, genres string, keywords string, overview string, rating double, votes double, target_genres array<string>, tone array<string>, setting string, wants_quality boolean, year_label string, open_request boolean"

_BODIES = [
    ('{"user_id": 3, "preferences": " a film ", "history": [{"tmdb_id": 5, "name": "Up"}, {"tmdb_id": "", "name": "x"}, "skip", {"tmdb_id": 6, "name": " "}]}', (3, "a film", '[{"id":5,"name":"Up"}]', None)),
    ("nope", (None, None, None, "invalid JSON")),
    ("[1]", (None, None, None, "not an object")),
    ('{"preferences": " "}', (None, None, None, "empty preferences")),
    ('{"preferences": "x"}', (1, "x", "[]", None)),
    ('{"user_id": "abc", "preferences": "x"}', (None, None, None, "invalid values")),
    ('{"preferences": "x", "history": [{"tmdb_id": "q", "name": "n"}]}', (None, None, None, "invalid values")),
    (None, (None, None, None, "invalid JSON")),
]

#: An override on "a drama, not scary, from 1999", and genres, refusals, people, years, running time, setting, tones and places after it.
_OVERRIDES = [
    (None, "drama|scary||1999-1999|1999|-||0|0|false"),
    ('{"genres":["Sci-Fi","scary"],"avoid":["Long  scenes"],"people":["Jo Mill"],"year":{"min":1980,"max":1989},"runtime":{"short":true},"setting":" paris ","tone":["a","b","c","d","e"],"quality":true,"countries":["Korea"]}', "drama,science fiction|scary,long scenes|jo mill|1980-1989|1980-1989|-110|paris|4|1|true"),
    ('{"year":{"min":0,"max":1989},"runtime":{"min":90},"genres":[" "]}', "drama|scary||1999-1999|1999|90-||0|0|false"),
]


def _mentions(c):
    return T.mentions(F.split_part(c, F.lit("~"), F.lit(1)), F.split_part(c, F.lit("~"), F.lit(2)))


CASES = {}


def cases(name, told, value, doc):
    CASES[name] = told, value


cases("title_roots", [("X: Part 2", "x"), ("X 3", "x"), ("A-B", "a-b"), ("Chapter 27", ""), ("Saga - The Return: Part 1", "saga"), ("Kill Bill: Vol. 2", "kill bill"), ("The Hangover Part III", "the hangover"), ("Rocky 4 Episode", "rocky"), ("1917", ""), ("Sci-Fi Volume One tale", "science fiction"), (" Department 7 ", "department"), (None, "")], T.title_root, "Franchise roots of titles.")
cases("word_stems", [("stories", "story"), ("ties", "tie"), ("classes", "class"), ("boxes", "box"), ("watches", "watch"), ("glass", "glass"), ("bus", "bus"), ("this", "this"), ("cats", "cat"), ("war", "war"), ("heroes", "hero"), ("axes", "axe"), ("quizzes", "quizz"), ("ies", "ies"), ("flies", "fly"), ("lies", "lie")], T.stem, "Stems of words.")
cases("one_spelling", [("  SciFi and sci-fi, Sci Fi ", "science fiction and science fiction, science fiction"), ("A b", "a b")], T.normalize, "One spelling of a genre, in lower case.")
cases("code_fences", [('```json\n{"a": 1}\n```', '{"a": 1}'), ("plain", "plain"), ("```only", "```only"), ("```\nx```", "x"), ("``````", "```"), ("  ```\n y \n``` ", "y")], T.strip_fence, "Answers without their code fences.")
cases("limited_texts", [("short", "short"), ("a sentence that is certainly longer than thirty", "a sentence that is certainly"), ("averyveryverylongwordwithoutspacesatall", "averyveryverylongwordwithoutsp"), (None, "")], lambda c: T.limited(c, 30), "Texts of thirty characters, cut at a word.")
cases(
    "first_sentences",
    [
        ("A short one. Then more text follows here and there.", "A short one. Then more text follows here and there."),
        ("Mr. Smith goes to the big city of light and shadow. He stays.", "Mr. Smith goes to the big city of light and shadow."),
        ("What a truly amazing and wonderful thing this is! And so on.", "What a truly amazing and wonderful thing this is!."),
        (_LONG, ("word " * 35).strip() + "."),
        ("one, ", "one."),
    ],
    T.first_sentence,
    "First sentences, past short forms and short openings.",
)
cases("natural_lists", [("a", "a"), ("a,b", "a and b"), ("a,b,c", "a, b, and c"), ("", "")], lambda c: T.natural_list(T.csv_list(c)), "Lists as people say them.")
cases("articles", [("apple", "an"), ("Big", "a"), ("Odd", "an"), ("", "a")], T.article, "Articles by the first letter.")
cases("comma_heads", [("a, ,b,c", "a, b"), ("x", "x")], lambda c: T.csv_head(c, 2), "The first two items of comma lists.")
cases("comma_sets", [("A, b ,,a", "a|b"), (None, "")], lambda c: _joined(T.csv_set(c)), "Distinct lower-case items of comma lists.")
cases("comma_lists", [("a, B ,,c", "a|B|c"), (" ", "")], lambda c: _joined(T.csv_list(c)), "Items of comma lists as written.")
cases("word_caps", [("  a  b \n c d", "a b c"), ("one", "one")], lambda c: T.word_cap(c, 3), "Three words with single spaces.")
cases("json_number_sets", [('[1,"2","x",3.5,-3.5]', "1|2|3|-3"), ("[1, 1, 2]", "1|2"), ("nonsense", ""), ('{"a":1}', ""), (None, "")], lambda c: _joined(F.transform(N.json_ints(c), lambda x: x.cast("string"))), "Whole numbers of JSON lists; fractions are cut off.")
cases("json_string_sets", [('["a"," b ","","a"]', "a|b"), ("X, y ,x", "x|y"), ("", "")], lambda c: _joined(N.json_strings(c)), "Strings of JSON lists, else of comma lists.")
cases("json_texts", [('["a","b c"]', "a b c"), ("plain text", "plain text"), ('{"a":1}', '{"a":1}'), ("", ""), ('["x",null]', "x ")], T.json_text, "JSON lists as text.")
cases("list_texts", [('["A","a"," b"]', "A, b"), ("X, x, Y", "X, Y"), (None, "")], enrichment.list_text, "Lists as text, items once whatever their case.")
cases("clean_keyword_lists", [('["Sci_Fi"," robots. ","ROBOTS","","' + "x" * 49 + '"]', "sci fi|robots")], lambda c: _joined(T.clean_keywords(_list(c))), "Keywords in one form.")
cases("allowed_tag_lists", [('["Dark","dark","nope"," GRITTY ","warm","bleak","moody"]', "dark|gritty|warm|bleak"), ("[]", "")], lambda c: _joined(T.allowed_tags(_list(c), V.TONE_TAGS, 4)), "Tags of a closed vocabulary, four at most.")
cases("title_checksums", [("AB", "3"), ("", "0"), ("é", "1")], lambda c: T.checksum(c, 4), "Checksums that pick a text's form.")
cases("three_decimals", [("0.0625", "0.062"), ("0.1875", "0.188"), ("-0.0625", "-0.062"), ("2", "2.0")], lambda c: N.rounded(c.try_cast("double")), "Three decimals, half to even.")
cases("plain_numbers", [("1,234", "1234.0"), (" 7.5 ", "7.5"), ("n/a", None), ("", None)], N.number, "Numbers with thousands commas.")
cases("phrase_borders", [("a war film~war", "true"), ("warm film~war", "false"), ("war~war", "true"), ("pg-13!~pg-13", "true"), ("c++ and c~c++", "true"), ("post-war~war", "true")], _mentions, "Phrases with no letter or digit beside them.")
cases("history_cells", [('["Heat","Up"]', "Heat|Up"), ("['Heat', 'Up']", "Heat|Up"), ("Heat; Up, Down", "Heat|Up, Down"), ("Heat, Up", "Heat|Up"), ("", ""), ('"Heat"', "Heat"), ("'Heat, two'", "Heat, two"), ('{"tmdb_id": 5, "name": "Up"}', '{"tmdb_id": 5, "name": "Up"}'), ("1999", "1999"), (None, "")], lambda c: _joined(service.history_cell(c)), "History cells of prompt tables.")
cases("history_lists", [('["Up",{"tmdb_id":"7","name":"Heat"},{"tmdb_id":7,"name":"Heat"},{"name":""},{"tmdb_id":"x","name":"Q"},{"tmdb_id":2}]', '[{"id":2,"name":""},{"id":7,"name":"Heat"},{"name":"Q"},{"name":"Up"}]'), ("[]", "[]")], lambda c: F.to_json(service.history_items(F.from_json(c, "array<string>"))), "Histories in canonical order.")
cases("metadata_columns", [(_DETAIL, '10~Saga~[1,2]~["A","C"]~[9,8]~["Orig","Alt"]~["X","Y"]~French, Deutsch~PG-13'), ("{}", "~~[]~[]~[]~[]~[]~~")], _metadata, "Catalogue columns of metadata objects.")
cases("intent_overrides", [(_INTENT, '{"genres":["Drama","Science Fiction"],"avoid":["a b","c","d"],"year":{"min":1980,"max":1989},"runtime":{"max":100,"short":false},"setting":"in paris","tone":["dark"],"quality":true,"countries":["Korean"]}'), ("no object", None), ('{"release_year":{"min":2000,"max":1990},"runtime":{"short_requested":true}}', '{"runtime":{"max":110,"short":true},"setting":""}')], _intent, "What a model found in a request, within its limits.")
cases("clipped_texts", [("x" * 20, "x" * 20), ("one two three. four five six seven", "one two three."), ("averylongword and, othermore things", "averylongword and.")], lambda c: selection.clipped(c, 22, 10), "Texts cut at a sentence, else at a word.")


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    ship(spark)
    told, value = CASES[name]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(told)], "i int, given string").coalesce(1)
    got = {r.i: r.result for r in rows.select("i", value(F.col("given")).cast("string").alias("result")).collect()}
    assert [got[i] for i in range(len(told))] == [want for _, want in told]


def test_descriptions(spark):
    rows = spark.createDataFrame([(i, *told) for i, (told, _) in enumerate(_BLURBS)], "i int, " + _BLURB)
    made = rows.withColumns({"year_missing": F.col("year_label") != "", "min_rating": F.lit(None).cast("double")})
    got = {r.i: r.description for r in made.select("i", selection.describe(made).alias("description")).collect()}
    assert [got[i] for i in range(len(_BLURBS))] == [said for _, said in _BLURBS]


def test_payloads(spark):
    rows = service.payloads(spark.createDataFrame([(i, b) for i, (b, _) in enumerate(_BODIES)], "i int, body string"))
    got = {r.i: (r.user_id, r.text, r.h, r.error) for r in rows.select("i", "user_id", "text", F.to_json("history").alias("h"), "error").collect()}
    assert [got[i] for i in range(len(_BODIES))] == [want for _, want in _BODIES]


def test_overrides(spark):
    rows = spark.createDataFrame([(i, "a drama, not scary, from 1999", o) for i, (o, _) in enumerate(_OVERRIDES)], "i int, text string, o string")
    got = parsing.profile(rows.withColumn("override", F.from_json("o", parsing.OVERRIDE)))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    listed = lambda c: F.array_join(c, ",")
    parts = [listed(F.sort_array("genres")), listed("avoid_phrases"), listed("said_people"), F.concat_ws("-", text(F.col("year.min")), text(F.col("year.max"))), text(F.col("year_label")), F.concat(text(F.col("runtime.min")), F.lit("-"), text(F.col("runtime.max"))), "setting", F.size("tone").cast("string"), F.size("said_countries").cast("string"), F.col("wants_quality").cast("string")]
    told = {r.i: r.result for r in got.select("i", F.concat_ws("|", *parts).alias("result")).collect()}
    assert [told[i] for i in range(len(_OVERRIDES))] == [want for _, want in _OVERRIDES]
