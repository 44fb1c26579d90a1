"""Queries of the scalar functions over the tables' own texts and columns, each beside its DuckDB SQL.

``given`` is one SQL expression that both engines compute from a row; Spark maps it through
a function of this library, and the SQL says independently what must come out.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import text as T
from .functions import values as V
from .operators import enrichment, hooks, parsing, selection
from .plans import service
from .sources.catalogue import dealt
from .sources.package import ship

#: White space, as SQL.
WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SPOKEN, PART = ("conversations", "conv_id, turn"), ("part", "p_partkey")


def _list(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def _joined(c: Column) -> Column:
    return F.array_join(c, "|")


def normal_sql(x: str) -> str:
    return f"replace(replace(replace(lower(trim(coalesce({x}, ''), {WHITE})), 'scifi', 'science fiction'), 'sci-fi', 'science fiction'), 'sci fi', 'science fiction')"


def stem_sql(x: str) -> str:
    return f"""CASE WHEN length({x}) <= 3 THEN {x} WHEN {x} LIKE '%ies' AND length({x}) > 4 THEN left({x}, length({x}) - 3) || 'y'
      WHEN regexp_matches({x}, '(ches|shes|xes|zes|sses|oes)$') AND length({x}) > 4 THEN left({x}, length({x}) - 2)
      WHEN {x} LIKE '%s' AND NOT regexp_matches({x}, '(ss|us|is)$') THEN left({x}, length({x}) - 1) ELSE {x} END"""


_ITEMS = "list_filter(list_transform(string_split(coalesce(g, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
_HEAD = "rtrim(substring(trim(coalesce(g, '')), 1, {n}))"


def _sentence_sql() -> str:
    """The first sentence of a text of one line."""
    ends = [
        f"list_min(list_filter(range(1, length(h) + 1), lambda i: substr(h, i, 2) = '{m} ' AND NOT regexp_matches(left(h, i - 1), '({T.SHORT_FORMS})$')))"
        for m in ".!?"
    ]
    long = [f"CASE WHEN {e} > 41 THEN left(h, {e}) END" for e in ends]
    kept = "regexp_replace(h, ' [^ ]*$', '')"
    word = f"CASE WHEN NOT regexp_matches(h, '[.!?]$') AND length(coalesce(g, '')) > 180 AND length({kept}) > 90 THEN {kept} ELSE h END"
    return f"regexp_replace(coalesce({', '.join(long)}, {word}), '[ ,.;:]+$', '') || '.'"


_ROW = "p_name || '|' || p_brand"
#: A metadata object, a model's answer, a request's body and an override, each made from a part.
_DETAIL = """'{"belongs_to_collection":{"id":' || p_partkey || ',"name":"' || p_brand || '"},"similar":{"results":[{"id":' || p_size || ',"title":"' || p_name || '"},{"id":2},{"title":"C"}]},"recommendations":{"results":[{"id":9,"original_title":"' || p_type || '"},{"id":8,"title":"","original_title":"Alt"}]},"alternative_titles":{"titles":[{"title":"' || p_name || '"},{"title":"' || upper(p_name) || '"},{"title":" Y "}]},"spoken_languages":[{"english_name":"French"},{"name":"' || p_type || '"},{"english_name":"french"}],"release_dates":{"results":[{"iso_3166_1":"FR","release_dates":[{"certification":"12"}]},{"iso_3166_1":"us","release_dates":[{"certification":" "},{"certification":"' || CASE WHEN p_size < 20 THEN 'R' ELSE 'PG-13' END || '"}]}]}}'"""
_INTENT = """'Sure {"genres":["' || CASE WHEN p_size % 2 = 0 THEN 'drama' ELSE 'sci-fi' END || '","' || p_type || '"],"avoid":[" a  ' || p_brand || ' ","c","d","e"],"release_year":{"min":' || (1950 + p_size) || ',"max":' || (1970 + p_size % 7) || '},"runtime":{"max":' || (60 + p_size) || '},"setting_period":" in  ' || p_name || ' ","tone_modifiers":["dark"],"quality_preference":true,"country_or_language":["Korean"]}'"""
_BODY = """CASE p_partkey % 5 WHEN 0 THEN '{"user_id": ' || p_partkey || ', "preferences": " ' || p_name || ' ", "history": [{"tmdb_id": ' || p_size || ', "name": "' || p_brand || '"}, {"tmdb_id": "", "name": "x"}, "skip"]}' WHEN 1 THEN '{"preferences": "' || p_type || '"}' WHEN 2 THEN 'no json: ' || p_name WHEN 3 THEN '{"user_id": "' || p_brand || '", "preferences": "x"}' ELSE '{"preferences": " ", "user_id": ' || p_size || '}' END"""
_OVERRIDE = """'{"genres":["' || CASE WHEN p_size % 2 = 0 THEN 'Sci-Fi' ELSE 'war' END || '"],"avoid":["' || p_type || '  scenes"],"people":["' || p_brand || '"],"year":{"min":' || (1960 + p_size) || ',"max":' || (1980 + p_size % 9) || '},"runtime":{"min":' || p_size || '},"setting":" ' || p_name || ' ","tone":["a","b","c","d","e"],"quality":' || CASE WHEN p_size < 9 THEN 'true' ELSE 'false' END || ',"countries":["Korea"]}'"""


def _metadata(c: Column) -> Column:
    return F.concat_ws("~", *enrichment.flat_metadata(c).values())


def _mentions(c: Column) -> Column:
    return T.mentions(F.split_part(c, F.lit("~"), F.lit(1)), F.lower(F.split_part(c, F.lit("~"), F.lit(2))))


#: name: (table and keys, given, function, SQL with ``g`` and the table's columns, what it is)
QUERIES: dict[str, tuple[tuple[str, str], str, Callable[[Column], Column], str, str]] = {
    "title_roots": (PART, "p_name || CASE p_partkey % 7 WHEN 0 THEN ': Part ' || p_size WHEN 1 THEN ' ' || p_size WHEN 2 THEN ' - the ' || p_type WHEN 3 THEN ' Chapter ' || p_size || ' of it' WHEN 4 THEN ' Vol. 2' WHEN 5 THEN '-volume' ELSE ' Department 7 ' END", T.title_root, r"trim(regexp_replace(trim(regexp_replace(split_part(split_part(NORMAL, ' - ', 1), ':', 1), '\b(part|chapter|episode|vol|volume)\b.*$', '')), '\b\d+\b$', ''))".replace("NORMAL", normal_sql("g")), "Franchise roots of titles."),
    "word_stems": (PART, "split_part(lower(p_type), ' ', 1) || CASE p_partkey % 8 WHEN 0 THEN 'ies' WHEN 1 THEN 'ches' WHEN 2 THEN 's' WHEN 3 THEN 'ss' WHEN 4 THEN 'xes' WHEN 5 THEN 'us' WHEN 6 THEN 'oes' ELSE '' END", T.stem, stem_sql("g"), "Stems of words."),
    "one_spelling": (SPOKEN, "'  ' || text || CASE turn % 3 WHEN 0 THEN ' SciFi' WHEN 1 THEN ' a Sci-Fi b ' ELSE ' sci fi' END", T.normalize, normal_sql("g"), "One spelling of a genre, in lower case."),
    "code_fences": (SPOKEN, "CASE turn % 4 WHEN 0 THEN ' ```json' || chr(10) || text || chr(10) || '```' WHEN 1 THEN text WHEN 2 THEN '```' || text || '```' ELSE '``` ' || chr(10) || ' ' || text END", T.strip_fence, rf"CASE WHEN starts_with(trim(g, {WHITE}), '```') THEN trim(regexp_replace(regexp_replace(trim(g, {WHITE}), '^[^\n]*\n', ''), '```$', ''), {WHITE}) ELSE trim(g, {WHITE}) END", "Answers without their code fences."),
    "limited_texts": (SPOKEN, "text", lambda c: T.limited(c, 30), f"CASE WHEN length(trim(coalesce(g, ''))) > 30 AND length(regexp_replace({_HEAD.format(n=30)}, ' [^ ]*$', '')) > 20 AND contains({_HEAD.format(n=30)}, ' ') THEN rtrim(regexp_replace({_HEAD.format(n=30)}, ' [^ ]*$', '')) ELSE {_HEAD.format(n=30)} END", "Texts of thirty characters, cut at a word."),
    "first_sentences": (SPOKEN, "CASE turn % 3 WHEN 0 THEN 'Mr. ' WHEN 1 THEN 'Short. ' ELSE '' END || replace(text, chr(10), ' ')", T.first_sentence, _sentence_sql().replace("h)", "rtrim(substring(coalesce(g, ''), 1, 180)))").replace("h,", "rtrim(substring(coalesce(g, ''), 1, 180)),").replace("ELSE h END", "ELSE rtrim(substring(coalesce(g, ''), 1, 180)) END"), "First sentences, past short forms and short openings."),
    "natural_lists": (PART, "CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ',' || p_type WHEN 2 THEN p_brand || ', ' || p_type || ' , ' || p_size ELSE ' ' END", lambda c: T.natural_list(T.csv_list(c)), f"CASE len({_ITEMS}) WHEN 0 THEN '' WHEN 1 THEN {_ITEMS}[1] WHEN 2 THEN array_to_string({_ITEMS}, ' and ') ELSE array_to_string({_ITEMS}[:-2], ', ') || ', and ' || {_ITEMS}[-1] END", "Lists as people say them."),
    "articles": (SPOKEN, "text", T.article, "CASE WHEN lower(substr(g, 1, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END", "Articles by the first letter."),
    "comma_heads": (SPOKEN, "text", lambda c: T.csv_head(c, 2), f"array_to_string({_ITEMS}[1:2], ', ')", "The first two items of comma lists."),
    "comma_sets": (SPOKEN, "text", lambda c: _joined(F.sort_array(T.csv_set(c))), f"array_to_string(list_sort(list_distinct(list_transform({_ITEMS}, lambda x: lower(x)))), '|')", "Distinct lower-case items of comma lists."),
    "comma_lists": (SPOKEN, "text", lambda c: _joined(T.csv_list(c)), f"array_to_string({_ITEMS}, '|')", "Items of comma lists as written."),
    "word_caps": (SPOKEN, "text", lambda c: T.word_cap(c, 3), r"array_to_string(list_filter(regexp_split_to_array(trim(g), '\s+'), lambda w: w <> '')[1:3], ' ')", "Three words with single spaces."),
    "json_number_sets": (PART, """CASE p_partkey % 5 WHEN 0 THEN '[' || (100 + p_partkey) || ',"' || p_size || '",' || (100 + p_partkey) || ',"x",' || p_size || '.75,-' || p_size || '.25]' WHEN 1 THEN '[' || p_partkey || ', ' || p_partkey || ', ' || (p_partkey + p_size) || ']' WHEN 2 THEN p_name WHEN 3 THEN '{"a":' || p_size || '}' END""", lambda c: _joined(F.transform(N.json_ints(c), lambda x: x.cast("string"))), "CASE p_partkey % 5 WHEN 0 THEN (100 + p_partkey) || '|' || p_size || '|-' || p_size WHEN 1 THEN p_partkey || '|' || (p_partkey + p_size) ELSE '' END", "Whole numbers of JSON lists; fractions are cut off, and what is no list has none."),
    "json_string_sets": (PART, """CASE p_partkey % 2 WHEN 0 THEN '["' || p_brand || '"," ' || p_type || ' ","","' || p_brand || '"]' ELSE p_brand || ', ' || p_type || ' ,' || p_brand END""", lambda c: _joined(N.json_strings(c)), "CASE p_partkey % 2 WHEN 0 THEN p_brand || '|' || p_type ELSE lower(p_brand) || '|' || lower(p_type) END", "Strings of JSON lists, else of comma lists."),
    "json_texts": (PART, """CASE p_partkey % 2 WHEN 0 THEN '["' || p_brand || '","' || p_type || '"]' ELSE '{"a":"' || p_name || '"}' END""", T.json_text, "CASE p_partkey % 2 WHEN 0 THEN p_brand || ' ' || p_type ELSE g END", "JSON lists as text."),
    "list_texts": (PART, """CASE p_partkey % 2 WHEN 0 THEN '["' || p_brand || '","' || lower(p_brand) || '"," ' || p_type || '"]' ELSE p_brand || ', ' || upper(p_brand) || ', ' || p_type END""", enrichment.list_text, "p_brand || ', ' || p_type", "Lists as text, items once whatever their case."),
    "clean_keyword_lists": (PART, """'["Sci_' || p_type || '"," ' || p_brand || '. ","' || upper(p_brand) || '","","' || repeat('x', 49) || '"]'""", lambda c: _joined(T.clean_keywords(_list(c))), "'sci ' || lower(p_type) || '|' || lower(p_brand)", "Keywords in one form."),
    "allowed_tag_lists": (PART, """'["' || CASE p_size % 3 WHEN 0 THEN 'Dark' WHEN 1 THEN ' GRITTY ' ELSE p_type END || '","warm","' || p_brand || '","' || CASE p_partkey % 2 WHEN 0 THEN 'bleak' ELSE 'dark' END || '","moody","tense","campy"]'""", lambda c: _joined(T.allowed_tags(_list(c), V.TONE_TAGS, 4)), "array_to_string(list_filter([CASE p_size % 3 WHEN 0 THEN 'dark' WHEN 1 THEN 'gritty' END, 'warm', CASE WHEN p_partkey % 2 = 0 THEN 'bleak' WHEN p_size % 3 > 0 THEN 'dark' END, 'moody', 'tense', 'campy'], lambda x: x IS NOT NULL)[1:4], '|')", "Tags of a closed vocabulary, four at most."),
    "title_checksums": (PART, "p_name || p_type", lambda c: T.checksum(c, 4), "list_sum(list_transform(string_split(g, ''), lambda x: unicode(x)))::INT % 4", "Checksums that pick a text's form."),
    "three_decimals": (PART, "p_size || CASE p_partkey % 4 WHEN 0 THEN '.0625' WHEN 1 THEN '.1875' WHEN 2 THEN '.5' ELSE '' END", lambda c: N.rounded(c.try_cast("double")), "round_even(g::DOUBLE, 3)", "Three decimals, half to even."),
    "plain_numbers": (PART, "CASE p_partkey % 4 WHEN 0 THEN ' ' || p_partkey || ',500' WHEN 1 THEN p_size || '.5' WHEN 2 THEN p_brand ELSE '' END", N.number, "try_cast(replace(trim(g), ',', '') AS DOUBLE)", "Numbers with thousands commas."),
    "phrase_borders": (PART, "p_type || ' (' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE '-' END || ')~' || p_brand", _mentions, "regexp_matches(lower(split_part(g, '~', 1)), '(^|[^a-z0-9])' || regexp_escape(lower(p_brand)) || '([^a-z0-9]|$)')", "Phrases with no letter or digit beside them."),
    "history_cells": (PART, """CASE p_partkey % 5 WHEN 0 THEN '["' || p_name || '","' || p_brand || '"]' WHEN 1 THEN p_name || '; ' || p_brand WHEN 2 THEN p_name || ', ' || p_brand WHEN 3 THEN '"' || p_name || '"' ELSE '{"tmdb_id": ' || p_partkey || '}' END""", lambda c: _joined(service.history_cell(c)), f"CASE p_partkey % 5 WHEN 3 THEN p_name WHEN 4 THEN g ELSE {_ROW} END", "History cells of prompt tables."),
    "history_lists": (PART, """'["' || p_name || '",{"tmdb_id":"' || p_partkey || '","name":"' || p_brand || '"},{"tmdb_id":' || p_partkey || ',"name":"' || p_brand || '"},{"name":""},{"tmdb_id":"x","name":"Q"}]'""", lambda c: F.to_json(service.history_items(F.from_json(c, "array<string>"))), """'[{"id":' || p_partkey || ',"name":"' || p_brand || '"},{"name":"' || list_sort(['Q', p_name])[1] || '"},{"name":"' || list_sort(['Q', p_name])[2] || '"}]'""", "Histories in canonical order."),
    "metadata_columns": (PART, _DETAIL, _metadata, """p_partkey || '~' || p_brand || '~[' || p_size || ',2]~["' || p_name || '","C"]~[9,8]~["' || p_type || '","Alt"]~["' || p_name || '","Y"]~French, ' || p_type || '~' || CASE WHEN p_size < 20 THEN 'R' ELSE 'PG-13' END""", "Catalogue columns of metadata objects."),
    "intent_overrides": (PART, _INTENT, lambda c: F.to_json(hooks.sanitised(c, F.array(*map(F.lit, ("Drama", "Science Fiction", "War"))))), """'{"genres":["' || CASE WHEN p_size % 2 = 0 THEN 'Drama' ELSE 'Science Fiction' END || '"],"avoid":["a ' || p_brand || '","c","d"],' || CASE WHEN 1970 + p_size % 7 >= 1950 + p_size THEN '"year":{"min":' || (1950 + p_size) || ',"max":' || (1970 + p_size % 7) || '},' ELSE '' END || '"runtime":{"max":' || (60 + p_size) || ',"short":false},"setting":"in ' || p_name || '","tone":["dark"],"quality":true,"countries":["Korean"]}'""", "What a model found in a request, within its limits."),
    "clipped_texts": (SPOKEN, "replace(text, chr(10), ' ')", lambda c: selection.clipped(c, 60, 20), r"CASE WHEN length(g) <= 60 THEN g WHEN length(regexp_extract(rtrim(substring(g, 1, 60)), '^(.*[.!?]) ', 1)) > 20 THEN regexp_extract(rtrim(substring(g, 1, 60)), '^(.*[.!?]) ', 1) ELSE regexp_replace(regexp_replace(rtrim(substring(g, 1, 60)), ' [^ ]*$', ''), '[ ,.;:]+$', '') || '.' END", "Texts cut at a sentence, else at a word."),
}


#: Of each kind of part, what ``describe`` is told beside its title; what a kind lacks is empty.
_TOLD = {
    "genres": {0: "'Action, War'", 1: "'Drama'", 2: "'Drama, War'", 3: "'Drama'", 4: "p_type", 6: "p_type", 7: "'Drama'", 8: "'Drama'", 9: "'Drama'"},
    "keywords": {0: "p_type || ', based on a book, ' || p_brand", 2: "p_type", 4: "'night, rain'", 5: "p_type || ', ' || p_brand", 7: "p_brand", 9: "p_type || ', ' || p_brand || ', c, d'", 11: "p_type", 13: "p_type || ', Based on ' || p_brand"},
    "overview": dict.fromkeys((0, 2, 4, 6, 7, 8, 9, 10, 12), "p_type || ' by ' || p_brand || '.'"),
    "rating": {0: "8.2D", 1: "8.1D", 2: "7.0D", 4: "6.0D", 7: "7.3D", 12: "8.5D", 13: "7.2D"},
    "votes": {0: "200000D", 1: "20000D", 2: "CAST(p_size AS DOUBLE)", 4: "5D", 7: "26000D", 12: "100000D", 13: "1000D"},
    "target_genres": {0: "array('action')", 1: "array('drama')", 2: "array('drama')", 4: "array('comedy', 'animation')", 5: "array('comedy')"},
    "tone": {7: "array('calm', 'warm', 'x')"},
    "setting": {8: "'set in ' || (1950 + p_size)"},
    "wants_quality": dict.fromkeys((1, 2, 3, 7, 12), "true"),
    "min_rating": {13: "7.0D"},
    "year_label": dict.fromkeys((2, 3), "(1950 + p_size) || 's'"),
    "open_request": {6: "true"},
}
_LACKING = {"rating": "0D", "votes": "0D", "target_genres": "CAST(array() AS array<string>)", "tone": "CAST(array() AS array<string>)", "wants_quality": "false", "min_rating": "CAST(NULL AS DOUBLE)", "open_request": "false"}


def _descriptions(part):
    """Blurbs of fourteen kinds of parts, one for each opening, praise and fit."""
    kind = lambda c: f"CASE p_partkey % 14 {' '.join(f'WHEN {k} THEN {v}' for k, v in _TOLD[c].items())} ELSE {_LACKING.get(c, repr(''))} END"
    rows = part.select("p_partkey", F.col("p_name").alias("title"), *[F.expr(kind(c)).alias(c) for c in _TOLD]).withColumn("year_missing", F.col("year_label") != "")
    return rows.select("p_partkey", selection.describe(rows).alias("description"))


def _descriptions_sql() -> str:
    """Each kind's blurb, written out."""
    mood = lambda asked, appeal="": "CASE form " + (f"WHEN 0 THEN 'If ' || {asked} || ' is the mood, look at ' || n || '.' " if asked else "") + (f"WHEN 1 THEN n || ' is all about ' || {appeal} || '.' " if appeal else "") + "WHEN 2 THEN n || ' could be one that you love.' ELSE 'Consider ' || n || '.' END || told"
    goal = lambda g: f"CASE pick WHEN 0 THEN ' A sound choice for {g}.' WHEN 1 THEN ' Among {g} it stands out.' ELSE ' For {g} it does the job.' END"
    article = "CASE WHEN left(lower(p_type), 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || lower(p_type)"
    drama = "' Good for a drama evening.'"
    kinds = [
        mood("'action'", "p_type || ' and ' || p_brand") + " || " + goal("action"),
        "'Try ' || n || '. Those who know it rate it very highly.' || " + goal("drama"),
        "'Nothing from ' || (1950 + p_size) || 's is in this catalogue, but ' || n || ' comes close in spirit.' || told || ' It is a lesser known pick.' || " + goal("drama"),
        "'Nothing from ' || (1950 + p_size) || 's is in this catalogue, but ' || n || ' has the feel that you asked for.' || " + drama,
        "'There is little pure animation and comedy to offer, but ' || n || ' mixes ' || lower(p_type) || ' in a way that may suit you.' || told || " + goal("animation and comedy"),
        "n || ' is not strictly comedy, but its ' || p_type || ' and ' || p_brand || ' themes could do as well.' || " + goal("comedy"),
        f"'As you are open to anything, take ' || {article} || ': ' || n || '.' || told || ' Good for ' || {article} || ' evening.'",
        mood("'calm and warm'", "p_brand") + " || ' It is popular with good reason.' || CASE pick WHEN 0 THEN ' The feeling is calm and warm throughout.' WHEN 1 THEN ' It suits a wish for something calm and warm.' ELSE ' On the calm and warm side it keeps its word.' END",
        mood("'set in ' || (1950 + p_size)", "'drama'") + " || ' The set in ' || (1950 + p_size) || ' is well drawn.'",
        mood("", "p_type || ', ' || p_brand || ', and c'") + " || " + drama,
        mood(""),
        "n || ' lives on ' || p_type || '.'",
        mood("") + " || ' Few films are as widely loved.'",
        "n || ' lives on ' || p_type || '. Its viewers mostly like it a lot.'",
    ]
    total = "list_sum(list_transform(string_split(p_name, ''), lambda x: unicode(x)))"
    return f"SELECT p_partkey, CASE p_partkey % 14 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(kinds))} END AS description FROM (SELECT *, p_name AS n, ' ' || p_type || ' by ' || p_brand || '.' AS told, {total} % 4 AS form, {total} % 3 AS pick FROM part)"


def _payloads(part):
    got = service.payloads(part.select("p_partkey", F.expr(_BODY).alias("body")))
    return got.select("p_partkey", "user_id", "text", F.to_json("history").alias("history"), "error")


def _overrides(part):
    part = dealt(part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    told = F.from_json(F.expr(_OVERRIDE), parsing.OVERRIDE)
    got = parsing.profile(part.select("p_partkey", F.concat(F.lit("a drama, not "), "p_name", F.lit(", from 1999")).alias("text"), told.alias("override")))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    listed = lambda c: F.array_join(c, ",")
    parts = [listed(F.sort_array("genres")), listed("avoid_phrases"), listed("said_people"), F.concat_ws("-", text(F.col("year.min")), text(F.col("year.max"))), F.concat(text(F.col("runtime.min")), F.lit("-"), text(F.col("runtime.max"))), "setting", F.size("tone").cast("string"), F.size("said_countries").cast("string"), F.col("wants_quality").cast("string")]
    return got.select("p_partkey", F.concat_ws("|", *parts).alias("result"))


def _merged(part):
    key = F.col("p_partkey") % 4
    rows = part.select(F.col("p_partkey").alias("tmdb_id"), F.when(key == 0, F.col("p_type")).otherwise("").alias("us_rating"), F.col("p_brand").alias("collection_name"), F.when(key == 3, enrichment.VERSION).otherwise("").alias(enrichment.STATUS))
    details = part.filter("p_partkey % 4 < 3").select(F.col("p_partkey").alias("tmdb_id"), F.when(key < 2, F.expr(_DETAIL)).otherwise("null").alias("detail"))
    out = enrichment.merge_metadata(rows, details)
    return out.select("tmdb_id", "us_rating", "collection_name", "spoken_languages", F.col(enrichment.STATUS).alias("status"))


def register(table: Callable, queries: dict, sql: dict) -> None:
    """Add all of these to ``queries`` and ``sql``; ``table`` reads a table."""

    def add(name: str, run: Callable, doc: str, says: str) -> None:
        run.__name__, run.__doc__ = name, doc
        queries[name], sql[name] = run, says

    def over(name: str, source: tuple[str, str], given: str, value: Callable, says: str, doc: str) -> None:
        keys = source[1].split(", ")

        def run(spark, d):
            ship(spark)
            rows = table(spark, d, source[0]).select(*keys, F.expr(given).alias("g"))
            return rows.select(*keys, value(F.col("g")).alias("result"))

        add(name, run, doc, f"SELECT {source[1]}, {says} AS result FROM (SELECT *, {given} AS g FROM {source[0]})")

    for name, (source, given, value, says, doc) in QUERIES.items():
        over(name, source, given, value, says, doc)
    add("descriptions", lambda spark, d: _descriptions(table(spark, d, "part")), "Deterministic blurbs.", _descriptions_sql())
    add("request_payloads", lambda spark, d: _payloads(table(spark, d, "part")), "Bodies of requests as typed columns, or their error.", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_partkey WHEN 1 THEN 1 END::BIGINT AS user_id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_type END AS text,
      CASE p_partkey % 5 WHEN 0 THEN '[{"id":' || p_size || ',"name":"' || p_brand || '"}]' WHEN 1 THEN '[]' END AS history, CASE p_partkey % 5 WHEN 2 THEN 'invalid JSON' WHEN 3 THEN 'invalid values' WHEN 4 THEN 'empty preferences' END AS error FROM part""")
    add("override_merge", lambda spark, d: _overrides(table(spark, d, "part")), "What a model adds to what a text says.", """SELECT p_partkey, 'drama,' || CASE WHEN p_size % 2 = 0 THEN 'science fiction' ELSE 'war' END || '|' || lower(p_name) || ',' || lower(p_type) || ' scenes|' || lower(p_brand) || '|' || CASE WHEN 1980 + p_size % 9 >= 1960 + p_size THEN (1960 + p_size) || '-' || (1980 + p_size % 9) ELSE '1999-1999' END
      || '|' || p_size || '-|' || p_name || '|4|1|' || CASE WHEN p_size < 9 THEN 'true' ELSE 'false' END AS result FROM part""")
    add("metadata_merge", lambda spark, d: _merged(table(spark, d, "part")), "Fetched metadata merged into the catalogue.", """SELECT p_partkey AS tmdb_id, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN CASE WHEN p_size < 20 THEN 'R' ELSE 'PG-13' END ELSE '' END AS us_rating, p_brand AS collection_name,
      CASE WHEN p_partkey % 4 < 2 THEN 'French, ' || p_type ELSE '' END AS spoken_languages, CASE WHEN p_partkey % 4 = 2 THEN '' ELSE 'v2' END AS status FROM part""")
