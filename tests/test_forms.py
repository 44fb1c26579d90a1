"""Queries over parts feed their function every form that it tells apart."""

from lumenrank import queries as library

SF = "/root/testdata/sf0.001"


def test_number_lists_of_every_form(spark):
    got = {r.p_partkey % 5: r.result for r in library.QUERIES["json_number_sets"](spark, SF).filter("p_partkey < 5").collect()}
    assert got[0].startswith("100|") and got[1].startswith("1|") and got[1].count("|") == 1, "repeated numbers come once"
    assert got[2] == got[3] == got[4] == "", "plain text, an object and null are no lists"


def test_descriptions_of_every_kind(spark):
    said = [r.description for r in library.QUERIES["descriptions"](spark, SF).collect()]
    openings = ["is the mood, look at", "is all about", "could be one that you love", "Consider ", "Try ", "comes close in spirit", "has the feel that you asked for", "There is little pure", "is not strictly", "As you are open to anything", " lives on "]
    praise = ["Few films are as widely loved.", "Those who know it rate it very highly.", "It is popular with good reason.", "Its viewers mostly like it a lot.", "It is a lesser known pick."]
    fits = ["throughout.", "is well drawn.", "A sound choice for", "it stands out.", "it does the job.", " evening."]
    missing = [p for p in openings + praise + fits if not any(p in x for x in said)]
    assert not missing
