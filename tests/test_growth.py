"""Work that grows with the input: plans and candidates, counted on small tables."""

import zlib

import pandas as pd
from pyspark.sql import functions as F

from lumenrank.functions import values as V
from lumenrank.llm import toxicity
from lumenrank.operators import evaluation, hooks, parsing


def test_pairs_of_histories_are_not_shuffled(spark, capsys):
    items = spark.createDataFrame([(1, "Up", "High"), (2, "Up", "up"), (3, "HIGH", "Low"), (4, "", None), (9, "Nine", "x")], "doc long, title string, other string")
    told = spark.createDataFrame([(1, None, "Up"), (1, None, " UP "), (1, 1, "HIGH"), (2, 9, "none"), (2, 3, "low"), (2, None, None), (3, 4, ""), (3, 77, "y")], "request_id long, id long, name string")
    got = parsing.resolved_history(told, items, F.array("title", "other"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "title"), (1, 2, "title"), (1, 3, "title"), (2, 3, "variant"), (2, 9, "id"), (3, 4, "title")]
    got.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[-1]
    assert plan.index("Join") < plan.index("Exchange"), "nothing is moved after items are met"


def test_names_with_the_same_first_words_make_no_pairs(spark, monkeypatch):
    names = spark.range(300).select("id", F.concat(F.lit("The small ring: a tale, part "), F.col("id").cast("string")).alias("name"))
    asked = names.select(F.col("id").alias("request_id"), F.concat(F.lit("like "), F.lower("name"), F.lit("!")).alias("text"))
    copies = names.union(names.select(F.col("id") + 1000, "name"))
    assert parsing.met(asked, copies).filter("request_id % 1000 = id % 1000").count() == parsing.met(asked, copies).count() == 600
    monkeypatch.setattr(parsing, "mentions", lambda text, name: F.lit(True))
    assert parsing.met(asked, names).count() == 300, "candidates meet by their whole names"
    monkeypatch.setattr(parsing, "SENT_NAMES", 10)
    assert parsing.met(asked, names).count() == 300


def test_texts_are_normalised_once(spark):
    """Within a lambda nothing is shared between a table's terms, so each would normalise the text anew."""
    t = F.col("t")
    assert str(parsing.named(t, V.LANGUAGES)).count("lower(") == 1
    assert str(parsing.blocked_genres(t)).count("instead") == 1 and str(parsing.refused_tokens(t)).count("instead") == 1
    assert str(evaluation.asked_language(t)).count("regexp_replace(") == 1 and str(evaluation.asked_years(t)).count("regexp_replace(") == 1
    df = spark.createDataFrame([("no sci-fi, non-fiction and hates war.",)], "t string")
    assert df.select(parsing.blocked_genres(t)).first()[0] == ["science fiction", "war"]


def test_answers_of_small_batches_are_handed_over_together(spark, monkeypatch):
    """One frame for each that comes in: a frame of each batch costs more than its answers."""
    frames = []

    class Rows:
        schema = {"request_id": type("f", (), {"dataType": type("t", (), {"simpleString": staticmethod(lambda: "bigint")})})}
        columns, sparkSession = ["request_id", "prompt", "deadline"], spark

        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            frames.extend(run(iter([pd.DataFrame({"request_id": range(50), "prompt": [f"p{i}" for i in range(50)], "deadline": [None] * 50})])))

    def model(prompts, options):
        if "p7" in prompts:
            raise RuntimeError("no model")
        return [p.upper() for p in prompts]

    hooks.ask(Rows(), model, batch=2)
    (got,) = frames
    assert list(got["request_id"]) == list(range(50)) and [i for i, e in enumerate(got["error"]) if e] == [6, 7]
    assert got["answer"][49] == "P49" and got["answer"][6] is None


def test_toxicity_learns_from_all_labelled_rows(spark):
    """What is toxic comes last in the order of the ids' hash, behind 11,000 other labels."""
    ids = spark.range(18_000).select(F.col("id").alias("doc_id")).filter(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"))
    ids = [r[0] for r in ids.collect()]
    assert len(ids) > 11_000
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    toxic = set(ids[-80:])
    docs = spark.createDataFrame([(i, f"some quiet words {word(i)} here" + (" vilewretch" if i in toxic else "")) for i in ids], "doc_id long, text string")
    labels = docs.select("doc_id", F.contains("text", F.lit("vilewretch")).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    assert model.score("a vilewretch") > 0.9 > 0.1 > model.score("some quiet words")


def test_toxicity_learns_every_word_and_feature(spark):
    """Some 2,400 toxic words in five documents each, and 20,000 words in all: none is left out for its rank."""
    ids = spark.range(25_000).select(F.col("id").alias("doc_id")).filter(~toxicity.held_out(F.col("doc_id"))).orderBy("doc_id")
    ids = [r[0] for r in ids.collect()]
    word = lambda i, n: "".join(chr(97 + i // 26**k % 26) for k in range(n))
    own = [word(i, 3) for i in range(26**3)]
    texts = [" ".join({word(k % 2600, 4), *(own[(k * 7 + j * 2003) % len(own)] for j in range(8))}) for k in range(13_000)] + [" ".join(own)] * 80
    assert len(ids) >= len(texts)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k < 13_000)) for k, i in enumerate(ids[: len(texts)])], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    marks = [min(zlib.crc32(w.encode()) for w in t.split()) for t in texts[:13_000]]
    unlike = {word(k, 4) for k in range(2600) if len({marks[k + 2600 * j] for j in range(5)}) >= toxicity.LEAST_TEXTS}
    assert set(model.evidence) == unlike and len(unlike) > 2000
    assert model.chars.uni["$"] == sum(len(t.split()) for t in texts) + 50 * len(unlike)


def test_histories_meet_blocks_of_items(spark, monkeypatch, capsys):
    """Items with the same titles are met as blocks, and told one by one after the join; the rows are those of all pairs."""
    monkeypatch.setattr(parsing, "BLOCK", 5)
    items = [(i, f"Ring {i % 7}" if i % 3 else f"ring {i % 7}", f"Alt {i % 4}" if i % 5 else None) for i in range(120)]
    told = [(n % 9, n % 130 if n % 4 == 0 else None, [None, f"Ring {n % 9}", f" RING {n % 8}", f"alt {n % 6}", ""][n % 5]) for n in range(90)]

    def tier(i, name, item):
        doc, *titles = item
        if name is not None and name == titles[0]:
            return 0
        if name and name.strip() and name.lower().strip() in {x.lower() for x in titles if x}:
            return 1
        return 2 if i == doc else None

    want = {}
    for r, i, name in told:
        tiers = {item[0]: tier(i, name, item) for item in items}
        first = min((x for x in tiers.values() if x is not None), default=None)
        for doc, x in tiers.items():
            if x is not None and x == first:
                want[r, doc] = min(x, want.get((r, doc), 2))
    got = parsing.resolved_history(spark.createDataFrame(told, "request_id long, id long, name string"), spark.createDataFrame(items, "doc long, title string, other string"), F.array("title", "other"))
    assert sorted(map(tuple, got.collect())) == sorted((r, d, ("title", "variant", "id")[x]) for (r, d), x in want.items()) and len(want) > 300
    got.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[-1]
    assert -1 < plan.find("Generate explode(docs") < plan.index("Join"), "pairs of requests and items aren't joined"
