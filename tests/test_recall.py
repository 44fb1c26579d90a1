"""Rows that constraints bring in, and the fallback, against all pairs; and how many rows are scored for them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenrank.plans import recall
from lumenrank.plans import recommend as plan
from lumenrank.sources import catalogue as C
from lumenrank.sources.stages import written

GENRES = ["Action", "Drama", "Horror", "Comedy", "Romance", "Western"]
ASKED = [
    "action films from the 1990s", "a drama between 1980 and 2005, no horror", "french drama under 100 minutes", "the best films", "best western of all time", "horror or comedy with Ana Bell since 2010",
    "rated pg-13 comedy", "something with Ana Bell", "a slow western longer than 150 minutes", "german horror from the 80s", "", "good comedy, not romance", "a courtroom drama from the 2000s",
]


def rows(n, seed=2):
    rng = random.Random(seed)
    for i in range(n):
        votes = rng.choice([0, 50, 900, 1500, 20_000, 400_000])
        people = ", ".join(rng.choices(["Ana Bell", "Bo Cole", "Cy Dunn", "Di Ernst", "Ed Flynn"], k=2))
        yield (
            i, f"Film {i}", ", ".join(rng.sample(GENRES, rng.randint(1, 2))), people, rng.choice(["a trial and a verdict", "rain in a town", "a ghost"]), str(rng.randint(1950, 2024)), str(rng.randint(60, 200)),
            str(rng.choice([5.5, 6.4, 7.1, 7.3, 7.5, 8.1, 8.4])), str(votes), rng.choice(["en", "en", "fr", "de"]), rng.choice(["PG-13", "R", "", "NR"]), "trial, verdict" if i % 9 == 0 else "night",
        )


@pytest.fixture(scope="module")
def made(spark):
    names = "tmdb_id long, title string, genres string, top_cast string, overview string, year string, runtime_min string, vote_average string, vote_count string, original_language string, us_rating string, keywords string"
    items = written(plan.prepare(C.ensure_columns(spark.createDataFrame(list(rows(2500)), names))), "items")
    told = [(i, text, [(3 * i, None)] if i % 2 else []) for i, text in enumerate(ASKED)]
    requests = spark.createDataFrame(told, "request_id int, text string, history array<struct<id:bigint,name:string>>")
    return items, written(plan.understand(requests, items), "asked")


def first(df, most):
    n = F.row_number().over(Window.partitionBy("request_id", "kind").orderBy(*plan.by_score()))
    return {(r.request_id, r.kind, r.doc, r.score) for r in df.withColumn("n", n).filter(F.col("n") <= most).collect()}


def brute(items, asked, most):
    """All pairs with their evidence, and of each kind the first ``most``."""
    pairs = asked.select("request_id").crossJoin(items.select("doc"))
    df = written(plan._score(plan._evidence(plan._unrecalled(pairs, False), asked, items)), "pairs")
    df = df.filter("not similar_request or seed_relation = ''")
    w = Window.partitionBy("request_id")
    few = F.count_if(F.col("good") & F.col("aimed")).over(w) >= F.least(F.lit(5), F.count_if("good").over(w))
    df = df.withColumn("narrowed", few)
    kinds = {"year": F.col("asked_year"), "runtime": F.col("asked_runtime"), "person": F.col("asked_person"), "quality": F.col("good") & (F.col("aimed") | ~F.col("narrowed"))}
    return set().union(*(first(df.filter(c).withColumn("kind", F.lit(k)), most) for k, c in kinds.items()))


def test_constraint_rows_equal_all_pairs(made, monkeypatch):
    items, asked = made
    monkeypatch.setattr(recall, "FIRST", 16)
    scored, evidence = [], plan._evidence

    def counting(pairs, *more):
        scored.append(pairs.select("request_id", "doc").distinct().groupBy("request_id").count().collect())
        return evidence(pairs, *more)

    monkeypatch.setattr(plan, "_evidence", counting)
    got = plan.constraint_rows(asked, items, 12)
    met = {(r.request_id, r.kind, r.doc, r.score) for r in got.collect()}
    monkeypatch.setattr(plan, "_evidence", evidence)
    want = brute(items, asked, 12)
    assert len(want) > 150 and {k for _, k, _, _ in want} == {"year", "runtime", "person", "quality"}
    assert met == want
    each = {}
    for r in sum(scored, []):
        each[r.request_id] = each.get(r.request_id, 0) + r["count"]
    pairs = items.count() * asked.count()
    assert sum(each.values()) < pairs / 5, (sum(each.values()), pairs)
    assert each[ASKED.index("the best films")] < 250, "a request without further wishes reads little more than it keeps"


def test_fallback_equals_all_pairs(made, monkeypatch):
    items, asked = made
    monkeypatch.setattr(recall, "FIRST", 16)
    pairs = asked.select("request_id").crossJoin(items.select("doc"))
    want = first(plan._score(plan._evidence(plan._unrecalled(pairs, True), asked, items)).withColumn("kind", F.lit("all")), 20)
    none = plan._score(plan._evidence(plan._unrecalled(pairs.limit(0), True), asked, items).withColumns({"year_available": F.col("asked_year"), "runtime_available": F.col("asked_runtime")}))
    got = plan.fallback(asked, items, none, 20)
    assert {(r.request_id, "all", r.doc, r.score) for r in got.collect()} == want and len(want) == 20 * len(ASKED)


def test_written_index_reads_few_documents(spark):
    """The same rows as the plain search, for frequent and rare terms, exclusions and small ``k``; most documents aren't scored."""
    import tempfile

    from lumenrank.operators import blockmax, index, lexical

    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.7))}x" for _ in range(150_000)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 30 : i * 30 + rng.randint(5, 30)])) for i in range(5000)], "doc long, text string")
    built = index.build(docs, "doc", {"text": 1.0})
    path = tempfile.mkdtemp() + "/index"
    blockmax.write(*built, path)
    opened = blockmax.read(spark, path)
    asked = ["w1x", "w1x w2x", "w7x w1x w2x w3x", "w50x w1x", "w900x nothing", "nothing", "", " ".join(f"w{i}x" for i in range(1, 20)), "w3x w3x w9x"]
    terms = lexical.query_terms(spark.createDataFrame(list(enumerate(asked)), "request_id int, text string"))
    out = spark.createDataFrame([(0, d) for d in range(0, 5000, 3)] + [(2, 7)], "request_id int, doc long")
    for exclude, k in ((None, 10), (out, 10), (None, 80)):
        got, want = (sorted(map(tuple, x.select("request_id", "doc", "bm25_raw", "bm25_rank").collect())) for x in (blockmax.search(terms, opened, exclude, k), lexical.search(terms, *built, exclude, k)))
        assert got == want and len(got) > 40
    scored, every = blockmax.candidates(terms, opened, None, 10).count(), built[0].join(terms, "term").select("request_id", "doc").distinct().count()
    assert scored < 0.6 * every, (scored, every)
    alone = blockmax.candidates(terms.filter("request_id = 0"), opened, None, 10).count()
    assert alone < 300 < built[0].filter("term = 'w1x'").count() / 4, alone
