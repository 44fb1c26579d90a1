"""Plans whose work must follow the rows, not the files or the copies of a text."""

from pyspark.sql import functions as F

from lumenrank import queries as library
from lumenrank.llm import toxicity
from lumenrank.operators import blockmax, index, lexical, parsing

SF = "/root/testdata/sf0.001"


def test_overrides_are_dealt_over_all_cores(spark):
    assert library.QUERIES["override_merge"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_liked_phrases_meet_texts_and_their_first_items(spark):
    """Of a text with 3,000 copies, 40 items go on."""
    one = lambda c: F.array(F.lit(c))
    copies = spark.range(3000).select(F.col("id").alias("doc"), F.lit("old ring big").alias("blob"), one("big").alias("genre_set"), F.when(F.col("id") < 40, one("early")).otherwise(one("late")).alias("keyword_set"))
    other = spark.range(1).select(F.lit(-1).cast("bigint").alias("doc"), F.lit("bold ring").alias("blob"), one("small").alias("genre_set"), one("first").alias("keyword_set"))
    asked = spark.createDataFrame([(1, ["old ring"], ["late"])], "request_id int, affinity_phrases array<string>, avoid_terms array<string>")
    (got,) = parsing.affinity_terms(asked, copies.union(other)).collect()
    assert got.affinity_terms == ["big", "early", "first", "small"]
    plan = parsing.affinity_terms(asked, copies.union(other))._jdf.queryExecution().optimizedPlan().toString()
    assert "held#" in plan and not any("doc#" in x or "genre_set#" in x for x in plan.split("\n") if "held#" in x and "Project" in x), "words lead to texts, not to each of their copies"


def test_labels_meet_texts_where_they_are(spark, monkeypatch):
    ids = [-5, 0, 7, 8, 32767, 32768, 32769, 70000, 2**40]
    docs = spark.createDataFrame([(i, f"t{i}") for i in [*ids, 3, 32770, None]], "id long, text string")
    marked = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)] + [(99, 1)], "id long, toxic int")
    want = sorted((f"t{i}", n % 2) for n, i in enumerate(ids))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = toxicity.labelled(docs, marked)
        assert sorted(map(tuple, met.collect())) == want
        assert "SortMergeJoin" not in met._jdf.queryExecution().executedPlan().toString(), "texts aren't shuffled"
        monkeypatch.setattr(toxicity, "SENT_BITMAPS", 2)
        assert sorted(map(tuple, toxicity.labelled(docs, marked).collect())) == want
        names = lambda x: x.withColumn("id", F.col("id").cast("string"))
        assert sorted(map(tuple, toxicity.labelled(names(docs), names(marked)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_terms_of_a_document_stay_together(spark):
    """Texts are dealt by document, and the sums of their terms aren't moved."""
    docs = spark.createDataFrame([(1, "quiet rain and rain"), (2, "rain"), (1, "quiet")], "doc_id long, text string")
    got = index.weighted_terms(docs, {"text": 1.0}, "doc_id")
    assert sorted(map(tuple, got.collect())) == [(1, "quiet", 2.0), (1, "rain", 2.0), (2, "rain", 1.0)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(dealt) == 1 and "term#" not in dealt[0]


def test_pairs_of_requests_and_documents_stay_where_they_are(spark, tmp_path):
    """Asked postings are dealt by document once, for all requests; texts are dealt over a given number of tasks, whatever their size."""
    docs = spark.range(400).select(F.col("id").alias("doc"), F.concat(F.lit("rain storm word"), F.col("id") % 7, F.when(F.col("id") % 3 == 0, " storm snow").otherwise("")).alias("text"))
    built = index.build(docs, "doc", {"text": 1.0})
    blockmax.write(*built, f"{tmp_path}/index")
    opened = blockmax.read(spark, f"{tmp_path}/index")
    terms = lexical.query_terms(spark.createDataFrame([(0, "rain storm"), (1, "snow word3 rain"), (2, "nothing"), (3, "storm storm word1")], "request_id int, text string"))
    got = blockmax.search(terms, opened, k=30)
    want = lexical.search(terms, *built, k=30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and got.count() == 90
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x]
    assert any("hashpartitioning(doc#" in x and "REPARTITION_BY_NUM" in x for x in dealt)
    assert not any("request_id#" in x and "doc#" in x.split("hashpartitioning(")[1].split(")")[0] for x in dealt), "pairs aren't shuffled before they are cut to the first"
    texts = index.weighted_terms(docs, {"text": 1.0}, "doc")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in texts
