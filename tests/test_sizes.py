"""Tables whose files are far smaller than their rows, and requests whose titles have many copies."""

from pyspark.sql import functions as F

from lumenrank.plans import recommend as plan
from lumenrank.sources.stages import scratch, written

_FACTOR = "spark.sql.sources.fileCompressionFactor"


def test_packed_tables_are_not_broadcast(spark):
    """A file of 400,000 equal rows has a few kilobytes, its rows tens of megabytes."""
    before = spark.conf.get(_FACTOR)
    rows = spark.range(400_000).select((F.col("id") % 400).alias("doc"), *[F.lit("the same words " * 9).alias(f"c{i}") for i in range(9)])
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    with scratch(spark) as keep:
        table = keep(written(rows, "packed"))
        within = size(table.select("*"))
    assert spark.conf.get(_FACTOR) == before and within >= 16 * size(table.select("*"))


def test_long_lists_of_documents_go_with_no_pair(spark):
    """What was seen and seeds' neighbours meet pairs as rows: a request's lists are no columns of its pairs."""
    ids, none = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    items = plan.prepare(spark.createDataFrame([(i, f"Film {i}", "Drama") for i in range(6)], "tmdb_id long, title string, genres string"))
    asked = plan.understand(spark.createDataFrame([(1, "a drama", [])], "request_id int, text string, history array<struct<id:bigint,name:string>>"), items)
    asked = asked.withColumns({"seen": F.array(F.lit(1).cast("bigint"), F.lit(None).cast("bigint")), "seed_similar_ids": F.array(F.lit(2).cast("bigint"), F.lit(3).cast("bigint")), "seed_recommended_ids": F.array(F.lit(3).cast("bigint"), F.lit(4).cast("bigint")), "history_docs": ids, "blocked_genres": none})
    pairs = plan._unrecalled(asked.select("request_id").crossJoin(items.select("doc")), False)
    rows = plan._evidence(pairs, asked, items)
    assert {r.doc: r.seed_relation for r in rows.collect()} == {0: "", 2: "similar", 3: "similar", 4: "recommended", 5: ""}
    joins = [x for x in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "array_contains(seen" in x or "array_contains(seed_" in x]
    assert not joins
