"""A written index with each block's highest score, and search that ranks no more documents than those bounds allow.

Index. Every posting holds its finished part of the score but for the term's idf. A term's postings are cut
into levels by that part, highest first: the first holds about FIRST of them, each
further one makes what came so far GROWTH times as many. Postings are dealt by document and lie there by term, so that no term is
a single task's, long or short, and postings move once. A table has each term's idf and each level's size and bounds; terms of
up to FIRST postings have one level.

Search. A request's ``k``-th score is at least that of any of its terms' ``k``-th
posting, which the levels bound from below. Against that floor stands what each term can add: the terms
with the most postings, and the low levels of one more, are set aside as long as all of that
together stays below the floor. A document with nothing but such postings can't be among the first ``k``, so only
documents in the other levels are ranked, each scored in full. Asked postings are dealt by document, once for all
requests; pairs of requests and documents are added up and cut to the first ``k`` where they arise.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import LEXICAL_TOP
from .lexical import SENT, bm25, ranked
from .ranking import without

FIRST, GROWTH, STEPS = 128, 2, 200
#: Postings times requests that one task adds up.
MET = 2_000_000
#: Distinct terms of all requests up to which the scan is told of them.
TOLD = 5000
#: Scores are rounded, so a bound must be missed by more than this.
SLACK = 1e-5


def levels(entries: DataFrame, by: str, step: Column, first: int, growth: float) -> DataFrame:
    """(by, step, level, through): each step's level, and how many entries of its key the levels down to it hold, highest steps first.

    Levels come from counts of steps, so that a key of any length is no single task's.
    """
    counts = entries.groupBy(by, step.alias("step")).agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(by).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("n").over(so_far) - F.col("n")
    level = F.when(before < first, 0).otherwise(1 + F.floor(F.log(before / first) / F.log(F.lit(float(growth))))).cast("int")
    cut = counts.withColumns({"level": level, "__through": F.sum("n").over(so_far)})
    return cut.select(by, "step", "level", F.max("__through").over(Window.partitionBy(by, "level")).alias("through"))


def _step() -> Column:
    return F.floor(F.col("part") * STEPS).cast("int")


def write(postings: DataFrame, stats: DataFrame, lengths: DataFrame, path: str) -> None:
    """Write ``postings`` (doc, term, tf), ``stats`` (term, df, idf) and ``lengths`` (doc, dl) as an index under a folder that isn't there yet."""
    spark = postings.sparkSession
    avgdl = F.coalesce(lengths.agg(F.avg("dl")).scalar(), F.lit(1.0))
    parts = postings.join(lengths.hint("shuffle_hash"), "doc").select("term", "doc", bm25(F.col("tf"), F.col("dl"), avgdl, F.lit(1.0)).alias("part"))
    parts.sortWithinPartitions("term").write.parquet(f"{path}/postings")
    parts = spark.read.schema(parts.schema).parquet(f"{path}/postings")
    each = parts.groupBy("term").agg(F.count("*").alias("n"), F.min(_step()).alias("low"), F.max(_step()).alias("high"))
    each.join(stats.select("term", "idf"), "term").write.parquet(f"{path}/terms")
    each = spark.read.parquet(f"{path}/terms")
    long = each.filter(F.col("n") > FIRST)
    few = long.limit(SENT + 1).count() <= SENT
    cut = levels(parts.join(F.broadcast(long.select("term")), "term", "left_semi") if few else parts, "term", _step(), FIRST, GROWTH)
    cut = cut.groupBy("term", "level").agg(F.max("through").alias("through"), F.min("step").alias("low"), F.max("step").alias("high"))
    cut = cut.join(long.select("term", "idf"), "term").select("term", "level", "through", "low", "high", "idf")
    short = each.filter(F.col("n") <= FIRST).select("term", F.lit(0).alias("level"), F.col("n").alias("through"), "low", "high", "idf")
    bounds = short.unionByName(cut).select("term", "level", "through", "low", "idf", ((F.col("high") + 1) / STEPS * F.col("idf")).alias("ceiling"), (F.col("low") / STEPS * F.col("idf")).alias("floor"))
    bounds.write.parquet(f"{path}/bounds")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, bounds) of a written index."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/bounds")


def asked_levels(terms: DataFrame, bounds: DataFrame, out: DataFrame | None, k: int) -> DataFrame:
    """(request_id, term, level): the levels whose documents can be among a request's first ``k``, and as many more as it excludes (request_id, out)."""
    met = terms.join(bounds, "term")
    met = (met.join(out, "request_id", "left") if out is not None else met.withColumn("out", F.lit(0))).withColumn("most", F.coalesce("out", F.lit(0)) + k)
    whole, term = Window.partitionBy("request_id"), Window.partitionBy("request_id", "term")
    met = met.withColumns({"least": F.max(F.when(F.col("through") >= F.col("most"), F.col("qtf") * F.col("floor"))).over(whole), "top": F.max(F.col("qtf") * F.col("ceiling")).over(term), "n": F.max("through").over(term)})
    # the longest lists are set aside first; what they can add is taken from the floor
    each = met.select("request_id", "term", "top", "n").distinct()
    before = F.coalesce(F.sum("top").over(whole.orderBy(F.desc("n"), "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    met = met.join(each.select("request_id", "term", before.alias("before")), ["request_id", "term"])
    spare = F.coalesce("least", F.lit(0.0)) - SLACK - F.col("before")
    return met.filter(F.col("qtf") * F.col("ceiling") >= spare).select("request_id", "term", "level")


def search(terms: DataFrame, index: tuple[DataFrame, DataFrame], exclude: DataFrame | None = None, k: int = LEXICAL_TOP, digits: int = 6) -> DataFrame:
    """As ``lexical.search`` over the table that was written: (request_id, doc, bm25_raw, bm25_score, bm25_rank)."""
    rows = _scored(terms, index, exclude, k).select("request_id", "doc", F.round("score", digits).alias("bm25_raw")).filter("bm25_raw > 0")
    if exclude is not None:
        rows = without(rows, exclude, ["request_id", "doc"])
    return ranked(rows, "bm25", k)


def candidates(terms: DataFrame, index: tuple[DataFrame, DataFrame], exclude: DataFrame | None = None, k: int = LEXICAL_TOP) -> DataFrame:
    """(request_id, doc): the documents that a search ranks."""
    return _scored(terms, index, exclude, k).select("request_id", "doc")


def _scored(terms: DataFrame, index: tuple[DataFrame, DataFrame], exclude: DataFrame | None, k: int) -> DataFrame:
    """(request_id, doc, score) of the candidates. Postings are dealt by document, and their sums stay there."""
    postings, bounds = _asked(terms, index)
    out = exclude.groupBy("request_id").agg(F.count("*").alias("out")) if exclude is not None else None
    wanted = asked_levels(terms, bounds, out, k).join(bounds.select("term", "level", "low"), ["term", "level"]).groupBy("request_id", "term").agg(F.min("low").alias("low"))
    held = bounds.groupBy("term").agg(F.first("idf").alias("idf"), F.max("through").alias("n"))
    told = terms.join(held, "term").join(wanted, ["request_id", "term"], "left").select("request_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "low", "n")
    if terms.limit(SENT + 1).count() <= SENT:
        # as many tasks as keep the sums of one in memory, whatever the number of requests
        n = told.agg(F.sum("n")).first()[0] or 0
        spark = terms.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // MET))
        postings, told = postings.repartition(tasks, "doc"), F.broadcast(told)
    met = postings.join(told.drop("n"), "term")
    sums = met.groupBy("request_id", "doc").agg(F.sum(F.col("weight") * F.col("part")).alias("score"), F.max(F.coalesce(_step() >= F.col("low"), F.lit(False))).alias("wanted"))
    return sums.filter("wanted").drop("wanted")


def _asked(terms: DataFrame, index: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The index with a filter that the scan can use, where few terms are asked for."""
    told = [r[0] for r in terms.select("term").distinct().limit(TOLD + 1).collect()]
    return tuple(x.filter(F.col("term").isin(told)) for x in index) if len(told) <= TOLD else index
