"""Inverted index over weighted fields: postings, term statistics, document lengths."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, json_text, normalize, stem
from ..functions.values import FIELD_WEIGHTS, OVERVIEW_TERMS, STOP_WORDS
from ..sources.stages import written


def exploded_tokens(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` once for each token of ``text`` that is no stop word, as column ``token``. No lambda: all of it is compiled."""
    found = rows.select(*rows.columns, F.explode(F.regexp_extract_all(normalize(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))).alias("token"))
    return found.filter(~F.col("token").isin(STOP_WORDS))


def _field_terms(docs: DataFrame, fields: dict[str, float], id_col: str) -> DataFrame:
    """(doc, field, w, term) for each occurrence. Texts are dealt by document, once: they are smaller than their terms' sums, which then stay where they are, each document's together.

    A number of tasks is given, since by the size of the texts alone too few tasks would get more terms than they can hold.
    """
    text = lambda f: json_text(F.col(f)) if f.endswith("_json") else F.col(f).cast("string")
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(w)).alias("w"), F.coalesce(text(f), F.lit("")).alias("text")) for f, w in fields.items()])
    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("doc"), parts.alias("parts")).repartition(tasks, "doc").select("doc", F.inline("parts"))
    terms = exploded_tokens(rows, F.col("text")).select("doc", "field", "w", stem(F.col("token")).alias("term"))
    return terms.filter(~F.col("term").isin(STOP_WORDS))


def weighted_terms(docs: DataFrame, fields: dict[str, float], id_col: str) -> DataFrame:
    """(doc, term, tf): occurrences times field weights. Each task adds up its own documents' terms."""
    return _field_terms(docs, fields, id_col).groupBy("doc", "term").agg(F.sum("w").alias("tf"))


def counted(docs: DataFrame) -> Column:
    """The number of documents, found as part of the plan that uses it."""
    return docs.agg(F.count("*")).scalar()


def term_stats(postings: DataFrame, n_docs: int | Column) -> DataFrame:
    """(term, df, idf). ``postings`` has each (doc, term) once."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0)


def doc_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc").agg(F.greatest(F.sum("tf"), F.lit(1.0)).alias("dl"))


def top_terms(postings: DataFrame, stats: DataFrame, k: int = OVERVIEW_TERMS) -> DataFrame:
    """The ``k`` terms of each document by tf * idf, then tf, then term, all descending."""
    w = Window.partitionBy("doc").orderBy(F.desc("score"), F.desc("tf"), F.desc("term"))
    scored = postings.join(stats, "term").withColumn("score", F.round(F.col("tf") * F.col("idf"), 9))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def build(docs: DataFrame, id_col: str, fields: dict[str, float] | None = None, long_field: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, term_stats, doc_stats), read from a written table; texts are read once.

    Terms of ``long_field`` beyond its best OVERVIEW_TERMS count for df alone.
    """
    fields = {f: w for f, w in (fields or FIELD_WEIGHTS).items() if f in docs.columns}
    long = F.col("field") == (long_field or "")
    sums = _field_terms(docs, fields, id_col).groupBy("doc", "term").agg(F.sum(F.when(long, 0.0).otherwise(F.col("w"))).alias("base"), F.sum(F.when(long, F.col("w")).otherwise(0.0)).alias("over"))
    every = written(sums, "postings")
    stats = term_stats(every, counted(docs))
    if long_field and long_field in fields:
        best = top_terms(every.filter("over > 0").select("doc", "term", F.col("over").alias("tf")), stats).select("doc", "term", F.lit(True).alias("best"))
        postings = every.join(best, ["doc", "term"], "left").select("doc", "term", (F.col("base") + F.when(F.col("best"), F.col("over")).otherwise(0.0)).alias("tf")).filter("tf > 0")
        postings = written(postings, "index")
    else:
        postings = every.select("doc", "term", F.col("base").alias("tf"))
    return postings, stats, doc_stats(postings)
