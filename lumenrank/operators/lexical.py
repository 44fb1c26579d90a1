"""BM25 over an index, for many requests at once."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stems
from ..functions.values import BM25_B, BM25_K1, LEXICAL_TOP
from .ranking import without


def bm25(tf: Column, dl: Column, avgdl: Column, idf: Column) -> Column:
    return F.when(tf > 0, idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / F.greatest(avgdl, F.lit(1.0))))).otherwise(0.0)


#: Query terms that are sent to all tasks; more of them meet the postings by a shuffle.
SENT = 500_000


def query_terms(requests: DataFrame, text_col: str = "text") -> DataFrame:
    """(request_id, term, qtf)."""
    return requests.select("request_id", F.explode(stems(F.col(text_col))).alias("term")).groupBy("request_id", "term").agg(F.count("*").alias("qtf"))


def search(terms: DataFrame, postings: DataFrame, stats: DataFrame, lengths: DataFrame, exclude: DataFrame | None = None, k: int = LEXICAL_TOP, digits: int = 6) -> DataFrame:
    """(request_id, doc, bm25_raw, bm25_score, bm25_rank) of the top ``k``; score is min-max over them.

    ``exclude`` holds (request_id, doc). Query terms meet postings by an equality
    join on the term: up to SENT of them are broadcast, so that postings stay where
    they are and a frequent term is no single task's; documents that share no term never appear.
    """
    avgdl = F.coalesce(lengths.agg(F.avg("dl")).scalar(), F.lit(1.0))
    weighed = terms.join(stats.select("term", "idf"), "term", "left")
    few = terms.limit(SENT + 1).count() <= SENT
    met = postings.join(F.broadcast(weighed) if few else weighed, "term").join(lengths, "doc")
    part = F.col("qtf") * bm25(F.col("tf"), F.col("dl"), avgdl, F.coalesce("idf", F.lit(1.0)))
    scored = met.groupBy("request_id", "doc").agg(F.round(F.sum(part), digits).alias("bm25_raw")).filter("bm25_raw > 0")
    if exclude is not None:
        scored = without(scored, exclude, ["request_id", "doc"])
    return ranked(scored, "bm25", k)


def ranked(scored: DataFrame, name: str, k: int) -> DataFrame:
    best = Window.partitionBy("request_id").orderBy(F.desc(f"{name}_raw"), "doc")
    every = Window.partitionBy("request_id")
    top = scored.withColumn(f"{name}_rank", F.row_number().over(best)).filter(F.col(f"{name}_rank") <= k)
    low, high = F.min(f"{name}_raw").over(every), F.max(f"{name}_raw").over(every)
    return top.withColumn(f"{name}_score", (F.col(f"{name}_raw") - low) / F.greatest(high - low, F.lit(1e-6)))
