"""Importance resampling towards a target: hashed n-gram features, a gain for each bucket, Gumbel top-k.

Dictionary. The distinct words of both corpora get integer ids, once, in a written
table with their counts. An n-gram is a tuple of ids. Each distinct tuple's text
is put together and hashed once, and what its bucket gains is joined back to the tuples of
documents. A tuple of one is its word's row, so ``max_n`` = 1 needs no second dictionary.

Joins. Words (and tuples) that make up at least one in ``HEAVY`` of all occurrences
are at most ``HEAVY``, so they are broadcast, and with them go the hot keys; the
others are joined by a shuffle, where no key has a larger share than that.

Draw. Scores are ranked by a range sort: each row keeps its place in its
partition, and the partitions' row counts, one number each, meet on the driver.

Defined cases: a null text has no words; a document without features has weight 0; a null
doc_id counts as '' in the hash and comes last among ties; rows that repeat are rows of their own, each drawn by itself; an
empty table gives no rows, an empty target leaves every t at 0. Rows that share a doc_id are told apart by a 64-bit hash of their texts.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ensure_checkpoint_dir, remove, text_or_empty

#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Floors and logarithms count in thousandths.
UNIT = 1000
SEED = 2024
LEAST_WORDS = 20
#: Percent of the documents with enough words that are drawn.
PERCENT = 10
HEAVY, HEAVY_BYTES = 1 << 19, 64


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def floor_div(a: Column, b: Column) -> Column:
    """The floored quotient of two integers, b positive."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def lookup(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """An inner join by ``on``, unique in ``table``; its rows marked ``frequent``, of proven number, are broadcast."""
    head, tail = table.filter("frequent").drop("frequent"), table.filter("NOT frequent").drop("frequent")
    known = rows.join(F.broadcast(head), on)
    rest = rows.join(F.broadcast(head.select(on)), on, "left_anti").join(tail, on)
    return known.unionByName(rest)


class Stages:
    """Written tables of one run."""

    def __init__(self, spark):
        self.spark, self.folder = spark, f"{ensure_checkpoint_dir(spark)}/resampling-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")


def occurrences(docs: DataFrame) -> DataFrame:
    """A row for each word of each document: doc_id, key, at, word."""
    return docs.select("doc_id", "key", F.posexplode(words(F.col("text"))).alias("at", "word"))


def dictionary(docs: DataFrame, target: DataFrame) -> DataFrame:
    """word, id, s and t: how often the documents and the target have it; and whether it is frequent."""
    told = lambda x, s: x.select(F.explode(words(F.col("text"))).alias("word")).select("word", F.lit(s).alias("s"))
    counted = told(docs, 1).unionByName(told(target, 0)).groupBy("word").agg(F.sum("s").cast("long").alias("s"), F.sum(1 - F.col("s")).cast("long").alias("t"))
    return counted.withColumn("id", F.monotonically_increasing_id())


def frequent(table: DataFrame, of: Column | None = None) -> DataFrame:
    """Marks the rows that hold one in HEAVY of all occurrences in the documents."""
    total = table.agg(F.sum("s")).first()[0] or 0
    mark = (F.col("s") * HEAVY >= total) & (F.col("s") > 0)
    return table.withColumn("frequent", mark & of if of is not None else mark)


def id_sequences(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, key, copies, ids: each different document's words as ids, in order."""
    met = lookup(occurrences(docs), table.select("word", "id", "frequent"), "word")
    grouped = met.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("at", "id"))).alias("row"), F.sum((F.col("at") == 0).cast("long")).alias("copies"))
    return grouped.select("doc_id", "key", "copies", F.col("row.id").alias("ids"))


def tuples(sequences: DataFrame, max_n: int) -> DataFrame:
    """A row for each run of 1 to ``max_n`` ids."""
    runs = lambda n: F.when(F.size("ids") >= n, F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda i: F.slice("ids", i, n)))
    grams = F.flatten(F.filter(F.array(*[runs(n) for n in range(1, max_n + 1)]), lambda x: x.isNotNull()))
    return sequences.select("doc_id", "key", "copies", F.explode(grams).alias("gram"))


def tuple_table(own: DataFrame, target: DataFrame, table: DataFrame) -> DataFrame:
    """gram, s, t, text: the distinct tuples of both, and each one's words again."""
    s = own.select("gram", F.col("copies").alias("s"), F.lit(0).cast("long").alias("t"))
    t = target.select("gram", F.lit(0).cast("long").alias("s"), F.col("copies").alias("t"))
    counted = s.unionByName(t).groupBy("gram").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    spelled = lookup(counted.select("gram", "s", "t", F.posexplode("gram").alias("at", "id")), table.select("id", "word", "frequent"), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return spelled.groupBy("gram").agg(F.first("s").alias("s"), F.first("t").alias("t"), text.alias("text"))


def with_gains(table: DataFrame, text: str, buckets: int) -> DataFrame:
    """``gain`` of the bucket that each row's text falls into."""
    table = table.withColumn("bucket", F.crc32(F.col(text).cast("binary")) % buckets)
    sums = table.groupBy("bucket").agg(F.sum("s").alias("bs"), F.sum("t").alias("bt"))
    total = sums.agg(F.sum("bs").alias("s"), F.sum("bt").alias("t")).first()
    ratio = (F.col("bt") + 1.0) * F.lit(float((total["s"] or 0) + buckets)) / ((F.col("bs") + 1.0) * F.lit(float((total["t"] or 0) + buckets)))
    gains = sums.select("bucket", F.floor(UNIT * F.log(ratio)).alias("gain"))
    return table.join(F.broadcast(gains), "bucket")  # at most ``buckets`` rows


def gumbel(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-UNIT * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, seed: int = SEED, stages: Stages | None = None) -> DataFrame:
    """doc_id, key, copies, n_words, n_features, weight, score of each different document. ``docs`` has doc_id and text, ``target`` text."""
    stages = stages or Stages(docs.sparkSession)
    docs = docs.select("doc_id", text_or_empty().alias("text")).withColumn("key", F.xxhash64("text"))
    target = target.select(F.lit(0).alias("doc_id"), text_or_empty().alias("text")).withColumn("key", F.xxhash64("text"))
    table = frequent(stages.write(dictionary(docs, target), "words"), F.octet_length("word") <= HEAVY_BYTES)
    if max_n == 1:
        grams = stages.write(with_gains(table, "word", buckets), "grams").select("word", "id", "gain", "frequent")
        met = lookup(occurrences(docs).select("doc_id", "key", "word"), grams, "word").withColumn("copies", F.lit(1))
    else:
        own = tuples(stages.write(id_sequences(docs, table), "ids"), max_n)
        asked = id_sequences(target, table.withColumn("frequent", F.lit(False)))
        grams = frequent(stages.write(with_gains(tuple_table(own, tuples(asked, max_n), table), "text", buckets), "grams").select("gram", "s", "gain"))
        met = lookup(own, grams.drop("s"), "gram")
    n = F.size(words(F.col("text")))
    n_features = sum((F.greatest(n - k, F.lit(0)) for k in range(1, max_n)), n)
    zero = F.lit(0).cast("long")
    base = docs.select("doc_id", "key", F.lit(1).cast("long").alias("copies"), n.cast("long").alias("n_words"), n_features.cast("long").alias("n_features"), zero.alias("gain"))
    gained = met.groupBy("doc_id", "key").agg(F.sum(F.col("gain") * F.col("copies")).alias("gain")).select("doc_id", "key", zero.alias("copies"), zero.alias("n_words"), zero.alias("n_features"), "gain")
    summed = base.unionByName(gained).groupBy("doc_id", "key").agg(*[F.sum(c).alias(c) for c in ("copies", "n_words", "n_features", "gain")])
    weight = F.when(F.col("n_features") > 0, floor_div(F.col("gain"), F.col("n_features"))).otherwise(0)
    each = lambda c: (F.col(c) / F.col("copies")).cast("long").alias(c)
    out = summed.select("doc_id", "key", "copies", each("n_words"), each("n_features"), weight.alias("weight"))
    return out.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, max_n: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document; drawn are the ``percent`` highest scores."""
    spark = docs.sparkSession
    stages = Stages(spark)
    scored = stages.write(weigh(docs, target, max_n, buckets, seed, stages), "scored")
    stages.drop("words", "ids", "grams")
    allowed = F.col("n_words") >= least_words
    rows = lambda x: x.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    columns = ("doc_id", "n_features", "weight", "score")
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("key"), F.col("copy")
    ordered = rows(scored.filter(allowed)).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = stages.write(ordered.select(*columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "ordered")
    counts = dict(sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()))  # one number for each partition
    drawn = sum(counts.values()) * percent // 100
    before = spark.createDataFrame(list(zip(counts, accumulate(counts.values(), initial=0))), "part int, before long")
    rank = F.col("before") + F.col("at") + 1
    ranked = ordered.join(F.broadcast(before), "part").select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(rows(scored.filter(~allowed)).select(*columns, F.lit(None).cast("long").alias("rank")))
