"""Readers of tables: catalogue, ratings, prompts; and files' fingerprints."""

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import first_by
from .package import ship
from .stages import written

CATALOGUE = (
    "tmdb_id title original_title genres keywords top_cast director overview tagline original_language production_countries spoken_languages "
    "production_companies collection_id collection_name year runtime_min vote_average vote_count imdb_id imdb_rating imdb_votes imdb_source updated_at "
    "similar_tmdb_ids similar_titles recommended_tmdb_ids recommended_titles alternative_titles us_rating essence tone_tags_json audience_tags_json "
    "source_tags_json keywords_augmented_json"
).split()
RATINGS = "imdb_id string, imdb_rating string, imdb_votes string, imdb_source string, updated_at string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, dealt over all of them; a larger one stays as it is, so no text is moved at scale."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Short rows before costly work on each, dealt by their key over several tasks a core: a small file of many rows has few splits, or few row groups in many."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """An all-string table with a header; tabs for .tsv. Quotes double, cells may span lines."""
    sep = "\t" if path.lower().endswith(".tsv") else ","
    return spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).csv(path)


def ensure_columns(df: DataFrame, names=CATALOGUE) -> DataFrame:
    return df.withColumns({c: F.lit("") for c in names if c not in df.columns})


def active_path(spark: SparkSession, enriched: str, base: str) -> str:
    """The enriched table where it exists, else the base."""
    return enriched if exists(spark, enriched) else base


def read_catalogue(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """The catalogue with all its columns as text, blanks for nulls and for columns that lack; ``base`` is read where ``path`` isn't there."""
    table = ensure_columns(read_table(spark, active_path(spark, path, base) if base else path))
    return table.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in table.columns])


def ratings(table: DataFrame) -> DataFrame:
    """imdb_id, imdb_rating, imdb_votes: trimmed keys, blanks dropped, the last row of a key wins.

    Without its three columns the table counts as empty.
    """
    if not {"tconst", "averageRating", "numVotes"} <= set(table.columns):
        return table.sparkSession.createDataFrame([], "imdb_id string, imdb_rating string, imdb_votes string")
    rows = table.select(F.trim("tconst").alias("imdb_id"), F.col("averageRating").alias("imdb_rating"), F.col("numVotes").alias("imdb_votes"), F.monotonically_increasing_id().alias("at"))
    return first_by(rows.filter("imdb_id <> ''"), ["imdb_id"], F.desc("at")).drop("at")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``ratings`` of a file with its name as imdb_source, and a blank updated_at; a file that isn't there has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], RATINGS)
    return ratings(read_table(spark, path)).withColumns({"imdb_source": F.lit(path.rstrip("/").rsplit("/", 1)[-1]), "updated_at": F.lit("")})


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("comment", "#").option("escape", '"').csv(path)


def most_voted(items: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` items with the most votes; rows whose votes are no number don't count."""
    votes = F.col("vote_count").cast("string").try_cast("double")
    return items.withColumn("__v", votes).filter("__v is not null").orderBy(F.desc("__v"), "tmdb_id").limit(n).drop("__v")


def lookup(items: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (doc) with the items' titles; an id that no item has is ``Unknown``."""
    titles = items.select(F.col("tmdb_id").cast("long").alias("doc"), "title").dropDuplicates(["doc"])
    return ids.join(titles, "doc", "left").na.fill("Unknown", ["title"])


def first_rows(df: DataFrame, order: list, n: int | None) -> DataFrame:
    """The scope of an offline job: the first ``n`` rows in an order, or all."""
    return df if n is None else df.orderBy(*order).limit(max(0, n))


def chunked(df: DataFrame, order: list, size: int) -> DataFrame:
    """A scope's rows with the ``chunk`` that each falls into, ``size`` rows a chunk in the given order.

    Positions come from ranges: rows are sorted over partitions, and each adds the counts of those before it.
    The ranges are written once: their bounds are sampled, and a second run of the plan would draw others than were counted.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    ranged = written(ranged.withColumn("__i", F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    counts = {r["__p"]: r["n"] for r in ranged.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # one number a partition
    before, offsets = 0, []
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(before).cast("long")]
        before += counts[p]
    if not offsets:
        return df.withColumn("chunk", F.lit(0).cast("long"))
    at = F.element_at(F.create_map(*offsets), F.col("__p")) + F.col("__i")
    return ranged.withColumn("chunk", F.floor(at / max(1, size)).cast("long")).drop("__p", "__i")


#: Bytes of a file that are held at once.
BLOCK = 8 << 20


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 and size of each file that ``path`` (a file, folder or pattern) names; one task streams each file, whatever its length."""
    ship(spark)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for given in fs.globStatus(target) or [] for s in (fs.listStatus(given.getPath()) if given.isDirectory() else [given])]
    files = [(s.getPath().toString(), s.getPath().getName()) for s in found if s.isFile()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for x in frames:
            for uri, name in zip(x["uri"], x["name"]):
                # Hadoop writes file:/x where the standard has file:///x
                where, at = FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                digest, size = hashlib.sha256(), 0
                with where.open_input_stream(at, compression=None) as stream:
                    while block := stream.read(BLOCK):
                        digest.update(block)
                        size += len(block)
                yield pd.DataFrame({"name": [name], "sha256": [digest.hexdigest()], "size": [size]})

    rows = spark.createDataFrame(files, "uri string, name string").repartition(max(1, len(files)))
    return rows.mapInPandas(run, "name string, sha256 string, size long")


def is_current(spark: SparkSession, metadata: DataFrame | None, path: str) -> bool:
    """Whether ``metadata`` (name, sha256, size) describes the file as it is now."""
    if metadata is None or not exists(spark, path):
        return False
    now = fingerprint(spark, path).select("name", "sha256", "size")
    return bool(now.join(metadata.select("name", "sha256", F.col("size").cast("long").alias("size")), ["name", "sha256", "size"], "left_semi").take(1))
