"""Embedding artifacts: vectors and ids in one table, metadata beside it, and whether they may be used."""

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue, commits

#: Values of a credential that mean none.
PLACEHOLDERS = {"", "your_key_here", "your_key", "xxxxx", "xxxx", "replace_me"}
MODEL, DIM = "hashing", 384


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """An object as JSON with sorted keys, in one file of the folder ``path``."""
    spark.createDataFrame([(json.dumps(payload, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """The object that ``write_json`` wrote, or a JSON file of any layout."""
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def write_vectors(vectors: DataFrame, path: str, metadata: dict | None = None, id_col: str = "doc") -> None:
    """(id, embedding) as Parquet, the ids beside their vectors, and the metadata in ``path``-meta. The new table takes the old one's place in one step."""
    spark = vectors.sparkSession
    commits.swap(vectors.select(F.col(id_col).alias("doc"), F.col("embedding").cast("array<float>").alias("embedding")), path)
    count = commits.read_swapped(spark, path).count()
    write_json(spark, path.rstrip("/") + "-meta", {"artifact": "embeddings", "rows": count, "dim": DIM, "model": MODEL, **(metadata or {})})


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(doc, embedding)."""
    return commits.read_swapped(spark, path).select("doc", "embedding")


def metadata(spark: SparkSession, path: str) -> dict:
    """The artifact's metadata, empty if there is none."""
    where = path.rstrip("/") + "-meta"
    return read_json(spark, where) if catalogue.exists(spark, where) else {}


def readiness(spark: SparkSession, path: str, source: str, credential: str | None = None) -> dict:
    """Whether dense recall may run, and why not: artifacts that lack or were built from another source, or a credential that lacks.

    ``credential`` names the environment variable that an encoder needs; None for an offline one.
    """
    meta = metadata(spark, path)
    told = {"model": meta.get("model", MODEL), "dim": meta.get("dim")}
    known = {"name", "sha256", "size"} <= set(meta) and commits.current(spark, path) is not None
    if not known or not catalogue.is_current(spark, spark.createDataFrame([(meta["name"], meta["sha256"], int(meta["size"]))], "name string, sha256 string, size long"), source):
        return {"ready": False, "reason": "artifacts_unavailable", **told}
    if credential is not None and os.environ.get(credential, "").strip().lower() in PLACEHOLDERS:
        return {"ready": False, "reason": "credential_missing", **told}
    return {"ready": True, "reason": "ok", **told}
