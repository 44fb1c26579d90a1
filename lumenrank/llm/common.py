"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
#: The same as a Java character class, negated: one word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` has a fast path for pure ASCII, where it is the same thing; other
    texts go through ``translate``, which leaves letters beyond ASCII alone.
    """
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    A lambda over an array of one element binds the value to a variable, so that
    nested lambdas can refer to it without computing it again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's, or a fresh local one in local mode where none is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lumenrank-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and read it from there.

    The files outlive any executor, and Spark removes them when the driver lets
    the frame go, if the cluster has its checkpoint cleaner on.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_name(stem: str) -> str:
    """A column name that no input table has."""
    return f"__{stem}_{uuid.uuid4().hex[:8]}"


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed, which picks one of several rows that a rule leaves equal."""
    plain = [f.name for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant", "interval"))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def one_row_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the one with the least ``row_hash``. Aggregated before the shuffle, so that a hot key is no task's burden."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*[F.col(f"`{k}`").alias(f"__key_{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, row_hash(df)).alias("__row"))
    return best.select(*[F.col("__row")[c].alias(c) for c in df.columns])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenrank_sent", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="lumenrank-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._lumenrank_sent = sc.applicationId
