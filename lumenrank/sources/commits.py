"""Sinks that a killed job leaves whole: parts that count once a manifest names them, and tables that are swapped.

A part is a folder of Parquet files under ``parts``; it counts when its manifest, a
small file of its name, is there. A manifest is written beside its place and renamed onto it, which a
file system does at once or not at all. Readers open only parts that have one, so what a
killed job left behind is never read, and the next run writes just the parts that lack.
"""

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from .stages import remove

MANIFESTS, PARTS, CURRENT = "manifests", "parts", "current"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a file onto another in one step, whether that is there or not."""
    jvm, old, _ = _fs(spark, source)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if old.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(old, jvm.org.apache.hadoop.fs.Path(target), options)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm, target, fs = _fs(spark, path)
    fresh = f"{path}.{uuid.uuid4().hex}.tmp"
    out = fs.create(jvm.org.apache.hadoop.fs.Path(fresh))
    out.write(bytearray(text.encode()))
    out.close()
    _rename(spark, fresh, path)


def _read_text(spark: SparkSession, path: str) -> str:
    _, target, fs = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def manifests(spark: SparkSession, path: str) -> dict[str, dict]:
    """What each committed part's manifest says, by the part's name."""
    _, target, fs = _fs(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(target):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return {n.removesuffix(".json"): json.loads(_read_text(spark, f"{path}/{MANIFESTS}/{n}")) for n in sorted(names) if n.endswith(".json")}


def write_part(df: DataFrame, path: str, name: str, **told) -> None:
    """Write a part and commit it under ``name``; one of that name from before is replaced in the same step."""
    spark, folder = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{PARTS}/{folder}")
    old = manifests(spark, path).get(name)
    _write_text(spark, f"{path}/{MANIFESTS}/{name}.json", json.dumps({"folder": folder, **told}, sort_keys=True))
    if old:
        remove(spark, f"{path}/{PARTS}/{old['folder']}")


def read_parts(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The rows of all committed parts; None without any, or an empty table where ``schema`` is told."""
    folders = [f"{path}/{PARTS}/{m['folder']}" for m in manifests(spark, path).values()]
    if not folders:
        return None if schema is None else spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(*folders)


def resume(spark: SparkSession, path: str, names: Iterable[str], work: Callable[[str], DataFrame], told: Callable[[str], None] | None = None) -> list[str]:
    """Write and commit ``work(name)`` for each name that isn't committed yet, one after the other; the names that were. ``told`` hears of each one."""
    done, new = set(manifests(spark, path)), []
    for name in names:
        if name not in done:
            write_part(work(name), path, name)
            new.append(name)
            if told is not None:
                told(name)
    return new


def swap(df: DataFrame, path: str) -> None:
    """Write a new version of a table and make it the current one in one step; the old one goes after that. ``df`` may read the old one."""
    spark, folder = df.sparkSession, f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    old = current(spark, path)
    _write_text(spark, f"{path}/{CURRENT}", folder)
    if old:
        remove(spark, f"{path}/{old}")


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of a swapped table's current version."""
    _, target, fs = _fs(spark, f"{path}/{CURRENT}")
    return _read_text(spark, f"{path}/{CURRENT}") if fs.exists(target) else None


def read_swapped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{current(spark, path)}")
