"""Written stages: a table in the shared checkpoint folder, so that later plans start from a scan and lost executors cost one stage."""

import tempfile
import time
import uuid
import weakref
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one only in local mode, where there is none, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="stages-")
    return _local[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone, and its temporary folder with it
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own. Readers prune its columns and know its size.

    ``release`` deletes it, and so does the end of the ``scratch`` that it is written in.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/stage-{uuid.uuid4().hex}-{name}"
    seen, began = Observation(), time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    _log.append((name, round(time.perf_counter() - began, 3), seen.get["rows"]))
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for scope in _scopes:
        scope.append((spark, path))
    return out


_scopes: list[list] = []


#: How many times as large as its file Spark takes a table's rows to be. Repeated values make files some fifty times smaller
#: than rows; without this, a table of a million rows counts as small and is sent through the driver for a broadcast.
UNPACKED = 32
_FACTOR = "spark.sql.sources.fileCompressionFactor"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it, written tables are temporary: all of them go at its end but those handed to the function that it gives.

    Plans that run within it take tables' files for UNPACKED times their size at least.
    """
    mine, kept = [], set()
    _scopes.append(mine)
    before = spark.conf.get(_FACTOR)
    spark.conf.set(_FACTOR, str(max(float(before), UNPACKED)))

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_paths[table])
        return table

    try:
        yield keep
    finally:
        spark.conf.set(_FACTOR, before)
        _scopes.remove(mine)
        for spark, path in mine:
            if path not in kept:
                remove(spark, path)


#: (stage, seconds, rows) of the latest written tables.
_log: "deque[tuple[str, float, int]]" = deque(maxlen=1000)


def timings(clear: bool = True) -> list[tuple[str, float, int]]:
    """(stage, seconds, rows) of the tables written since the last call, in order."""
    told = list(_log)
    if clear:
        _log.clear()
    return told


_paths: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            remove(table.sparkSession, path)
