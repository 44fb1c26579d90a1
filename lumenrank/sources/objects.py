"""A Spark data source of JSON objects over HTTP: ``spark.read.format("json_objects")``, one row for each key of a range.

Options: base, path (with ``{key}``), first, last, parts, and key or token as the credential; timeout and workers if wanted.
Each partition reads its own range of keys, and reading is a pure function of the range, so a
retried task gives the same rows. A key whose object can't be had has a null ``detail``: the next run tries it again.
"""

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .package import ship
from .rest import JsonSource


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ObjectReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[Range]:
        first, last, parts = int(self.options["first"]), int(self.options["last"]), max(1, int(self.options.get("parts", 8)))
        n = max(0, last - first + 1)
        cuts = [first + n * i // parts for i in range(parts + 1)]
        return [Range(a, b - 1) for a, b in zip(cuts, cuts[1:]) if a < b] or [Range(first, first - 1)]

    def read(self, partition: Range) -> Iterator[tuple]:
        o = self.options
        source = JsonSource(o["base"], o.get("key", ""), o.get("token", ""), float(o.get("timeout", 5)), int(o.get("workers", 8)))
        keys = list(range(partition.first, partition.last + 1))
        for at in range(0, len(keys), 256):
            part = keys[at : at + 256]
            found = source.fetch(lambda k: o["path"].replace("{key}", str(k)), part)
            for k in part:
                yield k, json.dumps(found[k]) if k in found else None


class ObjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_objects"

    def schema(self) -> str:
        return "key long, detail string"

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session and its executors."""
    ship(spark)
    spark.dataSource.register(ObjectSource)
