"""Micro-batch answering of a request stream: an extension, since the batch plan answers any number of requests."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans.recommend import recommend


def answer_stream(requests: DataFrame, catalogue: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that answers each micro-batch of ``requests`` and hands it to ``sink``."""
    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(recommend(catalogue, batch), n)).start()
