"""``python -m lumenrank CATALOGUE [PROMPTS [OUTPUT]]``: answer wishes typed in, or a table of prompts."""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.recommend import recommend
from .plans.service import history_cell, history_items, run_benchmark
from .sources.catalogue import read_catalogue


def main(args: list[str]) -> None:
    spark = SparkSession.builder.getOrCreate()
    items = read_catalogue(spark, args[0])
    if len(args) > 1:
        run_benchmark(spark, args[1], items, args[2] if len(args) > 2 else None)[1].show(truncate=False, vertical=True)
        return
    wish, past = input("Wish: ").strip(), input("Seen before (titles by commas): ").strip()
    asked = spark.createDataFrame([(0, wish, past)], "request_id int, text string, past string").select("request_id", "text", history_items(history_cell(F.col("past"))).alias("history"))
    for row in recommend(items, asked).select("title", "doc", "description").collect():
        print(f"{row.title} ({row.doc})\n{row.description}")


if __name__ == "__main__":
    main(sys.argv[1:])
