"""Command line: run a query over a folder of tables, answer requests, list what there is.

    python -m glossweave.cli queries
    python -m glossweave.cli run word_freq /data/tables /data/out
    python -m glossweave.cli answer /data/requests.jsonl /data/tables /data/answers
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="glossweave")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of all queries")
    run = commands.add_parser("run", help="write a query's result as parquet")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("out")
    answer = commands.add_parser("answer", help="answer a file of JSON requests, one a line")
    answer.add_argument("requests")
    answer.add_argument("tables")
    answer.add_argument("out")
    answer.add_argument("--threshold", type=float, default=0.05)
    given = parser.parse_args(arguments)

    from glossweave import catalogue
    from glossweave.plans import service

    if given.command == "queries":
        print("\n".join(sorted(catalogue.QUERIES)))
        return
    spark = SparkSession.builder.appName("glossweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "run":
        if given.query not in catalogue.QUERIES:
            parser.error(f"no query {given.query}")
        catalogue.QUERIES[given.query](spark, given.tables).write.mode("overwrite").parquet(given.out)
    else:
        requests = spark.read.text(given.requests).withColumn("id", F.xxhash64("value"))
        pem, names = service.prepared(spark, given.tables)
        service.answers(requests, "id", "value", pem, names, given.threshold).write.mode("overwrite").json(given.out)


if __name__ == "__main__":
    main()
