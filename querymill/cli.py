"""Facts of the queries in a text file, one a line (lines with # are skipped): spark-submit querymill/cli.py QUERIES TABLES OUT."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from querymill.operators import facts
from querymill.plans.facts import dictionary
from querymill.sources.readers import lines, write_rows


def main(argv: list[str]) -> None:
    path, tables, out = argv
    spark = SparkSession.builder.getOrCreate()
    queries = lines(spark, path).where(~F.col("phrase").startswith("#")).select(F.monotonically_increasing_id().alias("id"), F.col("phrase").alias("query"))
    found = queries.join(facts.extract(queries, dictionary(spark, tables)), "id", "left").withColumn("colors", F.array_join("colors", " "))
    write_rows(found, out)


if __name__ == "__main__":
    main(sys.argv[1:])
