"""Wiring check: session, paths, scan, shuffle and SQL comparison in one query.

It is not an operator of the surveyed project and must not be counted as one.

The filter reaches the parquet scan and only four columns are read. Rows are
summed before the shuffle, so each task sends at most one row per
(l_returnflag, l_linestatus) pair however large or skewed the table is.
Quantities are whole numbers, so their sum does not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import read_table

SQL = """
SELECT l_returnflag, l_linestatus,
       sum(l_quantity) AS sum_qty,
       count(*) AS n_rows
FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus
"""


def wiring_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(read_table(spark, sf_dir, "lineitem"))


def summarize(lineitem: DataFrame) -> DataFrame:
    cutoff = F.lit("1998-09-02 00:00:00").cast("timestamp_ntz")
    return (
        lineitem.filter(F.col("l_shipdate") <= cutoff)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )
