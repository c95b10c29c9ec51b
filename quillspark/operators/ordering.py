"""Row numbers within keys that may be hot: no task gets all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quillspark.session import keep


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`: 0, 1, 2, ... within the keys, in the order of `order` (which must tell all rows of a key apart).

    Rows are sorted in ranges of keys and order; each range numbers its own, and what the ranges before it hold of the
    same key is added. Only a key that goes over several ranges has such an offset, so there are fewer than ranges.
    """
    session = df.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    ranges = keep(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_range")) - F.col("_n"))
    before = before.filter("_before > 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before")
    own = ranges.withColumn("_own", F.row_number().over(W.partitionBy("_range", *keys).orderBy(*order)) - 1)
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # at most one row for each range but the first: fewer than `parts`
    j = own.join(F.broadcast(before), same, "left")
    return j.withColumn(name, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("bigint")).drop("_range", "_own", "_before", "_r", *[f"_k{i}" for i in range(len(keys))])
