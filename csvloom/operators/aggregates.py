"""Aggregates over scanned records, as built-in functions wherever Spark has them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def arg_max(df: DataFrame, value: Column, key: Column, tie: Column) -> DataFrame:
    """The value of the largest key; among equal keys that of the largest ``tie`` (such as the offset)."""
    return df.agg(F.max(F.struct(key.alias("key"), tie.alias("tie"), value.alias("value"))).alias("m")).select("m.value", "m.key")


def ragged_max(fields: Column, begin: int = 2) -> Column:
    """The largest number among the fields from ``begin`` (counted from 1) on; null without any."""
    return F.array_max(F.transform(F.slice(fields, F.lit(begin), F.greatest(F.size(fields) - (begin - 1), F.lit(0))), lambda x: x.cast("double")))


def validated(df: DataFrame, good: Column, message: str) -> DataFrame:
    """``df``, failing the query at the first row that is not good: an assertion, not a filter."""
    return df.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def in_file_order(df: DataFrame, value: str, offset: str = "_record_offset", path: str = "_path") -> DataFrame:
    """Rows (path, offset, value) sorted by file and place over all partitions: a collected column that never sits in one row."""
    return df.select(F.col(path).alias("path"), F.col(offset).alias("offset"), F.col(value).alias("value")).orderBy("path", "offset")


def running(df: DataFrame, order: list[str], value: Column, folder: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each one in an order, without one task that sees them all.

    Rows go to ranges of the order, written below ``folder`` so that the ranges hold; they are summed within and
    begin after the totals of those before.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{folder}/running-{uuid.uuid4().hex}"
    df.withColumn("__value", value).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = ranged.groupBy("__part").agg(F.sum("__value").alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__at", F.sum("__value").over(inside)).join(F.broadcast(totals), "__part")  # as many rows as ranges
    return summed.withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before", "__value")


def numbered(df: DataFrame, order: list[str], folder: str, name: str = "pos") -> DataFrame:
    """Adds the place of each row in an order over all rows, counted from 1; ``order`` must leave no ties."""
    return running(df, order, F.lit(1).cast("bigint"), folder, name)


def row_digest(df: DataFrame) -> DataFrame:
    """Count and an order-insensitive checksum of all rows: two inputs with equal records have equal digests.

    Hashes are summed modulo 2**64 in two 32-bit halves, so equal rows do not cancel and no sum overflows.
    """
    cells = [F.col(c) for c in df.columns]
    h = F.xxhash64(F.array(*(c.cast("string") for c in cells)) if len(cells) > 1 or df.dtypes[0][1][:5] != "array" else cells[0])
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return df.agg(
        F.count("*").alias("n"),
        (F.coalesce(F.sum(low), F.lit(0)) % (1 << 32)).alias("low"),
        (F.coalesce(F.sum(high), F.lit(0)) % (1 << 32)).alias("high"),
    )


def compare_digests(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: (n, equal).  Counts are looked at first, then checksums."""
    left, right = row_digest(a).withColumn("side", F.lit(0)), row_digest(b).withColumn("side", F.lit(1))
    both = left.unionByName(right).groupBy().agg(F.max("n").alias("n"), F.min("n").alias("least"), F.count_distinct("low", "high").alias("sums"))
    return both.select("n", ((F.col("n") == F.col("least")) & (F.col("sums") == 1)).alias("equal"))


def ordered_fold(df: DataFrame, order: str, zero: Column, step: Callable[[Column, Column], Column], value: str, groups: list[str]) -> DataFrame:
    """A user's fold over the values of each group in order, as a native aggregate (groups must be small)."""
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*groups).agg(F.aggregate(rows, zero, lambda s, r: step(s, r[value])).alias("state"))
