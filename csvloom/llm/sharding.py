"""Contiguous shards of equal bytes from global prefix sums.

Native: DataFrame functions only.  Rows, reduced to id, size and checksum, are dealt to range partitions of
the id and written once, so that partition numbers hold.  Each partition's total goes into a running sum
over the partitions (one small row each); a window inside each partition adds the rest.  A row whose bytes
have their midpoint in the k-th of n equal parts of the total goes to shard k, so shards are contiguous in
id order and each is within one document of the target.

Defined results: a null text has no bytes.  A null id comes first.  Rows that repeat an id are ordered by
checksum and size.  An empty table has no shards.  Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csvloom.llm.common import partitions, stage

#: Bytes counted for each document beside its text.
ROW_OVERHEAD = 8


def byte_shards(
    docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = ROW_OVERHEAD
) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``shard`` (0 to n_shards - 1), ``slot`` (its place in it)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.col(text_col)
    order: list[str | Column] = ["__id", "__crc", "__size"]
    narrow = docs.select(
        F.col(id_col).alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("__size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("__crc"),
    )
    dealt = narrow.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("__part", F.spark_partition_id())
    rows = stage(dealt, "shard-rows")

    totals = rows.groupBy("__part").agg(F.sum("__size").alias("__bytes"), F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        "__part",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes0"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
        F.sum("__bytes").over(Window.partitionBy()).alias("__total"),
    )
    inside = Window.partitionBy("__part").orderBy(*order)
    placed = (
        rows.withColumn("__end", F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__at", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__part")  # as many rows as range partitions
        .select(
            "__id",
            "__size",
            "__crc",
            (F.col("__n0") + F.col("__at") - 1).alias("__row"),
            F.expr(
                f"cast(least({n_shards - 1}, ((__bytes0 + __end) * 2 - __size) * {n_shards} div greatest(__total * 2, 1)) as int)"
            ).alias("__shard"),
        )
    )
    starts = placed.groupBy("__shard").agg(F.min("__row").alias("__first"))  # one row per shard
    return placed.join(F.broadcast(starts), "__shard").select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__shard").alias("shard"),
        (F.col("__row") - F.col("__first")).alias("slot"),
    )
