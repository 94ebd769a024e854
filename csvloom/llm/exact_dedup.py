"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Native: DataFrame functions only.  The first scan takes each text's byte length and the hash of a short
prefix.  Lengths held by one row are out at once; so are (length, prefix hash) pairs held by one row.  Both
are counted by grouping, which combines a hot length or group of copies within each task.  What survives
goes into bitmaps, and the second scan reads the full content (SHA-256) only of rows whose pair may be in
one.  Texts never enter a shuffle, and a row that a bitmap passes in error only costs a hash.

Defined results: a null text equals the empty one.  Of equal texts the row with the largest id stays; of
rows that repeat an id and a text, one stays.  A null id is below all others.  Empty tables give empty
results.  Texts may be of any length.  Other columns, whatever their names, do not matter; those named in ``carry`` pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csvloom.llm.common import bitmap, bits_for, flag, stage

#: Characters of the prefix that the second step hashes.
PREFIX_CHARS = 64


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), prefix_chars: int = PREFIX_CHARS, hash_col: str | None = None
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``full_hash`` and the carried columns.

    ``full_hash`` is the SHA-256 of texts that had to be read whole, null for those that were unique before.
    A caller that needs the SHA-256 of every text anyway names its column in ``hash_col``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    taken = {f"__c{i}": F.col(c) for i, c in enumerate(carry)}
    seen = docs.select(
        F.col(id_col).alias("__id"), text.alias("__t"), *([F.col(hash_col).alias("__sha")] if hash_col else []), *(c.alias(k) for k, c in taken.items())
    ).withColumns({"__n": F.octet_length("__t"), "__p": F.xxhash64(F.substring("__t", 1, prefix_chars))})

    sig = stage(seen.select("__n", "__p"), "dedup-sig")
    lengths = sig.groupBy("__n").agg(F.count("*").alias("__c")).where("__c > 1")
    shared = flag(sig, bitmap(lengths, "__n"), "__maybe", F.col("__n")).where("__maybe")
    pairs = stage(shared.groupBy("__n", "__p").agg(F.count("*").alias("__c")).where("__c > 1"), "dedup-pairs")
    bits = bits_for(pairs)

    marked = flag(seen, bitmap(pairs, "__n", "__p", bits=bits), "__maybe", F.col("__n"), F.col("__p"), bits=bits)
    hashed = stage(
        marked.select(
            "__id",
            F.monotonically_increasing_id().alias("__tag"),
            F.when(F.col("__maybe"), F.col("__sha") if hash_col else F.sha2("__t", 256)).alias("__h"),
            F.when(~F.col("__maybe"), F.concat_ws(":", "__n", "__p")).alias("__alone"),
            *taken,
        ).withColumn("__key", F.coalesce("__h", "__alone")).drop("__alone"),
        "dedup-hash",
    )
    groups = hashed.groupBy("__key").agg(F.max(F.struct("__id", "__tag")).alias("__keep"), F.count("*").alias("__size"))
    # written, so that the join's sides are plain exchanges, of which Spark splits one that a large group makes long
    shared = stage(groups.where("__size > 1").withColumnRenamed("__key", "__shared"), "dedup-groups")
    keep = F.coalesce(F.col("__keep"), F.struct("__id", "__tag"))
    return hashed.join(shared, F.col("__key") == F.col("__shared"), "left").select(
        F.col("__id").alias(id_col),
        keep["__id"].alias("keep_id"),
        F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("__tag") == keep["__tag"]).alias("kept"),
        F.col("__h").alias("full_hash"),
        *(F.col(k).alias(c) for k, c in zip(taken, carry, strict=True)),
    )
