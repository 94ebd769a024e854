"""Helpers shared by the operators: staged tables, bitmaps of bounded size, session settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bits in a survivor bitmap, by the number of keys: 2**24 bits travel as 2**18 rows of 64 bits (about 10 MB once hashed), the
#: largest as 2**21 rows (some 80 MB).  With more keys than bits it only passes more rows on to the exact step.
BITMAP_BITS, MOST_BITS = 1 << 24, 1 << 27


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine gets a temporary folder; on a cluster, where nobody
    else could read that, it is an error.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="csvloom-")
        spark.sparkContext.setCheckpointDir(held)
        held = spark.sparkContext.getCheckpointDir() or held
    return held.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again.

    It cuts lineage: after the write a lost executor costs no earlier work, and values that depend on how
    the plan ran (partition numbers, row tags) are fixed.  Its files go with :func:`release`, else when the
    session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bit_position(*cols: Column, bits: int = BITMAP_BITS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(bits))


def bits_for(keys: DataFrame) -> int:
    """Bits for a bitmap of so many keys: sixteen for each, within the bounds."""
    n = 16 * keys.count()
    return min(MOST_BITS, max(BITMAP_BITS, 1 << (n - 1).bit_length() if n else 0))


def bitmap(keys: DataFrame, *cols: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Fold keys to rows ``(__word, __bits)``: at most ``bits / 64`` rows whatever the number of keys."""
    at = bit_position(*(F.col(c) for c in cols), bits=bits)
    return (
        keys.select(at.alias("__at"))
        .groupBy(F.expr("__at div 64").alias("__word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(__at % 64 as int))")).alias("__bits"))
    )


def flag(df: DataFrame, words: DataFrame, name: str, *cols: Column, bits: int = BITMAP_BITS) -> DataFrame:
    """Add column ``name``: false where the key is surely not among those of ``words``.

    ``words`` comes from :func:`bitmap`, so the broadcast has a bound that does not depend on the data.
    A full bitmap only costs selectivity: true never means more than "maybe".
    """
    at = bit_position(*cols, bits=bits)
    return (
        df.withColumn("__at", at)
        .withColumn("__word", F.expr("__at div 64"))
        .join(F.broadcast(words), "__word", "left")
        .withColumn(name, F.expr("coalesce(getbit(__bits, cast(__at % 64 as int)), 0) = 1"))
        .drop("__word", "__bits", "__at")
    )


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; a null text has the key of the empty one."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def keep_rows(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, given (id, ``th``, ``kept``): ``th`` is a row's :func:`text_key`, needed of dropped rows and of those that repeat one's id and text.

    Rows whose id and text are surely not among the dropped ones pass in the scan, told by a bitmap; only the
    others travel.  Rows that repeat an id and a text, of which some are kept and some dropped, stay once.
    """
    last = F.lit((1 << 63) - 1)  # stands for a null id
    key = F.coalesce(F.col(id_col).cast("long"), last)
    known = verdict.where("th is not null").groupBy(key.alias("__key"), F.col("th").alias("__th")).agg(F.max("kept").alias("__some"), F.min("kept").alias("__all"))
    dropped = stage(known.where("not __all").select("__key", "__th", "__some"), "dropped")
    bits = bits_for(dropped)
    seen = docs.withColumn("__key", key).withColumn("__th", text_key(F.col(text_col)))
    marked = flag(seen, bitmap(dropped, "__key", "__th", bits=bits), "__maybe", F.col("__key"), F.col("__th"), bits=bits)
    looked = marked.where("__maybe")
    out = marked.where("not __maybe").unionByName(looked.join(dropped, ["__key", "__th"], "left_anti"))
    once = dropped.where("__some")
    if not once.isEmpty():
        out = out.unionByName(looked.join(once, ["__key", "__th"], "left_semi").dropDuplicates(["__key", "__th"]))
    return out.select(*docs.columns)
