"""The quote-free plan: lines of the text source, split in the JVM.  No Python touches the rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from csvloom.dialect import CRLF, NATIVE, Dialect
from csvloom.errors import InvalidConfig
from csvloom.functions.vector import BOM
from csvloom.plans.chunks import columns_of, scan
from csvloom.sources import files

#: ASCII white space that trimming strips.
BLANKS = r"[\t\n\f\r ]+"


def quoted_regex(b: int) -> str:
    return "\\" + chr(b) if not chr(b).isalnum() and b > 0x20 else f"\\x{b:02x}"


def trimmed(field: Column) -> Column:
    return F.regexp_replace(field, f"^{BLANKS}|{BLANKS}$", "")


def split_line(line: Column, d: Dialect) -> Column:
    fields = F.split(line, quoted_regex(d.delimiter), -1)
    return F.transform(fields, trimmed) if d.trim else fields


def is_record(line: Column, d: Dialect) -> Column:
    out = line != ""
    return out & ~F.startswith(line, F.lit(chr(d.comment))) if d.comment is not None else out


def has_bom(spark: SparkSession, path: str) -> bool:
    """Does any file begin with a byte order mark?  The text source would drop it.  Many files are looked at by tasks."""
    names = [name for name, _ in files.list_files(path)]

    def begins(name: str) -> bool:
        with files.Window(name) as w:
            return w.at(0, 3) == BOM

    if len(names) <= 16:
        return any(map(begins, names))

    def run(batches):
        for b in batches:
            found = [n for n in b.column(0).to_pylist() if begins(n)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])

    listed = spark.createDataFrame([(n,) for n in names], "path string").repartition(min(len(names) // 16, 10_000))
    return not listed.mapInArrow(run, "path string").isEmpty()


def read_native(spark: SparkSession, path: str, d: Dialect, columns: int | None = None) -> DataFrame:
    """Records of a dialect without quotes and header."""
    n = columns_of(d, columns)
    if (why := d.supports(NATIVE, n)) is not None:
        raise InvalidConfig(why)
    if has_bom(spark, path):
        return scan(spark, path, d, columns)
    reader = spark.read if d.terminator == CRLF else spark.read.option("lineSep", chr(d.terminator))
    lines = reader.text(path).where(is_record(F.col("value"), d))
    valid = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.lit("invalid UTF-8 in a line")).cast("string"))
    # generated, so that every line is split once and none is passed over where its fields are not needed
    fields = lines.select(F.explode(F.array(split_line(valid, d))).alias("fields"))
    if n is None:
        return fields
    found = F.size("fields")
    wrong = F.concat(F.lit(f"expected {n} fields, found "), found.cast("string"), F.lit(" in a line"))
    right = fields.where(F.when(found == n, F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean")))
    return right.select(*(F.get("fields", F.lit(i)).alias(f"_c{i}") for i in range(n)))
