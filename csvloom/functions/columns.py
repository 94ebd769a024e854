"""CSV documents in a column: the in-memory slice scan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvloom.dialect import CRLF, STRING, Dialect
from csvloom.functions.machine import checked
from csvloom.plans.chunks import columns_of
from csvloom.plans.native import is_record, quoted_regex, split_line


def parse_records(document: Column, d: Dialect, columns: int | None = None) -> Column:
    """The records of each document as ``array<array<string>>`` (or of binary); a null document gives null.

    Dialects without quotes stay in the JVM; the others go through the exact scanner in Arrow batches.
    """
    text = d.field_type == STRING
    if text and d.quote is None and (d.comment is None or d.terminator in (CRLF, 0x0A)) and columns is None:
        cut = r"[\r\n]" if d.terminator == CRLF else quoted_regex(d.terminator)
        lines = F.filter(F.split(document, cut, -1), lambda x: is_record(x, d))
        if d.header:
            lines = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        return F.when(document.isNotNull(), F.transform(lines, lambda x: split_line(x, d)))

    @F.pandas_udf("array<array<string>>" if text else "array<array<binary>>")
    def parse(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            records = checked(x.encode() if isinstance(x, str) else bytes(x), d, columns)
            return [[f.decode() for f in r] if text else r for _, r in records]

        return s.map(one)

    return parse(document)


def explode_records(df: DataFrame, document: str, d: Dialect, columns: int | None = None) -> DataFrame:
    """One row per record of the documents: the other columns, ``pos``, and ``fields`` or _c0.. ."""
    n = columns_of(d, columns)
    rest = [c for c in df.columns if c != document]
    each = df.select(*rest, F.posexplode(parse_records(F.col(document), d, n)).alias("pos", "fields"))
    return each if n is None else each.select(*rest, "pos", *(F.col("fields")[i].alias(f"_c{i}") for i in range(n)))


def as_unsigned(field: Column) -> Column:
    """A whole number without sign (a plus may stand before it); anything else fails the query."""
    good = F.when(field.rlike(r"^[+]?[0-9]+$"), field)
    return F.coalesce(good, F.raise_error(F.concat(F.lit("invalid digit found in "), field)).cast("string")).cast("bigint")
