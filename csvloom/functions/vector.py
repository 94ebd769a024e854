"""Whole chunks through Arrow's CSV reader, where the bytes leave no doubt about the result.

An input that strict quoting accepts means the same under every mode.  Whether it does is a test of the
neighbours of its quotes, done with numpy; inputs that fail it, and any error of the reader, are left to the
exact scanner, which also finds the byte an error points to.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyarrow import csv

from csvloom.dialect import CRLF, Dialect

BOM = b"\xef\xbb\xbf"


def clean(data: np.ndarray, d: Dialect) -> bool:
    """Does strict quoting accept the bytes, from the start of a record to the end of one?"""
    quotes = np.flatnonzero(data == d.quote)
    if not len(quotes):
        return True
    if len(quotes) % 2:
        return False
    border = np.zeros(256, dtype=bool)
    border[[d.delimiter, *d.terminators]] = True
    opens, closes = quotes[0::2], quotes[1::2]
    before = border[data[np.maximum(opens - 1, 0)]] | (opens == 0)
    # a doubled quote closes and opens at once
    before |= np.isin(opens - 1, closes, assume_unique=True)
    after = border[data[np.minimum(closes + 1, len(data) - 1)]] | (closes == len(data) - 1)
    after |= np.isin(closes + 1, opens, assume_unique=True)
    return bool(before.all() and after.all())


def read(data: bytes, d: Dialect, columns: int, fields: Sequence[int] | None = None) -> pa.Table | None:
    """The records as binary columns _c0.. (or only those of ``fields``), or None if the exact scanner has to look."""
    wanted = [f"_c{i}" for i in (range(columns) if fields is None else fields)]
    if not data:
        return pa.table({c: pa.array([], pa.binary()) for c in wanted})
    if d.supports("vector", columns) is not None or data.startswith(BOM) or b"\0" in data:
        return None
    if d.terminator != CRLF and b"\r" in data:
        return None
    if d.quote is not None and not clean(np.frombuffer(data, dtype=np.uint8), d):
        return None
    names = [f"_c{i}" for i in range(columns)]
    try:
        return csv.read_csv(
            pa.BufferReader(data),
            csv.ReadOptions(column_names=names, block_size=len(data) + 1, use_threads=False),
            csv.ParseOptions(
                delimiter=chr(d.delimiter), quote_char=False if d.quote is None else chr(d.quote), double_quote=d.quote is not None, escape_char=False, newlines_in_values=d.quote is not None
            ),
            csv.ConvertOptions(column_types={n: pa.binary() for n in names}, include_columns=wanted, strings_can_be_null=False, null_values=[]),
        )
    except pa.ArrowInvalid:
        return None
