"""Reports and checks around a corpus of inputs: throughput, snapshots, manifests, dialect sniffing."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from csvloom.dialect import FLEXIBLE, LITERAL, Dialect
from csvloom.functions.machine import AFTER_QUOTE, BEGUN, BROKEN, FIELD_START, IN_FIELD, IN_QUOTED, RECORD_START, STATES, range_function, utf8_error
from csvloom.operators.aggregates import numbered
from csvloom.sources import files


def geomean(x: Column) -> Column:
    """The geometric mean: 0 if any value is 0, NaN if any is negative; nulls do not count."""
    log = F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))
    return F.exp(F.avg(log))


def quotient(a: Column, b: Column) -> Column:
    """The quotient as a double; by zero it is infinite, or NaN for 0 / 0."""
    return F.when(b == 0, a.cast("double") * float("inf")).otherwise(a / b)


def total(df: DataFrame, name: str) -> Column:
    """The sum of a column as a double; whole numbers are summed in 38 digits, beyond what a long holds."""
    column = F.col(name)
    return F.sum(column.cast("decimal(38,0)") if isinstance(df.schema[name].dataType, IntegralType) else column).cast("double")


def throughput(df: DataFrame, size: str, nanos: str, by: list[str]) -> DataFrame:
    """Geometric mean and total of bytes per microsecond by group."""
    rate = quotient(F.col(size), F.col(nanos)) * 1000
    return df.groupBy(*by).agg(geomean(rate).alias("geomean"), (quotient(total(df, size), total(df, nanos)) * 1000).alias("total"), F.count("*").alias("n"))


def win_tie_loss(df: DataFrame, ours: str, theirs: str, by: list[str], band: float = 0.05) -> DataFrame:
    """How often ours beats, equals (within the band) or loses to theirs; larger is better."""
    ratio = F.col(ours) / F.col(theirs)
    return df.groupBy(*by).agg(
        F.count_if(ratio > 1 + band).alias("wins"), F.count_if((ratio <= 1 + band) & (ratio >= 1 - band)).alias("ties"), F.count_if(ratio < 1 - band).alias("losses")
    )


def snapshot_delta(new: DataFrame, old: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each new value beside the old one of its key: difference and percentage, null where there was none."""
    before = old.select(*keys, F.col(value).alias("old"))
    return new.join(before, keys, "left").select(*keys, F.col(value).alias("new"), "old", (F.col(value) - F.col("old")).alias("delta"), ((F.col(value) - F.col("old")) / F.col("old") * 100).alias("percent"))


def history(df: DataFrame, committed: str, run: str, tie: str, folder: str) -> DataFrame:
    """Runs with their place (``pos``) in order of commit date, else of when they ran; equal ones in order of ``tie``."""
    return numbered(df.withColumn("__when", F.coalesce(committed, run)), ["__when", run, tie], folder).drop("__when")


def manifest_gaps(manifest: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: ``missing`` (on the manifest alone) and ``unlisted`` (on disk alone)."""
    missing = manifest.join(disk, key, "left_anti").select(key, F.lit("missing").alias("gap"))
    return missing.unionByName(disk.join(manifest, key, "left_anti").select(key, F.lit("unlisted").alias("gap")))


def tier_gaps(expected: DataFrame, tier: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """Of the expected keys not on disk: those of the tier, and the others."""
    e, t, d = (x.select(key) for x in (expected, tier, disk))
    inside = e.intersect(t).subtract(d).withColumn("gap", F.lit("tier"))
    return inside.unionByName(e.subtract(t).subtract(d).withColumn("gap", F.lit("other")))


def tier(df: DataFrame, size: str, cap: int, key: str) -> DataFrame:
    return df.where(F.col(size) <= cap).orderBy(key)


def overlay(base: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Manifest rows with each field replaced where an override states it; keys of either side."""
    b, o = base.alias("b"), overrides.alias("o")
    names = [c for c in base.columns if c != key]
    fields = [F.coalesce(F.col(f"o.{c}"), F.col(f"b.{c}")).alias(c) if c in overrides.columns else F.col(f"b.{c}") for c in names]
    return b.join(o, F.col(f"b.{key}") == F.col(f"o.{key}"), "full_outer").select(F.coalesce(f"b.{key}", f"o.{key}").alias(key), *fields)


#: Candidates of the sniffer, in order of preference.
DELIMITERS = (",", ";", "\t", "|", ":")
QUOTES = ('"', "'", None)
CANDIDATES = [Dialect(delimiter=x, quote=q, escape=q, header=False, record_mode=FLEXIBLE, field_type="binary", quote_handling=LITERAL) for x, q in product(DELIMITERS, QUOTES)]
#: Bytes of a chunk of the sniffer.
SNIFFED = 8 << 20


def _over(spark: SparkSession | None, rows: list[tuple], f: Callable) -> list:
    """``f`` of every row (path, start, end, states), in order: by tasks, or here without a session."""
    if spark is None or not rows:
        return [f(*r) for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out = f(r["path"], r["start"], r["end"], r["states"])
                yield pa.RecordBatch.from_arrays([pa.array([r["i"]], pa.int64()), pa.array([pickle.dumps(out)], pa.binary())], ["i", "out"])

    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, path string, start long, end long, states binary")
    made = table.repartition(min(len(rows), 100_000), "i").mapInArrow(run, "i long, out binary")
    got = {r["i"]: pickle.loads(bytes(r["out"])) for r in made.collect()}  # some hundred bytes a chunk
    return [got[i] for i in range(len(rows))]


def _character(w: files.Window, at: int) -> int:
    """Where the character ends that goes on past ``at``; ``at`` if none does."""
    before = w.at(max(0, at - 3), at)
    for back, b in enumerate(reversed(before), 1):
        if b & 0xC0 != 0x80:
            size = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
            return min(at + max(0, size - back), w.size)
    return at


def _outline(path: str, start: int, end: int, _: bytes | None) -> tuple[bool, set[int], list[bytes]]:
    """Of a chunk: is it UTF-8 (characters belong where they begin), the quotes it has, each candidate's state function."""
    with files.Window(path) as w:
        data = w.at(start, end)
        good = utf8_error(w.at(_character(w, start), _character(w, end))) is None
    found = []
    for d in CANDIDATES:
        if d.quote is not None and d.quote in data:
            found.append(range_function(data, d))
        else:
            to = RECORD_START if data[-1] in d.terminators else FIELD_START if data[-1] == d.delimiter else IN_FIELD
            found.append(bytes(IN_QUOTED if s == IN_QUOTED else to for s in range(STATES)))
    return good, {d.quote for d in CANDIDATES if d.quote is not None and d.quote in data}, found


def _widths(data: bytes, d: Dialect, state: int) -> tuple[tuple[int, bool], dict[int, int], tuple[int, bool] | None]:
    """Records of bytes that begin in ``state``: what goes before the first end, whole records by width, what goes after the last.

    Ends are (delimiters, is there anything); the last is None where no record ends.
    """
    if d.quote is not None:
        q = bytes([d.quote])
        data = {IN_QUOTED: q, AFTER_QUOTE: q + q, IN_FIELD: b"x"}.get(state, b"") + data
        if q in data:  # a field that opens with a quote, to the end of its quoting, holds no delimiters
            data = re.sub(rb"(?<![^%b\r\n])%b(?:[^%b]++|%b%b)*+(?:%b|\Z)" % (re.escape(bytes([d.delimiter])), q, q, q, q, q), b"x", data)
    a = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(np.isin(a, d.terminators))
    delimiters = np.flatnonzero(a == d.delimiter)
    many = np.diff(np.concatenate([[0], np.searchsorted(delimiters, ends), [len(delimiters)]])).tolist()
    some = (np.diff(np.concatenate([[-1], ends, [len(a)]])) > 1).tolist()
    whole = Counter(n + 1 for n, there in zip(many[1:-1], some[1:-1]) if there)
    return (many[0], some[0]), dict(whole), (many[-1], some[-1]) if len(ends) else None


def _records(path: str, start: int, end: int, states: bytes) -> list:
    """Each candidate's :func:`_widths` of a chunk, from its exact state; None for those that are out."""
    with files.Window(path) as w:
        data = w.at(start, end)
    return [None if s == BROKEN else _widths(data, d, s) for d, s in zip(CANDIDATES, states)]


def sniff(path: str, spark: SparkSession | None = None, chunk_size: int = SNIFFED) -> dict:
    """Guess the dialect of all bytes of all files: the candidate whose records agree best on a number of fields above 1.

    Chunks are read by tasks of ``spark``, or here without it: once for encoding, quotes and state functions, once for
    the widths of records.  A candidate that leaves a quote open at the end of any file is out.
    Returns settings that differ from the defaults, ``columns``, and ``encoding`` where any file is not UTF-8.
    """
    rows = [(f, at, min(at + chunk_size, size), None) for f, size in files.list_files(path) for at in range(0, size, chunk_size)]
    outlines = _over(spark, rows, _outline)
    seen: set[int] = set().union(*(quotes for _, quotes, _ in outlines))
    out = {i for i, d in enumerate(CANDIDATES) if d.quote is not None and d.quote not in seen}
    states, held = [], [RECORD_START] * len(CANDIDATES)
    for i, ((f, *_), (_, _, functions)) in enumerate(zip(rows, outlines)):
        states.append(held)
        held = [function[s] % BEGUN for function, s in zip(functions, held)]
        if i + 1 == len(rows) or rows[i + 1][0] != f:
            out |= {k for k, s in enumerate(held) if s == IN_QUOTED}
            held = [RECORD_START] * len(CANDIDATES)
    known = [(*r[:3], bytes(BROKEN if k in out else s for k, s in enumerate(of))) for r, of in zip(rows, states)]
    parts = _over(spark, known, _records)

    best: tuple = ((-1.0, 0), {})
    for k, d in enumerate(CANDIDATES):
        if k in out:
            continue
        counts: Counter = Counter()
        many, some = 0, False  # of the record that goes on
        for i, part in enumerate(parts):
            (more, there), whole, last = part[k]
            many, some = many + more, some or there
            counts.update(whole)
            final = i + 1 == len(rows) or rows[i + 1][0] != rows[i][0]
            if last is not None or final:
                counts[many + 1] += some
                many, some = last or (0, False)
                if final and last is not None:
                    counts[many + 1] += some
                    many, some = 0, False
        counts = +counts
        if counts:
            width = max(counts, key=lambda n: (counts[n], n))
            score = counts[width] / sum(counts.values()) * (1 if width > 1 else 0.1)
            if (score, width) > best[0]:
                quote = None if d.quote is None else chr(d.quote)
                best = ((score, width), {"delimiter": chr(d.delimiter), "quote": quote, "columns": width})
    found = dict(best[1]) or {"columns": 1}
    defaults = {"delimiter": ",", "quote": '"'}
    result = {k: v for k, v in found.items() if k == "columns" or v != defaults[k]}
    if found.get("quote") is None and ord('"') not in seen:
        result.pop("quote", None)
    if not all(good for good, _, _ in outlines):
        result["encoding"] = "non-utf-8"
    return result


def write_csv(df: DataFrame, path: str, delimiter: str = "|", header: bool = True) -> None:
    """Write rows as delimited text, one file per partition."""
    df.write.option("sep", delimiter).option("header", header).option("emptyValue", "").csv(path)

