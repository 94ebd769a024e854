"""The parallel scan: chunks, their exact start states, and the records that begin in each.

Pass 1 makes each chunk's state function where the dialect needs it.  The functions of a file, some bytes
per chunk, are composed in order on an executor.  Pass 2 parses every chunk from its exact state.  A record
belongs to the chunk it begins in.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csvloom.dialect import ARITY, AUTO, STRING, VECTOR, Dialect
from csvloom.errors import CsvError, InvalidConfig, UserError
from csvloom.functions import vector
from csvloom.functions.machine import BEGUN, IDENTITY, RECORD_START, checked, range_function, utf8_error
from csvloom.sources import files

#: Tasks of a scan at most; they take several chunks each beyond it.
MOST_TASKS = 100_000
#: Bytes of a task, unless the cores ask for more tasks: small chunks are worked on together.
TASK = files.CHUNK
#: Tasks for each core where there are as many chunks.
TASKS_A_CORE = 4
#: Rows or bytes that a batch has at least before it leaves the scan.
ROWS, BYTES = 10_000, 4 << 20
#: Stands for the state function of a chunk that is a whole file: any records there begin in it.
WHOLE = bytes(BEGUN + x % BEGUN for x in IDENTITY)
PLAN = "path string, chunk long, start long, end long, state int, after int, header boolean"


def chunks(spark: SparkSession, path: str, chunk_size: int, tasks: int | None = None) -> tuple[DataFrame, int]:
    """Rows (path, size, chunk, start, end) of all files, dealt evenly to tasks in file order, and how many tasks.

    Their number follows the bytes and the cores, not the number of chunks.  The list of files is all that the driver holds.
    """
    found = files.list_files(path)
    total = sum(-(-size // chunk_size) for _, size in found)
    wanted = max(-(-sum(size for _, size in found) // TASK), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    tasks = max(1, min(total, tasks or min(wanted, MOST_TASKS)))
    table = spark.createDataFrame(found or [("", 0)], "path string, size long").where("size > 0")
    each = table.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {chunk_size}"))))
    each = each.withColumn("start", F.col("chunk") * chunk_size).withColumn("end", F.least(F.col("start") + chunk_size, F.col("size")))
    return dealt(each, tasks), tasks


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, as small chunks would give very many."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= ROWS or size >= BYTES:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def dealt(chunked: DataFrame, tasks: int) -> DataFrame:
    return chunked.repartitionByRange(tasks, "path", "chunk").sortWithinPartitions("path", "chunk")


def planned(spark: SparkSession, path: str, d: Dialect, chunk_size: int = files.CHUNK, tasks: int | None = None) -> DataFrame:
    """Chunks with the states at both ends and whether the header is theirs."""
    each, tasks = chunks(spark, path, chunk_size, tasks)
    if not files.needs_states(d):

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    with files.Window(r["path"]) as w:
                        state, after = files.border_state(w, d, r["start"]), files.border_state(w, d, r["end"])
                        mine = d.header and not files.first_record(w, d, r["start"]) and files.first_record(w, d, r["end"])
                    rows.append((r["path"], r["chunk"], r["start"], r["end"], state, after, mine))
                cols = list(zip(*rows)) or [[]] * 7
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "chunk", "start", "end", "state", "after", "header"])

        return each.mapInArrow(near, PLAN)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["start"] == 0 and r["end"] == r["size"]:
                    out.append(WHOLE)  # nothing comes after it
                    continue
                with files.Window(r["path"]) as w:
                    out.append(range_function(w.at(r["start"], r["end"]), d))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("path", "chunk", "start", "end")), pa.array(out, pa.binary())], ["path", "chunk", "start", "end", "f"])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        state, header, out = RECORD_START, d.header, []
        for f in rows["f"]:
            to = f[state]
            begun, to = to >= BEGUN, to % BEGUN
            out.append((state, to, bool(header and begun)))
            header = header and not begun
            state = to
        made = rows[["path", "chunk", "start", "end"]].reset_index(drop=True)
        made[["state", "after", "header"]] = pd.DataFrame(out, columns=["state", "after", "header"])
        return made.astype({"state": "int32", "after": "int32", "header": "bool"})

    made = each.mapInArrow(functions, "path string, chunk long, start long, end long, f binary")
    folded = made.groupBy("path").applyInPandas(fold, PLAN)  # one small row per chunk of a file
    return dealt(folded, tasks)


def schema(d: Dialect, columns: int | None, offsets: bool = False, fields: Sequence[int] | None = None) -> str:
    kind = "string" if d.field_type == STRING else "binary"
    body = f"fields array<{kind}>" if columns is None else ", ".join(f"_c{i} {kind}" for i in (range(columns) if fields is None else fields))
    return body + (", _record_offset long" if offsets else "")


def columns_of(d: Dialect, columns: int | None) -> int | None:
    """The fixed number of fields, None for the variadic and flexible modes."""
    if d.record_mode != ARITY:
        return None
    if columns is None or columns < 1:
        raise InvalidConfig("the number of fields is needed; use the variadic or flexible record mode to do without")
    return columns


def scan(
    spark: SparkSession,
    path: str,
    d: Dialect,
    columns: int | None = None,
    chunk_size: int = files.CHUNK,
    backend: str = AUTO,
    offsets: bool = False,
    max_record: int = files.MAX_RECORD,
    fields: Sequence[int] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """All records of ``path`` as a DataFrame; a malformed input fails the query with its error.

    ``fields``: the places of the columns to make (all records are still checked); ``offsets`` adds ``_path``
    and ``_record_offset``, by which rows of several files sort into file order.
    """
    n = columns_of(d, columns)
    if (why := files.reason(d, backend, n)) is not None:
        raise InvalidConfig(why)
    if chunk_size < 1:
        raise InvalidConfig("chunk_size must be at least 1")
    if fields is not None and (n is None or not fields or len(set(fields)) < len(fields) or min(fields) < 0 or max(fields) >= n):
        raise InvalidConfig("fields must be different places below the number of fields")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with files.Window(r["path"]) as w:
                    base, data, state = files.region(w, d, r["start"], r["end"], r["state"], r["after"], max_record)
                for made in files.batches(data, d, n, base, r["header"], state, backend, offsets, fields=fields):
                    yield made.append_column("_path", pa.array([r["path"]] * len(made), pa.string())) if offsets else made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(parts(batches))

    return planned(spark, path, d, chunk_size, tasks).mapInArrow(run, schema(d, n, offsets, fields) + (", _path string" if offsets else ""))


def fold_block(data: bytes, d: Dialect, columns: int | None, base: int, header: bool, state: int, held, acc: Callable, final: bool = True) -> tuple:
    """Fold the whole records of some bytes into ``held``: the new state, how many bytes were taken, is the header still to come.

    What ``acc`` raises becomes a :class:`UserError`.
    """
    text = d.field_type == STRING
    records = checked(data, d, columns, base, header, state, final)
    while True:
        try:
            offset, record = next(records)
        except StopIteration as end:
            return held, *end.value
        try:
            new = acc(held, [f.decode() for f in record] if text else record)
        except CsvError:
            raise
        except Exception as e:
            raise UserError(str(e), offset) from e
        held = held if new is None else new


def fold_records(data: bytes, d: Dialect, columns: int | None, base: int, header: bool, state: int, held, acc: Callable):
    """The state of :func:`fold_block` over bytes that hold whole records."""
    return fold_block(data, d, columns, base, header, state, held, acc)[0]


def _folded(spark: SparkSession, path: str, d: Dialect, columns: int | None, init: Callable, acc: Callable, chunk_size: int, max_record: int, tasks: int | None, backend: str, combine: Callable | None) -> DataFrame:
    """Rows (path, chunk, out): a pickled (failed, state or error) of each chunk with records, or with ``combine`` of each task."""

    def row(path: str, chunk: int, out: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([chunk], pa.int64()), pa.array([pickle.dumps(out)], pa.binary())], ["path", "chunk", "out"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # path, chunk and outcome so far
        for b in batches:
            for r in b.to_pylist():
                try:
                    with files.Window(r["path"]) as w:
                        base, data, state = files.region(w, d, r["start"], r["end"], r["state"], r["after"], max_record)
                    if not data:
                        continue
                    out = (False, _fold_region(data, d, columns, base, r["header"], state, init(), acc, backend))
                except CsvError as e:
                    out = (True, e)
                if combine is None:
                    yield row(r["path"], r["chunk"], out)
                elif held is None:
                    held = (r["path"], r["chunk"], out)
                else:
                    held = (*held[:2], _joined(held[2], out, combine))
        if held is not None:
            yield row(*held)

    return planned(spark, path, d, chunk_size, tasks).mapInArrow(run, "path string, chunk long, out binary")


def _fold_region(data: bytes, d: Dialect, columns: int | None, base: int, header: bool, state: int, held, acc: Callable, backend: str):
    """Fold a chunk's records; those that Arrow reads come in batches, with the chunk's offset in errors of ``acc``."""
    text = d.field_type == STRING
    table = vector.read(data, d, columns) if backend == VECTOR and state == RECORD_START else None
    if table is None or (text and utf8_error(data) is not None):
        return fold_records(data, d, columns, base, header, state, held, acc)
    for b in (table.slice(1) if header else table).to_batches(max_chunksize=10_000):
        for record in zip(*(c.cast(pa.string()).to_pylist() if text else c.to_pylist() for c in b.columns)):
            try:
                new = acc(held, list(record))
            except CsvError:
                raise
            except Exception as e:
                raise UserError(str(e), base) from e
            held = held if new is None else new
    return held


def _joined(a: tuple, b: tuple, combine: Callable) -> tuple:
    """Two neighbours' outcomes as one: the first error, else the states combined."""
    if a[0] or b[0]:
        return a if a[0] else b
    try:
        return False, combine(a[1], b[1])
    except CsvError as e:
        return True, e
    except Exception as e:
        return True, UserError(str(e))


def fold_chunks(
    spark: SparkSession, path: str, d: Dialect, columns: int | None, init: Callable, acc: Callable, chunk_size: int = files.CHUNK, max_record: int = files.MAX_RECORD, tasks: int | None = None, backend: str = AUTO
) -> list:
    """One folded state per chunk with records, in file order; raises the first error in file order.

    The states come to the driver, whose ``merge`` wants all of them: for many chunks see :func:`fold_tree`.
    """
    made = _folded(spark, path, d, columns, init, acc, chunk_size, max_record, tasks, backend, None)
    states = []
    for r in made.orderBy("path", "chunk").toLocalIterator():
        failed, out = pickle.loads(bytes(r["out"]))
        if failed:
            raise out
        states.append(out)
    return states


def fold_tree(
    spark: SparkSession,
    path: str,
    d: Dialect,
    columns: int | None,
    init: Callable,
    acc: Callable,
    combine: Callable,
    chunk_size: int = files.CHUNK,
    max_record: int = files.MAX_RECORD,
    tasks: int | None = None,
    backend: str = AUTO,
    width: int = 64,
):
    """All chunks' states combined in file order: within each task, then ``width`` neighbours at a time until one is left."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for b in batches:
            for r in b.to_pylist():
                out = pickle.loads(r["out"])
                if r["g"] != group:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([pickle.dumps(held)], pa.binary())], ["i", "out"])
                    group, held = r["g"], out
                else:
                    held = _joined(held, out, combine)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([pickle.dumps(held)], pa.binary())], ["i", "out"])

    made = _folded(spark, path, d, columns, init, acc, chunk_size, max_record, tasks, backend, combine)
    _, tasks = chunks(spark, path, chunk_size, tasks)
    # rows stand in file order by the number of their task
    level = made.select(F.spark_partition_id().cast("long").alias("i"), "out")
    while tasks > width:
        tasks = -(-tasks // width)
        grouped = level.withColumn("g", F.expr(f"i div {width}")).repartition(tasks, "g").sortWithinPartitions("g", "i")
        level = grouped.select("g", "out").mapInArrow(join, "i long, out binary")
    held = None
    for r in level.orderBy("i").toLocalIterator():  # at most ``width`` rows
        out = pickle.loads(bytes(r["out"]))
        held = out if held is None else _joined(held, out, combine)
    if held is not None and held[0]:
        raise held[1]
    return None if held is None else held[1]
