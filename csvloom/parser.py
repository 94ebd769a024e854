"""The parser API: a builder of dialects and parses that fold records with init, acc and merge.

    parser = Parser.builder().delimiter(";").header(False).build()
    total = parser.parse(spark, path, lambda: [0], add, lambda states: sum(s[0] for s in states), columns=3)

``acc(state, record)`` folds a record (a list of fields) into the state: it changes the state or returns a
new one.  ``init`` and ``acc`` run on executors and may run again after a loss, so they must have no other
effect.  ``merge`` gets the states in file order (an empty list for an input without records) on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession

from csvloom import dialect as D
from csvloom.dialect import Dialect
from csvloom.errors import InvalidConfig, InvalidUtf8, RecordTooLong, UserError
from csvloom.functions.columns import parse_records
from csvloom.functions.machine import RECORD_START
from csvloom.plans import chunks, native
from csvloom.sources import files


class ParserBuilder:
    """Collects settings; every method returns the builder."""

    def __init__(self) -> None:
        self._d: dict[str, Any] = {}
        self._run: dict[str, Any] = {"backend": D.AUTO, "chunk_size": files.CHUNK, "max_record": files.MAX_RECORD, "tasks": None}

    def _set(self, **kw) -> "ParserBuilder":
        self._d |= kw
        return self

    def _tune(self, **kw) -> "ParserBuilder":
        self._run |= kw
        return self

    def delimiter(self, b) -> "ParserBuilder":
        return self._set(delimiter=b)

    def terminator(self, b) -> "ParserBuilder":
        return self._set(terminator=b)

    def quote(self, b) -> "ParserBuilder":
        return self._set(quote=b)

    def escape(self, b) -> "ParserBuilder":
        return self._set(escape=b)

    def quote_handling(self, mode: str) -> "ParserBuilder":
        return self._set(quote_handling=mode)

    def comment(self, b) -> "ParserBuilder":
        return self._set(comment=b)

    def has_headers(self, yes: bool) -> "ParserBuilder":
        return self._set(header=yes)

    def trim(self, yes: bool) -> "ParserBuilder":
        return self._set(trim=yes)

    def variadic(self) -> "ParserBuilder":
        return self._set(record_mode=D.VARIADIC)

    def flexible(self) -> "ParserBuilder":
        return self._set(record_mode=D.FLEXIBLE)

    def bytes(self) -> "ParserBuilder":
        return self._set(field_type=D.BINARY)

    def parser_backend(self, backend: str) -> "ParserBuilder":
        return self._tune(backend=backend)

    def io_backend(self, _: str) -> "ParserBuilder":
        """Accepted and without effect: reads go through Arrow's file systems."""
        return self

    def concurrency(self, n: int) -> "ParserBuilder":
        """Tasks that the chunks are dealt to, at most; 0 for as many as the bytes and the cores ask for."""
        return self._tune(tasks=n or None)

    def chunk_size(self, n: int) -> "ParserBuilder":
        return self._tune(chunk_size=n or files.CHUNK)

    def io_buffer_limit(self, n: int | None) -> "ParserBuilder":
        """Bytes that a single record may take; 0 for the default, None for no limit."""
        return self._tune(max_record=files.MAX_RECORD if n == 0 else 1 << 62 if n is None else n)

    def supports_backend(self, backend: str, columns: int | None = None) -> str | None:
        """Why a backend cannot read this dialect, or None."""
        return Dialect(**self._d).supports(backend, columns)

    def build(self) -> "Parser":
        """Raises :class:`InvalidConfig` for settings that contradict each other."""
        d = Dialect(**self._d)
        if self._run["chunk_size"] < 1:
            raise InvalidConfig("chunk_size must be at least 1")
        if self._run["tasks"] is not None and self._run["tasks"] < 1:
            raise InvalidConfig("concurrency must not be negative")
        if self._run["backend"] not in (D.AUTO, D.NATIVE, D.VECTOR, D.EXACT):
            raise InvalidConfig(f"no backend is named {self._run['backend']}")
        return Parser(d, **self._run)


class Parser:
    def __init__(self, dialect: Dialect | None = None, backend: str = D.AUTO, chunk_size: int = files.CHUNK, max_record: int = files.MAX_RECORD, tasks: int | None = None) -> None:
        self.dialect = dialect or Dialect()
        self.backend, self.chunk_size, self.max_record, self.tasks = backend, chunk_size, max_record, tasks

    @staticmethod
    def builder() -> ParserBuilder:
        return ParserBuilder()

    def read(self, spark: SparkSession, path: str, columns: int | None = None, offsets: bool = False, fields: Sequence[int] | None = None) -> DataFrame:
        """The records as a DataFrame: ``_c0``.. (or only ``fields``) or ``fields``, with ``_path`` and ``_record_offset`` if asked for."""
        if self.backend == D.NATIVE:
            return native.read_native(spark, path, self.dialect, columns)
        return chunks.scan(spark, path, self.dialect, columns, self.chunk_size, self.backend, offsets, self.max_record, fields, self.tasks)

    def parse(self, spark: SparkSession, path: str, init: Callable, acc: Callable, merge: Callable, columns: int | None = None):
        """Parse files in parallel and fold their records in the same pass."""
        n = chunks.columns_of(self.dialect, columns)
        if (why := files.reason(self.dialect, self.backend, n)) is not None:
            raise InvalidConfig(why)
        return merge(chunks.fold_chunks(spark, path, self.dialect, n, init, acc, self.chunk_size, self.max_record, self.tasks, self.backend))

    def aggregate(self, spark: SparkSession, path: str, init: Callable, acc: Callable, combine: Callable, columns: int | None = None):
        """As :meth:`parse`, but ``combine(a, b)`` joins the states of neighbours on the executors, in file order: one state (None without
        records) reaches the driver however many chunks there are."""
        n = chunks.columns_of(self.dialect, columns)
        return chunks.fold_tree(spark, path, self.dialect, n, init, acc, combine, self.chunk_size, self.max_record, self.tasks, self.backend)

    def parse_slice(self, data: bytes | str, init: Callable, acc: Callable, merge: Callable, columns: int | None = None):
        """Parse bytes in memory; the bytes are not changed."""
        n = chunks.columns_of(self.dialect, columns)
        whole = data.encode() if isinstance(data, str) else bytes(data)
        if not whole:
            return merge([])
        return merge([chunks.fold_records(whole, self.dialect, n, 0, self.dialect.header, RECORD_START, init(), acc)])

    def parse_stream(self, stream: BinaryIO, init: Callable, acc: Callable, merge: Callable, columns: int | None = None, block: int = 1 << 20):
        """Parse a stream from its start to its end in bounded memory; ``merge`` gets one state, also for an empty stream."""
        n = chunks.columns_of(self.dialect, columns)
        held, data, base, header, final = init(), b"", 0, self.dialect.header, False
        while not final:
            # a record that goes on is scanned again only once its bytes have doubled
            more = stream.read(max(block, len(data)))
            final = not more
            data += more
            held, done, header = chunks.fold_block(data, self.dialect, n, base, header, RECORD_START, held, acc, final)
            if len(data) - done > self.max_record:
                raise RecordTooLong(self.max_record, base + done)
            data, base = data[done:], base + done
        return merge([held])

    def records(self, column: Column, columns: int | None = None) -> Column:
        """The records of CSV documents held in a column."""
        return parse_records(column, self.dialect, chunks.columns_of(self.dialect, columns))


__all__ = ["InvalidConfig", "InvalidUtf8", "Parser", "ParserBuilder", "UserError"]
