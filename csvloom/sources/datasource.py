"""``spark.read.format("dialect_csv")``: the scan as a Python data source.

Options: those of :meth:`Dialect.from_options`, ``chunkSize``, ``columns``, ``fields`` (places of the columns to make, with
commas), ``maxRecord`` (bytes of a record at most), ``offsets`` and ``splittable``.  Quote-free
dialects split files into chunks.  Start states of quoted dialects need a pass over the data, which a data
source cannot run, so there a file is one partition; :func:`csvloom.plans.chunks.scan` splits them too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StructType

from csvloom.dialect import AUTO, Dialect
from csvloom.errors import InvalidConfig
from csvloom.functions.machine import IN_FIELD, RECORD_START
from csvloom.plans.chunks import columns_of, schema
from csvloom.sources import files

OWN = {"path", "chunksize", "columns", "splittable", "backend", "offsets", "fields", "maxrecord"}


def places(own: dict[str, str]) -> list[int] | None:
    return [int(x) for x in own["fields"].split(",")] if own.get("fields") else None


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, whole: bool) -> None:
        self.path, self.start, self.end, self.whole = path, start, end, whole


class DialectCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dialect_csv"

    def __init__(self, options) -> None:
        super().__init__(options)
        given = {k.lower(): v for k, v in options.items()}
        self.own = {k: given[k] for k in OWN & given.keys()}
        self.dialect = Dialect.from_options({k: v for k, v in given.items() if k not in OWN})

    def schema(self) -> str:
        n = int(self.own["columns"]) if "columns" in self.own else None
        return schema(self.dialect, columns_of(self.dialect, n), self.own.get("offsets", "false").lower() == "true", places(self.own))

    def reader(self, schema: StructType) -> DataSourceReader:
        if "path" not in self.own:
            raise InvalidConfig("a path is needed")
        return Reader(self.dialect, schema, self.own)


class Reader(DataSourceReader):
    def __init__(self, d: Dialect, shape: StructType, own: dict[str, str]) -> None:
        self.dialect, self.own = d, own
        self.names = shape.fieldNames()
        self.offsets = self.names[-1] == "_record_offset"
        flexible = isinstance(shape.fields[0].dataType, ArrayType)
        self.fields = places(own)
        if self.fields is not None and ("columns" not in own or len(self.fields) != len(self.names) - self.offsets):
            raise InvalidConfig("fields needs columns, and a schema of as many")
        self.columns = None if flexible else int(own["columns"]) if self.fields else len(self.names) - self.offsets
        self.limit = int(own.get("maxrecord", files.MAX_RECORD))

    def partitions(self) -> list[Range]:
        size = int(self.own.get("chunksize", files.CHUNK))
        split = not files.needs_states(self.dialect) and self.own.get("splittable", "true").lower() == "true"
        out = []
        for path, n in files.list_files(self.own["path"]):
            step = size if split else max(n, 1)
            out += [Range(path, at, min(at + step, n), not split) for at in range(0, n, step)]
        return out or [Range("", 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        d = self.dialect
        if not partition.path:
            return
        with files.Window(partition.path) as w:
            if partition.whole:
                state, after, header = RECORD_START, IN_FIELD, d.header
            else:
                state, after = files.border_state(w, d, partition.start), files.border_state(w, d, partition.end)
                header = d.header and not files.first_record(w, d, partition.start) and files.first_record(w, d, partition.end)
            base, data, state = files.region(w, d, partition.start, partition.end, state, after, self.limit)
        for b in files.batches(data, d, self.columns, base, header, state, self.own.get("backend", AUTO), self.offsets, fields=self.fields):
            yield pa.RecordBatch.from_arrays(b.columns, names=self.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DialectCsv)
