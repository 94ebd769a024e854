"""Byte ranges of files, wherever Arrow's file systems reach, and the records that begin in them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs

from csvloom.dialect import AUTO, EXACT, STRING, VECTOR, Dialect
from csvloom.errors import RecordTooLong
from csvloom.functions import vector
from csvloom.functions.machine import BROKEN, IN_COMMENT, IN_FIELD, RECORD_START, Incomplete, Scanner, checked, utf8_error

#: Bytes of a chunk.
CHUNK = 32 << 20
#: A record may be this long.
MAX_RECORD = 1 << 30
#: Bytes read at once beyond a chunk's end to finish its last record; fewer at first where the chunk is small.
LOOK, LEAST_LOOK = 1 << 16, 1 << 12


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def list_files(path: str) -> list[tuple[str, int]]:
    """Files (path, size) of a file, a folder or a pattern in the last part of a path, in order of path."""
    system, local = located(path)
    prefix = path[: len(path) - len(local)] if path.endswith(local) else ""
    parent, _, last = local.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in system.get_file_info(fs.FileSelector(parent or ".")) if fnmatch(f.base_name, last)]
    else:
        info = system.get_file_info(local)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(local, recursive=True))
    files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((prefix + f.path, f.size) for f in files)


class Window:
    """A file opened for reads at any place."""

    def __init__(self, uri: str) -> None:
        system, local = located(uri)
        self.file = system.open_input_file(local)
        self.size = self.file.size()

    def __enter__(self) -> "Window":
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def at(self, start: int, end: int) -> bytes:
        return self.file.read_at(max(0, min(end, self.size) - start), start)


def needs_states(d: Dialect) -> bool:
    """Does a chunk's start state depend on more than the byte before it?"""
    return d.quote is not None or d.comment is not None


def border_state(w: Window, d: Dialect, at: int) -> int:
    """The state at ``at`` in a dialect without quotes and comments."""
    return RECORD_START if at == 0 or w.at(at - 1, at)[0] in d.terminators else IN_FIELD


def first_record(w: Window, d: Dialect, until: int) -> bool:
    """Does any record begin before ``until``?  (without comments)"""
    at, scanner = 0, Scanner(d)
    while at < until:
        if scanner.not_blank.search(w.at(at, min(at + LOOK, until))):
            return True
        at += LOOK
    return False


def region(w: Window, d: Dialect, start: int, end: int, state: int, after: int, limit: int = MAX_RECORD) -> tuple[int, bytes, int]:
    """The bytes of all records and comments that begin in start..end: their offset, the bytes, and their first state.

    ``state`` and ``after`` are the states at start and end.  What begins in the range is read to its end
    past it; what belongs to an earlier record is left out.
    """
    if state == BROKEN or start >= w.size:
        return start, b"", RECORD_START
    scanner = Scanner(d)
    data = w.at(start, end)
    begin = 0
    if state == IN_COMMENT:
        m = scanner.comment_end.search(data)
        begin, state = m.end() if m else len(data), RECORD_START
    elif state != RECORD_START:
        try:
            begin = scanner.skip(data, 0, state, start, end >= w.size)
        except Incomplete:
            return end, b"", RECORD_START  # all of it is the middle of a longer record
        state = RECORD_START
    if begin >= len(data):
        return end, b"", RECORD_START
    if after not in (RECORD_START, BROKEN) and end < w.size:
        more, step = b"", min(LOOK, max(LEAST_LOOK, end - start))
        while True:
            if len(more) > limit:
                raise RecordTooLong(limit, start)
            stop = min(end + step, w.size)
            more = w.at(end, stop)
            try:
                if after == IN_COMMENT:
                    m = scanner.comment_end.search(more)
                    if m is None and stop < w.size:
                        raise Incomplete
                    data += more[: m.end()] if m else more
                else:
                    data += more[: scanner.skip(more, 0, after, end, stop >= w.size)]
                break
            except Incomplete:
                step *= 4
    return start + begin, data[begin:], state


def batches(data: bytes, d: Dialect, columns: int | None, base: int, header: bool, state: int, backend: str = AUTO, offsets: bool = False, size: int = 10_000, fields: Sequence[int] | None = None) -> Iterator[pa.RecordBatch]:
    """The records of a region as Arrow batches, of all columns or those of ``fields``."""
    if not data:
        return
    text = d.field_type == STRING
    kind = pa.string() if text else pa.binary()
    if backend in (AUTO, VECTOR) and not offsets and columns is not None and state == RECORD_START:
        table = vector.read(data, d, columns, fields)
        if table is not None and text:
            try:
                if fields is not None and utf8_error(data) is not None:  # also in what is not read
                    raise pa.ArrowInvalid("not UTF-8")
                table = table.cast(pa.schema([(n, pa.string()) for n in table.column_names]))
            except pa.ArrowInvalid:
                table = None
        if table is not None:
            yield from (table.slice(1) if header else table).to_batches(max_chunksize=size)
            return
    held: list = []

    def made() -> pa.RecordBatch:
        where = [pa.array([o for o, _ in held], pa.int64())] if offsets else []
        named = ["_record_offset"] if offsets else []
        if columns is None:
            rows = [[f.decode() for f in r] for _, r in held] if text else [r for _, r in held]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(kind)), *where], ["fields", *named])
        wanted = range(columns) if fields is None else fields
        cols = [pa.array([r[i] for _, r in held], pa.binary()).view(kind) for i in wanted]  # the bytes are checked to be UTF-8
        return pa.RecordBatch.from_arrays([*cols, *where], [*(f"_c{i}" for i in wanted), *named])

    for record in checked(data, d, columns, base, header, state):
        held.append(record)
        if len(held) >= size:
            yield made()
            held = []
    if held:
        yield made()


def reason(d: Dialect, backend: str, columns: int | None) -> str | None:
    return None if backend in (AUTO, EXACT) else d.supports(backend, columns)
