"""The record grammar: a transition table per dialect, an exact scanner, and state functions of byte ranges.

Seven states say where a byte stands; an eighth absorbs what strict quoting forbids.  The effect of any byte
range is a function from states to states.  Such functions compose, so the exact state at the start of
every chunk of a file follows from one pass over the chunks in any order.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from csvloom.dialect import LITERAL, STRICT, TOGGLE, TRIMMED, Dialect
from csvloom.errors import CsvError, InvalidQuote, InvalidUtf8, NumberOfFields, UnclosedQuote

RECORD_START, FIELD_START, IN_FIELD, IN_QUOTED, AFTER_QUOTE, IN_ESCAPED, IN_COMMENT, BROKEN = range(8)
STATES = 8
#: Added to a state once a record has begun since the start of the range.
BEGUN = 8

Record = tuple[int, list[bytes]]


def transition(d: Dialect, state: int, b: int) -> int:
    """The state after byte ``b``."""
    if state == BROKEN:
        return BROKEN
    if state == IN_COMMENT:
        return RECORD_START if b in d.comment_ends else IN_COMMENT
    if state == IN_ESCAPED:
        return IN_QUOTED
    if state == IN_QUOTED:
        if b == d.escape and d.escape != d.quote:
            return IN_ESCAPED
        return AFTER_QUOTE if b == d.quote else IN_QUOTED
    # outside quotes
    if b == d.delimiter:
        return FIELD_START
    if b in d.terminators:
        return RECORD_START
    if state == RECORD_START and d.comment is not None and b == d.comment:
        return IN_COMMENT
    if b == d.quote and d.quote is not None:
        if state in (RECORD_START, FIELD_START):
            return IN_QUOTED
        if state == AFTER_QUOTE and d.escape == d.quote:
            return IN_QUOTED
        return {TOGGLE: IN_QUOTED, LITERAL: IN_FIELD, STRICT: BROKEN}[d.quote_handling]
    return BROKEN if state == AFTER_QUOTE and d.quote_handling == STRICT else IN_FIELD


@lru_cache(maxsize=64)
def _tables(d: Dialect) -> np.ndarray:
    """Per byte: state after each of the 16 states (with and without a record begun)."""
    out = np.zeros((256, 2 * STATES), dtype=np.uint8)
    for b in range(256):
        for s in range(STATES):
            to = transition(d, s, b)
            begins = s == RECORD_START and to not in (RECORD_START, IN_COMMENT)
            out[b, s] = to + BEGUN * begins
            out[b, s + BEGUN] = to + BEGUN
    return out


IDENTITY = bytes(range(2 * STATES))


def compose(first: bytes, then: bytes) -> bytes:
    """The function of two adjacent ranges from those of each."""
    return bytes(then[s] for s in first)


def range_function(data: bytes, d: Dialect, block: int = 1 << 16) -> bytes:
    """The state function of a byte range: entry s is the state (plus BEGUN if a record began) after starting in s."""
    if data and d.quote_handling == TOGGLE and d.comment is None and d.quote is not None and d.escape in (None, d.quote):
        return _parity_function(data, d)
    table = _tables(d)
    held = IDENTITY
    # a run of bytes that mean nothing acts like its first one
    plain = np.ones(256, dtype=bool)
    for b in (d.delimiter, *d.terminators, d.quote, d.escape, d.comment, *d.comment_ends):
        if b is not None:
            plain[b] = False
    whole = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(whole), block):
        some = whole[at : at + block]
        p = plain[some]
        keep = ~p
        keep[0] = True
        keep[1:] |= ~p[:-1]
        f = table[some[keep]]
        while len(f) > 1:
            if len(f) % 2:
                f = np.concatenate([f, np.arange(2 * STATES, dtype=np.uint8)[None, :]])
            f = np.take_along_axis(f[1::2], f[0::2].astype(np.intp), axis=1)
        held = compose(held, f[0].tobytes())
    return held


@lru_cache(maxsize=64)
def _first_ends(d: Dialect) -> tuple[re.Pattern, re.Pattern]:
    """Bytes to the first terminator outside quotes, from a place outside and from one inside."""
    q, ends = b"\\x%02x" % d.quote, b"".join(b"\\x%02x" % b for b in d.terminators)
    outside = b"[^%b%b]*+(?:%b[^%b]*+%b[^%b%b]*+)*+[%b]" % (q, ends, q, q, q, q, ends, ends)
    return re.compile(outside), re.compile(b"[^%b]*+%b" % (q, q) + outside)


def _parity_function(data: bytes, d: Dialect, block: int = 1 << 16) -> bytes:
    """The state function where every quote toggles: the number of quotes and the last byte tell the state.

    States that such a dialect does not reach go to BROKEN.
    """
    quotes = data.count(d.quote)
    last = data[-1]
    outside = FIELD_START if last == d.delimiter else RECORD_START if last in d.terminators else AFTER_QUOTE if last == d.quote else IN_FIELD
    content = len(data.rstrip(bytes(d.terminators)))  # one past the last byte that is not a terminator

    def begins(parity: int) -> bool:
        """Does a record begin after the first terminator outside quotes?"""
        for at in range(0, content, block):
            m = _first_ends(d)[parity].match(data, at, at + block)
            if m is not None:
                return m.end() <= content
            parity ^= data.count(d.quote, at, at + block) & 1
        return False

    out = bytearray([BROKEN] * STATES)
    after = [begins(0), begins(1)]
    for state in (RECORD_START, FIELD_START, IN_FIELD, IN_QUOTED, AFTER_QUOTE):
        parity = int(state == IN_QUOTED)
        to = IN_QUOTED if (quotes + parity) % 2 else outside
        begun = content > 0 if state == RECORD_START else after[parity]
        out[state] = to + BEGUN * begun
    return bytes(out) + bytes(x % BEGUN + BEGUN for x in out)


class Incomplete(Exception):
    """The bytes at hand end inside a record that goes on."""


@lru_cache(maxsize=64)
def _patterns(d: Dialect) -> tuple[re.Pattern, re.Pattern | None, re.Pattern, re.Pattern]:
    """What ends plain text, quoted text and comments, and a byte that is no terminator."""
    esc = lambda *bs: re.compile(b"[" + b"".join(b"\\x%02x" % b for b in bs if b is not None) + b"]")
    mid_quote = None if d.quote_handling == LITERAL else d.quote
    quoted_end = esc(d.quote, d.escape) if d.quote is not None else None
    not_blank = re.compile(b"[^" + b"".join(b"\\x%02x" % b for b in d.terminators) + b"]")
    return esc(d.delimiter, *d.terminators, mid_quote), quoted_end, esc(*d.comment_ends), not_blank


class Scanner:
    """Scans records of a buffer by the grammar; offsets are those of the buffer plus ``base``."""

    def __init__(self, d: Dialect) -> None:
        self.d = d
        self.plain_end, self.quoted_end, self.comment_end, self.not_blank = _patterns(d)

    def finish(self, data: bytes, at: int, state: int, base: int, final: bool, field_at: int | None = None) -> tuple[list[bytes], int]:
        """From inside a record (state other than RECORD_START and IN_COMMENT) to its end: its fields and where it ends."""
        d, n = self.d, len(data)
        quote, escape, delimiter, ends = d.quote, d.escape, d.delimiter, d.terminators
        fields: list[bytes] = []
        parts: list[bytes] = []
        begin = at if field_at is None else field_at

        def push() -> None:
            whole = parts[0] if len(parts) == 1 else b"".join(parts)
            fields.append(whole.strip(TRIMMED) if d.trim else whole)
            parts.clear()

        while True:
            if at >= n:
                if not final:
                    raise Incomplete
                if state in (IN_QUOTED, IN_ESCAPED):
                    raise UnclosedQuote(base + begin)
                push()
                return fields, at
            if state == IN_QUOTED:
                m = self.quoted_end.search(data, at)
                stop = m.start() if m else n
                if stop > at:
                    parts.append(data[at:stop])
                at = stop
                if m:
                    state = AFTER_QUOTE if data[at] == quote else IN_ESCAPED
                    at += 1
            elif state == IN_ESCAPED:
                parts.append(data[at : at + 1])
                at += 1
                state = IN_QUOTED
            else:
                b = data[at]
                if b == delimiter:
                    push()
                    at += 1
                    state, begin = FIELD_START, at
                elif b in ends:
                    push()
                    return fields, at + 1
                elif b == quote and quote is not None and (state != IN_FIELD or d.quote_handling != LITERAL):
                    if state == AFTER_QUOTE and escape == quote:
                        parts.append(data[at : at + 1])
                        state = IN_QUOTED
                    elif state == FIELD_START or d.quote_handling == TOGGLE:
                        state = IN_QUOTED
                    elif d.quote_handling == STRICT:
                        raise InvalidQuote(base + at)
                    else:
                        parts.append(data[at : at + 1])
                        state = IN_FIELD
                    at += 1
                else:
                    if state == AFTER_QUOTE and d.quote_handling == STRICT:
                        raise InvalidQuote(base + at)
                    m = self.plain_end.search(data, at)
                    stop = m.start() if m else n
                    parts.append(data[at:stop])
                    at, state = stop, IN_FIELD

    def records(self, data: bytes, base: int = 0, at: int = 0, state: int = RECORD_START, stop: int | None = None, final: bool = True) -> Iterator[Record]:
        """Records that begin at or after ``at`` and before ``stop`` (of the buffer), as (offset, fields).

        With ``state`` other than RECORD_START the bytes up to the first record's begin belong to an
        earlier one.  Raises :class:`Incomplete` where a record or comment goes past the buffer and ``final`` is not set.
        """
        n = len(data)
        stop = n if stop is None else stop
        if state == BROKEN:
            return
        if state not in (RECORD_START, IN_COMMENT):
            at = self.skip(data, at, state, base, final)
            state = RECORD_START
        while at < stop:
            if state == IN_COMMENT:
                m = self.comment_end.search(data, at)
                if m is None:
                    if not final:
                        raise Incomplete
                    return
                at, state = m.end(), RECORD_START
                continue
            m = self.not_blank.search(data, at)
            if m is None or m.start() >= stop:
                return
            at = m.start()
            self.at = at  # where to go on if the record or comment is incomplete
            if self.d.comment is not None and data[at] == self.d.comment:
                at, state = at + 1, IN_COMMENT
                continue
            fields, end = self.finish(data, at, FIELD_START, base, final)
            self.end = end
            yield base + at, fields
            at = end
        if state == IN_COMMENT and not final:
            raise Incomplete

    def skip(self, data: bytes, at: int, state: int, base: int, final: bool) -> int:
        """Where the record that is open in ``state`` ends; its errors are its owner's to raise."""
        try:
            return self.finish(data, at, state, base, final)[1]
        except (UnclosedQuote, InvalidQuote):
            return len(data)

    #: Where the last record began, or the one that is incomplete, and where the last one ended.
    at = end = 0


def utf8_error(data: bytes, base: int = 0, final: bool = True) -> InvalidUtf8 | None:
    """The first byte that is not UTF-8, if any; a character that the end cuts counts only if it is ``final``."""
    try:
        ends = pa.py_buffer(np.array([0, len(data)], dtype=np.int64))
        pa.Array.from_buffers(pa.large_string(), 1, [None, ends, pa.py_buffer(data)]).validate(full=True)
        return None
    except pa.ArrowInvalid:
        pass
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        return InvalidUtf8(base + e.start) if final or e.reason != "unexpected end of data" else None
    return None


def checked(data: bytes, d: Dialect, columns: int | None = None, base: int = 0, header: bool | None = None, state: int = RECORD_START, final: bool = True) -> Generator[Record, None, tuple[int, bool]]:
    """Records of bytes that begin where a record does, as (offset, fields), up to the first error in order of offset.

    The first record goes where ``header`` says so (default: as the dialect has it), unchecked but for its encoding.
    Returns how many bytes belong to whole records and comments (all of them if ``final``), and whether the
    header is still to come.
    """
    bad = utf8_error(data, base, final) if d.field_type == "string" else None
    first = d.header if header is None else header
    scanner, done = Scanner(d), len(data)
    try:
        for offset, fields in scanner.records(data, base, state=state, final=final):
            if bad is not None and offset > bad.offset:
                raise bad
            if not first and columns is not None and len(fields) != columns:
                raise NumberOfFields(columns, len(fields), offset)
            if bad is not None and bad.offset < base + scanner.end:
                raise bad
            if not first:
                yield offset, fields
            first = False
    except CsvError as e:
        raise bad if bad is not None and (e.offset is None or bad.offset < e.offset) else e
    except Incomplete:
        done = scanner.at
    if bad is not None and bad.offset < base + done:
        raise bad
    return done, first


def parse_bytes(data: bytes, d: Dialect, columns: int | None = None) -> list[Record]:
    """All records of a whole input."""
    return list(checked(data, d, columns))
