"""What a CSV input looks like: separators, quoting, comments, header, trimming, record mode."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from csvloom.errors import InvalidConfig

CRLF, LF, CR = "CRLF", "LF", "CR"
TOGGLE, STRICT, LITERAL = "toggle", "strict", "literal"
ARITY, VARIADIC, FLEXIBLE = "arity", "variadic", "flexible"
STRING, BINARY = "string", "binary"
AUTO, NATIVE, VECTOR, EXACT = "auto", "native", "vector", "exact"

#: Bytes that trimming strips (vertical tab is not among them).
TRIMMED = b" \t\n\x0c\r"


def _byte(value: str | bytes | int | None, what: str) -> int | None:
    if value is None or value in ("", b""):
        return None
    if isinstance(value, int):
        if not 0 <= value < 256:
            raise InvalidConfig(f"{what} is not a byte")
        return value
    data = value.encode("utf-8") if isinstance(value, str) else value
    if len(data) != 1:
        raise InvalidConfig(f"{what} must be a single byte")
    return data[0]


@dataclass(frozen=True)
class Dialect:
    """A dialect; bytes are given as one-character strings, bytes or integers, '' or None for none.

    ``terminator`` is CRLF (any of CR, LF, CR LF ends a record), LF, CR, or a byte.  ``escape`` equal to
    ``quote`` means doubling; another escape makes the next byte literal, inside quotes only.  A comment
    ends at LF (under CRLF also at CR) whatever the terminator.
    """

    delimiter: str | bytes | int = ","
    terminator: str | bytes | int = CRLF
    quote: str | bytes | int | None = '"'
    escape: str | bytes | int | None = '"'
    quote_handling: str = TOGGLE
    comment: str | bytes | int | None = None
    header: bool = True
    trim: bool = False
    record_mode: str = ARITY
    field_type: str = STRING

    def __post_init__(self) -> None:
        named = {CRLF: CRLF, LF: 0x0A, CR: 0x0D}
        ends = self.terminator
        ends = named[ends.upper()] if isinstance(ends, str) and ends.upper() in named else _byte(ends, "terminator")
        put = lambda k, v: object.__setattr__(self, k, v)
        put("terminator", ends)
        for k in ("delimiter", "quote", "escape", "comment"):
            put(k, _byte(getattr(self, k), k))
        if self.quote is None and self.escape == 0x22:
            put("escape", None)  # the default escape goes with the quote
        if self.delimiter is None or self.terminator is None:
            raise InvalidConfig("delimiter and terminator are needed")
        for k, allowed in (("quote_handling", (TOGGLE, STRICT, LITERAL)), ("record_mode", (ARITY, VARIADIC, FLEXIBLE)), ("field_type", (STRING, BINARY))):
            if getattr(self, k) not in allowed:
                raise InvalidConfig(f"{k} must be one of {', '.join(allowed)}")
        if self.escape is not None and self.quote is None:
            raise InvalidConfig("escape requires quote")
        used: dict[int, str] = {}
        controls = [("delimiter", self.delimiter), *(("terminator", b) for b in self.terminators), ("quote", self.quote), ("comment", self.comment)]
        if self.escape != self.quote:
            controls.append(("escape", self.escape))
        for what, b in controls:
            if b is None:
                continue
            if b in used:
                raise InvalidConfig(f"{what} and {used[b]} are the same byte")
            if self.field_type == STRING and b > 0x7F:
                raise InvalidConfig(f"{what} must be ASCII in text mode")
            used[b] = what

    @property
    def terminators(self) -> tuple[int, ...]:
        return (0x0D, 0x0A) if self.terminator == CRLF else (self.terminator,)

    @property
    def comment_ends(self) -> tuple[int, ...]:
        return (0x0D, 0x0A) if self.terminator == CRLF else (0x0A,)

    def with_(self, **changes) -> "Dialect":
        return replace(self, **changes)

    def supports(self, backend: str, columns: int | None = None) -> str | None:
        """Why a backend cannot read this dialect, or None if it can."""
        if backend == NATIVE:
            if self.quote is not None:
                return "the native plan has no quotes"
            if self.header:
                return "the native plan has no header"
            if self.comment is not None and self.terminator not in (CRLF, 0x0A):
                return "comments end at line feeds, which this terminator does not"
            if self.field_type == BINARY:
                return "the native plan splits text"
            if self.terminator != CRLF and self.terminator > 0x7F:
                return "the native plan needs an ASCII terminator"
        elif backend == VECTOR:
            if self.record_mode != ARITY or columns is None or columns < 2:
                return "the vector reader needs a fixed number of fields, two or more"
            if self.trim or self.comment is not None:
                return "the vector reader has no trimming or comments"
            if self.quote is not None and self.escape != self.quote:
                return "the vector reader has only doubled quotes"
            if self.terminator not in (CRLF, 0x0A):
                return "the vector reader needs line ends"
        elif backend not in (AUTO, EXACT):
            return f"no backend is named {backend}"
        return None

    @classmethod
    def from_options(cls, options: Mapping[str, str]) -> "Dialect":
        """From data source options: sep, terminator, quote, escape, quoteHandling, comment, header, trim, recordMode, fieldType."""
        given = {k.lower(): v for k, v in options.items()}
        names = {"sep": "delimiter", "delimiter": "delimiter", "quotehandling": "quote_handling", "recordmode": "record_mode", "fieldtype": "field_type"}
        known = {f.name for f in fields(cls)}
        out: dict = {}
        for k, v in given.items():
            name = names.get(k, k)
            if name in ("header", "trim"):
                if str(v).lower() not in ("true", "false"):
                    raise InvalidConfig(f"{k} must be true or false")
                out[name] = str(v).lower() == "true"
            elif name in known:
                out[name] = v.lower() if name in ("quote_handling", "record_mode", "field_type") else v
        return cls(**out)
