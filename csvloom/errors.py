"""Errors of a parse, each with the byte offset it points to."""

from __future__ import annotations


class CsvError(ValueError):
    """Base of all parse errors; ``offset`` counts bytes from the start of the file, slice or stream."""

    def __init__(self, text: str, offset: int | None = None) -> None:
        super().__init__(text)
        self.offset = offset

    def __reduce__(self):
        return _rebuilt, (type(self), str(self), self.offset)


def _rebuilt(kind: type, text: str, offset: int | None) -> CsvError:
    out = kind.__new__(kind)
    CsvError.__init__(out, text, offset)
    return out


class InvalidConfig(CsvError):
    def __init__(self, why: str) -> None:
        super().__init__(f"invalid parser configuration: {why}")


class NumberOfFields(CsvError):
    def __init__(self, expected: int, found: int, offset: int) -> None:
        super().__init__(f"expected {expected} fields, found {found} in the record at byte {offset}", offset)


class InvalidUtf8(CsvError):
    def __init__(self, offset: int) -> None:
        super().__init__(f"invalid UTF-8 at byte {offset}", offset)


class InvalidQuote(CsvError):
    def __init__(self, offset: int) -> None:
        super().__init__(f"quote not at field boundary at byte {offset}", offset)


class UnclosedQuote(CsvError):
    def __init__(self, offset: int) -> None:
        super().__init__(f"unterminated quoted field at byte {offset}", offset)


class RecordTooLong(CsvError):
    def __init__(self, limit: int, offset: int) -> None:
        super().__init__(f"record at byte {offset} is longer than {limit} bytes", offset)


class UserError(CsvError):
    """What a user's accumulator raised; an error of this module passes unwrapped."""
