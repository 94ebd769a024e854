"""The record grammar: golden vectors, quote modes, errors, and chunk seams."""

import csv
import io
import random

import pytest

from csvloom.dialect import Dialect
from csvloom.errors import CsvError, InvalidConfig
from csvloom.functions import vector
from csvloom.functions.machine import BEGUN, IDENTITY, RECORD_START, checked, compose, parse_bytes, range_function
from csvloom.sources import files


def records(data, columns=None, **settings):
    d = Dialect(**({"header": False, "record_mode": "flexible"} | settings))
    try:
        return [[f.decode("latin-1") for f in r] for _, r in parse_bytes(data, d, columns)]
    except CsvError as e:
        return str(e)


ACCEPTED = [
    (b"a,b,c\n1,2,3\n", {}, [["a", "b", "c"], ["1", "2", "3"]]),
    (b"a,b\n1,2", {}, [["a", "b"], ["1", "2"]]),
    (b"a,b\r1,2\n3,4\r\n", {}, [["a", "b"], ["1", "2"], ["3", "4"]]),
    (b"\n\n\na,b\n\n", {}, [["a", "b"]]),
    (b"\n\nh1,h2\n1,2\n", {"header": True}, [["1", "2"]]),
    (b"a,b\n  \n1,2\n", {}, [["a", "b"], ["  "], ["1", "2"]]),
    (b"a,b,", {}, [["a", "b", ""]]),
    (b",,,\n", {}, [["", "", "", ""]]),
    (b'""\n', {}, [[""]]),
    (b"", {}, []),
    (b"a,b\r\n1,2\r\n", {"terminator": "LF"}, [["a", "b\r"], ["1", "2\r"]]),
    (b"a,b;c,d;", {"terminator": ";"}, [["a", "b"], ["c", "d"]]),
    (b'"a\r\nb",c\r\n', {}, [["a\r\nb", "c"]]),
    (b'"he said ""hi""",ok\n', {}, [['he said "hi"', "ok"]]),
    (b'"a,b"\n', {"quote": None}, [['"a', 'b"']]),
    (b'"a\\"b",c\n', {"escape": "\\"}, [['a"b', "c"]]),
    (b'"a\\nb",c\n', {"escape": "\\"}, [["anb", "c"]]),
    (b"a\\,b\n", {"escape": "\\"}, [["a\\", "b"]]),
    (b"# c\na,b\n# d\n1,2\n", {"comment": "#"}, [["a", "b"], ["1", "2"]]),
    (b" #c\na\n", {"comment": "#"}, [[" #c"], ["a"]]),
    (b'#it"s\na,b\n', {"comment": "#"}, [["a", "b"]]),
    (b"#c\ra,b\r1,2\r", {"comment": "#", "terminator": "CR"}, []),
    (b"  hello , world \n\tfoo\t,  bar  \n", {"trim": True}, [["hello", "world"], ["foo", "bar"]]),
    (b'"  a  ", b \n', {"trim": True}, [["a", "b"]]),
    (b"\x0ba\x0b,b\n", {"trim": True}, [["\x0ba\x0b", "b"]]),
    (b"\xef\xbb\xbfa,b\n", {}, [["\xef\xbb\xbfa", "b"]]),
]


@pytest.mark.parametrize("data,settings,expected", ACCEPTED)
def test_accepted(data, settings, expected):
    assert records(data, **settings) == expected


@pytest.mark.parametrize(
    "data,toggle,literal,strict",
    [
        (b'x"y,z"w\n', [["xy,zw"]], [['x"y', 'z"w']], "quote not at field boundary at byte 1"),
        (b'"a"b,c\n', [["ab", "c"]], [["ab", "c"]], "quote not at field boundary at byte 3"),
        (b'"a"b"c,d"\n', [["abc,d"]], [['ab"c', 'd"']], "quote not at field boundary at byte 3"),
        (b'"a""b",c\n', [['a"b', "c"]], [['a"b', "c"]], [['a"b', "c"]]),
        (b' "a,b",c\n', [[" a,b", "c"]], [[' "a', 'b"', "c"]], "quote not at field boundary at byte 1"),
    ],
)
def test_quote_modes(data, toggle, literal, strict):
    assert [records(data, quote_handling=m) for m in ("toggle", "literal", "strict")] == [toggle, literal, strict]


def test_quote_modes_without_escape():
    assert records(b'"a""b",c\n', escape=None) == [["ab", "c"]]
    assert records(b'"a""b",c\n', escape=None, quote_handling="literal") == [['a"b"', "c"]]
    assert records(b'"a""b",c\n', escape=None, quote_handling="strict") == "quote not at field boundary at byte 3"


@pytest.mark.parametrize(
    "data,columns,settings,message",
    [
        (b"1,2\n3\n", 2, {}, "expected 2 fields, found 1 in the record at byte 4"),
        (b"1,2\n3,4,5\n", 2, {}, "expected 2 fields, found 3 in the record at byte 4"),
        (b'1,2\n""\n', 2, {}, "expected 2 fields, found 1 in the record at byte 4"),
        (b'a,b\n"unclosed\n', None, {}, "unterminated quoted field at byte 4"),
        (b'a,b\nfoo,"bar\n', None, {}, "unterminated quoted field at byte 8"),
        (b'x\n"\\', None, {"escape": "\\"}, "unterminated quoted field at byte 2"),
        (b"hello,\xffworld\n", None, {}, "invalid UTF-8 at byte 6"),
        (b'\xff,"open', None, {}, "invalid UTF-8 at byte 0"),
        (b"1,2\n3\n\xff", 2, {}, "expected 2 fields, found 1 in the record at byte 4"),
    ],
)
def test_errors(data, columns, settings, message):
    assert records(data, columns, **settings) == message


def test_header_is_not_checked():
    assert records(b"h1\n1,2\n", 2, header=True) == [["1", "2"]]


def test_bytes_mode_takes_any_byte():
    d = Dialect(header=False, record_mode="flexible", field_type="binary")
    assert parse_bytes(b"a,\xff\n", d) == [(0, [b"a", b"\xff"])]


@pytest.mark.parametrize(
    "settings",
    [{"delimiter": '"'}, {"delimiter": "\r"}, {"escape": ","}, {"quote": None, "escape": "\\"}, {"delimiter": 0xE9}, {"comment": ","}, {"delimiter": "ab"}, {"quote_handling": "none"}, {"delimiter": ""}],
)
def test_invalid_configurations(settings):
    with pytest.raises(InvalidConfig, match="invalid parser configuration"):
        Dialect(**settings)


def chunked(path, data, d, size, columns=None):
    """Every chunk from its composed start state, as the scan does it."""
    state, header, out = RECORD_START, d.header, []
    for at in range(0, len(data), size):
        to = range_function(data[at : at + size], d)[state]
        begun, to = to >= BEGUN, to % BEGUN
        with files.Window(path) as w:
            base, part, first = files.region(w, d, at, min(at + size, len(data)), state, to)
        out += checked(part, d, columns, base, header=header and begun, state=first)
        header = header and not begun
        state = to
    return out


def outcome(f):
    try:
        return f()
    except CsvError as e:
        return str(e)


def any_dialect(rnd):
    return Dialect(
        header=rnd.random() < 0.3, record_mode="flexible", quote_handling=rnd.choice(["toggle", "strict", "literal"]), escape=rnd.choice(['"', "\\", None]),
        comment=rnd.choice([None, "#"]), terminator=rnd.choice(["CRLF", "LF", "CR"]),
    )


def test_chunk_seams(tmp_path):
    rnd = random.Random(11)
    path = str(tmp_path / "x.csv")
    for _ in range(400):
        data = "".join(rnd.choice('ab,,""\n\r\\# é') for _ in range(rnd.randint(0, 24))).encode()
        d = any_dialect(rnd)
        with open(path, "wb") as f:
            f.write(data)
        whole = outcome(lambda: parse_bytes(data, d))
        for size in (1, 2, 3, 5, 8, 10, 16, 64):
            assert outcome(lambda: chunked(path, data, d, size)) == whole, (data, d, size)


def test_record_longer_than_many_chunks(tmp_path):
    path = str(tmp_path / "x.csv")
    data = b'h,h\n"' + b"x\n," * 100_000 + b'",1\n2,3\n'
    with open(path, "wb") as f:
        f.write(data)
    assert chunked(path, data, Dialect(), 65536, 2) == parse_bytes(data, Dialect(), 2)


def test_functions_compose():
    rnd = random.Random(3)
    for _ in range(200):
        data = bytes(rnd.choice(b'ab,"\n\r\\#') for _ in range(rnd.randint(0, 40)))
        d, cut = any_dialect(rnd), rnd.randint(0, 40)
        whole = range_function(data, d)
        assert compose(range_function(data[:cut], d), range_function(data[cut:], d)) == whole
        assert compose(IDENTITY, whole) == whole == range_function(data, d, block=3)


def test_parity_shortcut_equals_the_table():
    from csvloom.functions import machine

    rnd = random.Random(13)
    for _ in range(500):
        data = bytes(rnd.choice(b'ab,"\n\r;') for _ in range(rnd.randint(1, 30)))
        d = Dialect(escape=rnd.choice(['"', None]), terminator=rnd.choice(["CRLF", "LF", ";"]))
        state_of = lambda s: machine._parity_function(data, d, block=rnd.choice([1, 4, 64]))[s]
        for start in (machine.RECORD_START, machine.FIELD_START, machine.IN_FIELD, machine.IN_QUOTED, machine.AFTER_QUOTE):
            state = start
            for b in data:
                state = machine._tables(d)[b, state]
            assert state_of(start) == state, (data, d, start)


def test_vector_reader_agrees_or_declines():
    rnd, agreed = random.Random(7), 0
    for _ in range(1500):
        data = "".join(rnd.choice('ab,,""\n\n ') for _ in range(rnd.randint(0, 20))).encode()
        d = Dialect(header=False, quote=rnd.choice(['"', None]), quote_handling=rnd.choice(["toggle", "strict", "literal"]), terminator=rnd.choice(["CRLF", "LF"]))
        table = vector.read(data, d, 2)
        if table is not None:
            assert [list(r.values()) for r in table.to_pylist()] == [r for _, r in parse_bytes(data, d, 2)], (data, d)
            agreed += 1
    assert agreed > 100


def test_literal_is_what_the_csv_module_reads():
    rnd = random.Random(9)
    d = Dialect(header=False, record_mode="flexible", quote_handling="literal")
    for _ in range(1500):
        text = "".join(rnd.choice('ab,""\n ') for _ in range(rnd.randint(0, 14)))
        got = outcome(lambda: [[f.decode() for f in r] for _, r in parse_bytes(text.encode(), d)])
        if isinstance(got, list):
            assert got == [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def test_wide_records():
    assert len(records(b",".join([b"x"] * 64_000) + b"\n")[0]) == 64_000
