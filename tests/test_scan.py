"""Files, slices, streams, the data source, folds and reports."""

import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from csvloom.dialect import Dialect
from csvloom.errors import CsvError, InvalidConfig, NumberOfFields, UnclosedQuote, UserError
from csvloom.functions.columns import explode_records
from csvloom.functions.machine import RECORD_START, Scanner, utf8_error
from csvloom.operators import aggregates, reports
from csvloom.parser import Parser
from csvloom.plans import chunks, native
from csvloom.sources import datasource


def put(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


CITIES = b'name,age,city\nAnn,31,"Oslo, East"\nBo,44,Lund\nCy,44,"two\nlines"\n'


@pytest.mark.parametrize("size", [1, 7, 16, 1 << 20])
def test_scan_of_quoted_file_at_any_chunk_size(spark, tmp_path, size):
    rows = chunks.scan(spark, put(tmp_path, "a.csv", CITIES), Dialect(), 3, chunk_size=size, offsets=True).orderBy("_record_offset").collect()
    assert [tuple(r)[:3] for r in rows] == [("Ann", "31", "Oslo, East"), ("Bo", "44", "Lund"), ("Cy", "44", "two\nlines")]
    assert [r["_record_offset"] for r in rows] == [14, 34, 45]


def test_header_is_dropped_from_every_file(spark, tmp_path):
    for i in range(3):
        put(tmp_path, f"{i}.csv", b"\n\na,b\n%d,x\n" % i)
    put(tmp_path, "empty.csv", b"")
    for d in (Dialect(), Dialect(quote=None)):
        assert sorted(r[0] for r in chunks.scan(spark, str(tmp_path), d, 2, chunk_size=2).collect()) == ["0", "1", "2"]


def test_flexible_and_binary_modes(spark, tmp_path):
    path = put(tmp_path, "a.csv", b"a\n1,2,3\n\n4\n")
    rows = chunks.scan(spark, path, Dialect(header=False, record_mode="flexible")).collect()
    assert sorted(r["fields"] for r in rows) == [["1", "2", "3"], ["4"], ["a"]]
    raw = chunks.scan(spark, put(tmp_path, "b.csv", b"a,\xff\n"), Dialect(header=False, field_type="binary"), 2).first()
    assert (bytes(raw[0]), bytes(raw[1])) == (b"a", b"\xff")


def test_scan_of_nothing(spark, tmp_path):
    assert chunks.scan(spark, put(tmp_path, "a.csv", b""), Dialect(), 2).count() == 0
    with pytest.raises(FileNotFoundError):
        chunks.scan(spark, str(tmp_path / "none.csv"), Dialect(), 2)
    with pytest.raises(InvalidConfig):
        chunks.scan(spark, str(tmp_path), Dialect())


def test_malformed_file_fails_the_query(spark, tmp_path):
    with pytest.raises(Exception, match="expected 2 fields, found 1 in the record at byte 8"):
        chunks.scan(spark, put(tmp_path, "a.csv", b"a,b\n1,2\n3\n"), Dialect(), 2, chunk_size=3).collect()


def test_native_plan_equals_the_exact_one(spark, tmp_path):
    rnd = random.Random(2)
    for i, (ends, terminator) in enumerate([("\n", "LF"), ("\r\n", "CRLF"), (";", ";")]):
        text = "".join(rnd.choice(["a", "b", "|", " ", "é", "#", ends]) for _ in range(400))
        path = put(tmp_path, f"{i}.txt", text.encode())
        d = Dialect(delimiter="|", terminator=terminator, quote=None, header=False, record_mode="flexible", trim=i == 1, comment="#" if i < 2 else None)
        a = sorted(r["fields"] for r in native.read_native(spark, path, d).collect())
        assert a == sorted(r["fields"] for r in chunks.scan(spark, path, d, chunk_size=50).collect())


def test_native_plan_keeps_a_byte_order_mark(spark, tmp_path):
    path = put(tmp_path, "a.txt", b"\xef\xbb\xbfa|b\n")
    d = Dialect(delimiter="|", quote=None, header=False)
    assert native.read_native(spark, path, d, 2).first()[0] == "﻿a"


def test_native_plan_stays_in_the_jvm(spark, tmp_path):
    path = put(tmp_path, "a.txt", b"1|2\n")
    df = native.read_native(spark, path, Dialect(delimiter="|", quote=None, header=False), 2).agg(F.sum(F.col("_c0").cast("int")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_data_source(spark, tmp_path):
    datasource.register(spark)
    path = put(tmp_path, "a.csv", CITIES)
    df = spark.read.format("dialect_csv").options(columns="3", quoteHandling="strict").load(path)
    assert df.where("_c1 = '44'").count() == 2
    named = spark.read.format("dialect_csv").schema("name string, age string, city string").load(path)
    assert sorted(r["name"] for r in named.collect()) == ["Ann", "Bo", "Cy"]
    lines = put(tmp_path, "b.txt", b"h\n" + b"".join(b"%d|x\n" % i for i in range(500)))
    split = spark.read.format("dialect_csv").options(columns="2", sep="|", quote="", terminator="LF", chunkSize="100").load(lines)
    assert split.rdd.getNumPartitions() > 10 and split.count() == 500


def test_parse_folds_in_file_order(spark, tmp_path):
    path = put(tmp_path, "a.csv", b"n\n" + b"".join(b"%d\n" % i for i in range(300)))

    def merge(states):
        return [x for s in states for x in s]

    parser = Parser.builder().chunk_size(64).build()
    assert parser.parse(spark, path, list, lambda s, r: s.append(int(r[0])), merge, columns=1) == list(range(300))
    assert parser.parse(spark, put(tmp_path, "e.csv", b""), list, lambda s, r: None, merge, columns=1) == []


def test_parse_raises_the_first_error_in_file_order(spark, tmp_path):
    parser = Parser.builder().chunk_size(4).has_headers(False).build()
    path = put(tmp_path, "a.csv", b'1,2\n3\n4,5,6\n"open')
    with pytest.raises(NumberOfFields) as e:
        parser.parse(spark, path, list, lambda s, r: None, len, columns=2)
    assert e.value.offset == 4

    def refuse(state, record):
        if record[0] == "3":
            raise ValueError("no threes")

    with pytest.raises(UserError, match="no threes"):
        Parser.builder().variadic().has_headers(False).build().parse(spark, path[:-5] + "a.csv", list, refuse, len)


def test_slice_and_stream_agree():
    rnd = random.Random(4)
    for _ in range(500):
        data = "".join(rnd.choice('ab,,""\n\r\\# é') for _ in range(rnd.randint(0, 24))).encode()
        d = Dialect(header=rnd.random() < 0.3, record_mode="flexible", field_type="binary", escape=rnd.choice(['"', "\\", None]), comment=rnd.choice([None, "#"]), terminator=rnd.choice(["CRLF", "LF", "CR"]))
        flat = lambda states: [x for s in states for x in s]

        def run(f):
            try:
                return f()
            except CsvError as e:
                return str(e)

        a = run(lambda: Parser(d).parse_slice(data, list, lambda s, r: s.append(r), flat))
        b = run(lambda: Parser(d).parse_stream(io.BytesIO(data), list, lambda s, r: s.append(r), flat, block=rnd.randint(1, 9)))
        assert a == b, (data, d)


def test_stream_has_one_state_and_slice_of_nothing_none():
    assert Parser().parse_stream(io.BytesIO(b""), list, lambda s, r: None, len, columns=1) == 1
    assert Parser().parse_slice(b"", list, lambda s, r: None, len, columns=1) == 0


def test_builder_reports_unsupported_backends():
    b = Parser.builder().comment("#")
    assert b.supports_backend("vector", 3) and b.supports_backend("exact") is None
    with pytest.raises(InvalidConfig):
        Parser.builder().delimiter('"').build()


def test_column_of_documents(spark):
    df = spark.createDataFrame([(1, 'h\n"a\nb",2\n'), (2, None), (3, "")], "id int, csv string")
    assert [tuple(r) for r in explode_records(df, "csv", Dialect(), 2).collect()] == [(1, 0, "a\nb", "2")]
    plain = explode_records(df, "csv", Dialect(quote=None, record_mode="flexible", header=False)).where("id = 1")
    assert [r["fields"] for r in plain.orderBy("pos").collect()] == [["h"], ['"a'], ['b"', "2"]]
    with pytest.raises(Exception, match="unterminated quoted field at byte 0"):
        explode_records(spark.createDataFrame([(1, '"x')], "id int, csv string"), "csv", Dialect(header=False), 1).collect()


def test_errors_survive_pickling():
    import pickle

    e = pickle.loads(pickle.dumps(UnclosedQuote(5)))
    assert isinstance(e, UnclosedQuote) and e.offset == 5 and str(e) == "unterminated quoted field at byte 5"


def test_digests_tell_inputs_apart(spark):
    a = spark.createDataFrame([("x", "y"), ("x", "y"), ("z", "")], "a string, b string")
    b = spark.createDataFrame([("z", ""), ("x", "y")], "a string, b string")
    c = spark.createDataFrame([("z", ""), ("z", ""), ("x", "y")], "a string, b string")
    assert aggregates.compare_digests(a, a.orderBy("a")).first()["equal"]
    assert not aggregates.compare_digests(a, b).first()["equal"] and not aggregates.compare_digests(a, c).first()["equal"]


def test_assertions_fail_and_do_not_filter(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert aggregates.validated(df, F.col("x") > 0, "bad").count() == 2
    with pytest.raises(Exception, match="bad"):
        aggregates.validated(df, F.col("x") > 1, "bad").collect()


@pytest.mark.parametrize("data,expected", [(b"a;b\n1;2\n3;4\n", {"delimiter": ";", "columns": 2}), (b"a,b\n1,2\n", {"columns": 2}), (b"a\tb\n\xff\t2\n", {"delimiter": "\t", "columns": 2, "encoding": "non-utf-8"})])
def test_sniffing(tmp_path, data, expected):
    assert reports.sniff(put(tmp_path, "a.csv", data)) == expected


def test_sniffing_reads_whole_files(spark, tmp_path):
    """What decides comes after the first MiB, or in the second file."""
    head = b"a;b,c\n" * 200_000
    cases = [
        (head + b"\xff;b,c\n", b"", {"columns": 2, "encoding": "non-utf-8"}),
        (head, b"\xff;b,c\n", {"columns": 2, "encoding": "non-utf-8"}),
        (head + b"a;b\n" * 10, b"", {"delimiter": ";", "columns": 2}),
        (head, b"a;b\n" * 10, {"delimiter": ";", "columns": 2}),
        (head + b"1|2|3\n" * 500_000, b"", {"delimiter": "|", "columns": 3}),
        (b"a,b\n" * 300_000 + b"a,'b,c'\n" * 300_000, b"", {"quote": "'", "columns": 2}),
    ]
    for i, (first, second, expected) in enumerate(cases):
        folder = tmp_path / str(i)
        folder.mkdir()
        put(folder, "a.csv", first)
        put(folder, "b.csv", second)
        assert reports.sniff(str(folder)) == reports.sniff(str(folder), spark, 1 << 20) == expected, i


def test_sniffing_at_any_chunk_size(tmp_path):
    """Chunks count what the scanner of records finds, and see bad bytes whatever the border."""
    rnd = random.Random(5)
    for i in range(300):
        data = b"".join(rnd.choice([b"a", b",", b";", b'"', b'"', b"'", b"\n", b"\r\n", "é€😀".encode(), rnd.choice([b"b", b"\xe2"])]) for _ in range(rnd.randint(1, 30)))
        path = put(tmp_path, "a.csv", data)
        whole = reports.sniff(path)
        assert all(reports.sniff(path, chunk_size=n) == whole for n in (1, 2, 3, 7)), data
        assert (utf8_error(data) is not None) == ("encoding" in whole), data
        for d in reports.CANDIDATES:
            try:
                want = Counter(len(r) for _, r in Scanner(d).records(data))
            except UnclosedQuote:
                continue
            (many, some), got, last = reports._widths(data, d, RECORD_START)
            got = Counter(got) + Counter([n + 1 for n, there in [(many, some), *([last] if last else [])] if there])
            assert got == want, (data, d)


def test_streaming_extension(spark, tmp_path):
    from csvloom.streaming.files import stream_records

    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.csv", CITIES)
    q = stream_records(spark, str(tmp_path / "in"), Dialect(), 3).writeStream.format("memory").queryName("cities").start()
    try:
        q.processAllAvailable()
        assert spark.table("cities").count() == 3
    finally:
        q.stop()
