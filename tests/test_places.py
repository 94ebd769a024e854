"""Where errors point, and the order of records over chunks and files."""

import io
import random

import pytest
from pyspark.sql import functions as F

from csvloom.dialect import Dialect
from csvloom.errors import CsvError, InvalidConfig, InvalidUtf8, UserError
from csvloom.functions.columns import explode_records
from csvloom.functions.machine import checked
from csvloom.operators import aggregates
from csvloom.parser import Parser
from csvloom.plans import chunks, native
from csvloom.sources import datasource

RECORDS = [b"a,b,c\n", b'"a","b","c"\n', b'"a""b","c,d","e\nf"\n', b" a , b , c \n"]


def raised(f):
    with pytest.raises(CsvError) as e:
        f()
    return e.value


@pytest.mark.parametrize("record", RECORDS)
@pytest.mark.parametrize("bad", [b"\xff", b"\xc3", b"\xe2\x82", "é".encode()[1:]])
def test_bad_byte_at_every_place(record, bad):
    """Of slices and streams, in a record that others stand before and after."""
    for trim in (False, True):
        parser = Parser(Dialect(header=False, trim=trim))
        for at in range(len(record)):
            if record[at : at + 1] == b"\n" and at + 1 < len(record) or record[max(0, at - 1) : at + 1] == b'""':
                continue
            data = b"x,y,z\n" + record[:at] + bad + record[at:] + b"u,v,w\n"
            assert isinstance(e := raised(lambda: parser.parse_slice(data, list, lambda s, r: s.append(r), len, columns=3)), InvalidUtf8) and e.offset == 6 + at, data
            for block in (1, 5, 1 << 20):
                e = raised(lambda: parser.parse_stream(io.BytesIO(data), list, lambda s, r: s.append(r), len, columns=3, block=block))
                assert isinstance(e, InvalidUtf8) and e.offset == 6 + at, (data, block)


def test_records_before_a_bad_byte_are_seen_and_none_with_it():
    for at in range(6, 17):
        data = bytearray(b'x,y,z\n"a","b","c"\nu,v,w\n')
        data[at : at + 1] = b"\xff"
        seen = []
        try:
            for _, fields in checked(bytes(data), Dialect(header=False), 3):
                seen.append(fields)
        except CsvError:
            pass
        assert seen in ([[b"x", b"y", b"z"]], []), (at, seen)


def test_bad_bytes_of_files(spark, tmp_path):
    for k, record in enumerate(RECORDS[:3]):
        for at in (0, 2, len(record) - 2, len(record) - 1):
            path = tmp_path / f"{k}-{at}.csv"
            path.write_bytes(b"x,y,z\n" + record[:at] + b"\xff" + record[at:] + b"u,v,w\n" * 3)
            message = f"invalid UTF-8 at byte {6 + at}"
            with pytest.raises(Exception, match=message):
                chunks.scan(spark, str(path), Dialect(header=False), 3, chunk_size=9).collect()
            with pytest.raises(CsvError, match=message):
                Parser(Dialect(header=False), chunk_size=9).parse(spark, str(path), list, lambda s, r: None, len, columns=3)
    with pytest.raises(Exception, match="invalid UTF-8 at byte 8"):  # also in a column that is not read
        chunks.scan(spark, str(tmp_path / "0-2.csv"), Dialect(header=False), 3, fields=[0]).collect()
    rows = spark.createDataFrame([(b"x,y,z\na,b,\xff\n",)], "csv binary")
    with pytest.raises(Exception, match="invalid UTF-8 at byte 10"):
        explode_records(rows, "csv", Dialect(header=False), 3).collect()


def test_values_of_several_files_come_in_file_order(spark, tmp_path):
    want = []
    for i in range(3):
        values = [f"{i}{j}" for j in range(40)]
        (tmp_path / f"{i}.csv").write_text("h\n" + "".join(f'"{v}"\n' for v in values))
        want += values
    rows = chunks.scan(spark, str(tmp_path), Dialect(), 1, chunk_size=16, offsets=True)
    assert [r["value"] for r in aggregates.in_file_order(rows, "_c0").collect()] == want
    placed = aggregates.numbered(rows, ["_path", "_record_offset"], str(tmp_path / "scratch")).collect()
    assert [r["_c0"] for r in sorted(placed, key=lambda r: r["pos"])] == want and sorted(r["pos"] for r in placed) == [*range(1, 121)]


def test_only_the_fields_asked_for(spark, tmp_path):
    datasource.register(spark)
    path = tmp_path / "a.csv"
    path.write_bytes(b'a,b,c\n1,"x,y",3\n4,5,6\n')
    for backend in ("auto", "exact"):
        rows = chunks.scan(spark, str(path), Dialect(), 3, fields=[2, 0], backend=backend)
        assert rows.columns == ["_c2", "_c0"] and sorted(map(tuple, rows.collect())) == [("3", "1"), ("6", "4")]
    rows = spark.read.format("dialect_csv").options(columns="3", fields="1").load(str(path))
    assert rows.columns == ["_c1"] and sorted(r[0] for r in rows.collect()) == ["5", "x,y"]
    for fields in ([], [3], [0, 0], [-1]):
        with pytest.raises(InvalidConfig):
            chunks.scan(spark, str(path), Dialect(), 3, fields=fields)
    path.write_bytes(b"a,b,c\n1,2\n")
    with pytest.raises(Exception, match="expected 3 fields, found 2"):
        chunks.scan(spark, str(path), Dialect(), 3, fields=[0]).collect()


def test_records_beyond_the_limit(spark, tmp_path):
    datasource.register(spark)
    path = tmp_path / "a.txt"
    path.write_bytes(b"x|" + b"y" * 300_000 + b"\n")
    options = {"columns": "2", "sep": "|", "quote": "", "header": "false", "chunkSize": "100"}
    assert spark.read.format("dialect_csv").options(**options).load(str(path)).count() == 1
    with pytest.raises(Exception, match="longer than 1000 bytes"):
        spark.read.format("dialect_csv").options(**options, maxRecord="1000").load(str(path)).collect()


@pytest.mark.parametrize("tasks,backend", [(None, "auto"), (2, "auto"), (200, "vector")])
def test_states_are_combined_in_file_order(spark, tmp_path, tasks, backend):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("h,k\n" + "".join(f"{i * 100 + j},x\n" for j in range(100)))
    parser = Parser(Dialect(), backend=backend, chunk_size=16, tasks=tasks)
    got = parser.aggregate(spark, str(tmp_path), list, lambda s, r: s.append(int(r[0])), lambda a, b: a + b, columns=2)
    assert got == list(range(300))
    assert parser.parse(spark, str(tmp_path), list, lambda s, r: s.append(int(r[0])), lambda states: [x for s in states for x in s], columns=2) == got

    def refuse(state, record):
        if int(record[0]) >= 150:
            raise ValueError(f"no {record[0]}")

    with pytest.raises(UserError, match="no 150"):
        parser.aggregate(spark, str(tmp_path), list, refuse, lambda a, b: a, columns=2)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.csv").write_text("")
    assert parser.aggregate(spark, str(tmp_path / "empty"), list, refuse, lambda a, b: a, columns=2) is None


def test_chunks_are_dealt_evenly(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n" * 4000)
    rows, tasks = chunks.chunks(spark, str(tmp_path), 100, 40)
    many = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
    assert tasks == 40 and len(many) >= 38 and max(many) <= 6 and sum(many) == 160


def test_stream_of_one_long_record_takes_linear_time():
    """Bytes are scanned again only when they have doubled."""
    data = b'"' + b"x,\n" * 2_000_000 + b'",y\n'

    class Counted(io.BytesIO):
        reads = 0

        def read(self, n=-1):
            self.reads += 1
            return super().read(n)

    stream = Counted(data)
    got = Parser(Dialect(header=False)).parse_stream(stream, list, lambda s, r: s.append(len(r[0])), lambda s: s[0], columns=2, block=1 << 10)
    assert got == [6_000_000] and stream.reads < 30


def test_byte_order_marks_of_many_files(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i:02}.txt").write_bytes((b"\xef\xbb\xbf" if i == 33 else b"") + b"a|b\n")
    assert native.has_bom(spark, str(tmp_path))
    assert sorted(r[0] for r in native.read_native(spark, str(tmp_path), Dialect(delimiter="|", quote=None, header=False), 2).collect()) == ["a"] * 39 + ["﻿a"]


def test_stream_equals_slice_in_text_mode():
    rnd = random.Random(8)
    for _ in range(400):
        data = b"".join(rnd.choice([b"a", b",", b'"', b"\n", b"#", "é".encode(), b"\xff", b"\xc3"]) for _ in range(rnd.randint(0, 20)))
        d = Dialect(header=rnd.random() < 0.3, record_mode="flexible", comment=rnd.choice([None, "#"]))

        def run(f):
            seen = []
            try:
                f(lambda s, r: seen.append(r))
            except CsvError as e:
                return seen, str(e)
            return seen, None

        a = run(lambda acc: Parser(d).parse_slice(data, list, acc, len))
        b = run(lambda acc: Parser(d).parse_stream(io.BytesIO(data), list, acc, len, block=rnd.randint(1, 6)))
        assert a == b, (data, d)


def test_native_plan_checks_lines_that_nobody_reads(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"1|2\n3\n4|5\n")
    with pytest.raises(Exception, match="expected 2 fields, found 1 in a line"):
        native.read_native(spark, str(tmp_path), Dialect(delimiter="|", quote=None, header=False), 2).count()
