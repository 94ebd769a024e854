"""Queries against their SQL on rows that the test tables do not have."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from csvloom.dialect import Dialect
from csvloom.operators import reports
from csvloom.plans import chunks, queries

TEXTS = [None, "", "plain", "  a b", "a b \n", "a\r", "\r\nb\r\n", "\x01a\x1f", "\n\n", " ", 'a\0"', '"', '""\n,', "x" * 200_000 + " "]


def same(spark, folder, name, ids, texts, sources=None, sizes=None):
    """Does the query on such ``documents`` equal its SQL?"""
    n = len(ids)
    columns = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "source": pa.array(sources or ["s"] * n, pa.string()), "n_chars": pa.array(sizes or [1] * n, pa.int64())}
    pq.write_table(pa.table(columns), folder / "documents.parquet")
    with duckdb.connect() as con:
        con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
        want = con.sql(queries.ORACLE_SQL[name])
        got = [tuple(r) for r in queries.QUERIES[name](spark, str(folder)).select(*want.columns).collect()]
        assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)


def test_texts_come_back_whole(spark, tmp_path):
    same(spark, tmp_path, "scan_embedded_newlines", [None, *range(1, len(TEXTS))], TEXTS)


def test_rates_of_zero_and_beyond_a_long(spark, tmp_path):
    rows = [("zero", 1, 0), ("zero", 2, 5), ("null", 3, None), ("null", 4, 7), ("none", 5, None), (None, 6, 2), ("large", 2**62, 9), ("large", 2**62, 2**62), ("large", 0, 2**62), ("instant", -1, 3), ("instant", 7, 3)]
    sources, ids, sizes = map(list, zip(*rows))
    same(spark, tmp_path, "bench_geomean", ids, ["x"] * len(rows), sources, sizes)


def test_negative_rates_have_no_mean(spark):
    rows = spark.createDataFrame([(-5, 2), (3, 2)], "size long, ns long").withColumn("k", F.lit(1))
    found = reports.throughput(rows, "size", "ns", ["k"]).first()
    assert math.isnan(found["geomean"]) and (found["total"], found["n"]) == (-500.0, 2)
    real = reports.throughput(rows.select("k", (F.col("size") + 5.5).alias("size"), "ns"), "size", "ns", ["k"]).first()
    assert round(real["total"], 6) == 2250.0


def test_chunk_sizes_agree_on_odd_texts(spark, tmp_path):
    for texts in (TEXTS, [None, None], []):
        same(spark, tmp_path, "chunk_size_invariance", list(range(len(texts))), texts)


def test_tasks_follow_bytes_and_cores_not_chunks(spark, tmp_path):
    data = "a,b\n" + '"x\n",y\n' * 20_000
    (tmp_path / "a.csv").write_text(data)
    rows, tasks = chunks.chunks(spark, str(tmp_path), 64)
    cores = spark.sparkContext.defaultParallelism
    assert tasks == chunks.TASKS_A_CORE * cores and rows.count() == -(-len(data) // 64)
    found = chunks.scan(spark, str(tmp_path), Dialect(), 2, chunk_size=64)
    assert found.where("_c0 = 'x\\n' and _c1 = 'y'").count() == 20_000


def test_batches_of_small_chunks_are_joined():
    small = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(25_000)]
    joined = list(chunks.gathered(iter(small)))
    assert [b.num_rows for b in joined] == [10_000, 10_000, 5_000] and [x for b in joined for x in b.column(0).to_pylist()] == list(range(25_000))
    assert list(chunks.gathered(iter([]))) == []
