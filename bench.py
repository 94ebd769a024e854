"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

``value`` is the sum of the queries' seconds.  Inputs of the CSV queries are rendered before the clock starts,
$BENCH_COPIES times (default 20: some 550 MB at sf0.1).  ``spark_csv_seconds`` holds the same queries by Spark's own
CSV reader, the quoted one with ``multiLine``.
"""

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from csvloom.dialect import Dialect  # noqa: E402
from csvloom.operators import reports  # noqa: E402
from csvloom.plans import chunks, native  # noqa: E402
from csvloom.plans import queries as scans  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="csvloom-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    n = len(scans.LINEITEM)
    copies = spark.range(int(os.environ.get("BENCH_COPIES", "20"))).select(F.col("id").alias("copy"))
    pipe, quoted = scans.scratch(spark), scans.scratch(spark)
    lines_of = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*(F.col(c).cast("string") for c in scans.LINEITEM))
    reports.write_csv(lines_of.crossJoin(F.broadcast(copies)).drop("copy").repartition(4 * int(cpus)), pipe, "|", header=False)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts.crossJoin(F.broadcast(copies)).drop("copy").repartition(4 * int(cpus)).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(quoted)
    size, quoted_size = (sum(m for _, m in chunks.files.list_files(x)) for x in (pipe, quoted))

    def lines():
        return chunks.scan(spark, pipe, scans.PIPE, n, chunk_size=8 << 20, fields=[4, 8])

    runs = {
        "native_count": lambda: native.read_native(spark, pipe, scans.PIPE, n).agg(F.count("*")).collect(),
        "native_sum_by_flag": lambda: native.read_native(spark, pipe, scans.PIPE, n).groupBy("_c8").agg(F.sum(F.col("_c4").cast("double"))).collect(),
        "vector_count": lambda: lines().agg(F.count("*")).collect(),
        "vector_sum_by_flag": lambda: lines().groupBy("_c8").agg(F.sum(F.col("_c4").cast("double"))).collect(),
        "quoted_count": lambda: chunks.scan(spark, quoted, Dialect(terminator="LF"), 2, fields=[0]).agg(F.count("*")).collect(),
    }
    try:
        from csvloom.llm import queries as llm
    except ImportError:
        pass
    else:
        for name in ("op5_exact_dedup", "op6_byte_shards", "op8_byte_bpe", "op9_ngram_join", "op10_curriculum_mix"):
            runs[name] = lambda q=llm.QUERIES[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, run in runs.items():
        if not name.startswith("op"):
            run()  # warm
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)
    plain = spark.read.csv(pipe, sep="|", quote="", schema=", ".join(f"c{i} string" for i in range(n)))
    multi = spark.read.csv(quoted, schema="c0 string, c1 string", header=True, multiLine=True, escape='"')
    others = {
        "native_count": lambda: plain.agg(*(F.count(c) for c in plain.columns)).collect(),  # of all columns, so that lines are parsed
        "native_sum_by_flag": lambda: plain.groupBy("c8").agg(F.sum(F.col("c4").cast("double"))).collect(),
        "quoted_count": lambda: multi.agg(F.count("c0"), F.count("c1")).collect(),
    }
    spark_csv = {}
    for name, run in others.items():
        run()
        began = time.perf_counter()
        run()
        spark_csv[name] = round(time.perf_counter() - began, 3)
    mb = {k: round((quoted_size if k == "quoted_count" else size) / 1e6 / v, 1) for k, v in seconds.items() if not k.startswith("op")}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "mb_per_s": mb, "spark_csv_seconds": spark_csv}))


if __name__ == "__main__":
    main()
