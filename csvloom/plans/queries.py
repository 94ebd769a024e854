"""One query per operator of the scan: test tables are rendered as CSV, scanned back and aggregated; SQL states the same over the tables."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from csvloom.dialect import EXACT, FLEXIBLE, VARIADIC, VECTOR, Dialect
from csvloom.functions.columns import as_unsigned, explode_records
from csvloom.functions.machine import IN_QUOTED, RECORD_START, checked, range_function
from csvloom.errors import CsvError
from csvloom.operators import aggregates, reports
from csvloom.parser import Parser
from csvloom.plans import chunks, native
from csvloom.sources import datasource

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PIPE = Dialect(delimiter="|", terminator="LF", quote=None, header=False)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one, where rendered inputs go."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        held = tempfile.gettempdir()
    return f"{held}/csvloom/{uuid.uuid4().hex}".removeprefix("file://")


def rendered(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str], sep: str = "|", header: bool = True) -> str:
    """A table's columns as plain text files without quotes; every file has a header line if asked for."""
    path = scratch(spark)
    rows = table(spark, sf_dir, name).select(*(F.col(c).cast("string") for c in columns))
    reports.write_csv(rows, path, sep, header)
    return path


def quoted(*cols: Column, sep: str = ",", quote: str = '"', escape: str = '"') -> Column:
    """One record with every field quoted."""
    fields = []
    for c in cols:
        text = F.coalesce(c.cast("string"), F.lit(""))
        if escape != quote:
            text = F.replace(text, F.lit(escape), F.lit(escape * 2))
        fields.append(F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(escape + quote)), F.lit(quote)))
    return F.concat_ws(sep, *fields)


#: Fields of the rendered ``documents``: the last is 1 where the text is not null, which CSV cannot tell from an empty one.
DOCUMENTS = ("id", "text", "there")


def documents_file(spark: SparkSession, sf_dir: str) -> str:
    """``documents`` as quoted CSV lines with embedded line feeds, in several files of one header each."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNotNull().cast("int").alias("there"))
    # the writer trims fields unless told not to
    rows.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def ragged_file(spark: SparkSession, sf_dir: str) -> str:
    """``events`` as a line per user: its id, then its readings."""
    path = scratch(spark)
    ragged(spark, sf_dir).write.text(path)
    return path


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.col("value").cast("string")).alias("v"))
    return rows.select(F.concat_ws(",", F.col("user_id").cast("string"), F.array_join("v", ",")).alias("value"))


LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rendered(spark, sf_dir, "lineitem", LINEITEM, header=False)
    return native.read_native(spark, path, PIPE, len(LINEITEM))


@query("SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, count(*) AS n FROM lineitem GROUP BY 1")
def native_sum_by_flag(spark, sf_dir):
    """The flagship: quote-free lines split in the JVM, then an ordinary aggregate."""
    return lineitem(spark, sf_dir).groupBy(F.col("_c8").alias("l_returnflag")).agg(F.sum(F.col("_c4").cast("double")).cast("bigint").alias("sum_qty"), F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM lineitem")
def scan_arity_count(spark, sf_dir):
    path = rendered(spark, sf_dir, "lineitem", LINEITEM)
    return aggregates.record_count(chunks.scan(spark, path, PIPE.with_(header=True), len(LINEITEM)))


@query("SELECT CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem")
def scan_project_sum(spark, sf_dir):
    """Of all columns only the one that is summed leaves the scan."""
    path = rendered(spark, sf_dir, "lineitem", LINEITEM)
    rows = chunks.scan(spark, path, PIPE.with_(header=True), len(LINEITEM), fields=[LINEITEM.index("l_quantity")])
    return rows.agg(F.sum(F.col("_c4").cast("double")).cast("bigint").alias("total"))


@query("SELECT CAST(sum(p_size) AS BIGINT) AS total FROM part")
def scan_unsigned_sum(spark, sf_dir):
    path = rendered(spark, sf_dir, "part", ("p_partkey", "p_size"))
    return chunks.scan(spark, path, PIPE.with_(header=True), 2).agg(F.sum(as_unsigned(F.col("_c1"))).alias("total"))


@query("SELECT max(p_size) AS largest FROM part")
def scan_bytes_max(spark, sf_dir):
    path = rendered(spark, sf_dir, "part", ("p_partkey", "p_size"))
    rows = chunks.scan(spark, path, PIPE.with_(header=True, field_type="binary"), 2)
    return rows.agg(F.max(F.col("_c1").cast("string").cast("int")).alias("largest"))


@query("SELECT o_orderkey AS value, o_totalprice AS key FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")
def scan_argmax(spark, sf_dir):
    path = rendered(spark, sf_dir, "orders", ("o_orderkey", "o_totalprice"))
    rows = chunks.scan(spark, path, PIPE.with_(header=True), 2)
    order = F.col("_c0").cast("bigint")
    return aggregates.arg_max(rows, order, F.col("_c1").cast("double"), order)


@query("SELECT count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer")
def scan_count_avg(spark, sf_dir):
    path = rendered(spark, sf_dir, "customer", ("c_custkey", "c_acctbal"))
    return chunks.scan(spark, path, PIPE.with_(header=True), 2).agg(F.count("*").alias("n"), F.round(F.avg(F.col("_c1").cast("double")), 4).alias("mean"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS pos, n_name AS value FROM nation")
def scan_collect_ordered(spark, sf_dir):
    """Values of three files, each in several chunks, in order of file and place."""
    path = scratch(spark)
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartitionByRange(3, "n_nationkey").sortWithinPartitions("n_nationkey")
    reports.write_csv(nations, path, ",")
    rows = aggregates.in_file_order(chunks.scan(spark, path, Dialect(), 2, chunk_size=64, offsets=True), "_c1")
    return aggregates.numbered(rows, ["path", "offset"], scratch(spark)).select("pos", "value")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def scan_columnar(spark, sf_dir):
    path = rendered(spark, sf_dir, "supplier", ("s_suppkey", "s_name", "s_nationkey"))
    return chunks.scan(spark, path, PIPE.with_(header=True), 3).select(F.col("_c0").cast("bigint").alias("s_suppkey"), F.col("_c1").alias("s_name"), F.col("_c2").cast("int").alias("s_nationkey"))


@query("SELECT user_id, max(value) AS largest FROM events GROUP BY 1")
def scan_ragged_max(spark, sf_dir):
    found = chunks.scan(spark, ragged_file(spark, sf_dir), Dialect(header=False, record_mode=FLEXIBLE, quote=None))
    good = (F.size("fields") >= 2) & (F.col("fields")[0] != "")
    return aggregates.validated(found, good, "a reading is missing").select(F.col("fields")[0].cast("bigint").alias("user_id"), aggregates.ragged_max(F.col("fields")).alias("largest"))


@query("SELECT doc_id, text FROM documents")
def scan_embedded_newlines(spark, sf_dir):
    """Quoted fields with line feeds, scanned in small chunks from composed start states."""
    rows = chunks.scan(spark, documents_file(spark, sf_dir), Dialect(terminator="LF"), len(DOCUMENTS), chunk_size=1 << 16)
    return rows.select(F.when(F.col("_c0") != "", F.col("_c0").cast("bigint")).alias("doc_id"), F.when(F.col("_c2") == "1", F.col("_c1")).alias("text"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def source_format(spark, sf_dir):
    datasource.register(spark)
    path = rendered(spark, sf_dir, "lineitem", ("l_returnflag", "l_linestatus"))
    rows = spark.read.format("dialect_csv").options(sep="|", terminator="LF", quote="", columns="2", header="true", chunkSize="65536").load(path)
    return rows.groupBy(F.col("_c0").alias("l_returnflag"), F.col("_c1").alias("l_linestatus")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def stream_single_partition(spark, sf_dir):
    datasource.register(spark)
    path = rendered(spark, sf_dir, "customer", ("c_custkey", "c_mktsegment"), ",")
    rows = spark.read.format("dialect_csv").options(columns="2", splittable="false").load(path)
    return rows.groupBy(F.col("_c1").alias("c_mktsegment")).agg(F.count("*").alias("n"))


def _slice(name: str, source: str, key: Sequence[str], text: str, d: Dialect, sep: str = ",", quote: str = '"', escape: str = '"') -> None:
    cols = ", ".join([*key, text])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        csv = rows.select(*key, F.concat(F.lit("h\n") if d.header else F.lit(""), quoted(F.lit("k"), F.col(text), sep=sep, quote=quote, escape=escape), F.lit("\n")).alias("csv"))
        return explode_records(csv, "csv", d, 2).select(*key, F.col("_c1").alias(text))

    run.__name__ = name
    query(f"SELECT {cols} FROM {source}")(run)


_slice("slice_toggle_roundtrip", "documents", ["doc_id"], "text", Dialect(terminator="LF"))
_slice("slice_literal_roundtrip", "conversations", ["conv_id", "turn"], "text", Dialect(quote_handling="literal"))
_slice("slice_strict_roundtrip", "conversations", ["conv_id", "turn"], "text", Dialect(quote_handling="strict"))
_slice("slice_backslash_escape", "pages", ["page_id"], "html", Dialect(escape="\\"), escape="\\")
_slice("slice_at_quote", "documents", ["doc_id"], "text", Dialect(delimiter=";", quote="@", escape="@", terminator="LF", header=False), sep=";", quote="@", escape="@")


def _nation(name: str, d: Dialect, make: Callable[[], Column], trim: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        csv = table(spark, sf_dir, "nation").select(make().alias("csv"))
        return explode_records(csv, "csv", d, 2).select(F.col("_c0").cast("int").alias("n_nationkey"), F.col("_c1").alias("n_name"))

    run.__name__ = name
    query("SELECT n_nationkey, n_name FROM nation")(run)


def _line(sep: str = ",", end: str = "\n", head: str = "") -> Callable[[], Column]:
    return lambda: F.concat(F.lit(head), F.concat_ws(sep, F.col("n_nationkey").cast("string"), "n_name"), F.lit(end))


_nation("slice_semicolon", Dialect(delimiter=";"), _line(";", head="a;b\n"))
_nation("slice_tab", Dialect(delimiter="\t", terminator="LF", quote=None), _line("\t", head="a\tb\n"))
_nation("slice_crlf", Dialect(), _line(end="\r\n", head="a,b\r\n"))
_nation("slice_cr", Dialect(terminator="CR", quote=None), _line(end="\r", head="a,b\r"))
_nation("slice_custom_terminator", Dialect(terminator=";"), _line(end=";", head="a,b;"))
_nation("slice_comments", Dialect(comment="#"), _line(head='# "x\na,b\n#y\n'))
_nation("slice_blank_lines", Dialect(quote=None), _line(end="\n\n\r\n", head="\n\na,b\n\n"))
_nation("slice_trim", Dialect(trim=True, header=False), lambda: F.concat(F.lit(" \t"), F.col("n_nationkey").cast("string"), F.lit(' ," '), "n_name", F.lit('\t" \n')))
_nation("slice_no_header", Dialect(header=False), _line())
_nation("slice_no_final_newline", Dialect(header=False), _line(end=""))
_nation("slice_no_quote", Dialect(header=False, quote=None), _line())


@query("SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS qty, count(*) AS n FROM lineitem GROUP BY 1")
def fused_udaf_groupby(spark, sf_dir):
    """A map-valued state folded per chunk and merged in file order."""
    path = rendered(spark, sf_dir, "lineitem", ("l_returnflag", "l_quantity"))

    def acc(state, record):
        qty, n = state.get(record[0], (0.0, 0))
        state[record[0]] = (qty + float(record[1]), n + 1)

    def merge(states):
        out = {}
        for s in states:
            for k, (qty, n) in s.items():
                a, b = out.get(k, (0.0, 0))
                out[k] = (a + qty, b + n)
        return sorted((k, int(qty), n) for k, (qty, n) in out.items())

    parser = Parser(PIPE.with_(header=True), chunk_size=1 << 18)
    return spark.createDataFrame(parser.parse(spark, path, dict, acc, merge, columns=2), "l_returnflag string, qty long, n long")


@query("SELECT count(*) AS n, true AS equal FROM documents")
def row_digest_invariant(spark, sf_dir):
    """Two dialects of one table give equal digests."""
    rows = table(spark, sf_dir, "documents")
    a = explode_records(rows.select(F.concat(quoted(F.col("doc_id"), F.col("text")), F.lit("\n")).alias("csv")), "csv", Dialect(header=False, terminator="LF"), 2)
    b = explode_records(rows.select(F.concat(quoted(F.col("doc_id"), F.col("text"), sep=";", quote="'", escape="\\"), F.lit("\r")).alias("csv")), "csv", Dialect(delimiter=";", quote="'", escape="\\", header=False, terminator="CR"), 2)
    return aggregates.compare_digests(a.drop("pos"), b.drop("pos"))


@query("SELECT s AS chunk_size, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents, (VALUES (16384), (65536), (1048576)) v(s) GROUP BY 1")
def chunk_size_invariance(spark, sf_dir):
    path = documents_file(spark, sf_dir)
    out = None
    for size in (1 << 14, 1 << 16, 1 << 20):
        rows = chunks.scan(spark, path, Dialect(terminator="LF"), len(DOCUMENTS), chunk_size=size, backend=EXACT)
        chars = F.sum(F.when(F.col("_c2") == "1", F.length("_c1")))
        one = rows.agg(F.count("*").alias("n"), chars.alias("chars")).where("n > 0").select(F.lit(size).alias("chunk_size"), "n", "chars")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT doc_id, CAST(sum(length(text) - length(replace(text, '"', ''))) OVER (ORDER BY doc_id) % 2 AS INT) AS parity FROM documents""")
def state_prefix_parity(spark, sf_dir):
    """State functions of document texts, composed in order, give the running quote parity of toggle quoting."""
    d = Dialect(header=False, record_mode=FLEXIBLE)

    def parity(batches):
        for b in batches:
            odd = [int(range_function(t.as_buffer().to_pybytes(), d)[RECORD_START] % 8 == IN_QUOTED) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(odd, pa.int64())], ["doc_id", "p"])

    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(parity, "doc_id long, p long")
    return aggregates.running(rows, ["doc_id"], F.col("p"), scratch(spark), "r").select("doc_id", (F.col("r") % 2).cast("int").alias("parity"))


ERRORS = [
    ("arity_few", b"1,2\n3\n", {"header": False}, "expected 2 fields, found 1 in the record at byte 4"),
    ("arity_many", b"1,2\n3,4,5\n", {"header": False}, "expected 2 fields, found 3 in the record at byte 4"),
    ("arity_quoted_empty", b'1,2\n""\n', {"header": False}, "expected 2 fields, found 1 in the record at byte 4"),
    ("unclosed", b'a,b\n"unclosed\n', {"header": False}, "unterminated quoted field at byte 4"),
    ("unclosed_field", b'a,b\nfoo,"bar\n', {"header": False}, "unterminated quoted field at byte 8"),
    ("strict_quote", b'a"b,c\n', {"header": False, "quote_handling": "strict"}, "quote not at field boundary at byte 1"),
    ("strict_after", b'"a"b,c\n', {"header": False, "quote_handling": "strict"}, "quote not at field boundary at byte 3"),
    ("utf8", b"hello,\xffworld\n", {"header": False}, "invalid UTF-8 at byte 6"),
    ("utf8_last", b"a,b\xff\n", {"header": False}, "invalid UTF-8 at byte 3"),
    ("utf8_quoted", b'"a","b""\xff"\n', {"header": False}, "invalid UTF-8 at byte 8"),
    ("utf8_cut", b"a,b\nc,\xc3", {"header": False}, "invalid UTF-8 at byte 6"),
    ("utf8_comment", b"a,b\n#\xff\nc\n", {"header": False, "comment": "#"}, "invalid UTF-8 at byte 5"),
    ("utf8_before_arity", b"a,\xff\nc\n", {"header": False}, "invalid UTF-8 at byte 2"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{m}')" for n, _, _, m in ERRORS) + ") v(name, message)")
def error_messages(spark, sf_dir):
    """What malformed inputs raise, from inputs held in a column."""
    rows = spark.createDataFrame([(n, data) for n, data, _, _ in ERRORS], "name string, data binary")
    settings = {n: s for n, _, s, _ in ERRORS}
    return rows.mapInArrow(lambda batches: messages(batches, lambda name: Dialect(**settings[name])), "name string, message string")


def messages(batches, dialect):
    """What each input (name, data) raises under its dialect; null if nothing."""
    for b in batches:
        out = []
        for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                list(checked(data, dialect(name), 2))
                out.append(None)
            except CsvError as e:
                out.append(str(e))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["name", "message"])


@query("""SELECT doc_id, kind, CASE kind WHEN 'few' THEN 'expected 2 fields, found 1 in the record at byte ' || n
WHEN 'open' THEN 'unterminated quoted field at byte ' || n WHEN 'utf8' THEN 'invalid UTF-8 at byte ' || (n + 3)
WHEN 'quote' THEN 'quote not at field boundary at byte ' || (n + 1) END AS message
FROM (SELECT doc_id, strlen(replace(coalesce(text, ''), '"', '""')) + 6 AS n FROM documents), (VALUES ('few'), ('open'), ('utf8'), ('quote')) v(kind)""")
def error_offsets(spark, sf_dir):
    """A good record of each document's text, then a malformed one: the byte that the error names."""
    good = F.concat(F.lit("a,"), quoted(F.col("text")), F.lit("\r\n")).cast("binary")
    bad = F.create_map(F.lit("few"), F.lit(b"b\n"), F.lit("open"), F.lit(b'"b,c\n'), F.lit("utf8"), F.lit(b"b,c\xff\n"), F.lit("quote"), F.lit(b'b"c,d\n'))
    rows = table(spark, sf_dir, "documents").select("doc_id", good.alias("good"), F.explode(bad).alias("kind", "bad"))
    named = rows.select(F.concat_ws(":", "doc_id", "kind").alias("name"), F.concat("good", "bad").alias("data"))
    strict = Dialect(header=False, quote_handling="strict")
    found = named.mapInArrow(lambda batches: messages(batches, lambda _: strict), "name string, message string")
    return found.select(F.substring_index("name", ":", 1).cast("bigint").alias("doc_id"), F.substring_index("name", ":", -1).alias("kind"), "message")


CONFIGS = [
    ("same_byte", {"delimiter": '"'}, "quote and delimiter are the same byte"),
    ("escape_alone", {"quote": None, "escape": "\\"}, "escape requires quote"),
    ("two_bytes", {"delimiter": "ab"}, "delimiter must be a single byte"),
    ("not_ascii", {"delimiter": 200}, "delimiter must be ASCII in text mode"),
    ("no_delimiter", {"delimiter": ""}, "delimiter and terminator are needed"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', 'invalid parser configuration: {m}')" for n, _, m in CONFIGS) + ") v(name, message)")
def config_errors(spark, sf_dir):
    """What settings that contradict each other raise."""
    out = []
    for name, settings, _ in CONFIGS:
        try:
            Dialect(**settings)
        except CsvError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "name string, message string")


@query("SELECT 'no ' || max(s_suppkey) || ' please' AS message, 0 AS states, 1 AS stream_states FROM supplier")
def user_errors_and_empty_inputs(spark, sf_dir):
    """What an accumulator raises passes on; merge gets no state of an empty file and one of an empty stream."""
    suppliers = table(spark, sf_dir, "supplier")
    last = suppliers.agg(F.max("s_suppkey")).first()[0]

    def refuse(state, record):
        if record[0] == str(last):
            raise ValueError(f"no {record[0]} please")

    path = rendered(spark, sf_dir, "supplier", ("s_suppkey", "s_name"))
    try:
        Parser(PIPE.with_(header=True), chunk_size=1 << 12).parse(spark, path, list, refuse, len, columns=2)
        message = None
    except CsvError as e:
        message = str(e)
    nothing = scratch(spark)
    suppliers.where("1 = 0").select(F.col("s_name").alias("value")).coalesce(1).write.text(nothing)
    parser = Parser(Dialect(header=False))
    empty = parser.parse(spark, nothing, list, refuse, len, columns=2), parser.parse_stream(io.BytesIO(b""), list, refuse, len, columns=2)
    return spark.createDataFrame([(message, *empty)], "message string, states int, stream_states int")


RAGGED = "SELECT user_id, max(value) AS largest, count(*) AS n FROM events GROUP BY 1"


def _ragged_result(fields: Column, rows: DataFrame) -> DataFrame:
    text = F.transform(fields, lambda x: x.cast("string"))
    return rows.select(text[0].cast("bigint").alias("user_id"), aggregates.ragged_max(text).alias("largest"), (F.size(text) - 1).cast("bigint").alias("n"))


def _ragged_query(name: str, kind: str, read: Callable[[SparkSession, str, str], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ragged_result(F.col("fields"), read(spark, sf_dir, kind))

    run.__name__ = name
    query(RAGGED)(run)


def _ragged_slices(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return explode_records(ragged(spark, sf_dir), "value", Dialect(header=False, record_mode=VARIADIC, field_type=kind))


def _ragged_stream(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    datasource.register(spark)
    options = {"recordMode": VARIADIC, "fieldType": kind, "header": "false", "splittable": "false"}
    return spark.read.format("dialect_csv").options(**options).load(ragged_file(spark, sf_dir))


def _ragged_scan(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return chunks.scan(spark, ragged_file(spark, sf_dir), Dialect(header=False, record_mode=VARIADIC, field_type=kind), chunk_size=1 << 16)


_ragged_query("slice_variadic", "string", _ragged_slices)
_ragged_query("slice_variadic_bytes", "binary", _ragged_slices)
_ragged_query("stream_variadic", "string", _ragged_stream)
_ragged_query("stream_variadic_bytes", "binary", _ragged_stream)
_ragged_query("scan_variadic_bytes", "binary", _ragged_scan)


@query("SELECT doc_id, text FROM documents")
def slice_bytes(spark, sf_dir):
    csv = table(spark, sf_dir, "documents").select("doc_id", F.concat(quoted(F.lit("k"), F.col("text")), F.lit("\n")).cast("binary").alias("csv"))
    return explode_records(csv, "csv", Dialect(header=False, terminator="LF", field_type="binary"), 2).select("doc_id", F.col("_c1").cast("string").alias("text"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def stream_bytes(spark, sf_dir):
    datasource.register(spark)
    path = rendered(spark, sf_dir, "customer", ("c_custkey", "c_mktsegment"), ",")
    rows = spark.read.format("dialect_csv").options(columns="2", fields="1", fieldType="binary", splittable="false", maxRecord="1000000").load(path)
    return rows.groupBy(F.col("_c1").cast("string").alias("c_mktsegment")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, strlen(text) AS bytes, 2::BIGINT AS records, 1::BIGINT AS states FROM documents")
def stream_fold(spark, sf_dir):
    """Each document as a stream of two records, folded in blocks of 64 bytes."""
    csv = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("h\n"), quoted(F.col("text")), F.lit("\nlast,x")).cast("binary").alias("csv"))
    parser = Parser(Dialect(terminator="LF", record_mode=VARIADIC))

    def count(state, record):
        state[0] += 1
        state[1] = max(state[1], len(record[0].encode()) if len(record) == 1 else 0)

    def run(batches):
        for b in batches:
            out = [parser.parse_stream(io.BytesIO(x), lambda: [0, 0], count, lambda s: (s[0][1], s[0][0], len(s)), block=64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3))], ["doc_id", "bytes", "records", "states"])

    return csv.mapInArrow(run, "doc_id long, bytes long, records long, states long")


@query("SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS qty, count(*) AS n FROM lineitem GROUP BY 1")
def fused_udaf_tree(spark, sf_dir):
    """As fused_udaf_groupby, with states combined on the executors."""
    path = rendered(spark, sf_dir, "lineitem", ("l_returnflag", "l_quantity"))

    def acc(state, record):
        qty, n = state.get(record[0], (0.0, 0))
        state[record[0]] = (qty + float(record[1]), n + 1)

    def combine(a, b):
        for k, (qty, n) in b.items():
            x, m = a.get(k, (0.0, 0))
            a[k] = (x + qty, m + n)
        return a

    parser = Parser(PIPE.with_(header=True), backend=VECTOR, chunk_size=1 << 16, tasks=200)
    out = parser.aggregate(spark, path, dict, acc, combine, columns=2) or {}
    return spark.createDataFrame([(k, int(qty), n) for k, (qty, n) in out.items()], "l_returnflag string, qty long, n long")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(CAST(l.quality AS VARCHAR), d.source) AS source
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""")
def manifest_overrides_join(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", "source")
    return reports.overlay(base, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("source")), "doc_id")


@query("""SELECT doc_id, 'missing' AS gap FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'unlisted' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def manifest_gap_antijoin(spark, sf_dir):
    return reports.manifest_gaps(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("""SELECT doc_id, CASE WHEN n_chars <= 1000 THEN 'tier' ELSE 'other' END AS gap FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def manifest_tier_gaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return reports.tier_gaps(docs, reports.tier(docs, "n_chars", 1000, "doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT source, round(exp(avg(ln(n_chars / (doc_id + 1) * 1000))), 6) AS geomean, round(sum(n_chars) / sum(doc_id + 1) * 1000, 6) AS total, count(*) AS n FROM documents GROUP BY 1")
def bench_geomean(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("ns", F.col("doc_id") + 1)
    return reports.throughput(rows, "n_chars", "ns", ["source"]).withColumns({"geomean": F.round("geomean", 6), "total": F.round("total", 6)})


@query("""SELECT event_type, count(*) FILTER (value / (event_id % 97 + 1) > 1.05) AS wins,
count(*) FILTER (value / (event_id % 97 + 1) <= 1.05 AND value / (event_id % 97 + 1) >= 0.95) AS ties,
count(*) FILTER (value / (event_id % 97 + 1) < 0.95) AS losses FROM events GROUP BY 1""")
def bench_win_tie_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("theirs", F.col("event_id") % 97 + 1)
    return reports.win_tie_loss(rows, "value", "theirs", ["event_type"])


@query("""SELECT n.p_partkey, n.p_size AS "new", o.p_size AS old, n.p_size - o.p_size AS delta, round((n.p_size - o.p_size) * 100.0 / o.p_size, 6)::DOUBLE AS percent
FROM part n LEFT JOIN part o ON o.p_partkey = n.p_partkey + 1""")
def bench_snapshot_delta(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return reports.snapshot_delta(part, part.withColumn("p_partkey", F.col("p_partkey") - 1), ["p_partkey"], "p_size").withColumn("percent", F.round("percent", 6))


@query("""SELECT event_id, user_id, row_number() OVER (ORDER BY CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts END, ts, event_id) AS pos FROM events""")
def bench_history(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("committed", F.when(F.col("event_id") % 2 == 0, F.col("ts") - F.expr("INTERVAL 1 HOUR")))
    return reports.history(rows, "committed", "ts", "event_id", scratch(spark)).select("event_id", "user_id", "pos")


@query("""SELECT o_orderpriority, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def scan_then_join(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select(F.col("_c0").cast("bigint").alias("o_orderkey"), F.col("_c4").cast("double").alias("q"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return rows.join(orders, "o_orderkey").groupBy("o_orderpriority").agg(F.sum("q").cast("bigint").alias("qty"))


@query("""SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS INT) AS place FROM lineitem""")
def scan_then_window(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select(F.col("_c0").cast("bigint").alias("l_orderkey"), F.col("_c3").cast("int").alias("l_linenumber"), F.col("_c4").cast("double").alias("q"))
    return rows.select("l_orderkey", "l_linenumber", F.rank().over(Window.partitionBy("l_orderkey").orderBy(F.desc("q"))).alias("place"))


@query("SELECT * FROM (VALUES ('|', 3)) v(delimiter, columns)")
def sniffed_dialect(spark, sf_dir):
    found = reports.sniff(rendered(spark, sf_dir, "supplier", ("s_suppkey", "s_name", "s_nationkey")), spark)
    return spark.createDataFrame([(found.get("delimiter", ","), found["columns"])], "delimiter string, columns int")
