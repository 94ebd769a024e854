"""One query per operator of this subpackage, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csvloom.llm import byte_bpe, embedding_dedup, exact_dedup, mixing, ngram_join, pii_surrogates, quality_zstd, sharding, substring_dedup, warc_archive
from csvloom.llm.common import stage

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARDS = 24
#: Key of the surrogates; production passes its own secret to the operator.
PII_KEY = "surrogates of the registered query"
#: Documents of this score or more count as good.
KEEP_SCORE = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_archive.read_archive(warc_archive.write_archive(table(spark, sf_dir, "pages")))
    return records.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace_entities(table(spark, sf_dir, "documents"), PII_KEY)


def op4_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_zstd.score(docs, quality_zstd.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", quality_zstd.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )
    return exact_dedup.exact_dedup(docs, carry=["text_sha256"], hash_col="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mix, all passes, is written in training order; the rows tell of each document's first pass."""
    mix = stage(mixing.curriculum_mix(table(spark, sf_dir, "documents"), WEIGHTS), "mix")
    ordered = stage(mixing.in_training_order(mix), "mix-ordered")
    return ordered.where("pass = 0").unionByName(mix.where("taken = 0")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("position").alias("first_position")
    )


#: CRC-32 of the sixteen half bytes.
_HALF = "([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_warc_archive, op3_pii_surrogates, op4_quality_zstd, op5_exact_dedup, op6_byte_shards, op7_embedding_dedup, op8_byte_bpe, op9_ngram_join, op10_curriculum_mix)
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d""",
    # half bytes, the low one of each byte first
    "op6_byte_shards": f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, flatten(list_transform(regexp_extract_all(coalesce(hex(encode(text)), ''), '..'),
             lambda x: [strpos('0123456789ABCDEF', x[2]) - 1, strpos('0123456789ABCDEF', x[1]) - 1])) AS half FROM documents),
crc AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, half), lambda c, b: xor(c // 16, {_HALF}[xor(c, b) % 16 + 1])), 4294967295) AS text_crc32 FROM d),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS e, sum(size) OVER () AS total FROM crc),
s AS (SELECT *, least(23, ((2 * e - size) * 24) // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM s""",
}
# base32 of SHA-1: five bits at a time
ORACLE_SQL["op2_warc_archive"] = """
WITH d AS (
  SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
        4 * strpos('0123456789abcdef', h[i + 1]) - 3, 4)), 'string_agg', '') AS bits FROM d),
e AS (SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT, 1)), 'string_agg', '') AS payload_digest,
        max(page_id) OVER (PARTITION BY h) AS keep FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM e"""

ORACLE_SQL["op9_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(len(ws) - 3), lambda i: array_to_string(ws[i + 1 : i + 4], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 85 * (na.c + nb.c - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS component_id FROM r GROUP BY 1) m ON m.a = d.doc_id"""

ORACLE_SQL["op1_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 50], ' ') AS win FROM (
  SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
m AS (SELECT win, min(doc_id) AS least FROM g GROUP BY 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM g JOIN m USING (win) WHERE least < doc_id),
k AS (SELECT doc_id, p, ws[p + 1] AS word FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS p FROM w)),
t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.pos = k.p
      WHERE r.pos IS NULL GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(t.n, 0))::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id)"""
ORACLE_SQL["op7_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""
