"""The pipeline stage by stage against brute force, and the registered queries against their SQL."""

import glob
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from csvloom.llm import byte_bpe, mixing, quality_zstd, queries

SF = "/root/testdata/sf0.001"


def canonical(rows):
    return sorted(tuple(repr(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    pick = ", ".join(f'"{c}"' for c in columns)
    assert sorted(con.sql(queries.ORACLE_SQL[name]).columns) == columns
    assert canonical(map(tuple, df.select(*columns).collect())) == canonical(con.sql(f"select {pick} from ({queries.ORACLE_SQL[name]})").fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_quality_of_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    got = queries.op4_quality_zstd(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == k] for k in (1, 0))
    wins = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert wins > 0.95 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.94


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents and labels of its own: copies, near copies, junk, nulls, empty texts, an extra column that clashes."""
    rnd = random.Random(12)
    path = str(tmp_path_factory.mktemp("sf"))
    words = ["river", "mill", "field", "slow", "old", "stone", "bridge", "the", "and", "of"] + [f"n{i}" for i in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(20, 120))) for _ in range(120)]
    texts += texts[:15]
    for t in texts[20:35]:
        w = t.split()
        texts.append(" ".join(w[:-1] + ["changed"]))
    junk = [" | ".join(rnd.choice(["BUY", "now!!", "%%%", "$$$"]) for _ in range(rnd.randint(20, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*texts, *junk, "", None, " "])]
    rnd.shuffle(rows)
    docs = [(i, t, "en", rnd.choice(["a", "a", "a", "b", None]), len(t or ""), 7.0) for i, t in rows]
    spark.createDataFrame([*docs, docs[0]], "doc_id long, text string, lang string, source string, n_chars long, position double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(texts)), 0) for i in range(len(texts) + 60) if i % 5 < 4], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def by_hand(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    rate = quality_zstd.fit(docs, spark.read.parquet(f"{path}/labels.parquet")).scorer()
    out = [[r for r in rows if rate((r[1] or "").encode()) >= queries.KEEP_SCORE]]
    keep = {}
    for r in out[-1]:
        if (r[1] or "") not in keep or keep[r[1] or ""][0] < r[0]:
            keep[r[1] or ""] = r
    out.append(list(keep.values()))
    sets = {}
    for r in out[-1]:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (r[1] or "").encode().split()]
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out.append([r for r in out[-1] if find(r[0]) == r[0]])
    return out


def test_stages(spark, small):
    docs, want = spark.read.parquet(f"{small}/documents.parquet"), by_hand(spark, small)
    for (name, step), expected in zip(corpus_pipeline.STAGES[:3], want):
        docs = corpus_pipeline.stage(step(spark, docs, small), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "position"]
        assert canonical(map(tuple, docs.collect())) == canonical(expected), name
    assert len(want[0]) > len(want[1]) > len(want[2]) > 100

    mixed = corpus_pipeline.stage(corpus_pipeline.mix(spark, docs, small), "mix")
    words = {r[0]: len((r[1] or "").encode().split()) for r in want[2]}
    total = defaultdict(int)
    for r in want[2]:
        total[r[3]] += words[r[0]]
    sizes = spark.createDataFrame([*total.items()], "__src string, __total long")
    target = {r["__src"]: r["__target"] for r in mixing.source_targets(sizes, queries.WEIGHTS, 1.5, 2).collect()}
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    copies = Counter()
    for source in total:
        at = 0
        for r in sorted((r for r in want[2] if r[3] == source), key=lambda r: (hashes[r[0]], r[0])):
            middle = at + words[r[0]] / 2
            copies[r[0]] = sum(middle + k * total[source] < target[source] for k in range(2)) if words[r[0]] else 0
            at += words[r[0]]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies

    with open(queries.RANKS, "rb") as f:
        ranks = byte_bpe.ByteBpe.from_file(f.read(), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r[0]: r[1] or "" for r in want[2]}
    got = corpus_pipeline.tokens(spark, mixed, small).collect()
    assert Counter(r["doc_id"] for r in got) == +copies
    for r in got:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(text[r["doc_id"]]) and r["n_tokens"] * 4 == len(r["ids"])


def test_run(spark, small, tmp_path):
    assert corpus_pipeline.run(spark, small).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small}/{name}.parquet").where("1 = 0").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
