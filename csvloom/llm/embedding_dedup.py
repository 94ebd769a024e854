"""Near duplicates among embeddings: random-hyperplane signs in several tables, exact cosine, components.

1. Equal vectors are one from the start.  The signs of a vector against the hyperplanes of a table are its key
   there; bits per table grow with the logarithm of the number of vectors, so buckets keep their size, and the
   number of tables follows from the wanted recall at the threshold: a pair at angle a shares one sign with
   probability 1 - a / pi.
2. Only ids travel to the buckets, each with a signature of 128 more signs.  A vector goes on if some other in
   its bucket differs in no more signs than all but ``MISSED`` of the pairs at the threshold do; a pair of unrelated vectors
   does so once in millions.
3. The vectors of those travel to their buckets, where they are compared by cosine in double precision.  Work per
   bucket is a matrix product.  No pair is written out: a bucket yields, for each vector that has a link there, how
   many, and the smallest vector of its component.  A pair that meets in several tables counts in the first of them.

Buckets larger than ``block`` vectors (counted beforehand) are cut into blocks, and each pair of blocks is a
task of its own, so that no bucket has to fit in one.  Recall is ``recall`` at the very threshold and more above it.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link with
nothing and are kept.  Vectors of different lengths link with nothing; of any length and magnitude they are scaled before
they are squared.  Rows that repeat an id are links of one another if their
vectors are equal.  An empty table gives an empty result.  Other columns do not matter.  Ids are longs; a null id is
larger than all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csvloom.llm.common import partitions, release, stage
from csvloom.llm.components import connected_components
from csvloom.llm.textops import mix

#: Vectors of a bucket compared in one task.
BLOCK = 1024
#: Wanted probability that a pair at the very threshold is found.
RECALL = 0.999
#: Part of the pairs at the threshold whose signatures may differ too much.
MISSED = 1e-4
#: Vectors that a bucket should hold on average.
BUCKET = 48
#: Signs of the signature: two 64-bit integers.
SIGNS = 128
SEED = 20240101


def plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits per table and number of tables for n vectors."""
    bits = min(30, max(4, round(math.log2(max(n, 1) / BUCKET + 1))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    missed = 1 - recall / (1 - MISSED) if recall < 1 - MISSED else (1 - recall) / 2
    return bits, max(1, math.ceil(math.log(missed) / math.log(1 - meet)))


def most_signs(threshold: float, missed: float = MISSED) -> int:
    """In how many signs of the signature a pair at the threshold differs at most, but for a part of ``missed``."""
    p = math.acos(threshold) / math.pi
    left = 1.0
    for k in range(SIGNS + 1):
        left -= math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)
        if left <= missed:
            return k
    return SIGNS


def sign_codes(x: np.ndarray, bits: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row of x in each table, and its signature; the hyperplanes depend on seed and dimension only."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits + SIGNS))
    signs = x @ planes > 0
    codes = signs[:, : tables * bits].reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return codes, np.packbits(signs[:, tables * bits :], axis=1).view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many signs signatures differ, along the last axis."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1)


def link_block(
    x: np.ndarray, codes: np.ndarray, signature: np.ndarray, table: int, size: np.ndarray, cut: int | None, threshold: float, most: int
) -> tuple[np.ndarray, np.ndarray]:
    """New links of each vector and the first vector of its component.

    Without ``cut`` all pairs are looked at, else those between the rows before it and the others.
    """
    n = len(x)
    at = n if cut is None else cut
    i, j = np.nonzero(x[:at] @ (x.T if cut is None else x[cut:].T) >= threshold)
    if cut is not None:
        j = j + cut
    some = differing(signature[i], signature[j]) <= most
    some &= i < j
    i, j = i[some], j[some]
    fresh = np.ones(len(i), dtype=bool)
    for t in range(table):
        fresh &= codes[i, t] != codes[j, t]
    counts = np.bincount(i[fresh], size[j[fresh]], n) + np.bincount(j[fresh], size[i[fresh]], n)
    # each round takes the least name of a vector's neighbours, then follows names to their own
    first = np.arange(n)
    while len(i):
        before = first.copy()
        np.minimum.at(first, i, before[j])
        np.minimum.at(first, j, before[i])
        first = first[first]
        if (first == before).all():
            break
    return counts.astype(np.int64), first


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id`` (smallest id reachable over links)."""
    spark = vectors.sparkSession
    last = F.lit((1 << 63) - 1)  # stands for a null id
    v = F.col("v")
    good = (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = stage(
        vectors.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.col(vector_col).alias("v"))
        .withColumn("ok", F.coalesce(good, F.lit(False)))
        # 0.0 also for -0.0, so that equal vectors are equal as values
        .select("id", F.when(F.col("ok"), F.transform("v", lambda e: F.when(e == 0, F.lit(0)).otherwise(e))).alias("v")),
        "vectors",
    )
    distinct = stage(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "vectors-distinct")
    bits, tables = plan(distinct.count(), threshold, recall)
    most = most_signs(threshold, min(MISSED, (1 - recall) / 2))
    wide = distinct.schema["v"].dataType.elementType.simpleString() != "float"
    kind = np.float64 if wide else np.float32

    def keys(codes: np.ndarray, dimension: int) -> np.ndarray:
        table = np.arange(tables, dtype=np.uint64)[None, :]
        return mix(mix(codes.astype(np.uint64) + (table << np.uint64(32))) + np.uint64(dimension)).astype(np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, rep = b.column(0), b.column(1).to_numpy()
            lengths = column.value_lengths().to_numpy()
            values = column.flatten().to_numpy().astype(np.float64)
            begin = np.concatenate([[0], np.cumsum(lengths)])
            for d in np.unique(lengths):
                where = np.flatnonzero(lengths == d)
                codes, signature = sign_codes(unit(values[begin[where][:, None] + np.arange(d)]), bits, tables, seed)
                table = np.tile(np.arange(tables, dtype=np.int32), len(where))
                each = [np.repeat(y, tables) for y in (rep[where], signature[:, 0], signature[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in (keys(codes, d).ravel(), table, *each)], ["key", "t", "rep", "hi", "lo"])

    signed = stage(distinct.select("v", "rep").mapInArrow(sign, "key long, t int, rep long, hi long, lo long"), "vectors-signed")
    sizes = signed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = stage(sizes.select(F.col("key").alias("__key"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "vectors-large")
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = (
        signed.join(large, F.col("key") == F.col("__key"), "left")
        .select("key", "t", "rep", "hi", "lo", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("key", "t", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "hi", "lo")
    )
    dealt = dealt.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "mine", "rep")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have another of their bucket (of the other block, if there are two) within ``most`` signs."""
        held: list[np.ndarray] = []

        def near(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, t, i, j, own, _, hi, lo = cols
            n = len(key)
            signature = np.stack([hi, lo], axis=1)
            keep = np.zeros(n, dtype=bool)
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            group = np.cumsum(new)
            begins = np.flatnonzero(new)
            many = np.diff(np.append(begins, n))
            # small buckets together, each row with the one so many places on; large ones by themselves
            small = np.repeat(many <= 256, many)
            whole = i == j
            for step in range(1, int(many[many <= 256].max(initial=1))):
                a = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
                a = a[whole[a] | (own[a] != own[a + step])]
                a = a[differing(signature[a], signature[a + step]) <= most]
                keep[a] = True
                keep[a + step] = True
            for at, m in zip(begins[many > 256].tolist(), many[many > 256].tolist()):
                rows = np.arange(at, at + m)
                left, right = (rows, rows) if whole[at] else (rows[own[rows] == i[at]], rows[own[rows] == j[at]])
                for r in range(0, len(left), 256):
                    part = left[r : r + 256]
                    fits = differing(signature[part][:, None, :], signature[right][None, :, :]) <= most
                    if whole[at]:
                        fits &= part[:, None] != right[None, :]
                    keep[part] |= fits.any(axis=1)
                    keep[right] |= fits.any(axis=0)
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols[:6]], ["key", "t", "i", "j", "mine", "rep"])

        for b in batches:
            if not len(b):
                continue
            cols = [b.column(c).to_numpy() for c in range(8)]
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)] if held else cols
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[2] != cols[2][-1]) | (cols[3] != cols[3][-1])).max(initial=-1)) + 1
            held = [c[last:] for c in cols]  # a bucket's blocks are at most about twice ``block`` rows
            if last:
                yield near([c[:last] for c in cols])
        if held:
            yield near(held)

    likely = stage(dealt.mapInArrow(alike, "key long, t int, i int, j int, mine int, rep long"), "vectors-likely")
    sent = likely.join(distinct.select(F.col("rep").alias("__rep"), "size", "v"), F.col("rep") == F.col("__rep")).drop("__rep")
    sent = sent.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "mine", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def finish() -> list[pa.RecordBatch]:
            n = sum(len(h[0]) for h in held)
            if n < 2:
                return []
            mine, rep, size = (np.concatenate([h[k] for h in held]) for k in range(3))
            x = unit(np.concatenate([h[3] for h in held]).reshape(n, -1).astype(np.float64))
            codes, signature = sign_codes(x, bits, tables, seed)
            _, t, i, j = group
            cut = int(np.searchsorted(mine, j)) if i != j else None
            if cut in (0, n):
                return []
            counts, first = link_block(x, codes, signature, t, size, cut, threshold, most)
            # rows are in order of block and id: the smallest id of a component may be in the second block
            root = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(root, first, rep)
            some = np.flatnonzero((counts > 0) | (root[first] != rep))
            return [pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(counts[some]), pa.array(root[first][some])], ["rep", "n", "root"])]

        for b in batches:
            if not len(b):
                continue
            key, t, i, j, mine, rep, size = (b.column(c).to_numpy() for c in range(7))
            column = b.column(7)
            values = column.flatten().to_numpy().astype(kind)
            begin = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            bounds = [0, *new.tolist(), len(key)]
            for lo, hi in zip(bounds, bounds[1:]):
                name = (int(key[lo]), int(t[lo]), int(i[lo]), int(j[lo]))
                if name != group:
                    yield from finish()
                    group, held = name, []
                held.append((mine[lo:hi], rep[lo:hi], size[lo:hi], values[begin[lo] : begin[hi]]))
        yield from finish()

    found = stage(sent.select("key", "t", "i", "j", "mine", "rep", "size", "v").mapInArrow(compare, "rep long, n long, root long"), "vectors-links")
    for table in (signed, large, likely):
        release(table)
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    components = connected_components(found.select("rep", "root"))
    known = (
        distinct.join(links, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    valid = rows.where("v is not null").join(known, "v").select("id", "n_links", "component_id")
    other = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return valid.unionByName(other).select(F.nullif("id", last).alias(id_col), "n_links", F.nullif("component_id", last).alias("component_id"))
