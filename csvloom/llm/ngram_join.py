"""Exact Jaccard self-join of documents on word n-grams, reported as components.

1. One scan makes each document's set (64-bit hashes of its n-grams), a digest of the set, a histogram over
   64 ranges of the hash, and adds every n-gram of every document to a table of counters of fixed size.
2. Counters order n-grams from rare to frequent (equal counts by hash).  A second scan emits the prefix of
   each set in that order: sets of similarity t share an n-gram in their first n - ceil(t n) + 1.
   Documents with equal sets are one node from here on.  Of an n-gram that very many documents may have,
   a task sends one node of each size and links the others of that size to it: what is sent of it does
   not grow with the number of its documents.
3. Nodes meet at each prefix n-gram, sorted by size.  Pairs must pass the length and the positional filter;
   a long list is chained instead (each node to the next within the length filter), which keeps every pair
   that could link in one cluster and grows with the list, not with its square.  Pairs are made distinct
   and pass the suffix filter, a lower bound of the sets' difference from the histograms.
4. What is left are clusters that contain every link.  Each node's text travels to its cluster once, where
   every pair that could link is compared once, on whole sets.  Clusters beyond ``block`` nodes or
   ``BLOCK_GRAMS`` n-grams are cut in blocks and each pair of blocks is a task of its own.  Links give the components.

Nodes are named by a 128-bit BLAKE2 digest of the set.

Texts of any length: a long one is cut into sections for hashing, so that a text takes its own bytes and
eight for each distinct n-gram.

Defined results: words are matched after lower-casing A-Z; a document of fewer than n words has its whole
sequence as only n-gram; without words it has none and links with nothing; a null text has no words.  Rows
that repeat an id and a text are in one component; of rows that repeat an id with other texts each has its
own.  A null id is larger than all others in naming a component.  An empty table gives no rows.  Other
columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csvloom.llm.common import bitmap, bits_for, flag, partitions, stage, text_key
from csvloom.llm.components import connected_components
from csvloom.llm.textops import LOWER, SECTION, Words, chunks, gram_hashes, mix, sections

#: Counters of the frequency table: fixed, 32 bits each while they are summed, 16 bits of a logarithm once they order n-grams.
COUNTER_BITS = 24
#: The table travels in so many parts; those of more tasks than this are summed in groups first.
PARTS, TABLES = 16, 256
CELLS = 64
#: Lists of a prefix n-gram up to this length are paired, longer ones chained.
LIST = 64
#: Nodes, and n-grams of nodes, of each of the two blocks compared in one task.
BLOCK, BLOCK_GRAMS = 512, 4 << 20
#: An n-gram whose counter is this far above the average is combined before it is sent.
FREQUENT = 4096
#: Sets, and n-grams by size, that a task remembers to combine what repeats.
REMEMBER = 1 << 16


def need(a, b, percent: int):
    """Least overlap of sets of sizes a and b whose similarity is ``percent`` or more."""
    return -((-percent * (a + b)) // (100 + percent))


def sets_of(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-gram hashes, sorted."""
    if len(texts) == 1 and texts.nbytes > SECTION and texts[0].is_valid:
        raw = np.frombuffer(texts[0].as_buffer(), dtype=np.uint8)
        parts = [gram_hashes(Words.of(LOWER[part]).hashes(), n) for _, part in sections(raw, n - 1)]
        if any(map(len, parts)):
            yield np.unique(np.concatenate([np.unique(p) for p in parts]))
            return
    words = Words(texts, lower=True)
    h = words.hashes()
    grams = gram_hashes(h, n)
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if end - begin >= n:
            yield np.unique(grams[begin : end - n + 1])
        elif end > begin:
            yield mix(gram_hashes(h[begin:end], end - begin) + np.uint64(end - begin))
        else:
            yield np.zeros(0, dtype=np.uint64)


def digest(tokens: np.ndarray) -> bytes:
    """Digest of a set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def packed(counts: np.ndarray) -> bytes:
    """Compressed: a bit for each counter that is not zero, then those, all bytes of one significance together."""
    some = counts[counts > 0] - counts.dtype.type(1)
    planes = np.ascontiguousarray(some.view(np.uint8).reshape(-1, counts.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(counts > 0).tobytes() + planes.tobytes())


def unpacked(data: bytes, kind: type, n: int = (1 << COUNTER_BITS) // PARTS) -> np.ndarray:
    """The ``n`` counters (a multiple of 8) that :func:`packed` was given."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    out = np.zeros(n, dtype=kind)
    planes = raw[n // 8 :].reshape(np.dtype(kind).itemsize, -1)
    out[np.unpackbits(raw[: n // 8]).astype(bool)] = np.ascontiguousarray(planes.T).view(kind).ravel() + out.dtype.type(1)
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 2,047 steps for each doubling: in their order, apart from differences below 0.04 percent."""
    return np.round(np.log2(counts.astype(np.float64) + 1) * 2047).astype(np.uint16)


def describe(docs: DataFrame, n: int) -> DataFrame:
    """Rows (id, th, node, size, histogram) of all documents, and in rows of their own (part, counts) the counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, dtype=np.uint32)
        some = False
        for b in batches:
            for c in chunks(b, 2):
                node, size, cells, every = [], [], [], []
                for s in sets_of(c.column(2), n):
                    size.append(len(s))
                    node.append(digest(s) if len(s) else None)
                    cells.append(np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes())
                    every.append(s)
                if len(every):
                    slot, many = np.unique(np.concatenate(every) >> np.uint64(64 - COUNTER_BITS), return_counts=True)
                    counts[slot] += many.astype(np.uint32)  # fewer than 2**32 rows a task
                    some = True
                none = [None] * len(size)
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), c.column(1), pa.array(node, pa.binary()), pa.array(size, pa.int32()), pa.array(cells, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], SUMMARY_NAMES
                )
        if some:
            parts = [packed(p) for p in counts.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.binary()), pa.nulls(PARTS, pa.binary()), pa.nulls(PARTS, pa.int32()), pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], SUMMARY_NAMES
            )

    return docs.mapInArrow(run, "id long, th binary, node binary, size int, cells binary, part int, counts binary")


SUMMARY_NAMES = ["id", "th", "node", "size", "cells", "part", "counts"]


def counter_table(summary: DataFrame) -> np.ndarray:
    """The levels of the summed counters of all tasks; 32 MB in all, whatever the corpus."""

    def add(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    more = unpacked(data, np.uint32)
                    sums[part] = np.minimum(sums.get(part, np.uint64(0)) + more.astype(np.uint64), 0xFFFFFFFF)
            out = [packed(levels(x) if last else x.astype(np.uint32)) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(out, pa.binary())], ["part", "counts"])

        return run

    some = summary.where("part is not null").select("part", "counts")
    tables = some.count() // PARTS
    if tables > TABLES:
        groups = math.isqrt(tables)
        some = some.repartition(PARTS * groups, "part", F.pmod(F.xxhash64("counts"), F.lit(groups))).mapInArrow(add(False), "part int, counts binary")
    parts = some.repartition(PARTS, "part").mapInArrow(add(True), "part int, counts binary")
    out = np.zeros((PARTS, (1 << COUNTER_BITS) // PARTS), dtype=np.uint16)
    for r in parts.collect():  # at most PARTS rows
        out[r["part"]] = unpacked(bytes(r["counts"]), np.uint16)
    return out.ravel()


def names_of(nodes: np.ndarray) -> pa.Array:
    """Rows of 16 bytes as binary values."""
    offsets = np.arange(len(nodes) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(nodes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(nodes))])


def nodes_of(names: pa.Array) -> np.ndarray:
    """Binary values of 16 bytes each as rows."""
    return np.frombuffer(b"".join(names.to_pylist()), dtype=np.uint8).reshape(-1, 16)


def prefixes(docs: DataFrame, counters, average: float, n: int, percent: int, frequent: int = FREQUENT) -> DataFrame:
    """Rows (token, node, size, place) of the rarest n-grams of each set; rows with ``other`` are pairs that were made before.

    ``average`` is the mean of the counters.
    """
    limit = int(levels(np.array([frequent + 8 * average]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(counters.value, dtype=np.uint16)
        seen: set[bytes] = set()
        first_of: dict[tuple[int, int], bytes] = {}
        for b in batches:
            for c in chunks(b, 1):
                token, node, size, place, linked = [], [], [], [], []
                for s in sets_of(c.column(1), n):
                    if not len(s) or (name := digest(s)) in seen:
                        continue
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen.add(name)
                    k = len(s) + (-percent * len(s)) // 100 + 1
                    rank = table[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                    order = np.argsort(rank, kind="stable")[:k]  # s is sorted: equal ranks stand by hash
                    first = s[order].astype(np.int64)
                    at = np.arange(k, dtype=np.int32)
                    if rank[order[-1]] >= limit:
                        send = np.ones(k, dtype=bool)
                        others = set()
                        for i in np.flatnonzero(rank[order] >= limit).tolist():
                            if len(first_of) >= REMEMBER:
                                first_of.clear()
                            other = first_of.setdefault((int(first[i]), len(s)), name)
                            if other != name:
                                send[i] = False
                                others.add(other)
                        linked += [(name, other, len(s)) for other in others]
                        first, at = first[send], at[send]
                    token.append(first)
                    node += [name] * len(first)
                    size.append(np.full(len(first), len(s), dtype=np.int32))
                    place.append(at)
                if token:
                    some = [np.concatenate(x) for x in (token, size, place)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([some[0], np.frombuffer(b"".join(x[:8] for x, _, _ in linked), dtype="<i8")])),
                            pa.array(node + [x for x, _, _ in linked], pa.binary()),
                            pa.array(np.concatenate([some[1], np.array([m for _, _, m in linked], dtype=np.int32)])),
                            pa.array(np.concatenate([some[2], np.zeros(len(linked), dtype=np.int32)])),
                            pa.array([None] * len(node) + [x for _, x, _ in linked], pa.binary()),
                        ],
                        ["token", "node", "size", "place", "other"],
                    )

    return docs.mapInArrow(run, "token long, node binary, size int, place int, other binary")


def meet(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """Candidate pairs (a, b, size_a, size_b, loose) of nodes that share a prefix n-gram."""
    dealt = rows.repartition(partitions(rows.sparkSession), "token").sortWithinPartitions("token", "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros((0, 16), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # of the last token
        long = False  # has that token's list been too long already?

        def made(found: list[tuple]) -> pa.RecordBatch:
            a, b, na, nb, loose = (np.concatenate(x) for x in zip(*found))
            # a pair meets at many n-grams: once per batch is enough
            turn = key(a) > key(b)
            a, b = np.where(turn[:, None], b, a), np.where(turn[:, None], a, b)
            na, nb = np.where(turn, nb, na), np.where(turn, na, nb)
            both = np.ascontiguousarray(np.concatenate([a, b, loose[:, None].astype(np.uint8)], axis=1)).view("V33").ravel()
            once = np.unique(both, return_index=True)[1]
            return pa.RecordBatch.from_arrays(
                [names_of(a[once]), names_of(b[once]), pa.array(na[once].astype(np.int32)), pa.array(nb[once].astype(np.int32)), pa.array(loose[once])], ["a", "b", "size_a", "size_b", "loose"]
            )

        def key(nodes: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(nodes).view("S16").ravel()

        def pairs(token, node, size, place, chained) -> list[tuple]:
            """Pairs within each token's rows; of ``chained`` rows only neighbours."""
            found = []
            for step in range(1, most):
                i = np.flatnonzero((token[step:] == token[:-step]) & ((step == 1) | ~chained[step:]))
                if not len(i):
                    break
                j = i + step
                na, nb, loose = size[i], size[j], chained[j]
                # sorted by size: na <= nb
                good = (na * 100 >= percent * nb) & (loose | (np.minimum(na - place[i], nb - place[j]) >= need(na, nb, percent)))
                good &= (node[i] != node[j]).any(axis=1)
                i, j = i[good], j[good]
                found.append((node[i], node[j], size[i], size[j], loose[good]))
            return found

        def step(final: bool, new: list[np.ndarray]) -> list[tuple]:
            """Pairs of all tokens but the last one, whose list may go on; of that one, once it is long, the chain so far."""
            nonlocal held, long
            token, node, size, place = (np.concatenate([x, y]) for x, y in zip(held, new))
            if not len(token):
                return []
            # rows of one set that several tasks sent
            again = np.concatenate([[False], (token[1:] == token[:-1]) & (size[1:] == size[:-1]) & (node[1:] == node[:-1]).all(axis=1)])
            token, node, size, place = (x[~again] for x in (token, node, size, place))
            begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            many = np.diff(np.append(begins, len(token)))
            chained = np.repeat(many > most, many)
            if long:
                chained[: many[0]] = True
            last = begins[-1]
            open_long = bool(chained[last])
            end = len(token) if final or open_long else last
            found = pairs(token[:end], node[:end], size[:end], place[:end], chained[:end])
            keep = len(token) if final else len(token) - 1 if open_long else last
            held, long = [x[keep:] for x in (token, node, size, place)], open_long and not final
            return found

        for b in batches:
            pair = b.column(4).is_valid().to_numpy(zero_copy_only=False)
            found = []
            if pair.any():
                some = pa.array(pair)
                n = b.column(2).filter(some).to_numpy().astype(np.int64)
                found.append((nodes_of(b.column(1).filter(some)), nodes_of(b.column(4).filter(some)), n, n, np.ones(len(n), dtype=bool)))
            rest = pa.array(~pair)
            token, size, place = (b.column(i).filter(rest).to_numpy() for i in (0, 2, 3))
            found += step(False, [token, nodes_of(b.column(1).filter(rest)), size.astype(np.int64), place.astype(np.int64)])
            if found:
                yield made(found)
        found = step(True, [x[:0] for x in held])
        if found:
            yield made(found)

    found = dealt.mapInArrow(run, "a binary, b binary, size_a int, size_b int, loose boolean")
    return found.groupBy("a", "b", "size_a", "size_b").agg(F.max("loose").alias("loose"))


def suffix_filter(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose histograms alone differ by more than two linked sets may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(-1, CELLS).astype(np.int16) for i in (5, 6))
            na, nb = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            keep = np.abs(a - c).sum(axis=1) <= na + nb - 2 * need(na, nb, percent)
            keep |= b.column(4).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["a", "b"])

    full = pairs.join(cells.select(F.col("node").alias("a"), F.col("cells").alias("cells_a")), "a").join(
        cells.select(F.col("node").alias("b"), F.col("cells").alias("cells_b")), "b"
    )
    return full.select("a", "b", "size_a", "size_b", "loose", "cells_a", "cells_b").mapInArrow(run, "a binary, b binary")


def link_groups(sets: list[np.ndarray], left: list[int], right: list[int] | None, percent: int) -> list[int]:
    """The place of the first set of each set's component, comparing ``left`` with each other or with ``right``."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = left, right if right is not None else left
    if len(a) * len(b) <= 64:
        for i in a:
            for j in b:
                if (right is None and j <= i) or find(i) == find(j):
                    continue
                need_ = need(len(sets[i]), len(sets[j]), percent)
                if min(len(sets[i]), len(sets[j])) >= need_ and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= need_:
                    root[max(find(i), find(j))] = min(find(i), find(j))
    else:
        # overlaps of all pairs as a product of 0/1 matrices, some thousand shared n-grams at a time
        every = np.concatenate([sets[i] for i in (*a, *(right or ()))])
        tokens, many = np.unique(every, return_counts=True)
        tokens = tokens[many > 1]
        over = np.zeros((len(a), len(b)), dtype=np.float32)
        for at in range(0, len(tokens), 4096):
            some = tokens[at : at + 4096]

            def rows(places: list[int]) -> np.ndarray:
                m = np.zeros((len(places), len(some)), dtype=np.float32)
                for r, i in enumerate(places):
                    s = sets[i][np.searchsorted(sets[i], some[0]) : np.searchsorted(sets[i], some[-1], side="right")]
                    where = np.searchsorted(some, s)
                    m[r, where[(where < len(some)) & (some[np.minimum(where, len(some) - 1)] == s)]] = 1
                return m

            x = rows(a)
            over += x @ (x if right is None else rows(b)).T
        na, nb = (np.array([len(sets[i]) for i in x]) for x in (a, b))
        for r, i in enumerate(a):
            for c in np.flatnonzero(over[r] >= need(na[r], nb, percent)).tolist():
                if find(i) != find(b[c]):
                    root[max(find(i), find(b[c]))] = min(find(i), find(b[c]))
    return [find(i) for i in range(len(sets))]


def verify(docs: DataFrame, members: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """Edges (node, root) of all links within clusters.  ``members``: id, node, size, cluster, one row per node."""
    wanted = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_GRAMS))
    sizes = members.groupBy("cluster").agg(F.least(wanted, F.count("*")).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").select("id", "node", "cluster", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine"))
    placed = stage(placed, "join-placed")  # its size on disk decides whether the texts have to travel twice
    bits = bits_for(members)
    some = flag(docs, bitmap(members, "id", bits=bits), "__maybe", F.col("id"), bits=bits).where("__maybe").select("id", "text")
    texts = some.join(placed, "id")
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "text"
    )
    dealt = dealt.repartition(partitions(docs.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "mine", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, mine = None, [], [], []

        def finish():
            if len(nodes) < 2:
                return [], []
            cross = key[1] != key[2]
            left = [x for x in range(len(nodes)) if not cross or mine[x] == key[1]]
            right = [x for x in range(len(nodes)) if mine[x] == key[2]] if cross else None
            root = link_groups(sets, left, right, percent)
            out = [(nodes[x], nodes[r]) for x, r in enumerate(root) if x != r]
            return [a for a, _ in out], [b for _, b in out]

        for big in batches:
            a, b = [], []
            for batch in chunks(big, 5):
                for c, i, j, m, node, s in zip(*(batch.column(x).to_pylist() for x in range(5)), sets_of(batch.column(5), n)):
                    if (c, i, j) != key:
                        for held, more in zip((a, b), finish()):
                            held += more
                        key, nodes, sets, mine = (c, i, j), [], [], []
                    # rows that repeat an id may bring another text, or the same one again
                    if len(s) and digest(s) == node and not (nodes and nodes[-1] == node):
                        nodes.append(node)
                        sets.append(s)
                        mine.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        a, b = finish()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def jaccard_components(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", list_size: int = LIST, block: int = BLOCK, frequent: int = FREQUENT, keys: bool = False
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable over links, its own included).

    Documents link when 100 * overlap >= percent * union.  Ids are longs.  With ``keys`` also ``th``, the row's
    :func:`~csvloom.llm.common.text_key`, and ``kept``: is it the one of its component with the smallest id (of
    those that repeat that id, the smallest key)?  Documents without words are kept.
    """
    if not 0 < percent <= 100 or n < 1:
        raise ValueError("percent must be in 1..100 and n positive")
    last = F.lit((1 << 63) - 1)  # stands for a null id
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), (text_key(text) if keys else F.lit(None).cast("binary")).alias("th"), text.alias("text"))
    narrow = full.select("id", "text")
    summary = stage(describe(full, n), "join-summary")
    rows = summary.where("part is null").select("id", "th", "node", "size", "cells")
    counters = docs.sparkSession.sparkContext.broadcast(counter_table(summary).tobytes())
    average = (rows.agg(F.sum("size")).first()[0] or 0) / (1 << COUNTER_BITS)

    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("cells").alias("cells"))
    pairs = stage(meet(prefixes(narrow, counters, average, n, percent, frequent), percent, list_size), "join-pairs")
    # of the nodes only those in a pair matter from here on
    paired = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    bits = bits_for(pairs)
    nodes = stage(flag(nodes, bitmap(paired, "node", bits=bits), "__maybe", F.col("node"), bits=bits).where("__maybe").drop("__maybe"), "join-nodes")
    candidates = suffix_filter(pairs, nodes, percent)
    clusters = connected_components(candidates).select("node", F.col("component").alias("cluster"))
    members = stage(nodes.select("node", "id", "size").join(clusters, "node"), "join-members")
    links = connected_components(verify(narrow, members, n, percent, block))

    own = F.struct("id", "th")
    rooted = rows.select("id", "th", "node", "size").join(links, "node", "left").select("id", "th", "size", F.coalesce("component", "node").alias("root"))
    # written, so that the join's sides are plain exchanges, of which Spark splits one that a large group makes long
    least = stage(rooted.where("root is not null").groupBy("root").agg(F.min(own).alias("first")), "join-least")
    linked = rooted.where("root is not null").join(least, "root").select("id", "th", "size", F.col("first.id").alias("component_id"), own.eqNullSafe(F.col("first")).alias("kept"))
    alone = rooted.where("root is null").select("id", "th", "size", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone).select(
        F.nullif("id", last).alias(id_col),
        F.col("size").cast("long").alias("n_shingles"),
        F.nullif("component_id", last).alias("component_id"),
        *(["th", "kept"] if keys else []),
    )
