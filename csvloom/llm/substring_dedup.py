"""Removal of passages that an earlier document has, by super-k-mer partitioning.

A window is ``window`` consecutive words of one document.  Its minimiser is the smallest hash among its runs
of ``k`` words.  Consecutive windows with the same minimiser (a super-k-mer) travel as one packed string to
the minimiser's bucket, where the windows are sorted and equal ones, word for word, stand side by side.

1. The first scan sends only (minimiser, id, how many).  Minimisers of one document share nothing; the others
   go into a bitmap of fixed size.
2. The second scan packs and sends the super-k-mers whose minimiser may be shared.  A string that the task
   has already met in a document with a smaller id is settled on the spot and sends its range of words
   instead, so copies do not pile up in a bucket (rows are taken in order of id, batch by batch).  Those of a
   minimiser with very many super-k-mers are dealt to salted groups first, as many as the root of their number: there all
   but the smallest id of each string are settled, and only these go on to the bucket.
3. Each bucket yields the word ranges to remove.  A bucket whose windows do not fit in ``BUCKET_BYTES`` is passed
   on as single windows under their own hash to a last round, where the rows of a window stand in order of id
   and the smallest comes first, which needs no memory.
4. Documents with a range are joined with their ranges; all others, told by a bitmap, pass in the scan.

Defined results: a null or empty text has no words; a document shorter than a window loses nothing; words of
documents with equal ids are not removed on account of each other; rows that repeat an id and a text get the
same result; a null id counts as larger than all others.  Texts of any length: long ones are worked on section
by section, so what is held beside a text is bounded.  An empty table gives no rows.  Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csvloom.llm.common import bitmap, bits_for, flag, partitions, release, stage
from csvloom.llm.textops import SECTION, Words, chunks, gram_hashes, mix, sections, sliding_min

WINDOW = 50
#: Words of the runs whose smallest hash is the minimiser.
K = 8
#: Bits of the bitmap of shared minimisers (8 MB at all sizes).
SHARED_BITS = 26
#: Super-k-mers from which a minimiser counts as hot, so that no task gets many of them; never so low that more than
#: HOT_LIST minimisers could be.
HOT_ROWS = 1000
HOT_LIST = 1 << 20
#: Bytes that the windows of a bucket may take, whatever the corpus.
BUCKET_BYTES = 96 << 20
#: Bytes of strings that a task remembers to settle repeats.
REMEMBER = 24 << 20
#: What a row carries: a super-k-mer, a single window, a range that is settled, or a super-k-mer of a hot minimiser.
MANY, SINGLE, SETTLED, SALTED = 0, 1, 2, 3
#: Windows of a super-k-mer at most; longer runs of one minimiser are cut.
LONGEST = 512


def units(batch: pa.RecordBatch, text: int, overlap: int) -> Iterator[tuple[Words, np.ndarray, int]]:
    """The words of some rows at a time, the rows, and how many words of the row's text come before.

    Several short texts come together, a long one in sections that share ``overlap`` words.
    """
    at = 0
    for c in chunks(batch, text):
        rows = np.arange(at, at + len(c))
        at += len(c)
        column = c.column(text)
        if len(c) == 1 and column.nbytes > SECTION and column[0].is_valid:
            for before, part in sections(np.frombuffer(column[0].as_buffer(), dtype=np.uint8), overlap):
                yield Words.of(part), rows, before
        else:
            yield Words(column), rows, 0


def by_id(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows in order of their first column."""
    ids = batch.column(0).to_numpy()
    return batch if (ids[1:] >= ids[:-1]).all() else batch.take(pa.array(np.argsort(ids, kind="stable")))


def window_minimisers(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one minimiser: its first window, one past its last, the minimiser."""
    least = sliding_min(gram_hashes(words.hashes(), k), window - k + 1) if len(words) >= window else np.zeros(0, np.uint64)
    n = len(least)
    valid = np.zeros(n + 1, dtype=np.int64)
    first = words.first
    long = np.flatnonzero(np.diff(first) >= window)
    np.add.at(valid, first[long], 1)
    np.add.at(valid, first[long + 1] - window + 1, -1)
    inside = np.cumsum(valid)[:n] > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    begins[first[long]] = True
    start = np.flatnonzero(begins)
    stop = np.flatnonzero(inside & np.append(begins[1:] | ~inside[1:], True)) + 1 if n else start
    # cut what is too long
    pieces = -(-(stop - start) // LONGEST)
    which = np.repeat(np.arange(len(start)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cut = start[which] + nth * LONGEST
    return cut, np.minimum(cut + LONGEST, stop[which]), least[start][which]


def _shared(narrow: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, rows, _ in units(b, 2, window - 1):
                start, _, least = window_minimisers(words, window, k)
                if not len(start):
                    continue
                place = np.searchsorted(words.first, start, side="right") - 1
                ids = b.column(0).to_numpy()[rows[place]]
                once, n = np.unique(np.stack([least.astype(np.int64), ids]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1]), pa.array(n)], ["least", "id", "n"])

    made = narrow.mapInArrow(run, "least long, id long, n long")
    return made.groupBy("least").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.sum("n").alias("n")).where("a < b").select("least", "n")


def _bitmap(shared: DataFrame, bits: int) -> np.ndarray:
    """Which values of a minimiser's last bits are shared: at most 2**bits / 64 rows reach the driver."""
    words = (
        shared.select(F.expr(f"least & {(1 << bits) - 1}").alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))
    )
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    held = words.toArrow()
    out[held.column("word").to_numpy()] = held.column("set").to_numpy().astype(np.uint64)
    return out


FOUND = "id long, th long, a int, b int, key long, kind int, packed binary, places binary"


def _covered(batches: Iterator[pa.RecordBatch], window: int, room: int) -> Iterator[pa.RecordBatch]:
    """From rows (key, kind, id, th, start, n, packed, least, places) sorted by key, kind and id: ranges of words to remove, or what
    another round has to look at (first word, number of windows, key, kind and text): of salted groups the smallest id of
    each string, of a bucket that takes more than ``room`` bytes its single windows."""
    out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
    group: tuple | None = None
    rows: list[tuple] = []
    owner: dict[bytes, int] = {}
    every: list[tuple[bytes, int]] = []  # the different windows of each string, with its id
    least: dict[bytes, int] = {}
    left = room

    def emit(*row) -> None:
        for held, x in zip(out, (*row, *[None] * (len(out) - len(row)))):
            held.append(x)

    def windows(packed: bytes) -> list[bytes]:
        gaps = np.flatnonzero(np.frombuffer(packed, dtype=np.uint8) == 0x20)
        begin = np.concatenate([[0], gaps + 1])[: len(gaps) + 2 - window].tolist()
        return [packed[i:j] for i, j in zip(begin, np.append(gaps, len(packed))[window - 1 :].tolist())]

    def pass_on(doc: int, th: int, start: int, packed: bytes) -> None:
        """The different windows of a string, each with the places where it stands there."""
        places: dict[bytes, list[int]] = {}
        for w, text in enumerate(windows(packed)):
            places.setdefault(text, []).append(start + w)
        for text, at in places.items():
            emit(doc, th, at[0], 1, xxhash.xxh3_64_intdigest(text) - (1 << 63), SINGLE, text, np.array(at, dtype=np.int32).tobytes() if len(at) > 1 else None)

    def remove(doc: int, th: int, places: np.ndarray) -> None:
        """Ranges of the windows that begin at some places, in order."""
        cut = np.flatnonzero(np.diff(places) > window) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(places)]):
            emit(doc, th, int(places[a]), int(places[b - 1]) + window)

    def finish() -> None:
        """Sort the windows of a bucket's distinct strings and find the smallest id of each."""
        if not rows or rows[0][0] == rows[-1][0]:
            return
        smallest: dict[bytes, int] = {}
        if len(owner) > 1:
            every.sort()
            same = None
            for text, doc in every:
                if text != same:
                    same = text
                    smallest[text] = doc
        gone: dict[bytes, np.ndarray] = {}
        for doc, th, start, packed in rows:
            if len(owner) == 1:
                if owner[packed] < doc:
                    emit(doc, th, start, start + packed.count(b" ") + 1)
                continue
            if (least_of := gone.get(packed)) is None:
                least_of = gone[packed] = np.fromiter((smallest[t] for t in windows(packed)), dtype=np.int64)
            some = np.flatnonzero(least_of < doc)
            if len(some):
                remove(doc, th, start + some)

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["id", "th", "a", "b", "key", "kind", "packed", "places"])
        for held in out:
            held.clear()
        return made

    for batch in batches:
        key, kind, doc, th, start, n, packed, bucket, places = (batch.column(i).to_pylist() for i in range(9))
        for i in range(len(key)):
            if (key[i], kind[i]) != group:
                finish()
                group = (key[i], kind[i])
                rows.clear()
                owner.clear()
                every.clear()
                least.clear()
                left = room
            if kind[i] == SETTLED:
                emit(doc[i], th[i], start[i], start[i] + n[i] - 1 + window)
            elif kind[i] in (SINGLE, SALTED):
                if least.setdefault(packed[i], doc[i]) < doc[i]:
                    if places[i] is None:
                        emit(doc[i], th[i], start[i], start[i] + n[i] - 1 + window)
                    else:
                        remove(doc[i], th[i], np.frombuffer(places[i], dtype=np.int32))
                elif kind[i] == SALTED:
                    emit(doc[i], th[i], start[i], n[i], bucket[i], MANY, packed[i])
            else:
                left -= 200
                if left >= 0 and packed[i] not in owner:
                    cut = dict.fromkeys(windows(packed[i]))
                    left -= len(packed[i]) + sum(map(len, cut)) + 300 * len(cut)
                    if left >= 0:
                        owner[packed[i]] = doc[i]  # rows are in order of id
                        every += [(text, doc[i]) for text in cut]
                if left >= 0:
                    rows.append((doc[i], th[i], start[i], packed[i]))
                    continue
                for row in rows:
                    pass_on(*row)
                rows.clear()
                owner.clear()
                every.clear()
                pass_on(doc[i], th[i], start[i], packed[i])
                if len(out[0]) >= 10_000:
                    yield flush()
        yield flush()
    finish()
    yield flush()


def removed_ranges(docs: DataFrame, window: int = WINDOW, k: int = K, hot_rows: int = HOT_ROWS, room: int = BUCKET_BYTES) -> DataFrame:
    """Word ranges to remove as rows (id, th, a, b): words a to b - 1 of the document with this id and text hash.

    ``docs``: id (long), th (hash of the text), text.
    """
    spark = docs.sparkSession
    shared = stage(_shared(docs, window, k), "substring-shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.where(F.col("n") > max(hot_rows, total // HOT_LIST)).orderBy("least").toArrow()  # at most HOT_LIST
    salts = np.ceil(np.sqrt(hot.column("n").to_numpy())).astype(np.int64)
    sent = spark.sparkContext.broadcast((_bitmap(shared, SHARED_BITS).tobytes(), hot.column("least").to_numpy().tobytes(), salts.tobytes()))
    release(shared)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value[0], dtype=np.uint64)
        known_hot, salts = (np.frombuffer(x, dtype=np.int64) for x in sent.value[1:])
        met: dict[bytes, int] = {}
        room = REMEMBER
        for b in map(by_id, batches):
            ids, hashes = (b.column(i).to_numpy() for i in (0, 1))
            for words, rows, before in units(b, 2, window - 1):
                start, stop, least = window_minimisers(words, window, k)
                low = least & np.uint64((1 << SHARED_BITS) - 1)
                maybe = (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)
                start, stop, key = start[maybe], stop[maybe], least[maybe].astype(np.int64)
                if not len(start):
                    continue
                flat, off = words.spaced()
                place = np.searchsorted(words.first, start, side="right") - 1
                data = flat.tobytes()
                packed: list[bytes | None] = [data[i:j] for i, j in zip(off[start].tolist(), (off[stop + window - 1] - 1).tolist())]
                doc = ids[rows[place]]
                kind, bucket = np.full(len(start), MANY), key.copy()
                if len(known_hot):
                    at = np.minimum(np.searchsorted(known_hot, key), len(known_hot) - 1)
                    is_hot = known_hot[at] == key
                    kind[is_hot] = SALTED
                    salt = mix(doc[is_hot].astype(np.uint64)) % salts[at[is_hot]].astype(np.uint64)
                    key[is_hot] = mix(mix(key[is_hot].astype(np.uint64)) + salt).astype(np.int64)
                settled = []
                for r, (text, i) in enumerate(zip(packed, doc.tolist())):
                    held = met.get(text)
                    if held is not None and held < i:
                        settled.append(r)
                        packed[r] = None
                    else:
                        if held is None:
                            room -= len(text) + 100
                            if room < 0:
                                met, room = {}, REMEMBER
                        met[text] = i
                kind[settled] = SETTLED
                key[settled] = mix((doc[settled] * LONGEST + start[settled]).astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key),
                        pa.array(kind.astype(np.int32)),
                        pa.array(doc),
                        pa.array(hashes[rows[place]]),
                        pa.array((start - words.first[place] + before).astype(np.int32)),
                        pa.array((stop - start).astype(np.int32)),
                        pa.array(packed, pa.binary()),
                        pa.array(bucket),
                        pa.nulls(len(key), pa.binary()),
                    ],
                    ["key", "kind", "id", "th", "start", "n", "packed", "least", "places"],
                )

    rows = docs.mapInArrow(pack, "key long, kind int, id long, th long, start int, n int, packed binary, least long, places binary")

    def resolved(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(partitions(spark), "key", "kind").sortWithinPartitions("key", "kind", "id")
        return dealt.mapInArrow(lambda batches: _covered(batches, window, room), FOUND)

    out = None
    while True:  # three rounds at most: salted groups, buckets, single windows
        found = stage(resolved(rows), "substring-found")
        ranges = found.where("packed is null").select("id", "th", "a", "b")
        out = ranges if out is None else out.unionByName(ranges)
        more = found.where("packed is not null")
        if more.isEmpty():
            return out
        rows = more.select("key", "kind", "id", "th", F.col("a").alias("start"), F.col("b").alias("n"), "packed", F.col("key").alias("least"), "places")


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS, room: int = BUCKET_BYTES
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    A word goes if it lies in a window whose words also stand in a document with a smaller id.
    """
    if not 0 < k <= window:
        raise ValueError("k must be in 1..window")
    last = F.lit((1 << 63) - 1)  # stands for a null id
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    ranges = removed_ranges(narrow, window, k, hot_rows, room).groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    # written, so that the join's sides are plain exchanges
    ranges = stage(ranges.withColumnsRenamed({"id": "__id", "th": "__th"}), "substring-ranges")
    bits = bits_for(ranges)
    marked = flag(narrow, bitmap(ranges, "__id", "__th", bits=bits), "__maybe", F.col("id"), F.col("th"), bits=bits)
    touched = marked.where("__maybe").join(ranges, (F.col("id") == F.col("__id")) & (F.col("th") == F.col("__th")), "left").select("id", "text", "gone")
    whole = marked.where("not __maybe").select("id", "text", F.lit(None).cast(touched.schema["gone"].dataType).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            kept: list[list[bytes]] = [[] for _ in range(len(b))]
            gone = [[] if g is None else [(r["a"], r["b"]) for r in g] for g in b.column(2).to_pylist()]
            for words, rows, before in units(b, 1, 0):
                keep = np.ones(len(words), dtype=bool)
                for d, row in enumerate(rows.tolist()):
                    first, end = int(words.first[d]), int(words.first[d + 1])
                    for x, y in gone[row]:
                        keep[min(max(first, first + x - before), end) : max(first, min(end, first + y - before))] = False
                flat, off = words.spaced(keep)
                data = flat.tobytes()
                at = np.concatenate([[0], np.cumsum(keep)])[words.first]
                for d, row in enumerate(rows.tolist()):
                    n_words[row] += words.first[d + 1] - words.first[d]
                    n_removed[row] += words.first[d + 1] - words.first[d] - (at[d + 1] - at[d])
                    if at[d + 1] > at[d]:
                        kept[row].append(data[off[at[d]] : off[at[d + 1]] - 1])
            texts = pa.array([b" ".join(x) for x in kept], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(n_removed), texts], ["id", "n_words", "n_removed", "kept_text"])

    out = touched.unionByName(whole).mapInArrow(cut, "id long, n_words long, n_removed long, kept_text string")
    return out.select(F.nullif("id", last).alias(id_col), "n_words", "n_removed", "kept_text")
