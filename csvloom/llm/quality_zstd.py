"""Quality score from two zstandard dictionaries, one built from good and one from bad labelled texts.

A text costs fewer bytes with the dictionary of the kind it resembles.  The difference of the two compressed
sizes, divided by the square root of the text's length (a difference gathered over n bytes varies by about
as much), is the only input of the score.  Calibration turns it into a number between 0 and 1, the share of
label 1 among rows of such a difference: the best fit that never falls (pooled adjacent violators), straight
between its steps, with rows weighted to the labels' shares among all training rows.  To calibrate on sizes
that the dictionaries did not see, the training rows are split in two halves: dictionaries of each half
rate the other one, and the final ones are built from all.

The sample for fitting is bounded: ``max_docs`` rows of each label, those of the smallest hash of the id,
whole texts.  Only these rows reach the driver.  Scoring reads every whole text, one at a time, in memory
that grows with the longest text alone.  Where the texts are too few or too short to train a dictionary on,
the last ``DICT_BYTES`` of the joined texts serve as one.

Defined results: a null text is scored as the empty one.  Rows whose label is neither 0 nor 1, or null, are
not learned from; of several labels of one id all count.  Without training rows of both labels every score
is the share of label 1 (0.5 with none).  Rows that repeat an id are scored each.  Empty tables give an
empty result.  Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows of each label that the fit takes at most.
MAX_DOCS = 1500
#: Bytes of each dictionary.
DICT_BYTES = 64 << 10
#: Strong matching: a faster level finds less of a dictionary, and texts that repeat themselves look alike with both.
LEVEL = 12
#: Bytes added to a text's length, so that very short texts lean on the middle of the scale.
SMOOTH = 16


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and the points of the calibration: differences and their scores, both in rising order."""

    good: bytes
    bad: bytes
    at: tuple[float, ...]
    scores: tuple[float, ...]

    def scorer(self):
        if not self.good or not self.bad:
            return lambda text: self.scores[0]
        good, bad = compressor(self.good), compressor(self.bad)
        return lambda text: float(np.interp(difference(good, bad, text), self.at, self.scores))


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the texts themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICT_BYTES:]


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(data)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, text: bytes) -> float:
    """By how much the good dictionary makes the text smaller than the bad one, normalised by its length."""
    return (len(bad.compress(text)) - len(good.compress(text))) / math.sqrt(len(text) + SMOOTH)


def calibrate(rows: list[tuple[float, int]], weight: tuple[float, float]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Differences and the weighted shares of label 1 around them, never falling; each share leans on half a row of either label."""
    blocks: list[list[float]] = []  # weight of label 1, weight, weighted sum of differences
    for x, y in sorted(rows):
        blocks.append([weight[1] * y, weight[y], weight[y] * x])
        while len(blocks) > 1:
            (a, n, s), (b, m, t) = blocks[-2:]
            if a / n < b / m and s / n < t / m:
                break
            blocks[-2:] = [[a + b, n + m, s + t]]
    return tuple(s / n for _, n, s in blocks), tuple((a + 0.5) / (n + 1) for a, n, _ in blocks)


def train(rows: list[tuple[bytes, int]], shares: tuple[float, float] = (0.5, 0.5)) -> Model:
    """Fit on (text, label) rows in a fixed order; ``shares`` are those of labels 0 and 1 among all training rows."""
    by = {k: [t for t, q in rows if q == k] for k in (1, 0)}
    if min(map(len, by.values())) < 2:
        return Model(b"", b"", (0.0,), (len(by[1]) / len(rows) if rows else 0.5,))
    rated = []
    for half in (0, 1):
        good, bad = (compressor(dictionary(by[k][half::2])) for k in (1, 0))
        for k in (1, 0):
            rated += [(difference(good, bad, t), k) for t in by[k][1 - half :: 2]]
    weight = tuple(shares[k] * len(rows) / len(by[k]) for k in (0, 1))
    return Model(dictionary(by[1]), dictionary(by[0]), *calibrate(rated, weight))


def held_out(id_col: Column) -> Column:
    """Rows kept from training: a fifth of the ids, by checksum of their text."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS
) -> Model:
    """Fit on labelled rows that are not held out; at most ``max_docs`` of each label."""
    chosen: list[DataFrame] = []
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    many = {r["k"]: r["n"] for r in usable.groupBy(F.col(label_col).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(many.values()) or 1
    for k in (0, 1):
        some = usable.where(F.col(label_col) == k).select(F.col(id_col).alias("__id"), F.lit(k).alias("__y"), F.xxhash64(id_col).alias("__h"))
        chosen.append(some.orderBy("__h", "__id").limit(max_docs))
    sample = chosen[0].unionByName(chosen[1])  # at most 2 * max_docs narrow rows
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__t"))
    found = texts.join(F.broadcast(sample), "__id").groupBy("__id", "__y", "__h").agg(F.min("__t").alias("__t"))
    rows = sorted((r["__h"], r["__id"], r["__y"], bytes(r["__t"])) for r in found.collect())
    return train([(t, y) for _, _, y, t in rows], (many.get(0, 0) / total, many.get(1, 0) / total))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``score``."""
    narrow = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    kind = narrow.schema["__id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = sent.value.scorer()
        for b in batches:
            out = [rate(t.as_buffer().to_pybytes()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["__id", "score"])

    return narrow.mapInArrow(run, f"__id {kind}, score double").withColumnRenamed("__id", id_col)


def rate_rows(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows of ``docs`` with all their columns and the score added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = sent.value.scorer()
        for b in batches:
            out = [rate(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)
