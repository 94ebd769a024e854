"""Mixing sources to target weights along a time-varying curriculum.

Native: DataFrame functions only.

Targets.  Sources, ordered by code point with null last, have weights; together they share ``volume`` times
all words, none more than ``cap`` times its own.  What a capped source cannot take is shared again by
weight.  That ends where every open source takes the same multiple of its weight (a water level), found with
running sums over the sources ordered by cap per weight.

Curriculum.  A source's demand rate over training time 0..1 is its schedule: linear from ``start`` to
``end`` times its mean, so the integral is D(t) = target * (a t + (1 - a) t^2) with a = start / mean.  Documents of a
source stand in a fixed pseudo-random order (a hash of the id) and are passed over again and again; the
c-th word of that stream is wanted at the time t where D(t) = c.  Inverting D for the midpoint of every
document gives its training position; a copy is taken while its midpoint lies below the target.
:func:`in_training_order` sorts what is taken by position in range partitions.

A source may hold any part of the rows: its stream is cut by the leading bits of the hash into pieces whose
totals are summed first, and only then are running sums taken inside each piece.

Defined results: a null text has size 0 and is never taken; rows repeating an id are ordered by size; null
ids are ordered by a hash of their text; texts may be of any length; an empty table gives an empty mix; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csvloom.llm.common import n_words, partitions, stage

#: Leading bits of the order hash that name a piece of a source's stream: at least so many, and enough for pieces of so many rows.
PIECE_BITS, PIECE_ROWS = 9, 1 << 16


def source_targets(sizes: DataFrame, weights: Sequence[float], volume: float, cap: float) -> DataFrame:
    """``sizes``: one row per source (``__src``, ``__total``).  Adds ``__weight`` and ``__target``.

    The ordered windows run over one row per source, a catalogue rather than the corpus.
    """
    by_name = Window.orderBy(F.col("__src").isNull(), F.encode("__src", "utf-8"))
    ranked = sizes.withColumn("__rank", F.row_number().over(by_name) - 1).withColumn(
        "__weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    )
    by_level = Window.orderBy(F.col("__total") / F.col("__weight"), "__rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(volume) * F.sum("__total").over(everything) - F.coalesce(F.sum(F.lit(cap) * F.col("__total")).over(before), F.lit(0.0))) / F.sum("__weight").over(after)
    return (
        ranked.withColumn("__level", level)
        .withColumn("__open", F.col("__level") * F.col("__weight") <= F.lit(cap) * F.col("__total"))
        .withColumn("__water", F.min(F.when(F.col("__open"), F.struct(F.col("__total") / F.col("__weight"), "__rank", "__level"))).over(everything)["__level"])
        .withColumn("__target", F.least(F.lit(cap) * F.col("__total"), F.coalesce(F.col("__water"), F.lit(float("inf"))) * F.col("__weight")))
        .select("__src", "__total", "__rank", "__weight", "__target")
    )


def training_position(words: Column, target: Column, a: Column) -> Column:
    """The time in 0..1 at which a source's demand reaches ``words``: the inverse of target * (a t + (1 - a) t^2)."""
    y = F.when(target > 0, words / target).otherwise(F.lit(0.0))
    b = F.lit(1.0) - a
    # the stable form of the root, also where b is 0
    return F.when(y <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * y / (a + F.sqrt(F.greatest(a * a + F.lit(4.0) * b * y, F.lit(0.0)))))


def curriculum_mix(
    docs: DataFrame,
    weights: Sequence[float],
    schedules: Sequence[tuple[float, float]] = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0)),
    volume: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document and pass: id, ``size``, ``source_size``, ``target``, ``copies``, ``pass``, ``taken``, ``position``, carried columns.

    Rows with ``taken`` 0 are documents that the mix leaves out (pass 0, null position).  ``weights`` and
    ``schedules`` (relative demand at the start and at the end of training) repeat over the sources.
    Documents of no words are never taken.
    """
    if cap != int(cap) or cap < 1 or not weights or min(weights) <= 0 or volume < 0:
        raise ValueError("cap must be a whole number, weights positive, volume not negative")
    if min(min(s) for s in schedules) < 0 or any(sum(s) == 0 for s in schedules):
        raise ValueError("schedules must not be negative or zero throughout")
    kept = {f"__c{i}": F.col(c) for i, c in enumerate(carry)}
    rows = stage(
        docs.select(
            F.col(id_col).alias("__id"),
            F.col(source_col).alias("__src"),
            n_words(F.col(text_col)).alias("__size"),
            F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(F.xxhash64(F.col(id_col))).alias("__h"),
            *(c.alias(k) for k, c in kept.items()),
        ),
        "mix-rows",
    )
    bits = max(PIECE_BITS, (rows.count() // PIECE_ROWS).bit_length())
    piece = F.shiftright("__h", 64 - bits).alias("__piece")
    totals = rows.groupBy("__src", piece).agg(F.sum("__size").alias("__words"))
    sizes = totals.groupBy("__src").agg(F.sum("__words").alias("__total"))
    targets = source_targets(sizes, weights, volume, cap)
    before = Window.partitionBy("__src").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__words").over(before), F.lit(0)))
    # at most 2**bits rows for each source
    placed = offsets.join(targets, offsets["__src"].eqNullSafe(targets["__src"])).select(
        offsets["__src"].alias("__osrc"), F.col("__piece").alias("__opiece"), "__before", "__total", "__target", "__rank"
    )
    inside = Window.partitionBy("__src", "__piece").orderBy("__h", "__id", "__size")
    stream = rows.withColumn("__piece", F.shiftright("__h", 64 - bits)).withColumn(
        "__start", F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    )
    joined = stream.join(placed, stream["__src"].eqNullSafe(placed["__osrc"]) & (stream["__piece"] == placed["__opiece"]))
    a = F.element_at(F.array(*(F.lit(2.0 * s / (s + e)) for s, e in schedules)), (F.col("__rank") % len(schedules) + 1).cast("int"))
    middle = F.col("__before") + F.col("__start") + F.col("__size") / 2.0
    # the midpoint of pass p is middle + p * total: count the passes below the target
    copies = F.when(
        F.col("__size") > 0, F.greatest(F.lit(0), F.least(F.lit(int(cap)), F.ceil((F.col("__target") - middle) / F.col("__total"))))
    ).otherwise(F.lit(0)).cast("int")
    passes = joined.withColumns({"__mid": middle, "__copies": copies, "__a": a}).withColumn(
        "__pass", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__copies") - 1, F.lit(0))))
    )
    taken = F.col("__copies") > 0
    return passes.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__total").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__copies").alias("copies"),
        F.col("__pass").alias("pass"),
        F.when(taken, F.col("__size")).otherwise(F.lit(0)).cast("long").alias("taken"),
        F.when(taken, training_position(F.col("__mid") + F.col("__pass") * F.col("__total"), F.col("__target"), F.col("__a"))).alias("position"),
        *(F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)),
    )


def in_training_order(mix: DataFrame, id_col: str = "doc_id", prefix: str = "") -> DataFrame:
    """Range-sort what the mix takes by training position; equal positions by id and pass.  ``prefix`` is that of the mix's columns."""
    order = [f"{prefix}position", id_col, f"{prefix}pass"]
    return mix.where(F.col(f"{prefix}taken") > 0).repartitionByRange(partitions(mix.sparkSession), *order).sortWithinPartitions(*order)
