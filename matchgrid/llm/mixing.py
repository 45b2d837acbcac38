"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time. Its integral fixes how many words of the
source are read in all (the target); the running integral fixes by when. A document (or a repeat
of one) starts where the cumulative demand of its source reaches the words that stand before it,
so its training position is the inverse of that integral, and the corpus is range-sorted by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.llm.common import put, unused, word_count

#: Relative weights given to the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MAX_REPEATS = 3


@dataclass(frozen=True)
class Schedule:
    """A source's weight over training time: straight lines between (time, weight) knots.

    Times run from 0 to 1. Only the shape counts: the integral is scaled to the source's target.
    """

    knots: tuple[tuple[float, float], ...]

    def segments(self) -> list[tuple[float, float, float, float, float]]:
        """(start, length, weight at the start, slope, area before) of each line, total area 1."""
        pairs = list(zip(self.knots, self.knots[1:], strict=False))
        area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pairs)
        out, before = [], 0.0
        for (t0, w0), (t1, w1) in pairs:
            out.append((t0, t1 - t0, w0 / area, (w1 - w0) / area / (t1 - t0), before))
            before += (t1 - t0) * (w0 + w1) / 2 / area
        return out

    def inverse(self, share: Column) -> Column:
        """The time by which this share of the demand has been met."""
        result = None
        for start, length, weight, slope, before in self.segments():
            left = share - F.lit(before)
            if slope:
                step = (F.sqrt(F.lit(weight * weight) + F.lit(2 * slope) * left) - F.lit(weight)) / F.lit(slope)
            else:
                step = left / F.lit(weight)
            time = F.lit(start) + step
            result = time if result is None else F.when(share >= F.lit(before), time).otherwise(result)
        return F.least(F.greatest(result, F.lit(0.0)), F.lit(1.0))


#: Heavily weighted sources lead the curriculum, lightly weighted ones close it.
CURRICULUM = (
    Schedule(((0.0, 1.5), (1.0, 0.5))),
    Schedule(((0.0, 1.0), (1.0, 1.0))),
    Schedule(((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))),
)


def source_targets(by_source: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, tier, target).

    Sources take the weights in the order of their names (code points, null last) and share the
    sum of all sizes; a target stops at ``max_repeats`` times its source, and what is over is
    shared by the others by weight until none is above. That is a water level: with the sources
    in the order of their ceiling per unit of weight, the stopped ones come first, so two running
    sums find them. One row per source passes through one task, no document does.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    tier = (F.row_number().over(named) - 1) % len(weights)
    s = by_source.withColumn("tier", tier).withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("tier") + 1))
    s = s.withColumn("ceiling", F.col("source_size") * F.lit(max_repeats).cast("long"))
    rising = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("before", F.coalesce(F.sum("ceiling").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weights_left", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("stopped", F.col("ceiling") * F.col("weights_left") < F.col("weight") * (F.col("total") - F.col("before")))
    s = s.withColumn("rest", F.col("total") - F.sum(F.when(F.col("stopped"), F.col("ceiling")).otherwise(0)).over(everything))
    s = s.withColumn("rest_weight", F.sum(F.when(F.col("stopped"), F.lit(0)).otherwise(F.col("weight"))).over(everything))
    target = F.when(F.col("stopped"), F.col("ceiling").cast("double")).otherwise((F.col("rest") * F.col("weight")).cast("double") / F.col("rest_weight").cast("double"))
    return s.select("source", "source_size", "tier", target.alias("target"))


SCRATCH = ("_s", "_k", "_t", "_b", "_o", "_ps", "_pb", "_z", "_tier", "_target", "_c", "_e", "_left", "_c0", "_more", "_n")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights=WEIGHTS,
    curriculum=CURRICULUM,
    max_repeats: int = MAX_REPEATS,
    buckets: int = 4096,
) -> DataFrame:
    """Each document with its part in the mix; columns of ``docs`` stay unless named alike.

    Added: size (words), source_size, target (words wanted of its source), taken (words the mix
    takes, repeats counted), copies, first_position and positions (training time of each copy,
    0 to 1; null and empty when not taken). A source reads its documents in the order of a
    content hash: whole passes first, then as many words as are left, so that the last copy of
    one document for each source is read in part (taken tells how far) and the target is met to
    the word.

    A source may hold any share of the rows: the running sum is taken in ``buckets`` ranges of
    the hash, whose sums alone are added up by source. The ranges follow the order, so the
    result doesn't depend on their number.

    Null or empty texts have size 0 and are never taken; a null source is a source of its own,
    ordered last; rows alike in id and text are told apart arbitrarily but count twice; an empty
    table gives an empty one.
    """
    n = dict(zip(SCRATCH, unused(docs, *SCRATCH), strict=True))  # names that the caller doesn't use
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    sized = put(docs, {"size": word_count(F.col(text)), n["_s"]: F.col(source), n["_k"]: key, n["_t"]: F.md5(F.coalesce(F.col(text), F.lit("")))})
    sized = sized.withColumn(n["_b"], F.conv(F.substring(n["_k"], 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32))
    sized = sized.withColumn(n["_b"], F.floor(n["_b"]).cast("int"))
    sums = sized.groupBy(n["_s"], n["_b"]).agg(F.sum("size").alias("n"))
    upto = Window.partitionBy(n["_s"]).orderBy(n["_b"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(n["_s"], n["_b"], F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(n["_o"]))
    targets = source_targets(sums.groupBy(F.col(n["_s"]).alias("source")).agg(F.sum("n").alias("source_size")), weights, max_repeats)
    # source by bucket at most: small beside the documents, joined without a broadcast hint
    plan = offsets.join(targets, offsets[n["_s"]].eqNullSafe(targets["source"])).select(
        F.col(n["_s"]).alias(n["_ps"]), F.col(n["_b"]).alias(n["_pb"]), n["_o"], F.col("source_size").alias(n["_z"]), F.col("tier").alias(n["_tier"]), F.col("target").alias(n["_target"])
    )
    order = Window.partitionBy(n["_s"], n["_b"]).orderBy(n["_k"], n["_t"]).rowsBetween(Window.unboundedPreceding, -1)
    run = sized.withColumn(n["_c"], F.coalesce(F.sum("size").over(order), F.lit(0)))
    run = run.join(plan, run[n["_s"]].eqNullSafe(plan[n["_ps"]]) & (run[n["_b"]] == plan[n["_pb"]]))
    c0 = F.col(n["_c"]) + F.col(n["_o"])
    z = F.col(n["_z"])
    passes = F.when(z > 0, F.floor(F.col(n["_target"]) / z.cast("double"))).otherwise(F.lit(0)).cast("long")
    left = F.floor(F.col(n["_target"]) - (F.col(n["_e"]) * z).cast("double") + F.lit(0.5)).cast("long")
    run = run.withColumn(n["_e"], passes).withColumn(n["_left"], left).withColumn(n["_c0"], c0)
    run = run.withColumn(n["_more"], F.least(F.greatest(F.col(n["_left"]) - F.col(n["_c0"]), F.lit(0).cast("long")), F.col("size")))
    run = run.withColumn(n["_n"], F.when(F.col("size") > 0, F.col(n["_e"]) + F.when(F.col(n["_more"]) > 0, 1).otherwise(0)).otherwise(0).cast("int"))

    def position(copy: Column) -> Column:
        share = F.least((copy.cast("long") * z + F.col(n["_c0"])).cast("double") / F.col(n["_target"]), F.lit(1.0))
        result = curriculum[0].inverse(share)
        for i, schedule in enumerate(curriculum[1:], 1):
            result = F.when(F.col(n["_tier"]) % len(curriculum) == i, schedule.inverse(share)).otherwise(result)
        return result

    taken = F.col(n["_n"]) > 0
    positions = F.when(taken, F.transform(F.sequence(F.lit(0), F.col(n["_n"]) - 1), position)).otherwise(F.array().cast("array<double>"))
    out = put(
        run,
        {
            "size": F.col("size"),
            "source_size": z,
            "target": F.col(n["_target"]),
            "taken": F.col("size") * F.col(n["_e"]) + F.col(n["_more"]),
            "copies": F.col(n["_n"]),
            "first_position": F.when(taken, position(F.lit(0))),
            "positions": positions,
        },
    )
    return out.drop(*n.values())


def in_training_order(mixed: DataFrame) -> DataFrame:
    """The documents the mix takes, range-sorted by training position."""
    return mixed.filter(F.col("copies") > 0).orderBy("first_position")


def copies_in_training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy that training meets, range-sorted by ``position``; a document taken
    several times stands at each of its positions. ``words``: how many of it this copy gives, less
    than all for a last copy that is read in part. Columns of these names are replaced."""
    copy, at = unused(mixed, "_copy", "_at")
    dealt = mixed.filter(F.col("copies") > 0).select("*", F.posexplode("positions").alias(copy, at))
    rest = F.col("taken") - F.col("size") * F.col(copy)
    return put(dealt, {"position": F.col(at), "words": F.least(F.col("size"), rest)}).drop(copy, at).orderBy("position", "doc_id")
