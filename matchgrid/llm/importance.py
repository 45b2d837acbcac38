"""Importance resampling of documents towards a target: hashed n-gram features, log ratios, Gumbel noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.llm.common import persist_plan
from matchgrid.llm.crc import gram_crcs, words_of

#: Buckets that features are counted in: what the driver gets of any table.
BUCKETS = 10_000


def bucket_counts(texts: DataFrame, text: str, n: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket; null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, crcs in gram_crcs(batch.column(0), n):
                found += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(found)
        yield pa.record_batch({"bucket": pa.array(at, pa.int64()), "n": pa.array(found[at], pa.int64())})

    out = np.zeros(buckets, np.int64)
    rows = texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    for bucket, count_ in rows:
        out[bucket] = count_
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket speaks for the target, in thousandths of the natural logarithm."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1.0) * (s.sum() + len(s)) / ((s + 1.0) * (t.sum() + len(t)))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def with_weights(docs: DataFrame, gain: np.ndarray, key: str, text: str, n: int = 2) -> DataFrame:
    """(key, n_words, n_features, weight): the mean gain of a document's features, rounded down; 0 without any."""
    buckets = np.uint32(len(gain))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size = batch.column(1), batch.num_rows
            total, features = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for owners, crcs in gram_crcs(texts, n):
                features += np.bincount(owners, minlength=size)
                np.add.at(total, owners, gain[crcs % buckets])
            words = np.bincount(words_of(texts)[3], minlength=size)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (words, features, weight)]], names=["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text).mapInArrow(weigh, f"key {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 2, share: tuple[int, int] = (25, 100), least_words: int = 20, seed: int = 7) -> DataFrame:
    """(key, n_features, weight, score, rank) of each document; the drawn ones have a rank, from 1.

    Of the documents of ``least_words`` words or more the given share is drawn, without
    replacement: the highest sums of weight and Gumbel noise, the latter from a hash of seed and
    key, ties to the smaller key (then fewer features; a null key counts as an empty one and comes
    first). Documents of equal key and score have ranks of their own. Null texts have no features.
    An empty target has equal counts for all buckets. Other columns are left out.

    No row is sorted into one task. A score's rank starts after the documents of higher scores,
    which are counted by score: whole numbers of a bounded range, so few. Within a score documents
    are numbered by key; the noise spreads equal weights so that a score holds at most about one in
    2,700 of them.
    """
    gain = gains(bucket_counts(docs, text, n), bucket_counts(target, target_text, n))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    scored = persist_plan(with_weights(docs, gain, key, text, n).withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= least_words
    by_score = scored.filter(able).groupBy("score").agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_score.select("score", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.floor(F.sum("_n").over(Window.partitionBy()) * share[0] / share[1]).alias("_most"))
    within = F.row_number().over(Window.partitionBy("score", "_able").orderBy(F.col("key").asc_nulls_first(), "n_features", "weight"))
    ranked = scored.withColumn("_able", able).join(offsets.filter("_before < _most"), "score", "left")
    place = F.when(F.col("_able"), F.col("_before") + within)
    return ranked.select(F.col("key").alias(key), "n_features", "weight", "score", F.when(place <= F.col("_most"), place).cast("long").alias("rank"))
