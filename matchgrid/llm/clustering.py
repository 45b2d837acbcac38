"""Lloyd's clustering with the dimensions dealt to shards, in whole numbers.

Vectors are cut into blocks of rows and blocks into column shards. In a round each shard of a block
gives its partial distances to the shard's slice of every centroid; they are added by block, and
the nearest centroid goes back to the block's shards, which add up their own columns by cluster. A
shard's new slice needs nothing of the other shards. Only centroids (clusters times dimensions)
pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.llm.common import persist_plan

#: Rows of a block and columns of a shard.
ROWS, COLUMNS = 1024, 16
#: Components as whole numbers stay below this, so that distances are exact in doubles.
LARGEST = 1 << 22


def whole_vectors(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(key, v): vectors of so many components, none null or non-finite, as floor(scale * x).

    A component of LARGEST or more is an error: distances wouldn't be exact any more.
    """
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.col(vector).isNotNull() & (F.size(vector) == dims) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    checked = F.transform(scaled, lambda c: F.when(F.abs(c) < LARGEST, c).otherwise(F.raise_error(F.lit(f"a component of {LARGEST} or more"))).cast("long"))
    return vectors.filter(fine).select(F.col(key).alias("key"), checked.alias("v"))


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and key, in that order (all, if fewer); equal
    hashes by components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in whole.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def _shards(whole: DataFrame, dims: int) -> DataFrame:
    """(block, shard, keys, m): columns of a block as bytes; keys on the first shard only."""
    kind = whole.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            names = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("keys", pa.list_(batch.schema.field("key").type)), ("m", pa.binary())])
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                keys = part.column("key").to_pylist()
                m = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int32)
                starts = range(0, dims, COLUMNS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int32()), pa.array([keys] + [None] * (len(starts) - 1), names.field("keys").type), pa.array([m[:, s : s + COLUMNS].tobytes() for s in starts], pa.binary())],
                    schema=names,
                )
                number += 1

    return whole.mapInArrow(cut, f"block long, shard int, keys array<{kind}>, m binary")


def _matrix(m: bytes, shard: int, dims: int) -> np.ndarray:
    return np.frombuffer(m, np.int32).reshape(-1, min(COLUMNS, dims - shard * COLUMNS)).astype(np.float64)


def _slice(centroids: np.ndarray, shard: int) -> np.ndarray:
    return centroids[:, shard * COLUMNS : (shard + 1) * COLUMNS].astype(np.float64)


def _assigned(shards: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """(block, cluster, distance): the nearest centroid of each row of a block, the smaller number
    on a tie, as 32-bit and 64-bit integers in bytes."""
    k = len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, m in zip(batch.column("shard").to_pylist(), batch.column("m"), strict=True):
                x, c = _matrix(m.as_py(), shard, dims), _slice(centroids, shard)
                d = (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]  # whole numbers below 2**53
                out.append(d.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], names=["block", "d"])

    def nearest(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d.as_py(), np.int64) for d in parts.column("d")).reshape(-1, k)
        cluster = total.argmin(1)
        distance = total[np.arange(len(total)), cluster]
        return pa.table({"block": parts.column("block").slice(0, 1), "cluster": pa.array([cluster.astype(np.int32).tobytes()], pa.binary()), "distance": pa.array([distance.tobytes()], pa.binary())})

    return shards.select("block", "shard", "m").mapInArrow(partial, "block long, d binary").groupBy("block").applyInArrow(nearest, "block long, cluster binary, distance binary")


def _moved(shards: DataFrame, assigned: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """Centroids after a round: each shard adds up its columns by cluster and divides, rounding down.
    Empty clusters stay."""
    k = len(centroids)

    def by_cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, m, cluster in zip(batch.column("shard").to_pylist(), batch.column("m"), batch.column("cluster"), strict=True):
                x, c = _matrix(m.as_py(), shard, dims).astype(np.int64), np.frombuffer(cluster.as_py(), np.int32)
                own = sums.setdefault(shard, np.zeros((k, x.shape[1] + 1), np.int64))
                np.add.at(own, c, np.column_stack([x, np.ones(len(x), np.int64)]))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["shard", "sums"])

    def new_slice(parts: pa.Table) -> pa.Table:
        shard = parts.column("shard")[0].as_py()
        total = sum(np.frombuffer(s.as_py(), np.int64) for s in parts.column("sums")).reshape(k, -1)
        old, n = centroids[:, shard * COLUMNS : (shard + 1) * COLUMNS], total[:, -1:]
        new = np.where(n > 0, total[:, :-1] // np.maximum(n, 1), old)
        return pa.table({"shard": pa.array([shard], pa.int32()), "c": pa.array([np.ascontiguousarray(new).tobytes()], pa.binary())})

    joined = shards.select("block", "shard", "m").join(assigned.select("block", "cluster"), "block")
    slices = joined.select("shard", "m", "cluster").mapInArrow(by_cluster, "shard int, sums binary").groupBy("shard").applyInArrow(new_slice, "shard int, c binary").collect()
    out = centroids.copy()
    for shard, c in slices:
        out[:, shard * COLUMNS : (shard + 1) * COLUMNS] = np.frombuffer(c, np.int64).reshape(k, -1)
    return out


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Null vectors, vectors of another length and those with null or non-finite components take no
    part. Repeated rows and null keys (hashed as empty) count one by one. With fewer than k vectors
    each starts as a centroid. An empty table gives an empty one. Other columns are left out.
    """
    whole = whole_vectors(vectors, key, vector, dims, scale)
    centroids = first_centroids(whole, k, seed)
    kind = whole.schema["key"].dataType.simpleString()
    if not len(centroids):
        return whole.filter("false").select(F.col("key").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    shards = persist_plan(_shards(whole, dims).repartition("block"))
    for _ in range(rounds):
        centroids = _moved(shards, _assigned(shards, centroids, dims), centroids, dims)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, cluster, distance in zip(batch.column("keys"), batch.column("cluster"), batch.column("distance"), strict=True):
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(np.frombuffer(cluster.as_py(), np.int32)), pa.array(np.frombuffer(distance.as_py(), np.int64))], names=["key", "cluster", "distance"])

    last = shards.filter("shard = 0").select("block", "keys").join(_assigned(shards, centroids, dims), "block")
    found = persist_plan(last.select("keys", "cluster", "distance").mapInArrow(rows, f"key {kind}, cluster int, distance long"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # k sums
    table = [(i, inertia.get(i), sum(inertia.values()), name) for i, name in enumerate(names)]
    clusters = found.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
