"""Exact top-k inner-product search with Fagin's threshold algorithm.

Candidates are dealt into blocks. A block keeps one sorted list per dimension; a query reads the
lists from the end that its own sign prefers, deeper where its weight is larger, and scores each
vector in full when it first meets it. It stops once no vector that it hasn't met can beat its
k-th best score: each component of such a vector is at most what its list gave last, and its norm
at most the largest of the block. There is no other way through a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The heaviest dimension's list is read this many entries at a time at first, then twice as many each time.
FIRST_DEPTH = 16


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as longs; null unless all components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def unmet_limit(weights: np.ndarray, last: np.ndarray, norm: float) -> float:
    """The largest inner product of positive ``weights`` with a vector of components at most
    ``last`` and a norm of at most ``norm``.

    It has the components min(last, l * weights), l as large as the norm allows.
    """
    ratio = np.maximum(last / weights, 0.0)
    order = np.argsort(ratio)
    w, y, r = weights[order], last[order], ratio[order]
    settled = np.concatenate([[0.0], np.cumsum(y * y)])  # squares of components held by their lists
    gained = np.concatenate([[0.0], np.cumsum(w * y)])
    free = np.concatenate([np.cumsum((w * w)[::-1])[::-1], [0.0]])
    over = np.flatnonzero(settled[:-1] + r * r * free[:-1] > norm * norm)
    if not len(over):
        return float(gained[-1])
    i = over[0]
    return float(gained[i] + np.sqrt(max(0.0, norm * norm - settled[i]) * free[i]))


def threshold_search(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """(query index, candidate index, score) of each query's k best in one block, ties to smaller
    ids, and of each query how many candidates it met.

    ``queries`` (q x d) and ``rows`` (n x d) hold integers, ``own`` the ids that a query may not
    return. ``rows`` must be in the order of ``ids``.
    """
    n, d = rows.shape
    exact = np.float64 if max(np.abs(queries).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * max(d, 1) < 2**53 else np.int64
    queries, rows = queries.astype(exact), rows.astype(exact)
    order = np.argsort(rows, axis=0, kind="stable")
    rising = np.ascontiguousarray(order.T, np.int32)  # of each dimension, candidates by component
    values = np.ascontiguousarray(np.take_along_axis(rows, order, axis=0).T)
    norm = float(np.sqrt((rows.astype(np.float64) ** 2).sum(1).max(initial=0.0)))
    out_q, out_c, out_s, out_met = [], [], [], []
    for i, q in enumerate(queries):
        used = np.flatnonzero(q)
        weights = np.abs(q[used]).astype(np.float64)
        down = q[used] > 0
        share = weights / weights.max(initial=1.0)
        unseen = np.ones(n, bool)
        left, depth = n, FIRST_DEPTH
        at = np.zeros(len(used), np.int64)
        best, scores = np.empty(0, np.int64), np.empty(0, exact)
        while left:
            upto = np.minimum(n, np.ceil(depth * share).astype(np.int64))
            if len(used):
                parts = [rising[j, n - b : n - a] if up else rising[j, a:b] for j, up, a, b in zip(used, down, at, upto, strict=True)]
                before = unseen.copy()
                unseen[np.concatenate(parts)] = False
                met = np.flatnonzero(before & ~unseen)
            else:
                met = np.arange(n)  # a query of zeros has no lists to read: all scores are zero
            left = left - len(met) if len(used) else 0
            at, depth = upto, depth * 2
            met = met[ids[met] != own[i]]
            best = np.concatenate([best, met])
            scores = np.concatenate([scores, rows[met] @ q])
            if len(best) > k:
                close = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                best, scores = best[close], scores[close]
                kept = np.lexsort((best, -scores))[:k]
                best, scores = best[kept], scores[kept]
            if len(best) >= k and left:
                last = np.where(down, values[used, n - at], -values[used, at - 1]).astype(np.float64)
                limit = unmet_limit(weights, last, norm)
                if limit + 1e-9 * abs(limit) + 1e-3 < scores.min():
                    break
        out_q.append(np.full(len(best), i))
        out_c.append(best)
        out_s.append(scores)
        out_met.append(n - left)
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s).astype(np.int64), np.array(out_met)


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors of differing length are filled up with zeros."""
    width = max((len(v) for v in vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.stack(vectors.to_numpy()).astype(np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = 1024,
    block_rows: int = 8192,
    query_rows: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every row that ``is_query`` marks.

    Score: inner product of floor(scale * x), in 64-bit integers; ties go to the smaller id.
    Vectors that are null or hold nulls, NaN or infinities take no part; shorter vectors count as
    filled up with zeros; null ids take no part; of rows alike in id and vector each counts.

    Rows with one and the same vector score alike, so only the k + 1 smallest ids of each vector
    can be in a result: the window below drops the others before the shuffle, however many there
    are. Candidates and queries are dealt into blocks of bounded size, each pair of blocks is one
    group, and a query's blocks are merged by rank. The lists of a block are sorted once for each
    ``query_rows`` queries, which is under a hundredth of the search.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(embedding), scale).alias("v"), is_query.alias("q"))
    rows = rows.filter("id is not null and v is not null")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("m")).first()
    blocks, groups = -(-sizes["n"] // block_rows) or 1, -(-sizes["m"] // query_rows) or 1
    alike = Window.partitionBy("v").orderBy("id")
    candidates = rows.withColumn("r", F.row_number().over(alike)).filter(F.col("r") <= k + 1).select("id", "v")
    candidates = candidates.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    queries = rows.filter("q").select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(groups)).cast("int").alias("g"))

    # a partition for each few groups: adaptive coalescing goes by bytes and would leave a handful
    parts = min(blocks * groups, 10_000)
    candidates, queries = candidates.repartition(parts, "b", "g"), queries.repartition(parts, "b", "g")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        right = right.sort_values("id", kind="stable")
        q, c = _matrix(left["v"]), _matrix(right["v"])
        width = max(q.shape[1], c.shape[1])
        q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
        own, ids = left["id"].to_numpy(), right["id"].to_numpy()
        qi, ci, score, _ = threshold_search(q, own, ids, c, k)
        return pd.DataFrame({"query_id": own[qi], "vec_id": ids[ci], "score": score})

    found = queries.groupBy("b", "g").cogroup(candidates.groupBy("b", "g")).applyInPandas(search, "query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
