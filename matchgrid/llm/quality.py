"""Quality classifier over supervised subword embeddings.

A document is the mean of the vectors of its words, neighbouring word pairs and character
n-grams, all hashed into one table. Table and softmax are learned together by stochastic
gradient descent in numpy. For scoring, table times softmax weights folds into one number for
each bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm import hashing
from matchgrid.llm.common import persist_plan, put

BITS = 17
GRAMS = (3, 4)
#: Labelled documents that the model is fitted on, at most: those of the smallest id hashes.
SAMPLE = 2000
#: Terms of all of them together, at most (8 bytes each on the driver); rows past it are left out.
TERMS = 20_000_000


def buckets(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of every word, word pair and character n-gram.

    The hash of a pair is that of the exclusive or of its words', so that all repeats of a word
    share one bucket. N-grams may begin or end with white space but not hold it inside.
    """
    shift = np.uint64(64 - BITS)
    space = hashing.is_space(codes)
    starts, ends = hashing.runs(~space)
    words = hashing.stretch_hashes(codes, starts, ends)
    pairs = (words[1:] ^ words[:-1]) + np.uint64(0x632BE59BD9B4E019)
    hashing.mixed(pairs)
    found, at = [words >> shift, pairs >> shift], [starts, starts[1:]]
    for n in GRAMS:
        h = hashing.gram_hashes(codes, n) >> shift
        ok = np.ones(len(h), bool)
        for i in range(1, n - 1):
            ok &= ~space[i : i + len(h)]
        where = np.flatnonzero(ok)
        found.append(h[where])
        at.append(where)
    return np.concatenate(found).astype(np.int64), np.concatenate(at)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text; their number is bounded by the table."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for codes, starts, owners in hashing.batches(texts):
        found, at = buckets(codes)
        piece = np.searchsorted(starts, at, "right") - 1
        order = np.argsort(piece, kind="stable")
        cuts = np.searchsorted(piece[order], np.arange(1, len(starts)))
        for owner, part in zip(owners, np.split(found[order], cuts), strict=True):
            parts[owner].append(part)
    out = []
    for p in parts:
        out.append(np.unique(np.concatenate(p), return_counts=True) if p else (np.empty(0, np.int64), np.empty(0, np.int64)))
    return out


@dataclass
class Model:
    prior: float
    weights: np.ndarray  # log-odds of each bucket


def train(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, epochs: int = 4, rate: float = 8.0, batch: int = 32, seed: int = 0) -> Model:
    """Stochastic gradient descent on the softmax loss over table and output weights."""
    ones = float(labels.sum())
    prior = (ones + 0.5) / (len(labels) + 1) if len(labels) else 0.5
    if not 0 < ones < len(labels):
        return Model(float(np.log(prior / (1 - prior))), np.zeros(1 << BITS, np.float32))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.log([1 - prior, prior]).astype(np.float32)
    steps, step = epochs * -(-len(found) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(found))
        for k in range(0, len(order), batch):
            ids = order[k : k + batch]
            idx, val = np.concatenate([found[i][0] for i in ids]), np.concatenate([found[i][1] / max(1, found[i][1].sum()) for i in ids]).astype(np.float32)
            row = np.repeat(np.arange(len(ids)), [len(found[i][0]) for i in ids])
            rows = table[idx] * val[:, None]
            mean = np.stack([np.bincount(row, rows[:, j], len(ids)) for j in range(dim)], 1).astype(np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p
            g[np.arange(len(ids)), labels[ids]] -= 1
            lr = rate * (1 - step / steps)
            back = (g @ out.T)[row] * val[:, None]
            out -= lr / len(ids) * (mean.T @ g)
            bias -= lr / len(ids) * 0.1 * g.sum(0)
            used, at = np.unique(idx, return_inverse=True)
            table[used] -= lr * np.stack([np.bincount(at, back[:, j], len(used)) for j in range(dim)], 1).astype(np.float32)
            step += 1
    w = out[:, 1] - out[:, 0]
    return Model(float(bias[1] - bias[0]), (table @ w).astype(np.float32))


def score(texts: list[str], model: Model) -> np.ndarray:
    """Probability of label 1 of each text."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for codes, starts, owners in hashing.batches(texts):
        found, at = buckets(codes)
        piece = np.searchsorted(starts, at, "right") - 1
        total += np.bincount(owners, np.bincount(piece, model.weights[found], len(starts)), len(texts))
        count += np.bincount(owners, np.bincount(piece, minlength=len(starts)), len(texts))
    return 1 / (1 + np.exp(-np.clip(model.prior + total / np.maximum(count, 1), -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, doc_id: str, text: str, sample: int) -> DataFrame:
    """(i, t, y): ids, texts and labels of at most ``sample`` rows, those of the smallest id hashes.

    The labels are cut down before any text is read; ``sample`` bounds what is broadcast. Of the
    texts of a repeated id one is taken, so that it bounds what is returned too.
    """
    some = labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).filter(F.col("i").isNotNull() & F.col("y").isin(0, 1)).distinct()
    some = some.filter(may_learn).orderBy(F.xxhash64("i"), "i", "y").limit(sample)
    texts = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return texts.join(F.broadcast(some), "i").groupBy("i", "y").agg(F.min("t").alias("t")).select("i", "t", F.col("y").cast("int").alias("y"))


def within(rows: DataFrame, terms: Column, most: int) -> DataFrame:
    """The rows of a sample, in the order of their id hashes, that have ``most`` terms at most together:
    what is fetched is bounded by its terms too, however long the texts are. The rows are written
    first, so that only ids and counts are put in order.
    """
    held = persist_plan(rows)
    so_far = Window.orderBy(F.xxhash64("i"), "i", "y").rowsBetween(Window.unboundedPreceding, 0)
    kept = held.select("i", "y", F.sum(terms).over(so_far).alias("n")).filter(F.col("n") <= most).select("i", "y")
    return held.join(F.broadcast(kept), ["i", "y"], "left_semi")


_FEATURES = T.StructType().add("b", T.ArrayType(T.IntegerType())).add("n", T.ArrayType(T.FloatType()))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, most: int = TERMS) -> Model:
    """The model of a bounded sample of labelled documents: ``sample`` rows and ``most`` terms at most.
    ``may_learn`` is over the id, named i."""

    @F.pandas_udf(_FEATURES)
    def hashed(texts: pd.Series) -> pd.DataFrame:
        found = features(texts.tolist())
        return pd.DataFrame({"b": [b.astype(np.int32) for b, _ in found], "n": [n.astype(np.float32) for _, n in found]})

    sampled = labelled_sample(docs, labels, label, may_learn, doc_id, text, sample).select("i", "y", hashed("t").alias("f"))
    rows = within(sampled, F.size("f.b"), most).select("f.b", "f.n", "y").toArrow()
    found = list(zip(ragged(rows["b"]), ragged(rows["n"]), strict=True))
    labels_ = rows["y"].to_numpy().astype(np.int64)
    order = sorted(range(len(found)), key=lambda i: (len(found[i][0]), int(np.sum(found[i][0], dtype=np.int64)), int(labels_[i])))
    return train([found[i] for i in order], labels_[order])


def ragged(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of an Arrow column as slices of one numpy array: nothing becomes Python objects."""
    if not column.num_chunks:
        return []
    flat = pa.concat_arrays(column.chunks)
    offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in zip(offsets, offsets[1:], strict=False)]


def score_quality(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in the column ``out`` (an existing one is replaced).

    Null and empty texts get the prior; whole texts are scored, in bounded chunks; repeated rows
    get equal scores; nothing is shuffled, and what is sent out is one table of fixed size. With
    no labels, or labels of one kind only, every score is the smoothed share of label 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score(texts.tolist(), sent.value))

    return put(docs, {out: scored(F.coalesce(F.col(text), F.lit("")))})
