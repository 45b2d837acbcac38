"""Toxicity by a factorization machine over hashed terms.

Besides a weight for each term the model has a short vector for it; the inner product of two
terms' vectors is the weight of their meeting in one document, such as an insult with the
mention of a group, which no sum of single weights can tell apart from either alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm import hashing
from matchgrid.llm.common import put
from matchgrid.llm.quality import labelled_sample, ragged, within

BITS = 18
FACTORS = 8
#: Labelled documents that the model is fitted on, at most: those of the smallest id hashes.
SAMPLE = 12000
#: Different terms of each of them, added up, at most (4 bytes each on the driver); rows past it are left out.
TERMS = 20_000_000
#: Terms get a weight if they stand in this share of the sample's documents, or if they tell the
#: labels apart by themselves (chi-squared with one degree of freedom) and aren't too rare.
FREQUENT = 0.02
CHI2 = 12.0
MIN_DOCS = 3


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, term) of the different terms of each text, in order: runs of letters and
    digits in lower case, hashed into 2**BITS buckets."""
    found = []
    for codes, starts, owners in hashing.batches([t.lower() for t in texts]):
        s, e = hashing.runs(hashing.is_alnum(codes))
        h = hashing.stretch_hashes(codes, s, e) >> np.uint64(64 - BITS)
        owner = owners[np.searchsorted(starts, s, "right") - 1].astype(np.uint64)
        found.append(np.unique((owner << np.uint64(BITS)) | h))
    keys = np.concatenate(found) if found else np.empty(0, np.uint64)
    if len(found) > 1:
        keys = np.unique(keys)
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of n documents from their (document, term) pairs."""
        kept = self.live[term]
        row, term = row[kept], term[kept]
        z = self.bias + np.bincount(row, self.weights[term], n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[term, f]
            z += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return z

    def __post_init__(self) -> None:
        self.live = (self.weights != 0) | (self.vectors != 0).any(1)


def telling(row: np.ndarray, term: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which terms the machine learns weights for."""
    n, ones = len(labels), float(labels.sum())
    df = np.bincount(term, minlength=1 << BITS).astype(float)
    hit = np.bincount(term, labels[row], 1 << BITS)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = n * (hit * n - df * ones) ** 2 / (df * (n - df) * ones * (n - ones))
    return (df >= MIN_DOCS) & ((df >= FREQUENT * n) | (np.nan_to_num(chi2) >= CHI2))


def train(row: np.ndarray, term: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.3, ridge: float = 1e-4, batch: int = 64, emphasis: float = 1.0, seed: int = 0) -> Machine:
    """AdaGrad on the log loss, in which label 1 counts ``emphasis`` times. ``row`` must be sorted."""
    n, size = len(labels), 1 << BITS
    ones = float(labels.sum())
    prior = (ones + 0.5) / (n + 1) if n else 0.5
    machine = Machine(float(np.log(prior / (1 - prior))), np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    if not 0 < ones < n:
        return machine
    rng = np.random.default_rng(seed)
    common = telling(row, term, labels)
    kept = common[term]
    row, term = row[kept], term[kept]
    w, v = machine.weights, machine.vectors
    v[common] = rng.normal(0, 0.02, (int(common.sum()), FACTORS)).astype(np.float32)
    sw, sv = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32)
    bias, sb = machine.bias, 1.0
    starts = np.searchsorted(row, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            ids = order[k : k + batch]
            lens = starts[ids + 1] - starts[ids]
            t = np.concatenate([term[starts[i] : starts[i + 1]] for i in ids])
            r = np.repeat(np.arange(len(ids)), lens)
            vt = v[t]
            sums = np.stack([np.bincount(r, vt[:, f], len(ids)) for f in range(FACTORS)], 1).astype(np.float32)
            squares = np.bincount(r, (vt * vt).sum(1), len(ids))
            z = bias + np.bincount(r, w[t], len(ids)) + 0.5 * ((sums**2).sum(1) - squares)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[ids]).astype(np.float32)
            g *= np.where(labels[ids] == 1, emphasis, 1.0).astype(np.float32)
            u, back = np.unique(t, return_inverse=True)
            gw = np.bincount(back, g[r], len(u)).astype(np.float32) + ridge * w[u]
            gv = g[r, None] * (sums[r] - vt)
            gv = np.stack([np.bincount(back, gv[:, f], len(u)) for f in range(FACTORS)], 1).astype(np.float32) + ridge * v[u]
            sw[u] += gw * gw
            sv[u] += gv * gv
            w[u] -= rate * gw / np.sqrt(sw[u])
            v[u] -= 0.3 * rate * gv / np.sqrt(sv[u])
            gb = float(g.sum())
            sb += gb * gb
            bias -= rate * gb / sb**0.5
    machine.bias = float(bias)
    machine.__post_init__()
    return machine


def score(texts: list[str], machine: Machine) -> np.ndarray:
    """Probability of label 1 of each text."""
    row, term = terms(texts)
    return 1 / (1 + np.exp(-np.clip(machine.raw(row, term, len(texts)), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, most: int = TERMS) -> Machine:
    """The machine of a bounded sample of labelled documents: ``sample`` rows and ``most`` terms at most.
    ``may_learn`` is over the id, named i."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def hashed(texts: pd.Series) -> pd.Series:
        row, term = terms(texts.tolist())
        return pd.Series(np.split(term.astype(np.int32), np.searchsorted(row, np.arange(1, len(texts)))), dtype=object)

    sampled = labelled_sample(docs, labels, label, may_learn, doc_id, text, sample).select("i", "y", hashed("t").alias("t"))
    rows = within(sampled, F.size("t"), most).select("t", "y").toArrow()
    found, labels_ = ragged(rows["t"]), rows["y"].to_numpy().astype(np.int64)
    order = sorted(range(len(found)), key=lambda i: (len(found[i]), int(np.sum(found[i], dtype=np.int64)), int(labels_[i])))
    lengths = [len(found[i]) for i in order]
    term = np.concatenate([found[i] for i in order]) if found else np.empty(0, np.int32)
    return train(np.repeat(np.arange(len(order), dtype=np.int32), lengths), term, labels_[order])


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in the column ``out`` (an existing one is replaced).

    Null and empty texts get the score of no terms; whole texts are scored, in bounded chunks;
    repeated rows get equal scores; nothing is shuffled, and what is sent out is a table of fixed
    size. With no labels, or labels of one kind only, every score is the smoothed share of label 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score(texts.tolist(), sent.value))

    return put(docs, {out: scored(F.coalesce(F.col(text), F.lit("")))})
