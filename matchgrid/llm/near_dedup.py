"""Near-duplicate documents by improved consistent weighted sampling.

A document is a weighted set of five-word shingles: how often one occurs, times the mean inverse
document frequency of its words. Consistent weighted samples of two sets agree with the
probability of their weighted Jaccard similarity; samples are banded, documents that share a
band are candidates, and every candidate is verified by its exact weighted Jaccard similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm import hashing
from matchgrid.llm.common import WORD, matching, persist_plan, unused
from matchgrid.llm.components import components

WORDS = 5
SIMILARITY = 0.8
#: At similarity 0.8, 12 bands of 3 samples find a pair with a probability of 0.9998.
BANDS, ROWS = 12, 3
#: Document frequencies are counted in 2**IDF_BITS buckets of word hashes: a table of fixed size.
IDF_BITS = 20
#: Texts of a band of more texts than this are compared by blocks, those of a smaller one by pairs.
FEW = 8
#: Texts and characters of a block, about.
BLOCK_TEXTS, BLOCK_CHARS = 1024, 8_000_000
#: Shingles that are multiplied at a time.
COLUMNS = 2048
_STEP = 1 << 16


def _pieces(text: str) -> Iterator[str]:
    """Bounded pieces of a text; each begins with the last words of the one before."""
    tail = ""
    for piece in hashing.pieces(text):
        yield tail + piece
        tail = " ".join(re.findall(WORD, tail + piece)[1 - WORDS :]) + " " if len(text) > hashing.CHUNK else ""


def _words(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, hash) of the words of bounded batches, in order."""
    owners: list[int] = []
    parts: list[str] = []
    for i, t in enumerate(texts):
        for p in _pieces(t.lower()):
            owners.append(i)
            parts.append(p)
    for codes, starts, index in hashing.batches(parts, 2 * hashing.CHUNK):
        s, e = hashing.runs(~hashing.is_space(codes))
        yield np.array(owners)[index[np.searchsorted(starts, s, "right") - 1]] if len(s) else np.empty(0, np.int64), hashing.stretch_hashes(codes, s, e), index[np.searchsorted(starts, s, "right") - 1]


def shingles(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, weight) of the different shingles, in order of owner and shingle.

    A text of fewer than five words is one shingle; one without words has none.
    """
    keys, weights = [], []
    multipliers = [np.uint64(pow(hashing.BASE, j + 1, 1 << 64)) for j in range(WORDS)]
    for owner, h, piece in _words(texts):
        if not len(h):
            continue
        value = idf[(h >> np.uint64(64 - IDF_BITS)).astype(np.int64)]
        edge = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        length = np.diff(np.concatenate([edge, [len(h)]]))
        n = np.minimum(length, WORDS)
        last = np.repeat(edge + length, length)
        at = np.arange(len(h))
        full = at + WORDS <= last
        total, sums = np.zeros(len(h), np.uint64), np.zeros(len(h))
        for j in range(WORDS):
            m = len(h) - j
            total[:m] += h[j:] * multipliers[j]
            sums[:m] += value[j:]
        short = np.flatnonzero(length < WORDS)
        for k in short:  # few: whole texts of under five words
            a, b = edge[k], edge[k] + length[k]
            with np.errstate(over="ignore"):
                total[a] = np.sum(h[a:b] * np.array(multipliers[: n[k]], np.uint64), dtype=np.uint64)
            sums[a] = value[a:b].mean() * WORDS
            full[a] = True
        total = hashing.mixed(total[full])
        keys.append((owner[full].astype(np.uint64) << np.uint64(48)) | (total >> np.uint64(16)))
        weights.append(sums[full] / WORDS)
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.add.reduceat(weight, first)
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), weight


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 2**16 steps: r, 1 / r and log c of consistent weighted sampling."""
    p = (np.arange(_STEP) + 0.5) / _STEP
    x = np.full(_STEP, 2.0)
    low, high = np.zeros(_STEP), np.full(_STEP, 40.0)
    for _ in range(60):  # bisection of 1 - (1 + x) exp(-x) = p
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return x.astype(np.float32), (1 / x).astype(np.float32), np.log(x).astype(np.float32)


_GAMMA: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def samples(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, count: int) -> np.ndarray:
    """count consistent weighted samples of each of n sets, as 32-bit fingerprints of (shingle, t).

    For each shingle and sample, 16-bit slices of one hash pick r and c of Gamma(2, 1) and beta
    of the uniform distribution; t = floor(log(w) / r + beta), and the shingle of the least
    log a = log c - r (t - beta + 1) is the sample. Sets without shingles get zeros.
    """
    if not _GAMMA:
        _GAMMA.append(_tables())
    gamma, inverse, log_c = _GAMMA[0]
    out = np.zeros((n, count), np.uint32)
    if not len(owner):
        return out
    log_w = np.log(weight).astype(np.float32)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    # whole sets, about 64 thousand shingles at a time, so that the arrays stay in the cache
    cuts, at = [0], 0
    for i, s in enumerate(starts):
        if s - at > 1 << 16:
            cuts.append(i)
            at = s
    cuts.append(len(starts))
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        lo, hi = starts[a], starts[b] if b < len(starts) else len(owner)
        h, lw, local = shingle[lo:hi], log_w[lo:hi], starts[a:b] - lo
        name = h >> np.uint64(8)
        for k in range(count):
            g = h * np.uint64((2 * k + 1) * hashing.BASE & (1 << 64) - 1)
            g ^= g >> np.uint64(32)
            g *= np.uint64(0xD6E8FEB86659FD93)
            g ^= g >> np.uint64(32)
            v = g.view(np.uint16).reshape(-1, 4)
            r = v[:, 0]
            beta = v[:, 2] * np.float32(2**-16)
            t = np.floor(lw * inverse[r] + beta)
            log_a = log_c[v[:, 1]] - gamma[r] * (t - beta + np.float32(1))
            bits = log_a.view(np.int32)
            rank = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) + (1 << 31)
            print_ = (name + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
            least = np.minimum.reduceat((rank.astype(np.uint64) << np.uint64(32)) | print_, local)
            out[owner[starts[a:b]], k] = least.astype(np.uint32)
    return out


def bands(texts: list[str], idf: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> list[list[int]]:
    """The band hashes of each text; none for a text without words."""
    owner, shingle, weight = shingles(texts, idf)
    s = samples(owner, shingle, weight, len(texts), n_bands * rows).astype(np.uint64).reshape(len(texts), n_bands, rows)
    h = np.arange(n_bands, dtype=np.uint64)[None, :] * np.uint64(0x632BE59BD9B4E019) + np.uint64(1)
    for j in range(rows):
        h = hashing.mixed((h + s[:, :, j]) * np.uint64(hashing.BASE))
    has = np.zeros(len(texts), bool)
    has[owner] = True
    return [x.tolist() if y else [] for x, y in zip(h.view(np.int64), has, strict=True)]


def similarities(left: list[str], right: list[str], idf: np.ndarray) -> np.ndarray:
    """Exact weighted Jaccard similarity of each pair of texts."""
    names = {t: i for i, t in enumerate(dict.fromkeys([*left, *right]))}
    texts = list(names)
    owner, shingle, weight = shingles(texts, idf)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = np.zeros(len(left))
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        a, b = names[a], names[b]
        sa, sb = slice(cuts[a], cuts[a + 1]), slice(cuts[b], cuts[b + 1])
        _, x, y = np.intersect1d(shingle[sa], shingle[sb], assume_unique=True, return_indices=True)
        least = np.minimum(weight[sa][x], weight[sb][y]).sum()
        most = weight[sa].sum() + weight[sb].sum() - least
        out[i] = least / most if most > 0 else 0.0
    return out


def block_links(texts: list[str], labels: list, idf: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of texts that are similar enough and join all labels that any such pair joins.

    All pairs of differing labels are compared, exactly: a shingle is one column for each weight
    it has, as heavy as that weight is above the next smaller one, so that what two texts share
    is a product of matrices.
    """
    names = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    label = np.array([names[x] for x in labels])
    if len(names) < 2:
        return []
    rows = np.flatnonzero(label != np.bincount(label).argmax())  # one of each pair isn't of the commonest label
    owner, shingle, weight = shingles(texts, idf)
    size = np.bincount(owner, weight, len(texts))
    order = np.lexsort((weight, shingle))
    owner, shingle, weight = owner[order], shingle[order], weight[order]
    new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
    level = new | np.concatenate([[True], weight[1:] != weight[:-1]])
    column = np.cumsum(level) - 1  # of each entry the one of its own weight
    height = weight[level] - np.where(new[level], 0.0, np.concatenate([[0.0], weight[level][:-1]]))
    lowest = np.maximum.accumulate(np.where(new, column, 0))
    times = column - lowest + 1
    entry = np.repeat(np.arange(len(owner)), times)
    column = lowest[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
    owner = owner[entry]
    met = np.bincount(column, minlength=len(height)) > 1
    kept = met[column]
    column, owner = (np.cumsum(met) - 1)[column[kept]], owner[kept]
    height = np.sqrt(height[met])
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((len(rows), len(texts)))
    for first in range(0, len(height), COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(texts), min(COLUMNS, len(height) - first)))
        part[owner[lo:hi], column[lo:hi] - first] = height[column[lo:hi]]
        shared += part[rows] @ part.T
    union = size[rows, None] + size[None, :] - shared
    alike = (shared >= similarity * union) & (union > 0) & (label[rows, None] != label[None, :])
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for r, c in zip(*np.nonzero(alike), strict=True):
        a, b = root(label[rows[r]]), root(label[c])
        if a != b:
            parent[a] = b
            out.append((int(rows[r]), int(c)))
    return out


def inverse_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """1 + log((1 + documents) / (1 + documents with the word)) / log(2 + documents), over all rows.

    Scaled to between 1 and 2, so that no rare word outweighs a shared sentence.
    """
    schema = T.StructType().add("b", T.IntegerType()).add("n", T.LongType())

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, docs_seen = np.zeros(1 << IDF_BITS, np.int64), 0
        for p in parts:
            texts = p["t"].tolist()
            docs_seen += len(texts)
            for at in range(0, len(texts), 256):
                seen = [np.empty(0, np.uint64)]
                for owner, h, _ in _words(texts[at : at + 256]):
                    seen.append(np.unique((owner.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(64 - IDF_BITS))))
                keys = np.unique(np.concatenate(seen)) & np.uint64((1 << IDF_BITS) - 1)
                total += np.bincount(keys.astype(np.int64), minlength=1 << IDF_BITS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"b": np.append(used, -1).astype(np.int32), "n": np.append(total[used], docs_seen)})

    counts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(count, schema).groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << IDF_BITS)
    b, n = counts["b"].to_numpy(), counts["n"].to_numpy()  # columns, never rows of Python objects
    table[b[b >= 0]] = n[b >= 0]
    size = n[b < 0].sum()
    return (1 + np.log((1 + size) / (1 + table)) / np.log(2 + size)).astype(np.float32)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, copy_key, copy_of, class_id, class_size): one row for each row of ``docs``.

    copy_key is the hash of the text, copy_of the smallest id of an equal text, class_id the
    smallest id of the near-duplicate class, its connected component under verified links.

    Equal texts are one node, so a group of copies of any size costs one row. Documents that
    share a band are compared with one centre for each band first; then all texts of a band that
    this leaves apart are compared with each other, however many they are: in small bands by
    pairs, in large ones by blocks, each pair of which is one group. Null and empty texts (without words) are never duplicates
    of each other and form a class each by row content: their class_id is their own id. Null ids
    count as larger than others; repeated rows are copies; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(source, "t"))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def banded(texts: pd.Series) -> pd.Series:
        out: list[list[int]] = []
        values = texts.tolist()
        for at in range(0, len(values), 512):
            some = values[at : at + 512]
            index = {t: i for i, t in enumerate(dict.fromkeys(some))}
            found = bands(list(index), idf.value)
            out += [found[index[t]] for t in some]
        return pd.Series(out, dtype=object)

    @F.pandas_udf(T.DoubleType())
    def compared(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(left), 256):
            out.append(similarities(left.iloc[at : at + 256].tolist(), right.iloc[at : at + 256].tolist(), idf.value))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    signed = persist_plan(source.select("doc_id", F.md5("t").alias("k"), F.length("t").alias("chars"), banded("t").alias("bands")))
    texts = signed.filter(F.size("bands") > 0).groupBy("k").agg(F.first("bands").alias("bands"), F.first("chars").alias("chars"))
    members = persist_plan(texts.select("k", F.explode("bands").alias("b")))
    shared = persist_plan(members.join(members.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1"), "b"))
    # the centre of a band is the text that meets most others in all its bands: of a group of
    # edited copies that is what they were made from, or what is closest to it
    known = shared.groupBy("k").agg(F.sum("n").alias("known"))
    centres = shared.join(known, "k").groupBy("b").agg(F.max(F.struct("known", "k")).alias("m")).select("b", F.col("m.k").alias("c"))
    shared = persist_plan(shared.select("b", "k").join(centres, "b"))
    pairs = shared.filter("k <> c").select("k", "c").distinct()

    def verified(candidates: DataFrame) -> DataFrame:
        """The pairs (k, c) that are similar enough."""
        candidates = persist_plan(candidates)
        ends = persist_plan(candidates.select("k").union(candidates.select("c")).distinct())
        bodies = persist_plan(_bodies(source, ends))
        both = candidates.join(bodies, "k").withColumnRenamed("t", "ta").join(bodies.select(F.col("k").alias("c"), F.col("t").alias("tb")), "c")
        return both.select("k", "c", compared("ta", "tb").alias("j")).filter(F.col("j") >= similarity).select("k", "c")

    links = persist_plan(verified(pairs))
    label = components(links.select(F.col("k").alias("u"), F.col("c").alias("v")))
    placed = shared.join(label.select(F.col("u").alias("k"), F.col("v").alias("x")), "k", "left").withColumn("x", F.coalesce("x", "k"))
    placed = placed.join(texts.select("k", "chars"), "k")
    apart = placed.groupBy("b").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min("x").alias("low"), F.max("x").alias("high")).filter("n > 2 and low <> high")
    placed = persist_plan(placed.select("b", "k", "x").join(apart.select("b", "n", "chars"), "b"))
    few = placed.filter(F.col("n") <= FEW).select("b", "k", "x")
    near = few.join(few.select("b", F.col("k").alias("c"), F.col("x").alias("cx")), "b").filter("k > c and x <> cx").select("k", "c").distinct()
    compared_before = pairs.select(F.greatest("k", "c").alias("k"), F.least("k", "c").alias("c"))
    more = persist_plan(near.join(compared_before, ["k", "c"], "left_anti"))
    crowd = placed.filter(F.col("n") > FEW)
    found = []
    if not more.isEmpty():
        found.append(persist_plan(verified(more)))
    if not crowd.isEmpty():
        found.append(persist_plan(_compared_by_blocks(crowd, source, idf, similarity)))
    found = [f for f in found if not f.isEmpty()]
    if found:
        for f in found:
            links = links.union(f)
        label = components(links.select(F.col("k").alias("u"), F.col("c").alias("v")))
    nodes = signed.groupBy("k").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"), F.first(F.size("bands")).alias("s"))
    nodes = nodes.join(label.select(F.col("u").alias("k"), F.col("v").alias("x")), "k", "left").withColumn("x", F.coalesce("x", "k"))
    classes = nodes.groupBy("x").agg(F.min("copy_of").alias("class_id"), F.sum("copies").alias("class_size"))
    named = nodes.join(classes, "x").select("k", "copy_of", "class_id", "class_size", "s")
    empty = F.col("s") == 0
    return signed.select("doc_id", "k").join(named, "k").select(
        "doc_id",
        F.col("k").alias("copy_key"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
    )


def _bodies(source: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, t): the text of each key. Copies are put together before they are shuffled."""
    return matching(source.select(F.md5("t").alias("k"), "t"), keys, ["k"]).groupBy("k").agg(F.first("t").alias("t"))


def _compared_by_blocks(crowd: DataFrame, source: DataFrame, idf, similarity: float) -> DataFrame:
    """Links (k, c) between texts of differing x in each band b of (b, k, x, n, chars)."""
    bodies = _bodies(source, persist_plan(crowd.select("k").distinct()))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    dealt = crowd.select("b", "k", "x", blocks.alias("m")).withColumn("p", F.pmod(F.xxhash64("k"), F.col("m")).cast("int"))
    # a block meets itself and each other one
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("b", "k", "x", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).join(persist_plan(bodies), "k")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        k = rows["k"].tolist()
        out = block_links(rows["t"].tolist(), rows["x"].tolist(), idf.value, similarity)
        return pd.DataFrame([(k[a], k[b]) for a, b in out], columns=["k", "c"], dtype=object)

    return dealt.groupBy("b", "i", "j").applyInPandas(search, "k string, c string")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near-duplicates: of each class the document of the smallest id stays.

    Documents without words all stay; of repeated rows one stays.
    """
    found = near_duplicates(docs, text, doc_id, similarity)
    k, i, n = unused(docs, "_k", "_i", "_n")

    def name(id_: Column) -> Column:
        """Ids as text, so that null is one too; a document's name goes with its text's key."""
        return F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("null"))

    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("copy_key").alias(k), name(F.col("doc_id")).alias(i)).distinct()
    body = F.coalesce(F.col(text), F.lit(""))
    kept = matching(docs.select("*", F.md5(body).alias(k), name(F.col(doc_id)).alias(i)), persist_plan(stay), [k, i])
    wordless = ~body.rlike(r"[^\x20\x09-\x0D]")
    # only rows alike in id and text are left to choose from
    first = kept.filter(~wordless).withColumn(n, F.row_number().over(Window.partitionBy(k, i).orderBy(k))).filter(F.col(n) == 1).drop(n)
    return first.unionByName(kept.filter(wordless)).select(*[f"`{c}`" for c in docs.columns])
