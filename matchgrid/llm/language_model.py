"""Scores texts by an n-gram language model with deleted interpolation.

P_n(w | context) = l_n(b) * c(context w) / c(context) + (1 - l_n(b)) * P_{n-1}(w | shorter context),
from P_0 = 1 / (V + 1) up. The weight l_n depends on the context's frequency through its bucket b,
the binary logarithm of the count. Counts come from nine tenths of the training documents (by a
hash of the text, so that equal texts go together) while the weights are learned by expectation
maximisation on the rest; then all training documents count.

How the counts meet the texts. Documents are laid out in blocks of about BLOCK tokens, as numbers
into the block's list of word hashes. Each block asks once for each different n-gram that it holds,
and adds how often it stands in training documents of the block: however frequent an n-gram is, it
costs a block one entry. Questions are dealt by ranges of the 64-bit n-gram hash; the task of a
range adds up the counts of all blocks and answers each block in the order it asked. So no key is
hot, no task sees more than about RANGE questions, and the driver sees sums and weights only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm.common import persist_plan
from matchgrid.llm.hashing import CHUNK, is_space, mixed, runs, stretch_hashes

#: Tokens of a block, and questions to a range of hashes (expected; hashes are even).
BLOCK = 2_000_000
RANGE = 4_000_000
#: One in so many training documents is held out for the weights.
HELD = 10
#: Rounds at most; they end once a held-out token's log probability gains less than this.
ROUNDS, GAIN = 20, 1e-4
#: Weights stay inside these bounds, so that no text has the probability 0.
LEAST, MOST = 0.001, 0.999
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(r"[\x20\x09-\x0D]")
#: What a document does: it is scored only, gives counts, or gives counts for the weights.
SCORED, COUNTED, WEIGHED = 0, 1, 2
#: Different words, then tokens and documents that give counts and that give counts for the weights.
STATS = ("words", "n_counted", "n_weighed", "docs_counted", "docs_weighed")


# -- packed integers ---------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit integers as bytes. Bytes of equal weight stand together, so zeros vanish."""
    out = [np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()]
    out += [np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    sizes, at, out = raw[8 : 8 * (n + 1)].view(np.int64), 8 * (n + 1), []
    for size in sizes.tolist():
        out.append(np.ascontiguousarray(raw[at : at + 8 * size].reshape(8, size).T).view(np.int64).reshape(-1))
        at += 8 * size
    return out


# -- tokens ------------------------------------------------------------------------------------


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about CHUNK characters that end at white space: no word is cut."""
    at = 0
    while len(text) - at > CHUNK:
        space = _SPACE.search(text, at + CHUNK)
        if space is None:
            break
        yield text[at : space.end()]
        at = space.end()
    yield text[at:]


def word_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of the words of a text with A-Z in lower case, in pieces."""
    for piece in _pieces(text):
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        codes[(codes >= 65) & (codes <= 90)] += 32
        yield stretch_hashes(codes, *runs(~is_space(codes)))


def _token_runs(texts: list[str]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(index of the text, hashes of its next tokens, whether they end it); short texts are hashed together."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < CHUNK):
            size += len(texts[stop]) + 1
            stop += 1
        if stop == at + 1:
            *early, last = word_hashes(texts[at])
            for hashes in early:
                yield at, hashes, False
            yield at, np.append(last, END), True
        else:
            codes = np.frombuffer("\n".join(texts[at:stop]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
            codes[(codes >= 65) & (codes <= 90)] += 32
            starts, ends = runs(~is_space(codes))
            hashes = stretch_hashes(codes, starts, ends)
            first = np.cumsum([0] + [len(x) + 1 for x in texts[at:stop]])
            cuts = np.searchsorted(starts, first)
            for i in range(stop - at):
                yield at + i, np.append(hashes[cuts[i] : cuts[i + 1]], END), True
        at = stop


class _Block:
    """Tokens of documents laid end to end. A document that goes on from an earlier block starts
    with its last order - 1 tokens there, which are looked up but neither counted nor scored."""

    def __init__(self) -> None:
        self.tokens: list[np.ndarray] = []
        self.size = 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # document, kind, tokens, place of the first, tokens seen before
        self.keys: list = []

    def add(self, uid: int, key, kind: int, tokens: np.ndarray, place: int, seen: int) -> None:
        self.tokens.append(tokens)
        self.size += len(tokens)
        self.rows.append((uid, kind, len(tokens), place, seen))
        self.keys.append(key)

    def row(self, block: int) -> tuple[int, list, int, bytes]:
        words, numbers = np.unique(np.concatenate(self.tokens), return_inverse=True)
        columns = np.array(self.rows, np.int64).T
        return block, self.keys, self.size, pack(*columns, np.diff(words, prepend=np.uint64(0)).view(np.int64), numbers)


def _blocks(docs: DataFrame, order: int, key_type: T.DataType) -> DataFrame:
    """(block, keys, size, data); needs columns key, text, kind.

    Documents for the weights have blocks of their own, of odd numbers.
    """

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, uid, made, open_ = TaskContext.get().partitionId() << 32, 0, 0, [_Block(), _Block()]
        names = None

        def close(weighed: int) -> pa.RecordBatch:
            nonlocal made
            row = open_[weighed].row(base + 2 * made + weighed)
            made, open_[weighed] = made + 1, _Block()
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, names, strict=True)], schema=names)

        for batch in batches:
            names = pa.schema([("block", pa.int64()), ("keys", pa.list_(batch.schema.field("key").type)), ("size", pa.int64()), ("data", pa.binary())])
            keys, kinds = batch.column("key").to_pylist(), batch.column("kind").to_pylist()
            texts = [x or "" for x in batch.column("text").to_pylist()]
            before, place = np.empty(0, np.uint64), 0
            for i, tokens, ends in _token_runs(texts):
                weighed, at = int(kinds[i] == WEIGHED), 0
                while at < len(tokens):
                    block = open_[weighed]
                    took = tokens[at : at + max(1, BLOCK - block.size)]
                    both = np.concatenate([before, took])
                    block.add(base + uid, keys[i], kinds[i], both, place - len(before), len(before))
                    at, place = at + len(took), place + len(took)
                    before = both[len(both) - min(place, order - 1) :]
                    if block.size >= BLOCK:
                        yield close(weighed)
                if ends:
                    before, place, uid = np.empty(0, np.uint64), 0, uid + 1
        yield from (close(w) for w in (0, 1) if open_[w].rows)

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(key_type)), T.StructField("size", T.LongType()), T.StructField("data", T.BinaryType())])
    return docs.mapInArrow(lay_out, schema)


class _Tokens:
    """A block unpacked: one entry for each token."""

    def __init__(self, data: bytes, order: int):
        self.uid, kind, size, place, seen, words, self.number = unpack(data)
        self.words = np.cumsum(words.view(np.uint64), dtype=np.uint64)
        starts = np.cumsum(size) - size
        within = np.arange(len(self.number)) - np.repeat(starts, size)
        self.row = np.repeat(np.arange(len(size)), size)
        self.place = within + np.repeat(place, size)  # in the document
        self.counts = within >= np.repeat(seen, size)
        self.kind = np.repeat(kind, size)
        self.within, self.order = within, order

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length from 1: the different n-grams' hashes in order, the number of each token's
        n-gram among them, and which tokens have one. What stands before a document is START."""
        yield self.words, self.number, np.ones(len(self.number), bool)
        word = self.words[self.number]
        last, has_last = word, np.ones(len(word), bool)
        for n in range(2, self.order + 1):
            before = np.concatenate([[START], last[:-1]])
            has = np.concatenate([[False], has_last[:-1]]) & (self.within > 0)
            if n == 2:
                before[self.place == 0] = START
                has |= self.place == 0
            last = mixed((before + np.uint64(n)) * _STEP + word)
            has_last = has
            at = np.flatnonzero(has)
            ordered = at[np.argsort(last[at])]
            new = np.ones(len(ordered), bool)
            new[1:] = last[ordered[1:]] != last[ordered[:-1]]
            number = np.zeros(len(last), np.int64)
            number[ordered] = np.cumsum(new) - 1
            yield last[ordered[new]], number, has


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Number of the range that each hash is in; grows with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _answers(blocks: DataFrame, order: int, ranges: int) -> DataFrame:
    """(block, range, data, *STATS): for each length the counts in both parts of
    the training documents of the n-grams that the block asked for in that range, in its order.
    The other columns, on one row of each range, add up to V and to the tokens and documents of both parts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                tokens, questions = _Tokens(data.as_py(), order), []
                for hashes, number, has in tokens.grams():
                    has = has & tokens.counts
                    counts = [np.bincount(number[has & (tokens.kind == kind)], minlength=len(hashes)) for kind in (COUNTED, WEIGHED)]
                    questions.append((hashes, *counts, np.searchsorted(_range_of(hashes, ranges), np.arange(ranges + 1, dtype=np.uint64))))
                rows = []
                for r in range(ranges):
                    parts = []
                    for hashes, counted, weighed, cut in questions:
                        span = slice(cut[r], cut[r + 1])
                        parts += [np.diff(hashes[span], prepend=np.uint64(0)).view(np.int64), counted[span], weighed[span]]
                    if any(len(x) for x in parts):
                        rows.append({"range": r, "block": block, "data": pack(*parts)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("range", pa.int64()), ("block", pa.int64()), ("data", pa.binary())]))

    def add_up(asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("block")
        parts = [unpack(x.as_py()) for x in asked.column("data")]
        out = [[] for _ in parts]
        totals = np.zeros(len(STATS), np.int64)
        for n in range(order):
            hashes = np.concatenate([np.cumsum(p[3 * n].view(np.uint64), dtype=np.uint64) for p in parts])
            if not len(hashes):
                for o in out:
                    o += [np.empty(0, np.int64)] * 2
                continue
            ordered = np.argsort(hashes)
            new = np.ones(len(ordered), bool)
            new[1:] = hashes[ordered[1:]] != hashes[ordered[:-1]]
            number = np.empty(len(ordered), np.int64)
            number[ordered] = np.cumsum(new) - 1
            ends = np.cumsum([len(p[3 * n]) for p in parts])[:-1]
            sums = [np.add.reduceat(np.concatenate([p[3 * n + k] for p in parts])[ordered], np.flatnonzero(new)) for k in (1, 2)]
            if n == 0:
                end = np.flatnonzero(hashes[ordered][new] == END)
                totals[:] = np.count_nonzero(sums[0] + sums[1]), sums[0].sum(), sums[1].sum(), sums[0][end].sum(), sums[1][end].sum()
            for o, a, b in zip(out, np.split(sums[0][number], ends), np.split(sums[1][number], ends), strict=True):
                o += [a, b]
        stats = [pa.array([int(t)] + [0] * (len(parts) - 1), pa.int64()) for t in totals]
        return pa.table([asked.column("block"), asked.column("range"), pa.array([pack(*o) for o in out], pa.binary()), *stats], names=["block", "range", "data", *STATS])

    asked = blocks.select("block", "data").mapInArrow(ask, "range long, block long, data binary")
    return asked.groupBy("range").applyInArrow(add_up, "block long, range long, data binary, " + ", ".join(f"{c} long" for c in STATS))


def _counts(tokens: _Tokens, answers: pa.Table, part: int | None, n_docs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1: count of each token's n-gram and of its context, the latter 0 where
    there is none (and for single words, whose context is everything). part: COUNTED, or None for all;
    n_docs: its documents, the count of START."""
    found = [unpack(x.as_py()) for x in answers.sort_by("range").column("data")]
    before = None
    for n, (_, number, has) in enumerate(tokens.grams()):
        total = np.concatenate([p[2 * n] if part == COUNTED else p[2 * n] + p[2 * n + 1] for p in found])
        c = np.where(has, total[number], 0)
        context = np.zeros(len(c), np.int64)
        if n:
            context[1:] = np.where(tokens.within[1:] > 0, before[:-1], 0)
        if n == 1:
            context[tokens.place == 0] = n_docs
        yield c, np.where(has, context, 0)
        before = c


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for a context that never occurs, else one more than the binary logarithm, rounded down."""
    return np.frexp(count.astype(np.float64))[1]


def interpolated(counts: list[tuple[np.ndarray, np.ndarray]], n_tokens: int, n_words: int, weights: np.ndarray) -> np.ndarray:
    """Probability of each token; weights[n - 1, bucket] belongs to the n-grams of length n."""
    p = np.full(len(counts[0][0]), 1.0 / (n_words + 1))
    for n, (c, context) in enumerate(counts):
        context = np.full(len(c), n_tokens) if n == 0 else context
        weight = np.where(context > 0, weights[n][bucket_of(context)], 0.0)
        p = weight * (c / np.maximum(context, 1)) + (1.0 - weight) * p
    return p


def expected(frequencies: np.ndarray, buckets: np.ndarray, n_words: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(taken, offered, log probability): how many of the held-out tokens each weight is expected to
    take from its level, how many it is offered, and what all of them have now. Rows of both
    arguments are the lengths from 1."""
    order = len(frequencies)
    lam = np.stack([np.where(buckets[n] > 0, weights[n][buckets[n]], 0.0) for n in range(order)])
    share, rest = np.empty((order + 1, frequencies.shape[1])), np.ones(frequencies.shape[1])
    for n in range(order - 1, -1, -1):
        share[n + 1] = rest * lam[n] * frequencies[n]
        rest = rest * (1.0 - lam[n])
    share[0] = rest / (n_words + 1)
    total = share.sum(0)
    share /= total
    below = np.cumsum(share, 0)
    size = weights.shape[1]
    taken = np.stack([np.bincount(buckets[n], share[n + 1], size) for n in range(order)])
    offered = np.stack([np.bincount(buckets[n], below[n + 1], size) for n in range(order)])
    return taken, offered, float(np.log(total).sum())


def _learn_weights(joined, order: int, n_counted: int, n_docs: int, n_words: int) -> np.ndarray:
    """Weights by length and bucket, learned on the held-out part; 1/2 where it has no example.

    A round's result is rounded to nine places, so that reruns agree whatever the order of addition.
    """

    def examples(block: pa.Table, answers: pa.Table) -> pa.Table:
        f, b = [], []
        for data in block.column("data"):
            tokens = _Tokens(data.as_py(), order)
            at = tokens.counts & (tokens.kind == WEIGHED)
            if not at.any():
                continue
            for n, (c, context) in enumerate(_counts(tokens, answers, COUNTED, n_docs)):
                context = np.full(at.sum(), n_counted) if n == 0 else context[at]
                f.append(c[at] / np.maximum(context, 1))
                b.append(bucket_of(context))
        if not f:
            return pa.table({"f": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        return pa.table({"f": pa.array([np.stack(f).astype(np.float32).tobytes()], pa.binary()), "b": pa.array([np.stack(b).astype(np.uint8).tobytes()], pa.binary())})

    held = persist_plan(joined.applyInArrow(examples, "f binary, b binary"))
    weights, last = np.full((order, 65), 0.5), -np.inf
    for _ in range(ROUNDS):

        def one_round(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            taken, offered, log, n = np.zeros(weights.shape), np.zeros(weights.shape), 0.0, 0
            for batch in batches:
                for f, b in zip(batch.column("f"), batch.column("b"), strict=True):
                    frequencies = np.frombuffer(f.as_py(), np.float32).reshape(order, -1).astype(np.float64)
                    t, o, p = expected(frequencies, np.frombuffer(b.as_py(), np.uint8).reshape(order, -1), n_words, weights)
                    taken, offered, log, n = taken + t, offered + o, log + p, n + frequencies.shape[1]
            if n:  # the last row has the log probability and the tokens
                yield pa.record_batch({"i": pa.array(range(weights.size + 1), pa.int64()), "taken": pa.array([*taken.ravel(), log]), "offered": pa.array([*offered.ravel(), float(n)])})

        found = held.mapInArrow(one_round, "i long, taken double, offered double").groupBy("i").agg(F.sum("taken").alias("taken"), F.sum("offered").alias("offered")).collect()
        now = -np.inf
        learned = weights.copy()
        for i, taken, offered in found:
            if i == weights.size:
                now = taken / offered
            elif offered > 0:
                learned.flat[i] = round(min(max(taken / offered, LEAST), MOST), 9)
        weights = learned
        if not now - last >= GAIN:  # nothing held out counts as no gain
            break
        last = now
    return weights


def score_texts(docs: DataFrame, learns: Column, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score), one row for each document.

    ``learns``: which documents the model learns from (null: not). Tokens are the words with A-Z in
    lower case, and one end. ``base_score`` is the additive unigram score, ``score`` the model's
    log10 probability. n-grams are told apart by 64-bit hashes. A null text counts as empty: one
    token, the end. Repeated documents, null keys and repeated keys are rows of their own. With
    nothing to learn from all scores are log10(1) = 0. An empty table gives an empty one. Other columns of
    ``docs`` are left out. A document longer than a block is continued in the next one.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    key_type = docs.schema[key].dataType
    part = F.when(F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(HELD)) == 0, WEIGHED).otherwise(COUNTED)
    kind = F.when(F.coalesce(learns, F.lit(False)), part).otherwise(SCORED)
    ready = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), kind.cast("int").alias("kind"))
    blocks = persist_plan(_blocks(ready, order, key_type))
    n = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    answers = persist_plan(_answers(blocks, order, 1 + order * n // RANGE))
    stats = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATS]).first()
    n_words, n_tokens, n_docs = stats["words"], stats["n_counted"] + stats["n_weighed"], stats["docs_counted"] + stats["docs_weighed"]

    def joined(which: Column):
        answered = answers.filter(which).select("block", "range", "data").groupBy("block")
        return blocks.filter(which).groupBy("block").cogroup(answered)

    weights = _learn_weights(joined(F.col("block") % 2 == 1), order, stats["n_counted"], stats["docs_counted"], n_words)

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        (data,), (keys,) = block.column("data"), block.column("keys")
        tokens = _Tokens(data.as_py(), order)
        counts = list(_counts(tokens, answers, None, n_docs))
        own = tokens.counts
        logs = np.log10(interpolated(counts, n_tokens, n_words, weights))
        base = np.log10((counts[0][0] + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
        rows, size = tokens.row, len(tokens.uid)
        sums = [np.bincount(rows, own, size), np.bincount(rows, own & (counts[0][0] > 0), size), np.bincount(rows, base * own, size), np.bincount(rows, logs * own, size)]
        return pa.table([pa.array(tokens.uid), keys.values, *[pa.array(x.astype(np.int64)) for x in sums[:2]], *[pa.array(x) for x in sums[2:]]], names=["uid", "key", "n_tokens", "n_known", "base_score", "score"])

    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("key", key_type)] + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")])
    scored = joined(F.lit(True)).applyInArrow(score, schema).groupBy("uid").agg(F.first("key").alias("key"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return scored.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
