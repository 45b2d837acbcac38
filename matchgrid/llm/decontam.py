"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A window is embedded by a random walk: step j emits the character under the walk and moves on if
a random bit of (j, character) says so. Walks over strings of small edit distance fall into step
again soon, so that their embeddings differ in few coordinates; a hash of a few sampled
coordinates finds them. A walk that runs through a whole item would stay out of step once edits
come faster than it recovers, so the embedding of a window as long as an item is made of walks
that begin anew at each of its words, and every hash that agrees names the window by where the
item would begin. How many coordinates are sampled and how often the sampling is repeated follows
from a stated recall: items of about one length get the most selective sampling that finds that
share of their own copies with as many edits as are allowed. What collides is verified, first by
bit-parallel edit distance of 64-character segments of all candidates at a time, then by the
exact distance between the item and the best stretch of the document around the collision.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm import hashing
from matchgrid.llm.common import persist_plan, put, unused

#: Edits for each character of an item, at most.
MAX_EDITS = 0.2
#: Share of the copies with that many edits that the sampling is to find.
RECALL = 0.96
#: Repeats of a sampling at most; beyond them a less selective one is taken.
REPEATS = 8
#: Copies of items of a length class that the repeats are measured on, about.
COPIES = 256
#: Shortest lengths of the classes of items.
LENGTHS = (0, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 384)
#: Characters of benchmark items that are sent to the executors at a time.
GROUP_CHARS = 4_000_000
#: Candidates that are verified, and collisions that are listed, at a time.
TOGETHER, LISTED = 4096, 2_000_000
_ODD = np.uint64(hashing.BASE)
_ROOM = 48


@dataclass(frozen=True)
class Sampling:
    """How windows are embedded: steps of a walk, coordinates sampled of it, the steps after which
    walks are given up that no item starts like, how many walks must agree on a window, and whether
    walks begin at each character of items, and of documents too, instead of each word."""

    steps: int
    sampled: int
    early: int
    votes: int = 1
    item_chars: bool = False
    text_chars: bool = False


#: From the most selective on.
SAMPLINGS = (
    Sampling(40, 8, 16, 2),
    Sampling(40, 8, 16),
    Sampling(32, 7, 14),
    Sampling(24, 6, 12),
    Sampling(16, 5, 12, 1, True),
    Sampling(12, 4, 8, 1, True),
    Sampling(10, 4, 8, 1, True, True),
    Sampling(6, 3, 6, 1, True, True),
)


def normal(text: str) -> str:
    """Lower case, with every run of white space turned into one space."""
    return " ".join(text.lower().split())


def symbols(codes: np.ndarray) -> np.ndarray:
    return ((codes ^ (codes >> 8)) & 0xFF).astype(np.uint8)


class Walk:
    def __init__(self, sampling: Sampling, seed: int):
        rng = np.random.default_rng([sampling.steps, seed])
        self.sampled = set(rng.choice(sampling.steps, sampling.sampled, replace=False).tolist())
        self.steps = max(self.sampled) + 1
        self.bits = rng.integers(0, 2, (sampling.steps, 256)).astype(np.int32)

    def run(self, text: np.ndarray, at: np.ndarray, first: int, last: int, h: np.ndarray) -> None:
        """Steps first to last - 1 of the walks at ``at``, which move; their hashes grow in place."""
        c, move = np.empty(len(at), np.uint8), np.empty(len(at), np.int32)
        for j in range(first, min(last, self.steps)):
            np.take(text, at, out=c, mode="clip")
            if j in self.sampled:
                h *= np.uint64(257)
                h += c
            np.take(self.bits[j], c, out=move, mode="clip")
            at += move


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts end to end, with room behind the last, and where each begins."""
    joined = "\n".join(texts) + "\n" + "\0" * _ROOM
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]) if texts else np.empty(0, np.int64)
    return symbols(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)), starts.astype(np.int64)


def _starts(text: np.ndarray, size: int, chars: bool) -> np.ndarray:
    """Where walks begin: at each word, or at each character."""
    gap = (text[:size] == 32) | (text[:size] == 10)
    if chars:
        return np.flatnonzero(text[:size] != 10).astype(np.int32)
    return np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])).astype(np.int32)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of all positions from lo to hi - 1 of each row."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(row))


@dataclass
class Table:
    """The hashes of one walk over items."""

    walk: Walk
    early: np.ndarray  # which 16-bit early hashes occur
    present: np.ndarray  # which 20-bit hashes occur
    hashes: np.ndarray  # sorted
    items: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(walk: Walk, sampling: Sampling, texts: list[str], names: np.ndarray) -> Table:
        """``names`` are the items that the texts are."""
        laid, starts = _laid(texts)
        at = _starts(laid, len(laid) - _ROOM, sampling.item_chars)
        item = np.searchsorted(starts, at, "right") - 1
        ends = np.append(starts[1:], len(laid) - _ROOM) - 1
        kept = ends[item] - at >= min(sampling.steps * 3 // 4, 4) if len(at) else np.empty(0, bool)
        at, item = at[kept], item[kept]
        pos, h = at.copy(), np.zeros(len(at), np.uint64)
        walk.run(laid, pos, 0, sampling.early, h)
        early, present = np.zeros(1 << 16, bool), np.zeros(1 << 20, bool)
        early[((h + np.uint64(1)) * _ODD >> np.uint64(48)).astype(np.int64)] = True
        walk.run(laid, pos, sampling.early, sampling.steps, h)
        present[((h + np.uint64(1)) * _ODD >> np.uint64(44)).astype(np.int64)] = True
        order = np.argsort(h, kind="stable")
        return Table(walk, early, present, h[order], names[item[order]].astype(np.int32), (at - starts[item])[order].astype(np.int32))

    def meet(self, laid: np.ndarray, windows: np.ndarray, sampling: Sampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that meet an item, and from where to where in the table."""
        pos, h = windows.copy(), np.zeros(len(windows), np.uint64)
        self.walk.run(laid, pos, 0, sampling.early, h)
        alive = np.flatnonzero(self.early[((h + np.uint64(1)) * _ODD >> np.uint64(48)).astype(np.int64)])
        pos, h = pos[alive], h[alive]
        self.walk.run(laid, pos, sampling.early, sampling.steps, h)
        there = np.flatnonzero(self.present[((h + np.uint64(1)) * _ODD >> np.uint64(44)).astype(np.int64)])
        h, alive = h[there], alive[there]
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        hit = np.flatnonzero(hi > lo)
        return windows[alive[hit]], lo[hit], hi[hit]


def edited(text: str, edits: int, rng: np.random.Generator) -> str:
    """A copy with so many single characters replaced, put in or taken out at random."""
    chars = list(text)
    for _ in range(edits):
        i, kind = int(rng.integers(len(chars) + 1)), int(rng.integers(3))
        c = text[int(rng.integers(len(text)))]
        if kind == 0:
            chars.insert(i, c)
        elif i < len(chars) and kind == 1:
            chars[i] = c
        elif i < len(chars) and len(chars) > 1:
            del chars[i]
    return "".join(chars)


def repeats_for(texts: list[str], max_edits: float, recall: float = RECALL, samplings: tuple[Sampling, ...] = SAMPLINGS) -> tuple[Sampling, int]:
    """The first sampling, and its repeats, that find this share of edited copies of the texts."""
    rng = np.random.default_rng(len(texts))
    some = [texts[i] for i in np.linspace(0, len(texts) - 1, min(len(texts), COPIES // 2)).astype(int)]
    # between other words, as in a document
    copies = [(i, f"{some[i - 1][-24:]} {edited(t, int(max_edits * len(t)), rng)} {some[i - 1][:24]}") for i, t in enumerate(some) for _ in range(-(-COPIES // len(some)))]
    laid, starts = _laid([c for _, c in copies])
    target = np.array([i for i, _ in copies])
    widths = _widths(some)
    best = (0.0, samplings[-1], REPEATS)
    for sampling in samplings:
        windows = _starts(laid, len(laid) - _ROOM, sampling.text_chars)
        rows, counts, share = np.empty((0, 3), np.int64), np.empty(0, np.int64), 0.0
        for r in range(REPEATS):
            table = Table.of(Walk(sampling, r), sampling, some, np.arange(len(some)))
            at, lo, hi = table.meet(laid, windows, sampling)
            row, which = _spread(lo, hi)
            copy = np.searchsorted(starts, at[row], "right") - 1
            mine = np.flatnonzero(table.items[which] == target[copy])
            more = np.stack([copy[mine], target[copy[mine]], at[row[mine]] - starts[copy[mine]] - table.offsets[which[mine]]], 1)
            rows, counts = _counted(np.concatenate([rows, more]), np.concatenate([counts, np.ones(len(more), np.int64)]), widths)
            share = len(np.unique(rows[_agreed(rows, counts, widths, sampling.votes), 0])) / len(copies)
            if share >= recall:
                return sampling, r + 1
        if share > best[0]:
            best = (share, sampling, REPEATS)
    return best[1], best[2]


@dataclass
class Index:
    """The embedded items of one group."""

    ids: list
    texts: list[str]
    max_edits: float
    whole: list[int] = field(default_factory=list)  # too short for any edit
    levels: list[tuple[Sampling, list[Table]]] = field(default_factory=list)
    measured: dict[int, tuple[Sampling, int]] = field(default_factory=dict)  # by shortest length of a class

    @staticmethod
    def of(ids: list, texts: list[str], max_edits: float = MAX_EDITS, recall: float = RECALL) -> Index:
        index = Index(ids, [normal(t) for t in texts], max_edits)
        lengths = np.array([len(t) for t in index.texts], np.int64)
        limits = (max_edits * lengths).astype(np.int64)
        index.whole = np.flatnonzero((limits == 0) & (lengths > 0)).tolist()
        kinds = np.searchsorted(LENGTHS, lengths, "right") - 1
        by_sampling: dict[Sampling, list[tuple[int, np.ndarray]]] = {}
        for kind in np.unique(kinds[limits > 0]):
            names = np.flatnonzero((kinds == kind) & (limits > 0))
            sampling, repeats = repeats_for([index.texts[i] for i in names], max_edits, recall)
            index.measured[LENGTHS[kind]] = sampling, repeats
            by_sampling.setdefault(sampling, []).append((repeats, names))
        for sampling, classes in by_sampling.items():
            tables = []
            for r in range(max(n for n, _ in classes)):
                names = np.concatenate([x for n, x in classes if n > r])
                tables.append(Table.of(Walk(sampling, r), sampling, [index.texts[i] for i in names], names))
            index.levels.append((sampling, tables))
        return index

    def candidates(self, texts: list[str]) -> np.ndarray:
        """Rows (text, item, place), sorted: where enough hashes say that an item may begin. Places
        of the same width are listed once."""
        found = [np.empty((0, 3), np.int64)]
        done = np.zeros(len(texts), np.int64)
        widths = _widths(self.texts)
        for codes, starts, owners in hashing.batches(texts):
            laid = np.concatenate([symbols(codes), np.zeros(_ROOM, np.uint8)])
            base = np.zeros(len(starts), np.int64)
            for i, (o, n) in enumerate(zip(owners, np.diff(np.append(starts, len(codes))) - 1, strict=True)):
                base[i] = done[o]
                done[o] += n
            for sampling, tables in self.levels:
                windows = _starts(laid, len(codes), sampling.text_chars)
                rows, counts = np.empty((0, 3), np.int64), np.empty(0, np.int64)
                for table in tables:
                    at, lo, hi = table.meet(laid, windows, sampling)
                    cuts = np.searchsorted(np.cumsum(hi - lo), np.arange(LISTED, int((hi - lo).sum()) + LISTED, LISTED)).tolist()
                    for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
                        row, which = _spread(lo[a:b], hi[a:b])
                        start = at[a:b][row]
                        piece = np.searchsorted(starts, start, "right") - 1
                        place = start - starts[piece] + base[piece] - table.offsets[which]
                        more = np.stack([owners[piece], table.items[which].astype(np.int64), place], 1)
                        rows, counts = _counted(np.concatenate([rows, more]), np.concatenate([counts, np.ones(len(more), np.int64)]), widths)
                found.append(rows[_agreed(rows, counts, widths, sampling.votes)])
        rows = np.concatenate(found)
        return _counted(rows, np.ones(len(rows), np.int64), widths)[0]


def _widths(texts: list[str]) -> np.ndarray:
    """Places of an item in a text that are verified together, of each item."""
    return np.maximum(4, np.array([len(t) for t in texts], np.int64) // 8)


def _bins(rows: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """A number for each (text, item, place by width); those of places next to each other differ by one."""
    bins = rows[:, 2] // widths[rows[:, 1]]
    low = bins.min(initial=0)
    return (rows[:, 0] * len(widths) + rows[:, 1]) * (int(bins.max(initial=0) - low) + 2) + (bins - low)


def _counted(rows: np.ndarray, counts: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each bin, with the sum of its counts, in order."""
    _, first, which = np.unique(_bins(rows, widths), return_index=True, return_inverse=True)
    return rows[first], np.bincount(which, counts, len(first)).astype(np.int64)


def _agreed(rows: np.ndarray, counts: np.ndarray, widths: np.ndarray, votes: int) -> np.ndarray:
    """Which of the rows, in order, have enough votes together with the bin before or behind."""
    if votes == 1 or not len(rows):
        return np.ones(len(rows), bool)
    near = np.diff(_bins(rows, widths)) == 1
    behind = np.append(np.where(near, counts[1:], 0), 0)
    before = np.concatenate([[0], np.where(near, counts[:-1], 0)])
    return counts + np.maximum(before, behind) >= votes


def segments(text: str) -> list[tuple[int, int]]:
    """(offset, length) of the nearly equal parts of at most 64 characters."""
    parts = -(-len(text) // 64)
    edges = [len(text) * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def plausible(texts: list[str], index: Index, rows: np.ndarray) -> np.ndarray:
    """Which candidates have a segment within its share of the edits near its place.

    If no segment has, the edits of all add up to more than the item may have, so nothing is lost.
    Myers' columns of all candidates are kept in one array of 64-bit integers; characters are
    folded to 256 symbols, which can only bring strings closer.
    """
    kept = np.zeros(len(rows), bool)
    lengths = np.array([len(index.texts[i]) for i in rows[:, 1]], np.int64)
    order = np.argsort(lengths, kind="stable")
    for first in range(0, len(order), TOGETHER):
        some = order[first : first + TOGETHER]
        part, n = rows[some], lengths[some]
        slack = (index.max_edits * n).astype(np.int64) + _widths(index.texts)[part[:, 1]]
        wide = int((n + 2 * slack).max())
        begin = part[:, 2] - slack
        cut = "".join(("\0" * max(0, -b) + texts[t][max(0, b) : max(0, b + wide)])[:wide].ljust(wide, "\0") for t, b in zip(part[:, 0].tolist(), begin.tolist(), strict=True))
        window = symbols(np.frombuffer(cut.encode("utf-32-le", "surrogatepass"), np.uint32)).reshape(len(part), wide)
        items, which = np.unique(part[:, 1], return_inverse=True)
        cuts = [segments(index.texts[i]) for i in items]
        owner = np.repeat(np.arange(len(items)), [len(c) for c in cuts])
        offset, size = np.array([x for c in cuts for x in c], np.int64).T
        shapes = np.zeros((len(owner), 256), np.uint64)
        letters = "".join(index.texts[items[o]][a : a + m].ljust(64, "\0") for o, a, m in zip(owner.tolist(), offset.tolist(), size.tolist(), strict=True))
        letters = symbols(np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)).reshape(len(owner), 64)
        for j in range(64):
            inside = np.flatnonzero(size > j)
            shapes[inside, letters[inside, j]] |= np.uint64(1 << j)
        ends = np.cumsum([len(c) for c in cuts])
        row, seg = _spread((ends - [len(c) for c in cuts])[which], ends[which])  # each candidate with its segments
        top = (size[seg] - 1).astype(np.uint64)
        score = size[seg].copy()
        least = score.copy()
        pv, mv = np.full(len(row), ~np.uint64(0)), np.zeros(len(row), np.uint64)
        start, one = offset[seg], np.uint64(1)
        reach = size[seg] + 2 * slack[row]
        flat, base = window.ravel(), row * wide + start
        last = len(flat) - 1
        for j in range(int(reach.max())):
            eq = shapes[seg, flat[np.minimum(base + j, last)]]
            eq[j >= reach] = 0
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            score += (ph >> top & one).astype(np.int64) - (mh >> top & one).astype(np.int64)
            ph <<= one
            mh <<= one
            pv = mh | ~(xv | ph)
            mv = ph & xv
            np.minimum(least, score, out=least)
        good = least <= (index.max_edits * size[seg]).astype(np.int64)
        kept[some[np.unique(row[good])]] = True
    return kept


def best_distance(pattern: str, text: str, limit: int) -> int:
    """Least edit distance between the pattern and any stretch of the text; limit + 1 if greater.

    Myers' bit-parallel columns in one integer as wide as the pattern.
    """
    n = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best = full, 0, n, n
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a stretch may begin anywhere
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best = score
    return best if best <= limit else limit + 1


def leaks(texts: list[str], index: Index) -> list[list[tuple]]:
    """(item id, distance) of each item in each text."""
    texts = [normal(t) for t in texts]
    best: list[dict[int, int]] = [{} for _ in texts]
    rows = index.candidates(texts)
    for doc, item, place in rows[plausible(texts, index, rows)].tolist():
        known = best[doc].get(item)
        if known == 0:
            continue
        pattern, text = index.texts[item], texts[doc]
        limit = int(index.max_edits * len(pattern))
        slack = limit + max(4, len(pattern) // 8)
        near = text[max(0, place - slack) : max(0, place + len(pattern) + slack)]
        d = 0 if pattern in near else best_distance(pattern, near, limit)
        if d <= limit and (known is None or d < known):
            best[doc][item] = d
    for item in index.whole:
        pattern = f" {index.texts[item]} "
        for doc, text in enumerate(texts):
            if pattern in f" {text} ":
                best[doc][item] = 0
    return [sorted((index.ids[i], d) for i, d in b.items()) for b in best]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leaks", max_edits: float = MAX_EDITS, group_chars: int = GROUP_CHARS
) -> DataFrame:
    """``docs`` with the column ``out``: array of (item_id, distance) of the items they hold, the
    distance being that of the best stretch that was found.

    A document holds an item if some stretch of it is within ``max_edits`` edits per character of
    the item, both in lower case and with runs of white space as one space. An item too short for
    one edit is held where its words stand in the text. Null and empty texts and items match
    nothing; equal items are reported each; documents are scanned whole, where they lie, and
    repeated rows get equal results. Items are sent out in groups of at most ``group_chars``
    characters (but for one longer item) and about 30 times as many bytes, one group at a time. One
    group needs no shuffle. Each of several is a job of its own over the documents that writes what
    it finds, by a key of the text, before its index goes; what all found is joined to the
    documents. A column named like ``out`` is replaced.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and length(trim(t)) > 0")
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_chars))
    schema = T.ArrayType(T.StructType().add("item_id", T.LongType()).add("distance", T.IntegerType()))

    def scan(index):
        @F.pandas_udf(schema)
        def found(texts: pd.Series) -> pd.Series:
            values, result = texts.tolist(), []
            for at in range(0, len(values), 512):
                result += [[{"item_id": i, "distance": d} for i, d in x] for x in leaks(values[at : at + 512], index.value)]
            return pd.Series(result, dtype=object)

        return found(F.coalesce(F.col(text), F.lit("")))

    def index_of(g: int):
        part = items.filter(F.pmod(F.xxhash64("i"), F.lit(groups)) == g).orderBy("i", "t").collect()
        return docs.sparkSession.sparkContext.broadcast(Index.of([r["i"] for r in part], [r["t"] for r in part], max_edits))

    if groups == 1:
        return put(docs, {out: scan(index_of(0))})
    passes = []
    for g in range(groups):
        index = index_of(g)
        passes.append(persist_plan(docs.select(_text_key(text).alias("k"), F.explode(scan(index)).alias("leak")).distinct()))
        index.destroy()  # no worker holds two
    by_text = reduce(DataFrame.union, passes).groupBy("k").agg(F.array_sort(F.collect_list("leak")).alias("found"))
    key, other, found = unused(docs, "_key", "_other", "_found")
    joined = docs.withColumn(key, _text_key(text)).join(by_text.select(F.col("k").alias(other), F.col("found").alias(found)), F.col(key) == F.col(other), "left")
    return put(joined, {out: F.coalesce(F.col(found), F.array().cast(schema))}).drop(key, other, found)


def _text_key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))
