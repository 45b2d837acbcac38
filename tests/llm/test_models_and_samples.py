"""Language model scores, importance resampling and clustering against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm import clustering, crc, importance, language_model
from matchgrid.llm import queries as Q

DATA = "/root/testdata/sf0.001"
WORDS = "the of and river Stone quiet garden été yellow 東京 market under seven lamps across winter song".split()
SPACES = [" ", "  ", "\n", "\t", "\x0b", "\xa0 "]


def some_texts(rng: random.Random, n: int, size: int = 40) -> list[str | None]:
    texts: list[str | None] = ["".join(rng.choice(WORDS) + rng.choice(SPACES) for _ in range(rng.randrange(size))) for _ in range(n)]
    return texts + texts[:3] + ["", None, "   \n ", "?!", "x" * 5000, "the"]


# -- 11: language model ------------------------------------------------------------------------


def tokens_of(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "</s>"]


def grams_of(tokens: list[str], order: int):
    """(place, n, n-gram) of all n-grams; the first word of a text has a start before it."""
    line = ["<s>", *tokens]
    for t in range(len(tokens)):
        yield t, 1, (tokens[t],)
        for n in range(2, order + 1):
            if t + 2 - n >= 0:
                yield t, n, tuple(line[t + 2 - n : t + 2])


def brute_scores(texts, kinds, order):
    """Scores by dictionaries; kinds as the operator's."""
    docs = [tokens_of(t) for t in texts]

    def count(which):
        out = Counter(g for d, k in zip(docs, kinds, strict=True) if k in which for _, _, g in grams_of(d, order))
        out["<s>",] = sum(k in which for k in kinds)
        return out, sum(len(d) for d, k in zip(docs, kinds, strict=True) if k in which)

    part, n_part = count({1})
    every, n_all = count({1, 2})
    n_words = len({t for d, k in zip(docs, kinds, strict=True) if k for t in d})
    weights = np.full((order, 65), 0.5)

    def levels(counts, total, d):
        found = [[] for _ in d]
        for t, n, g in grams_of(d, order):
            c = total if n == 1 else counts[g[:-1]]
            found[t].append((n, 0 if c == 0 else int(math.log2(c)) + 1, counts[g] / max(c, 1)))
        return found

    held = [x for d, k in zip(docs, kinds, strict=True) if k == 2 for x in levels(part, n_part, d)]
    last = -math.inf
    for _ in range(language_model.ROUNDS):
        taken, offered, log = np.zeros(weights.shape), np.zeros(weights.shape), 0.0
        for found in held:
            shares, rest = {}, 1.0
            for n, b, f in reversed(found):
                w = weights[n - 1, b] if b else 0.0
                shares[n] = rest * w * f
                rest *= 1.0 - w
            base = rest / (n_words + 1)
            total = base + sum(shares.values())
            log += math.log(total)
            below = base
            for n, b, _ in found:
                below += shares[n]
                taken[n - 1, b] += shares[n] / total
                offered[n - 1, b] += below / total
        now = log / len(held) if held else -math.inf
        weights = np.where(offered > 0, np.clip(taken / np.where(offered > 0, offered, 1), language_model.LEAST, language_model.MOST), weights)
        if not now - last >= language_model.GAIN:
            break
        last = now
    out = []
    for d in docs:
        score = base_score = 0.0
        for token, found in zip(d, levels(every, n_all, d), strict=True):
            p = 1.0 / (n_words + 1)
            for n, b, f in found:
                w = weights[n - 1, b] if b else 0.0
                p = w * f + (1 - w) * p
            score += math.log10(p)
            base_score += math.log10((every[token,] + 0.5) / (n_all + 0.5 * (n_words + 1)))
        out.append((len(d), sum(every[t,] > 0 for t in d), n_all, base_score, score))
    return out


def check_scores(spark, order, n=120):
    texts = some_texts(random.Random(order), n)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    learns = F.col("i") % 4 != 1
    part = F.when(F.pmod(F.xxhash64(F.coalesce("body", F.lit(""))), F.lit(language_model.HELD)) == 0, 2).otherwise(1)
    kinds = [r[0] for r in df.orderBy("i").select(F.when(learns, part).otherwise(0)).collect()]
    got = {r[0]: r[1:] for r in language_model.score_texts(df, learns, "i", "body", order).collect()}
    want = brute_scores(texts, kinds, order)
    assert 2 in kinds and len(got) == len(texts)
    for i, row in enumerate(want):
        assert got[i][:3] == row[:3]
        assert got[i][3:] == pytest.approx(row[3:], rel=2e-4)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_is_the_plain_one(spark, order):
    check_scores(spark, order)


def test_documents_go_on_over_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK", 37)
    monkeypatch.setattr(language_model, "RANGE", 300)
    check_scores(spark, 3, 60)


def test_language_model_edges(spark):
    schema = "doc_id string, text string, score string, block int"
    rows = [(None, "a b", "x", 1), ("k", None, "x", 1), ("k", "a b", "x", 1), ("k", "a b", "x", 1)]
    df = spark.createDataFrame(rows, schema)
    out = language_model.score_texts(df, F.lit(True)).collect()
    assert sorted(r["n_tokens"] for r in out) == [1, 3, 3, 3] and sum(r["doc_id"] is None for r in out) == 1
    assert {r["train_tokens"] for r in out} == {10}
    nothing = language_model.score_texts(df, F.lit(None).cast("boolean")).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in nothing) and len(nothing) == 4
    assert language_model.score_texts(spark.createDataFrame([], schema), F.lit(True)).count() == 0


def test_long_texts_are_cut_at_spaces_only():
    text = "word " * 300_000 + "x" * 3_000_000 + " end"
    hashes = np.concatenate(list(language_model.word_hashes(text)))
    assert len(hashes) == 300_002 and len(np.unique(hashes)) == 3
    runs = list(language_model._token_runs(["a b", text, "", "END of"]))
    assert [(i, ends) for i, _, ends in runs if ends] == [(0, True), (1, True), (2, True), (3, True)]
    assert sum(len(t) for i, t, _ in runs if i == 1) == 300_003


def test_packed_integers_come_back():
    rng = np.random.default_rng(5)
    arrays = [rng.integers(-(1 << 62), 1 << 62, n) for n in (0, 1, 7, 1000)] + [np.zeros(5, np.int64)]
    for a, b in zip(arrays, language_model.unpack(language_model.pack(*arrays)), strict=True):
        assert np.array_equal(a, b)


def test_op11_learns_from_the_training_fold_only(spark):
    got = Q.op11_language_model(spark, DATA)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    train = Counter(t for i, x in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens_of(x))
    total, rows = sum(train.values()), got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        tokens = tokens_of(docs[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(train[t] > 0 for t in tokens), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[t] + 0.5) / (total + 0.5 * (len(train) + 1))) for t in tokens))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # two words tell more than one


# -- 12: importance resampling -----------------------------------------------------------------


def plain_words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text: str | None, n: int) -> list[int]:
    words = plain_words(text)
    return sorted(zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(words) - k + 1))


@pytest.mark.parametrize("n", [1, 2, 4])
def test_crcs_of_all_n_grams(n, monkeypatch):
    rng = random.Random(n)
    monkeypatch.setattr(crc, "WORDS", 13)
    texts = some_texts(rng, 60) + ["a" * 1000 + " b " + "ü" * 700, "Zz-9_é東", "x\x7fy\x00z"]
    array = pa.array(["skipped first", *texts]).slice(1)
    got: dict[int, list[int]] = {i: [] for i in range(len(texts))}
    for owners, crcs in crc.gram_crcs(array, n):
        for o, c in zip(owners.tolist(), crcs.tolist(), strict=True):
            got[o].append(c)
    for i, text in enumerate(texts):
        assert sorted(got[i]) == features(text, n)


def test_running_registers_and_shifts():
    data = np.random.default_rng(3).integers(0, 256, 5000, dtype=np.uint8)
    registers = crc.running(data)
    for a, b in [(0, 5000), (0, 0), (17, 18), (255, 257), (256, 512), (1000, 4999)]:
        own = registers[b : b + 1] ^ crc.shifted(registers[a : a + 1] ^ crc.FULL, np.array([b - a])) ^ crc.FULL
        assert int(own[0]) == zlib.crc32(data[a:b].tobytes())


def brute_resample(rows, targets, seed=7):
    source, target = Counter(), Counter()
    for _, text in rows:
        source.update(c % 10000 for c in features(text, 2))
    for text in targets:
        target.update(c % 10000 for c in features(text, 2))
    S, total = sum(source.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (S + 10000) / ((source[b] + 1) * (total + 10000)))) for b in source}
    out = []
    import hashlib

    for key, text in rows:
        f = features(text, 2)
        weight = sum(gain[c % 10000] for c in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(f), weight, score, len(plain_words(text)) >= 20])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0]))
    ranks = {x[0]: i + 1 for i, x in enumerate(able[: 25 * len(able) // 100])}
    return sorted((x[0], x[1], x[2], x[3], ranks.get(x[0])) for x in out)


def test_resampling_is_the_plain_one(spark):
    rng = random.Random(12)
    rows = list(enumerate(some_texts(rng, 150, 60)))
    targets = ["the river under the Stone", "quiet garden quiet garden", None, "東京 market"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("_n", F.lit(1)).repartition(3)
    bench = spark.createDataFrame([(t,) for t in targets], "text string")
    got = importance.resample(docs, bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute_resample(rows, targets)


def test_resampling_edges(spark):
    schema = "doc_id long, text string"
    long = "word " * 25
    docs = spark.createDataFrame([(1, long)] * 8 + [(None, long), (None, None)], schema)
    none = spark.createDataFrame([], "text string")
    got = importance.resample(docs, none).collect()
    assert len(got) == 10 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    assert importance.resample(spark.createDataFrame([], schema), none).count() == 0


def test_op12_runs_over_all_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = sorted(map(tuple, Q.op12_importance(spark, DATA).collect()), key=lambda r: r[0])
    assert got == brute_resample(docs, bench)


# -- 13: clustering ----------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims, scale=256, seed=2):
    import hashlib

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept))[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        found = [near(v)[0] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), f in zip(kept, found, strict=True) if f == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, c, d in last:
        total[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, total[c], sum(total.values()), names[c]) for i, c, d in last)


@pytest.mark.parametrize(("dims", "k", "n"), [(64, 7, 150), (20, 5, 40), (5, 9, 6)])
def test_clusters_are_lloyds(spark, monkeypatch, dims, k, n):
    monkeypatch.setattr(clustering, "ROWS", 11)
    rng = random.Random(dims)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.3, rng.gauss(0, 1)]) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(3)]
    odd = [(900, None), (901, [0.5] * (dims - 1)), (902, [None] + [0.5] * (dims - 1)), (903, [math.nan] + [0.5] * (dims - 1)), (904, [math.inf] + [0.5] * (dims - 1)), (905, [])]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType())])
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows + odd], schema).repartition(3)
    got = clustering.cluster_vectors(df, "id", "v", k, rounds=3, dims=dims)
    assert sorted(map(tuple, got.collect())) == brute_clusters(rows + odd, k, 3, dims)


def test_cluster_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clustering.cluster_vectors(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustering.cluster_vectors(empty).count() == 0
    same = spark.createDataFrame([(None, [1.0] * 64)] * 5, "vec_id long, embedding array<float>")
    assert [(r["cluster"], r["distance"]) for r in clustering.cluster_vectors(same).collect()] == [(0, 0)] * 5
    with pytest.raises(Exception, match="component of"):
        clustering.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()


def test_op13_is_lloyds_on_all_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted(map(tuple, Q.op13_clusters(spark, DATA).collect())) == brute_clusters(rows, 40, 5, 64)
