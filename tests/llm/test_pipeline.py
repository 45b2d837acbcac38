"""The pipeline on 300 documents, each stage against brute force over what the one before kept."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchgrid.llm import decontam, toxicity
from tests.llm.test_corpus import brute_classes, brute_lines, prose

SHARED = "this passage stands in many documents and is much longer than twenty characters"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(30)
    items = [(i, prose(rng, rng.randrange(8, 30))) for i in range(12)]
    docs, labels = [], []
    for i in range(300):
        lines = [prose(rng, 25) for _ in range(3)]
        toxic = rng.random() < 0.2
        if toxic:
            lines[1] += " you wretched vermin"
        if i % 7 == 0:
            lines.insert(1, SHARED)
        if i % 23 == 5:
            lines[2] += " " + items[i % 12][1] + " " + prose(rng, 5)
        if i % 11 == 3:  # a near copy of the one before
            lines = [line.replace(" ", "  ", 1) for line in docs[-1][1].split("\n")]
            lines[-1] += " w0"
        docs.append((i, "\n".join(lines), "en", rng.choice(["a", "b", "c", None]), 0))
        labels.append((i, 1, int("vermin" in docs[-1][1])))
    docs += [(300, None, "en", "a", 0), (301, "", "en", "b", 0), (302, docs[0][1], "en", "a", 0), (303, SHARED, "en", "a", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def table(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    kept = {"start": spark.read.parquet(f"{sf_dir}/documents.parquet")}
    docs = kept["start"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
    start, clean, lines, unique, held = (kept[k] for k in ("start", "toxicity", "line dedup", "near-duplicates", "decontamination"))
    for df in (clean, lines, unique, held):
        assert df.columns == start.columns
    # toxicity: what the machine, fitted outside the held-out fold, rejects goes; it is right about nearly all
    machine = toxicity.fit(start, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.crc32(F.col("i").cast("string")) % 5 != 0)
    ids, texts = zip(*[(i, t or "") for i, t in table(start).items()], strict=True)
    score = dict(zip(ids, toxicity.score(list(texts), machine), strict=True))
    assert set(table(clean)) == {i for i, p in score.items() if p < 0.5}
    held_out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    bad, good = ([score[i] for i in held_out if ("vermin" in texts[ids.index(i)]) == toxic] for toxic in (True, False))
    assert np.mean([x > y for x in bad for y in good]) > 0.9
    # lines
    want = brute_lines({i: t for i, t in table(clean).items() if t is not None})
    before = table(clean)
    got = table(lines)
    assert {i: t for i, t in got.items() if t is not None} == {i: t for i, t in want.items() if t.strip() or t == before[i]}
    assert 300 in got and 303 not in got
    assert all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in lines.collect())
    # near-duplicates: of each class the smallest id stays, with its text
    classes = brute_classes(lines, sorted(got.items()))
    assert table(unique) == {i: got[i] for i in got if classes[i] == i}
    # decontamination
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()

    def holds(text):
        return any(decontam.best_distance(decontam.normal(r["text"]), decontam.normal(text or ""), len(r["text"])) <= int(0.2 * len(decontam.normal(r["text"]))) for r in items)

    assert table(held) == {i: t for i, t in table(unique).items() if not holds(t)}
    # mixing: the whole run's rows are those of the stages
    mixed = kept["mixing"].collect()
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in mixed) == sorted(r["doc_id"] for r in whole)
    texts = table(held)
    total = sum(len((t or "").split()) for t in texts.values())
    assert abs(sum(r["taken"] for r in mixed) - total) <= 4
    for r in mixed:
        assert r["size"] == len(texts[r["doc_id"]].split()) and 0 < r["taken"] <= 3 * r["size"]
    order = [r["first_position"] for r in whole]
    assert order == sorted(order)


def test_stages_on_an_empty_table(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
