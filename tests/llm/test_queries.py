"""Every opN query on made tables: columns, folds, thresholds, and rows that are odd in any way."""

from __future__ import annotations

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from matchgrid.llm import queries as Q

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_main_text": ["page_id", "url", "text", "n_chars"],
    "op3_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op5_quality": ["doc_id", "held_out", "score", "predicted"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_top_k": ["query_id", "rank", "vec_id", "score"],
    "op8_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op11_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op12_importance": ["doc_id", "n_features", "weight", "score", "rank"],
    "op13_clusters": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}
LONG = 70_000
ODD = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "the same words in two rows, as it happens"), (-5, "the same words in two rows, as it happens"), (-6, "x" * 50_000), (-7, "many words, " * LONG), (-8, "password = hunter2 mail a.b@c.de"), (-8, "password = hunter2 mail a.b@c.de")]


def written(spark, folder, seed_labels=None, empty=False):
    """The given tables with odd rows and columns of clashing names; or without rows."""
    extra = {c: F.lit("clash") for c in ("_key", "key", "kind", "spans", "score", "text_", "_n", "size", "cluster", "leaks")}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs.schema)
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    bad = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "<<<>>><p"), (-3, "u", "<p>Twice the same, as it is.</p>"), (-3, "u", "<p>Twice the same, as it is.</p>")], "page_id long, url string, html string").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in pages.select("page_id", "url", "html").schema])
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    strange = spark.createDataFrame([(-100, None), (-200, []), (-300, [math.nan] * 64), (-400, [None] + [0.0] * 63), (-500, [math.inf] * 64), (-600, [0.0] * 64), (-600, [0.0] * 64)], vectors.schema)
    labels = spark.read.parquet(f"{DATA}/labels.parquet") if seed_labels is None else seed_labels
    tables = {
        "documents": docs.unionByName(odd).withColumns(extra), "pages": pages.select("page_id", "url", "html").unionByName(bad).withColumns({"text": F.lit(1), "main_text": F.lit(2)}),
        "embeddings": vectors.unionByName(strange).withColumns(extra), "labels": labels, "benchmark": spark.read.parquet(f"{DATA}/benchmark.parquet"),
    }
    for name, df in tables.items():
        (df.limit(0) if empty else df).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("made"))


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("none"), empty=True)


@pytest.fixture(scope="module")
def found(spark, made):
    """Rows of all queries, each run once."""
    kept = {}

    def rows(name):
        if name not in kept:
            kept[name] = Q.QUERIES[name](spark, made).collect()
        return kept[name]

    return rows


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_one_row_for_each_document(spark, made, found, name):
    rows = found(name)
    assert rows[0].__fields__[: len(COLUMNS[name])] == COLUMNS[name]
    if name == "op1_main_text":
        assert len(rows) == spark.read.parquet(f"{made}/pages.parquet").count()
    elif name not in ("op7_top_k", "op13_clusters"):
        assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{made}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables_give_empty_results(spark, none, name):
    assert Q.QUERIES[name](spark, none).count() == 0


@pytest.mark.parametrize(("name", "parts", "part", "threshold"), [("op5_quality", 4, 2, 0.7), ("op6_toxicity", 5, 0, 0.5)])
def test_folds_and_thresholds(found, name, parts, part, threshold):
    for r in found(name):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == part)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= threshold)
    by = {}
    for r in found(name):
        by.setdefault(r["doc_id"], set()).add(r["score"])
    for alike in (by[-4] | by[-5], by[-8]):  # sums of floats depend on what else is in a batch
        assert max(alike) - min(alike) < 1e-3


@pytest.mark.parametrize(("name", "parts", "part", "label"), [("op5_quality", 4, 2, "quality"), ("op6_toxicity", 5, 0, "toxic")])
def test_held_out_labels_are_never_learned(spark, found, tmp_path, name, parts, part, label):
    """With all labels of the held-out fold turned round no score moves."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % parts == part
    turned = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)).cast(labels.schema[label].dataType))
    assert labels.filter(held & F.col(label).isNotNull()).count() > 0
    again = Q.QUERIES[name](spark, written(spark, tmp_path / "turned", turned)).collect()
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in again) == sorted((r["doc_id"], round(r["score"], 9)) for r in found(name))


@pytest.mark.parametrize(("name", "kinds"), [("op3_secrets", ("assign", "access", "hex")), ("op4_pii", ("email", "ip", "card", "phone"))])
def test_digests_are_of_the_base_spans(found, name, kinds):
    odd = {r["doc_id"]: r for r in found(name) if r["doc_id"] < 0}
    assert odd[-1]["base_sha256"] == odd[-2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and odd[-1]["spans"] == ""
    want = "assign:0:18" if name == "op3_secrets" else "email:24:32"
    assert odd[-8]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and want in odd[-8]["spans"].split(",")
    for r in found(name):
        assert sum(r[f"n_{k}"] for k in kinds) <= len([s for s in r["spans"].split(",") if s])


def test_vectors_that_take_no_part(found):
    ids = {r["query_id"] for r in found("op7_top_k")} | {r["vec_id"] for r in found("op7_top_k")}
    assert not ids & {-100, -300, -400, -500} and -600 in {r["query_id"] for r in found("op7_top_k")}
    assert not {r["vec_id"] for r in found("op13_clusters")} & {-100, -200, -300, -400, -500}
    assert [r["vec_id"] for r in found("op13_clusters")].count(-600) == 2


def test_pages_of_all_kinds(found):
    odd = [(r["page_id"], r["text"], r["n_chars"]) for r in found("op1_main_text") if r["page_id"] is not None and int(r["page_id"]) < 0]
    assert (-1, "", 0) in [(int(a), b, c) for a, b, c in odd] and [b for _, b, _ in odd].count("Twice the same, as it is.") == 2
    for r in found("op1_main_text"):
        assert r["n_chars"] == len(r["text"])


def test_sizes_targets_and_language_of_odd_rows(found):
    mix = {r["doc_id"]: r for r in found("op8_mix")}
    assert mix[-1]["size"] == mix[-2]["size"] == mix[-3]["size"] == 0 and mix[-7]["size"] == 2 * LONG
    assert all(r["taken"] <= 3 * r["size"] for r in mix.values())
    for source in {(r["source_size"], r["target"]) for r in mix.values()}:
        taken = sum(r["taken"] for r in mix.values() if (r["source_size"], r["target"]) == source)
        assert taken == pytest.approx(source[1], abs=1.0)
    model = {r["doc_id"]: r for r in found("op11_language_model")}
    assert model[-1]["n_tokens"] == model[-2]["n_tokens"] == model[-3]["n_tokens"] == 1 and model[-7]["n_tokens"] == 2 * LONG + 1
    assert model[-4]["score"] == pytest.approx(model[-5]["score"]) and all(r["score"] < 0 for r in model.values())
    drawn = sorted(r["rank"] for r in found("op12_importance") if r["rank"])
    assert drawn == list(range(1, len(drawn) + 1))
