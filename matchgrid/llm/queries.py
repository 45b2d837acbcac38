"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm import clustering, decontam, html, importance, language_model, line_dedup, mixing, near_dedup, pii, quality, secrets, topk, toxicity
from matchgrid.llm.common import read


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.extract_main_text(pages, "html", "text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("copy_key")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "secrets")
    return _digest(found.select("doc_id", "secrets"), "secrets", ("assign", "access", "hex"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(pii.find_pii(docs, "text", "doc_id", "pii").select("doc_id", "pii"), "pii", pii.KINDS)


def _digest(found: DataFrame, spans: str, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter(spans, lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col(spans)).alias("spans"))


def _held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(doc_id.cast("string")) % parts == part


def _scored(scored: DataFrame, held_out: Column, threshold: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~_held_out(F.col("i"), 4, 2))
    return _scored(quality.score_quality(docs, model), _held_out(F.col("doc_id"), 4, 2), 0.7)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~_held_out(F.col("i"), 5, 0))
    return _scored(toxicity.score_toxicity(docs, machine), _held_out(F.col("doc_id"), 5, 0), 0.5)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    columns = ("doc_id", "size", "source_size", "target", "taken", "copies", "first_position")
    return mixed.select(*columns).orderBy("first_position", "doc_id")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k, md5(coalesce(text, '')) AS t
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS ceiling
  FROM s
), x AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY ceiling / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM w
), y AS (
  SELECT *, ceiling * weights_left < weight * (total - before) AS stopped FROM x
), z AS (
  SELECT source, source_size, weight,
         CASE WHEN stopped THEN ceiling::DOUBLE
              ELSE (weight * (total - sum(CASE WHEN stopped THEN ceiling ELSE 0 END) OVER ()))::DOUBLE
                   / sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER ()::DOUBLE END AS target
  FROM y
), c AS (
  SELECT d.doc_id, d.size, z.source_size, z.target, z.weight,
         (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS c0,
         CASE WHEN z.source_size > 0 THEN floor(z.target / z.source_size::DOUBLE)::BIGINT ELSE 0 END AS e
  FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source
), m AS (
  SELECT *, least(greatest(floor(target - (e * source_size)::DOUBLE + 0.5)::BIGINT - c0, 0), size) AS more FROM c
), n AS (
  SELECT *, (CASE WHEN size > 0 THEN e + (CASE WHEN more > 0 THEN 1 ELSE 0 END) ELSE 0 END)::INTEGER AS copies,
         CASE WHEN target > 0 THEN least(c0::DOUBLE / target, 1.0::DOUBLE) END AS q
  FROM m
)
SELECT doc_id, size, source_size, target, (size * e + more)::BIGINT AS taken, copies,
       CASE WHEN copies > 0 THEN least(greatest(CASE weight
         WHEN 5 THEN 0.0::DOUBLE + (sqrt((1.5::DOUBLE * 1.5::DOUBLE) + (2 * -1.0::DOUBLE) * q) - 1.5::DOUBLE) / -1.0::DOUBLE
         WHEN 2 THEN q
         ELSE CASE WHEN q >= 0.375::DOUBLE THEN 0.5::DOUBLE + (sqrt(1.0::DOUBLE + 2.0::DOUBLE * (q - 0.375::DOUBLE)) - 1.0::DOUBLE) / 1.0::DOUBLE
                   ELSE 0.0::DOUBLE + (sqrt(0.25::DOUBLE + 2.0::DOUBLE * q) - 0.5::DOUBLE) / 1.0::DOUBLE END END, 0.0::DOUBLE), 1.0::DOUBLE) END AS first_position
FROM n
"""

def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH p AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM p
), n AS (
  SELECT *, lower(trim(line, ' ' || chr(9) || chr(13))) AS n FROM l
), f AS (
  SELECT n, min((doc_id, pos)) AS first FROM n WHERE n <> '' GROUP BY n
), h AS (
  SELECT n, first, length(n) AS m, left(n, length(n) // 2) AS a, right(n, length(n) - length(n) // 2) AS b,
         left(n, (length(n) - 1) // 2) AS pa, right(n, (length(n) - 1) - (length(n) - 1) // 2) AS pb
  FROM f WHERE length(n) >= 20
), c AS (
  SELECT x.n AS xn, x.first AS xf, y.n AS yn, y.first AS yf FROM h x JOIN h y ON x.m = y.m AND x.a = y.a AND x.n < y.n
  UNION SELECT x.n, x.first, y.n, y.first FROM h x JOIN h y ON x.m = y.m AND x.b = y.b AND x.n < y.n
  UNION SELECT x.n, x.first, y.n, y.first FROM h x JOIN h y ON x.m = y.m - 1 AND x.a = y.pa
  UNION SELECT x.n, x.first, y.n, y.first FROM h x JOIN h y ON x.m = y.m - 1 AND x.b = y.pb
), g AS (
  SELECT DISTINCT CASE WHEN xf > yf THEN xn ELSE yn END AS n FROM c WHERE levenshtein(xn, yn) <= 1
), k AS (
  SELECT n.doc_id, n.pos, n.line,
         n.n = '' OR ((n.doc_id, n.pos) = f.first AND g.n IS NULL) AS stays
  FROM n LEFT JOIN f ON n.n = f.n LEFT JOIN g ON n.n = g.n
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS text,
       count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped
FROM k GROUP BY doc_id
"""


def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.distance")


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(_held_out(F.col("doc_id"), 5, 1), F.lit(False))
    scored = language_model.score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH steps AS (
  SELECT list(c ORDER BY b) AS s FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS b))
), t AS (
  SELECT 'd' AS part, doc_id AS id, row_number() OVER () AS n, text FROM documents
  UNION ALL SELECT 'b', NULL, row_number() OVER (), text FROM benchmark
), w AS (
  SELECT part, id, n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM t
), f AS (
  SELECT part, n, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w
), c AS (
  SELECT part, n, f, count(*) AS k FROM f GROUP BY ALL
), g AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c // 256, s[xor(c % 256, x) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT f FROM c) CROSS JOIN steps
), n AS (
  SELECT b, coalesce(sum(k) FILTER (part = 'd'), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (part = 'b'), 0)::DOUBLE AS t FROM c JOIN g USING (f) GROUP BY b
), gains AS (
  SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM n
), sums AS (
  SELECT n, sum(k)::BIGINT AS n_features, floor(sum(k * gain)::DOUBLE / sum(k)::DOUBLE)::BIGINT AS weight FROM c JOIN g USING (f) JOIN gains USING (b) WHERE part = 'd' GROUP BY n
), d AS (
  SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || left(sha256('7:' || id::VARCHAR), 8))::BIGINT AS h
  FROM w LEFT JOIN sums USING (n) WHERE part = 'd'
), e AS (
  SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM e
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM r
"""


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(read(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """Each round is a pair of CTEs: the nearest centroid of every vector, then the new centroids."""
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS c, x AS m FROM v ORDER BY sha256('2:' || vec_id::VARCHAR) LIMIT 40
)"""
    ]
    for i in range(6):
        parts.append(
            f"""a{i} AS MATERIALIZED (
  SELECT n, vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT n, vec_id, x, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{i}) GROUP BY n, vec_id, x
)"""
        )
        if i < 5:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT c0.c, coalesce(s.m, o.m) AS m FROM c0 JOIN c{i} o ON c0.c = o.c LEFT JOIN (
    SELECT c, list(m ORDER BY j) AS m FROM (
      SELECT c, j, floor(sum(x[j])::DOUBLE / count(*)::DOUBLE)::BIGINT AS m FROM a{i} CROSS JOIN (SELECT unnest(range(1, 65)) AS j) GROUP BY c, j) GROUP BY c) s ON c0.c = s.c
)"""
            )
    return "WITH " + ", ".join(parts) + """
SELECT vec_id, a5.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a5.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON a5.c = c5.c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_secrets": op3_secrets,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_top_k": op7_top_k,
    "op8_mix": op8_mix,
    "op9_line_dedup": op9_line_dedup,
    "op10_leaks": op10_leaks,
    "op11_language_model": op11_language_model,
    "op12_importance": op12_importance,
    "op13_clusters": op13_clusters,
}
ORACLE: dict[str, str] = {"op7_top_k": OP7_SQL, "op8_mix": OP8_SQL, "op9_line_dedup": OP9_SQL, "op12_importance": OP12_SQL, "op13_clusters": _op13_sql()}
