"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import centroids, decontaminate, importance, language_model, line_dedup, passage_quality, quality_rules, secret_scan, sentencepieces, simhash, token_files, toxicity, warc
from tidemark.llm.workspace import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_report(_table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=0
    )
    return token_files.read_token_files(spark, path)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), min_docs=10, min_key_chars=1, keep="none")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path, min_bytes=1000)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"), held_out=(10, 0))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)
    return found.select("doc_id", "item_id", "start_word", "n_words", "distance", "similarity")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), max_rows=3000)
    return toxicity.score_toxicity(docs, model)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = passage_quality.fit_quality(docs, _table(spark, sf_dir, "labels"), max_rows=3000, held_out=(4, 2))
    scored = passage_quality.score_quality(docs.select("doc_id", "text"), model, cut=0.7)
    return scored.select(
        "doc_id", (passage_quality.remainder("doc_id", 4) == 2).alias("held_out"), F.col("quality_score").alias("score"),
        F.col("quality_ok").cast("int").alias("predicted"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.fit_quality_rules(docs, _table(spark, sf_dir, "labels"), max_rows=4000)
    return quality_rules.apply_rules(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.secret_report(docs, secret_scan.fit_tagger(docs, max_docs=20_000, max_windows=2_000))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5, min_words=20)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(_table(spark, sf_dir, "embeddings"), k=8, size=64, scale=1024, rounds=10, seed=3)


def queries() -> dict:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_simhash": op2_simhash,
        "op3_token_files": op3_token_files,
        "op4_line_dedup": op4_line_dedup,
        "op5_warc": op5_warc,
        "op6_language_model": op6_language_model,
        "op7_decontaminate": op7_decontaminate,
        "op8_toxicity": op8_toxicity,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_quality_rules": op10_quality_rules,
        "op11_secret_scan": op11_secret_scan,
        "op12_importance": op12_importance,
        "op13_centroids": op13_centroids,
    }


OP4_SQL = r"""
WITH lines AS (
  SELECT rowid_ AS r, u.i AS pos, u.line AS line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS rowid_, coalesce(text, '') AS text FROM documents) d,
       LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line,
                       generate_subscripts(string_split(d.text, chr(10)), 1) AS i) u
),
common AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
),
kept AS (
  SELECT l.r, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.key IS NULL), '') AS body
  FROM lines l LEFT JOIN common c ON l.key = c.key GROUP BY l.r
)
SELECT d.doc_id, CAST(k.n_lines AS BIGINT) AS n_lines, CAST(k.n_dropped AS BIGINT) AS n_dropped, sha256(k.body) AS kept_sha256
FROM (SELECT row_number() OVER () AS rowid_, doc_id FROM documents) d JOIN kept k ON d.rowid_ = k.r
"""


OP5_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body,
         octet_length(encode(coalesce(html, ''))) AS size,
         sha1(coalesce(html, '')) AS digest
  FROM pages
),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS latest FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM g
"""


OP12_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT list(c ORDER BY b) AS crc_table FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(b))
),
texts AS (
  SELECT true AS is_doc, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
),
split AS (
  SELECT is_doc, r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
),
runs AS (
  SELECT is_doc, r, unnest(w) AS f FROM split
  UNION ALL SELECT is_doc, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
  UNION ALL SELECT is_doc, r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split
),
counted AS (SELECT is_doc, r, f, count(*) AS n FROM runs GROUP BY ALL),
spelled AS (
  SELECT f, list_transform(range(0, octet_length(encode(f))), lambda i: (strpos('0123456789abcdef', lower(hex(encode(f))[2 * i + 1])) - 1) * 16
                                                            + strpos('0123456789abcdef', lower(hex(encode(f))[2 * i + 2])) - 1) AS b
  FROM (SELECT DISTINCT f FROM counted)
),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, crc_table[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, bytes
),
placed AS (SELECT is_doc, r, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
shares AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (WHERE is_doc), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT is_doc), 0) AS t
  FROM range(10000) b(bucket) LEFT JOIN placed p ON p.bucket = b.bucket GROUP BY b.bucket
),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + CAST(10000 AS DOUBLE)) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + CAST(10000 AS DOUBLE))))) AS BIGINT) AS gain
  FROM shares
),
weights AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE is_doc GROUP BY r),
scored AS (
  SELECT doc_id, len(w) >= 20 AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((list_reduce(list_prepend(0, list_transform(string_split(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[:8], ''),
           lambda x: strpos('0123456789abcdef', x) - 1)), lambda a, x: a * 16 + x) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (r) WHERE is_doc
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE enough) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""


def op13_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Every round written out: nearest centroids, then floors of the means."""
    gap = f"list_sum(list_transform(range(1, {size} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(x))) = {size}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c
  FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k})
)""",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(j, d * {k} + j) AS j, min(d) AS d FROM (SELECT vec_id, r, v, j, {gap} AS d FROM kept, c{t}) GROUP BY vec_id, r, v
)""")
        if t < rounds:
            parts.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT j, coalesce(m.c, o.c) AS c FROM c{t} o LEFT JOIN (
    SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t}) GROUP BY j, i
    ) GROUP BY j
  ) m USING (j)
)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (j)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op5_warc": OP5_SQL, "op12_importance": OP12_SQL, "op13_centroids": op13_sql()}
