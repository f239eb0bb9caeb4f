"""One query per operator over its whole table, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import bpe, clusters, fingerprints, langid, lines, lm, mixing, neardup, phrases, pii, quality, token_counts, topk
from sigloom.llm.text import id_bucket
from sigloom.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", id_bucket(F.col("doc_id"), 4).alias("part"))
    filters = langid.train(docs.where("part <> 2"))
    held_out = (F.col("part") == 2).alias("held_out")
    return langid.predict(docs.select("doc_id", held_out, "text"), filters).drop("text")


def op2_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=4, threshold=0.8)


def op3_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", id_bucket(F.col("doc_id"), 7).alias("part"))
    model = lm.train(docs.where("part <> 2"), order=3)
    return lm.score(docs.select("doc_id", (F.col("part") == 2).alias("held_out"), "text"), model)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(documents(spark, sf_dir), ranks, ("n_tokens", "ids_sha256", "decoded_sha256"))


#: Of the registered query only; a user passes a secret.
PII_KEY = "example key"


def op6_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir), PII_KEY)


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut_lineage(mixing.sizes(documents(spark, sf_dir)))
    mixed = mixing.copies(sized, mixing.balance(sized))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP8_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(documents(spark, sf_dir), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM d),
k AS (
  SELECT doc_id, pos, line, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    definition = token_counts.read_definition(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.token_counts(documents(spark, sf_dir), definition, limit=512)


def op12_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clusters.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return clusters.cluster(vectors, k=40, rounds=5, seed=2)


def _op12_sql(rounds: int = 5) -> str:
    parts = [
        """e AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v AS c FROM e QUALIFY cluster < 40)""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (
  SELECT row, vec_id, v, cluster, distance FROM (
    SELECT row, vec_id, v, cluster,
      CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
    FROM e, c{i})
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            means = ", ".join(f"CAST(floor(sum(v[{k}])::DECIMAL(30, 0) / count(*)) AS BIGINT)" for k in range(1, 65))
            parts.append(f"""c{i + 1} AS (
  SELECT cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT cluster, [{means}] AS c FROM a{i} GROUP BY cluster) m USING (cluster))""")
    with_ctes = ",\n".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)
    return f"""
WITH {with_ctes}
SELECT vec_id, CAST(cluster AS INT) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), max_words=5, min_count=100, most=2000)


OP13_SQL = r"""
WITH p AS (
  SELECT lang, unnest(pieces) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]') AS pieces FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, ws[i : i + k - 1] AS g FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) AS r(k))),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g HAVING count(*) >= 100),
cut AS (
  SELECT c.lang, c.g, c.f AS a, l.k, l.f AS l, r.f AS r, t.n,
    CAST(1000::HUGEINT * c.f * t.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM f c JOIN t USING (lang)
  JOIN f l ON l.lang = c.lang AND l.k < c.k AND l.g = c.g[1 : l.k]
  JOIN f r ON r.lang = c.lang AND r.k = c.k - l.k AND r.g = c.g[l.k + 1 : c.k] WHERE c.k > 1),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
named AS (SELECT *, array_to_string(g, ' ') AS phrase FROM best),
kept AS (
  SELECT * FROM named c WHERE NOT EXISTS (
    SELECT 1 FROM named d WHERE d.lang = c.lang AND len(d.g) > len(c.g) AND 100 * d.a >= 100 * c.a
      AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')))
SELECT lang, CAST(row_number() OVER o AS BIGINT) AS rank, phrase, a, l, r, n, score FROM kept
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
"""

QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_chosen_path_dedup": op2_chosen_path_dedup,
    "op3_weighted_fingerprints": op3_weighted_fingerprints,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_feistel_pii": op6_feistel_pii,
    "op7_entropy_mix": op7_entropy_mix,
    "op8_exact_topk": op8_exact_topk,
    "op9_weak_quality": op9_weak_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_bit_plane_clusters": op12_bit_plane_clusters,
    "op13_phrase_collocations": op13_phrase_collocations,
}
ORACLES: dict[str, str] = {
    "op8_exact_topk": OP8_SQL.strip(),
    "op10_line_dedup": OP10_SQL.strip(),
    "op12_bit_plane_clusters": _op12_sql().strip(),
    "op13_phrase_collocations": OP13_SQL.strip(),
}
