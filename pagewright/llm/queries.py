"""One query per operator over its whole table, and DuckDB statements where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import (
    embed_join, exact_dedup, fingerprint, langid, mixing, packing, periodic, pii, resample, secrets, sharding, simhash, warc,
)

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_path() -> str:
    """The vocabulary that packing encodes with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.train_model(docs))


def op3_sharding(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    out = sharding.assign_shards(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_warc(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    manifest = warc.write_archives(warc.mark_revisits(pages))
    found = warc.resolve_revisits(warc.read_headers(manifest))
    return found.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op5_simhash(spark, sf_dir):
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_embedding_dedup(spark, sf_dir):
    return embed_join.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_pii(spark, sf_dir):
    return pii.find_pii(_table(spark, sf_dir, "documents")).drop("found")


def op9_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path())


def op10_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    out = periodic.periodic_runs(periodic.plant_runs(_table(spark, sf_dir, "documents")))
    best = F.col("best")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(periodic.run_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_fingerprints(spark, sf_dir):
    out = fingerprint.fingerprint_edits(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("sketch")).alias("fingerprint"), fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), "next_id",
    )


def op13_resampling(spark, sf_dir):
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_secret_scan, op3_sharding, op4_warc, op5_simhash, op6_mixing, op7_embedding_dedup,
        op8_pii, op9_packing, op10_language_id, op11_periodic_runs,
        op12_fingerprints, op13_resampling,
    )
}

ORACLE: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op4_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                          sha256(coalesce(html, '')) AS payload_digest FROM pages),
             r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM r""",
    "op6_mixing": r"""
        WITH d AS (
               SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                      md5(coalesce('k' || CAST(doc_id AS VARCHAR), 'null')) AS h
               FROM documents),
             s AS (
               SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
               FROM d GROUP BY source),
             w AS (
               SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(rank - 1) % 3 + 1] AS weight, CAST(source_size AS DOUBLE) * 2.0::DOUBLE AS cap
               FROM s),
             f AS (
               SELECT *, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS budget,
                      coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS capped,
                      sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
               FROM w),
             l AS (SELECT *, (budget - capped) / rest AS level FROM f),
             g AS (SELECT level AS free FROM l WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
             t AS (SELECT source, source_size, rank, budget,
                          CASE WHEN (SELECT free FROM g) IS NULL THEN cap ELSE least(cap, (SELECT free FROM g) * weight) END AS target
                   FROM l),
             q AS (
               SELECT d.*, t.source_size, t.rank, t.target, t.budget,
                      sum(d.size) OVER (PARTITION BY t.rank ORDER BY h, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
               FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
             e AS (
               SELECT doc_id, h, size, rank, budget, turn, cum + turn * source_size AS c,
                      CAST(cum + turn * source_size AS DOUBLE) / target AS finish
               FROM q, (VALUES (0), (1)) v(turn) WHERE size > 0),
             o AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, c ROWS UNBOUNDED PRECEDING) AS upto FROM e),
             k AS (SELECT doc_id, rank, count(*) FILTER (WHERE upto <= budget) AS copies FROM o GROUP BY doc_id, rank)
        SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(k.copies, 0) AS BIGINT) AS taken
        FROM q LEFT JOIN k ON q.doc_id = k.doc_id AND q.rank = k.rank""",
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (
               SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
                 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
             l AS (
               SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
               WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
             r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
             c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
             n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT c.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)""",
    "op12_fingerprints": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next,
                          coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
             e AS (SELECT *, left(text, length(text) - length(text) // 4) || left(next, length(text) // 4) AS edited FROM n),
             t AS (SELECT DISTINCT unnest([text, next, edited]) AS t FROM e),
             w AS (SELECT t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
             s AS (SELECT t, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END AS s FROM w),
             h AS (SELECT t, list_sort(list_distinct(list_transform(s, lambda x: substring(md5(x), 1, 16))))[1:128] AS h FROM s),
             j AS (SELECT e.doc_id, e.next_id, e.text, e.edited, a.h AS a, b.h AS b, c.h AS c,
                          list_sort(list_distinct(list_concat(a.h, b.h)))[1:128] AS ab, list_sort(list_distinct(list_concat(a.h, c.h)))[1:128] AS ac
                   FROM e JOIN h a ON a.t = e.text JOIN h b ON b.t = e.edited JOIN h c ON c.t = e.next)
        SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
               array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
               CASE WHEN len(ab) = 0 THEN 1.0::DOUBLE
                    ELSE len(list_intersect(list_intersect(ab, a), b))::DOUBLE / len(ab) END AS near_edited,
               CASE WHEN len(ac) = 0 THEN 1.0::DOUBLE
                    ELSE len(list_intersect(list_intersect(ac, a), c))::DOUBLE / len(ac) END AS near_next, next_id
        FROM j""",
}
