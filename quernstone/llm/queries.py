"""One query per operator, over its whole table, with the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.archives import archive_pages
from quernstone.llm.clustering import cluster_vectors
from quernstone.llm.filter_audit import BATCHES, PER_BUCKET, audit_filters
from quernstone.llm.language_model import score_documents
from quernstone.llm.mixing import mix
from quernstone.llm.near_duplicates import near_duplicates
from quernstone.llm.packing import pack_documents
from quernstone.llm.quality import classify_documents
from quernstone.llm.registry import ORACLES, QUERIES, query
from quernstone.llm.secrets import find_secrets
from quernstone.llm.token_counts import prefix_counts
from quernstone.llm.token_matrices import token_matrices
from quernstone.llm.vectors import exact_topk, nearest
from quernstone.sources import SCHEMAS, load

__all__ = ["ORACLES", "QUERIES"]


@query()
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(load(spark, sf_dir, "documents"))
    named = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"),
        F.array_join(named, ",").alias("spans"), "learned",
    )


@query()
def op2_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrices(load(spark, sf_dir, "documents"))


@query()
def op3_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(load(spark, sf_dir, "documents"))


@query()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


@query()
def op5_co_trained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefix_counts(load(spark, sf_dir, "documents"))
    return counts.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 2048 AS over_limit")


@query()
def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), size=4)


def _vectors(spark: SparkSession, sf_dir: str, every: int) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS v")
    return rows, rows.where(F.col("id") % every == 0)


@query(
    """
    WITH v AS (
      SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
      SELECT a.vec_id AS query_id, b.vec_id,
             CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE a.vec_id % 100 = 0
    ), ranked AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id
             ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
      FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """
)
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(*_vectors(spark, sf_dir, 100))


@query()
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(load(spark, sf_dir, "documents"))
    return mixed.selectExpr(
        "id AS doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


@query()
def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(*_vectors(spark, sf_dir, 50))


_AUDIT_SQL = """
    WITH docs AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copy
      FROM documents
    ), flags AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id
    ), masks AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text)
                    THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN copy THEN 16 ELSE 0 END AS mask
      FROM docs LEFT JOIN flags USING (doc_id)
    ), counters AS (
      SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM masks GROUP BY part, mask
    ), letters AS (
      SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
    ), orders AS (
      SELECT a.f || b.f || c.f || d.f || e.f AS filter_order,
             [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM letters a, letters b, letters c, letters d, letters e
      WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
    ), steps AS (
      SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit,
             coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier
      FROM orders, range(1, 6) AS r(step)
    ), counted AS (
      SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM counters, steps GROUP BY part, filter_order, step, bit
    )
    SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
           redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
           good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
           (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
    FROM counted
    """


@query(_AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    ours = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(ours, -(-docs.count() // PER_BUCKET))
    files = max(1, -(-len(docs.inputFiles()) // BATCHES))
    # the braces make the path a pattern, which may name one file as well as a folder
    stream = (
        spark.readStream.schema(SCHEMAS["documents"]).option("maxFilesPerTrigger", files)
        .parquet(f"{sf_dir}/{{documents}}.parquet")
    )
    return audit_filters(stream, load(spark, sf_dir, "labels"), buckets)


@query(
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages
    ), g AS (
      SELECT *, max(page_id) OVER (PARTITION BY body) AS head FROM p
    )
    SELECT page_id, n::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
           CASE WHEN n >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id < head THEN head END AS refers_to
    FROM g
    """
)
def op12_capture_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = archive_pages(load(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    """
    WITH RECURSIVE v AS MATERIALIZED (
      SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) = 64
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), start AS (
      SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster, q
      FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16
    ), rounds AS (
      SELECT 0 AS r, cluster, q FROM start
      UNION ALL
      SELECT * FROM (
        WITH c AS (SELECT * FROM rounds WHERE r < 3),
        near AS (
          SELECT v.q, arg_min(c.cluster, struct_pack(
                   d := list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(v.q, c.q)]),
                   n := c.cluster)) AS cluster
          FROM v, c GROUP BY v.vec_id, v.q
        ), sums AS (
          SELECT cluster, i, CAST(floor(sum(q[i]) / count(*)) AS HUGEINT) AS m
          FROM near, range(1, 65) AS t(i) GROUP BY cluster, i
        ), moved AS (SELECT cluster, list(m ORDER BY i) AS q FROM sums GROUP BY cluster)
        SELECT c.r + 1, c.cluster, coalesce(moved.q, c.q)
        FROM c LEFT JOIN moved USING (cluster)
      )
    ), last AS MATERIALIZED (SELECT cluster, q FROM rounds WHERE r = 3),
    best AS (
      SELECT v.vec_id, min(struct_pack(
               d := list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(v.q, last.q)]),
               n := last.cluster)) AS b
      FROM v, last GROUP BY v.vec_id
    )
    SELECT vec_id, b.n AS cluster, b.d::BIGINT AS distance,
           (sum(b.d) OVER (PARTITION BY b.n))::BIGINT AS cluster_inertia,
           (sum(b.d) OVER ())::BIGINT AS inertia,
           sha256(array_to_string(last.q, ',')) AS centroid_sha256
    FROM best JOIN last ON last.cluster = b.n
    """
)
def op13_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(load(spark, sf_dir, "embeddings"))
