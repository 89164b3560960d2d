"""The queries of the ten operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtrust.llm import licences, mixing, mpeg, packing, pii, quality, simhash, substrings, urlrules, voronoi
from graphtrust.runtime import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 64-bit fingerprints of 3-word shingles are linked at 3 or fewer bits."""
    classes = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"), width=3, words=1, radius=3, distinct=False)
    return classes.select(F.col("id").alias("doc_id"), F.col("fp").alias("fingerprint"), "component_id")


def op2_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every hundredth vector against all others."""
    vectors = voronoi.integer_vectors(table(spark, sf_dir, "embeddings"))
    return voronoi.top_k(vectors, F.pmod("id", F.lit(100)) == 0)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.detect(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    found = licences.license_labels(table(spark, sf_dir, "documents"))
    return found.drop("license_spans").withColumnRenamed("id", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weak label and the scorer's verdict on every document."""
    return quality.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's URL."""
    return urlrules.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("copies")


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as an MPEG audio stream and read back."""
    return mpeg.digests(mpeg.encode_audio(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier document holds."""
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_voronoi_topk, op3_pii, op4_licenses, op5_quality, op6_packing, op7_url_rules, op8_mixing, op9_mpeg_audio, op10_substrings,
)}

_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1)"


def _fits(rule: urlrules.Rule) -> str:
    return f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '/{rule.path}')"


_RANKED = sorted(urlrules.RULES, key=lambda r: -len(r.name))
ORACLES = {
    "op2_voronoi_topk": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS row, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.row <> c.row AND len(q.e) = len(c.e)
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
    "op7_url_rules": f"""
        WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages)
        SELECT page_id, host, path,
            CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.name}'" for r in _RANKED)} END AS rule,
            CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _RANKED)}
                WHEN regexp_matches(host || path, '^[^/]*(spam|pills|casino)[^/]*/') OR contains(host || path, '/ads/') OR contains(host || path, '/tracking/') THEN 'block'
                ELSE 'allow' END AS verdict
        FROM p
    """,
    "op8_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
        ), c AS (
            SELECT *, CASE WHEN size < 16 THEN size ELSE 8 * length(bin(size)) + (size >> (length(bin(size)) - 4)) % 8 END AS class, ((coalesce(doc_id, 0) % 64) + 64) % 64 AS deal FROM d
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS cap,
                [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
            FROM c GROUP BY source
        ), w AS (
            SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s
        ), t AS (
            SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT min_by(level, cap / weight) FROM w WHERE level * weight <= cap)::DOUBLE * weight), cap::DOUBLE) AS target FROM w
        ), r AS (
            SELECT c.*, t.source_size, t.target, row_number() OVER (PARTITION BY c.source ORDER BY class, deal, size, doc_id NULLS FIRST) AS place,
                CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
                CAST(('0x' || substr(md5('mix-1:' || coalesce(c.source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS off
            FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
            CAST((floor(each * place::DOUBLE + off) - floor(each * (place - 1)::DOUBLE + off)) * size AS BIGINT) AS taken
        FROM r
    """,
}
