"""The citation-shaped views of the input tables: consecutive parts of an order cite one another; brands are a given partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphtrust.functions.labels import INTENTS, intent_weight
from graphtrust.runtime import spread_by, table


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) with repeats and loops."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return spread_by(lines, "l_orderkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).filter("dst is not null")


def edge_id(src: Column, dst: Column) -> Column:
    return F.sha1(F.concat_ws("->", src.cast("string"), dst.cast("string")).cast("binary"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst), distinct: for what needs no edge ids."""
    return spread_by(raw_edges(spark, sf_dir), "src", "dst").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, src, dst), distinct."""
    return pairs(spark, sf_dir).select(edge_id(F.col("src"), F.col("dst")).alias("edge_id"), "src", "dst")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("domain"), F.col("p_brand").alias("community"))


def semantics(edge_table: DataFrame) -> DataFrame:
    """(edge_id, src, dst, intent, weight, confidence): a deterministic label for six of ten edges, none for the others."""
    code = F.pmod(F.col("src") * 7 + F.col("dst") * 13, F.lit(10)).cast("int")
    labelled = edge_table.withColumn("k", code).filter(F.col("k") < len(INTENTS))
    intent = F.element_at(F.array(*[F.lit(x) for x in INTENTS]), F.col("k") + 1)
    return labelled.select(*edge_table.columns, intent.alias("intent"), intent_weight(intent).alias("weight"), (F.pmod("src", F.lit(31)) / F.lit(30.0)).alias("confidence"))


#: The same views as SQL for the oracle.
SQL = """
raw_edges AS (
    SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL
), edges AS (
    SELECT sha1(concat(CAST(src AS VARCHAR), '->', CAST(dst AS VARCHAR))) AS edge_id, src, dst FROM (SELECT DISTINCT src, dst FROM raw_edges)
), nodes AS (
    SELECT p_partkey AS id, p_name AS title, p_type AS domain, p_brand AS community FROM part
), semantics AS (
    SELECT edge_id, src, dst, ['Background', 'Method', 'Result/Comparison', 'Support', 'Contrast/Criticism', 'Perfunctory/Ceremonial'][CAST(k + 1 AS INTEGER)] AS intent,
        (CAST([0.2, 1.0, 0.7, 0.5, 0.3, 0.1] AS DOUBLE[]))[CAST(k + 1 AS INTEGER)] AS weight, (src % 31) / 30.0::DOUBLE AS confidence
    FROM (SELECT *, (src * 7 + dst * 13) % 10 AS k FROM edges) WHERE k < 6
), weighted AS (
    SELECT e.*, coalesce(s.intent, 'Untyped') AS intent, coalesce(s.weight, 1.0)::DOUBLE AS weight, coalesce(s.confidence, 0.0)::DOUBLE AS confidence, s.edge_id IS NOT NULL AS typed
    FROM edges e LEFT JOIN semantics s USING (edge_id)
), flagged AS (
    SELECT w.*, r.src IS NOT NULL AS reciprocal, a.community AS src_community, b.community AS dst_community, coalesce(a.community = b.community, false) AS internal
    FROM weighted w LEFT JOIN edges r ON r.src = w.dst AND r.dst = w.src LEFT JOIN nodes a ON a.id = w.src LEFT JOIN nodes b ON b.id = w.dst
), outdeg AS (SELECT src AS id, count(*) AS d FROM edges GROUP BY 1
), indeg AS (SELECT dst AS id, count(*) AS d FROM edges GROUP BY 1
)
"""
