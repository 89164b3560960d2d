"""The canonical tables of a raw data set: papers, their metadata, closed-world edges, and a manifest; load or build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtrust.functions import text
from graphtrust.functions.stats import fixed
from graphtrust.plans.project import edge_id
from graphtrust.runtime import spill

#: Columns of the metadata table.
METADATA = ("paper_id", "title", "year", "n_citation", "top_fos")


def canonical_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(papers, metadata, edges, manifest) from raw records (see readers.PAPER). Records without an id are left out.

    Missing titles are empty, missing citation counts 0 (a key that is absent can't be told from a null one), missing
    abstracts empty. Edges are references whose both ends are papers, repeats kept; null references are left out.
    """
    rows = spill(raw.filter("id is not null").withColumn("id", F.col("id").cast("string")), "raw-papers")
    refs = F.filter(F.coalesce(F.col("references").cast("array<string>"), F.array().cast("array<string>")), lambda r: r.isNotNull())
    words = F.flatten(F.transform(F.map_entries("indexed_abstract.InvertedIndex"), lambda e: F.transform(e["value"], lambda p: F.struct(e["key"].alias("word"), p.alias("pos")))))
    abstract = F.when(F.col("indexed_abstract.InvertedIndex").isNotNull(), text.text_from_index(words, F.col("indexed_abstract.IndexLength"))).otherwise("")
    papers = rows.select(
        F.col("id").alias("paper_id"), F.coalesce("title", F.lit("")).alias("title"), abstract.alias("abstract"), "year", F.coalesce("n_citation", F.lit(0)).cast("long").alias("n_citation"),
        text.top_field(F.col("fos")).alias("top_fos"), F.size(refs).cast("long").alias("out_reference_count_raw"),
    )
    ids = rows.select(F.col("id").alias("cited_id")).distinct()
    edges = rows.select(F.col("id").alias("citing_id"), F.explode(refs).alias("cited_id")).join(ids, "cited_id", "left_semi")
    edges = edges.select(edge_id(F.col("citing_id"), F.col("cited_id")).alias("edge_id"), "citing_id", "cited_id")
    counts = ids.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))  # one row each
    manifest = counts.withColumn("edge_node_ratio", fixed(F.coalesce(F.try_divide("edge_count", "node_count"), F.lit(0.0))))
    return papers, papers.select(*METADATA), edges, manifest


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], reuse: bool = True) -> DataFrame:
    """The Parquet table at path if it is there and may be reused, else what build makes, written there first."""
    if reuse:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
