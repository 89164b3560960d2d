"""Readers: papers as JSON, numbered JSON lines, shard folders, GraphML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The columns of a paper record.
PAPER = (
    "id string, title string, year int, n_citation long, doc_type string, references array<string>, "
    "fos array<struct<name: string, w: double>>, indexed_abstract struct<IndexLength: int, InvertedIndex: map<string, array<int>>>"
)


def papers(spark: SparkSession, path: str, lines: bool = True, root: str | None = None, schema: str = PAPER) -> DataFrame:
    """Records from JSON lines, or from files that hold one array (lines=False), inside a member `root` if named. A file of one array is one task: convert it once."""
    if root:
        whole = spark.read.schema(f"`{root}` array<struct<{_struct(schema)}>>").option("multiLine", True).json(path)
        return whole.select(F.explode(root).alias("paper")).select("paper.*")
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def _struct(schema: str) -> str:
    from pyspark.sql import types as T

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def paper_references(rows: DataFrame) -> DataFrame:
    """(src, dst): a row for each reference that isn't null, repeats kept."""
    return rows.select(F.col("id").cast("string").alias("src"), F.explode(F.filter(F.col("references").cast("array<string>"), lambda r: r.isNotNull())).alias("dst"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value, doc): lines numbered from 1 in each file, blank ones counted but left out; a malformed line raises.

    Numbers are counted inside a file's blocks and offset by the blocks before, so a large file is read by many tasks.
    """
    m = F.col("_metadata")
    raw = spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = raw.withColumn("n", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("k"))
    before = sizes.select("file", "block", (F.sum("k").over(Window.partitionBy("file").orderBy("block")) - F.col("k")).alias("before"))
    kept = lines.filter(F.trim("value") != "").join(before, ["file", "block"])
    return kept.select("file", (F.col("n") + F.col("before")).alias("line_no"), "value", F.parse_json("value").alias("doc"))


def shards(spark: SparkSession, folder: str, skip_corrupt: bool = False) -> DataFrame:
    """All part_*.parquet of a folder with their source_path; files that can't be read raise, unless skipped."""
    reader = spark.read.option("pathGlobFilter", "part_*.parquet").option("ignoreCorruptFiles", skip_corrupt)
    return reader.parquet(folder).select("*", F.col("_metadata.file_path").alias("source_path"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (id), edges (src, dst)), ids as strings."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return read("node", "_id string").selectExpr("_id id"), read("edge", "_source string, _target string").selectExpr("_source src", "_target dst")


def config(path: str) -> dict:
    """A YAML file of the driver as a dict; an empty one gives {}."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or ValueError where columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def paper_stats(rows: DataFrame) -> DataFrame:
    """(n_nodes, n_references, without_references, mean_out_degree) of raw records (id, references)."""
    from graphtrust.functions.stats import fixed

    k = F.coalesce(F.size(F.col("references")), F.lit(0))
    k = F.when(k < 0, 0).otherwise(k).cast("long")
    return rows.agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum(k), F.lit(0)).alias("n_references"), F.count_if(k == 0).alias("without_references"), fixed(F.coalesce(F.avg(k), F.lit(0.0))).alias("mean_out_degree"))


def papers_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A second pass over records: those in ids (id), with the references among them only. References go through a join, so ids may be many."""
    keys = ids.select(F.col("id").cast("string").alias("id")).distinct()
    kept = rows.withColumn("id", F.col("id").cast("string")).join(keys, "id", "left_semi")
    refs = kept.select("id", F.posexplode(F.col("references").cast("array<string>")).alias("at", "ref")).join(keys.withColumnRenamed("id", "ref"), "ref", "left_semi")
    lists = refs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "ref"))).alias("r"))
    none = F.array().cast("array<string>")
    return kept.drop("references").join(lists, "id", "left").select(*[c for c in rows.columns if c != "references"], F.coalesce(F.col("r.ref"), none).alias("references"))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet folder; only footers are read."""
    return spark.read.parquet(path).count()


def label_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(text1, text2, label, source, target) from one array of the early label files."""
    return spark.read.schema("text1 string, text2 string, label int, source string, target string").option("multiLine", True).json(path)


def edge_ids(spark: SparkSession, files: list[str] = (), folders: list[str] = ()) -> DataFrame:
    """(edge_id), distinct, of label files, each of which must be there, and of shard folders, which may be missing."""
    from pyspark.errors import AnalysisException

    out = spark.createDataFrame([], "edge_id string")
    for path in files:
        out = out.unionByName(spark.read.parquet(path).select(F.col("edge_id").cast("string")))
    for folder in folders:
        try:
            out = out.unionByName(shards(spark, folder).select(F.col("edge_id").cast("string")))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return out.filter("edge_id is not null").distinct()


def partial_semantics(spark: SparkSession, folders: list[str] = (), files: list[str] = ()) -> DataFrame:
    """(edge_id, label, weight, confidence, source): student shards of the folders in order, then teacher label files in order; of an edge_id the first stands."""
    from pyspark.errors import AnalysisException

    from graphtrust.functions.labels import intent_weight
    from graphtrust.operators.ranking import keep_first

    schema = "edge_id string, label string, weight double, confidence double, source string, _k int"
    out, k = spark.createDataFrame([], schema), 0
    for folder in folders:
        try:
            rows = shards(spark, folder)
            out = out.unionByName(rows.selectExpr("edge_id", "predicted_label label", "semantic_weight weight", "label_confidence confidence", "source_path source", f"{k} _k"))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        k += 1
    for path in files:
        rows = teacher_labels(spark, path, k)
        out = out.unionByName(rows.select("edge_id", "label", intent_weight(F.col("label")).alias("weight"), "confidence", "source", F.lit(k).alias("_k")))
        k += 1
    return keep_first(out, "edge_id", F.col("_k"), F.col("source")).drop("_k")


def teacher_labels(spark: SparkSession, path: str, priority: int = 10_000) -> DataFrame:
    """(edge_id, label, weight, confidence, model_version, source, priority) of a teacher's label file; ValueError where edge_id or label are missing columns."""
    from graphtrust.functions.labels import intent_weight

    rows = require(spark.read.parquet(path), "edge_id", "label")
    confidence = F.col("confidence").cast("double") if "confidence" in rows.columns else F.lit(None).cast("double")
    return rows.select(
        "edge_id", "label", intent_weight(F.col("label")).alias("weight"), confidence.alias("confidence"), F.lit("teacher").alias("model_version"), F.lit(path).alias("source"), F.lit(priority).alias("priority"),
    )
