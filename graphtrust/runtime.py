"""Session helpers: table access and reliable lineage cuts in shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Folders that spill() wrote in this process and that still stand, in order.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the input folder; read by Spark alone, so any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where unset: one of our own, in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphtrust-"))
    return context.getCheckpointDir()


def partitions(df: DataFrame, mb: float = 2.0) -> int:
    """Partitions for what is made of df, one for each so many MB of the files and kept tables it reads, so that a task's share doesn't grow with the input; spark.sql.shuffle.partitions at least."""
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [plan.apply(k) for k in range(plan.length())]
    size = sum(int(str(leaf.stats().sizeInBytes())) for leaf in leaves if leaf.getClass().getSimpleName() in ("LogicalRelation", "InMemoryRelation"))
    return min(10_000, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size / mb / 2**20) if size < 2**50 else 0))


def spread_by(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by columns to partitions() tasks, if these are more than Spark would take: a number that is asked for is not made less, so no task's share grows with the input."""
    n = partitions(df)
    return df if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, *columns)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def observed(df: DataFrame, *aggregates: Column) -> tuple[DataFrame, dict]:
    """checkpoint(df), and aggregates of its rows taken as they are written, so that no further job reads them."""
    watch = Observation()
    out = checkpoint(df.observe(watch, *aggregates))
    return out, watch.get


def spill(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of a large table by writing it as Parquet to the shared folder and rereading it.

    The folder stays until drop_folder() or the end of a scratch() around it, as a plan may read it at any later time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/graphtrust-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spilled_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def drop_folder(spilled: DataFrame) -> None:
    """Delete what spill() wrote for this table; for tables that no plan reads any more because what follows is written too."""
    _delete(spilled.sparkSession, spilled._spilled_to)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """spill() of what make gives; all else that was written on the way, and that only its plan read, is deleted."""
    before = len(_written)
    out = spill(make(), name)
    for path in _written[before:]:
        if path != out._spilled_to:
            _delete(out.sparkSession, path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that spill() wrote inside: put it around a query and what is done with its rows."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            _delete(spark, path)
