"""Sinks: Parquet in bounded files, resumable appends, reports, JSON lines, GraphML, manifests, digests, archives."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def resume(df: DataFrame, folder: str, key: str, fn: Callable[[DataFrame], DataFrame], batches: int = 1, most: int | None = None) -> int:
    """Append fn of the rows whose key the folder lacks, in `batches` commits by hash of the key (`most`: stop after so many); gives the commits made.

    A run that breaks off loses its open commit only; the next goes on with what is missing. fn keeps the key.
    """
    spark = df.sparkSession
    commits = 0
    for k in range(batches if most is None else min(batches, most)):
        part = df.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        try:
            done = spark.read.parquet(folder).select(key).distinct()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            done = None
        if done is not None:
            part = part.join(done, key, "left_anti")
        if not part.isEmpty():
            fn(part).write.mode("append").option("compression", "zstd").parquet(folder)
            commits += 1
    return commits


def write_report(df: DataFrame, path: str, head: int | None = None) -> None:
    """One CSV file with a header, for tables of communities or less; head: the first rows only, in df's order."""
    (df if head is None else df.limit(head)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A line of JSON for each row, nulls written."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def _escaped(x: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


_KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double", "boolean": "boolean"}


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = True) -> None:
    """One GraphML document, for the tools that read it: nodes (id, ...) and edges (src, dst, ...), further columns as data, nulls left out.

    A document is one file, so one task writes it; it sorts by section and id and holds no table in memory.
    """
    spark = nodes.sparkSession
    keys, lines = [], []
    for n, (what, df, own) in enumerate((("node", nodes, ("id",)), ("edge", edges, ("src", "dst")))):
        data = [c for c in df.columns if c not in own]
        names = {c: f"{what[0]}{k}" for k, c in enumerate(data)}
        types = dict(df.dtypes)
        keys += [(f'<key id="{names[c]}" for="{what}" attr.name="{_plain(c)}" attr.type="{_KINDS.get(types[c], "string")}"/>') for c in data]
        text = lambda c: _escaped(F.col(f"`{c}`").cast("string"))
        inner = F.concat(F.lit(""), *[F.coalesce(F.concat(F.lit(f'<data key="{names[c]}">'), text(c), F.lit("</data>")), F.lit("")) for c in data])
        ends = [F.concat(F.lit(f' {name}="'), text(c), F.lit('"')) for name, c in zip(("id",) if what == "node" else ("source", "target"), own, strict=True)]
        line = F.concat(F.lit(f"<{what}"), *ends, F.lit(">"), inner, F.lit(f"</{what}>"))
        lines.append(df.select(F.lit(n + 1).alias("section"), line.alias("value")))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(k + "\n" for k in keys)
    frame = spark.createDataFrame([(0, head + f'<graph edgedefault="{"directed" if directed else "undirected"}">'), (3, "</graph>\n</graphml>")], "section int, value string")
    whole = frame.unionByName(lines[0]).unionByName(lines[1])
    whole.repartition(1).sortWithinPartitions("section", "value").select("value").write.mode("overwrite").text(path)


def _plain(name: str) -> str:
    return name.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def write_manifest(spark: SparkSession, values: dict, path: str) -> None:
    """Counts, paths and seeds with the time in UTC, as one JSON document."""
    now = spark.sql("SELECT date_format(to_utc_timestamp(current_timestamp(), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").first()[0]
    text = json.dumps({"created_at": now} | values, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, sha256) of files below 2 GB each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def package(spark: SparkSession, folders: Sequence[str], target: str, expected: Sequence[str] = ()) -> dict:
    """A tar.gz at `target` (a local path of the driver) of all files below the folders, and its manifest, which is also a member.

    The manifest has each file's path, bytes and time, and which expected names are missing; the archive is written either
    way. Files come one at a time. For reports and figures, not for tables.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(folders))
    records, roots = [], [spark._jvm.org.apache.hadoop.fs.Path(f).toUri().getPath().rstrip("/") for f in folders]
    with tarfile.open(target, "w:gz") as archive:

        def put(name: str, content: bytes, when: float = 0.0) -> None:
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(content), int(when)
            archive.addfile(info, io.BytesIO(content))

        for row in files.orderBy("path").toLocalIterator():
            where = spark._jvm.org.apache.hadoop.fs.Path(row["path"]).toUri().getPath()
            root = max((r for r in roots if where.startswith(f"{r}/")), key=len, default="")
            name = f"{root.rsplit('/', 1)[-1]}/{where[len(root) + 1 :]}"
            records.append({"path": name, "bytes": row["length"], "modified_at": row["modificationTime"].isoformat()})
            put(name, bytes(row["content"]), row["modificationTime"].timestamp())
        held = {r["path"].split("/", 1)[1] for r in records}
        manifest = {"package": target, "files": records, "missing": [e for e in expected if e not in held]}
        put("manifest.json", json.dumps(manifest, indent=2, sort_keys=True).encode())
    return manifest


def write_request_chunks(rows: DataFrame, folder: str, order: str, value: str, most_rows: int, most_bytes: int) -> DataFrame:
    """JSON lines in a folder for each chunk, below most_rows lines and most_bytes bytes, line feeds included; gives (chunk, requests, bytes).

    rows: (order, value), value a JSON document. A line beyond most_bytes has a chunk of its own.
    """
    from graphtrust.operators.ranking import chunks

    sized = rows.select(order, value, (F.octet_length(value) + 1).cast("long").alias("_bytes"))
    held = sized.join(chunks(sized, order, "_bytes", most_rows, most_bytes).select(order, "chunk"), order)
    held.select("chunk", F.col(value).alias("value")).repartition("chunk").write.mode("overwrite").partitionBy("chunk").text(folder)
    return held.groupBy("chunk").agg(F.count("*").alias("requests"), F.sum("_bytes").alias("bytes"))


def append_progress(spark: SparkSession, record: dict, folder: str) -> None:
    """One line of JSON with the time in UTC, appended to a folder of such lines, as training goes on."""
    now = spark.sql("SELECT date_format(to_utc_timestamp(current_timestamp(), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").first()[0]
    spark.createDataFrame([(json.dumps({"time": now} | record, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(folder)
