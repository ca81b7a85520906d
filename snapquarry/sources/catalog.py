"""The catalog's Parquet tables in a repository directory.

``nodes`` and ``nodechunks`` are partitioned by snapshot.  Indexes live in generations: a
consolidation writes a new one and flips the pointer, so no path is overwritten while it is
read.  A snapshot counts once its record is there, which is written last.
"""

from __future__ import annotations

import json
import os
import shutil
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import committed, last_wins
from ..schema import SCHEMAS, conform
from .store import LocalStore

_POINTER = "index.json"


class Catalog:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.dir, self.store = spark, os.path.abspath(directory), LocalStore(directory)

    def generation(self) -> int:
        return json.loads(self.store.get(_POINTER))["generation"] if self.store.exists(_POINTER) else 0

    def _path(self, table: str) -> str:
        return f"{self.dir}/index/{self.generation()}/{table}" if table in ("chunks", "packs") else f"{self.dir}/{table}"

    def _read(self, table: str, *extra: str) -> DataFrame:
        """An absent table is an empty one."""
        schema = ", ".join([SCHEMAS[table], *extra])
        path = self._path(table)
        if not os.path.isdir(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def snapshots(self) -> DataFrame:
        """The records in time; one that stands in two files, see ``forget``, counts once."""
        return conform(self._read("snapshots"), "snapshots").dropDuplicates(["id"]).orderBy("timestamp", "id")

    def nodes(self, snapshot_id: str | None = None) -> DataFrame:
        return self._of("nodes", snapshot_id)

    def nodechunks(self, snapshot_id: str | None = None) -> DataFrame:
        return self._of("nodechunks", snapshot_id)

    def _of(self, table: str, snapshot_id: str | None) -> DataFrame:
        rows = committed(conform(self._read(table), table), self.snapshots())
        return rows if snapshot_id is None else rows.where(F.col("snapshot_id") == snapshot_id)

    def chunks(self) -> DataFrame:
        """The last entry of each hash; entries carry the batch that wrote them."""
        return conform(last_wins(self._read("chunks", "batch STRING"), "hash", "batch", "pack_id", "offset"), "chunks")

    def packs(self) -> DataFrame:
        return conform(last_wins(self._read("packs", "batch STRING"), "pack_id", "batch"), "packs")

    def write_nodes(self, nodes: DataFrame, nodechunks: DataFrame) -> None:
        for table, df in (("nodes", nodes), ("nodechunks", nodechunks)):
            df.select([f.split(" ")[0] for f in SCHEMAS[table].split(", ")]).write.mode("append").partitionBy("snapshot_id").parquet(f"{self.dir}/{table}")

    def write_index(self, chunks: DataFrame, packs: DataFrame, batch: str) -> None:
        for table, df in (("chunks", chunks), ("packs", packs)):
            conform(df, table).withColumn("batch", F.lit(batch)).write.mode("append").parquet(self._path(table))

    def write_record(self, record: DataFrame) -> None:
        """The commit of a snapshot."""
        conform(record, "snapshots").coalesce(1).write.mode("append").option("compression", "snappy").parquet(f"{self.dir}/snapshots")

    def replace_index(self, chunks: DataFrame, packs: DataFrame) -> None:
        old = self.generation()
        for table, df in (("chunks", chunks), ("packs", packs)):
            conform(df, table).withColumn("batch", F.lit("")).write.parquet(f"{self.dir}/index/{old + 1}/{table}")
        self.store.put(_POINTER, json.dumps({"generation": old + 1}).encode())
        shutil.rmtree(f"{self.dir}/index/{old}", ignore_errors=True)

    def forget(self, snapshot_id: str) -> None:
        """Delete the file of the record, then nodes and chunk lists; chunks stay until compaction.

        Other records in that file are first copied to a new one, so no step loses any.
        """
        if os.path.isdir(self._path("snapshots")):
            placed = self._read("snapshots").withColumn("_file", F.col("_metadata.file_path"))
            files = [r["_file"] for r in placed.where(F.col("id") == snapshot_id).select("_file").distinct().collect()]
            others = placed.where(F.col("_file").isin(files) & (F.col("id") != snapshot_id)).drop("_file")
            if not others.isEmpty():
                self.write_record(others)
            for path in (unquote(urlparse(f).path) for f in files):
                os.remove(path)
                checksum = f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc"
                if os.path.exists(checksum):
                    os.remove(checksum)
        for table in ("nodes", "nodechunks"):
            shutil.rmtree(f"{self.dir}/{table}/snapshot_id={snapshot_id}", ignore_errors=True)


class FlatCatalog:
    """Read-only view of a directory with one Parquet file for each snapshot and table."""

    PATHS = {"snapshots": "meta/snapshots", "nodes": "nodes", "nodechunks": "nodechunks", "chunks": "meta/chunks", "packs": "meta/packs"}

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.dir = spark, os.path.abspath(directory)

    def table(self, name: str) -> DataFrame:
        path = f"{self.dir}/{self.PATHS[name]}"
        if not os.path.isdir(path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        files = self.spark.read.schema(SCHEMAS[name]).parquet(path)
        if name == "nodechunks":
            files = files.withColumn("snapshot_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", ""))
        if name in ("chunks", "packs"):
            # the consolidated file counts as oldest of equals would: later file names, then later rows, win
            files = last_wins(files.withColumn("_file", F.col("_metadata.file_name")).withColumn("_row", F.col("_metadata.row_index")), "hash" if name == "chunks" else "pack_id", "_file", "_row")
        return conform(files, name)
