"""Integrity: references without an index entry, blobs that don't hash to their name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_chunks(nodechunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every reference to a chunk that isn't indexed."""
    return nodechunks.join(chunks.select("hash"), "hash", "left_anti")


def locate(nodechunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """References with the places of their chunks; null where there is none."""
    return nodechunks.join(chunks, "hash", "left")


def stats(snapshots: DataFrame, nodes: DataFrame, nodechunks: DataFrame) -> DataFrame:
    """Snapshots, files and chunk references; a reference counts each time."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    files = nodes.where("type = 'file'")
    refs = nodechunks.join(files.select("snapshot_id", "path"), ["snapshot_id", "path"], "left_semi")
    return one(snapshots, "snapshots").crossJoin(one(files, "files")).crossJoin(one(refs, "chunks"))
