"""Chunk and pack indexes, ordered chunk lists, live sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import content_hash


def last_wins(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row for each key, the last in the given order (ascending)."""
    latest = [F.desc(o) if isinstance(o, str) else o for o in order]
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*latest))).where("_nth = 1").drop("_nth")


def union_with_override(key: str, order: str, *tables: DataFrame) -> DataFrame:
    """Tables by name, later ones overriding earlier ones for a key."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn(order, F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return last_wins(out, key, order).drop(order)


def live_index(chunks: DataFrame) -> DataFrame:
    """All indexed hashes, referenced or not."""
    return chunks.select("hash").distinct()


def ordered_chunks(nodechunks: DataFrame, *keys: str) -> DataFrame:
    """The hashes of each node by ``seq``."""
    pairs = F.array_sort(F.collect_list(F.struct("seq", "hash")))
    return nodechunks.groupBy(*keys).agg(F.transform(pairs, lambda p: p["hash"]).alias("chunks"))


def with_chunks(nodes: DataFrame, nodechunks: DataFrame) -> DataFrame:
    """Nodes with their chunk lists; files without chunks have an empty one."""
    folded = ordered_chunks(nodechunks, "snapshot_id", "path")
    return nodes.join(folded, ["snapshot_id", "path"], "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))


def explode_chunks(nodes: DataFrame, *keys: str) -> DataFrame:
    """The reverse: a row for each chunk, numbered from 0."""
    return nodes.select(*keys, F.posexplode("chunks").alias("seq", "hash")).withColumn("seq", F.col("seq").cast("long"))


def content_hashes(nodechunks: DataFrame, *keys: str) -> DataFrame:
    return ordered_chunks(nodechunks, *keys).select(*keys, content_hash(F.col("chunks")).alias("content_hash"))


def live_set(nodechunks: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Hashes that surviving snapshots refer to."""
    if snapshots is not None:
        nodechunks = nodechunks.join(snapshots.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi")
    return nodechunks.select("hash").distinct()


def committed(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows of snapshots whose record was written, which is the last step of a backup."""
    return rows.join(snapshots.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi")


def in_any(rows: DataFrame, key: str, *sets: DataFrame) -> DataFrame:
    """Rows whose key is in the union of the sets."""
    union = sets[0].select(key)
    for s in sets[1:]:
        union = union.union(s.select(key))
    return rows.join(union.distinct(), key, "left_semi")


def first_occurrences(candidates: DataFrame, order: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """Candidate chunks not known yet, the first of each hash."""
    if known is not None:
        candidates = candidates.join(known.select("hash"), "hash", "left_anti")
    return candidates.withColumn("_nth", F.row_number().over(Window.partitionBy("hash").orderBy(*order))).where("_nth = 1").drop("_nth")
