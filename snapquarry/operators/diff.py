"""Incremental differences between a file tree and its parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _unchanged(cur: str, old: str) -> Column:
    same = (F.col(f"{cur}.type") == "file") & (F.col(f"{old}.type") == "file") & (F.col(f"{cur}.size") == F.col(f"{old}.size")) & (F.col(f"{cur}.mtime") == F.col(f"{old}.mtime"))
    return F.coalesce(same, F.lit(False))


def carry_forward(current: DataFrame, parent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the parent that stand unchanged, and rows of the current walk to be read.

    Files are unchanged if size and modification time agree; mode and owner don't count, the
    parent's are carried.  The comparison needs no byte of any file.
    """
    last = parent.dropDuplicates(["path"])
    joined = current.alias("c").join(last.alias("p"), F.col("c.path") == F.col("p.path"), "left").withColumn("_same", _unchanged("c", "p"))
    return joined.where("_same").select("p.*"), joined.where("NOT _same").select("c.*")


def changes(current: DataFrame, parent: DataFrame, key: str = "path", compare: tuple[str, ...] = ("size", "mtime")) -> DataFrame:
    """``added``, ``removed``, ``changed`` or ``unchanged`` for every key of either side."""
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"p.{c}"))
    both = current.alias("c").join(parent.alias("p"), F.col(f"c.{key}") == F.col(f"p.{key}"), "full")
    status = F.when(F.col(f"p.{key}").isNull(), "added").when(F.col(f"c.{key}").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    sides = [F.col(f"{side}.{c}").alias(f"{name}_{c}") for c in compare for side, name in (("p", "old"), ("c", "new"))]
    return both.select(F.coalesce(f"c.{key}", f"p.{key}").alias(key), *sides, status.alias("status"))


def stats(changed: DataFrame) -> DataFrame:
    return changed.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("new_size"), F.lit(0)).alias("bytes"))
