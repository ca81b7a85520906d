"""Candidate groups: rows that meet in hash buckets and whose sketches are alike.

A row has one entry for each bucket it falls in, with a node and a sketch of fixed size.
Within a bucket sketches are compared; whoever is alike is linked.  A task does not return
the pairs: it walks from node to node and returns one link for each node it reaches, so a
bucket of n near copies costs n comparisons and n links.  The components of the links are
the candidate groups, and every pair of alike rows that met lies within one of them.

A bucket of more than ``block`` entries is cut into blocks, and each pair of blocks is a
piece of work of its own.  The pairs within a group are verified in the same way: see
``pairs_of_blocks``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runs import fixed_width, smallest_linked, whole_runs
from .shared import drop_table, map_arrow, materialise

#: ``alike(one, two)``: which rows of two equally long arrays of sketches are alike.
Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]

_SMALL = 8


def pairs_of_blocks(rows: DataFrame, key: str, blocks: Column, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each row once for each pair of blocks (``x`` <= ``y``) that its own block ``own`` is in.

    Rows of the same ``order`` columns, ``x`` and ``y`` stand together, sorted by ``key``.
    """
    placed = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    by = [*order, "x", "y"]
    return dealt.select(*by, "own", *columns).repartition(*by).sortWithinPartitions(*by, key)


def _small_runs(bounds: np.ndarray, sketches: np.ndarray, alike: Alike) -> tuple[np.ndarray, np.ndarray]:
    """Links within all runs of at most ``_SMALL`` rows, distance by distance."""
    sizes = np.diff(bounds)
    last = np.repeat(bounds[1:], sizes)
    small = np.repeat(sizes <= _SMALL, sizes)
    at, ones, twos = np.arange(len(last)), [], []
    for step in range(1, _SMALL):
        i = at[small & (at + step < last)]
        if not len(i):
            break
        for a in range(0, len(i), 1 << 14):
            one = i[a : a + (1 << 14)]
            one = one[alike(sketches[one], sketches[one + step])]
            ones.append(one)
            twos.append(one + step)
    return (np.concatenate(ones), np.concatenate(twos)) if ones else (at[:0], at[:0])


def _walk(sketches: np.ndarray, own: np.ndarray, x: int, y: int, alike: Alike) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what alike pairs connect: pairs across the blocks ``x`` and ``y``, or within one."""
    n = len(own)
    open_ = np.ones(n, bool)
    froms, tos = [], []
    for start in range(n):
        if not open_[start]:
            continue
        open_[start] = False
        frontier = [start]
        while frontier:
            now = frontier.pop()
            left = np.flatnonzero(open_ & (own != own[now]) if x != y else open_)
            hit = np.concatenate([left[a : a + 4096][alike(np.broadcast_to(sketches[now], (len(left[a : a + 4096]), sketches.shape[1])), sketches[left[a : a + 4096]])] for a in range(0, len(left), 4096)] or [left])
            open_[hit] = False
            froms.append(hit)
            tos.append(np.full(len(hit), start))
            frontier += hit.tolist()
    return (np.concatenate(froms), np.concatenate(tos)) if froms else (np.zeros(0, np.int64),) * 2


def links(entries: DataFrame, buckets: Sequence[str], alike: Alike, dtype: type, width: int, block: int, bare: DataFrame | None = None) -> DataFrame:
    """``a`` and ``b``: links between the alike nodes of each bucket.

    ``entries``: the ``buckets`` columns (numbers), ``node`` (long) and ``sketch`` (binary,
    ``width`` items of ``dtype``), each once.  ``bare`` has the same rows without sketches,
    to be counted.
    """
    buckets = list(buckets)
    many = (entries if bare is None else bare).groupBy(*buckets).agg(F.count("*").alias("n")).where(F.col("n") > block)
    # written, the few large buckets have a known size: Spark broadcasts them below its threshold
    many = materialise(many.select(*buckets, F.ceil(F.col("n") / block).cast("int").alias("_blocks")), "buckets")
    placed = entries.join(many, buckets, "left")
    dealt = pairs_of_blocks(placed, "node", F.coalesce("_blocks", F.lit(1)), buckets, ["node", "sketch"])
    by = [*buckets, "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_runs(batches, by):
            node = batch.column("node").to_numpy()
            own, x, y = (batch.column(c).to_numpy() for c in ("own", "x", "y"))
            sketches = fixed_width(batch.column("sketch"), dtype, width)
            # a small run may be a pair of blocks too; links within a block do no harm
            one, two = _small_runs(bounds, sketches, alike)
            ones, twos = [one], [two]
            for k in np.flatnonzero(np.diff(bounds) > _SMALL).tolist():
                a, b = int(bounds[k]), int(bounds[k + 1])
                f, t = _walk(sketches[a:b], own[a:b], int(x[a]), int(y[a]), alike)
                ones.append(f + a)
                twos.append(t + a)
            roots = smallest_linked(len(node), np.concatenate(ones), np.concatenate(twos))
            at = np.flatnonzero(roots != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[roots[at]])], ["a", "b"])

    return map_arrow(dealt, run, "a long, b long")


def candidate_groups(entries: DataFrame, buckets: Sequence[str], alike: Alike, dtype: type, width: int, name: str, block: int = 1024, bare: DataFrame | None = None) -> DataFrame:
    """``node`` and ``group`` of all nodes alike some other that they meet."""
    found = materialise(links(entries, buckets, alike, dtype, width, block, bare), f"{name}-alike")
    groups = connected_components(found, f"{name}-groups").withColumnRenamed("component", "group")
    drop_table(found)
    return groups
