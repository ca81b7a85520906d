"""Nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a string of 64 bits, one for the side of each of 64 random
hyperplanes through the middle of a bounded sample, and keeps the strings in a sorted
array.  A query descends in every tree to its longest matching prefix, of whatever length,
and all trees then ascend together, one bit at a time, until their ranges hold ``postings``
entries for each row of the array and, of rows with other ids than the query's, at least ``k``
and ``share`` of the array, or the root is reached.  The candidates get exact distances.

The arrays are built over blocks of rows, so a task holds one block; all rows are indexed.
Queries come in blocks of bounded size, each sent to all tasks; the ten best of each block
of rows are merged.  The share of rows that must be looked at for a recall of 0.9 depends on
the data: near-uniform vectors of 64 dimensions need about half of them.

Defined results: vectors that are null, zero, or hold null or non-finite components, or have
another length than most, take no part; rows with the query's own id are not its candidates;
of queries with equal ids the smallest vector counts; ties go to the smaller ``vec_id``; rows
with equal ids are candidates of their own; fewer rows give fewer neighbours, an empty table
none; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import map_arrow, materialise, table
from .vectors import matrix, sample, usable

_BITS = 64


class Forest:
    """The hyperplanes of all trees."""

    def __init__(self, data: np.ndarray, trees: int, seed: int = 7):
        rng, d = np.random.default_rng(seed), data.shape[1]
        self.d = d
        self.planes = []
        for _ in range(trees):
            blocks = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-_BITS // d))]
            self.planes.append(np.concatenate(blocks, axis=1)[:, :_BITS])
        self.middles = [np.median(data @ p, axis=0) for p in self.planes]

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """One row of 64-bit strings for each tree."""
        weights = np.uint64(1) << np.arange(_BITS - 1, -1, -1, dtype=np.uint64)
        return np.stack([((vectors @ p > m) * weights).sum(axis=1, dtype=np.uint64) for p, m in zip(self.planes, self.middles, strict=True)])


class SortedBlock:
    """The sorted arrays of a block of rows."""

    def __init__(self, forest: Forest, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        strings = forest.strings(vectors)
        self.orders = np.argsort(strings, axis=1, kind="stable")
        self.strings = np.take_along_axis(strings, self.orders, axis=1)

    def candidates(self, strings: np.ndarray, query_ids: np.ndarray, postings: float, least: float) -> list[np.ndarray]:
        """For each query (column of ``strings``) a mask of rows of other ids, ``least`` of them or all there are."""
        n, queries, wanted = len(self.ids), strings.shape[1], postings * len(self.ids)
        masks = [np.zeros(0, bool)] * queries
        open_ = np.ones(queries, bool)
        for length in range(_BITS, -1, -1):
            rest = np.uint64((1 << (_BITS - length)) - 1)
            at = np.flatnonzero(open_)
            low = np.stack([np.searchsorted(s, q & ~rest, "left") for s, q in zip(self.strings, strings[:, at], strict=True)])
            high = np.stack([np.searchsorted(s, q | rest, "right") for s, q in zip(self.strings, strings[:, at], strict=True)])
            # a row has a posting in each tree, so enough postings may still be few rows
            for j in np.flatnonzero(((high - low).sum(axis=0) >= wanted) | (length == 0)).tolist():
                mask = np.zeros(n, bool)
                for order, a, b in zip(self.orders, low[:, j].tolist(), high[:, j].tolist(), strict=True):
                    mask[order[a:b]] = True
                mask &= self.ids != query_ids[at[j]]
                if length == 0 or np.count_nonzero(mask) >= least:
                    masks[at[j]] = mask
                    open_[at[j]] = False
            if not open_.any():
                break
        return masks


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = 24, postings: float = 1.2, share: float = 0.5, sample_rows: int = 10_000, rows_per_block: int = 4096, queries_per_block: int = 4096) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the nearest rows found of ``vectors`` for each of ``queries``.

    Both have ``vec_id`` and ``embedding``.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    data = sample(vectors, sample_rows)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(data):
        return empty
    forest = spark.sparkContext.broadcast(Forest(data, trees))
    d = data.shape[1]
    part = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")) & (F.size("v") == d))
    rows = part(vectors)
    asked = part(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = -(-asked.count() // queries_per_block)
    found = []
    for block in range(blocks):
        # hashes spread the ids, so a block has about queries_per_block of them
        now = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in now], np.int64), np.array([r["v"] for r in now], np.float64).reshape(len(now), d)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query_ids, query_vectors = sent.value
            if not len(query_ids):
                return
            strings = forest.value.strings(query_vectors)
            held: list[pa.RecordBatch] = []
            for batch in _blocks(batches, rows_per_block, held):
                ids, x = batch.column("vec_id").to_numpy(zero_copy_only=False), matrix(batch.column("v"), d)
                index = SortedBlock(forest.value, ids, x)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for a in range(0, len(query_ids), 256):
                    for q, mask in enumerate(index.candidates(strings[:, a : a + 256], query_ids[a : a + 256], postings, max(k, share * len(ids))), a):
                        at = np.flatnonzero(mask)
                        far = np.sqrt(((x[at] - query_vectors[q]) ** 2).sum(axis=1))
                        best = np.lexsort((ids[at], far))[:k]
                        out.append((np.full(len(best), query_ids[q]), ids[at][best], far[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

        found.append(materialise(map_arrow(rows, run, schema), "forest-found"))
    if not found:
        return empty
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined to ``rows`` rows, the last one shorter."""
    count = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - count)
            held.append(part)
            count += part.num_rows
            at += part.num_rows
            if count == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held.clear()
                count = 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 100 = 0"))
