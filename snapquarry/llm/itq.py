"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations that turn centred vectors into balanced bits are learned on a bounded sample, from
several starts.  A code is a row's bits under all rotations.  It is cut into substrings;
each substring is a table of its own, and two vectors meet in every table in which a
substring of theirs agrees.  Within a bucket codes are compared by their Hamming distance;
who is near enough is linked, and the components are candidate groups.  Only then the
original vectors are fetched, for members of groups, and all pairs within a group are
compared in double precision.

Substrings have about log2(rows / 32) bits, so buckets stay small however many rows there
are.  How many tables are needed follows from the largest angle that two vectors of the
least cosine can have as seen from the mean of the sample: if the rows share a mean, angles
seen from it are wider, bits differ more often, and there are more and shorter substrings.
Pairs at the least cosine are missed with a probability of ``miss`` at most; the limit of the
Hamming distance lies five standard deviations above what such pairs have.

Only pairs of equal labels and lengths meet.  Buckets and groups of many rows are split into
blocks, and pairs of blocks are tasks of their own; tasks return counts of links and one link
for each row, never the pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, or have
no label, link with nothing; every row is a vector of its own, so rows with equal ids, or
without one, count as linked if their vectors are; the component is the smallest ``vec_id``
reached, nulls last; vectors of other lengths than the sample's get random rotations; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .candidates import candidate_groups, pairs_of_blocks
from .components import connected_components
from .runs import single_runs, smallest_linked
from .shared import drop_table, map_arrow, materialise, table
from .vectors import matrix, sample, usable

#: Components of a block of a candidate group, unless it is a single vector.
_BLOCK_COMPONENTS = 1 << 20


class Codes:
    """Learned rotations, and how the codes are cut into tables."""

    def __init__(self, data: np.ndarray, rows: int, least: float, miss: float = 1e-4, bucket: int = 32, most_tables: int = 64, rounds: int = 50, seed: int = 11):
        unit = data / np.linalg.norm(data, axis=1, keepdims=True)
        self.d, self.seed = data.shape[1], seed
        self.mean = unit.mean(axis=0)
        centred = unit - self.mean
        # the angle under which the mean sees two vectors of the least cosine, for rows near the mean
        radius = max(float(np.quantile(np.linalg.norm(centred, axis=1), 0.01)), 1e-9)
        differ = 2 * math.asin(min(1.0, math.sqrt(2 - 2 * least) / 2 / radius)) / math.pi
        self.bits = max(1, round(math.log2(max(rows, 2) / bucket)))
        needed = lambda bits: math.ceil(math.log(miss) / math.log1p(-((1 - differ) ** bits))) if differ < 1 else most_tables
        while self.bits > 1 and needed(self.bits) > most_tables:
            self.bits -= 1
        self.tables = needed(self.bits) if differ > 0 else 1
        self.length = max(256, -(-self.tables * self.bits // 64) * 64)
        self.limit = math.ceil(self.length * differ + 5 * math.sqrt(self.length * differ * (1 - differ)) + 1)
        # principal directions, all of them: each rotation gives as many bits as there are components
        _, directions = np.linalg.eigh(centred.T @ centred)
        projected = centred @ directions
        rng = np.random.default_rng(seed)
        self.rotations = []
        for _ in range(-(-self.length // self.d)):
            turn = np.linalg.qr(rng.normal(size=(self.d, self.d)))[0]
            for _ in range(rounds):
                bits_now = np.where(projected @ turn >= 0, 1.0, -1.0)
                u, _, vt = np.linalg.svd(projected.T @ bits_now)
                turn = u @ vt
            self.rotations.append(directions @ turn)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes, and the substring of each table."""
        d = vectors.shape[1]
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        if d == self.d:
            unit, rotations = unit - self.mean, self.rotations
        else:
            rng = np.random.default_rng([self.seed, d])
            rotations = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-self.length // d))]
        on = np.concatenate([unit @ r >= 0 for r in rotations], axis=1)[:, : self.length]
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        cut = on[:, : self.tables * self.bits].reshape(len(on), self.tables, self.bits)
        return np.packbits(on, axis=1), cut @ weights


def _near(limit: int):
    def test(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= limit

    return test


def _encode(rows: DataFrame, codes) -> DataFrame:
    """``row``, ``label``, ``d``, packed ``code`` and ``subs`` of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                code, subs = codes.value.encode(matrix(part.column("v"), d).astype(np.float64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, subs.size + 1, subs.shape[1], dtype=np.int32)), pa.array(subs.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("label"), part.column("d"), pa.array([c.tobytes() for c in code], pa.binary()), lists], ["row", "label", "d", "code", "subs"])

    return map_arrow(rows, run, "row long, label long, d int, code binary, subs array<long>")


def _compare(least: float, group: list[str]):
    """Links of a pair of blocks, by the sum of products in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in single_runs(batches, group):
            if rows.num_rows < 2:
                continue
            nodes, own = (rows.column(c).to_numpy() for c in ("row", "own"))
            x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
            v = matrix(rows.column("v"), rows.column("d")[0].as_py()).astype(np.float64)
            v /= np.abs(v).max(axis=1)[:, None]  # squares of very large or small components stay finite
            unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
            one, two = (np.arange(len(nodes)),) * 2 if x == y else (np.flatnonzero(own == x), np.flatnonzero(own == y))
            if not len(one) or not len(two):
                continue
            hit = unit[one] @ unit[two].T >= least - 1e-9
            if x == y:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            i, j = one[i], two[j]
            keep = np.concatenate([np.zeros(0, bool), *((unit[i[a : a + 65536]] * unit[j[a : a + 65536]]).sum(axis=1) >= least for a in range(0, len(i), 65536))])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            n = np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
            roots = smallest_linked(len(nodes), i, j)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[roots[at]]), pa.array(n[at].astype(np.int64))], ["a", "b", "n"])

    return run


def _links(rows: DataFrame, least: float, miss: float, sample_rows: int, block: int) -> DataFrame:
    """``a``, ``b`` and ``n``: the links of each row that has some, and a row that they reach."""
    spark = rows.sparkSession
    data = sample(rows, sample_rows, "vec_id", "v")
    if not len(data):
        return spark.createDataFrame([], "a long, b long, n long")
    codes = Codes(data, rows.count(), least, miss)
    sent = spark.sparkContext.broadcast(codes)
    coded = materialise(_encode(rows, sent), "itq-codes")
    entries = coded.select("label", "d", F.posexplode("subs").alias("t", "sub"), F.col("row").alias("node"), F.col("code").alias("sketch"))
    groups = candidate_groups(entries, ["label", "d", "t", "sub"], _near(codes.limit), np.uint8, codes.length // 8, "itq", block)
    members = rows.join(groups, F.col("row") == F.col("node")).select("row", "v", "d", "group")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("d") / _BLOCK_COMPONENTS)).cast("int")
    sizes = materialise(members.groupBy("group").agg(blocks.alias("blocks")), "itq-sizes")
    pairs = pairs_of_blocks(members.join(sizes, "group"), "row", F.col("blocks"), ["group"], ["row", "v", "d"])
    found = materialise(map_arrow(pairs, _compare(least, ["group", "x", "y"]), "a long, b long, n long"), "itq-links")
    for gone in (coded, groups, sizes):
        drop_table(gone)
    sent.unpersist()
    return found


def near_duplicates(vectors: DataFrame, least: float = 0.98, miss: float = 1e-4, sample_rows: int = 10_000, block: int = 1024) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``vectors`` (``vec_id``, ``embedding``, ``label``)."""
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("label").alias("label"), (F.col("label").isNotNull() & usable(F.col("embedding"))).alias("usable"), F.col("embedding").cast("array<double>").alias("v"))
    stored = materialise(numbered.withColumn("d", F.coalesce(F.size("v"), F.lit(0))), "itq-rows")
    rows = stored.where("usable")
    links = _links(rows, least, miss, sample_rows, block)
    counts = links.groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n"))
    parts = connected_components(links.select("a", "b"), "itq").select(F.col("node").alias("row"), F.col("component").alias("part"))
    linked = parts.join(counts, "row").join(stored.select("row", "vec_id"), "row")
    smallest = linked.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    known = linked.join(smallest, "part").select("row", "n", "component_id")
    joined = stored.select("row", "vec_id").join(known, "row", "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op9_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


# Every pair of vectors; ids are unique and components finite in the tables that this is run on.
ORACLE = r"""
WITH RECURSIVE
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
      WHERE list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e) * list_inner_product(y.e, y.e)) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*)::BIGINT AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN root USING (vec_id) LEFT JOIN n USING (vec_id)
"""
