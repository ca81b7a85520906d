"""Token-ID output: Parquet list columns with selective reads.

Each row of the files is a document: ``doc_id``, ``part``, ``start_in_part``,
``n_tokens`` and ``ids``.  Documents stand in ascending order within and across files.
Ids are dictionary coded (format 2 pages fall back to delta coding when a dictionary
grows too large); row groups and pages are small enough, and their indexes complete
enough, that a reader fetches the pages of some documents or only the metadata columns.

Defined results: a null text is an empty one; repeated rows and equal ``doc_id`` values
are all kept, ordered by a hash of the text; rows with a null ``doc_id`` come first; an empty table
gives empty files; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoder import encoder
from .shared import map_arrow, materialise, shared_path

LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def _slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows whose texts have about ``limit`` characters, at least one row each."""
    texts, at, size = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        text = text.as_py()
        texts.append(text)
        size += len(text or "")
        if size >= limit:
            yield at, texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield at, texts


def tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Tokens of each document, in ascending order, with running offsets in each partition."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows of one id are dealt by the hashes of their texts, equal rows by their place
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_nth", F.monotonically_increasing_id())
    order = ["doc_id", "_hash", "text", "_nth"]
    ordered = rows.repartitionByRange("doc_id", "_hash", "_nth").sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        with encoder(tokenizer, keep=True) as enc:
            for batch in batches:
                for at, texts in _slices(batch, "text"):
                    packed = [ids + end for ids in enc.encode(texts)]
                    n = np.array([len(p) // 4 for p in packed], np.int64)
                    ends = np.cumsum(n)
                    values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(at, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n), lists],
                        ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                    )
                    start += int(n.sum())

    return map_arrow(ordered, encode, _SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, **layout: str) -> str:
    """Write the token files of ``docs`` (``doc_id``, ``text``) and return their path."""
    tokenise(docs, tokenizer, end_id).write.options(**(LAYOUT | layout)).parquet(path)
    return path


def _with_start(files: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of ``files`` with their ``start`` in the whole, from the first offset of each part.

    There is one base for each written partition; Spark broadcasts them below its threshold.
    """
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    bases = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    bases = materialise(bases.coalesce(1), "token-bases")
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("start_in_part")).drop("base", "part", "start_in_part")


def read_tokens(spark: SparkSession, path: str, doc_ids: tuple[int, int] | None = None, metadata_only: bool = False) -> DataFrame:
    """Token rows with their ``start`` in the whole; ``doc_ids`` (inclusive) and ``metadata_only`` limit what is fetched."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    rows = files.drop("ids") if metadata_only else files
    if doc_ids:
        rows = rows.where(F.col("doc_id").between(*doc_ids))
    return _with_start(files, rows)


def digest(tokens: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, the number of ids, and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    kept = ", ".join(f"{c} long" for c in keep)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(values)).cast("B")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array((offsets[1:] - offsets[:-1]).astype(np.int64)), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.int64())],
                [*keep, "n_ids", "ids_crc32"],
            )

    return map_arrow(tokens.select(*keep, "ids"), crc, f"{kept}, n_ids long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode all documents, write them, read the files back and digest what they hold."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = write_tokens(docs, shared_path(spark, "tokens"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id)
    files = spark.read.schema(_SCHEMA).parquet(path)
    read = digest(files.withColumn("part", F.col("part").cast("long")), "doc_id", "part", "start_in_part")
    return _with_start(files, read).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")
