"""WARC archives and their Merkle fixity audit.

A manifest lists the records of an archive: file, offset, length and SHA-256.  It is either
planned from the pages (:func:`manifest`) or read from stored files (:func:`read_archives`).
A tree is built over it bottom-up: records, ranges of offsets that grow by a factor of 16,
files, groups of 64 files, groups of those, and one root; the number of levels follows the
largest offset and file number, so that no node has more than 64 children and a range holds
records of 64 KiB.  Two replicas are compared from the root down; each level's differing
nodes are written, and of the next level only their children are compared.  What is left at
the bottom are the ranges that hold damage, and there the records themselves are compared.

Equal records (repeated rows) are one manifest row with a number of ``copies``, stored one
after the other.  A file takes its records by the first digits of their hash, so that no
host or id fills a file.

Defined results: a null url or payload is an empty string, a null ``page_id`` is kept and
sorted first; equal rows are audited together; an empty table has no root and no damage;
other columns of the input are ignored.  In stored files, bytes that are no whole record (cut
off, without a readable length, or with a length that doesn't lead to the record's end) are
one record that is not ``whole``, up to the next line that begins a record; a payload that is
no UTF-8 is hashed as it is and shown with replacement characters; an empty file has no records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_table, materialise, table

_END = "\r\n\r\n"
_RANGE = 16  # bits of the lowest offset ranges
_WIDER = 4  # bits by which ranges grow
_GROUP = 6  # bits of a group of files, and of a group of groups


def record(url: Column, payload: Column) -> Column:
    """A WARC resource record without the empty lines that end it."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_END), body)


def write_archives(pages: DataFrame, path: str, records_per_file: int = 4096) -> None:
    """Write records as WARC files."""
    pages.select(record(F.col("url"), F.col("html")).alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", records_per_file).text(path)


def records(data: bytes) -> Iterator[tuple[int, int, bool, bytes, bytes]]:
    """``(offset, end, whole, url, payload)`` of the records of a file; see the module for damaged ones."""
    at, mark = 0, _END.encode()
    while at < len(data):
        head = data.find(mark, at)
        fields = dict(line.partition(b":")[::2] for line in data[at : max(head, at)].split(b"\r\n")[1:])
        size = fields.get(b"Content-Length", b"").strip()
        end = head + len(mark) + int(size) if head >= 0 and size.isdigit() and len(size) < 19 else -1
        if data.startswith(b"WARC/", at) and end >= 0 and data[end : end + len(mark)] == mark and data[end + len(mark) : end + len(mark) + 5] in (b"WARC/", b""):
            yield at, end, True, fields.get(b"WARC-Target-URI", b"").strip(), data[head + len(mark) : end]
        else:
            end = data.find(mark + b"WARC/1.", at + 1)
            end = len(data) if end < 0 else end
            yield at, end, False, fields.get(b"WARC-Target-URI", b"").strip(), b""
        at = end + len(mark)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files: ``file``, ``offset``, ``length``, ``whole``, ``url``, ``payload`` and ``digest`` of the record's bytes.

    A file is read by one task, whole (archives are split into files of about 1 GB, 2 GB at
    most); its records leave the task in batches of 256.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "offset", "length", "whole", "url", "payload", "digest"]
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                rows = []
                for at, end, whole, url, payload in records(data):
                    rows.append((name, at, end - at, whole, url.decode(errors="replace"), payload.decode(errors="replace") if payloads else None, hashlib.sha256(data[at:end]).hexdigest()))
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, offset long, length long, whole boolean, url string, payload string, digest string")


def stored_manifests(spark: SparkSession, primary: str, replica: str) -> tuple[DataFrame, DataFrame]:
    """The manifests of two stored archives, whose files are equal if their paths below the folders are.

    Files are numbered in the order of their paths: one row per file passes through one task.
    """

    def read(path: str, name: str) -> DataFrame:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
        found = read_archives(spark, path, payloads=False).drop("payload")
        below = F.col("file").substr(F.instr("file", F.lit(root)) + len(root) + 1, F.length("file"))
        return materialise(found.withColumn("file", below), name)

    one, two = read(primary, "stored-a"), read(replica, "stored-b")
    files = one.select("file").union(two.select("file")).distinct()
    numbers = materialise(files.withColumn("file_id", F.row_number().over(Window.orderBy("file")).cast("long") - 1), "stored-files")
    number = lambda df: df.join(numbers, "file").withColumn("copies", F.lit(1).cast("long"))
    return number(one), number(two)


def audit_archives(spark: SparkSession, primary: str, replica: str) -> DataFrame:
    """:func:`audit` of two stored archives, with the ``file`` and ``url`` of each damaged record."""
    return audit(*stored_manifests(spark, primary, replica), names=("file", "url"))


def manifest(pages: DataFrame, damaged: Column | None = None) -> DataFrame:
    """Records in files with offsets; ``found`` is the hash of ``damaged``, a replica's bytes (null: lost)."""
    bytes_ = record(F.col("url"), F.col("html"))
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), (F.octet_length(bytes_) + len(_END)).cast("long").alias("length"), F.sha2(bytes_.cast("binary"), 256).alias("digest"), *([F.sha2(damaged.cast("binary"), 256).alias("found")] if damaged is not None else []))
    distinct = hashed.groupBy(*hashed.columns).agg(F.count("*").alias("copies"))
    filed = distinct.withColumn("file_id", F.floor(F.coalesce("page_id", F.lit(-1)) / (1 << 20)).cast("long") * 4096 + F.conv(F.substring("digest", 1, 3), 16, 10).cast("long"))
    before = Window.partitionBy("file_id").orderBy(F.col("page_id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    return filed.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).cast("long"))


def _node(order: str, digest: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda x: x[digest]), ""), 256)


def _steps(*manifests: DataFrame) -> list[tuple[str, int]]:
    """By how many bits slots, then files, are grouped from each level to the next, for trees of one shape."""
    ends = [m.agg(F.max("offset"), F.min("file_id"), F.max("file_id")).first() for m in manifests]
    offset = max((e[0] or 0 for e in ends), default=0) >> _RANGE
    files = max((max(e[2] or 0, -1 - (e[1] or 0)) for e in ends), default=0)
    slots = max(1, -(-offset.bit_length() // _WIDER))
    return [("slot", _WIDER)] * slots + [("file", _GROUP)] * -(-files.bit_length() // _GROUP) + [("file", 63)]


class Tree:
    """The levels of a tree, from ranges of offsets up to the root.

    ``levels[i]`` has ``file_id``, ``slot``, ``up_file``, ``up_slot`` and ``hash``.  The last
    step joins the two halves of file numbers, those below 0 (records without an id) and the rest.
    """

    def __init__(self, records: DataFrame, name: str, steps: list[tuple[str, int]] | None = None):
        """``records``: ``file_id``, ``offset``, ``digest`` and ``copies``."""
        leaves = records.select("file_id", F.shiftright("offset", _RANGE).alias("slot"), "offset", F.concat("digest", F.lit("*"), F.col("copies").cast("string")).alias("digest"))
        level = leaves.groupBy("file_id", "slot").agg(_node("offset", "digest").alias("hash"))
        self.levels: list[DataFrame] = []
        for i, (kind, bits) in enumerate(steps or _steps(records)):
            up_file, up_slot = F.col("file_id"), F.col("slot")
            if kind == "slot":
                up_slot = F.shiftright("slot", bits)
            else:
                up_file = F.shiftright("file_id", bits) if bits < 63 else F.lit(0).cast("long")
            level = materialise(level.withColumn("up_file", up_file).withColumn("up_slot", up_slot), f"{name}-{i}")
            self.levels.append(level)
            order = "slot" if kind == "slot" else "file_id"
            level = level.groupBy(F.col("up_file").alias("file_id"), F.col("up_slot").alias("slot")).agg(_node(order, "hash").alias("hash"))
        self.root = materialise(level, f"{name}-root")


def differing_ranges(one: Tree, two: Tree) -> DataFrame:
    """``file_id``, ``slot`` of the lowest ranges below which the trees differ, found from the roots down."""

    def differ(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        b = b.select(F.col("file_id").alias("f2"), F.col("slot").alias("s2"), F.col("hash").alias("h2"))
        both = a.select("file_id", "slot", "hash").join(b, (F.col("file_id") == F.col("f2")) & (F.col("slot") == F.col("s2")), "full")
        return materialise(both.where(~F.col("hash").eqNullSafe(F.col("h2"))).select(F.coalesce("file_id", "f2").alias("file_id"), F.coalesce("slot", "s2").alias("slot")), name)

    below = differ(one.root, two.root, "frontier")
    for a, b in zip(reversed(one.levels), reversed(two.levels), strict=True):
        if below.isEmpty():
            return below
        above = below.select(F.col("file_id").alias("up_file"), F.col("slot").alias("up_slot"))
        lower = differ(a.join(above, ["up_file", "up_slot"], "left_semi"), b.join(above, ["up_file", "up_slot"], "left_semi"), "frontier")
        drop_table(below)
        below = lower
    return below


def audit(primary: DataFrame, replica: DataFrame, names: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Damaged records: ``altered``, ``missing`` or ``unexpected`` in the replica.

    Both have ``file_id``, ``offset``, ``length``, ``copies``, ``digest`` and the columns ``names``.
    """
    steps = _steps(primary, replica)
    one, two = Tree(primary, "merkle-a", steps), Tree(replica, "merkle-b", steps)
    ranges = differing_ranges(one, two)
    for level in [*one.levels, *two.levels, one.root, two.root]:
        drop_table(level)
    inside = lambda df: df.withColumn("slot", F.shiftright("offset", _RANGE)).join(ranges, ["file_id", "slot"], "left_semi")
    a, b = inside(primary).alias("a"), inside(replica).alias("b")
    both = a.join(b, (F.col("a.file_id") == F.col("b.file_id")) & (F.col("a.offset") == F.col("b.offset")), "full")
    bad = both.where(~(F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.copies").eqNullSafe(F.col("b.copies"))))
    either = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    status = F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "unexpected").otherwise("altered")
    return bad.select(*[either(c) for c in (*names, "file_id", "offset", "length", "copies")], status.alias("status"), F.col("a.digest").alias("expected"), F.col("b.digest").alias("found"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit the archive of all pages against a replica with planted damage.

    The replica lost the records whose hash starts with 01 and has a byte too many in those
    with 00, about one in 128 together; the audit has to find these records and no others.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    bytes_ = record(F.col("url"), F.col("html"))
    start = F.substring(F.sha2(bytes_.cast("binary"), 256), 1, 2)
    stored = materialise(manifest(pages, F.when(start == "01", None).when(start == "00", F.concat(bytes_, F.lit("!"))).otherwise(bytes_)), "manifest")
    primary = stored.drop("found")
    replica = stored.where("found IS NOT NULL").drop("digest").withColumnRenamed("found", "digest")
    return audit(primary, replica)


ORACLE = r"""
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))
         || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS bytes FROM pages),
h AS (SELECT page_id, (octet_length(encode(bytes)) + 4)::BIGINT AS length, sha256(bytes) AS expected,
             CASE substr(sha256(bytes), 1, 2) WHEN '01' THEN NULL WHEN '00' THEN sha256(bytes || '!') ELSE sha256(bytes) END AS found FROM r),
d AS (SELECT page_id, length, expected, found, count(*)::BIGINT AS copies,
             floor(coalesce(page_id, -1) / 1048576)::BIGINT * 4096 + ('0x' || substr(expected, 1, 3))::BIGINT AS file_id FROM h GROUP BY ALL),
o AS (SELECT *, (coalesce(sum(length * copies) OVER (PARTITION BY file_id ORDER BY page_id NULLS FIRST, expected ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM d)
SELECT page_id, file_id, "offset", length, copies, CASE WHEN found IS NULL THEN 'missing' ELSE 'altered' END AS status, expected, found
FROM o WHERE found IS DISTINCT FROM expected
"""
