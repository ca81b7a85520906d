"""A repository: backup, restore, forget, compact, verify and query."""

from __future__ import annotations

import fcntl
import json
import os
import secrets
import shutil
import socket
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import chunking
from .functions.scalars import PACK_HEADER, default_actor, display_time, human_bytes, mode_string, stored_path, stored_roots, type_char, under_prefix
from .operators import diff, index, packs, select, verify
from .operators.select import Selector
from .plans import sql
from .schema import DEFAULT_KIND
from .sources.catalog import Catalog
from .sources.store import LocalStore
from .sources.walker import SCHEMA as WALK_SCHEMA
from .sources.walker import FileTree

FORMAT = 2
_ENTRY = "hash STRING, pack_id STRING, offset BIGINT, comp_length BIGINT, length BIGINT"


class RepositoryError(RuntimeError):
    pass


def _chunk_files(sizes: chunking.ChunkSizes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, real in zip(frame["path"], frame["real_path"], strict=True):
                rows, at = [], 0
                with open(real, "rb") as f:
                    for seq, chunk in enumerate(chunking.split(f.read, sizes)):
                        rows.append((path, seq, chunking.digest(chunk), real, at, len(chunk)))
                        at += len(chunk)
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "seq", "hash", "real_path", "at", "length"])

    return run


def _write_packs(directory: str, target: int, read):
    """Pack the chunks of a task; a pack is named by its content, so a repeated task writes the same packs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, body, rows = LocalStore(directory), bytearray(PACK_HEADER), []

        def flush() -> pd.DataFrame:
            pack = chunking.digest(bytes(body))[:32]
            store.put(f"data/{pack}.pack", bytes(body))
            out = pd.DataFrame([(h, pack, o, c, n) for h, o, c, n in rows], columns=["hash", "pack_id", "offset", "comp_length", "length"])
            body[:] = PACK_HEADER
            rows.clear()
            return out

        for frame in frames:
            for row in frame.itertuples(index=False):
                chunk = read(row)
                if chunking.digest(chunk) != row.hash:
                    raise RepositoryError(f"chunk {row.hash} changed while it was read")
                packed = chunking.deflate(chunk)
                rows.append((row.hash, len(body), len(packed), len(chunk)))
                body += packed
                if len(body) >= target:
                    yield flush()
        if rows:
            yield flush()

    return run


def _from_file(row) -> bytes:
    with open(row.real_path, "rb") as f:
        f.seek(row.at)
        return f.read(row.length)


class _FromPack:
    def __init__(self, directory: str):
        self.directory = directory

    def __call__(self, row) -> bytes:
        return chunking.inflate(LocalStore(self.directory).get_range(f"data/{row.pack_id}.pack", row.offset, row.comp_length))


class Repo:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.dir = spark, os.path.abspath(directory)
        if not os.path.exists(f"{self.dir}/repo.json"):
            raise RepositoryError(f"{directory} is not initialized")
        with open(f"{self.dir}/repo.json", encoding="utf-8") as f:
            self.meta = json.load(f)
        if self.meta["format_version"] != FORMAT:
            raise RepositoryError(f"format {self.meta['format_version']} is not supported")
        c = self.meta.get("chunker") or {}
        self.sizes = chunking.ChunkSizes(c.get("Min", 0), c.get("Avg", 0), c.get("Max", 0)).or_default()
        self.catalog = Catalog(spark, self.dir)
        spark.dataSource.register(FileTree)

    @classmethod
    def init(cls, spark: SparkSession, directory: str, sizes: chunking.ChunkSizes | None = None) -> Repo:
        store = LocalStore(directory)
        if store.exists("repo.json"):
            raise RepositoryError(f"{directory} is a repository already")
        sizes = sizes or chunking.ChunkSizes()
        store.put("repo.json", json.dumps({"id": secrets.token_hex(16), "format_version": FORMAT, "created": datetime.now(UTC).isoformat(), "chunker": {"Min": sizes.least, "Avg": sizes.average, "Max": sizes.most}}, indent=2).encode())
        return cls(spark, directory)

    @contextmanager
    def _lock(self) -> Iterator[None]:
        """Backups, forgets and compactions exclude each other."""
        with open(f"{self.dir}/lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def snapshots(self) -> DataFrame:
        return self.catalog.snapshots()

    def resolve(self, selector: Selector | str = "") -> Row:
        return select.resolve(self.snapshots(), selector if isinstance(selector, Selector) else Selector(id=selector))

    def backup(self, paths: list[str], event: str = "", tags: dict[str, str] | None = None, kind: str = DEFAULT_KIND, actor: str | None = None, annotations: dict[str, str] | None = None, pack_target: int = packs.TARGET) -> dict:
        """Record the trees under ``paths``; returns counts, ``id`` and ``parent``."""
        with self._lock():
            spark, cat = self.spark, self.catalog
            parents = select.latest(cat.snapshots()).collect()
            parent = parents[0]["id"] if parents else ""
            work = f"{self.dir}/work-{secrets.token_hex(8)}"
            keep = lambda df, name: (df.write.parquet(f"{work}/{name}"), spark.read.schema(df.schema).parquet(f"{work}/{name}"))[1]
            try:
                walked = keep(spark.read.format("filetree").schema(WALK_SCHEMA).option("paths", json.dumps(list(paths))).load(), "walk")
                twice = walked.groupBy("path").count().where("count > 1").limit(1).collect()
                if twice:
                    raise RepositoryError(f"two sources store {twice[0]['path']!r}")
                old_nodes = cat.nodes(parent) if parent else spark.createDataFrame([], cat.nodes().schema)
                carried, fresh = diff.carry_forward(walked, old_nodes)
                carried = keep(carried, "carried")
                to_read = fresh.where("type = 'file'").select("path", "real_path").repartition(spark.sparkContext.defaultParallelism)
                pieces = keep(to_read.mapInPandas(_chunk_files(self.sizes), "path string, seq long, hash string, real_path string, at long, length long"), "pieces")
                new = index.first_occurrences(pieces, ["path", "seq"], index.live_index(cat.chunks()))
                entries = keep(new.repartition(spark.sparkContext.defaultParallelism, "path").sortWithinPartitions("path", "seq").mapInPandas(_write_packs(self.dir, pack_target, _from_file), _ENTRY), "entries")

                # time and id once the data is packed
                ns = time.time_ns()
                id_ = f"{datetime.fromtimestamp(ns / 1e9, UTC):%Y%m%dT%H%M%S}-{secrets.token_hex(6)}"
                hashes = index.content_hashes(pieces, "path")
                empty = index.content_hash(F.array().cast("array<string>"))
                is_file = F.col("type") == "file"
                made = fresh.join(hashes, "path", "left").withColumn("content_hash", F.when(is_file, F.coalesce("content_hash", empty)).otherwise(""))
                columns = ["path", "type", "mode", "uid", "gid", "size", "mtime", "symlink_target", "content_hash"]
                nodes = made.select(*columns).unionByName(carried.select(*columns)).withColumn("snapshot_id", F.lit(id_)).withColumn("content_type", F.lit("")).withColumn("embedding", F.lit(""))
                old_pieces = cat.nodechunks(parent) if parent else spark.createDataFrame([], cat.nodechunks().schema)
                reused = old_pieces.join(carried.select("path"), "path", "left_semi")
                lists = pieces.select("path", "seq", "hash").unionByName(reused.select("path", "seq", "hash")).withColumn("snapshot_id", F.lit(id_))
                cat.write_nodes(nodes, lists)
                cat.write_index(entries, packs.summary(entries, "pack_id", "comp_length"), id_)
                record = [(id_, ns, kind, default_actor() if actor is None else actor, event, json.dumps(tags, sort_keys=True), parent, socket.gethostname(), json.dumps(list(paths)), json.dumps(annotations, sort_keys=True))]
                cat.write_record(spark.createDataFrame(record, "id string, timestamp long, kind string, actor string, event_label string, tags string, parent_id string, host string, source_paths string, annotations string"))

                n = {r["type"]: r["n"] for r in walked.groupBy("type").agg(F.count("*").alias("n")).collect()}
                read = pieces.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
                added = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum("comp_length"), F.lit(0)).alias("b")).first()
                return {
                    "id": id_, "parent": parent, "files": n.get("file", 0), "dirs": n.get("dir", 0), "symlinks": n.get("symlink", 0),
                    "total_bytes": read["b"] + carried.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], "new_chunks": added["n"], "new_bytes": added["b"],
                    "reused_chunks": read["n"] - added["n"] + reused.count(),
                }
            finally:
                shutil.rmtree(work, ignore_errors=True)

    def ls(self, selector: Selector | str = "", path: str = "") -> DataFrame:
        """Entries under ``path``, with the columns of a long listing."""
        snapshot = self.resolve(selector)
        prefix = stored_path(json.loads(snapshot["source_paths"] or "null") or [], path)
        rows = self.catalog.nodes(snapshot["id"]).where(under_prefix(F.col("path"), prefix)).orderBy("path")
        link = F.when(F.col("type") == "symlink", F.concat(F.lit(" -> "), "symlink_target")).otherwise("")
        return rows.select(type_char(F.col("type")).alias("type"), mode_string(F.col("mode")).alias("mode"), human_bytes(F.col("size")).alias("size"), F.concat("path", link).alias("path"))

    def list_snapshots(self) -> DataFrame:
        from .functions.scalars import dash_if_empty

        tags = F.array_join(F.transform(F.array_sort(F.map_entries(F.from_json("tags", "map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
        sources = F.array_join(F.from_json("source_paths", "array<string>"), ",")
        return self.snapshots().select(
            F.col("id").alias("ID"), display_time(F.col("timestamp")).alias("TIME"), dash_if_empty(F.col("kind")).alias("KIND"), dash_if_empty(F.col("actor")).alias("ACTOR"),
            dash_if_empty(F.col("event_label")).alias("EVENT"), dash_if_empty(sources).alias("SOURCES"), dash_if_empty(tags).alias("TAGS"),
        )

    def restore(self, dest: str, selector: Selector | str = "", path: str = "") -> dict:
        """Write a snapshot, or what is under ``path``, to ``dest``."""
        snapshot = self.resolve(selector)
        roots = json.loads(snapshot["source_paths"] or "null") or []
        nodes = self.catalog.nodes(snapshot["id"]).where(under_prefix(F.col("path"), stored_path(roots, path)))
        top = os.path.abspath(dest)
        if nodes.isEmpty():
            raise RepositoryError(f"nothing under {path!r}; paths are relative to {', '.join(stored_roots(roots))}")
        if not nodes.where(F.col("path").rlike(r"(^|/)\.\.(/|$)") | F.col("path").startswith("/")).isEmpty():
            raise RepositoryError("a stored path leads out of the destination")
        folders = nodes.where("type <> 'file'").orderBy("path")
        for r in folders.toLocalIterator():
            target = os.path.join(top, r["path"])
            if r["type"] == "dir":
                os.makedirs(target, 0o755, exist_ok=True)
            else:
                os.makedirs(os.path.dirname(target), 0o755, exist_ok=True)
                if os.path.lexists(target):
                    os.remove(target)
                os.symlink(r["symlink_target"], target)
        files = nodes.where("type = 'file'").select("path", "mode", "mtime")
        pieces = verify.locate(self.catalog.nodechunks(snapshot["id"]), self.catalog.chunks())
        lost = pieces.join(files, "path", "left_semi").where("pack_id IS NULL").limit(1).collect()
        if lost:
            raise RepositoryError(f"missing chunk {lost[0]['hash']} of {lost[0]['path']!r}")
        rows = files.join(pieces.drop("snapshot_id"), "path", "left")
        read = _FromPack(self.dir)

        def assemble(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A file's chunks stand together and in order; only one chunk is held."""
            last, out, size, done = None, None, 0, []

            def close() -> None:
                out.close()
                os.chmod(out.name, last.mode)
                try:
                    os.utime(out.name, ns=(last.mtime, last.mtime))
                except OSError:
                    pass  # times are kept as far as the file system does
                done.append((last.path, size))

            for frame in frames:
                for row in frame.itertuples(index=False):
                    if last is None or row.path != last.path:
                        if out:
                            close()
                        target = os.path.join(top, row.path)
                        os.makedirs(os.path.dirname(target), 0o755, exist_ok=True)
                        if os.path.lexists(target):
                            os.remove(target)
                        last, out, size = row, open(target, "wb"), 0  # noqa: SIM115
                    if isinstance(row.pack_id, str):
                        place = row._replace(offset=int(row.offset), comp_length=int(row.comp_length))
                        data = read(place)
                        if chunking.digest(data) != row.hash:
                            raise RepositoryError(f"chunk {row.hash} is damaged")
                        out.write(data)
                        size += len(data)
            if out:
                close()
            yield pd.DataFrame(done, columns=["path", "bytes"])

        written = rows.repartition(self.spark.sparkContext.defaultParallelism, "path").sortWithinPartitions("path", "seq").mapInPandas(assemble, "path string, bytes long")
        total = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
        n = {"dir": 0, "symlink": 0}
        for r in folders.orderBy(F.desc("path")).toLocalIterator():
            n[r["type"]] += 1
            if r["type"] == "dir":
                os.chmod(os.path.join(top, r["path"]), r["mode"])
        return {"id": snapshot["id"], "files": total["n"], "dirs": n["dir"], "symlinks": n["symlink"], "bytes": total["b"]}

    def forget(self, text: str) -> str:
        with self._lock():
            id_ = self.resolve(text)["id"]
            self.catalog.forget(id_)
            return id_

    def compact(self, threshold: float = packs.THRESHOLD, pack_target: int = packs.TARGET) -> dict:
        """Drop packs without live chunks and rewrite those with few."""
        with self._lock():
            spark, cat = self.spark, self.catalog
            work = f"{self.dir}/work-{secrets.token_hex(8)}"
            keep = lambda df, name: (df.write.parquet(f"{work}/{name}"), spark.read.schema(df.schema).parquet(f"{work}/{name}"))[1]
            try:
                flagged = keep(packs.flag_live(cat.chunks(), index.live_set(cat.nodechunks())), "flagged")
                classes = keep(packs.classify(packs.liveness(flagged), threshold), "classes")
                all_packs = keep(cat.packs(), "packs")
                live = flagged.agg(F.count_if("live").alias("l"), F.count_if(~F.col("live")).alias("d")).first()
                by_class = {r["class"]: r["n"] for r in classes.groupBy("class").agg(F.count("*").alias("n")).collect()}
                out = {"packs_before": all_packs.count(), "packs_deleted": by_class.get("dead", 0), "packs_rewritten": by_class.get("candidate", 0), "live_chunks": live["l"], "dead_chunks": live["d"], "chunks_relocated": 0, "bytes_reclaimed": 0}
                if not out["packs_deleted"] and not out["packs_rewritten"]:
                    return out | {"packs_after": out["packs_before"]}
                moving = flagged.where("live").join(classes.where("class = 'candidate'").select("pack_id"), "pack_id", "left_semi").select("hash", "pack_id", "offset", "comp_length", "length")
                placed = keep(moving.repartition("pack_id").sortWithinPartitions("pack_id", "offset").mapInPandas(_write_packs(self.dir, pack_target, _FromPack(self.dir)), _ENTRY), "placed")
                new = packs.summary(placed, "pack_id", "comp_length")
                after = packs.compacted_packs(all_packs, classes, new)
                retired = [r["pack_id"] for r in classes.where("class <> 'keep'").join(new.select("pack_id"), "pack_id", "left_anti").select("pack_id").toLocalIterator()]
                out |= {"packs_after": after.count(), "chunks_relocated": placed.count(), "bytes_reclaimed": packs.reclaimed(all_packs, classes, new).first()[0]}
                cat.replace_index(packs.compacted_chunks(flagged, classes, placed), after)
                for pack in retired:  # once no index names them
                    cat.store.delete(f"data/{pack}.pack")
                return out
            finally:
                shutil.rmtree(work, ignore_errors=True)

    def verify(self, deep: bool = False) -> dict:
        """Every referenced chunk is indexed; with ``deep`` also read and hashed, each once."""
        cat = self.catalog
        lists = cat.nodechunks()
        lost = verify.missing_chunks(lists, cat.chunks()).limit(1).collect()
        if lost:
            raise RepositoryError(f"snapshot {lost[0]['snapshot_id']}: {lost[0]['path']!r} refers to missing chunk {lost[0]['hash']}")
        if deep:
            read = _FromPack(self.dir)

            def damaged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    bad = []
                    for row in frame.itertuples(index=False):
                        try:
                            ok = chunking.digest(read(row)) == row.hash
                        except (OSError, KeyError, ValueError, chunking.zlib.error):
                            ok = False
                        if not ok:
                            bad.append((row.hash, row.pack_id))
                    yield pd.DataFrame(bad, columns=["hash", "pack_id"])

            once = cat.chunks().join(lists.select("hash").distinct(), "hash", "left_semi")
            bad = once.repartition("pack_id").sortWithinPartitions("pack_id", "offset").mapInPandas(damaged, "hash string, pack_id string").limit(1).collect()
            if bad:
                raise RepositoryError(f"chunk {bad[0]['hash']} in pack {bad[0]['pack_id']} is damaged")
        return verify.stats(cat.snapshots(), cat.nodes(), lists).first().asDict() | {"deep": deep}

    def tables(self) -> dict[str, DataFrame]:
        c = self.catalog
        return {"snapshots": c.snapshots(), "nodes": c.nodes(), "nodechunks": c.nodechunks(), "chunks": c.chunks(), "packs": c.packs()}

    def sql(self, text: str) -> DataFrame:
        sql.register(self.spark, self.tables())
        return sql.query(self.spark, text)
