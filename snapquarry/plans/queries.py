"""The catalog operators as queries over the test tables, each with its DuckDB equivalent.

Queries read whole tables.  The identifiers in the comments are those of the operator
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import analytics, diff, index, packs, select, verify
from ..schema import conform
from . import sql
from .projection import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(oracle: str | None = None, alone: bool = False):
    """Register a query; its SQL comes behind the common views unless it stands ``alone``."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle if alone else _COMMON + oracle
        return f

    return add


_COMMON = r"""
WITH snapshots AS (SELECT event_id::VARCHAR AS id, epoch_us(ts) * 1000 AS "timestamp", event_type AS event_label, user_id::VARCHAR AS actor, props AS tags FROM events),
nodes AS (SELECT concat_ws('/', source, lang, doc_id::VARCHAR) AS path, 'file' AS type, octet_length(encode(text))::BIGINT AS size, sha256(text) AS content_hash, doc_id, source FROM documents),
cut AS (SELECT doc_id, source, text, unnest(range(0, (greatest(length(text), 1) - 1) // 1024 + 1)) AS seq FROM documents),
pieces AS (SELECT doc_id, source, seq::BIGINT AS seq, sha256(substring(text, seq * 1024 + 1, 1024)) AS hash, octet_length(encode(substring(text, seq * 1024 + 1, 1024)))::BIGINT AS length FROM cut),
first_pieces AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, seq) AS n FROM pieces) WHERE n = 1),
bucketed AS (SELECT *, ((coalesce(sum(length) OVER (PARTITION BY source ORDER BY doc_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) // 65536)::BIGINT AS pack_no FROM first_pieces),
chunks AS (SELECT *, source || '-' || pack_no AS pack_id, length AS comp_length,
           (coalesce(sum(length) OVER (PARTITION BY source, pack_no ORDER BY doc_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 8)::BIGINT AS "offset" FROM bucketed),
surviving AS (SELECT * FROM pieces WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0) AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en' OR source IN ('src1', 'src2'))),
live AS (SELECT DISTINCT hash FROM surviving),
flagged AS (SELECT c.*, l.hash IS NOT NULL AS live FROM chunks c LEFT JOIN live l ON c.hash = l.hash),
liveness AS (SELECT pack_id, count(*) AS total, count(*) FILTER (live) AS live_n FROM flagged GROUP BY pack_id),
classes AS (SELECT *, CASE WHEN live_n = 0 THEN 'dead' WHEN live_n / total < 0.5 THEN 'candidate' ELSE 'keep' END AS class FROM liveness),
packs AS (SELECT pack_id, (sum(comp_length) + 8)::BIGINT AS size, count(*) AS chunk_count FROM chunks GROUP BY pack_id)
"""

# selection and time travel ---------------------------------------------------------------


@_query('SELECT * FROM snapshots ORDER BY "timestamp" DESC, id DESC LIMIT 1')
def latest_snapshot(t: Tables) -> DataFrame:  # SO06
    return select.latest(t.snapshots())


_AT = 1_704_500_000 * 10**9


@_query(f'SELECT * FROM snapshots WHERE "timestamp" <= {_AT} ORDER BY "timestamp" DESC, id DESC LIMIT 1')
def snapshot_at(t: Tables) -> DataFrame:  # J10, PF08
    return select.at_time(t.snapshots(), _AT)


@_query(f"""SELECT * FROM snapshots WHERE event_label = 'click' AND "timestamp" <= {_AT} ORDER BY "timestamp" DESC, id DESC LIMIT 1""")
def snapshot_event_before(t: Tables) -> DataFrame:  # J11, PF07
    return select.at_event(t.snapshots(), "click", _AT)


@_query("SELECT * FROM snapshots WHERE starts_with(id, '77')  AND (id = '77' OR NOT EXISTS (SELECT 1 FROM snapshots WHERE id = '77'))")
def snapshot_prefix(t: Tables) -> DataFrame:  # PF09, PF10, A15
    return select.by_id(t.snapshots(), "77")


@_query("""
SELECT e.event_id, e.user_id, s.event_id AS asof_state
FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase') s ON e.user_id = s.user_id AND e.ts >= s.ts
WHERE e.event_type <> 'purchase'
""", alone=True)
def asof_events(t: Tables) -> DataFrame:  # J10 for many points
    e = t.raw("events").select("event_id", "user_id", "ts", "event_type")
    states = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("state"))
    points = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return select.asof(points, states, "user_id", "ts", "state").select("event_id", "user_id", "asof_state")


@_query('SELECT id, lag(id) OVER (ORDER BY "timestamp", id) AS parent FROM snapshots')
def parent_lineage(t: Tables) -> DataFrame:  # W01, J14
    return select.lineage(t.snapshots()).select("id", "parent")


@_query('SELECT event_label, arg_max(id, ("timestamp", id)) AS id, max("timestamp") AS "timestamp" FROM snapshots WHERE event_label <> \'\' GROUP BY event_label')
def latest_per_event(t: Tables) -> DataFrame:  # W07
    return select.latest_per_event(t.snapshots())


@_query("SELECT id, json_extract_string(tags, '$.k') AS k, json_extract_string(tags, '$.ref') AS ref FROM snapshots")
def tags_lookup(t: Tables) -> DataFrame:  # SF11, SF28
    return t.snapshots().select("id", F.get_json_object("tags", "$.k").alias("k"), F.get_json_object("tags", "$.ref").alias("ref"))


# indexes and deduplication ----------------------------------------------------------------


@_query("SELECT DISTINCT hash FROM chunks")
def live_index(t: Tables) -> DataFrame:  # SC07, SC09
    return index.live_index(t.chunks())


@_query("SELECT hash, max(doc_id * 1000000 + seq) % 1000000 AS seq, max(doc_id * 1000000 + seq) // 1000000 AS doc_id FROM pieces GROUP BY hash")
def last_wins_index(t: Tables) -> DataFrame:  # SC07, SC08, A07, SE02
    return index.last_wins(t.pieces(), "hash", "doc_id", "seq").select("hash", "doc_id", "seq")


@_query("SELECT doc_id, seq, hash, length, row_number() OVER (PARTITION BY hash ORDER BY doc_id, seq) = 1 AS is_new FROM pieces")
def chunk_dedup(t: Tables) -> DataFrame:  # J03, W05, SE06
    w = Window.partitionBy("hash").orderBy("doc_id", "seq")
    return t.pieces().select("doc_id", "seq", "hash", "length", (F.row_number().over(w) == 1).alias("is_new"))


@_query("SELECT doc_id, seq, hash FROM first_pieces WHERE doc_id >= 100 AND hash NOT IN (SELECT hash FROM pieces WHERE doc_id < 100)")
def new_chunks(t: Tables) -> DataFrame:  # J03
    p = t.pieces()
    return index.first_occurrences(p.where("doc_id >= 100"), ["doc_id", "seq"], index.live_index(p.where("doc_id < 100"))).select("doc_id", "seq", "hash")


@_query("""SELECT source, count(*) AS chunks, count(*) FILTER (is_new) AS unique_chunks, sum(length)::BIGINT AS logical_bytes, coalesce(sum(length) FILTER (is_new), 0)::BIGINT AS unique_bytes
FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, seq) = 1 AS is_new FROM pieces) GROUP BY source""")
def dedup_ratio(t: Tables) -> DataFrame:  # A10, slice 0
    return analytics.dedup_ratio(t.pieces(), "source", "length", ["doc_id", "seq"])


@_query("SELECT doc_id, array_to_string(list(hash ORDER BY seq), ',') AS chunks FROM pieces GROUP BY doc_id")
def ordered_chunks(t: Tables) -> DataFrame:  # SC05, A08, W04
    return index.ordered_chunks(t.pieces(), "doc_id").select("doc_id", F.array_join("chunks", ",").alias("chunks"))


@_query("SELECT doc_id, sha256(string_agg(hash || chr(0), '' ORDER BY seq)) AS content_hash FROM pieces GROUP BY doc_id")
def content_hash(t: Tables) -> DataFrame:  # A09, SF09
    return index.content_hashes(t.pieces(), "doc_id")


@_query("SELECT n.path, n.doc_id, count(p.hash) AS n_chunks FROM nodes n LEFT JOIN (SELECT * FROM pieces WHERE doc_id IN (SELECT doc_id FROM labels)) p ON n.doc_id = p.doc_id GROUP BY n.path, n.doc_id")
def nodes_with_chunks(t: Tables) -> DataFrame:  # J01, SC04; only documents with a label have a chunk list
    key = F.col("doc_id").cast("string")
    lists = t.pieces().join(t.raw("labels").select("doc_id"), "doc_id", "left_semi").select(key.alias("path"), F.lit("s").alias("snapshot_id"), "seq", "hash")
    nodes = t.nodes().select(F.col("path").alias("full"), key.alias("path"), F.lit("s").alias("snapshot_id"), "doc_id")
    return index.with_chunks(nodes, lists).select(F.col("full").alias("path"), "doc_id", F.size("chunks").cast("long").alias("n_chunks"))


@_query("SELECT source, lang, list_aggregate(list(doc_id ORDER BY doc_id), 'string_agg', ',') AS ids FROM documents GROUP BY source, lang")
def explode_round_trip(t: Tables) -> DataFrame:  # SK03, W04
    nodes = t.raw("documents").groupBy("source", "lang").agg(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")).alias("chunks"))
    back = index.ordered_chunks(index.explode_chunks(nodes, "source", "lang"), "source", "lang")
    return back.select("source", "lang", F.array_join("chunks", ",").alias("ids"))


# differences --------------------------------------------------------------------------------

_VERSIONS = r""", cur AS (SELECT o_custkey AS path, count(*) AS size, max(epoch_us(o_orderdate)) AS mtime FROM orders WHERE o_orderdate < TIMESTAMP '1998-03-01' GROUP BY 1),
old AS (SELECT o_custkey AS path, count(*) AS size, max(epoch_us(o_orderdate)) AS mtime FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
diff AS (SELECT coalesce(c.path, p.path) AS path, p.size AS old_size, c.size AS new_size, p.mtime AS old_mtime, c.mtime AS new_mtime,
  CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN c.size = p.size AND c.mtime = p.mtime THEN 'unchanged' ELSE 'changed' END AS status
  FROM cur c FULL JOIN old p ON c.path = p.path)
"""


@_query(_VERSIONS + "SELECT * FROM diff")
def incremental_diff(t: Tables) -> DataFrame:  # J02, PF06
    return diff.changes(t.version("1998-03-01"), t.version("1998-01-01"))


@_query(_VERSIONS + "SELECT status, count(*) AS n, coalesce(sum(new_size), 0)::BIGINT AS bytes FROM diff GROUP BY status")
def backup_stats(t: Tables) -> DataFrame:  # A10
    return diff.stats(incremental_diff(t))


@_query(_VERSIONS + "SELECT path, new_size AS size, status = 'unchanged' AS carried FROM diff WHERE status <> 'removed'")
def carry_forward(t: Tables) -> DataFrame:  # J02, PF06
    as_files = lambda v: t.version(v).withColumn("type", F.lit("file"))
    kept, fresh = diff.carry_forward(as_files("1998-03-01"), as_files("1998-01-01"))
    return kept.select("path", "size", F.lit(True).alias("carried")).unionByName(fresh.select("path", "size", F.lit(False).alias("carried")))


# packs and compaction -----------------------------------------------------------------------


@_query("SELECT hash, pack_id FROM chunks")
def pack_assign(t: Tables) -> DataFrame:  # W03, fixed buckets
    return t.chunks().select("hash", "pack_id")


@_query("""SELECT source, doc_id, seq, hash, length, pack_no FROM (
WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, seq) AS n FROM first_pieces),
p AS (SELECT *, 0::BIGINT AS pack_no, 8 + length AS held FROM numbered WHERE n = 1 UNION ALL
      SELECT b.*, p.pack_no + (p.held >= 65536)::BIGINT, CASE WHEN p.held >= 65536 THEN 8 ELSE p.held END + b.length
      FROM p JOIN numbered b ON p.source IS NOT DISTINCT FROM b.source AND b.n = p.n + 1)
SELECT * FROM p)""")
def pack_assign_exact(t: Tables) -> DataFrame:  # W03, SK07
    first = index.first_occurrences(t.pieces(), ["doc_id", "seq"])
    return packs.assign_exact(first.select("source", "doc_id", "seq", "hash", "length"), "length", 65536, ["doc_id", "seq"], "source")


@_query('SELECT hash, pack_id, "offset", length FROM chunks')
def pack_offsets(t: Tables) -> DataFrame:  # W02
    return t.chunks().select("hash", "pack_id", "offset", "length")


@_query("SELECT * FROM packs")
def pack_summary(t: Tables) -> DataFrame:  # A13
    return packs.summary(t.chunks(), "pack_id", "comp_length")


@_query("SELECT hash FROM live")
def live_set(t: Tables) -> DataFrame:  # A01, J12
    return index.live_set(t.surviving())


@_query("SELECT pack_id, total, live_n FROM liveness")
def pack_liveness(t: Tables) -> DataFrame:  # A02, A03, J06, PF11
    return packs.liveness(packs.flag_live(t.chunks(), index.live_set(t.surviving())))


@_query("SELECT pack_id, total, live_n, class FROM classes")
def pack_class(t: Tables) -> DataFrame:  # PF12, PF13, SO04
    return packs.classify(pack_liveness(t))


@_query("SELECT hash, pack_id FROM flagged WHERE NOT live")
def dead_chunks(t: Tables) -> DataFrame:  # SE03, A04
    return packs.dead_chunks(t.chunks(), index.live_set(t.surviving())).select("hash", "pack_id")


@_query("SELECT count(*) FILTER (live) AS live_chunks, count(*) FILTER (NOT live) AS dead_chunks FROM flagged")
def live_dead_counts(t: Tables) -> DataFrame:  # A04
    return packs.flag_live(t.chunks(), index.live_set(t.surviving())).agg(F.count_if("live").alias("live_chunks"), F.count_if(~F.col("live")).alias("dead_chunks"))


_MOVED = r""", moved AS (SELECT f.hash, 'new-' || f.source AS pack_id, f.comp_length, f.length,
  (coalesce(sum(f.comp_length) OVER (PARTITION BY f.source ORDER BY f.pack_id, f."offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 8)::BIGINT AS "offset"
  FROM flagged f JOIN classes c ON f.pack_id = c.pack_id WHERE f.live AND c.class = 'candidate'),
moved_packs AS (SELECT pack_id, (sum(comp_length) + 8)::BIGINT AS size, count(*) AS chunk_count FROM moved GROUP BY pack_id)
"""


def _compaction(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    flagged = packs.flag_live(t.chunks(), index.live_set(t.surviving()))
    classes = packs.classify(packs.liveness(flagged))
    moving = flagged.where("live").join(classes.where("class = 'candidate'").select("pack_id"), "pack_id", "left_semi")
    placed = packs.offsets(moving.withColumnsRenamed({"offset": "old_offset", "pack_id": "old"}), "source", "comp_length", ["old", "old_offset"])
    placed = placed.withColumn("pack_id", F.concat(F.lit("new-"), "source")).select("hash", "pack_id", "offset", "comp_length", "length")
    return flagged, classes, placed, packs.summary(placed, "pack_id", "comp_length")


@_query(_MOVED + """SELECT f.hash, f.pack_id, f."offset", f.comp_length, f.length FROM flagged f JOIN classes c ON f.pack_id = c.pack_id WHERE c.class = 'keep'
UNION ALL SELECT hash, pack_id, "offset", comp_length, length FROM moved""")
def compacted_index(t: Tables) -> DataFrame:  # J07, J08, SK05
    flagged, classes, placed, _ = _compaction(t)
    return packs.compacted_chunks(flagged, classes, placed)


@_query(_MOVED + "SELECT p.* FROM packs p JOIN classes c ON p.pack_id = c.pack_id WHERE class = 'keep' UNION ALL SELECT * FROM moved_packs")
def compacted_packs(t: Tables) -> DataFrame:  # J09, SE04, SE05
    _, classes, _, new = _compaction(t)
    return packs.compacted_packs(packs.summary(t.chunks(), "pack_id", "comp_length"), classes, new)


@_query(_MOVED + "SELECT (coalesce((SELECT sum(p.size) FROM packs p JOIN classes c ON p.pack_id = c.pack_id WHERE class <> 'keep'), 0) - coalesce((SELECT sum(size) FROM moved_packs), 0))::BIGINT AS bytes_reclaimed")
def reclaimed(t: Tables) -> DataFrame:  # A05
    _, classes, _, new = _compaction(t)
    return packs.reclaimed(packs.summary(t.chunks(), "pack_id", "comp_length"), classes, new)


@_query(_MOVED + """SELECT (SELECT count(*) FROM packs) AS packs_before, (SELECT count(*) FROM classes WHERE class = 'keep') + (SELECT count(*) FROM moved_packs) AS packs_after,
(SELECT count(*) FROM classes WHERE class = 'dead') AS packs_deleted, (SELECT count(*) FROM classes WHERE class = 'candidate') AS packs_rewritten,
(SELECT count(*) FROM flagged WHERE live) AS live_chunks, (SELECT count(*) FROM flagged WHERE NOT live) AS dead_chunks, (SELECT count(*) FROM moved) AS chunks_relocated""")
def compaction_stats(t: Tables) -> DataFrame:  # A06
    flagged, classes, placed, new = _compaction(t)
    c = classes.agg(F.count("*").alias("packs_before"), F.count_if(F.col("class") == "keep").alias("kept"), F.count_if(F.col("class") == "dead").alias("packs_deleted"), F.count_if(F.col("class") == "candidate").alias("packs_rewritten"))
    f = flagged.agg(F.count_if("live").alias("live_chunks"), F.count_if(~F.col("live")).alias("dead_chunks"))
    rows = c.crossJoin(f).crossJoin(placed.agg(F.count("*").alias("chunks_relocated"))).crossJoin(new.agg(F.count("*").alias("made")))
    return rows.withColumn("packs_after", F.col("kept") + F.col("made")).drop("kept", "made")


# verification and restore -------------------------------------------------------------------


@_query("SELECT doc_id, seq, hash FROM pieces WHERE hash NOT IN (SELECT hash FROM flagged WHERE live)")
def missing_chunks(t: Tables) -> DataFrame:  # J05
    kept = packs.flag_live(t.chunks(), index.live_set(t.surviving())).where("live")
    return verify.missing_chunks(t.pieces(), kept).select("doc_id", "seq", "hash")


@_query("SELECT (SELECT count(DISTINCT source) FROM nodes) AS snapshots, (SELECT count(*) FROM nodes) AS files, (SELECT count(*) FROM pieces) AS chunks")
def verify_stats(t: Tables) -> DataFrame:  # A12
    nodes = t.nodes().select(F.col("source").alias("snapshot_id"), F.col("doc_id").cast("string").alias("path"), "type")
    lists = t.pieces().select(F.col("source").alias("snapshot_id"), F.col("doc_id").cast("string").alias("path"), "hash")
    return verify.stats(nodes.select("snapshot_id").distinct(), nodes, lists)


@_query('SELECT p.doc_id, p.seq, c.pack_id, c."offset", c.length FROM pieces p JOIN chunks c ON p.hash = c.hash JOIN nodes n ON n.doc_id = p.doc_id WHERE n.source = \'src1\'')
def restore_plan(t: Tables) -> DataFrame:  # J04, PF03
    wanted = t.nodes().where(scalars.under_prefix(F.col("path"), "src1")).select("doc_id")
    lists = t.pieces().select("doc_id", "seq", "hash").join(wanted, "doc_id", "left_semi")
    return verify.locate(lists, t.chunks().select("hash", "pack_id", "offset", "length")).select("doc_id", "seq", "pack_id", "offset", "length")


@_query("SELECT count(*) AS files, sum(size)::BIGINT AS bytes FROM nodes WHERE path = 'src1/en' OR starts_with(path, 'src1/en/')")
def restore_stats(t: Tables) -> DataFrame:  # A11
    return t.nodes().where(scalars.under_prefix(F.col("path"), "src1/en")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


# projections, sorts, scalars ------------------------------------------------------------------


@_query("SELECT path, size FROM nodes WHERE path = 'src1' OR starts_with(path, 'src1/')")
def subtree_filter(t: Tables) -> DataFrame:  # PF03, PF04
    return t.nodes().where(scalars.under_prefix(F.col("path"), "src1/")).select("path", "size")


@_query("SELECT path, row_number() OVER (PARTITION BY source ORDER BY path) AS nth, len(string_split(path, '/')) AS depth FROM nodes")
def path_depth_sort(t: Tables) -> DataFrame:  # SO02, SO03
    w = Window.partitionBy("source").orderBy("path")
    return t.nodes().select("path", F.row_number().over(w).cast("long").alias("nth"), F.size(F.split("path", "/")).cast("long").alias("depth"))


@_query("SELECT path, size FROM nodes ORDER BY size DESC, path LIMIT 10")
def topk_largest(t: Tables) -> DataFrame:  # SO07
    return analytics.largest(t.nodes()).select("path", "size")


def _human(n: str) -> str:
    units = "".join(f" WHEN {n} < {1024 ** (k + 1)} THEN format('{{:.1f}} {unit}', {n} / {1024**k}.0)" for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1))
    return f"CASE WHEN {n} < 1024 THEN {n} || ' B'{units} END"


@_query(f"SELECT path, {_human('size')} AS human, {_human('(size * 300)')} AS more, {_human('(size * 300000)')} AS most FROM nodes")
def human_bytes(t: Tables) -> DataFrame:  # SF17; multiples of the sizes reach the larger units
    size = F.col("size")
    return t.nodes().select("path", scalars.human_bytes(size).alias("human"), scalars.human_bytes(size * 300).alias("more"), scalars.human_bytes(size * 300000).alias("most"))


@_query("""SELECT doc_id, '-' || string_agg(CASE WHEN (doc_id % 512) & (1 << (8 - i)) <> 0 THEN substr('rwxrwxrwx', i + 1, 1) ELSE '-' END, '' ORDER BY i) AS mode,
CASE doc_id % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'l' ELSE '-' END AS t FROM documents, (SELECT unnest(range(0, 9))::INT AS i) GROUP BY doc_id""")
def listing_columns(t: Tables) -> DataFrame:  # PF16, SF20, SF21
    kind = F.when(F.col("doc_id") % 3 == 0, "dir").when(F.col("doc_id") % 3 == 1, "symlink").otherwise("file")
    return t.raw("documents").select("doc_id", scalars.mode_string((F.col("doc_id") % 512).cast("int")).alias("mode"), scalars.type_char(kind).alias("t"))


@_query("""SELECT id, strftime(make_timestamp("timestamp" // 1000), '%Y-%m-%d %H:%M:%S') AS shown, coalesce(nullif(event_label, ''), '-') AS event, substr(id, 1, 20) AS short FROM snapshots""")
def snapshot_listing(t: Tables) -> DataFrame:  # PF17, SF18, SF19, SF22, SF25
    s = t.snapshots()
    return s.select("id", scalars.display_time(F.col("timestamp")).alias("shown"), scalars.dash_if_empty(F.col("event_label")).alias("event"), scalars.short_id(F.col("id")).alias("short"))


@_query("SELECT content_hash AS id, regexp_full_match(content_hash, '[0-9a-fA-F]{64}') AS ok, 'data/' || content_hash || '.pack' AS key FROM nodes")
def chunk_ids(t: Tables) -> DataFrame:  # SF01, SF02, SF08
    h = F.col("content_hash")
    return t.nodes().select(scalars.chunk_id(F.upper(h)).alias("id"), scalars.is_chunk_id(h).alias("ok"), scalars.pack_key(h).alias("key"))


@_query("SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS root FROM pages")
def stored_roots(t: Tables) -> DataFrame:  # SF13, A14
    return t.raw("pages").select("page_id", F.coalesce(F.element_at(scalars.stored_roots_column(F.array("url")), 1), F.lit("")).alias("root"))


@_query("SELECT doc_id::VARCHAR AS id, '' AS actor, CASE WHEN doc_id % 2 = 0 THEN 'backup' ELSE 'checkpoint' END AS kind, 0::BIGINT AS \"timestamp\" FROM documents")
def schema_defaults(t: Tables) -> DataFrame:  # PF01, PF02, SC03
    rows = t.raw("documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("checkpoint").alias("kind"), F.lit(None).cast("string").alias("actor"))
    return conform(rows, "snapshots").select("id", "actor", "kind", "timestamp")


@_query("""SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL BY NAME SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance FROM supplier""", alone=True)
def union_by_name(t: Tables) -> DataFrame:  # SE01, SC10
    c = t.raw("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = t.raw("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@_query("SELECT hash, arg_max(length, doc_id) AS length, max(doc_id) AS doc_id FROM (SELECT hash, length + 1 AS length, doc_id FROM pieces WHERE seq = 0 UNION ALL SELECT hash, length, doc_id - 1000000 FROM pieces WHERE seq > 0) GROUP BY hash")
def override_union(t: Tables) -> DataFrame:  # SE02
    p = t.pieces()
    old = p.where("seq > 0").groupBy("hash").agg(F.max("length").alias("length"), (F.max("doc_id") - 1000000).alias("doc_id"))
    new = p.where("seq = 0").groupBy("hash").agg((F.max("length") + 1).alias("length"), F.max("doc_id").alias("doc_id"))
    return index.union_with_override("hash", "_turn", old, new)


@_query("SELECT doc_id FROM nodes WHERE content_hash IN (SELECT content_hash FROM nodes WHERE doc_id < 50 UNION SELECT content_hash FROM nodes WHERE doc_id % 97 = 0)")
def retired_union(t: Tables) -> DataFrame:  # SE04
    n = t.nodes()
    return index.in_any(n, "content_hash", n.where("doc_id < 50"), n.where("doc_id % 97 = 0")).select("doc_id")


# analytics and SQL ----------------------------------------------------------------------------


@_query("SELECT bucket, added, (sum(added) OVER (ORDER BY bucket))::BIGINT AS total FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, count(*) AS added FROM orders GROUP BY 1)", alone=True)
def growth_over_time(t: Tables) -> DataFrame:
    o = t.raw("orders").select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m"), F.lit(1).alias("one"))
    return analytics.growth(o, F.col("m"), "one")


@_query("SELECT path, size FROM (SELECT o_custkey AS path, count(*) AS size, max(epoch_us(o_orderdate)) * 1000 AS mtime FROM orders GROUP BY 1) WHERE mtime > 898000000000000000")
def changed_since(t: Tables) -> DataFrame:
    v = t.version("9999-01-01").withColumn("mtime", F.col("mtime") * 1000)
    return analytics.changed_since(v, 898000000000000000).select("path", "size")


@_query("SELECT pack_id, total, live_n FROM liveness WHERE live_n / total < 0.5")
def mostly_dead_packs(t: Tables) -> DataFrame:
    return analytics.mostly_dead(pack_liveness(t))


def _sql(name: str, spark_text: str, duck_text: str | None = None) -> None:
    """A statement through the query gate; DuckDB gets its own spelling where the dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        sql.register(spark, {"snapshots": t.snapshots(), "nodes": t.nodes(), "chunks": t.chunks(), "nodechunks": t.pieces()})
        return sql.query(spark, spark_text)

    QUERIES[name] = run
    body = (duck_text or spark_text).replace("nodechunks", "pieces")
    ORACLE_SQL[name] = _COMMON + body


_sql("sql_aggregates", "SELECT source, count(*) AS n, CAST(sum(size) AS DECIMAL(38,0)) AS total, avg(size) AS mean, count(*) FILTER (WHERE size > 1024) AS large, median(size) AS mid, max_by(path, struct(size, path)) AS biggest FROM nodes GROUP BY ALL", "SELECT source, count(*) AS n, sum(size)::DECIMAL(38,0) AS total, avg(size) AS mean, count(*) FILTER (WHERE size > 1024) AS large, median(size) AS mid, arg_max(path, (size, path)) AS biggest FROM nodes GROUP BY ALL")  # Q03, Q05, A17
_sql("sql_grouping_sets", "SELECT source, size > 2048 AS large, count(*) AS n, CAST(grouping(source) AS BIGINT) AS g FROM nodes GROUP BY CUBE (source, size > 2048)", "SELECT source, size > 2048 AS large, count(*) AS n, grouping(source)::BIGINT AS g FROM nodes GROUP BY CUBE (source, size > 2048)")  # Q04
_sql("sql_windows", "SELECT path, CAST(rank() OVER w AS BIGINT) AS r, lag(size) OVER w AS prev, CAST(sum(size) OVER (PARTITION BY source ORDER BY size DESC, path ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s3 FROM nodes WINDOW w AS (PARTITION BY source ORDER BY size DESC, path)")  # Q06
_sql("sql_joins", "SELECT n.path, c.pack_id FROM nodes n JOIN nodechunks k ON n.doc_id = k.doc_id AND k.seq = 0 LEFT JOIN chunks c ON c.hash = k.hash")  # Q02, J15
_sql("sql_semi_anti", "SELECT path FROM nodes n LEFT ANTI JOIN (SELECT doc_id FROM nodechunks WHERE seq >= 2) k ON n.doc_id = k.doc_id", "SELECT path FROM nodes n ANTI JOIN (SELECT doc_id FROM pieces WHERE seq >= 2) k ON n.doc_id = k.doc_id")  # Q02
_sql("sql_set_operations", "SELECT source FROM nodes WHERE size > 20000 INTERSECT ALL SELECT source FROM nodes WHERE size < 1000 UNION ALL (SELECT source FROM nodes EXCEPT SELECT source FROM nodes WHERE size > 500)")  # Q08
_sql("sql_recursive", "WITH RECURSIVE chain(n, size) AS (SELECT 0, CAST(0 AS BIGINT) UNION ALL SELECT n + 1, size + n FROM chain WHERE n < 50) SELECT n, size FROM chain", "SELECT n, size FROM (WITH RECURSIVE chain(n, size) AS (SELECT 0, 0::BIGINT UNION ALL SELECT n + 1, size + n FROM chain WHERE n < 50) SELECT n, size FROM chain)")  # Q09
_sql("sql_from_first", "FROM nodes SELECT path, size::STRING AS s WHERE path ILIKE 'SRC1/%'", "SELECT path, size::VARCHAR AS s FROM nodes WHERE path ILIKE 'SRC1/%'")  # Q10
_sql("sql_star_except", "SELECT * EXCEPT (type, content_hash) FROM nodes", "SELECT * EXCLUDE (type, content_hash) FROM nodes")  # Q11
_sql("sql_json", "SELECT id, json_extract_string(tags, '$.k') AS k FROM snapshots WHERE regexp_matches(event_label, '^c')", "SELECT id, json_extract_string(tags, '$.k') AS k FROM snapshots WHERE regexp_matches(event_label, '^c')")  # Q12, Q15, SF28
_sql("sql_lists", "SELECT doc_id, explode(array(seq, seq + 1)) AS x FROM nodechunks", "SELECT doc_id, unnest([seq, seq + 1]) AS x FROM pieces")  # Q13
_sql("sql_limit", 'SELECT "path", size div 7 AS sevenths FROM nodes ORDER BY size DESC NULLS LAST, path LIMIT 20 OFFSET 5', "SELECT path, size // 7 AS sevenths FROM nodes ORDER BY size DESC NULLS LAST, path LIMIT 20 OFFSET 5")  # Q01, Q07, Q14
