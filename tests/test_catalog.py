import pytest
from pyspark.sql import functions as F

from snapquarry.operators import index, packs, select
from snapquarry.operators.select import AmbiguousSnapshot, Selector, SnapshotNotFound
from snapquarry.plans import sql
from snapquarry.schema import SCHEMAS, conform, typed_snapshots
from snapquarry.sources.catalog import Catalog, FlatCatalog

T0, HOUR = 1000 * 10**9, 3600 * 10**9


@pytest.fixture(scope="module")
def timeline(spark):
    rows = [("aaa111", T0, ""), ("bbb222", T0 + HOUR, "pre-deploy"), ("ccc333", T0 + 2 * HOUR, ""), ("ddd444", T0 + 3 * HOUR, "pre-deploy")]
    return spark.createDataFrame(rows, "id string, timestamp long, event_label string").cache()


@pytest.mark.parametrize(
    ("selector", "expected"),
    [
        (Selector(), "ddd444"), (Selector("latest"), "ddd444"), (Selector("ccc333"), "ccc333"), (Selector("bbb2"), "bbb222"), (Selector(at=T0 + 150 * 60 * 10**9), "ccc333"), (Selector(at=T0), "aaa111"),
        (Selector(event="pre-deploy"), "ddd444"), (Selector(event="pre-deploy", before=T0 + 2 * HOUR), "bbb222"), (Selector("aaa111", at=T0 + HOUR), "bbb222"), (Selector("aaa111", T0, "pre-deploy"), "ddd444"), (Selector("aaa111", before=T0), "aaa111"),
    ],
)
def test_resolve(timeline, selector, expected):
    assert select.resolve(timeline, selector)["id"] == expected


def test_resolve_errors(spark, timeline):
    for s in (Selector("zzz"), Selector(event="none"), Selector(at=T0 - 1)):
        with pytest.raises(SnapshotNotFound):
            select.resolve(timeline, s)
    more = timeline.union(spark.createDataFrame([("aaa222", T0, "")], timeline.schema))
    with pytest.raises(AmbiguousSnapshot, match="2"):
        select.resolve(more, Selector("aaa"))
    exact = timeline.union(spark.createDataFrame([("aaa", T0, "")], timeline.schema))
    assert select.resolve(exact, Selector("aaa"))["id"] == "aaa"


def test_equal_times_go_to_the_larger_id(spark):
    rows = spark.createDataFrame([("b", 5), ("c", 5), ("a", 5)], "id string, timestamp long")
    assert select.latest(rows).first()["id"] == "c"


def test_ancestors(spark):
    rows = spark.createDataFrame([("a", ""), ("b", "a"), ("c", "b"), ("x", "gone")], "id string, parent_id string")
    assert [r["id"] for r in select.ancestors(rows, "c").orderBy("depth").collect()] == ["c", "b", "a"]


def test_tables_round_trip(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    assert c.snapshots().isEmpty() and c.chunks().isEmpty() and c.nodechunks("x").isEmpty()
    nodes = spark.createDataFrame([("snap-1", "a.txt", "file", 0o644, 12, "h1"), ("snap-1", "sub", "dir", 0o755, 0, "")], "snapshot_id string, path string, type string, mode long, size long, content_hash string")
    lists = spark.createDataFrame([("snap-1", "a.txt", 1, "c2"), ("snap-1", "a.txt", 0, "c1")], SCHEMAS["nodechunks"])
    c.write_nodes(conform(nodes, "nodes"), lists)
    assert c.nodes().isEmpty()  # not committed
    c.write_index(spark.createDataFrame([("c1", "p1", 8, 20, 40), ("c2", "p1", 28, 10, 15)], SCHEMAS["chunks"]), spark.createDataFrame([("p1", 512, 2)], SCHEMAS["packs"]), "snap-1")
    record = spark.createDataFrame([("snap-1", 1_700_000_000 * 10**9, "pre-deploy", '{"host":"laptop","job":"nightly"}', '["/src/projects"]')], "id string, timestamp long, event_label string, tags string, source_paths string")
    c.write_record(record)
    s = typed_snapshots(c.snapshots()).first()
    assert (s["kind"], s["tags"], s["source_paths"], s["actor"]) == ("backup", {"host": "laptop", "job": "nightly"}, ["/src/projects"], "")
    with_lists = {r["path"]: r["chunks"] for r in index.with_chunks(c.nodes("snap-1"), c.nodechunks("snap-1")).collect()}
    assert with_lists == {"a.txt": ["c1", "c2"], "sub": []}
    assert {r["hash"] for r in index.live_index(c.chunks()).collect()} == {"c1", "c2"}
    # a later batch overrides, a consolidation keeps what was last
    c.write_index(spark.createDataFrame([("c1", "p2", 8, 20, 40)], SCHEMAS["chunks"]), spark.createDataFrame([("p2", 28, 1)], SCHEMAS["packs"]), "snap-2")
    assert c.chunks().where("hash = 'c1'").first()["pack_id"] == "p2" and c.packs().count() == 2
    c.replace_index(c.chunks(), c.packs())
    assert c.generation() == 1 and c.chunks().count() == 2
    c.forget("snap-1")
    assert c.snapshots().isEmpty() and c.nodes().isEmpty() and c.chunks().count() == 2


def test_large_manifest(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    n = spark.range(3000).select(F.concat(F.lit("dir"), F.col("id") % 50, F.lit("/file"), "id", F.lit(".dat")).alias("path"), F.when(F.col("id") % 600 == 0, 25_000).otherwise(1).alias("k"), "id")
    lists = n.select(F.lit("s").alias("snapshot_id"), "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)).alias("seq")).withColumn("hash", F.lpad(F.hex("seq"), 64, "0"))
    c.write_nodes(conform(n.select(F.lit("s").alias("snapshot_id"), "path"), "nodes"), lists)
    c.write_record(spark.createDataFrame([("s", 1)], "id string, timestamp long"))
    assert c.nodechunks("s").count() == 5 * 25_000 + 2_995
    assert index.ordered_chunks(c.nodechunks("s"), "path").where(F.size("chunks") == 25_000).count() == 5


def test_flat_layout(spark, tmp_path):
    import pandas as pd

    for d in ("meta/snapshots", "nodechunks", "meta/chunks"):
        (tmp_path / d).mkdir(parents=True)
    pd.DataFrame({"id": ["s1"], "timestamp": [1]}).to_parquet(tmp_path / "meta/snapshots/s1.parquet")
    pd.DataFrame({"path": ["a"], "seq": [0], "hash": ["h"]}).to_parquet(tmp_path / "nodechunks/s1.parquet")
    for k, name in enumerate(("20260101", "index")):
        pd.DataFrame({"hash": ["h", "h"], "pack_id": [f"p{k}", f"q{k}"], "offset": [8, 8], "comp_length": [1, 1], "length": [1, 1]}).to_parquet(tmp_path / f"meta/chunks/{name}.parquet")
    f = FlatCatalog(spark, str(tmp_path))
    assert f.table("snapshots").first()["kind"] == "backup" and f.table("nodechunks").first()["snapshot_id"] == "s1"
    assert [r["pack_id"] for r in f.table("chunks").collect()] == ["q1"] and f.table("packs").isEmpty()


def test_liveness_threshold(spark):
    rows = spark.createDataFrame([("dead", 4, 0), ("half", 4, 2), ("less", 4, 1), ("full", 4, 4)], "pack_id string, total long, live_n long")
    got = lambda t: {r["pack_id"]: r["class"] for r in packs.classify(rows, t).collect()}
    assert got(0.5) == got(0) == {"dead": "dead", "half": "keep", "less": "candidate", "full": "keep"}
    assert got(1.5)["full"] == "candidate"


def test_sql_gate(spark, timeline, tmp_path):
    sql.register(spark, {"snapshots": timeline})
    assert sql.query(spark, '-- first\nSELECT "id" FROM snapshots WHERE starts_with("id", \'a\')').count() == 1
    into = f"OVERWRITE DIRECTORY '{tmp_path}/out' USING parquet SELECT id"
    for bad in ("DROP VIEW snapshots", "INSERT INTO x VALUES (1)", "CREATE TABLE t (a INT)", "", f"FROM range(3) INSERT {into}", f"WITH t AS (SELECT 1 AS id) INSERT {into} FROM t", f"FROM range(3) INSERT {into} INSERT {into}"):
        with pytest.raises(sql.NotReadOnly):
            sql.query(spark, bad)
    assert not (tmp_path / "out").exists() and sql.query(spark, "WITH t AS (FROM range(3)) SELECT id, 'INSERT' FROM t").count() == 3
    text = sql.render(spark.createDataFrame([("big.bin", 1000, None, bytearray(b"x"))], "path string, size long, n int, b binary"))
    assert text.splitlines()[0].split() == ["path", "size", "n", "b"] and text.splitlines()[1].split() == ["big.bin", "1000", "x"]


def test_stream_passes_each_hash_once(spark, tmp_path):
    from snapquarry.streaming.incremental import maintain_index

    m, out, cp = (str(tmp_path / x) for x in ("m", "out", "cp"))
    write = lambda rows: spark.createDataFrame(rows, SCHEMAS["chunks"]).coalesce(1).write.mode("append").parquet(m)
    write([("a", "p1", 8, 1, 1), ("b", "p1", 9, 1, 1)])
    maintain_index(spark, m, out, cp).awaitTermination()
    write([("b", "p2", 8, 1, 1), ("c", "p2", 9, 1, 1)])
    maintain_index(spark, m, out, cp).awaitTermination()
    assert sorted(r["hash"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_forget_keeps_records_that_share_a_file(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.write_record(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, timestamp long"))
    c.write_record(spark.createDataFrame([("d", 4)], "id string, timestamp long"))
    for gone, left in (("b", "acd"), ("d", "ac"), ("x", "ac"), ("a", "c")):
        c.forget(gone)
        assert "".join(r["id"] for r in c.snapshots().collect()) == left
    # a crash between the copy and the deletion leaves a record twice
    c.write_record(c.snapshots())
    assert c.snapshots().count() == 1


def test_packs_by_blocks_are_those_of_one_window(spark):
    rows = [(s, i, j, ((i or 0) * 7 + j * 3) % 50 + 1) for s in ("a", "b", None) for i in [None, *range(-5, 90)] for j in range(3)]
    d = spark.createDataFrame(rows, "source string, doc_id long, seq long, length long")
    plain = packs.assign_buckets(d, "length", 64, ["doc_id", "seq"], ["source"])
    for bits in (0, 2, 5):
        cut = packs.assign_buckets(d, "length", 64, ["doc_id", "seq"], ["source"], F.shiftright("doc_id", bits))
        assert cut.columns == plain.columns and cut.exceptAll(plain).isEmpty() and plain.exceptAll(cut).isEmpty()
    assert packs.assign_buckets(d.limit(0), "length", 64, ["doc_id"], [], F.col("doc_id")).isEmpty()
