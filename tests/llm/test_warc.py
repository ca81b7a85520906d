import shutil

from pyspark.sql import functions as F

from snapquarry.llm import warc

PAGES = [(i, f"http://h/{i}", f"<p>{'é' * (i % 7)} {i}</p>\r\n\r\n") for i in range(200)] + [(5, "http://h/5", "<p>again</p>"), (9, None, None), (None, "u", ""), (9, None, None), (700, "http://long", "x" * 200_000)]


def pages(spark):
    return spark.createDataFrame([(i, u, h, 1, "d") for i, u, h in PAGES], "page_id long, url string, html string, offset int, digest string")


def test_archives_round_trip(spark, tmp_path):
    warc.write_archives(pages(spark), str(tmp_path / "w"), 40)
    back = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted((r["url"], r["payload"]) for r in back) == sorted((u or "", h or "") for _, u, h in PAGES)
    r = back[0]
    data = open(r["file"].removeprefix("file:"), "rb").read()
    assert data[r["offset"] : r["offset"] + r["length"]].startswith(b"WARC/1.1\r\n")


def test_audit_finds_planted_damage_only(spark):
    m = warc.manifest(pages(spark)).cache()
    assert m.agg(F.sum("copies")).first()[0] == len(PAGES)
    assert warc.audit(m, m).count() == 0
    bad = m.withColumn("digest", F.when(F.col("page_id") == 17, F.lit("0" * 64)).otherwise(F.col("digest"))).where("page_id IS NULL OR page_id <> 33")
    extra = m.where("page_id = 3").withColumn("offset", F.lit(10**9).cast("long"))
    got = sorted((r["page_id"], r["status"]) for r in warc.audit(m, bad.unionByName(extra)).collect())
    assert got == [(3, "unexpected"), (17, "altered"), (33, "missing")]
    fewer = m.withColumn("copies", F.lit(1).cast("long"))
    assert [(r["page_id"], r["status"]) for r in warc.audit(m, fewer).collect()] == [(9, "altered")]


def test_audit_reads_mismatching_branches_only(spark):
    m = warc.manifest(pages(spark)).cache()
    bad = m.withColumn("digest", F.when(F.col("page_id") == 17, F.lit("0" * 64)).otherwise(F.col("digest")))
    ranges = warc.differing_ranges(warc.Tree(m, "a"), warc.Tree(bad, "b")).collect()
    assert [(r["file_id"], r["slot"]) for r in ranges] == [(r["file_id"], r["offset"] >> 16) for r in m.where("page_id = 17").collect()]


def test_stored_archives_with_damage(spark, tmp_path):
    one, two = tmp_path / "one +%", tmp_path / "two"
    warc.write_archives(pages(spark).repartition(3), str(one), 40)
    for f in one.glob("_*"):
        f.unlink()
    shutil.copytree(one, two, ignore=shutil.ignore_patterns(".*"))
    assert warc.audit_archives(spark, str(one), str(two)).count() == 0
    files = sorted(two.glob("*.txt"))
    whole = [list(warc.records(f.read_bytes())) for f in files]
    url = lambda r: r[3].decode()
    damage = {}
    data = bytearray(files[0].read_bytes())  # a byte of a payload that is no UTF-8 any more
    data[whole[0][3][1] - 5] = 0xFF
    damage[files[0].name, url(whole[0][3])] = "altered"
    files[0].write_bytes(bytes(data))
    data = files[1].read_bytes()  # a length that leads astray
    at, end = whole[1][4][:2]
    files[1].write_bytes(data[:at] + data[at:end].replace(b"Content-Length: ", b"Content-Length:x") + data[end:])
    damage[files[1].name, url(whole[1][4])] = "altered"
    data = files[2].read_bytes()  # cut off inside the last record
    files[2].write_bytes(data[: whole[2][-1][1] - 3])
    damage[files[2].name, url(whole[2][-1])] = "altered"
    files[3].unlink()
    for r in whole[3]:
        damage[files[3].name, url(r)] = "missing"
    (two / "z.txt").write_bytes(b"no record")
    damage["z.txt", ""] = "unexpected"
    got = warc.audit_archives(spark, str(one), str(two)).collect()
    assert {(r["file"], r["url"]): r["status"] for r in got} == damage
    assert len(got) == 4 + len(whole[3])
    broken = warc.read_archives(spark, str(two)).where("NOT whole").select("payload").collect()
    assert len(broken) == 3


def test_sparse_ids_fill_no_node(spark):
    d = spark.createDataFrame([(i << 40, f"u{i}", "x" * (i % 50)) for i in range(-5, 300)], "page_id long, url string, html string")
    m = warc.manifest(d).cache()
    tree = warc.Tree(m, "sparse")
    for level in tree.levels:
        assert level.groupBy("up_file", "up_slot").count().agg(F.max("count")).first()[0] <= 64
    bad = m.withColumn("digest", F.when(F.col("page_id") == 7 << 40, F.lit("0" * 64)).otherwise(F.col("digest")))
    assert [(r["page_id"], r["status"]) for r in warc.audit(m, bad).collect()] == [(7 << 40, "altered")]


def test_nothing_to_audit(spark):
    m = warc.manifest(pages(spark).limit(0))
    assert warc.audit(m, m).count() == 0
    full = warc.manifest(pages(spark))
    assert warc.audit(full, m).where("status = 'missing'").count() == full.count()
