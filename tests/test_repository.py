import json
import os
from pathlib import Path

import numpy as np
import pytest

from snapquarry.__main__ import run
from snapquarry.api import Repo, RepositoryError
from snapquarry.operators.select import Selector, SnapshotNotFound


def seeded(n: int, seed: int) -> bytes:
    rng = np.random.default_rng(seed)
    return np.where(rng.random(n) < 0.2, rng.integers(0, 256, n), np.arange(n) % 251).astype(np.uint8).tobytes()


def tree(top: Path) -> dict[str, object]:
    return {p.relative_to(top).as_posix(): os.readlink(p) if p.is_symlink() else None if p.is_dir() else p.read_bytes() for p in sorted(top.rglob("*"))}


def test_backup_restore_incremental(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("hello")
    (src / ".hidden").write_text("")
    (src / "sub/b.bin").write_bytes(seeded(512 * 1024, 1))
    (src / "link").symlink_to("a.txt")
    os.chmod(src / "sub", 0o750)
    repo = Repo.init(spark, str(tmp_path / "repo"))
    with pytest.raises(RepositoryError, match="already"):
        Repo.init(spark, str(tmp_path / "repo"))
    one = repo.backup([str(src)], event="pre-deploy", tags={"k": "v"})
    before = tree(src)
    assert (one["files"], one["dirs"], one["symlinks"], one["parent"]) == (3, 2, 1, "")
    (src / "a.txt").write_text("hello again")
    two = repo.backup([str(src)], kind="checkpoint", actor="me")
    assert two["parent"] == one["id"] and two["reused_chunks"] > 0 and two["new_chunks"] == 1 < one["new_chunks"]
    assert two["total_bytes"] == 512 * 1024 + len("hello again")

    restored = repo.restore(str(tmp_path / "r1"), one["id"])
    assert tree(tmp_path / "r1/src") == before and restored["files"] == 3
    assert (tmp_path / "r1/src/sub").stat().st_mode & 0o777 == 0o750
    assert (tmp_path / "r1/src/sub/b.bin").stat().st_mtime_ns == (src / "sub/b.bin").stat().st_mtime_ns
    repo.restore(str(tmp_path / "r2"))
    assert tree(tmp_path / "r2/src") == tree(src)
    repo.restore(str(tmp_path / "r3"), Selector(event="pre-deploy"), "src/sub")
    assert sorted(tree(tmp_path / "r3/src")) == ["sub", "sub/b.bin"]
    repo.restore(str(tmp_path / "r4"), path=str(src / "a.txt"))
    assert tree(tmp_path / "r4/src") == {"a.txt": b"hello again"}
    at = repo.snapshots().where(f"id = '{one['id']}'").first()["timestamp"]
    assert repo.restore(str(tmp_path / "r5"), Selector(at=at))["id"] == one["id"]
    with pytest.raises(RepositoryError, match="relative to src"):
        repo.restore(str(tmp_path / "r6"), path="none")
    with pytest.raises(SnapshotNotFound):
        repo.restore(str(tmp_path / "r7"), "zzz")
    assert [r["path"] for r in repo.ls("", "src/sub").collect()] == ["src/sub", "src/sub/b.bin"]
    assert repo.ls().where("type = 'l'").first()["path"] == "src/link -> a.txt"
    kinds = [(r["KIND"], r["EVENT"], r["TAGS"]) for r in repo.list_snapshots().collect()]
    assert kinds == [("backup", "pre-deploy", "k=v"), ("checkpoint", "-", "-")]
    assert repo.sql("SELECT count(*) AS n FROM nodes JOIN snapshots ON snapshot_id = id").first()["n"] == 12
    hashes = {r["path"]: r["content_hash"] for r in repo.catalog.nodes(two["id"]).collect()}
    assert hashes["src/.hidden"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" and hashes["src"] == ""
    with pytest.raises(RepositoryError, match="two sources"):
        repo.backup([str(src), str(tmp_path / "r2/src")])


def test_compaction_reclaims_what_was_forgotten(spark, tmp_path):
    src = tmp_path / "data"
    src.mkdir()
    (src / "keep.bin").write_bytes(seeded(100 * 1024, 3))
    (src / "big.bin").write_bytes(seeded(400 * 1024, 11))
    repo = Repo.init(spark, str(tmp_path / "repo"))
    one = repo.backup([str(src)], pack_target=64 * 1024)
    assert repo.compact()["packs_deleted"] == 0  # nothing to do
    (src / "big.bin").write_bytes(seeded(450 * 1024, 22))
    repo.backup([str(src)], pack_target=64 * 1024)
    indexed = repo.catalog.chunks().count()
    assert repo.forget(one["id"]) == one["id"]
    done = repo.compact()
    assert done["packs_deleted"] + done["packs_rewritten"] > 0 and done["bytes_reclaimed"] > 0
    assert done["live_chunks"] + done["dead_chunks"] == indexed and done["packs_after"] == repo.catalog.packs().count()
    assert {p.stem for p in (tmp_path / "repo/data").iterdir()} == {r["pack_id"] for r in repo.catalog.packs().collect()}
    assert repo.verify(deep=True)["files"] == 2
    repo.restore(str(tmp_path / "out"))
    assert tree(tmp_path / "out/data") == tree(src)
    sizes = repo.sql("SELECT p.pack_id FROM packs p JOIN (SELECT pack_id, sum(comp_length) + 8 AS s FROM chunks GROUP BY pack_id) c ON p.pack_id = c.pack_id WHERE s <> size")
    assert sizes.isEmpty()

    pack = next((tmp_path / "repo/data").iterdir())
    pack.write_bytes(pack.read_bytes()[:-1] + bytes([pack.read_bytes()[-1] ^ 255]))
    repo.verify()
    with pytest.raises(RepositoryError, match="damaged"):
        repo.verify(deep=True)
    repo.catalog.replace_index(repo.catalog.chunks().limit(0), repo.catalog.packs())
    with pytest.raises(RepositoryError, match="missing chunk"):
        repo.verify()


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("SNAPQUARRY_HOME", str(tmp_path / "home"))
    src, where = tmp_path / "s", str(tmp_path / "r")
    src.mkdir()
    (src / "f").write_text("x" * 2000)
    assert "ready" in run(["--path", where, "init", "--name", "mine"])
    assert run(["snapshots"]) == "nothing backed up so far\n"
    assert "new chunks  1" in run(["backup", str(src), "--event", "e", "--tag", "a=b"])
    assert "2.0 KiB" in run(["ls"]) and "nothing at" in run(["ls", "latest", "nope"])
    assert "files  1" in run(["restore", str(tmp_path / "o"), "--path", "s/f"])
    assert "contents too" in run(["verify", "--deep"])
    assert run(["query", "SELECT count(*) AS n FROM nodes"]).split() == ["n", "2"]
    assert "is gone" in run(["forget", "latest"]) and "packs deleted  1" in run(["compact"])
    assert json.loads(run(["config"]))["default_repo"] == "mine"
    with pytest.raises(LookupError):
        run(["config", "set-default", "other"])
    with pytest.raises(RepositoryError, match="not initialized"):
        run(["--path", str(tmp_path), "snapshots"])


def test_format_gate(spark, tmp_path):
    Repo.init(spark, str(tmp_path / "r"))
    meta = json.loads((tmp_path / "r/repo.json").read_text())
    (tmp_path / "r/repo.json").write_text(json.dumps(meta | {"format_version": 1}))
    with pytest.raises(RepositoryError, match="format 1"):
        Repo(spark, str(tmp_path / "r"))
