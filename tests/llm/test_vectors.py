import numpy as np
import pytest

from snapquarry.llm import itq, prefix_forest

SCHEMA = "vec_id long, embedding array<float>, label int, v string, codes int"
BAD = [(1001, None, 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [None] + [1.0] * 15, 1), (1005, [float("inf")] + [1.0] * 15, 1), (1006, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[n // 2 : n // 2 + n // 4] = x[: n // 4] + rng.normal(scale=0.03, size=(n // 4, 16)).astype(np.float32)
    return x


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)


def test_forest_recall_and_order(spark):
    x = vectors(600)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    d = frame(spark, rows + BAD)
    got = {}
    for r in prefix_forest.search(d, d.where("vec_id % 20 = 0"), rows_per_block=128).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = x.astype(np.float64)
    hits = 0
    assert set(got) == set(range(0, 600, 20))
    for q, found in got.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(f[2] == far[f[1]] for f in found) and [f[2] for f in found] == sorted(f[2] for f in found)
        hits += len({f[1] for f in found} & set(np.argsort(far)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(got)


def test_forest_edges(spark):
    one = [1.0] * 16
    d = frame(spark, [(7, one, 0), (3, one, 0), (0, one, 0), (5, [2.0] * 16, 0), (0, [5.0] * 16, 0)] + BAD)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in prefix_forest.search(d, d.where("vec_id = 0")).collect())
    assert got == [(0, 1, 3), (0, 2, 7), (0, 3, 5)]
    assert prefix_forest.search(d.limit(0), d).count() == 0 and prefix_forest.search(d, d.where("vec_id = 1001")).count() == 0


def test_forest_small_blocks_and_copies(spark):
    x = vectors(20, 3)
    for n in (2, 3, 5, 11, 20):
        d = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x[:n])]).coalesce(1)
        got = {(r["query_id"], r["vec_id"]) for r in prefix_forest.search(d, d, k=30).collect()}
        assert got == {(a, b) for a in range(n) for b in range(n) if a != b}, n
    x = vectors(150, 4)
    x[1:8] = x[0]
    d = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]).coalesce(1)
    got = [r["vec_id"] for r in prefix_forest.search(d, d.where("vec_id = 0")).orderBy("rank").collect()]
    far = np.sqrt(((x.astype(np.float64) - x[0]) ** 2).sum(axis=1))
    assert got[:7] == list(range(1, 8)) and len(got) == 10 and len(set(got[7:]) & set(np.argsort(far, kind="stable")[8:11].tolist())) >= 2


def brute(rows, least):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    near = (x @ x.T >= least) & (label[:, None] == label) & (label >= 0)[:, None]
    np.fill_diagonal(near, False)
    root = list(range(len(ids)))
    for _ in range(len(ids)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
        if new == root:
            break
        root = new
    return near.sum(axis=1), root


@pytest.mark.parametrize("block", [1024, 20])
def test_near_duplicates_match_brute_force(spark, block):
    x = vectors(400, 3)
    hot = x[0] + np.random.default_rng(9).normal(scale=0.02, size=(60, 16)).astype(np.float32)  # one large group
    rows = [(i, v.tolist(), None if i % 50 == 49 else i % 3 % 2) for i, v in enumerate(np.concatenate([x, hot]))]
    n, root = brute(rows, 0.98)
    got = {r["vec_id"]: r for r in itq.near_duplicates(frame(spark, rows + BAD), block=block).collect()}
    assert len(got) == len(rows) + len(BAD)
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert n.sum() * 0.99 <= found <= n.sum() and all(got[i]["n_links"] <= n[i] for i in range(len(rows)))
    if found == n.sum():
        assert all(got[i]["component_id"] == root[i] and got[i]["kept"] == (root[i] == i) for i in range(len(rows)))
    for i, _, _ in BAD:
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i


def test_near_duplicates_edges(spark):
    one = [1.0, 2.0, 3.0]
    d = frame(spark, [(4, one, 1), (4, one, 1), (2, [2.0, 4.0, 6.0], 1), (2, one, 1), (9, one, 2), (None, one, 2), (5, [1.0] * 5, 2), (6, [3.0] * 5, 2), (7, [1e30] * 5, 2)])
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in itq.near_duplicates(d).collect())
    assert got == [(0, 1, 9, False), (2, 3, 2, True), (2, 3, 2, True), (4, 3, 2, False), (4, 3, 2, False), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False), (9, 1, 9, True)]
    assert itq.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("shift", [0.0, 0.9, 0.95])
def test_no_links_are_missed_off_the_mean(spark, shift):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    mean = unit(rng.normal(size=64)) * shift
    x = unit(mean + unit(rng.normal(size=(1500, 64))) * np.sqrt(1 - shift**2))
    pairs = x[:500]
    aside = rng.normal(size=pairs.shape)
    aside = unit(aside - (aside * pairs).sum(axis=1, keepdims=True) * pairs)
    turn = np.arccos(rng.uniform(0.98001, 0.985, len(pairs)))[:, None]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, np.cos(turn) * pairs + np.sin(turn) * aside]))]
    n, _ = brute(rows, 0.98)
    got = {r["vec_id"]: r["n_links"] for r in itq.near_duplicates(frame(spark, rows)).collect()}
    assert sum(got.values()) >= 0.995 * n.sum() > 0 and all(got[i] <= n[i] for i in got)


def test_near_duplicate_tables_follow_the_rows():
    data = np.random.default_rng(1).normal(size=(500, 32))
    codes = [itq.Codes(data, n, 0.98, rounds=1) for n in (1000, 10**6, 10**9)]
    assert [c.bits for c in codes] == [5, 15, 25] and codes[0].tables < codes[1].tables < codes[2].tables < 64
    assert all(c.limit < 0.2 * c.length for c in codes)
