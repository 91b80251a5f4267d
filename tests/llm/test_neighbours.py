from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarlake.llm import neighbours
from sonarlake.llm.neighbours import canonical_vectors, nearest, similar_pairs

COLS = "vec_id long, matrix array<float>, feature_names array<string>, id int, digest string"
NAMES = [f"f{i:02d}" for i in range(24)]


def rows_of(x, start=0):
    return [(start + i, [float(v) for v in r], NAMES, 1, "d") for i, r in enumerate(x)]


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        best = sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in best if s[i, j] >= least}
    return out


def test_groups_are_found(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 24))
    x[300:420] = x[:120] + r.normal(0, 0.05, (120, 24))
    x[420:440] = x[:20] + r.normal(0, 0.02, (20, 24))
    got = {tuple(p) for p in similar_pairs(spark.createDataFrame(rows_of(x), COLS), 10, 0.96).collect()}
    want = brute(list(range(900)), x, 10, 0.96)
    assert len(want) >= 150 and len(got & want) >= 0.99 * len(want) and not got - want


def test_names_decide_and_odd_rows_take_no_part(spark):
    v = [float(i + 1) for i in range(24)]
    back = list(range(24))[::-1]
    rows = [
        (1, v, NAMES, 1, ""), (2, [v[i] for i in back], [NAMES[i].upper() for i in back], 1, ""), (3, [*v, 0.0], [*NAMES, "constant_0"], 1, ""), (4, [v[i] for i in back], NAMES, 1, ""),
        (5, None, NAMES, 1, ""), (6, [], [], 1, ""), (7, [0.0] * 24, NAMES, 1, ""), (8, [float("nan"), *v[1:]], NAMES, 1, ""), (9, v[:5], NAMES, 1, ""), (10, v, None, 1, ""), (None, v, NAMES, 1, ""),
    ]
    df = spark.createDataFrame(rows + rows[:2], COLS)
    assert {r.vec_id for r in canonical_vectors(df).collect()} == {1, 2, 3, 4}
    assert sorted(map(tuple, similar_pairs(df, 10, 0.96).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_many_copies(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(200, 24))
    x[50:120] = x[50] * np.linspace(1, 3, 70)[:, None]
    x[150] = x[50] + r.normal(0, 0.03, 24)
    got = nearest(spark.createDataFrame(rows_of(x), COLS), 5, 0.96).toPandas()
    copies = set(range(50, 120))
    for i in copies:
        assert got[got.vec_id == i].sort_values("rank").other_id.tolist() == [j for j in range(50, 57) if j != i][:5]
    assert got[got.vec_id == 150].sort_values("rank").other_id.tolist() == [50, 51, 52, 53, 54]


def test_recall_without_a_least_cosine(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(20, 24))[r.integers(0, 20, 1500)] + r.normal(0, 0.4, (1500, 24))
    got = nearest(spark.createDataFrame(rows_of(x), COLS), 10, asks=F.col("vec_id") % 20 == 0, reach=100).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for i in range(0, 1500, 20):
        s = u @ u[i]
        s[i] = -2
        hit += len(set(np.argsort(-s)[:10]) & set(got[got.vec_id == i].other_id))
    assert hit / 750 >= 0.9
    assert set(got.vec_id) == set(range(0, 1500, 20)) and (got.groupby("vec_id").size() == 10).all()


def test_recall_without_structure(spark):
    r = np.random.default_rng(19)
    x = r.normal(size=(4000, 24))
    got = nearest(spark.createDataFrame(rows_of(x), COLS), 10, asks=F.col("vec_id") % 20 == 0, share=0.05).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::20] @ u.T
    s[np.arange(200), np.arange(0, 4000, 20)] = -2
    best = np.argsort(-s, axis=1)[:, :10]
    assert sum(len(set(b) & set(got[got.vec_id == 20 * i].other_id)) for i, b in enumerate(best.tolist())) >= 0.9 * 2000


def test_ascending_stops_at_the_longest_prefix_that_suffices():
    h = np.sort(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    level, held = neighbours.longest_prefix(h[None, ::50], [h], 40)
    for x, n, c in zip(h[::50], level.tolist(), held.tolist()):
        common = lambda m: int((h >> np.uint64(64 - m) == x >> np.uint64(64 - m)).sum()) if m else len(h)
        assert common(n) >= 40 and (n == 64 or common(n + 1) < 40) and (c == common(n) or n == 0)


def test_one_string_fills_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 300)
    r = np.random.default_rng(23)
    x = r.normal(size=(1500, 24))
    x[:900] = x[0] * (1 + 1e-4 * r.random((900, 24)))  # different vectors, nearly all strings equal
    got = nearest(spark.createDataFrame(rows_of(x), COLS), 5, asks=F.col("vec_id") % 20 == 0, reach=20).toPandas()
    assert (got.groupby("vec_id").size() == 5).all() and set(got[got.vec_id < 900].other_id) <= set(range(900))


def test_empty_and_one(spark):
    df = spark.createDataFrame(rows_of(np.ones((1, 24))), COLS)
    assert similar_pairs(df, 10, 0.9).count() == 0
    assert similar_pairs(df.limit(0), 10, 0.9).count() == 0


@pytest.mark.parametrize("sent", [0, 1000])
def test_far_neighbours_are_exact(spark, monkeypatch, sent):
    monkeypatch.setattr(neighbours, "SCAN_SENT", sent)
    r = np.random.default_rng(11)
    x = r.normal(size=(3000, 24))
    df = spark.createDataFrame(rows_of(x) + rows_of(x[:40]), COLS)
    got = nearest(df, 10, asks=F.col("vec_id") % 20 == 0).toPandas().sort_values(["vec_id", "rank"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 3000, 20):
        s = u @ u[i]
        s[i] = -2
        assert got[got.vec_id == i].other_id.tolist() == np.argsort(-s)[:10].tolist()
    assert len(got) == 1500


@pytest.mark.parametrize("dense", [300, 3000])
def test_nearest_in_a_dense_group(spark, dense):
    r = np.random.default_rng(13)
    names = [f"f{i:02d}" for i in range(40)]
    x = r.normal(size=(dense + 3000, 40))
    x[:dense] = np.full(40, 40**-0.5) + r.normal(0, (0.02 / 40) ** 0.5, (dense, 40))
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), names, 1, "d") for i, v in enumerate(x)]
    got = {tuple(p) for p in similar_pairs(spark.createDataFrame(rows, COLS), 10, 0.96).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(min(i, j), max(i, j)) for i, best in enumerate(np.argsort(-s, axis=1)[:, :10].tolist()) for j in best if s[i, j] >= 0.96}
    assert len(want) > 5 * dense and len(got & want) >= 0.999 * len(want) and len(got - want) <= 0.001 * len(want)
