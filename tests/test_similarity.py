"""Neighbours by cosine against all pairs, on clusters, copies and odd rows."""

import numpy as np
import pytest

from opinara.operators import similarity


@pytest.mark.parametrize("block_rows", [7, 40, 4096])
@pytest.mark.parametrize("same", [True, False])
def test_top_k_is_exact(spark, block_rows, same):
    rng = np.random.default_rng(block_rows)
    centres = rng.normal(size=(6, 5)) * 3
    vectors = np.concatenate([centres[rng.integers(0, 6, 150)] + rng.normal(size=(150, 5)) * 0.3, np.tile(centres[0], (60, 1))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 5)]
    right = spark.createDataFrame(rows, "id int, e array<double>")
    left = right if same else right.where("id % 3 = 0")
    got = {}
    for r in similarity.top_k(left, right, "id", "id", "e", "e", 4, same, block_rows).collect():
        got.setdefault(r["left_id"], []).append((r["rank"], r["right_id"], r["similarity"]))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    s = np.round(unit @ unit.T, 9)
    asked = [i for i in range(len(vectors)) if same or i % 3 == 0]
    assert sorted(got) == asked
    for i in asked:
        order = sorted((j for j in range(len(vectors)) if not (same and j == i)), key=lambda j: (-s[i, j], j))[:4]
        found = sorted(got[i])
        assert [x[0] for x in found] == [1, 2, 3, 4]
        assert np.allclose([x[2] for x in found], [s[i, j] for j in order], atol=1e-8)
        if block_rows == 4096:
            assert [x[1] for x in found][:1] == order[:1] or abs(s[i, order[0]] - s[i, order[1]]) < 1e-8


def test_few_blocks_are_met(spark):
    """Vectors in distant clusters meet the block of their own cluster alone."""
    rng = np.random.default_rng(1)
    centres = np.eye(8)
    vectors = centres[np.arange(400) % 8] + rng.normal(size=(400, 8)) * 0.01
    rows = similarity.unit(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id int, e array<double>"), "id", "e")
    unit = np.array([r["v"] for r in rows.orderBy("id").collect()])
    pivots = unit[:8]
    placed = similarity._nearest_pivot(rows, pivots).selectExpr("id", "v", "block", "cast(0.1 AS double) AS reach")
    assert similarity._wanted(placed, pivots, np.arange(8), np.full(8, 0.1)).count() == 0
    far = placed.selectExpr("id", "v", "block", "cast(5 AS double) AS reach")
    assert similarity._wanted(far, pivots, np.arange(8), np.full(8, 0.1)).count() == 400 * 7


def test_rows_are_not_copied_for_each_block(spark, monkeypatch):
    """Vectors without clusters and many copies of one: a row asks for cells, of which there are few, not for blocks."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(similarity, "LEAST_CELL", 40)
    vectors = np.concatenate([rng.normal(size=(300, 6)), np.ones((90, 6))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id int, e array<double>")
    asked, wanted = [], similarity._wanted
    monkeypatch.setattr(similarity, "_wanted", lambda *a: asked.append(wanted(*a)) or asked[-1])
    got = {}
    for r in similarity.top_k(df, df, "id", "id", "e", "e", 3, same=True, block_rows=5).collect():
        got.setdefault(r["left_id"], []).append((r["rank"], r["right_id"], r["similarity"]))
    assert asked[0].count() <= 390 * 2 * similarity.CELLS  # 78 blocks
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    s = np.round(unit @ unit.T, 9)
    for i in range(390):
        order = sorted((j for j in range(390) if j != i), key=lambda j: (-s[i, j], j))[:3]
        assert [x[1] for x in sorted(got[i])] == order


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "id int, e array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "id int, e array<double>")
    assert similarity.top_k(some, none, "id", "id", "e", "e", 3).count() == 0
    assert similarity.top_k(none, some, "id", "id", "e", "e", 3).count() == 0
    assert similarity.top_k(some, some, "id", "id", "e", "e", 3, same=True).count() == 0
    assert similarity.top_k(some, some, "id", "id", "e", "e", 3).count() == 1


def test_close_ones_in_other_blocks_are_ties(spark):
    """Similarities that round to 1 are ties, of which the least ids are right, though in other blocks and farther than rounded."""
    rng = np.random.default_rng(3)
    vectors = np.array([1.0, 0, 0, 0]) + np.c_[np.zeros(80), rng.normal(size=(80, 3)) * 5e-6]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id int, e array<double>")
    right = df.selectExpr("id + 1000 AS id", "e")
    for same in (True, False):
        got = {}
        for r in similarity.top_k(df, df if same else right, "id", "id", "e", "e", 3, same, block_rows=4).collect():
            got.setdefault(r["left_id"], []).append((r["rank"], r["right_id"], r["similarity"]))
        assert len(got) == 80
        for i, found in got.items():
            least = [j for j in range(5) if not (same and j == i)][:3]
            assert sorted(found) == [(n + 1, j if same else j + 1000, 1.0) for n, j in enumerate(least)]


def test_ids_that_repeat_and_numbers_that_are_not_finite(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LEAST_CELL", 12)
    rng = np.random.default_rng(4)
    ids, vectors = np.r_[np.arange(60), np.arange(60, 70), np.arange(60, 70), np.full(9, 5)], rng.normal(size=(89, 4))
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)]
    df = spark.createDataFrame([*rows, (900, [float("nan")] * 4), (901, [float("inf"), 0.0, 0.0, 0.0]), (None, rows[0][1])], "id int, e array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    s, got = np.round(unit @ unit.T, 9), {}
    for r in similarity.top_k(df, df, "id", "id", "e", "e", 4, same=True, block_rows=5).collect():
        got.setdefault(r["left_id"], []).append((r["rank"], r["right_id"], r["similarity"]))
    assert sorted(got) == sorted(set(ids.tolist()))
    for i, found in got.items():
        all_of = sorted((-s[a, b], int(ids[b])) for a in np.flatnonzero(ids == i) for b in np.flatnonzero(ids != i))[:4]
        assert [(r, j) for r, j, _ in sorted(found)] == [(n + 1, j) for n, (_, j) in enumerate(all_of)]


@pytest.mark.parametrize("copies", [0, 700])
def test_two_rows_are_multiplied_once(monkeypatch, copies):
    """Without clusters a table's cells make half of all products, and give both rows their nearest."""
    pa = pytest.importorskip("pyarrow")
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(3000 - copies, 16)), np.tile(rng.normal(size=(1, 16)), (copies, 1))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    table = lambda lo, hi: pa.table({"id": pa.array(np.arange(lo, hi)), "v": pa.array(list(v[lo:hi])), "block": pa.array(np.arange(lo, hi) // 250)})
    x, y = similarity._Cell(table(0, 1500), 16), similarity._Cell(table(1500, 3000), 16)
    made, tile = [], similarity._tile
    monkeypatch.setattr(similarity, "_tile", lambda a, i, b, j, *to: made.append(len(i) * len(j)) or tile(a, i, b, j, *to))
    everything, k = np.ones((1500, 6), bool), 5
    s = np.round(v @ v.T, 9)
    np.fill_diagonal(s, -2)
    for a, b in ((x, x), (x, y)):
        made.clear()
        to_a = similarity._Found(a, b, k, similarity._codes(a, b))
        to_b = to_a if a is b else similarity._Found(b, a, k, similarity._codes(b, a))
        similarity._cross(a, b, everything, everything, to_a, to_b)
        assert sum(made) <= (0.75 if a is b else 1) * 1500 * 1500  # tiles on the diagonal are whole
        for to, lo, other in ((to_a, 0, 0 if a is b else 1500), (to_b, 0 if a is b else 1500, 0)):
            row, ids, off = to.lists()
            assert row.tolist() == list(range(1500))
            for i, found, units in zip(range(lo, lo + 1500), ids.to_pylist(), off.to_pylist(), strict=True):
                order = np.lexsort((np.arange(1500), -s[i, other : other + 1500]))[:k]
                assert found == (order + other).tolist()
                assert np.allclose(1 - np.array(units) / 1e9, s[i, other + order], atol=2e-9)
