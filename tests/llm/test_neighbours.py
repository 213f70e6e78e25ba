import numpy as np
import pytest

from tilewright.llm import neighbours as N


def brute(ids, vectors, k=20):
    out = {}
    fine = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([vectors[i] for i in fine], dtype=np.float64)
    own = np.array([ids[i] for i in fine])
    for i, q in zip(own, x):
        if i % 20 == 0:
            s = x @ q
            order = [j for j in np.lexsort((own, -s)) if own[j] != i][:k]
            out[i] = [(own[j], s[j]) for j in order]
    return out


def recall(spark, ids, vectors, **how):
    df = spark.createDataFrame([(int(i), v if v is None else [x if x is None else float(x) for x in v], 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in N.nearest(df, **how).collect():
        got.setdefault(r.query_id, []).append(r)
    floats = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors]
    want = brute(ids, floats)
    assert set(got) == set(want)
    hit = total = 0
    for q, near in want.items():
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1)) and len(mine) <= 20
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(mine, mine[1:]))
        hit += len({r.vec_id for r in mine} & {i for i, _ in near})
        total += len(near)
    return hit / total


def test_recall_on_directions_and_lengths(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 64))
    assert recall(spark, np.arange(1500), (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()) >= 0.9
    assert recall(spark, np.arange(1500), (x * rng.uniform(0.2, 3, (1500, 1))).tolist()) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 16)).tolist()
    x[40:120] = [x[40]] * 80
    for k, v in zip((3, 5, 7, 9, 11), (None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15)):
        x[k] = v
    x[13] = [float("inf")] + [1.0] * 15
    assert recall(spark, np.arange(200), x) >= 0.9
    assert recall(spark, np.arange(200), x, slice_rows=10) >= 0.9


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in N.nearest(df).collect()) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert N.nearest(df.where("vec_id > 99")).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(3).normal(size=(5, 128))
    y = N.rotated(x, N.signs(1, 1, 128, 1)[0, 0])
    assert np.linalg.norm(y, axis=1) / 128**1.5 == pytest.approx(np.linalg.norm(x, axis=1), rel=1e-5)


def test_cells_in_order_of_nearness():
    rng = np.random.default_rng(5)
    counts, x = [32, 32, 8], rng.normal(size=(4, 16))
    rounds = N.signs(1, 3, 16, 1)[0]
    near = [N.axes(x, r, c) for r, c in zip(rounds, counts)]
    lack = [(n.max(axis=1, keepdims=True) - n) ** 2 for n in near]
    every = (lack[0][:, :, None, None] + lack[1][:, None, :, None] + lack[2][:, None, None, :]).reshape(4, -1)
    got = N.nearest_cells(x, rounds, counts, 300)
    assert (got[:, 0] == N.cells(x, rounds, counts)).all()
    for row, far in zip(got, every):
        assert len(set(row.tolist())) == 300 and far[row] == pytest.approx(np.sort(far)[:300])


def test_clusters_of_vectors_need_few_cells(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(100, 32))
    x = centres[np.arange(4000) % 100] + 0.2 * rng.normal(size=(4000, 32))
    assert recall(spark, np.arange(4000), x.tolist(), cell_rows=4) >= 0.9
    assert len(N.splits(4000, 64, 4)) == 2 and len(N.splits(10**9, 64, 24)) == 4


def test_each_length_is_searched_by_itself(spark):
    rows = [(i, [float(i % 7), 1.0, 2.0 + i]) for i in range(60)] + [(i, [1.0, float(i)]) for i in range(60, 130)] + [(140, [1e300, 1e300])]
    rows = [(140, [1e30, 1e30]) if i == 140 else (i, v) for i, v in rows]
    got = {}
    for r in N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    lengths = {i: len(v) for i, v in rows}
    assert all({lengths[i] for i in near} == {lengths[q]} for q, near in got.items())


def test_components_near_the_largest_double(spark):
    rows = [(i, [1e200 * (i + 1), 1e200]) for i in range(30)]
    got = [r for r in N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert {r.query_id for r in got} == {0, 20}
