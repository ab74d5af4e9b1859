"""The randomised k-d forest: planes, bounds, recall, and what it does with awkward rows."""

import numpy as np

from voxelweave.operators import forest as FO
from voxelweave.operators import knn as KNN
from voxelweave.operators import match as M

FORM = "id long, grp long, pc array<double>"


def pairs(near):
    return {(r.q, r.t): (r.d, r["rank"]) for r in near.collect()}


def test_a_tree_halves_its_sample_and_bounds_hold():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(512, 6))
    tree = FO.grow(v, 5, rng)
    leaf, cost = tree.leaf(v), tree.bounds(v)
    assert np.bincount(leaf, minlength=32).tolist() == [16] * 32
    # a row's own leaf costs nothing, another one something
    assert (cost[np.arange(512), leaf] == 0).all() and (np.sort(cost, axis=1)[:, 1] > 0).all()
    # one plane alone bounds the distance to every row beyond it
    one = FO.grow(v, 1, rng)
    d2 = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    assert (one.bounds(v)[:, one.leaf(v)] <= d2 + 1e-12).all()


def test_equal_rows_stay_in_one_leaf():
    rng = np.random.default_rng(0)
    tree = FO.grow(np.ones((100, 3)), 3, rng)
    assert set(tree.leaf(np.ones((5, 3)))) == {0} and (tree.bounds(np.ones((1, 3)))[0] > 0).sum() == 7
    # most rows equal to the largest: the others are still told apart from them
    v = np.r_[np.ones((90, 1)), np.zeros((10, 1))]
    assert len(set(FO.grow(v, 1, rng).leaf(v))) == 2


def test_recall_grows_with_checks(spark):
    rng = np.random.default_rng(7)
    n = 4000
    v = (rng.normal(size=(50, 16)) * 10)[rng.integers(0, 50, n)] + rng.normal(size=(n, 16))
    x = spark.createDataFrame([(i, i % 20, v[i].tolist()) for i in range(n)], FORM).cache()
    exact = pairs(M.nearest(x, x, 5))
    recall = []
    for checks in (16, 64, 256):
        got = pairs(M.nearest_forest(x, x, 5, checks=checks))
        hits = exact.keys() & got.keys()
        recall.append(len(hits) / len(exact))
        # what is found has the exact distance, and only targets of other groups are
        assert all(abs(exact[h][0] - got[h][0]) < 1e-9 for h in hits) and all(q % 20 != t % 20 for q, t in got)
    assert recall == sorted(recall) and recall[2] >= 0.9 and recall[0] < recall[2]
    # with as many checks as there are rows nothing is missed
    some = x.filter("id < 40")
    assert pairs(M.nearest_forest(some, x, 5, checks=8 * n)) == pairs(M.nearest(some, x, 5))


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, 1, [0.0, 0.0]), (2, 2, [1.0, 0.0]), (3, 3, None), (4, 4, [float("nan"), 0.0]), (None, 5, [0.0, 0.0]), (6, None, [0.0, 0.0]), (7, 7, [None, 1.0])]
    x = spark.createDataFrame(rows, FORM)
    assert pairs(M.nearest_forest(x, x, 3)) == {(1, 2): (1.0, 1), (2, 1): (1.0, 1)}
    none = spark.createDataFrame([], FORM)
    assert pairs(M.nearest_forest(none, x, 3)) == {} and pairs(M.nearest_forest(x, none, 3)) == {}
    # thousands of equal rows: those of the smallest ids, as the exact search has them
    same = spark.range(3000).selectExpr("id", "id % 3 as grp", "array(1D, 2D, 3D) as pc")
    few = same.filter("id < 9")
    assert pairs(M.nearest_forest(few, same, 4)) == pairs(M.nearest(few, same, 4))


def test_a_sample_by_hash_is_not_each_tasks_own(spark, monkeypatch):
    """The vectors of the smallest hashes come to the driver with few others, from however many tasks."""
    x = spark.range(6000).repartition(40).selectExpr("id", "array(cast(id as double), cast(id % 7 as double)) as pc").cache()
    want = [r["pc"] for r in x.orderBy(KNN.F.xxhash64("id", "pc"), "id").limit(100).collect()]
    sent, whole = [], type(x).toArrow
    monkeypatch.setattr(type(x), "toArrow", lambda df: sent.append(whole(df)) or sent[-1])
    assert KNN.hashed_first(x, 6000, 100).tolist() == want and len(sent) == 1 and len(sent[0]) < 300
    # a count that is too large leaves too few rows at first
    assert KNN.hashed_first(x, 10**7, 100).tolist() == want
    assert KNN.hashed_first(x.limit(3), 3, 100).shape == (3, 2) and not KNN.hashed_first(x.limit(0), 0, 100).size
