"""Matching, voting, points, formats and the driver's contract."""

import math
from collections import Counter

import numpy as np

from voxelweave.functions import vectors as V
from voxelweave.operators import features as FT
from voxelweave.operators import match as M
from voxelweave.operators import points as P
from voxelweave.operators import vote as VT
from voxelweave.plans.match import match_by_polarity, match_images, match_to_first
from voxelweave.sources import text as TX
from voxelweave.sources import volumes as VS


def rotation(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def images(spark, n=40):
    rng = np.random.default_rng(0)
    r, s, t = rotation(rng), 1.5, np.array([10.0, -5, 2])
    p, sc, pc = rng.random((n, 3)) * 50, 1 + rng.random(n) * 5, rng.random((n, 64))
    frames = [rotation(rng) for _ in range(n)]
    rows = [("a", i, *p[i].tolist(), float(sc[i]), frames[i].tolist(), pc[i].tolist()) for i in range(n)]
    moved = (p @ r.T) * s + t
    rows += [("b", i, *moved[i].tolist(), float(s * sc[i]), (frames[i] @ r.T).tolist(), (pc[i] + rng.normal(0, 0.01, 64)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "image_id string, feat_id long, x double, y double, z double, scale double, ori array<array<double>>, pc array<double>"), r, s, t


def test_planted_transform_is_found(spark):
    df, r, s, t = images(spark)
    got = match_to_first(df).collect()
    assert [(g.a, g.b) for g in got] == [("a", "b")] and got[0].inliers >= 35
    # from b to a: the inverse
    assert np.isclose(got[0].scale, 1 / s, rtol=1e-3) and np.allclose(got[0].rot, r.T, atol=1e-3)
    assert np.allclose(got[0].trans, -(r.T @ t) / s, atol=1e-2)


def test_ring_few_matches_and_options(spark):
    df, r, s, t = images(spark, 12)
    c = df.filter("image_id = 'a' and feat_id < 3").withColumn("image_id", M.F.lit("c"))
    # a-b by twelve matches, b-c by three (too few), c-a by twelve of a's nearest among three: voted on, not agreed on
    got = {(g.a, g.b): g for g in match_to_first(df.unionByName(c), ring=True).collect()}
    assert ("b", "c") not in got and got["a", "b"].n == 12 and got["a", "b"].inliers >= 10
    out = match_images(df, dedupe=True)
    assert {(h.a_feat, h.b_feat) for h in out.inliers.collect()} <= {(i, i) for i in range(12)} and out.inliers.count() == out.transforms.first().inliers
    own = {x.feat_id: (x.x, x.y, x.z, x.scale) for x in df.filter("image_id = 'a'").collect()}
    for x in out.aligned.collect():
        assert x.image_id == "b" and np.allclose((x.x, x.y, x.z, x.scale), own[x.feat_id], atol=0.3)
    assert match_images(df, max_ratio=0.0).transforms.count() == 0
    f = df.withColumn("info", M.F.when(df["feat_id"] < 6, 16).otherwise(0))
    parts = match_by_polarity(f)
    assert {k: v.transforms.first().n for k, v in parts.items()} == {"all": 12, "minima": 6, "maxima": 6}
    assert match_images(df.limit(0)).transforms.count() == 0


def test_second_neighbour_is_another_structure(spark):
    eye = FT.IDENTITY
    # the first five targets are one structure, seen five times; the sixth is elsewhere
    rows = [(i, 1, [0.1 * i, 0.0], 5.0 + 0.01 * i, 5.0, 5.0, 1.0, eye) for i in range(1, 6)] + [(6, 1, [2.0, 0.0], 50.0, 5.0, 5.0, 1.0, eye)]
    t = spark.createDataFrame(rows, "id long, grp long, pc array<double>, x double, y double, z double, scale double, ori array<array<double>>")
    q = spark.createDataFrame([(9, 2, [0.0, 0.0])], "id long, grp long, pc array<double>")
    got = M.apart(q, t).first()
    assert (got.t, round(got.d, 6), round(got.second, 6), round(got.ratio, 6)) == (1, 0.01, 4.0, 0.0025)
    alone = M.apart(q, t.filter("id < 6")).first()
    assert alone.t == 1 and alone.second is None and alone.ratio is None


def test_mirrored_frames_vote(spark):
    rng = np.random.default_rng(3)
    rows = []
    mirror = np.diag([1.0, 1.0, -1.0])
    for i in range(30):
        o = rotation(rng)
        p = rng.random(3) * 20
        rows.append(("k", i, 1.0, 2.0, p.tolist(), (2 * p + 1).tolist(), o.tolist(), (o if i % 2 else mirror @ o).tolist()))
    df = spark.createDataFrame(rows, "pair string, id long, s0 double, s1 double, p0 array<double>, p1 array<double>, o0 array<array<double>>, o1 array<array<double>>")
    votes = {(r.hyp, r.corr) for r in M.hough(df, ["pair"], rows=7).collect()}
    assert all((i, j) in votes for i in range(1, 30, 2) for j in range(1, 30, 2))
    counts = {r.hyp: r.inliers for r in M.hough(df, ["pair"], rows=7, count=True).collect()}
    assert counts == {h: sum(a == h for a, _ in votes) for h in {a for a, _ in votes}}
    best = M.best_hypothesis(M.hough(df, ["pair"], count=True), ["pair"])
    assert {r.corr for r in M.inliers(df, best, ["pair"]).collect()} == {c for h, c in votes if h == best.first().hyp}
    turned = spark.createDataFrame([(rotation(rng).tolist(),)], "o array<array<double>>").select("o", M.rotation(M.F.col("o"), M.F.col("o")).alias("r")).first()
    assert np.allclose(turned.r, np.eye(3))


def test_line_grid_loses_no_pair(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(150):
        p = rng.random(3) * 10
        q = p + rng.normal(size=3) * np.exp(rng.normal())
        rows.append((i, *p.tolist(), [(q if i % 15 else p).tolist()]))
    df = spark.createDataFrame(rows, "feat_id long, x double, y double, z double, ori array<array<double>>")
    d = lambda a, b: np.linalg.norm(np.subtract(a, b))
    for share in (0.5, 0.8):
        want = {(a[0], b[0]) for a in rows for b in rows if d(a[1:4], a[4][0]) * d(b[1:4], b[4][0]) > 0 and (d(a[1:4], b[1:4]) + d(a[4][0], b[4][0])) / (d(a[1:4], a[4][0]) + d(b[1:4], b[4][0])) < share}
        got = [(r.a.feat_id, r.b.feat_id) for r in M.compatible_lines(df, df, share).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_transform_algebra(spark):
    rng = np.random.default_rng(1)
    r, t = rotation(rng), [1.0, 2.0, 3.0]
    df = spark.createDataFrame([((2.0, r.tolist(), t),)], "t struct<scale: double, rot: array<array<double>>, trans: array<double>>")
    one = df.select(M.compose(M.invert(df["t"]), df["t"]).alias("i")).first().i
    assert np.isclose(one.scale, 1) and np.allclose(one.rot, np.eye(3)) and np.allclose(one.trans, 0)
    back = df.select(TX.parse_transform(TX.transform_lines(df["t"])).alias("b")).first().b
    assert np.isclose(back.scale, 2, rtol=1e-5) and np.allclose(back.rot, r, atol=1e-5) and np.allclose(back.trans, t)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    m, v = rng.normal(size=(3, 3)), rng.normal(size=3)
    df = spark.createDataFrame([(m.tolist(), v.tolist(), [0.0, 0.0, 0.0], [3.0, 1.0, 2.0, 1.0])], "m array<array<double>>, v array<double>, o array<double>, r array<double>")
    c = df.columns and df
    got = df.select(V.mat_vec(c["m"], c["v"]), V.invert3(c["m"]), V.det3(c["m"]), V.unit(c["o"]), V.ranks(c["r"]), V.mat_mul(c["m"], c["m"]), V.positive_unit(c["o"])).first()
    assert np.allclose(got[0], m @ v) and np.allclose(got[1], np.linalg.inv(m)) and np.isclose(got[2], np.linalg.det(m))
    assert got[3] == [1, 0, 0] and got[4] == [3, 0, 2, 1] and np.allclose(got[5], m @ m) and got[6] == [0, 0, 0]


def test_nearest_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.random((150, 8)).round(2)
    df = spark.createDataFrame([(i, i % 5, x[i].tolist()) for i in range(150)], "id long, grp long, pc array<double>").repartition(3)
    got = {(r.q, r.rank): r.t for r in M.nearest(df, df, 4, rows=16).collect()}
    for i in range(150):
        near = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(150) if j % 5 != i % 5)[:4]
        assert [got[i, k + 1] for k in range(4)] == [j for _, j in near]


def test_nearest_of_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    kinds = rng.random((3, 64))
    ids = rng.permutation(180).tolist()
    rows = [(ids[i], i % 2, kinds[i % 3].tolist()) for i in range(180)]
    df = spark.createDataFrame(rows, "id long, grp long, pc array<double>").coalesce(1)
    got = {(r.q, r.rank): (r.t, r.d) for r in M.nearest(df, df, 5).collect()}
    for q, g, v in rows:
        assert [got[q, k + 1] for k in range(5)] == [(t, 0.0) for t in sorted(t for t, h, w in rows if h != g and w == v)[:5]]


def test_grid_join_loses_no_pair(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *(rng.random(3) * 12).tolist(), float(np.exp(rng.normal())), FT.IDENTITY) for i in range(120)]
    df = spark.createDataFrame(rows, "feat_id long, x double, y double, z double, scale double, ori array<array<double>>")
    got = {(r.a.feat_id, r.b.feat_id) for r in M.compatible(df, df).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if abs(np.log(a[4] / b[4])) < np.log(1.5) and np.linalg.norm(np.subtract(a[1:4], b[1:4])) < 0.5 * a[4]}
    assert got == want


def test_suppression_is_greedy(spark):
    rng = np.random.default_rng(5)
    p = rng.integers(0, 20, (200, 3))
    df = spark.createDataFrame([("v", *map(int, q), 1.0, i) for i, q in enumerate(p)], "vol string, x int, y int, z int, v double, seq int")
    kept = []
    for q in p:
        if all(((q - k) ** 2).sum() >= 16 for k in kept):
            kept.append(q)
    want = sorted(map(tuple, np.array(kept).tolist()))
    for whole in (1000, 10):  # by a fold, and in rounds
        assert sorted((r.x, r.y, r.z) for r in P.suppress(df, "vol", 4, ("seq",), whole).collect()) == want
    assert P.suppress(df.limit(0), "vol", 4, ("seq",)).count() == 0


def test_suppression_of_large_small_and_null_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(g, *map(int, rng.integers(0, 12, 3)), i) for g, n in ((1, 90), (2, 8), (None, 70)) for i in range(n)]
    df = spark.createDataFrame(rows, "vol long, x long, y long, z long, seq long")
    got = [sorted((str(r.vol), r.x, r.y, r.z) for r in P.suppress(df, "vol", 3, ("seq",), whole).collect()) for whole in (1000, 40, 1)]
    assert got[0] == got[1] == got[2] and {g for g, *_ in got[0]} == {"1", "2", "None"}


def test_feature_text_round_trip(spark, tmp_path):
    row = (1.5, 2.25, 3.0, 4.5, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [3.0, 2.0, 1.0], 48, [float(i) for i in range(64)])
    flat = (9.0, 9.0, 9.0, 1.0, row[4], [1e6, 1.0, 1.0], 0, row[7])
    df = spark.createDataFrame([("i1", *row), ("i1", *flat), ("i2", *row)], "image_id string, x float, y float, z float, scale float, ori array<array<float>>, eigs array<float>, info int, pc array<float>")
    TX.write_features(df, str(tmp_path / "f"), limit=140.0, comments=("made here",))
    back = TX.read_features(spark, str(tmp_path / "f" / "image_id=i1")).drop("image_id").collect()
    assert len(back) == 1 and tuple(back[0])[:4] == row[:4] and back[0].info == 48 and list(back[0].pc) == row[7] and back[0].ori == row[4]
    first = (tmp_path / "f" / "image_id=i1").glob("part-*")
    assert next(first).read_text().startswith("# made here\nFeatures: 1\n")


def test_feature_binary_round_trip(spark, tmp_path):
    rng = np.random.default_rng(9)
    row = lambda i, e: (f"i{i % 2}", *map(float, rng.random(4).astype(np.float32)), rng.random((3, 3)).astype(np.float32).tolist(), e, 48, [float(x) for x in rng.integers(0, 256, 64)])
    rows = [row(i, [3.0, 2.0, 1.0]) for i in range(7)] + [row(0, [1e6, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "image_id string, x float, y float, z float, scale float, ori array<array<float>>, eigs array<float>, info int, pc array<float>")
    VS.save(TX.feature_files(df, limit=140.0), str(tmp_path / "b"), "").collect()
    assert (tmp_path / "b" / "i0").read_bytes().startswith(b"# featExtract 1.1\nFeatures: 4\n") and (tmp_path / "b" / "i1").stat().st_size == 30 + 3 * 132
    key = lambda r: (r[0], r[1], [list(a) for a in r[5]], list(r[6]), r[7], list(r[8]))
    assert sorted(map(key, TX.read_feature_files(spark, str(tmp_path / "b")).collect())) == sorted(map(key, rows[:7]))
    assert TX.feature_files(df.limit(0)).count() == 0


def test_summary_lines(spark):
    t = (2.0, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [1.0, 2.0, 3.0])
    df = spark.createDataFrame([("0-1", "b.key", 7, t)], "pair string, name string, inliers long, transform struct<scale double, rot array<array<double>>, trans array<double>>")
    assert TX.summary_lines(df).first().line == "b.key:\t7\t0\t0\t2.000000\t1.000000\t2.000000\t3.000000"


def test_similarity_of_three_points(spark):
    rng = np.random.default_rng(4)
    r, p = rotation(rng), rng.random((3, 3)) * 10
    q = 2.5 * p @ r.T + [1, -2, 3]
    df = spark.createDataFrame([(p.tolist(), q.tolist()), ([[0.0] * 3] * 3, q.tolist())], "p array<array<double>>, q array<array<double>>")
    got = [x.t for x in df.select(M.similarity_of(df["p"], df["q"]).alias("t")).collect()]
    assert np.isclose(got[0].scale, 2.5) and np.allclose(got[0].rot, r) and np.allclose(got[0].trans, [1, -2, 3]) and got[1] is None


def test_gaussian_2d():
    w = np.zeros((21, 21))
    for i, j, v in V.gaussian_2d((21, 21), (2.0, 3.0)):
        w[i, j] = v
    assert np.isclose(w.sum(), 1, atol=1e-3) and np.allclose(w, w[::-1, ::-1])
    turned = {(i, j): v for i, j, v in V.gaussian_2d((21, 21), (2.0, 3.0), theta=np.pi / 2)}
    assert all(np.isclose(turned[i, j], w[j, i]) for i in range(21) for j in range(21))
    slope = {(i, j): v for i, j, v in V.gaussian_2d((21, 21), (2.0, 3.0), along=0.0)}
    assert np.isclose(slope[10, 5], w[10, 6] - w[10, 4]) and np.isclose(slope[10, 10], 0)


def test_points_text(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1.9\t2\t3\t0.5\nbad\t1\n-1.9\t0\t0\t2\n")
    assert sorted(map(tuple, TX.read_points(spark, str(tmp_path / "p.txt")).collect())) == [(-1, 0, 0, 2.0), (1, 2, 3, 0.5)]


def test_nifti_round_trip(spark, tmp_path):
    import gzip

    a = np.random.default_rng(6).random((2, 3, 4, 5)).astype(np.float32)
    (tmp_path / "a.nii").write_bytes(VS.encode_nifti(a, (3.0, 2.0, 1.0)))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(VS.encode_nifti(a[:1])))
    rows = VS.read_nifti(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * 60 + 60
    assert all(np.isclose(r.v, a[r.t, r.z, r.y, r.x]) for r in rows)
    assert {r.t for r in VS.read_nifti(spark, str(tmp_path / "a.nii"), volumes=[1]).collect()} == {1}
    part = VS.read_nifti(spark, str(tmp_path / "a.nii"), volumes=[1], box=((1, 2), (3, 1), (0, 4))).collect()
    assert {(r.z, r.y, r.x) for r in part} == {(z, 3, x) for z in (1, 2) for x in range(4)} and all(r.v == float(a[1, r.z, r.y, r.x]) for r in part)
    h = VS.read_headers(spark, str(tmp_path / "a.nii")).first()
    assert list(h.dims) == [3, 4, 5] and list(h.spacing) == [3.0, 2.0, 1.0]
    files = VS.assembled(VS.read_nifti(spark, str(tmp_path / "a.nii")), (3, 4, 5), VS.encode_nifti)
    VS.save(files, str(tmp_path / "out"), ".copy").collect()
    assert np.array_equal(VS.parse_nifti((tmp_path / "out" / "a.nii.copy").read_bytes())[0], a)


def test_raw_and_pnm(spark, tmp_path):
    a = np.arange(24, dtype="<f4")
    (tmp_path / "a.img").write_bytes(a.tobytes())
    (tmp_path / "a.txt").write_text("Features: 2\nx: 3\ny: 2\nz: 2\nt: 1\ndata: a.img\nmeans: 1 2\nvars: 3 4\n")
    got = {(r.z, r.y, r.x): r.v for r in VS.read_array(spark, str(tmp_path / "a.txt"), channel=1).collect()}
    assert got[1, 1, 2] == a.reshape(2, 2, 3, 2)[1, 1, 2, 1]
    both = VS.read_array(spark, str(tmp_path / "a.txt"))
    VS.save_arrays(both, (2, 2, 3), str(tmp_path / "again")).collect()
    (header,) = (tmp_path / "again").glob("*.txt")
    back = {(r.z, r.y, r.x): r.v for r in VS.read_array(spark, str(header)).collect()}
    assert back == {(r.z, r.y, r.x): r.v for r in both.collect()}
    assert VS.means_and_variances("m: 1 2\nv: 3\n") == {"means": [1.0, 2.0], "variances": [3.0]}
    img = np.arange(12).reshape(3, 4)
    assert np.array_equal(VS.parse_pnm(VS.encode_pgm(img, 0, 255)), img)
    assert VS.parse_pnm(b"P3\n# c\n2 1\n255\n1 2 3 4 5 6\n").shape == (1, 2, 3)


def test_streamed_volumes(spark, tmp_path):
    from voxelweave.operators import volumes as VOL
    from voxelweave.streaming.volumes import on_new_voxels

    df = spark.createDataFrame([("s", 0, 0, i, float(i)) for i in range(4)], "vol string, z int, y int, x int, v double")
    df.write.parquet(str(tmp_path / "in"))
    q = on_new_voxels(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), VOL.statistics)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().total == 6.0


def test_registry():
    import __spark_entry__

    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(q) > 70 and set(s) <= set(q)


def test_votes_reach_the_thresholds(spark):
    """Scales up to a factor of e, places up to two scales away, axes up to a cosine of 0.7: votes within, none beyond."""
    def frame(angle):
        c, s = math.cos(angle), math.sin(angle)
        return [[c, s, 0.0], [-s, c, 0.0], [0.0, 0.0, 1.0]]

    eye = frame(0.0)
    at = [(0, 1.0, 0.0, eye), (1, 2.5, 0.0, eye), (2, 2.8, 0.0, eye), (3, 1.0, 1.5, eye), (4, 1.0, 2.1, eye), (5, 1.0, 0.0, frame(math.acos(0.72))), (6, 1.0, 0.0, frame(math.acos(0.68)))]
    corr = spark.createDataFrame([("p", i, 1.0, s, [10.0 * i, 0.0, 0.0], [10.0 * i + d, 0.0, 0.0], eye, o) for i, s, d, o in at], "pair string, id long, s0 double, s1 double, p0 array<double>, p1 array<double>, o0 array<array<double>>, o1 array<array<double>>")
    votes = {r["corr"] for r in M.hough(corr, ["pair"]).filter("hyp = 0").collect()}
    assert votes == {0, 1, 3, 5}
    best = spark.createDataFrame([("p", 0)], "pair string, hyp long")
    assert {r["corr"] for r in M.inliers(corr, best, ["pair"]).collect()} == votes


def test_zones_rule_out_most_of_clustered_targets(spark):
    """Equal to brute force with every rule, ties and repeats among them; most pairs of clustered rows are not measured."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 6)) * 8
    vecs = np.round(centres[rng.integers(12, size=900)] + rng.normal(size=(900, 6)) * 0.4, 1)
    vecs[:200] = vecs[0]  # very many equal ones
    rows = [(i, i % 5, vecs[i].tolist()) for i in range(900)]
    odd = [(1000, 1, None), (1001, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, 1, [float("nan")] * 6), (1003, None, [0.0] * 6), (None, 1, [0.0] * 6), (1004, 1, [float("inf")] * 6)]
    df = spark.createDataFrame(rows + odd, "id long, grp long, pc array<double>").repartition(3)
    ids, grp = np.arange(900), np.arange(900) % 5
    d = ((vecs[:, None] - vecs[None]) ** 2).sum(axis=2)
    for other, allowed in ((True, grp[:, None] != grp[None]), (False, ids[:, None] != ids[None]), (None, grp[:, None] == grp[None])):
        met = M.KNN.Met()
        got = {(r.q, r.rank): (r.t, r.d) for r in M.nearest(df, df, 4, other, rows=64, met=met).collect()}
        assert len(got) == 3600
        for q in range(900):
            own = np.where(allowed[q], d[q], np.inf)
            for rank, t in enumerate(np.lexsort((ids, own))[:4], 1):
                assert got[q, rank][0] == t and math.isclose(got[q, rank][1], own[t], abs_tol=1e-12)
        if other is not None:
            assert met.rounds >= 2 and met.skipped > 0.5, met


def test_zones_where_few_targets_are_allowed(spark):
    """A query whose group holds all but a few far targets goes on, round by round, until it has them."""
    rng = np.random.default_rng(2)
    vecs = np.r_[rng.normal(size=(400, 3)), rng.normal(size=(3, 3)) + 90]
    df = spark.createDataFrame([(i, int(i >= 400), v.tolist()) for i, v in enumerate(vecs)], "id long, grp long, pc array<double>")
    got = M.nearest(df.filter("id < 20"), df, 5, rows=32).groupBy("q").count().collect()
    assert [r["count"] for r in got] == [3] * 20


def test_second_neighbour_by_zones(spark):
    """apart() with zones against brute force: most neighbours are compatible with the first."""
    rng = np.random.default_rng(8)
    n = 300
    spot, scale = rng.integers(0, 12, n), rng.uniform(1.0, 1.2, n)
    place = rng.normal(size=(12, 3))[spot] * 50 + rng.normal(size=(n, 3)) * 0.1
    vecs = spot[:, None] * 3.0 + rng.normal(size=(n, 4))
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    df = spark.createDataFrame([(i, i % 3, vecs[i].tolist(), *place[i].tolist(), float(scale[i]) if i else None, eye) for i in range(n)], "id long, grp long, pc array<double>, x double, y double, z double, scale double, ori array<array<double>>")
    for rows in (16, 2048):
        got = {r.q: r for r in M.apart(df, df, rows=rows).collect()}
        assert len(got) == n
        for q in range(n):
            d = np.where(np.arange(n) % 3 == q % 3, np.inf, ((vecs - vecs[q]) ** 2).sum(axis=1))
            t = int(d.argmin())
            far = (np.abs(np.log(scale / scale[t])) >= M.SAME[0]) | (np.sqrt(((place - place[t]) ** 2).sum(axis=1)) >= M.SAME[1] * scale)
            far &= (np.arange(n) != 0) & (t != 0)  # the first has no scale, so no whole place
            second = np.where(far, d, np.inf).min()
            assert got[q].t == t and math.isclose(got[q].d, d[t])
            assert (got[q].second is None) == (not np.isfinite(second)) and (got[q].second is None or math.isclose(got[q].second, second))


def test_log_likelihood_without_the_own_share(spark):
    """Against the sum by hand: the image's own rows are taken from its label's prior, before and in the totals."""
    feats = [("a", "L")] * 3 + [("b", "L")] * 2 + [("c", "M")] * 4
    near = [(1, "a", 10, "b", "L", 0.5, 1), (1, "a", 11, "c", "M", 1.0, 2), (2, "a", 12, "c", "M", 0.0, 1), (3, "c", 13, "a", "L", 2.0, 1)]
    df = spark.createDataFrame(feats, "image string, label string")
    out = VT.log_likelihood(spark.createDataFrame(near, "q long, qimg string, t long, timg string, label string, d double, rank int"), VT.priors(df), VT.own_shares(df))
    got = {(r.image, r.label): r.loglik for r in out.collect()}
    want = {}
    for image, label in (("a", "L"), ("c", "M")):
        prior = {"L": 6 / 11, "M": 5 / 11}
        prior[label] -= sum(x == (image, label) for x in feats) / 11
        for l in prior:
            total = 0.0
            for q in {n[0] for n in near if n[1] == image}:
                mine = [n for n in near if n[0] == q]
                m = min((n[5] for n in mine if n[5] > 0), default=0.0)
                c = {k: p + sum(math.exp(-((n[5] / (m + 1)) ** 2)) for n in mine if n[4] == k) / p for k, p in prior.items()}
                total += math.log(c[l] / sum(c.values()))
            want[image, l] = total
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_places_join_the_descriptor(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 4.0, 8.0, -2.0, 2.0), (2, [1.0, 2.0], 1.0, 1.0, 1.0, 0.0)], "feat_id long, pc array<float>, x float, y float, z float, scale float")
    got = {r.feat_id: r.pc for r in FT.with_place(df, 0.5).collect()}
    assert got[1] == [1.0, 2.0, 1.0, 2.0, -0.5] and got[2][2:] == [None] * 3


def test_rows_sent_to_zones_are_not_broadcast(spark, monkeypatch):
    """What Python makes of a small table, a query's row for each zone that it meets, may be large: no task gets it whole."""
    x = np.random.default_rng(21).normal(size=(700, 16))
    df = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "id long, grp long, pc array<double>")
    plans, kept = [], M.KNN.written

    def told(out, label):
        if label == "nearest":
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        return kept(out, label)

    monkeypatch.setattr(M.KNN, "written", told)
    met = M.KNN.Met()
    got = {(r.q, r.rank): r.t for r in M.nearest(df, df, 3, rows=64, met=met).collect()}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d[np.arange(700)[:, None] % 4 == np.arange(700)[None] % 4] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert all(got[q, k + 1] == near[q, k] for q in range(700) for k in range(3))


def test_lsh_keeps_its_pairs_and_lists_none(spark):
    """The nearest of all pairs that share a bucket, as Spark's own join has them; its join of buckets is not used."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    x = np.random.default_rng(4).normal(size=(300, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, grp long, pc array<double>")
    near = M.nearest_lsh(df, df, 3, width=0.05, tables=2)
    assert "BucketedRandomProjection" not in near._jdf.queryExecution().executedPlan().toString()
    v = df.select("id", "grp", array_to_vector("pc").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.05, numHashTables=2, seed=1).fit(v)
    met = {}
    for r in model.approxSimilarityJoin(v, v, 1.5, "dist").filter("datasetA.grp != datasetB.grp").select("datasetA.id", F.col("datasetB.id").alias("t"), "dist").collect():
        met.setdefault(r.id, []).append((r.dist, r.t))
    got = {(r.q, r["rank"]): r.t for r in near.collect()}
    assert got == {(q, k): t for q, found in met.items() for k, (_, t) in enumerate(sorted(found)[:3], 1)}


def test_wide_buckets_meet_once(spark, monkeypatch):
    """Where nearly all rows share buckets, a row comes once and not for each table; the pairs are those of Spark's own join."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    x = np.random.default_rng(5).normal(size=(120, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, grp long, pc array<double>")
    sent, products = [], M.KNN.products
    monkeypatch.setattr(M.KNN, "products", lambda q, t, *a: sent.append((q.count(), t.count())) or products(q, t, *a))
    got = {(r.q, r["rank"]): r.t for r in M.nearest_lsh(df, df, 3, width=0.7, tables=3).collect()}
    assert sent == [(120, 120)]
    v = df.select("id", "grp", array_to_vector("pc").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.7, numHashTables=3, seed=1).fit(v)
    met = {}
    for r in model.approxSimilarityJoin(v, v, 1.5, "dist").filter("datasetA.grp != datasetB.grp").select("datasetA.id", F.col("datasetB.id").alias("t"), "dist").collect():
        met.setdefault(r.id, []).append((r.dist, r.t))
    assert got == {(q, k): t for q, found in met.items() for k, (_, t) in enumerate(sorted(found)[:3], 1)}
    assert len({(q, t) for q, found in met.items() for _, t in found}) < 2 * 40 * 120  # some pairs share no bucket


def test_recall_searches_exact_neighbours_once(spark, monkeypatch):
    from voxelweave import catalog

    asked, knn5 = [], catalog.knn5
    monkeypatch.setattr(catalog, "knn5", lambda *a: asked.append(a) or knn5(*a))
    for query in (catalog.lsh_recall, catalog.forest_recall):
        assert query(spark, "/root/testdata/sf0.001").first().enough
    assert len(asked) == 2


def test_single_precision_decides_nothing():
    """Blocks of vectors that single precision can't tell apart, can't hold or holds exactly: equal to sums in double, ties by id."""
    rng = np.random.default_rng(6)
    far = 10.0 ** rng.integers(-30, 30, (300, 1))
    for v in (rng.normal(size=(300, 8)), 1e6 + rng.normal(size=(300, 8)) * 1e-3, rng.normal(size=(300, 8)) * 1e25, rng.normal(size=(300, 8)) * far, np.round(rng.normal(size=(300, 2))), rng.integers(0, 64, (300, 9)) * 1.0):
        kept = M.KNN._from_bytes(M.KNN._to_bytes(v)).reshape(v.shape)
        assert np.array_equal(kept, v)
        x = {"id": rng.permutation(300), "grp": np.arange(300) % 4, "pc": kept}
        with np.errstate(over="ignore"):
            d = ((v[:, None] - v[None]) ** 2).sum(axis=2)
        d[x["grp"][:, None] == x["grp"][None]] = np.inf
        for k in (1, 5):
            i, t, got, rank = M.KNN._first([M.KNN._best(x, x, np.full(300, np.inf), k, M._base(True))], k)
            for q in range(300):
                want = np.lexsort((x["id"], d[q]))[:k]
                assert t[i == q].tolist() == x["id"][want].tolist() and got[i == q].tolist() == d[q][want].tolist()
    kinds = [M.KNN._to_bytes(np.array(v, np.float64))[-1:] for v in ([0, 255], [0.5, -1], [0.1], [256.0], [float("nan")], [1e300], [])]
    assert kinds == [b"B", b"f", b"d", b"f", b"f", b"d", b"f"]


def _correspondences(spark, n):
    rng = np.random.default_rng(n)
    eye = np.eye(3).tolist()
    p = rng.normal(size=(n, 3)) * 3
    rows = [("p", i, *rng.uniform(0.5, 2, 2).tolist(), p[i].tolist(), (p[i] + rng.normal(size=3)).tolist(), eye, eye) for i in range(n)]
    return spark.createDataFrame(rows, "pair string, id long, s0 double, s1 double, p0 array<double>, p1 array<double>, o0 array<array<double>>, o1 array<array<double>>")


def test_votes_of_one_pair_are_many_tasks(spark):
    """Blocks of one pair of images meet in several tasks; votes gathered by either side are those listed one by one."""
    corr = _correspondences(spark, 90)
    votes = M.hough(corr, ["pair"], rows=10)
    held = votes.rdd.glom().map(len).filter(bool).count()
    assert held > 1
    listed = {(r.hyp, r["corr"]) for r in votes.collect()}
    of = lambda c: [h for h, x in listed if x == c]
    got = {r["corr"]: tuple(r)[2:] for r in M.supporters(corr, ["pair"], rows=10).collect()}
    assert got == {c: (len(of(c)), min(of(c)), max(of(c)), sum(of(c))) for c in {x for _, x in listed}}
    counts = {r.hyp: r.inliers for r in M.hough(corr, ["pair"], rows=10, count=True).collect()}
    assert counts == {h: sum(x == h for x, _ in listed) for h in {x for x, _ in listed}}


def test_a_groups_neighbours_are_many_tasks(spark):
    df = spark.createDataFrame([(i, 7, [float(i), 0.0]) for i in range(120)], "id long, grp long, pc array<double>")
    met = M.nearest(df, df, 2, None, rows=10)
    assert met.select("q").distinct().count() == 120
    found = M.KNN.products(*[M._vectors(df).selectExpr("*", "grp as zone", "double('infinity') as kth")] * 2, 2, M._base(None), rows=10)
    assert found.rdd.glom().map(len).filter(bool).count() > 1


def test_inliers_are_all_matches_not_the_voters_alone(spark):
    df, *_ = images(spark, 12)
    out = match_images(df, most=6)
    t = out.transforms.first()
    assert t.n == 6 and t.inliers <= 6 and out.inliers.count() >= 10


def test_reports_keep_the_sign_of_a_rounded_zero(spark, tmp_path):
    from voxelweave.catalog_formats import report_text

    rows = [(1, [-1e-6, 1e-6, -0.5] + [0.1] * 61, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert report_text(spark, str(tmp_path)).first().line.split("\t")[1:4] == ["-0.000000", "0.000000", "-25.000000"]


def test_support_is_what_each_pair_measures_to():
    """Of many turns and frames or few, with places and scales on thresholds, and with numbers that are none."""
    rng = np.random.default_rng(8)
    for kinds in (1, 3, 80):
        for grid in (False, True):
            n = 80
            own = np.linalg.qr(rng.normal(size=(kinds, 2, 3, 3)))[0][rng.integers(0, kinds, n)].reshape(n, 18)
            if kinds > 1:
                own = np.where(rng.random(n)[:, None] < 0.5, np.tile(np.eye(3).ravel(), 2), own)
            place = rng.integers(-2, 3, (n, 6)).astype(float) if grid else rng.normal(size=(n, 6))
            v = np.concatenate([2.0 ** rng.integers(-1, 2, (n, 2)), place, own], axis=1)
            v[3, 4], v[7, 11], v[9, 0], v[11, 20] = math.nan, math.inf, math.inf, math.nan
            with np.errstate(all="ignore"):
                h, c = M.Side.of(np.arange(n), v), M.Side.of(np.arange(n), v)
                got = np.zeros((n, n), bool)
                got[np.ix_(h.ids, c.ids)] = M._support(h, c, math.log(2), 2.0, 0.7)
                turn = M._turns(v[:, 8:17].reshape(-1, 3, 3), v[:, 17:].reshape(-1, 3, 3))
                for i in range(n):
                    s = v[i, 1] / v[i, 0]
                    moved = (v[:, 2:5] - v[i, 2:5]) @ turn[i].T * s + v[i, 5:8]
                    near = (np.abs(np.log(v[:, 0] / v[:, 1] * s)) < math.log(2)) & (((moved - v[:, 5:8]) ** 2).sum(axis=1) < (2 * v[:, 1]) ** 2)
                    near &= (np.einsum("ab,nkb,nka->nk", turn[i], v[:, 8:17].reshape(-1, 3, 3), v[:, 17:].reshape(-1, 3, 3)).min(axis=1) > 0.7)
                    # random places are nowhere near a threshold; on the grid, sums of another order may differ there
                    assert (got[i] == near).mean() >= (0.9 if grid and kinds > 1 else 1.0)
            assert got.any()


def test_votes_of_few_turns_measure_no_pair_alone(monkeypatch):
    """Frames that are all one turn are one product: pairs far from each threshold are not measured one by one."""
    rng = np.random.default_rng(9)
    n, eye = 200, np.tile(np.eye(3).ravel(), 2)
    v = np.concatenate([np.ones((n, 2)), rng.normal(size=(n, 3)) * 9, rng.normal(size=(n, 3)) * 9, np.tile(eye, (n, 1))], axis=1)
    s = M.Side.of(np.arange(n), v)
    assert len(s.frames) == len(s.turns) == 1
    made = []
    monkeypatch.setattr(M, "_runs", lambda w, f=M._runs: made.append(len(w)) or f(w))
    ok = M._support(s, s, 1.0, 2.0, 0.7)
    assert ok.diagonal().all() and made == [n, n]


def test_line_pairs_by_blocks(spark):
    """line_pairs() against compatible_lines() within groups, over several blocks, with equal ids and odd rows."""
    rng, rows = np.random.default_rng(3), []
    for i in range(300):
        p = rng.normal(size=3) * rng.choice([1, 1e-3]) + rng.choice([0, 0, 1e5])
        rows.append((i // 2 if i < 20 else i, i % 2, *map(float, p), [list(map(float, p + rng.normal(size=3) * rng.choice([0.5, 2])))]))
    # gap over length is the share itself, just below it, and lines without length or with no number
    rows += [(900, 0, 0.0, 0.0, 0.0, [[2.0, 0.0, 0.0]]), (901, 0, 0.0, 1.0, 0.0, [[2.0, 1.0, 0.0]]), (902, 0, 0.0, 1 - 1e-15, 0.0, [[2.0, 1 - 1e-15, 0.0]])]
    rows += [(903, 0, 1.0, 1.0, 1.0, [[1.0, 1.0, 1.0]]), (904, 0, float("nan"), 0.0, 0.0, [[1.0, 0.0, 0.0]]), (905, 0, float("inf"), 0.0, 0.0, [[1.0, 0.0, 0.0]]), (None, 0, 0.0, 0.0, 0.0, [[2.0, 0.0, 0.0]]), (906, None, 0.0, 0.0, 0.0, [[2.0, 0.0, 0.0]]), (907, 0, 0.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "feat_id long, image_id long, x double, y double, z double, ori array<array<double>>")
    far = lambda a, b: math.sqrt(sum((u - w) ** 2 for u, w in zip(a, b, strict=True)))
    whole, want = [r for r in rows if r[0] is not None and r[1] is not None and r[5]], Counter()
    for a in whole:
        for b in whole:
            size = far(a[2:5], a[5][0]) + far(b[2:5], b[5][0])
            if a[0] < b[0] and a[1] == b[1] and size and (far(a[2:5], b[2:5]) + far(a[5][0], b[5][0])) / size < 0.5:
                want[a[0], b[0]] += 1
    assert (900, 902) in want and (900, 901) not in want and sum(want.values()) > 100
    for size in (4096, 40):
        assert Counter((r.a_id, r.b_id) for r in M.line_pairs(df, "feat_id", ["image_id"], rows=size).collect()) == want
    assert M.line_pairs(df.limit(0), "feat_id", ["image_id"]).count() == 0


def test_second_neighbour_takes_one_search(spark):
    """Where the first neighbours are places apart, all pairs are measured once; where they are not, their queries go on."""
    rng = np.random.default_rng(4)
    place, vecs, eye = rng.normal(size=(60, 3)) * 100, rng.normal(size=(60, 4)), FT.IDENTITY
    place[40:] = place[40] + rng.normal(size=(20, 3)) * 0.01
    vecs[40:] = 50 + rng.normal(size=(20, 4))
    rows = [(i, i % 2, vecs[i].tolist(), *place[i].tolist(), 1.0, eye) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, grp long, pc array<double>, x double, y double, z double, scale double, ori array<array<double>>")
    for some, more in (("id < 40", 0), ("id >= 0", 20 * 60)):
        met, x = M.KNN.Met(), df.filter(some)
        got, n = M.apart(x, x, met=met).collect(), x.count()
        assert met.measured == n * n + more and len(got) == n
        for r in got:
            d = ((vecs[:n] - vecs[r.q]) ** 2).sum(axis=1)
            d[np.arange(n) % 2 == r.q % 2] = np.inf
            apart = np.sqrt(((place[:n] - place[r.t]) ** 2).sum(axis=1)) >= M.SAME[1]
            assert r.t == d.argmin() and math.isclose(r.second, d[apart].min())
