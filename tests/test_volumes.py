"""Volumes against numpy on small analytic arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.functions import vectors as V
from voxelweave.operators import bricks as BR
from voxelweave.operators import volumes as VOL
from voxelweave.plans import extract as X


def frame(spark, a, vol="a"):
    return spark.createDataFrame([(vol, *map(int, i), float(v)) for i, v in np.ndenumerate(a) for i in [i]], "vol string, z int, y int, x int, v double")


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.z, r.y, r.x] = r.v
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).random((5, 7, 9))


def test_kernel_width_and_sum():
    for s in (0.5, 1.0, 1.6):
        k = V.gaussian(s)
        assert abs(sum(w for _, w in k) - 1) < 1e-12 and k[0][0] == -k[-1][0]


def test_impulse_is_the_kernels_product(spark):
    a = np.zeros((15, 15, 15))
    a[7, 7, 7] = 1
    got = dense(VOL.blur(frame(spark, a), 1.0, a.shape), a.shape)
    k = np.zeros(15)
    for o, w in V.gaussian(1.0):
        k[7 + o] = w
    want = np.einsum("i,j,k->ijk", k, k, k)
    assert np.allclose(np.nan_to_num(got), want)
    assert np.allclose(X.blurred(a, 1.0), want)


def test_blur_equals_numpy(spark, noise):
    assert np.allclose(dense(VOL.blur(frame(spark, noise), 1.0, noise.shape), noise.shape), X.blurred(noise, 1.0))


def test_mirrored_border_keeps_a_constant(spark):
    a = np.full((4, 5, 6), 7.0)
    got = dense(VOL.blur(frame(spark, a), None, a.shape, [(-1, 0.25), (0, 0.5), (1, 0.25)], "xy", "mirror"), a.shape)
    assert np.allclose(got, 7)


def test_pool_double_and_shapes(spark, noise):
    f = frame(spark, noise)
    assert np.allclose(dense(VOL.pool(f, noise.shape), (2, 3, 4)), X.pooled(noise))
    big = dense(VOL.double(f, noise.shape), (10, 14, 18))
    assert np.allclose(big[::2, ::2, ::2], noise) and np.allclose(big[0, 0, 17], noise[0, 0, 8])
    assert np.allclose(big[0, 0, 1], (noise[0, 0, 0] + noise[0, 0, 1]) / 2)


def test_ramp_gradient_and_trilinear(spark):
    z, y, x = np.mgrid[:5, :6, :7]
    a = (x + 2 * y + 3 * z).astype(float)
    g = VOL.gradient(frame(spark, a), a.shape).filter("x between 1 and 5 and y between 1 and 4 and z between 1 and 3").collect()
    assert {(r.dx, r.dy, r.dz) for r in g} == {(2.0, 4.0, 6.0)}
    assert VOL.gradient(frame(spark, a), a.shape).filter("x = 0 and dx != 0").count() == 0
    p = [(0, 2.2, 3.1, 1.9), (1, 0.1, 0.1, 0.1), (2, 6.9, 5.9, 4.9)]
    pts = spark.createDataFrame([("a", *q) for q in p], "vol string, id long, fx double, fy double, fz double")
    got = {r.id: r.value for r in VOL.sample(pts, frame(spark, a), a.shape).collect()}
    assert np.isclose(got[0], 1.7 + 2 * 2.6 + 3 * 1.4) and np.isclose(got[1], 0) and np.isclose(got[2], a.max())
    back = VOL.scatter(pts.withColumn("value", pts["fx"]), a.shape)
    assert np.isclose(back.agg({"v": "sum"}).first()[0], sum(q[1] for q in p))
    assert np.allclose(X.trilinear(a, np.array([q[1:] for q in p]), "zero"), [got[0], got[1], got[2]])


def test_constant_normalises_to_zero(spark):
    f = frame(spark, np.full((3, 3, 3), 7.0))
    assert {r.v for r in VOL.normalise(f, "minmax").collect()} == {0.0}
    assert {r.v for r in VOL.normalise(f, "zero_mean_l2").collect()} == {None}


def test_isotropic_size(spark, noise):
    a = noise[:4, :, :]
    got, dims = VOL.resample_isotropic(frame(spark, a), a.shape, (2.0, 1.0, 1.0))
    assert dims == (8, 7, 9) and got.count() == 8 * 7 * 9


def test_extrema_polarity_swaps(spark, noise):
    f, g = frame(spark, noise), frame(spark, -noise)
    a = {(r.z, r.y, r.x): r.polarity for r in VOL.extrema(f).collect()}
    b = {(r.z, r.y, r.x): r.polarity for r in VOL.extrema(g).collect()}
    assert a and a == {k: 1 - v for k, v in b.items()}


def test_neighbourhoods():
    for n in (2, 3, 4, 6, 8, 13, 18, 26):
        assert len(set(VOL.neighbourhood(n))) == n


def test_haar_bank(spark):
    b = VOL.haar((2, 4, 4), (1, 2, 3), spark)
    assert b.count() == 6 * 32 and b.filter("lx = 0 and ly = 0").agg({"v": "sum"}).first()[0] == 32


def blob(sign=1.0):
    z, y, x = np.mgrid[:32, :32, :32]
    return sign * np.exp(-((x - 16.3) ** 2 + (y - 15.6) ** 2 + (z - 16.1) ** 2) / 18)


def test_blob_has_one_point_at_its_centre():
    top = [k for k in X.keypoints(blob(), X.Options(eigen=-1.0, reoriented=False)) if np.abs(np.array(k[:3]) - (16.8, 16.1, 16.6)).max() < 1]
    low = [k for k in X.keypoints(blob(-1), X.Options(eigen=-1.0, reoriented=False)) if np.abs(np.array(k[:3]) - (16.8, 16.1, 16.6)).max() < 1]
    assert len(top) == len(low) == 1 and (top[0][6] ^ low[0][6]) == 16
    assert 3 < top[0][3] < 9


def test_frames_and_descriptors(spark, noise):
    p = X.unit_patch(X.blurred(np.random.default_rng(4).random((11, 11, 11)), 1.0))
    for f in X.frames(p):
        assert np.allclose(f @ f.T, np.eye(3)) and np.isclose(np.linalg.det(f), 1)
    d = X.descriptor(p)
    assert np.isclose(np.linalg.norm(d), 1) and d.min() == 0
    assert sorted(X.ranks(d)) == list(range(64))
    e, axes = X.tensor(p)
    assert (np.diff(e) <= 0).all() and np.allclose(axes @ axes.T, np.eye(3))
    pairs = np.random.default_rng(1).integers(0, 10, (64, 2, 3))
    pairs[:, 1, 0] = (pairs[:, 0, 0] + 3) % 10
    raw = X.pair_descriptor(p, pairs)
    assert (X.pair_descriptor(p, pairs, "sign") == (raw < 0)).all() and np.abs(X.pair_descriptor(p, pairs, "scaled")).max() <= np.abs(raw).max()


def test_extract_rows(spark):
    got = X.extract(frame(spark, blob(), "b1").unionByName(frame(spark, blob(-1), "b2")), X.Options(eigen=-1.0))
    rows = got.collect()
    assert {r.image_id for r in rows} == {"b1", "b2"} and all(sorted(r.pc) == list(range(64)) for r in rows)


def test_patches_equal_the_arrays(spark):
    from voxelweave.operators import patches as PT

    rng = np.random.default_rng(3)
    arrays = {f"p{i}": rng.random((11, 11, 11)) if i else np.zeros((11, 11, 11)) for i in range(4)}
    df = None
    for name, a in arrays.items():
        df = frame(spark, a, name) if df is None else df.unionByName(frame(spark, a, name))
    pc = {r.vol: np.array(r.pc) for r in PT.orientation_histogram(df).collect()}
    e = {r.vol: np.array(r.e) for r in PT.tensor_eigenvalues(df).collect()}
    for name, a in arrays.items():
        assert np.allclose(pc[name], X.descriptor(a)) and np.allclose(e[name], X.tensor(a)[0], atol=1e-9)


def test_sampled_patches_equal_the_arrays(spark):
    from voxelweave.operators import patches as PT

    rng = np.random.default_rng(4)
    a = rng.random((20, 24, 28))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    df = spark.createDataFrame([("v", 1, 14.2, 12.6, 10.1, 2.0, q.tolist()), ("v", 2, 2.0, 12.0, 10.0, 2.0, q.tolist())], "vol string, id int, fx double, fy double, fz double, scale double, ori array<array<double>>")
    got = PT.sampled(df, frame(spark, a, "v"), a.shape).collect()
    want = X.patch(a, np.array([14.2, 12.6, 10.1]), 2.0, q, "clamp")
    assert {r.vol for r in got} == {1} and X.patch(a, np.array([2.0, 12.0, 10.0]), 2.0, q, "clamp") is None
    assert len(got) == 1331 and all(np.isclose(r.v, want[r.z, r.y, r.x]) for r in got)


def test_doubled_arrays_equal_the_rows(spark):
    a = np.random.default_rng(5).random((3, 4, 5))
    v = a
    for axis in range(3):
        v = X.doubled(v, axis)
    got = {(r.z, r.y, r.x): r.v for r in VOL.double(frame(spark, a, "v"), a.shape).collect()}
    assert v.shape == (6, 8, 10) and all(np.isclose(got[i], v[i]) for i in np.ndindex(v.shape))


def test_extraction_options(spark):
    b = blob()
    at = lambda opt: [k for k in X.keypoints(b, opt) if np.abs(np.array(k[:3]) - (16.8, 16.1, 16.6)).max() < 1.5]
    plain = X.Options(eigen=-1.0, reoriented=False)
    # places and scales are in the given volume's voxels, whatever it was extracted from
    found = at(X.replace(plain, size=2.0))
    assert found and min(abs(k[3] - at(plain)[0][3]) for k in found) < 1.5
    z, y, x = np.mgrid[:48, :48, :48]
    big = np.exp(-((x - 24.3) ** 2 + (y - 23.6) ** 2 + (z - 24.1) ** 2) / 72)
    for size in (0.5, 1.0):
        near = [k[3] for k in X.keypoints(big, X.replace(plain, size=size)) if np.abs(np.array(k[:3]) - (24.8, 24.1, 24.6)).max() < 2]
        assert near and min(abs(s - 12) for s in near) < 4
    pairs = X.random_pairs(64, 1)
    assert len(set(pairs)) > 60 and X.random_pairs(64, 1) == pairs != X.random_pairs(64, 1, sigma=2.0)
    for how in ("raw", "sign", "scaled"):
        d = at(X.replace(plain, descriptor=how, pairs=pairs))
        assert d and sorted(d[0][7]) == list(range(64))
    for bad in ({"size": 3.0}, {"descriptor": "raw"}, {"pairs": pairs}, {"descriptor": "raw", "pairs": ((0, 0, 0, 0, 0, 0),)}):
        try:
            X.Options(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    df = frame(spark, b, "b")
    m = ((0.0, -2.0, 0.0, 5.0), (2.0, 0.0, 0.0, 0.0), (0.0, 0.0, 2.0, 1.0))
    own = sorted((r.feat_id, r.x, r.y, r.z, r.scale) for r in X.extract(df, plain).collect())
    out = {r.feat_id: r for r in X.extract(df, X.replace(plain, affine=m)).collect()}
    for i, x, y, z, s in own:
        assert np.allclose((out[i].x, out[i].y, out[i].z, out[i].scale), (-2 * y + 5, 2 * x, 2 * z + 1, 2 * s), atol=1e-3)
    # cubic voxels of spacing 1 from ones of 1 x 1 x 2: the world's places of a blob in the squeezed volume
    eye = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 2.0, 0]]
    world = X.extract_world(frame(spark, b[::2], "h"), b[::2].shape, (2.0, 1.0, 1.0), eye, plain).collect()
    assert min(np.abs(np.array((r.x, r.y, r.z)) - (16.8, 16.1, 16.6)).max() for r in world) < 1.5


def test_small_matrices(spark):
    from voxelweave.functions import linear as L
    from voxelweave.functions import vectors as V

    rng = np.random.default_rng(7)
    m4, s, wide = rng.normal(size=(4, 4)), rng.normal(size=(3, 3)), rng.normal(size=(2, 3))
    sym = s @ s.T
    rows = [(m4.tolist(), sym.tolist(), wide.tolist()), (np.zeros((4, 4)).tolist(), (2 * np.eye(3)).tolist(), None)]
    df = spark.createDataFrame(rows, "m array<array<double>>, s array<array<double>>, w array<array<double>>")
    e = lambda i, j: df["s"][i][j]
    got = df.select(V.invert4(df["m"]).alias("i"), V.eigenvalues3(e(0, 0), e(0, 1), e(0, 2), e(1, 1), e(1, 2), e(2, 2)).alias("e"), L.pinv(df["w"]).alias("p"), L.svd(df["w"]).alias("d")).collect()
    assert np.allclose(got[0].i, np.linalg.inv(m4)) and got[1].i is None
    assert np.allclose(got[0].e, np.linalg.eigvalsh(sym)[::-1]) and got[1].e == [2, 2, 2]
    assert np.allclose(got[0].p, np.linalg.pinv(wide)) and got[1].p is None
    assert np.allclose(np.array(got[0].d.u) @ np.diag(got[0].d.s) @ np.array(got[0].d.vt), wide)


def test_components_of_descriptors(spark):
    """The first components against numpy's, up to sign."""
    from voxelweave import catalog as C

    sf = "/root/testdata/sf0.001"
    x = {r.feat_id: list(r.pc) for r in C.descriptors(spark, sf).collect()}
    ids = sorted(x)
    a = np.array([x[i] for i in ids], float)
    u, s, vt = np.linalg.svd(a - a.mean(axis=0), full_matrices=False)
    got = {r.feat_id: list(r.c) for r in C.pca(spark, sf).collect()}
    g = np.array([got[i] for i in ids])
    assert np.allclose(np.abs(g), np.abs(a @ vt[:3].T), atol=1e-6)


def rows_of_features(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()), key=lambda r: (r[0], int(r[1])))


@pytest.mark.parametrize("opt", [X.Options(eigen=-1.0), X.Options(eigen=500.0, size=2.0, edge="zero")])
def test_tiles_give_the_features_of_the_whole(spark, opt):
    """Two volumes in bricks, one with halos wider than its bricks, against the whole arrays: equal bit by bit."""
    rng = np.random.default_rng(6)
    one, two = (X.blurred(rng.normal(size=s), 1.5) * 100 for s in ((40, 44, 37), (36, 41, 35)))
    one[:, :, :12] = 0  # bricks of zeros alone have no voxel row
    vols = frame(spark, one, "a").filter("v != 0").unionByName(frame(spark, two, "b"))
    whole = rows_of_features(X.extract(vols, opt))
    assert len({r[0] for r in whole}) == 2 and len(whole) >= 8
    assert rows_of_features(X.extract_tiles(vols, opt, side=16)) == whole
    if opt.size == 1.0:
        # one volume whole, the other in bricks
        assert rows_of_features(X.extract(vols, opt, whole=55_000, side=16)) == whole
        assert X.extract_tiles(vols.limit(0), opt).collect() == []


def test_bricks_equal_arrays(spark, noise):
    side, df = 4, frame(spark, noise)
    kernel = [(-2, 0.1), (-1, 0.2), (0, 0.4), (1, 0.2), (2, 0.1)]
    want = noise
    for axis in (2, 1, 0):
        want = BR.along(want, kernel, axis)
    b = BR.pack(df, side)
    assert (dense(BR.unpack(b, side), noise.shape) == noise).all()
    assert (dense(BR.unpack(BR.blur(b, side, kernel), side), noise.shape) == want).all()
    holes = BR.pack(df.filter("x != 4"), side, float("nan"))
    assert (dense(BR.unpack(BR.blur(holes, side, kernel), side), noise.shape) == dense(BR.unpack(BR.blur(BR.pack(df.withColumn("v", F.when(F.col("x") == 4, 0.0).otherwise(F.col("v"))), side), side, kernel), side), noise.shape)).all()
    assert BR.unpack(holes, side).count() == noise.size - 35 and BR.unpack(holes, side, absent=True).count() == noise.size
    half = X.pooled(noise)
    assert (dense(BR.unpack(BR.pool(b, side), side), half.shape) == half).all()
    twice = noise
    for axis in range(3):
        twice = X.doubled(twice, axis)
    assert (dense(BR.unpack(BR.double(b, side), 2 * side), twice.shape) == twice).all()
    levels = BR.pack(df.withColumn("level", F.lit(0)).unionByName(VOL.blur(df, None, noise.shape, kernel).withColumn("level", F.lit(1))), side)
    got = BR.unpack(BR.differences(levels, side), side)
    assert np.allclose(dense(got, noise.shape), noise - want) and {r.level for r in got.collect()} == {0}


def test_extrema_of_bricks_equal_the_joins(spark, noise):
    """With a missing voxel, whose neighbours are no extrema; levels beside each other; in the slice alone."""
    df = frame(spark, noise).filter("not (z = 2 and y = 3 and x = 3)")
    other = frame(spark, noise * 0.5 + 0.01)
    pick = lambda d: sorted(tuple(r) for r in d.select("z", "y", "x", "v", "polarity").collect())
    b = BR.pack(df, 4, float("nan"))
    assert pick(BR.extrema(b, 4)) == pick(VOL.extrema(df)) != []
    both = BR.pack(df.withColumn("level", F.lit(0)).unionByName(other.withColumn("level", F.lit(1))), 4, float("nan"))
    assert pick(BR.extrema(both, 4, 0, (1,))) == pick(VOL.extrema(df, other))
    flat = frame(spark, np.pad(noise[:1], ((1, 1), (0, 0), (0, 0))))
    assert pick(BR.extrema(BR.pack(flat, 4, float("nan")), 4, flat=True).filter("z = 1")) == pick(VOL.extrema(flat, flat=True).filter("z = 1"))
    places = {(r.z, r.y, r.x): (r.fx, r.fy, r.fz) for r in VOL.refine(VOL.extrema(df), df).collect()}
    got = BR.extrema(b, 4)
    for r in got.collect():
        if (r.z, r.y, r.x) in places:
            fx, fy, fz = places[r.z, r.y, r.x]
            assert np.allclose([X.vertex((c - 1, c, c + 1), (p, r.v, n)) + 0.5 for c, p, n in ((r.x, r.x0, r.x2), (r.y, r.y0, r.y2), (r.z, r.z0, r.z2))], [fx, fy, fz])
