"""Vector and matrix arithmetic over array columns, all in built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def dist2(a: Column, b: Column, n: int | None = None) -> Column:
    """Squared distance over the first n components, all if not given."""
    if n is not None:
        a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length; (1, 0, 0) for the zero vector."""
    n = magnitude(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mat_vec(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: dot(row, v))


def transpose(m: Column, n: int = 3) -> Column:
    return F.array(*[F.array(*[m[i][j] for i in range(n)]) for j in range(n)])


def mat_mul(a: Column, b: Column, n: int = 3) -> Column:
    return F.array(*[F.array(*[sum((a[i][k] * b[k][j] for k in range(1, n)), a[i][0] * b[0][j]) for j in range(n)]) for i in range(n)])


def det3(m: Column) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def invert3(m: Column) -> Column:
    """The inverse of a 3x3 matrix by cofactors; null if its determinant is 0."""
    d = det3(m)
    cof = F.array(cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1]))
    return F.when(d != 0, F.transform(transpose(cof), lambda r: F.transform(r, lambda x: x / d)))


def invert4(m: Column) -> Column:
    """The inverse of a 4x4 matrix, by the 2x2 minors of its upper and lower halves; null if its determinant is 0."""
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    minor = lambda a, b: {p: m[a][p[0]] * m[b][p[1]] - m[a][p[1]] * m[b][p[0]] for p in pairs}
    parts = F.struct(*[v.alias(f"{h}{i}{j}") for h, rows in (("u", (0, 1)), ("l", (2, 3))) for (i, j), v in minor(*rows).items()])

    def made(s: Column) -> Column:
        u, low = ({p: s[f"{h}{p[0]}{p[1]}"] for p in pairs} for h in "ul")
        sign = {p: -1.0 if sum(p) % 2 == 0 else 1.0 for p in pairs}
        rest = lambda p: tuple(k for k in range(4) if k not in p)
        det = sum((u[p] * low[rest(p)] * sign[p] for p in pairs[1:]), u[pairs[0]] * low[rest(pairs[0])] * sign[pairs[0]])

        def cofactor(r: int, c: int) -> Column:
            """Of the row and column left out: the other row of the same half, times the other half's minors."""
            same, half = m[r ^ 1], (low if r < 2 else u)
            cols = [k for k in range(4) if k != c]
            terms = [same[cols[0]] * half[(cols[1], cols[2])], -same[cols[1]] * half[(cols[0], cols[2])], same[cols[2]] * half[(cols[0], cols[1])]]
            # rows in order: for the lower half the minor's two rows come before the single one, which changes no sign
            v = terms[0] + terms[1] + terms[2]
            return v if (r + c) % 2 == 0 else -v

        inverse = F.array(*[F.array(*[F.try_divide(cofactor(r, c), det) for r in range(4)]) for c in range(4)])
        return F.when(det != 0, inverse)

    return F.transform(F.array(parts), made)[0]


def eigenvalues3(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """The eigenvalues of a symmetric 3x3 matrix, the largest first, by the trigonometric solution of its cubic."""
    mean = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    parts = F.struct(mean.alias("m"), F.sqrt(((xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean) + 2 * off) / 6).alias("p"))

    def made(s: Column) -> Column:
        a, b, c = xx - s["m"], yy - s["m"], zz - s["m"]
        det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
        half = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det, 2 * s["p"] * s["p"] * s["p"])))
        angle = F.acos(half) / 3
        first, last = s["m"] + 2 * s["p"] * F.cos(angle), s["m"] + 2 * s["p"] * F.cos(angle + 2 * math.pi / 3)
        return F.when(s["p"] == 0, F.array(s["m"], s["m"], s["m"])).otherwise(F.array(first, 3 * s["m"] - first - last, last))

    return F.transform(F.array(parts), made)[0]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def outer(a: Column, b: Column) -> Column:
    """All products, b's index running fastest."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x.cast("double") * y.cast("double"))))


def picked(a: Column, places: list[int]) -> Column:
    """The components at these places, in this order."""
    return F.array(*[a[i] for i in places])


def steps(a: Column) -> Column:
    """Each component less the next one: one shorter than a."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n), lambda x, y: x - y)


def index_at(x: Column, y: Column, z: Column, nx: int, ny: int) -> Column:
    """A voxel's place in an array whose x runs fastest."""
    return x + nx * (y + ny * z)


def place_of(index: Column, nx: int, ny: int) -> list[Column]:
    """x, y, z of a place in such an array."""
    row = F.floor(index / nx)
    return [index % nx, row % ny, F.floor(row / ny)]


def positive_unit(a: Column) -> Column:
    """Shifted to a least component of 0, then to length 1; a constant vector becomes zeros."""
    lifted = F.transform(a, lambda x: x.cast("double") - F.array_min(a).cast("double"))
    n = magnitude(lifted)
    return F.transform(lifted, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def ranks(a: Column) -> Column:
    """Each component's rank from 0, equal ones in order of place."""
    order = F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))
    placed = F.transform(order, lambda s, r: F.struct(s["i"].alias("i"), r.alias("r")))
    return F.transform(F.array_sort(placed), lambda s: s["r"])


def parabola(x0: Column, x1: Column, x2: Column, f0: Column, f1: Column, f2: Column) -> Column:
    """The vertex of the parabola through three points if the middle is a strict extremum, else x1."""
    a = (f1 - f0) / (x1 - x0)
    b = ((f2 - f1) / (x2 - x1) - a) / (x2 - x0)
    peak = ((f1 > f0) & (f1 > f2)) | ((f1 < f0) & (f1 < f2))
    return F.when(peak, F.try_divide(b * (x0 + x1) - a, 2 * b)).otherwise(x1)


def spherical(mag: Column, zenith: Column, azimuth: Column) -> list[Column]:
    """Whole Cartesian coordinates, cut towards 0."""
    return [(mag * F.sin(zenith) * F.cos(azimuth)).cast("int"), (mag * F.sin(zenith) * F.sin(azimuth)).cast("int"), (mag * F.cos(zenith)).cast("int")]


def cell_weight(x: Column, size: int) -> tuple[Column, Column]:
    """(cell, weight of it) for linear interpolation between samples at .5, .5 + 1, ...; edges are held."""
    low, high = x < 0.5, x >= size - 0.5
    cell = F.when(low, 0).when(high, max(size - 2, 0)).otherwise(F.floor(x - 0.5))
    return cell.cast("int"), F.when(low, 1.0).when(high, 0.0 if size > 1 else 1.0).otherwise(1.0 - (x - 0.5 - F.floor(x - 0.5)))


def gaussian(sigma: float, least: float = 0.01) -> list[tuple[int, float]]:
    """(offset, weight) of a sampled Gaussian, of sum 1, wide enough for all but `least` of its mass."""
    tail = lambda i: math.exp(-i * i / (2 * sigma * sigma))
    every, i = 1.0, 1
    while tail(i) > 1e-5:
        every += 2 * tail(i)
        i += 1
    got, r = 1.0, 0
    while got <= (1 - least) * every:
        r += 1
        got += 2 * tail(r)
    return [(o, tail(o) / got) for o in range(-r, r + 1)]


def gaussian_2d(shape: tuple[int, int], sigma: tuple[float, float], mean: tuple[float, float] | None = None, theta: float = 0.0, along: float | None = None) -> list[tuple[int, int, float]]:
    """(row, column, weight) of a 2-D Gaussian density, turned by theta, around the middle if no mean is given.

    along: its central difference over one sample to each side, in this direction. Sigmas and means go row, column.
    """
    r0, c0 = mean or ((shape[0] - 1) / 2, (shape[1] - 1) / 2)

    def density(r: float, c: float) -> float:
        across, on = r * math.cos(theta) - c * math.sin(theta), r * math.sin(theta) + c * math.cos(theta)
        return math.exp(-((across / sigma[0]) ** 2 + (on / sigma[1]) ** 2) / 2) / (2 * math.pi * sigma[0] * sigma[1])

    def weight(r: float, c: float) -> float:
        if along is None:
            return density(r, c)
        dr, dc = math.sin(along), math.cos(along)
        return density(r + dr, c + dc) - density(r - dr, c - dc)

    return [(i, j, weight(i - r0, j - c0)) for i in range(shape[0]) for j in range(shape[1])]
