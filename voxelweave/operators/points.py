"""Located values (x, y, z, v): filters, order, suppression and set operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.stage import written


def in_range(pts: DataFrame, axis: str, low: int, high: int) -> DataFrame:
    return pts.filter(F.col(axis).between(low, high))


def at_least(pts: DataFrame, value: float) -> DataFrame:
    return pts.filter(F.abs("v") >= value)


def dist2(x: Column | int, y: Column | int, z: Column | int) -> Column:
    return (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + (F.col("z") - z) * (F.col("z") - z)


def within(pts: DataFrame, centre: tuple[int, int, int], radius: int) -> DataFrame:
    return pts.filter(dist2(*centre) <= radius * radius)


def outside(pts: DataFrame, centre: tuple[int, int, int], radius: int) -> DataFrame:
    return pts.filter(dist2(*centre) >= radius * radius)


def different(pts: DataFrame, fixed: DataFrame, shift: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Points that are none of the fixed ones, these moved by a shift."""
    f = fixed.select(*[(F.col(c) + d).alias(c) for c, d in zip("xyz", shift, strict=True)])
    return pts.join(f, ["x", "y", "z"], "left_anti")


def index_of(pts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with the first seq of an equal point, or -1."""
    first = pts.groupBy("x", "y", "z").agg(F.min("seq").alias("index"))
    return wanted.join(first, ["x", "y", "z"], "left").withColumn("index", F.coalesce("index", F.lit(-1)))


def first_per_xy(pts: DataFrame) -> DataFrame:
    """The point with the least seq of each (x, y)."""
    return pts.groupBy("x", "y").agg(F.min(F.struct("seq", "z", "v")).alias("p")).select("x", "y", "p.z", "p.v", "p.seq")


def by_value(pts: DataFrame, descending: bool = True) -> DataFrame:
    return pts.orderBy(F.col("v").desc() if descending else F.col("v"), "z", "y", "x")


def shuffled(pts: DataFrame, seed: int = 0) -> DataFrame:
    """In an order of hashes: random, and the same in every run."""
    return pts.orderBy(F.xxhash64("x", "y", "z", F.lit(seed)), "x", "y", "z")


def top_share(pts: DataFrame, group: list[str], share: float, most: int) -> DataFrame:
    """Points of a value of at least share times their group's largest, the first `most` of them."""
    top = pts.groupBy(*group).agg(F.max("v").alias("__top"))
    some = pts.join(top, group).filter(F.col("v") >= share * F.col("__top")).drop("__top")
    w = Window.partitionBy(*group).orderBy(F.desc("v"), "z", "y", "x")
    return some.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def suppress(pts: DataFrame, group: str, least: int, order: tuple[str, ...], whole: int = 200_000) -> DataFrame:
    """Greedy: in order, a point of a group stays if no point that stayed is nearer than `least`. (x, y, z) are whole
    numbers; order names columns, "-v" for descending. Of points at one place the first counts, equal rows as one.
    A null group is a group like others.

    A group of at most `whole` places is a fold in one task. Larger ones take rounds, in which no task needs a group: a
    point stays if all earlier points near it have gone, and goes if an earlier one near it stays. Near points are in
    the same or a touching cell of side `least`, an equi-join; there are as many rounds as the longest chain of points
    that decide each other, each written to the shared folder.
    """
    by = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in order]
    w = Window.partitionBy(group, "x", "y", "z").orderBy(*by)
    first = pts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    sizes = first.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__size"))
    large = sizes.filter(F.col("__size") > whole).select("__g")
    of = F.col(group).eqNullSafe(F.col("__g"))
    if large.isEmpty():
        return _folded(first, group, least, order)
    small = _folded(first.join(large, of, "left_anti"), group, least, order)
    return small.unionByName(_rounds(first.join(large, of, "left_semi"), group, least, order))


def _folded(pts: DataFrame, group: str, least: int, order: tuple[str, ...]) -> DataFrame:
    names, up = [c.lstrip("-") for c in order], [c[0] != "-" for c in order]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, ascending=up, kind="stable")
        kept: list[int] = []
        cells: dict[tuple, list[int]] = {}
        at = pdf[["x", "y", "z"]].to_numpy()
        size = max(least, 1)
        for i, p in enumerate(at):
            c = tuple(p // size)
            near = (j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) for j in cells.get((c[0] + dx, c[1] + dy, c[2] + dz), ()))
            if all(((at[j] - p) ** 2).sum() >= least * least for j in near):
                kept.append(i)
                cells.setdefault(c, []).append(i)
        return pdf.iloc[kept]

    return pts.groupBy(group).applyInPandas(fold, pts.schema)


def _rounds(pts: DataFrame, group: str, least: int, order: tuple[str, ...]) -> DataFrame:
    size = max(least, 1)
    key = F.struct(F.col(group).alias("g"), "x", "y", "z").alias("p")
    cells = {c: F.floor(F.col(c) / size) for c in "xyz"}
    names = [c.lstrip("-") for c in order]
    one = pts.select(key, F.struct(*names).alias("o"), *[v.alias(f"c{c}") for c, v in cells.items()])
    two = one.select(F.col("p").alias("q"), F.col("o").alias("o2"), *[F.col(f"c{c}").alias(f"d{c}") for c in "xyz"])
    for c in "xyz":
        two = two.withColumn(f"d{c}", F.explode(F.array(*[F.col(f"d{c}") + i for i in (-1, 0, 1)])))
    near = sum(((F.col(f"p.{c}") - F.col(f"q.{c}")) * (F.col(f"p.{c}") - F.col(f"q.{c}")) for c in "yz"), (F.col("p.x") - F.col("q.x")) * (F.col("p.x") - F.col("q.x"))) < least * least
    earlier, same = F.lit(False), F.lit(True)
    for c, n in zip(order, names, strict=True):
        a, b = F.col(f"o2.{n}"), F.col(f"o.{n}")
        earlier = earlier | (same & ((a > b) if c[0] == "-" else (a < b)))
        same = same & (a == b)
    on = F.col("p.g").eqNullSafe(F.col("q.g")) & (F.col("cx") == F.col("dx")) & (F.col("cy") == F.col("dy")) & (F.col("cz") == F.col("dz")) & near & earlier
    edges = written(one.join(two, on).select("p", "q"), "edges")
    todo, kept = written(one.select("p"), "todo"), None
    while todo.count():
        stay = written(todo.join(edges.select("p").distinct(), "p", "left_anti"), "stay")
        kept = stay if kept is None else kept.unionByName(stay)
        gone = edges.join(stay.select(F.col("p").alias("q")), "q", "left_semi").select("p").distinct()
        out = written(stay.unionByName(gone), "out")
        todo = written(todo.join(out, "p", "left_anti"), "todo")
        edges = written(edges.join(out, "p", "left_anti").join(out.select(F.col("p").alias("q")), "q", "left_anti"), "edges")
    if kept is None:
        return pts
    at = F.struct(F.col(group).alias("g"), "x", "y", "z")
    return pts.join(kept.select(F.col("p").alias("__p")), at == F.col("__p"), "left_semi")


def visit(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn over batches of rows: the per-voxel visitor, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)
