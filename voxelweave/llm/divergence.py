"""Source divergence: how the term shares of each language's sources differ from each other and from the language's."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.llm.common import UPPER, spill

#: All bytes but ASCII letters and those of longer characters separate terms; A-Z are lower-cased.
_FOLD = bytes(b | 0x20 if chr(b) in UPPER else b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
#: A share is in billionths.
UNIT = 1_000_000_000
#: Terms that a task holds before it gives its counts out, and their bytes.
ENTRIES, BYTES = 200_000, 64 << 20
#: Cells of a dense tile, and of one step of all its pairs.
CELLS = 1 << 21
#: Parts of a language's terms that the number of its blocks is joined to, so that no language is one task's.
SALTS = 64


def term_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of data in blocks of about size bytes, each cut between terms."""
    at, end = 0, len(data)
    while at < end:
        part = data[at : at + size].translate(_FOLD)
        at += len(part)
        while at < end and part[-1] != 0x20:  # the term goes on
            more = data[at : at + size].translate(_FOLD)
            cut = more.find(b" ") + 1
            part += more[:cut] if cut else more
            at += cut or len(more)
        yield part.split()


def term_counts(texts: DataFrame, most: int = ENTRIES, most_bytes: int = BYTES) -> DataFrame:
    """(lang, source, term, n, docs) from (lang, source, text binary): occurrences, and rows that hold the term.

    Each task sums over its rows before anything is shuffled, and gives out what it holds whenever that reaches a bound,
    so a term may have several rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                cols = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in term_blocks(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                entries, size = entries + len(n) - before, size + sum(map(len, seen))
                if entries >= most or size >= most_bytes:
                    yield from out()
                    held, entries, size = {}, 0, 0
        yield from out()

    found = texts.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.withColumn("term", F.col("term").cast("string"))


def shares(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT (n + 1) / total) in int64, exact for totals below 2^63 / 1000: long division, three digits a step."""
    out, left = np.divmod(n + 1, total)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, total)
        out = out * 1000 + digit
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are UNIT + 1 at most, so the square fits."""
    d = p - q
    return d * d // q


def pair_matrix(p: np.ndarray) -> np.ndarray:
    """[groups, groups]: the gaps of p [groups, terms] of each row against each, summed over the terms."""
    groups, terms = p.shape
    out, step = np.zeros((groups, groups), np.int64), max(1, CELLS // max(groups * terms, 1))
    for i in range(0, groups, step):
        out[i : i + step] = gap(p[i : i + step, None, :], p[None, :, :]).sum(axis=2)
    return out


def _tile(top: int):
    """The cogrouped function of one (lang, block): pair sums over its terms, and each group's `top` terms in it."""

    def run(key: tuple[pa.Scalar, ...], terms: pa.Table, totals: pa.Table) -> pa.Table:
        groups = sorted(totals.column("groups")[0].as_py(), key=lambda g: g["source"])
        names, size = [g["source"] for g in groups], np.array([g["n"] for g in groups], np.int64)
        kept = totals.column("kept")[0].as_py()
        terms = terms.combine_chunks().sort_by("term") if terms.num_rows else terms
        tile = np.zeros((len(names), terms.num_rows), np.int64)
        cells = terms.column("cells").combine_chunks()
        if terms.num_rows:
            at = np.repeat(np.arange(terms.num_rows), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
            who = pc.index_in(cells.flatten().field("source"), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
            tile[who, at] = cells.flatten().field("n").to_numpy(zero_copy_only=False)
        word = terms.column("term").to_pylist()
        p = shares(tile, np.maximum(size + kept, 1)[:, None])
        q = shares(tile.sum(axis=0), max(int(size.sum()) + kept, 1))
        pairs = pair_matrix(p)
        rows: list[tuple[str, str, str, int]] = [(a, "pair", b, int(pairs[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
        for i, a in enumerate(names):
            own = np.flatnonzero((tile[i] > 0) & (p[i] > q))
            value = gap(p[i, own], q[own])
            # terms are in order, so that a stable sort leaves ties so
            for j in np.argsort(-value, kind="stable")[:top]:
                rows.append((a, "term", word[own[j]], int(value[j])))
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        lang = pa.array([key[0].as_py()] * len(rows), pa.string())
        return pa.table([lang, *[pa.array(c, pa.string()) for c in cols[:3]], pa.array(cols[3], pa.int64())], names=["lang", "source", "part", "item", "value"])

    return run


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 3, top: int = 200, width: int = 512) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each occurring (lang, source) group apart.

    Nulls are ''. Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those
    in `least` of its rows or more (a repeated row counts again). The share p of a kept term in a group is
    1 + floor(10^9 (n + 1) / (N + V)); the gap of p and q is floor((p - q)^2 / q). Part `pair`: for each other source of
    the language, the gaps to its shares, summed over all kept terms (0 if none are kept). Part `term`: terms of the
    group with a larger share than in the whole language, by that gap, `top` of them. Ranks are from 1, larger values
    first, ties by item in UTF-8 order. Empty table: empty result; further columns of docs play no part.

    Counts are summed in each task, then by key. A language's kept terms are dealt to blocks of about `width` (fewer with
    many sources, so that a tile's cells stay bounded until a language has 2^17 sources). A block is a dense tile of
    groups by terms, and gives a partial matrix of all pairs and a heap of each group's best terms; these are summed and
    merged by Spark. All arithmetic is in integers: exact up to 2^63 / 1000 occurrences a language and 10^9 kept terms.
    """
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    x = docs.select(none(lang).alias("lang"), none(source).alias("source"), none(text).cast("binary").alias("text"))
    counts = term_counts(x).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    kept = spill(kept.filter(F.col("docs") >= least).select("lang", "term", "cells"), "kept-terms")

    groups = x.select("lang", "source").distinct()
    sizes = kept.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = groups.join(sizes, ["lang", "source"], "left").groupBy("lang").agg(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n"))).alias("groups"))
    totals = totals.join(vocabulary, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    wide = F.least(F.lit(width), F.greatest(F.lit(16), F.floor(F.lit(CELLS) / F.size("groups"))))
    totals = spill(totals.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / wide))), "totals")

    salted = totals.select("lang", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    h = F.xxhash64("term")
    dealt = kept.withColumn("salt", F.pmod(h, F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    # the salt takes the low bits
    dealt = dealt.select("lang", F.pmod(F.shiftright(h, 8), F.col("blocks")).alias("block"), "term", "cells")
    each = totals.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "groups", "kept")
    tiles = dealt.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInArrow(_tile(top), "lang string, source string, part string, item string, value long")
    tiles = spill(tiles, "tiles")

    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = tiles.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(w))
    # of each group no more than `top` rows leave a task
    best = tiles.filter("part = 'term'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return pairs.unionByName(best)
