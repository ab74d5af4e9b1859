"""Mixing sources to target weights: whole copies first, then a Pareto order sample for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.llm.common import WS, ranked, spill

BINS = 1 << 10
SALTS = 64


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null.

    Every word becomes one letter: a list of the words, as regexp_count makes, would fill the heap for a long text.
    """
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), WS, "")
    return F.coalesce(F.char_length(marks), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources by code point, null last, get the weights in turn. Together they take share times all sizes; a target
    stops at most times its source's size and the excess is dealt to the others by weight until none is above.
    The limit a target may reach is a level times its weight; each pass adds the sources that the level caps and
    raises it, so only sums of the source table come to the driver. If share is above most, all targets stop.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    src = ranked(src, [], [F.col("source").asc_nulls_last()], "rank")
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = spill(src.select("source", "source_size", "docs", weigh.alias("weight")), "sources")
    cap = F.col("source_size") * float(most)
    total = (src.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, seen = 0.0, None
    while True:
        held = cap <= F.col("weight") * level
        r = src.agg(F.coalesce(F.sum(F.when(held, cap)), F.lit(0.0)).alias("kept"), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)).alias("open"), F.count(F.when(held, 1)).alias("n")).first()
        if r["n"] == seen or not r["open"]:
            break
        level, seen = (total - r["kept"]) / r["open"], r["n"]
    return src.withColumn("target", F.least(cap, F.col("weight") * level) if level else cap * 0.0)


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from md5 of seed and key; the same in every run. A null key counts as the empty text."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 52))


def digits(size: Column) -> Column:
    """Binary digits of a size, 0 for none: a document's inclusion weight."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")


def inclusion(x: DataFrame, src: DataFrame) -> DataFrame:
    """src (s, ..., lack) with the inclusion probabilities of its documents: 1 for more than `most_digits` binary
    digits, `scale` times their digits for others; and `open_lack`, what the source lacks beside the certain ones.

    Probabilities in proportion to the digits, 1 at most, of which the expected words are the lack. Digits are few, so
    a source has 63 rows here at most, and integer sums, the same in any order.
    """
    grades = x.filter("digits > 0").groupBy("source", "digits").agg(F.sum("size").alias("words"))
    down = Window.partitionBy("source").orderBy(F.desc("digits")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("source").orderBy("digits").rowsBetween(Window.unboundedPreceding, 0)
    g = grades.select("source", "digits", F.coalesce(F.sum("words").over(down), F.lit(0)).alias("certain"), F.sum(F.col("words") * F.col("digits")).over(below).alias("open"))
    g = g.join(src.select("s", "lack"), F.col("source").eqNullSafe(F.col("s")))
    g = g.withColumn("open_lack", F.col("lack") - F.col("certain")).withColumn("scale", F.col("open_lack") / F.col("open").cast("double"))
    best = g.filter(F.col("scale") * F.col("digits") <= 1).groupBy(F.col("s").alias("gs")).agg(F.max(F.struct("digits", "scale", "open_lack")).alias("b"))
    none = F.struct(F.lit(0).cast("long").alias("digits"), F.lit(0.0).alias("scale"), F.lit(0.0).alias("open_lack"))
    j = src.join(best, F.col("s").eqNullSafe(F.col("gs")), "left").withColumn("b", F.coalesce("b", none))
    return j.select(*src.columns, F.col("b.digits").alias("most_digits"), "b.scale", "b.open_lack")


def _cut(q: DataFrame, src: DataFrame, col: str, before: str) -> DataFrame:
    """src (s, open_lack, and `before`: words ranked before these bins) with the bin in which the lack is reached, and the
    words before that, as `col` and `before`; null if it is not reached. A source has BINS rows in the window."""
    w = Window.partitionBy("source").orderBy(col)
    sums = q.groupBy("source", col).agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(w)).join(src, F.col("source").eqNullSafe(F.col("s")))
    sums = sums.withColumn("upto", F.col("upto") + F.col(before)).withColumn("start", F.col("upto") - F.col("words"))
    hit = sums.filter("start <= open_lack and upto > open_lack").groupBy(F.col("s").alias("cs")).agg(F.min(F.struct(col, "start")).alias("c"))
    out = src.join(hit, F.col("s").eqNullSafe(F.col("cs")), "left")
    return out.select(*[c for c in src.columns if c != before], F.col(f"c.{col}").alias(f"cut_{col}"), F.col("c.start").alias(before))


def _nearest_to_lack(inside: DataFrame) -> DataFrame:
    """Rows of the bin that holds a source's cut, with `more`: 1 for those whose words bring the sum nearer to the lack.

    Rows with one number, id and size are interchangeable: the window of a source goes over their counts, a row for each
    of the SALTS parts of them. Of at most one such part of a source some rows are taken and others not.
    """
    key = ["source", "q", "doc_id", "size", "salt"]
    order = Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_last(), "size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = inside.groupBy(*key).agg(F.count("*").alias("rows"), F.first("before").alias("before"), F.first("open_lack").alias("open_lack"))
    parts = parts.withColumn("base", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0)))
    nearer = lambda n: f"abs(base + size * {n} - open_lack) < abs(base + size * ({n} - 1) - open_lack)"
    parts = parts.withColumn("all", F.expr(nearer("rows"))).withColumn("any", F.expr(nearer("1")))
    parts = parts.select(*[F.col(c).alias(f"p_{c}") for c in key], "base", "all", "any")
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    met = inside.join(parts, on).drop(*[f"p_{c}" for c in key])
    some = F.col("any") & ~F.col("all")
    split = ranked(met.filter(some), key, [], "n").withColumn("more", F.expr(nearer("(n + 1)")).cast("int")).drop("n")
    return met.filter(~some).withColumn("more", F.col("all").cast("int")).unionByName(split)


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs.

    A source's rate is its target over its size. Every document gets the whole part of the rate as certain copies, and
    the words that the source still lacks are a Pareto order sample of its documents. Inclusion probabilities p are in
    proportion to the number of binary digits of a document's size, so longer texts come sooner; documents for which
    that is 1 or more are one certain copy more. The others are ranked by their random odds over their inclusion
    odds, (u / (1 - u)) / (p / (1 - p)), u from the document's id, and the first ones are taken, as many as come nearest
    to the lack (fewer, at a tie): the sample has a fixed size in words, and misses the target by half a document at
    most. No document exceeds `most` (rounded up) times its size.

    The cut is found without sorting a source: sums per source and bin of the ranking number give the bin that holds
    it, sums per bin inside that bin the next, and only that one's documents, one in BINS^2 or so, are ordered. Null
    source: a source of its own, last. Null id: as the empty text, so that all of them with as many digits share one
    ranking number and go by size. Rows with no words, however long the text: size 0, taken 0. Repeated rows count each;
    equal ones are ranked side by side, and are ordered as one row with their number, however many they are. Empty
    table: empty result.
    """
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), uniform(F.col(id_col), seed).alias("u"))
    # equal rows may be very many: SALTS parts of them are told apart
    x = x.withColumn("digits", digits(F.col("size"))).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    x = spill(x, "sizes")
    src = targets(x, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    src = src.withColumn("whole", F.floor(rate)).withColumn("lack", F.col("target") - F.col("whole") * F.col("source_size"))
    src = spill(src.select(F.col("source").alias("s"), "source_size", "target", "whole", "lack"), "targets")
    src = spill(inclusion(x, src).withColumn("before", F.lit(0).cast("long")), "inclusion")
    # the ranking number q in 0..inf, and the same as a place from 0 to 1
    p = F.col("scale") * F.col("digits")
    q = (F.col("u") / (1 - F.col("u"))) * F.try_divide(1 - p, p)
    open_ = (F.col("digits") > 0) & (F.col("digits") <= F.col("most_digits")) & (F.col("scale") > 0)

    def ranked_rows(src: DataFrame) -> DataFrame:
        j = x.join(src, F.col("source").eqNullSafe(F.col("s"))).withColumn("q", F.when(open_, q))
        at = F.col("q") / (1 + F.col("q")) * BINS
        return j.withColumn("bin", F.floor(at).cast("int")).withColumn("fine", F.floor((at - F.floor(at)) * BINS).cast("int"))

    narrow = ["source", "size", "bin"]
    src = spill(_cut(ranked_rows(src).filter("q is not null").select(*narrow), src, "bin", "before"), "bins")
    inner = ranked_rows(src).filter("bin = cut_bin").select("source", "size", "fine")
    src = spill(_cut(inner, src, "fine", "before"), "cuts")
    j = ranked_rows(src)
    here = F.coalesce((F.col("bin") == F.col("cut_bin")) & (F.col("fine") == F.col("cut_fine")), F.lit(False))
    inside = _nearest_to_lack(j.filter(here))
    early = F.expr("q is not null and (cut_bin is null or bin < cut_bin or (bin = cut_bin and fine < cut_fine))")
    rest = j.filter(~here).withColumn("more", (early | ((F.col("digits") > F.col("most_digits")) & (F.col("lack") > 0))).cast("int"))
    cols = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more")).cast("int").alias("copies")]
    both = rest.select(*cols).unionByName(inside.select(*cols))
    return both.withColumn("taken", F.col("size") * F.col("copies"))
