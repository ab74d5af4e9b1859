"""Exact dedup and source divergence against brute force, and their defined results for odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import digests, divergence
from voxelweave.llm.common import fresh_path

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


# ------------------------------------------------------------------------------------------------------- exact dedup


def brute_groups(rows):
    """[(id, keep_id, group_size)]; in each group one row stays."""
    by = defaultdict(list)
    for i, t in rows:
        by[lower(t)].append(i)
    low = float("-inf")
    keep = {t: max(ids, key=lambda i: low if i is None else i) for t, ids in by.items()}
    return sorted(((i, keep[lower(t)], len(by[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows), key=repr)


def deduplicated(spark, df, index=None, **kw):
    own = index or digests.DigestIndex(spark, fresh_path(spark, "test-index"), buckets=3)
    out = digests.exact_duplicates(df, own, **kw).collect()
    return out, sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in out), key=repr)


@pytest.mark.parametrize("batches", [1, 4])
def test_exact_dedup_equals_brute_force(spark, batches):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, got = deduplicated(spark, docs, batches=batches)
    assert got == brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert any(r.group_size > 1 for r in out)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    assert {r.source for r in out} and "lang" in out[0].__fields__


def test_exact_dedup_odd_rows(spark):
    long = "Wort " * 300_000
    rows = [(1, None), (2, ""), (3, " "), (None, "a\nB"), (4, "A\nb"), (4, "a\nb"), (4, "a\nb"), (None, "only null"), (None, "ONLY null"), (5, "É"), (6, "é"), (7, long), (8, long.upper()), (9, "x")]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, keep_id string, seq int")
    out, got = deduplicated(spark, df)
    assert got == brute_groups(rows)
    kept = Counter(bytes(r.digest) for r in out if r.kept)
    # one row of each text stays, also where ids are null or repeat
    assert set(kept.values()) == {1} and len(kept) == len({lower(t) for _, t in rows})
    assert out[0].seq == 7
    assert deduplicated(spark, df.limit(0))[0] == []


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    out, got = deduplicated(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_groups(rows) and sum(r.kept for r in out) == 2001


def test_digest_index_is_opened_by_its_path(spark):
    """A later session's rows are held against what an earlier one added; a run that is repeated changes nothing."""
    path = fresh_path(spark, "test-index")
    first = spark.createDataFrame([(10, "a"), (11, "b"), (12, "B")], "doc_id long, text string")
    index = digests.DigestIndex(spark, path, buckets=5)
    deduplicated(spark, first, index)
    index.close()
    again = digests.DigestIndex(spark, path)
    assert again.buckets == 5 and again.rows().count() == 2
    out, _ = deduplicated(spark, first, again)
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in out) == [(10, 10, True), (11, 12, False), (12, 12, True)]
    out, _ = deduplicated(spark, spark.createDataFrame([(1, "A"), (20, "b"), (21, "c")], "doc_id long, text string"), again)
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in out) == [(1, 10, False), (20, 12, False), (21, 21, True)]
    assert again.rows().count() == 3


def test_the_index_is_not_shuffled_again(spark):
    index = digests.DigestIndex(spark, fresh_path(spark, "test-index"), buckets=4)
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    deduplicated(spark, df, index)
    known = index.rows().withColumnRenamed("digest", "known").hint("merge")
    new = df.select(digests.digest_of(F.col("text")).alias("digest")).repartition(4, "digest")
    plan = new.join(known, F.col("digest") == F.col("known"), "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text


# ------------------------------------------------------------------------------------------------------- divergence


def brute_divergence(rows, least=3, top=200):
    """rows: (lang, source, text)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall(lower(text))
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted((t for t, c in docs[lang].items() if c >= least), key=lambda t: t.encode())
        sources = sorted({r[1] for r in rows if r[0] == lang})

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        q = shares(sum((n[lang, s] for s in sources), Counter()))
        p = {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(items)]
    return sorted(out)


def diverged(df, **kw):
    return sorted(tuple(r) for r in divergence.divergence(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("width", [512, 16])
def test_divergence_equals_brute_force(spark, width):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = diverged(docs, width=width)
    assert got == brute_divergence([(r.lang, r.source, r.text) for r in docs.collect()])
    assert {r[2] for r in got} == {"pair", "term"}


def test_divergence_takes_the_first_terms(spark):
    """More terms than are asked for, many of one value: the first in UTF-8 order, over several tiles."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["￮", "\U00010400", "zz"]
    rows = [("en", s, " ".join(words)) for s in "abb"] + [("en", "c", "other " * 50)] + [("en", "a", "other")] * 3
    got = diverged(spark.createDataFrame(rows, "lang string, source string, text string"), top=20, width=16)
    assert got == brute_divergence(rows, top=20)
    assert sum(r[2] == "term" and r[1] == "b" for r in got) == 20


def test_divergence_odd_rows(spark):
    rows = [(None, None, None), (None, "s", ""), ("", "", "one One ONE"), ("en", None, "É é é x1y2"), ("en", "s", "é X-y é"), ("en", "s", "é X-y é"), ("en", "t", "1234 _ @"), ("de", "s", "wort " * 400_000 + "a" * 2_000_000), ("de", "s", "Wort"), ("de", "t", "wort\x00wort"), ("fr", "s", "un"), ("fr", "t", "deux")]
    df = spark.createDataFrame([(*r, 3, "clash") for r in rows], "lang string, source string, text string, n int, rank string")
    got = diverged(df)
    assert got == brute_divergence(rows)
    # no term of this language is in three rows: all gaps are 0
    assert [r for r in got if r[0] == "fr"] == [("fr", "s", "pair", "t", 0, 1), ("fr", "t", "pair", "s", 0, 1)]
    assert diverged(df.limit(0)) == []


def test_terms_do_not_depend_on_blocks_or_bounds(spark):
    text = "Ab, cdé 12ef\x7fgh" * 50 + "lang" * 40
    want = [t.encode() for t in TERM.findall(lower(text))]
    for size in (1, 7, 64, 1 << 20):
        assert [t for b in divergence.term_blocks(text.encode(), size) for t in b] == want
    assert [*divergence.term_blocks(b"")] == []
    x = spark.createDataFrame([("en", f"s{i % 2}", f"a b{i % 5} c".encode()) for i in range(50)], "lang string, source string, text binary").coalesce(2)
    sums = lambda df: sorted(tuple(r) for r in df.groupBy("lang", "source", "term").sum("n", "docs").collect())
    assert sums(divergence.term_counts(x)) == sums(divergence.term_counts(x, most=3)) == sums(divergence.term_counts(x, most_bytes=5))
    assert divergence.term_counts(x, most=3).count() > divergence.term_counts(x).count()


def test_shares_and_pairs_are_exact(monkeypatch):
    rng = np.random.default_rng(5)
    total = rng.integers(1, 9 * 10**15, 200)
    n = (rng.random(200) * total).astype(np.int64) % total
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total, strict=True)]
    p = rng.integers(1, 10**9 + 2, (7, 50))
    want = [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(x, y, strict=True)) for y in p] for x in p]
    for cells in (1, 800, 1 << 21):
        monkeypatch.setattr(divergence, "CELLS", cells)
        assert divergence.pair_matrix(p).tolist() == want
