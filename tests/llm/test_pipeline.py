"""The corpus pipeline: each stage against a brute-force version, odd rows, and the whole run."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import regex

import corpus_pipeline as cp
from voxelweave.llm import common, pieces, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGE = dict(cp.STAGES)


@pytest.fixture(scope="module")
def kept(spark):
    """The input of each stage, as cached tables, and the last result."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").cache(), []
    for _, stage in cp.STAGES:
        out.append(docs)
        docs = stage(spark, docs, SF).cache()
    return [*out, docs]


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_names_and_columns(kept):
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources", "SentencePiece"]
    assert all(d.columns == COLUMNS for d in kept[:-1])
    assert set(kept[-1].columns) == {"doc_id", "lang", "source", "n_chars", "ids", "n_pieces"}


def test_language_stage_rejects_texts_without_letters_alone(kept):
    want = Counter(tuple(r) for r in kept[0].collect() if r.text and regex.search(r"\p{L}", r.text))
    assert Counter(tuple(r) for r in kept[1].collect()) == want


def test_language_stage_fills_null_languages(spark):
    say = {"en": "the house and the garden of the king {}", "de": "das haus und der garten von dem koenig {}"}
    rows = [(i, say[c].format(i), c) for i in range(200) for c in [("en", "de")[i % 2]]]
    rows += [(1000 + i, say[c].format("x" * i), None) for i, c in enumerate(("en", "de"))] + [(1002, "12 ½", None), (1003, None, None)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in cp.identify_language(spark, df, SF).collect()}
    assert got == {**{d: c for d, _, c in rows[:200]}, 1000: "en", 1001: "de"}
    # no labelled row: no model, and still no text without letters
    assert {r.doc_id: r.lang for r in cp.identify_language(spark, df.filter("doc_id >= 1000"), SF).collect()} == {1000: None, 1001: None}


def test_line_stage(kept):
    rows = kept[1].collect()
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for r in rows:
        for line in r.text.split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(r.doc_id)
    top = {k: max(v) for k, v in held.items() if len(v) >= 3}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if top.get(key(x), r.doc_id) == r.doc_id) for r in rows}
    got = kept[2].collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def test_near_copy_stage(kept):
    rows, stay = kept[2].collect(), {r.doc_id for r in kept[3].collect()}
    sets = {r.doc_id: shingles(r.text) for r in rows}
    alike = defaultdict(dict)
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        s = 1.0 if not sets[a] and not sets[b] else both / max(1, len(sets[a] | sets[b]))
        if s >= 0.6:
            alike[a][b] = alike[b][a] = s
    for d in sets:
        if d in stay:
            # what stays is the least of its group: no smaller document is a clear copy of it
            assert not any(s >= 0.95 and o < d for o, s in alike[d].items())
        else:
            # what goes is like another document, and its group has one that stays
            assert max(alike[d].values(), default=0) >= 0.7
            seen, todo = {d}, [d]
            while todo:
                todo += (new := [o for o in alike[todo.pop()] if o not in seen])
                seen.update(new)
            assert seen & stay and min(seen) < d
    assert 0 < len(stay) < len(sets)


@pytest.mark.parametrize("parts", [1, 7])
def test_near_copy_stage_is_exact_at_the_line(spark, parts):
    rng, rows = random.Random(parts), []
    word = lambda: f"w{rng.randrange(10**6)}"
    # 8 to 20 words, and 300, with words changed, added or cut: similarities around 0.8, and just under and at it
    for i in range(700):
        a = [word() for _ in range(rng.choice([*range(8, 21), 40, 90, 300]))]
        b = list(a)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 7]) if len(a) > 80 else 1):
            at = rng.choice([0, len(b) - 1, rng.randrange(len(b))])
            b[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
        b = b[: rng.choice([len(b), len(b), max(5, len(b) * 5 // 6)])]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    rows += [(2000, " ".join(f"e{i}" for i in range(9))), (2001, " ".join(f"e{i}" for i in range(8)))]
    # many texts that share a passage are no copies of each other
    passage = [f"p{i}" for i in range(30)]
    rows += [(3000 + i, " ".join(passage + [word() for _ in range(12)])) for i in range(120)]
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    root = {d: d for d in sets}
    find = lambda d: d if root[d] == d else find(root[d])
    seen, at_line = Counter(p for h in holders.values() for p in itertools.combinations(h, 2)), Counter()
    for (a, b), both in seen.items():
        union = len(sets[a]) + len(sets[b]) - both
        at_line[20 * both // union] += 1
        if 5 * both >= 4 * union:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert at_line[15] > 20 and at_line[16] > 20 and find(2001) == 2000
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
    assert {r.doc_id for r in cp.drop_near_copies(spark, df, SF).collect()} == {d for d in sets if find(d) == d}


@pytest.mark.parametrize("entries", [False, True])
def test_near_copies_are_looked_up_by_fingerprints(spark, monkeypatch, entries):
    """Alike texts within 3 bits are found without any shared entry; alike ones farther apart by entries, and no others."""
    rows_of = simhash._set_rows
    if not entries:  # a share above 1 leaves a set without entries
        monkeypatch.setattr(simhash, "_set_rows", lambda k, words, common, share: rows_of(k, words, common, (3, 1)))
    rng, texts = random.Random(5), []
    for i in range(60):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 400, 900]))]
        texts += [a, a[:-1], a[1:] + ["end"], a[: len(a) * 9 // 10], a[: len(a) // 2]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000, None), (1001, "")]
    sets = {i: simhash.shingle_set(t, 5) for i, t in rows}
    bits = lambda h: int((simhash._bit_counts(h) * 2 > len(h)) @ (1 << np.arange(64, dtype=object)))
    fp, root, far = {i: bits(h) for i, h in sets.items()}, {i: i for i in sets}, 0
    find = lambda d: d if root[d] == d else find(root[d])
    for at in range(0, len(texts), 5):
        for a, b in itertools.combinations(range(at, at + 5), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                near = (fp[a] ^ fp[b]).bit_count() <= 3
                far += not near
                if near or entries:
                    a, b = sorted((find(a), find(b)))
                    root[b] = a
    root[1001] = 1000
    assert far > 20 and sum(find(d) != d for d in sets) > 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == {d: find(d) for d in sets}


def test_workers_give_back_what_they_have_freed():
    """Small blocks of a freed heap go back to the system, though a later one keeps the heap's top in use."""
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1])
    blocks = [np.ones(8000) for _ in range(2000)]
    last, full = np.ones(8000), held()
    del blocks
    common.give_back()
    assert full - held() > 64_000 and last.all()


def test_mixing_stage(kept):
    words = lambda t: len(WORD.findall(t or ""))
    own, most, times = Counter(), Counter(), Counter()
    for r in kept[3].collect():
        own[r.source] += words(r.text)
        most[r.source] = max(most[r.source], words(r.text))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(own, key=lambda s: (s is None, s)))}
    # water level by bisection: the targets' sum is 1.5 times all words
    lo, hi = 0.0, 2.0 * sum(own.values())
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * own[s], weight[s] * mid) for s in own) < 1.5 * sum(own.values()) else (lo, mid)
    taken = Counter()
    for r in kept[4].collect():
        taken[r.source] += words(r.text)
        times[r.doc_id] += 1
    for s in own:
        assert math.isclose(min(2 * own[s], weight[s] * hi), taken[s], abs_tol=most[s] / 2 + 1)
    assert max(times.values()) <= 2


def test_pieces_stage(spark, kept):
    assert Counter(r.text for r in kept[4].collect()) == Counter(r.text for r in pieces.decode(kept[5], pieces.load()).collect())
    assert all(r.n_pieces == len(r.ids) for r in kept[5].collect())


def test_run_equals_the_stages(spark, kept):
    got = cp.run(spark, SF)
    rows = lambda df: Counter((r.doc_id, r.source, tuple(r.ids)) for r in df.collect())
    assert rows(got) == rows(kept[-1])


def test_odd_rows_and_empty_tables(spark):
    long = " ".join(f"word{i}" for i in range(30000))
    odd = [(1, None, None, "a", None), (2, "", "en", "a", 0), (3, " \t\n", None, None, 3), (None, "Some text that is long enough to count", "en", "b", 38), (5, long, "en", "b", 1), (5, long, "en", "b", 1), (6, "½ ² 12", "de", None, 6), (7, "été ▁ 日本\r\n", None, None, None)]
    df = spark.createDataFrame([(*r, 9, "x") for r in odd], "doc_id long, text string, lang string, source string, n_chars long, size int, copies string")
    for _, stage in cp.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
    first = STAGE["language ID"](spark, df, SF)
    assert sorted((r.doc_id or 0) for r in first.collect()) == [0, 5, 5, 7]
    second = STAGE["line dedup"](spark, df, SF)
    assert second.count() == len(odd) and second.columns == df.columns
    third = STAGE["SimHash near-dedup"](spark, df, SF)
    assert sorted((r.doc_id or 0) for r in third.collect()) == [0, 1, 5, 5, 6, 7]
    fourth = STAGE["mixing sources"](spark, third, SF)
    assert fourth.columns == df.columns and {r.doc_id for r in fourth.collect()} <= {None, 1, 5, 6, 7}
    assert STAGE["SentencePiece"](spark, df, SF).count() == len(odd)


def keyed(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_of_null_and_repeated_ids(spark):
    """Each row is judged by its own text, whatever other rows share its id or have none."""
    text = lambda a: " ".join(f"{a}{i}" for i in range(60))
    near = lambda a: text(a) + " end"
    rows = [(1, text("a"), "s"), (None, near("a"), "s"), (None, text("b"), "s"), (2, text("c"), "s"), (3, near("c"), "s"), (3, text("d"), "s"), (None, text("e"), "s"), (None, near("e"), "s"), (-5, near("d"), "s"), (7, text("f"), "s"), (7, text("f"), "s")]
    left = sorted((r.text, r.doc_id) for r in STAGE["SimHash near-dedup"](spark, keyed(spark, rows), SF).collect())
    assert [x for x in left if x[0][0] != "e"] == [(text("a"), 1), (text("b"), None), (text("c"), 2), (near("d"), -5), (text("f"), 7), (text("f"), 7)]
    assert len([x for x in left if x[0][0] == "e"]) == 1


def test_mixing_of_null_and_repeated_ids(spark):
    """Of every source as many words come as the mix has, to half a document, with ids that are no keys."""
    rows = [(None, f"w{i} " * (1 + i % 7), "c") for i in range(700)] + [(None, "same text", "c")] * 300 + [(i // 4, f"x{i} " * (1 + i % 5), "a") for i in range(400)] + [(9, "y z", "b")] * 501
    words = lambda t: len(WORD.findall(t))
    own = Counter()
    for _, t, s in rows:
        own[s] += words(t)
    got, times = Counter(), Counter()
    for r in STAGE["mixing sources"](spark, keyed(spark, rows).repartition(5), SF).collect():
        got[r.source] += words(r.text)
        times[r.text, r.source] += 1
    weight, lo, hi = {"a": 3, "b": 1, "c": 2}, 0.0, 2.0 * sum(own.values())
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * own[s], weight[s] * mid) for s in own) < 1.5 * sum(own.values()) else (lo, mid)
    for s in own:
        assert abs(got[s] - min(2 * own[s], weight[s] * hi)) <= 4
    there = Counter((t, s) for _, t, s in rows)
    assert all(n <= 2 * there[k] for k, n in times.items())


def test_shingle_sets_take_no_call_for_a_shingle(monkeypatch):
    """Sets are as large as those of XXH64 of each shingle, through blocks, white space, long words and few words; only long
    words are hashed one by one. Fingerprints are majorities of all wide hashes."""
    rng = np.random.default_rng(12)
    many = " ".join(map(str, rng.integers(0, 9, 40000)))
    texts = [None, "", " \n", "a", "B b", "A  b\tc d\x0be", "a b c d e f a b c d e", "a b c d e", "ab c d e f", "a bc d e f", "é ü ß a b c " * 9, many, "x" * 90000 + " a b c d " + "y" * 70000, "\x00 \x01 a \x00\x01 b c d \x1f"]
    want = [len(np.unique(np.concatenate([np.zeros(0, np.uint64), *simhash.shingle_hashes(t, 5)]))) for t in texts]
    calls, digest = [], simhash.xxhash.xxh64_intdigest
    monkeypatch.setattr(simhash.xxhash, "xxh64_intdigest", lambda *a: calls.append(a) or digest(*a))
    sets = [simhash.shingle_set(t, 5) for t in texts]
    assert [len(h) for h in sets] == want and len(calls) == 2
    assert len(np.unique(np.concatenate(sets[7:10]))) == 3 and np.array_equal(simhash.shingle_set("A B C d e", 5), sets[7])
    words = [bytes(w) for n in range(1, 13) for w in itertools.product(b"ab", repeat=n)]
    assert len(np.unique(simhash._word_hashes(b" ".join(words)))) == len(words)
    for h in sets:
        bits = np.stack([simhash._bit_counts(simhash._word(h, i)) for i in range(8)])
        assert simhash.majority(h, 8).tolist() == np.packbits(bits * 2 > len(h), axis=1, bitorder="little").view(np.int64).ravel().tolist()


def test_little_units_are_looked_at_together():
    """Links of little units join what forests of each unit would; a unit's own call is left to large ones."""
    import pyarrow as pa

    rng = np.random.default_rng(13)
    size = [1, 2, 2, 3, 8, 9, 30, 1, 5]
    unit = np.repeat(np.arange(len(size)), size)
    fp = rng.integers(0, 4, (len(unit), 2))
    t = pa.table({"unit": unit, "label": rng.integers(0, 40, len(unit)), "node": np.arange(len(unit)), "n": rng.integers(60, 90, len(unit)), "w0": fp[:, 0], "w1": fp[:, 1]})
    args = 2, (4, 5), 1
    asked, near = [], simhash._near_rows(*args, False)
    few = simhash._unit_links(lambda part: asked.append(part.num_rows) or near(part), 2, simhash._near_pairs(*args))
    all_ = simhash._unit_links(near, 2)

    def groups(run):
        root = {}
        find = lambda x: x if root.get(x, x) == x else find(root[x])
        links = [tuple(r.values()) for b in run(iter(t.to_batches(max_chunksize=7))) for r in b.to_pylist()]
        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in range(40)}, links

    (got, links), (want, _) = groups(few), groups(all_)
    assert got == want and links and max(got.values()) > 0 and asked == [9, 30]
