"""Each operator against a brute-force version, and its defined results for odd rows."""

import hashlib
import itertools
import math
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from voxelweave.llm import components as cc
from voxelweave.llm import gru_lm, langid, lines, media, mixing, pieces, shards, simhash, topk, urls, webp

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (None, "Some text here, long enough to count as a line", "b"), (5, "x " * 20000, "b"), (5, "x " * 20000, "b"), (6, "é ß 日本 ▁ ok\r\n\x0b", "c"), (7, "12 34", "c")]


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, s, "en", 7, "clash") for i, t, s in ODD], "doc_id long, text string, source string, lang string, id int, component_id string")


def brute_fingerprint(text, k):
    w = WORD.findall(lower(text or ""))
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---------------------------------------------------------------------------------------------------------- operator 1


def test_simhash_equals_brute_force(docs, rows):
    fp = {r.doc_id: brute_fingerprint(r.text, 3) for r in rows}
    linked = [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 3]
    want = brute_components(fp, linked)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (fp[d], want[d]) for d in fp}


def test_simhash_finds_every_pair_at_three_bits(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40)
    fps = sorted({int(b) ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 3, 4)})
    fps = sorted(f - (1 << 64) if f >= 1 << 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "node long")
    pairs = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    want = brute_components(fps, pairs)
    forest = [(r.src, r.dst) for r in simhash.links(df).collect()]
    assert brute_components(fps, forest) == want
    assert all(tuple(sorted(p)) in set(pairs) for p in forest)
    # a bucket of n rows gives n - 1 links at most
    same = spark.createDataFrame([(i,) for i in range(8)], "node long")
    assert simhash.links(same).count() <= 2 * (8 - 1) + 8


def test_buckets_in_blocks(spark, monkeypatch):
    # one bucket of 400 distinct fingerprints with the same low half, compared in blocks of 32
    monkeypatch.setattr(simhash, "BLOCK", 32)
    rng = np.random.default_rng(8)
    fps = sorted({int(v) << 32 | 7 for v in rng.integers(0, 4096, 400)})
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    df = spark.createDataFrame([(f,) for f in fps], "node long")
    forest = [(r.src, r.dst) for r in simhash.links(df).collect()]
    assert set(map(tuple, map(sorted, forest))) <= set(near) and brute_components(fps, forest) == brute_components(fps, near)


def test_blocks_meet_in_every_two(spark):
    df = spark.createDataFrame([(g, i) for g, n in ((1, 40), (2, 3)) for i in range(n)], "g long, i long")
    rows = simhash.in_blocks(df, "g", "i", simhash.F.lit(1), 10).collect()
    units = defaultdict(set)
    for r in rows:
        units[r.unit].add((r.g, r.i))
    assert all(len({g for g, _ in u}) == 1 for u in units.values()) and max(map(len, units.values())) < 40
    for g, n in ((1, 40), (2, 3)):
        assert all(any({(g, a), (g, b)} <= u for u in units.values()) for a, b in itertools.combinations(range(n), 2))


@pytest.mark.parametrize("blocks", [False, True])
def test_near_copies_find_all_pairs_at_similarity(spark, monkeypatch, blocks):
    """Isolated pairs of 200 and 800 words just above and below the line, and one large group of chained near copies."""
    if blocks:
        monkeypatch.setattr(simhash, "BLOCK", 16)
        monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 2000)
    rng = np.random.default_rng(5)
    shingled = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    docs, at = [], Counter()
    for i in range(160):
        size = (200, 800)[i % 2]
        a = [f"w{j}" for j in rng.integers(0, 50000, size)]
        b = list(a)
        # changes far apart take five shingles each; the last ones, at the end, one each
        for j in range(int(0.0215 * size)):
            b[10 * j + 5] = f"c{i}"
        while len(shingled(a) & shingled(b)) / len(shingled(a) | shingled(b)) > (0.8 if i % 4 < 2 else 0.805):
            b = b[:-1]
        if i % 4 < 2:
            b.append(a[len(b)])
        s = len(shingled(a) & shingled(b)) / len(shingled(a) | shingled(b))
        at[s >= 0.8] += 1
        docs += [(2 * i, " ".join(a), s), (2 * i + 1, " ".join(b), s)]
    assert at[True] >= 100
    base = [f"g{j}" for j in range(120)]
    chain = []
    for i in range(150):
        base = list(base)
        base[int(rng.integers(0, 120))] = f"h{i}"
        chain.append((10000 + i, " ".join(base)))
    df = spark.createDataFrame([(d, t) for d, t, _ in docs] + chain, "doc_id long, text string").repartition(5)
    comp = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    for d, _, s in docs[1::2]:
        assert comp[d] == (d - 1 if s >= 0.8 else d)
    sets = [(d, shingled(t.split())) for d, t in chain]
    linked = [(a, b) for (a, s), (b, t) in itertools.combinations(sets, 2) if 5 * len(s & t) >= 4 * len(s | t)]
    want = brute_components([d for d, _ in sets], linked)
    assert {d: comp[d] for d, _ in sets} == want


def test_simhash_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    zero = [r for r in got if r.fp == 0]
    assert {r.doc_id for r in zero} >= {1, 2, 3} and {r.component_id for r in zero} == {1}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components_on_paths_stars_and_nulls(spark):
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1300)]
    e = [*path, *star, (5000, 5000), (None, 3), (7000, None), (2, 1), (2, 1)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}
    assert cc.components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---------------------------------------------------------------------------------------------------------- operator 2


@pytest.fixture(scope="module")
def tok():
    return pieces.Tokenizer(pieces.load())


def brute_viterbi(tok, s):
    score = {p: v for p, v, t in tok.model.pieces if t == pieces.NORMAL}
    best = [0.0] + [-math.inf] * len(s)
    for e in range(1, len(s) + 1):
        for a in range(max(0, e - 64), e):
            v = score.get(s[a:e])
            if v is None and e == a + 1:
                v = tok.unknown
            if v is not None:
                best[e] = max(best[e], best[a] + v)
    return best[-1]


def test_pieces_round_trip_and_best_score(tok, rows):
    texts = [r.text for r in rows[:80]] + [t for _, t, _ in ODD if t] + [" a  b ", "▁▁ x", "\n\n", "a\u2581b", "日本語 текст"]
    for t in texts:
        ids = tok.encode(t)
        assert tok.decode(ids) == t
    for t in texts[:25]:
        s = "▁" + t[:300].replace("▁", "").replace(" ", "▁")
        got = sum(tok.model.pieces[i][1] for i in tok.viterbi(s) if tok.model.pieces[i][2] == pieces.NORMAL)
        unknown = sum(c not in tok.single for c in s)
        assert math.isclose(got + unknown * tok.unknown, brute_viterbi(tok, s), rel_tol=1e-12)


def test_pieces_met_before_cost_no_python_call(tok):
    """A word met before is looked up without a call of Python code; what a small table has dropped is made anew."""
    text = " ".join(f"word{i % 50}" for i in range(2000)) + " 日x"
    want, calls = tok.encode(text).tolist(), []
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "call" else None)
    try:
        again = tok.encode(text).tolist()
    finally:
        sys.setprofile(None)
    assert again == want and len(calls) < 100
    assert pieces.Tokenizer(tok.model, cache=7).encode(text).tolist() == want


def test_pieces_score_no_less_than_the_library(tok, rows):
    """The library's own segmentation, by merges, never scores more, and the library decodes these ids."""
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    score = lambda ids: math.fsum(tok.model.pieces[i][1] for i in ids)
    for r in rows[:80]:
        ids = tok.encode(r.text).tolist()
        assert score(ids) >= score(sp.encode(r.text)) and sp.decode(ids) == r.text


def test_pieces_columns(spark, odd):
    model = pieces.load()
    out = pieces.encode(odd.withColumnRenamed("component_id", "ids"), model, decoded="back")
    assert [f.name for f in out.schema] == ["doc_id", "text", "source", "lang", "id", "ids", "back"]
    got = out.collect()
    assert all(r.back == r.text for r in got) and all((r.ids is None) == (r.text is None) for r in got)
    back = pieces.decode(out.drop("text", "back"), model).collect()
    assert sorted((str(r.text) for r in back)) == sorted(str(t) for _, t, _ in ODD)
    assert pieces.encode(odd.limit(0), model).count() == 0


# ---------------------------------------------------------------------------------------------------------- operator 3


def test_language_id_held_out(docs, rows):
    held = langid.in_fold(docs["doc_id"], 4, 2)
    model = langid.fit(docs.filter(~held))
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    mine = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(mine) > 20
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in mine]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("classes", [2, 3, 4, 5, 6, 30, 200, 512])
def test_codewords_are_apart(classes):
    m = langid.code_matrix(classes)
    apart = min((m[a] != m[b]).sum() for a, b in itertools.combinations(range(classes), 2))
    assert apart >= (3 if classes > 3 else 2 ** (classes - 2))
    # no two bits are one split, and none is no split
    assert len({tuple(c * c[0]) for c in m.T}) == m.shape[1] and (abs(m.sum(axis=0)) < classes).all()


def test_language_decoding_by_hand():
    model = langid.Model(["a", "b", "c"], langid.code_matrix(3), np.zeros((64, 3), np.float32), np.array([2.0, -1.0, 0.5], np.float32), 64, 0.1)
    loss = [sum(math.log1p(math.exp(-s * v)) for s, v in zip(code, (2.0, -1.0, 0.5))) for code in model.codes.tolist()]
    share = [math.exp(-x) for x in loss]
    best = max(range(3), key=lambda i: share[i])
    lang, score, ambiguous = model.predict("text")
    assert lang == "abc"[best] and math.isclose(score, share[best] / sum(share), rel_tol=1e-6)
    two = sorted(share)[-2:]
    assert ambiguous == ((two[1] - two[0]) / sum(share) < 0.1)
    assert model.predict("12 ½") == model.predict(None) == ("und", 0.0, False)


def test_language_of_mixed_texts_and_null_ids(spark, docs):
    """Half a text in each of two languages is flagged; languages that only rows with null ids have are learned."""
    model = langid.fit(docs)
    by = defaultdict(list)
    for r in docs.filter("lang is not null and text is not null").collect():
        by[r.lang].append(" ".join(r.text.split()[:60]))
    one = [model.predict(t)[2] for v in by.values() for t in v if len(t) > 200]
    langs = sorted(by)
    pairs = [(a, b) for a, b in itertools.combinations(langs, 2)]
    mixed = [model.predict(f"{x} {y}") for a, b in pairs for x, y in zip(by[a][:20], by[b][:20])]
    assert np.mean([m[2] for m in mixed]) > np.mean(one) and np.mean([m[1] for m in mixed]) < 0.9
    rows = [(None, f"das haus und der garten {i}", "de") for i in range(3000)] + [(i, f"the house and the garden {i}", "en") for i in range(30)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=200)
    assert m.predict("der garten und das haus")[0] == "de" and m.predict("the garden and the house")[0] == "en"


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_a_language_of_one_text_repeated_is_learned(spark, seed):
    """3000 copies of one row beside 3000 other rows: whatever their hash, the copies are one row of the fit."""
    rows = [(seed, "das haus und der garten", "de")] * 3000 + [(i, f"the house and the garden {seed} {i}", "en") for i in range(3000)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=200)
    assert m.languages == ["de", "en"]
    assert m.predict("das haus und der garten")[0] == "de" and m.predict("the house and the garden")[0] == "en"


def test_features_do_not_depend_on_blocks():
    t = "Ein Text, der über mehrere Blöcke geht. " * 40
    assert np.allclose(langid.features(t, 512), langid.features(t, 512, block=37), atol=1e-6)


def test_language_id_odd_rows(spark, docs, odd):
    model = langid.fit(docs)
    got = langid.identify(odd.withColumnRenamed("component_id", "score"), model).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3, 7)] == ["und"] * 4
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


# ---------------------------------------------------------------------------------------------------------- operator 4


def brute_lines(rows):
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 20:
                held[key(s)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [s for s in ls if len(held.get(key(s), ())) < 3 or max(held[key(s)]) == (-1 if i is None else i)]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(docs, rows):
    got = lines.dedup_lines(docs, batches=5, fanout=2)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_dropped"}
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute_lines([(r.doc_id, r.text) for r in rows])


def test_line_dedup_odd_rows(spark):
    long = "a line that is long enough to count"
    x = [(i, t) for i, t, _ in ODD] + [(10, long), (11, f"  {long.upper()}\t\n{long}\nshort"), (12, f"{long}\n{long}\n"), (None, long), (13, f"\n{long}"), (13, f"other\n{long}")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in x], "doc_id long, text string, th string, pos int")
    got = lines.dedup_lines(df)
    assert {"th", "pos"} <= set(got.columns)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute_lines(x)
    assert lines.dedup_lines(df.limit(0)).count() == 0


# ---------------------------------------------------------------------------------------------------------- operator 5


def test_gru_gradients():
    cfg = gru_lm.Config(hidden=5, dim=4, classes=3)
    net, cls = gru_lm.new_net(cfg, [9, 7, 5, 3, 2, 1, 1], 4)
    rng = np.random.default_rng(0)
    net.p = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in net.p.items()}
    prev, want = rng.integers(0, 8, (6, 3)), rng.integers(0, 8, (6, 3))
    fresh = np.zeros((6, 3), bool)
    fresh[3, 1] = True
    valid = rng.random((6, 3)) < 0.8

    def loss():
        run = gru_lm.Runner(net, cls, 3)
        run.h = run.h.astype(np.float64)
        return run.gradients(prev, fresh, want, valid)

    _, g = loss()
    for k, v in net.p.items():
        for i in rng.choice(v.size, min(5, v.size), replace=False):
            at = np.unravel_index(i, v.shape)
            old = v[at]
            v[at] = old + 1e-3
            up = loss()[0]
            v[at] = old - 1e-3
            down = loss()[0]
            v[at] = old
            assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3, k


def test_gru_scores_are_probabilities_and_carry_state():
    cfg = gru_lm.Config(hidden=6, dim=4, classes=3, window=4, lanes=3)
    net, cls = gru_lm.new_net(cfg, [9, 7, 5, 3], 4)
    rng = np.random.default_rng(1)
    net.p = {k: (v + rng.standard_normal(v.shape) * 0.4).astype(np.float32) for k, v in net.p.items()}
    run = gru_lm.Runner(net, cls, 1)
    hs = rng.standard_normal((1, 6)).astype(np.float32)
    assert math.isclose(sum(float(np.exp(run.losses(hs, np.array([w]))[0])) for w in range(5)), 1, rel_tol=1e-4)
    docs = [rng.integers(0, 5, n) for n in (1, 3, 4, 5, 9, 30, 2)]

    def alone(d):
        r = gru_lm.Runner(net, cls, 1)
        prev = np.concatenate([[0], d[:-1]])[:, None]
        out, _ = r.forward(prev, np.zeros((len(d), 1), bool))
        return r.losses(out.reshape(-1, 6), d).sum()

    assert np.allclose(gru_lm.score(net, cls, docs, 0), [alone(d) for d in docs], rtol=1e-4)


def test_gru_scores_lanes_without_a_turn_for_each():
    """A window of all lanes is taken by one look-up; logits beyond the limit are still cut where weights are large."""
    rng = np.random.default_rng(5)
    net, cls = gru_lm.new_net(gru_lm.Config(vocab=5, classes=2, dim=4, hidden=6, lanes=100), [9, 5, 4, 3, 2], 1)
    docs, calls = [rng.integers(0, 6, 960 + i) for i in range(100)], []
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "c_call" and arg is len else None)
    try:
        got = gru_lm.score(net, cls, docs, 0)
    finally:
        sys.setprofile(None)
    assert len(calls) < 1500  # over 30 windows of 100 lanes
    assert np.allclose(got, [gru_lm.score(net, cls, [d], 0)[0] for d in docs], rtol=1e-4)
    net.p["wc"] += 1e4
    net.p["ww"] += 1e4
    assert np.isfinite(gru_lm.score(net, cls, docs, 0)).all()


def test_gru_documents(docs, rows):
    cfg = gru_lm.Config(head=300, vocab=120, classes=8)
    out = gru_lm.score_documents(docs, ~langid.in_fold(docs["doc_id"], 7, 2), cfg=cfg).collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    toks = lambda r: [*WORD.findall(lower(r.text or "")), ""]
    c = Counter(t for r in train for t in toks(r))
    n, v = sum(c.values()), len(c)
    by = {r.doc_id: r for r in rows}
    for r in out:
        t = toks(by[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(x in c for x in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
    held = [r for r in out if not r.train]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_gru_trains_on_every_window(docs, rows):
    cfg = gru_lm.Config()
    index = {b"a": 0, b"b": 1, b"": 2}
    sizes = (1, 40, 200, 700)
    got = list(gru_lm._chunks(iter(["a b c " * n for n in sizes]), index, cfg, 2))
    assert sum(len(c) - 1 for c in got) == sum(3 * n + 1 for n in sizes)
    net, cls = gru_lm.new_net(gru_lm.Config(hidden=5, dim=4, classes=2), [9, 7, 5], 4)
    assert gru_lm.train(net, cls, iter(got), 2)[1] == sum(3 * n + 1 for n in sizes)


def test_gru_weights_are_averaged_by_words(spark):
    parts = [(b, p, p + 1, np.full(3, float(p * (p + 1) + b)).tobytes()) for p in range(150) for b in (0, 1)]
    df = spark.createDataFrame(parts, "block int, part long, seen long, v binary").repartition(150, "part")
    got = {r.block: (r.seen, np.frombuffer(bytes(r.v))) for r in gru_lm._summed(df, fan=8).collect()}
    for b in (0, 1):
        assert got[b][0] == sum(range(1, 151)) and np.allclose(got[b][1], sum(p * (p + 1) + b for p in range(150)))


def test_gru_score_of_the_registered_configuration(docs, rows):
    """Scores against each text's own sum: the network's classes and words by plain formulas, and counts of rare words."""
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    held = ~langid.in_fold(docs["doc_id"], 7, 2)
    got = {r.doc_id: r.score for r in gru_lm.score_documents(docs, held).collect()}
    cfg, seen = gru_lm.Config(), docs.filter(held)
    counts = Counter(t for r in train for t in gru_lm.words_of(r.text))
    n = sum(counts.values())
    head = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    assert head[: cfg.vocab] == gru_lm._commonest(gru_lm.token_counts(seen, "text"), cfg)[: cfg.vocab]
    net, cls, number, start = gru_lm.fit(seen, "doc_id", "text", head, n, cfg)
    at = {t: int(i) for (t, _), i in zip(head, number, strict=False)}
    rare = {t: c for t, c in counts.items() if at[t] == net.vocab}
    p, sig = {k: v.astype(float) for k, v in net.p.items()}, lambda x: 1 / (1 + np.exp(-x))
    k = cfg.hidden

    def by_hand(text):
        h, prev, total = np.zeros(k), start, 0.0
        for w in gru_lm.words_of(text):
            x, hu = p["emb"][prev] @ p["wx"] + p["b"], h @ p["u"]
            r, z = sig(x[:k] + hu[:k]), sig(x[k : 2 * k] + hu[k : 2 * k])
            cand = np.tanh(x[2 * k :] + r * hu[2 * k :])
            h = cand + z * (h - cand)
            prev = at.get(w, net.vocab)
            lg = h @ p["wc"] + p["bc"]
            total += lg[cls[prev]] - np.log(np.exp(lg).sum())
            if prev == net.vocab:
                total += math.log((rare.get(w, 0) + 1) / (sum(rare.values()) + len(rare) + 1))
            else:
                a, e = net.cuts[cls[prev]], net.cuts[cls[prev] + 1]
                lg = h @ p["ww"][a:e].T + p["bw"][a:e]
                total += lg[prev - a] - np.log(np.exp(lg).sum())
        return total / math.log(10)

    for r in rows[:40]:
        assert math.isclose(got[r.doc_id], by_hand(r.text), rel_tol=1e-3), r.doc_id


def test_gru_trains_on_few_windows():
    net, cls = gru_lm.new_net(gru_lm.Config(hidden=5, dim=4, classes=3), [9, 7, 5, 3], 4)
    got, seen = gru_lm.train(net, cls, iter([np.array([0, 1, 2, 0])]), 0)
    assert seen == 3 and not np.array_equal(got.flat(), net.flat())


def test_gru_does_not_depend_on_partitions(docs):
    cfg = gru_lm.Config(head=300, vocab=120, classes=8, rounds=2, copy_words=4000)
    held = ~langid.in_fold(docs["doc_id"], 7, 2)
    got = []
    for n in (1, 8, 64):
        r = gru_lm.score_documents(docs.repartition(n), held, cfg=cfg).collect()
        got.append({x.doc_id: x.score for x in r})
        assert sum(x.score for x in r if not x.train) > sum(x.base_score for x in r if not x.train)
    for other in got[1:]:
        assert all(math.isclose(v, got[0][k], rel_tol=1e-5) for k, v in other.items())


def test_gru_deals_every_row_once(spark, docs):
    rows = gru_lm.dealt(docs, "doc_id", "text", 4, 5)
    met = {(r["round"], r["copy"]): r["n"] for r in rows.groupBy("round", "copy").agg(F.count("*").alias("n")).collect()}
    assert sum(met.values()) == docs.count() and set(met) == {(a, b) for a in range(4) for b in range(5)}
    # rows of one text and no id, or with ids of their own, are not one copy's
    for same in (spark.range(2000).selectExpr("cast(null as bigint) id", "'a text' t"), spark.range(2000).selectExpr("id", "'a text' t")):
        most = gru_lm.dealt(same, "id", "t", 4, 5).groupBy("round", "copy").count().agg(F.max("count")).first()[0]
        assert most < 200


def test_gru_odd_rows(spark, odd):
    cfg = gru_lm.Config(head=50, vocab=20, classes=4)
    got = gru_lm.score_documents(odd, odd["doc_id"] > 2, cfg=cfg).collect()
    assert len(got) == len(ODD) and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    none = gru_lm.score_documents(odd, odd["doc_id"] > 99, cfg=cfg).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    assert gru_lm.score_documents(odd.limit(0), odd["doc_id"] > 2, cfg=cfg).count() == 0


# ---------------------------------------------------------------------------------------------------------- operator 6


def brute_top(vecs, k=10, every=100):
    q = {i: [math.floor(1024 * x) for x in v] for i, v in vecs if v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, a in q.items():
        if i % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in q.items() if j != i and len(b) == len(a))[:k]
        out += [(i, n + 1, j, -v) for n, (v, j) in enumerate(s)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_top([(r.vec_id, r.embedding) for r in e.collect()], every=10)
    got = sorted(tuple(r) for r in topk.top_k(e, e["vec_id"] % 10 == 0, rows=64).collect())
    assert got == want


def test_top_k_prunes(spark):
    """The share of pairs that the bounds end before exact products, on the registered table."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r.embedding for r in e], float))
    ids = np.array([r.vec_id for r in e])
    q, left = ids % 100 == 0, []
    r, c, s = topk.block_top(x[q], ids[q], x, ids, 10, left=left)
    marks = np.array([s[r == i].min() for i in range(q.sum())], float)
    topk.block_top(x[q], ids[q], x, ids, 10, marks, left)
    assert left[0][-1] < 0.8 * left[0][0] and left[1][-1] < 0.6 * left[1][0]
    # with structure, as real embeddings have, the coarse levels end most pairs
    rng = np.random.default_rng(1)
    y = np.floor(1024 * (np.repeat(rng.normal(size=(40, 8)), 8, axis=1)[rng.integers(0, 40, 2000)] + 0.1 * rng.normal(size=(2000, 64))))
    topk.block_top(y[:50], np.arange(50), y, np.arange(2000), 10, left=left)
    assert left[2][2] < 0.2 * left[2][0]


def test_top_k_ties_nulls_and_short_tables(spark):
    v = [(0, [1.0, 2.0]), (3, [1.0, 2.0]), (2, [1.0, 2.0]), (1, [0.5, 0.25]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (8, []), (9, [1.0]), (100, [3e8, -2e9])]
    df = spark.createDataFrame([(i, x, 1) for i, x in v], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in topk.top_k(df, df["vec_id"] % 100 == 0, k=3).collect())
    assert got == brute_top(v, 3)
    assert topk.top_k(df.limit(0), df["vec_id"] % 100 == 0).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, (50, 20))
    for cuts in topk.levels(20):
        s = topk.statistics(x, cuts)
        near = ((s[:, None] - s[None]) ** 2).sum(axis=2)
        assert (near <= ((x[:, None] - x[None]) ** 2).sum(axis=2) + 1e-9).all()


# ---------------------------------------------------------------------------------------------------------- operator 7

RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/")]


def test_url_rules(spark):
    x = [
        ("https://WWW.Example.com/en/a", "www.example.com", "/en/a", "www.example.com/en/", "allow"), ("http://m.example.com/en/?q", "m.example.com", "/en/", "example.com/en/", "block"), ("http://notexample.com/en/x#f", "notexample.com", "/en/x", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"), ("http://example.com?x=/en/", "example.com", "", None, "allow"), ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"), ("http://anet/es/1", "anet", "/es/1", None, "allow"), ("no scheme.com/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("x://com/y://net/es/", "com", "/y://net/es/", "com/", "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], None, "old") for i, r in enumerate(x)], "page_id long, url string, html string, verdict string")
    got = [(r.url, r.host, r.path, r.rule, r.verdict) for r in sorted(urls.judge(df, RULES).collect())]
    assert got == x
    assert urls.judge(df.limit(0), RULES).count() == 0


def test_url_aliases_carry_blocks(spark):
    page = lambda tag: f"<html><head><!-- <link rel=canonical href='http://z.org/'> -->{tag}</head></html>"
    x = [
        (1, "http://a.org/x", page('<link rel="canonical" href="http://b.net/es/1">')),  # its target is blocked
        (2, "http://c.org/y", page("<meta http-equiv='Refresh' content='0; URL=http://a.org/x#top'>")),  # by two steps
        (3, "http://d.com/z", page('<link href="http://a.org/x" rel="canonical"/>')),  # allowed by its own rule
        (4, "http://e.org/w", page('<link rel="canonical" href="/v">')),
        (5, "http://e.org/v", None),
        (6, "http://a.org/x", None),  # the same URL again
        (7, "http://f.org/a/b", page('<meta property="og:url" content="../c"><link rel=stylesheet href="http://b.net/es/1">')),
        (8, None, page('<link rel="canonical" href="http://b.net/es/1">')),
    ]
    # verdicts that depend on the links' meeting: dot segments, a base, case, ports, empty paths, long and broken pages
    x += [
        (9, "HTTP://F.org:80/c#x", page('<link rel=canonical href="http://b.net/es/../es/./1">')),
        (10, "https://g.org", page('<base href="http://h.org/deep/er/"><link rel=canonical href="../b">')),
        (11, "http://h.org/deep/b", page('<meta http-equiv=refresh content="3;url=//B.NET:80/es/1">')),
        (12, "https://G.org:443/", None),
        (13, "http://long.org/", "<p>" * 200000 + '<link rel=canonical href="http://b.net/es/1">' + "<!-- <meta"),
        (14, "http://broken.org/", "<link rel=canonical href='http://b.net/es/1"),
    ]
    df = spark.createDataFrame(x, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(df, RULES).collect()}
    assert got == {**{i: "block" for i in (1, 2, 6, 7, 9, 10, 11, 12, 13)}, **{i: "allow" for i in (3, 4, 5, 8, 14)}}


def test_urls_normal(spark):
    x = {"HTTP://A.Org:80/x/../y/./z?Q=/../#f": "http://a.org/y/z?Q=/../", "https://a.org": "https://a.org/", "http://a.org/../..": "http://a.org/", "http://a.org/b/..": "http://a.org/", "http://a.org/b/.": "http://a.org/b/", "http://a.org:8080/.b/c..d": "http://a.org:8080/.b/c..d", "no scheme#x": "no scheme", "http://a.org?q": "http://a.org/?q", "": ""}
    got = spark.createDataFrame([(k,) for k in x] + [(None,)], "u string").select("u", urls.normal(urls.F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in got} == {**x, None: None}


# ---------------------------------------------------------------------------------------------------------- operator 8


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (13, 9), (20, 33)])
@pytest.mark.parametrize("colours", [2, 3, 12, 100, None])
def test_webp_round_trips(shape, colours):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, shape) if colours is None else rng.integers(0, 1 << 32, colours)[rng.integers(0, colours, shape)]
    for tr in ([], [0], [1], [2], [0, 1, 2], [3], [2, 0], [3, 0]):
        if 3 in tr and colours is None:
            continue
        for cache, refs, tile in ((0, False, 0), (4, False, 0), (0, True, 0), (6, True, 2)):
            assert (webp.decode_argb(webp.encode_argb(x, tr, cache_bits=cache, refs=refs, tile=tile)) == x).all()


def test_webp_one_pixel_by_hand():
    # 1 x 1, no transform, no cache, no groups, five one-symbol codes: green 5, red 200, blue 7, alpha 255
    w = webp.Writer()
    for v, n in ((0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        w.put(v, n)
    for v in (5, 200, 7, 255):
        for a, n in ((1, 1), (0, 1), (1, 1), (v, 8)):
            w.put(a, n)
    for a, n in ((1, 1), (0, 1), (0, 1), (0, 1)):
        w.put(a, n)
    body = b"\x2f" + w.bytes()
    body += b"\0" * (len(body) & 1)
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode_argb(data).tolist() == [[0xFFC80507]]


def test_webp_references_by_plain_decoding():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in rng.integers(2, 12, 60)]
    text = b" ".join(words[i] for i in rng.integers(0, 60, 3000))
    for payload in (text, b"\xff" * 576, text[:300], b"abc" * 40000, bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), b"A" + b"\xff" * 575):
        payload += b"\xff" * (-len(payload) % 576)
        g = np.frombuffer(payload, np.uint8)
        start, size, far = webp.references(g)
        assert all((g[a : a + n] == g[a - d : a + n - d]).all() for a, n, d in zip(start, size, far))
        x = g.reshape(-1, 576).astype(np.int64) << 8 | webp.BLACK
        kept = webp.encode_argb(x, refs=True)
        assert (webp.decode_argb(kept) == x).all()
        # the same stream pixel by pixel, token by token: after sides, alpha, version and no transform
        b = webp.Bits(kept[21:])
        b.read(33)
        assert (_slow_pixels(b, 576, len(x)) == x.ravel()).all()
    assert len(webp.references(np.frombuffer(text, np.uint8))[0]) > 100


def _slow_pixels(b, width, height):
    """Plain decoding of one group of codes without a cache, by the format's description."""
    assert (b.read(1), b.read(1)) == (0, 0)
    codes = [webp.Table(webp._get_code(b, n)) for n in webp.ALPHABETS]
    out = []
    while len(out) < width * height:
        s = b.symbol(codes[0])
        if s < 256:
            red, blue, alpha = (b.symbol(c) for c in codes[1:4])
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
            continue
        size = webp._prefixed(s - 256, b)
        far = webp._prefixed(b.symbol(codes[4]), b)
        if far <= 120:
            dx, dy = webp.NEAR[far - 1]
            far = max(1, dx + dy * width)
        else:
            far -= 120
        for _ in range(size):
            out.append(out[-far])
    return np.array(out)


def test_store_takes_the_smaller_form():
    steps = np.add.outer(np.arange(60) * 3, np.arange(576) * 2).astype(np.uint8).tobytes()
    forms = {"few": b"ab" * 576, "smooth": steps, "text": ("some plain text, line %d\n" * 200 % tuple(range(200))).encode()}
    for name, p in forms.items():
        p += b"\xff" * (-len(p) % 576)
        form = webp._form(np.frombuffer(p, np.uint8).reshape(-1, 576))
        assert form.get("transforms") == {"few": [webp.PALETTE], "smooth": [webp.PREDICTOR], "text": None}[name]
        kept = webp.store(p)
        assert webp.load(kept).tobytes() == p and len(kept) < len(p) / 2
    long = b"".join(b"row %07d %s\n" % (i, b"x" * (i % 50)) for i in range(260000))  # two files
    long += b"\xff" * (-len(long) % 576)
    kept = webp.store(long)
    assert len(long) > webp.MOST_ROWS * 576 and kept.count(b"WEBPVP8L") >= 2 and webp.load(kept).tobytes() == long


def test_webp_rejects_broken_files():
    data = webp.encode_argb(np.arange(400).reshape(20, 20) << 8 | 0xFF000000)
    for bad in (b"", data[:30], b"GIF8" + data[4:], data[:-8]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode_argb(bad)


def test_media_columns(docs, rows, odd):
    by = {r.doc_id: r.text for r in rows}
    got = media.stored(docs, media="image").collect()
    assert len(got) == len(rows)
    for r in got:
        raw = by[r.doc_id].encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-32:])
        assert r.media_bytes == len(r.image) and r.media_sha256 == hashlib.sha256(r.image).hexdigest()
        assert webp.load(bytes(r.image)).tobytes() == want
    odd_rows = media.stored(odd).collect()
    assert len({r.feature for r in odd_rows if r.doc_id in (1, 2)}) == 1 and len(odd_rows) == len(ODD)
    assert media.stored(odd.limit(0)).count() == 0


# ---------------------------------------------------------------------------------------------------------- operator 9


def test_mixing_meets_targets(docs, rows):
    got = mixing.mix(docs, mixing.word_count(docs["text"])).collect()
    assert len(got) == len(rows)
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    per, want, most = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        per[r.source] += r.taken
        want[r.source] = (r.target, r.source_size)
        most[r.source] = max(most[r.source], r.size)
    assert math.isclose(sum(t for t, _ in want.values()), 1.5 * sum(size.values()), rel_tol=1e-9)
    for s, (t, n) in want.items():
        assert t <= 2 * n + 1e-9 and abs(per[s] - t) <= most[s] / 2 + 1e-6
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7), mixing.word_count(docs["text"])).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    # longer texts come more often: inclusion grows with the digits of the size
    share = defaultdict(list)
    for r in got:
        rate = r.target / r.source_size
        if r.size and 0.05 < rate % 1 < 0.95:
            share[r.source].append((r.size.bit_length(), r.copies - math.floor(rate)))
    for v in share.values():
        if len(v) > 60:
            mid = sorted(b for b, _ in v)[len(v) // 2]
            assert np.mean([m for b, m in v if b >= mid]) > np.mean([m for b, m in v if b < mid])
    # weights 3, 1, 2 in turn, null last; uncapped targets stand as the weights
    level = {s: t / [3, 1, 2][i % 3] for i, (s, (t, n)) in enumerate(sorted(want.items())) if t < 2 * n - 1e-6}
    assert len(level) == 0 or max(level.values()) - min(level.values()) < 1e-6 * max(level.values())


def test_mixing_of_equal_rows(spark):
    """Thousands of rows without an id share one ranking number: as many are taken as come nearest to the target."""
    rows = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.when(F.col("id") % 5 == 0, "w w w w").otherwise("w w w w w").alias("text"))
    rows = rows.unionByName(spark.range(50).select("id", F.lit("c"), F.repeat(F.lit("w "), F.col("id").cast("int") * 3)).toDF("doc_id", "source", "text"))
    got = mixing.mix(rows, mixing.word_count(rows["text"])).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("size"), F.count("*").alias("rows"))
    got = {r.source: r for r in got.collect()}
    assert {s: r.rows for s, r in got.items()} == {"a": 2000, "b": 4000, "c": 50}
    assert all(abs(r.taken - r.target) <= r.size / 2 for r in got.values())


def test_mixing_odd_rows(spark, odd):
    got = mixing.mix(odd, mixing.word_count(odd["text"])).collect()
    assert len(got) == len(ODD)
    assert {r.source for r in got} == {"a", "b", "c", None}
    assert all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(odd.limit(0), mixing.word_count(odd["text"])).count() == 0


# --------------------------------------------------------------------------------------------------------- operator 10


def test_shards_move_only_to_the_new_one(docs, rows):
    df = docs.select("doc_id", "source")
    got = shards.shard(df, "doc_id", [1.0] * 24, [1.0] * 25).collect()
    assert len(got) == len(rows)
    for r in got:
        bids = [int(hashlib.md5(f"{r.doc_id}/{s}".encode()).hexdigest()[:13], 16) for s in range(25)]
        assert r.shard == bids[:24].index(max(bids[:24])) and r.grown_shard in (r.shard, 24)
    for s in range(24):
        mine = sorted((r.slot, r.doc_id) for r in got if r.shard == s)
        assert [a for a, _ in mine] == list(range(len(mine))) and [d for _, d in mine] == sorted(d for _, d in mine)


def test_shards_follow_weights(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    n = Counter(r.s for r in df.select(shards.rendezvous(df["doc_id"], [1.0, 2.0, 0.0, 5.0]).alias("s")).collect())
    assert n[2] == 0 and all(abs(n[s] / 20000 - w / 8) < 0.015 for s, w in ((0, 1), (1, 2), (3, 5)))


def test_shards_odd_rows(spark, odd):
    got = shards.shard(odd.drop("text"), "doc_id", [1.0] * 3).collect()
    assert len(got) == len(ODD) and all(r.grown_shard is None for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert shards.shard(odd.limit(0).drop("text"), "doc_id", [1.0] * 3).count() == 0
