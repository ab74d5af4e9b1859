"""The jobs: repeated runs, growing input, a batch that was cut off, odd rows, and a command line."""

import logging
import math
import os
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

from jobs import image_votes, label_texts

SF = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string, source string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------------------------------------------- image votes


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    """Three images; rows that can take no part."""
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(60)]
    odd = [(None, [0.0] * 4, 1), (90, None, 1), (91, [0.0] * 4, None), (92, [0.0, None, 0.0, 0.0], 1), (93, [0.0, float("nan"), 0.0, 0.0], 1)]
    path = str(tmp_path_factory.mktemp("features"))
    spark.createDataFrame([(*r, "clash") for r in good + odd], "vec_id long, embedding array<double>, label int, image string").coalesce(2).write.mode("overwrite").parquet(path)
    return good, path


def brute_votes(good, k):
    """{(image, label): (votes, cnt)}."""
    best = {}
    for q, v, image in good:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), t, label) for t, w, label in good if t != q)[:k]
        first = {}
        for d, t, label in near:
            if label != image:
                first.setdefault(label, (d, t))
        m = min((d for d, _ in first.values() if d > 0), default=1.0)
        e = {label: math.exp(-((d / m) ** 2)) for label, (d, _) in first.items()}
        for label, (_, t) in first.items():
            w = math.log2(e[label] / sum(e.values()) + 1)
            best[image, t, label] = max(w, best.get((image, t, label), 0.0))
    out = defaultdict(lambda: [0.0, 0])
    for (image, _, label), w in best.items():
        out[image, label][0] += w
        out[image, label][1] += 1
    return out


def test_votes_equal_brute_force_and_runs_repeat(spark, features, tmp_path, caplog):
    good, path = features
    out = f"{tmp_path}/votes"
    with caplog.at_level(logging.INFO):
        done = rows_of(image_votes.run(spark, path, out, neighbours=6))
    assert "65 rows, 60 of them features" in caplog.text and "9 rows for all images" in caplog.text
    want = brute_votes(good, 6)
    assert len(done) == 9
    for label, votes, cnt, share, loglik, place, image in done:
        v, n = want.get((image, label), (0.0, 0))
        assert math.isclose(votes, v, abs_tol=1e-9) and cnt == n and loglik < 0
        assert math.isclose(share, v / sum(want[image, other][0] for other in range(3)), abs_tol=1e-9)
    by_image = defaultdict(list)
    for r in done:
        by_image[r[6]].append((r[5], -r[1]))
    assert all([v for _, v in sorted(x)] == sorted(v for _, v in x) for x in by_image.values())
    assert sorted(os.listdir(out))[-3:] == ["image=0", "image=1", "image=2"]
    assert rows_of(image_votes.run(spark, path, out, neighbours=6)) == done


def test_listed_images_alone_are_replaced(spark, features, tmp_path):
    _, path = features
    out = f"{tmp_path}/votes"
    all_six = rows_of(image_votes.run(spark, path, out, neighbours=6))
    mixed = rows_of(image_votes.run(spark, path, out, neighbours=20, images=[1]))
    assert [r for r in mixed if r[6] != 1] == [r for r in all_six if r[6] != 1]
    assert [r for r in mixed if r[6] == 1] != [r for r in all_six if r[6] == 1]
    assert rows_of(image_votes.run(spark, path, out, neighbours=6, images=[1])) == all_six


def test_no_features(spark, features, tmp_path):
    empty = f"{tmp_path}/empty"
    spark.read.parquet(features[1]).limit(0).write.parquet(empty)
    assert rows_of(image_votes.run(spark, empty, f"{tmp_path}/votes")) == []


def test_command_line(features, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "few.toml").write_text("neighbours = 4\nimages = [2]\n")
    args = ["--features", features[1], "--out", f"{tmp_path}/votes", "--config", f"{tmp_path}/few.toml"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell", "PYTHONPATH": ""}
    said = subprocess.run([sys.executable, f"{root}/jobs/image_votes.py", *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert said.returncode == 0, said.stderr[-2000:]
    assert "3 rows for images [2]" in said.stderr
    assert [p for p in os.listdir(tmp_path / "votes") if p.startswith("image")] == ["image=2"]


# ------------------------------------------------------------------------------------------------------- text labels


def brute_profile(text, bins=64):
    b = (text or "").encode()
    n = Counter((y - x) % bins for x, y in zip(b, b[1:], strict=False))
    order = sorted(range(bins), key=lambda i: (n[i], i))
    return [order.index(i) for i in range(bins)]


def brute_labels(texts, atlas, k):
    """{doc_id: (label, votes, share, nearest, dist)}."""
    guide = [(i, brute_profile(t), label) for i, t, label in atlas]
    out = {}
    for q, text in texts:
        pc = brute_profile(text)
        near = sorted((sum((a - b) ** 2 for a, b in zip(pc, v, strict=True)), t, label) for t, v, label in guide if t != q)[:k]
        m = min((d for d, _, _ in near if d > 0), default=1)
        e = [math.exp(-((d / m) ** 2)) for d, _, _ in near]
        votes = defaultdict(float)
        for (_, _, label), x in zip(near, e, strict=True):
            votes[label] += math.log2(x / sum(e) + 1)
        label = min(votes, key=lambda v: (-round(votes[v], 9), v))
        out[q] = (label, votes[label], votes[label] / sum(votes.values()), near[0][1], near[0][0])
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return base, docs, labels


def arrive(spark, rows, folder):
    spark.createDataFrame(rows, TEXTS).coalesce(1).write.mode("append").parquet(folder)


def same(got, want):
    got = {r.doc_id: (r.label, r.votes, r.share, r.nearest, r.dist) for r in got}
    assert got.keys() == want.keys()
    for i, (label, *rest) in want.items():
        assert got[i][0] == label and np.allclose(got[i][1:], rest, atol=1e-9), (i, got[i], want[i])


def test_labels_over_growing_input(spark, corpus, tmp_path, caplog):
    """Two runs over a folder that grows, one over nothing new, against one run over all of it."""
    _, docs, labels = corpus
    where, out = f"{tmp_path}/arriving", f"{tmp_path}/out"
    run = lambda to=out: label_texts.run(spark, where, f"{SF}/documents.parquet", f"{SF}/labels.parquet", to)
    want = brute_labels([(r.doc_id, r.text) for r in docs], [(r.doc_id, r.text, labels[r.doc_id]) for r in docs if r.doc_id in labels], 5)
    first = [tuple(r) for r in docs[:120]]
    arrive(spark, first, where)
    with caplog.at_level(logging.INFO):
        same(run().collect(), {r[0]: want[r[0]] for r in first})
        # the second file repeats ten texts of the first
        arrive(spark, [tuple(r) for r in docs[110:]], where)
        done = run()
        same(done.collect(), want)
        stamps = {d: sorted((f, os.stat(os.path.join(p, f)).st_mtime_ns) for p, _, fs in os.walk(f"{out}/{d}") for f in fs) for d in ("batch=0", "batch=1")}
        before = rows_of(done)
        assert rows_of(run()) == before
    assert f"batch 0: read 120 rows of {where}, wrote 120" in caplog.text
    assert f"batch 1: read {len(docs) - 110} rows of {where}, wrote {len(docs) - 120}" in caplog.text
    assert f"0 rows were new in {where}" in caplog.text
    assert stamps == {d: sorted((f, os.stat(os.path.join(p, f)).st_mtime_ns) for p, _, fs in os.walk(f"{out}/{d}") for f in fs) for d in stamps}
    once = run(f"{tmp_path}/once")
    assert rows_of(once.drop("batch")) == rows_of(done.drop("batch"))
    assert {r.batch for r in done.collect()} == {0, 1} and {r.batch for r in once.collect()} == {0}


def test_a_batch_that_was_cut_off_is_written_anew(spark, corpus, tmp_path, monkeypatch):
    _, docs, _ = corpus
    where, out = f"{tmp_path}/arriving", f"{tmp_path}/out"
    run = lambda: label_texts.run(spark, where, f"{SF}/documents.parquet", f"{SF}/labels.parquet", out)
    arrive(spark, [tuple(r) for r in docs[:20]], where)
    run()
    arrive(spark, [tuple(r) for r in docs[20:40]], where)
    whole = label_texts.labelled

    def cut(texts, atlas, k):
        """Writes what a run leaves that dies after half of its output, then dies."""
        whole(texts.limit(5), atlas, k).write.mode("overwrite").partitionBy("label").parquet(f"{out}/batch=1")
        raise RuntimeError("lost")

    monkeypatch.setattr(label_texts, "labelled", cut)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(label_texts, "labelled", whole)
    got = run().collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs[:40])


def test_odd_texts(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, equal texts, no atlas, nothing that arrives."""
    long = "ab c" * 700_000
    rows = [(None, "no id", "s"), (1, None, None), (2, "", "s"), (3, long, "s"), (4, "twice", "s"), (4, "also", "s"), (5, "same", "s"), (6, "same", ""), (7, "x", "s")]
    atlas = [(10, "same", 0), (11, "same", 1), (12, long, 1), (13, None, 0), (5, "same", 0)]
    where, guide, labels = f"{tmp_path}/arriving", f"{tmp_path}/atlas", f"{tmp_path}/labels"
    arrive(spark, rows, where)
    spark.createDataFrame([(i, t, 3) for i, t, _ in atlas], "doc_id long, text string, source int").write.parquet(guide)
    spark.createDataFrame([(i, label) for i, _, label in atlas] + [(99, 1), (None, 1)], "doc_id long, toxic int").write.parquet(labels)
    got = label_texts.run(spark, where, guide, labels, f"{tmp_path}/out", label="toxic", neighbours=2).collect()
    texts = {i: t for i, t, _ in sorted(rows[1:], key=lambda r: (r[0], r[1] or ""), reverse=True)}
    same(got, brute_labels(list(texts.items()), atlas, 2))
    assert {r.doc_id: r.source for r in got} == {1: None, 2: "s", 3: "s", 4: "s", 5: "s", 6: "", 7: "s"}
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/none")
    got = label_texts.run(spark, where, guide, f"{tmp_path}/none", f"{tmp_path}/out2", label="toxic").collect()
    assert len(got) == 7 and {(r.label, r.votes, r.nearest) for r in got} == {(None, None, None)}
    os.makedirs(f"{tmp_path}/nothing")
    assert rows_of(label_texts.run(spark, f"{tmp_path}/nothing", guide, labels, f"{tmp_path}/out3", label="toxic")) == []


def test_profile_in_blocks():
    data = bytes(np.random.default_rng(1).integers(0, 256, 1000, np.uint8))
    want = label_texts.profile(data)
    assert all((label_texts.profile(data, block=n) == want).all() for n in (1, 7, 999, 1000, 1001)) and want.sum() == 999
