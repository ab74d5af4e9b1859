"""Language ID by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTER = regex.compile(r"\p{L}")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str, buckets: int, block: int = 1 << 20) -> np.ndarray:
    """Counts of byte 1- to 4-grams of the lower-cased letters, hashed to buckets, as a unit vector of square roots.

    Everything but letters is one space; texts are read in blocks that overlap, so every n-gram counts.
    """
    data = text.lower().encode().translate(_TABLE)
    out = np.zeros(buckets, np.float64)
    for at in range(0, max(len(data), 1), block):
        b = np.frombuffer(data[max(0, at - 3) : at + block], np.uint8).astype(np.uint32)
        skip = at - max(0, at - 3)
        g = b.copy()
        for n in range(1, 5):
            if n > 1:
                g = g[:-1] * np.uint32(0x9E3779B1) + b[n - 1 :]
            h = (g ^ np.uint32(n * 0x7FEB352D & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            # an n-gram belongs to the block that its last byte is in
            out += np.bincount((h[max(0, skip - n + 1) :] >> np.uint32(16)) % np.uint32(buckets), minlength=buckets)
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


def code_matrix(classes: int, bits: int | None = None, apart: int = 3, seed: int = 7) -> np.ndarray:
    """A codeword of signs for each class, any two of them at least `apart` bits from each other where classes allow.

    No two bits split the classes alike, and none puts all on one side. Up to five classes have every split as a bit,
    2^(classes - 1) - 1 of them, at distance 2^(classes - 2); more have `bits` random ones (by default 5 for each
    binary digit of their number), the best separated of a number of draws, and eight more until they are apart.
    """
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= 5:
        splits = np.arange(1, 1 << (classes - 1))
        return np.where(splits[None, :] << 1 >> np.arange(classes)[:, None] & 1, -1, 1).astype(np.int8)
    rng = np.random.default_rng(seed)
    bits = min(bits or max(15, 5 * classes.bit_length()), 2 ** (classes - 1) - 1)
    while True:
        best, gap = None, -1
        for _ in range(50):
            m = np.zeros((classes, 0), np.int8)
            while m.shape[1] < bits:
                m = np.concatenate([m, rng.choice(np.array([-1, 1], np.int8), size=(classes, bits))], axis=1)
                m = m[:, np.abs(m.sum(axis=0)) < classes]
                m = np.unique(m * m[:1], axis=1)
            m = m[:, rng.permutation(m.shape[1])[:bits]]
            d = ((bits - m.astype(int) @ m.T.astype(int)) // 2 + np.eye(classes, dtype=int) * bits).min()
            if d > gap:
                best, gap = m, d
        if gap >= apart or bits >= 2 ** (classes - 1) - 1:
            return best.astype(np.int8)
        bits = min(bits + 8, 2 ** (classes - 1) - 1)


@dataclass
class Model:
    """languages, their codewords, and a linear classifier for each bit of the codewords."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    buckets: int
    min_margin: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score in 0..1, ambiguous); `und` with score 0 for a null text or one with no letter.

        Loss-weighted decoding: the codeword with the least sum of logistic losses under the bits' margins. The score
        is its share when losses are turned to weights; a share that leads the next by under min_margin is ambiguous.
        """
        if text is None or not _LETTER.search(text):
            return "und", 0.0, False
        margin = features(text, self.buckets) @ self.weights + self.bias
        loss = np.logaddexp(0, -self.codes * margin).sum(axis=1)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        lead = share[order[0]] - (share[order[1]] if len(order) > 1 else 0.0)
        return self.languages[order[0]], float(min(1.0, share[order[0]])), bool(lead < self.min_margin)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = 1600, max_languages: int = 512, buckets: int = 4096, bits: int | None = None, min_margin: float = 0.1, epochs: int = 300) -> Model:
    """A model from the labelled rows of docs (text and lang not null; give training rows only).

    The classifiers are fitted on at most sample distinct texts in all, an even share of each language's: those of the
    smallest hashes. Whole texts are used, each once however often it is repeated, so a language of one text repeated has
    one row and languages weigh alike. The sample and max_languages (languages beyond it are an error) bound what comes to
    the driver: sample vectors of `buckets` numbers. Ids and sources are no inputs. No labelled row: a model without
    languages, which predicts `und` for every text.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.lit("fit"), F.col(text_col)).alias("h"))
    langs = sorted(r["l"] for r in rows.select("l").distinct().limit(max_languages + 1).collect())
    if len(langs) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    if not langs:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((buckets, 1), np.float32), np.zeros(1, np.float32), buckets, min_margin)
    each = max(1, sample // len(langs))
    # Distinct texts under a share of the hashes that holds a few more of each language than are taken: none is sorted
    # whole. Of very many repeats each task gives on one row.
    rows = rows.filter(F.rlike("t", F.lit(r"\p{L}")))
    counts = {r["l"]: r["n"] for r in rows.select("l", "h").distinct().groupBy("l").agg(F.count("*").alias("n")).collect()}
    # four deviations more than are taken, so that these are there
    most = F.create_map(*[x for c in langs for x in (F.lit(c), F.lit(min(1.0, (each + 4 * each**0.5 + 4) / max(1, counts.get(c, 0)))))])
    pick = (F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < most[F.col("l")]
    picked = rows.filter(pick).groupBy("l", "h").agg(F.min("t").alias("t"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [features(t.as_py(), buckets).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(v, pa.binary())], names=["l", "h", "v"])

    found = sorted((r["l"], r["h"] % (1 << 64), bytes(r["v"])) for r in picked.mapInArrow(vectors, "l string, h long, v binary").collect())
    kept: dict[str, list[bytes]] = {c: [] for c in langs}
    for c, _, v in found:
        if len(kept[c]) < each:
            kept[c].append(v)
    x = np.stack([np.frombuffer(v, np.float32) for c in langs for v in kept[c]]) if any(kept.values()) else np.zeros((0, buckets), np.float32)
    y = np.repeat(np.arange(len(langs)), [len(kept[c]) for c in langs])
    codes = code_matrix(len(langs), bits)
    w, b = _logistic(x, codes[y].astype(np.float32), np.bincount(y, minlength=len(langs))[y], epochs)
    return Model(langs, codes, w, b, buckets, min_margin)


def _logistic(x: np.ndarray, t: np.ndarray, per: np.ndarray, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression for all bits at once, by Nesterov's gradient steps; languages weigh alike."""
    n, d = x.shape
    w, b = np.zeros((d, t.shape[1]), np.float32), np.zeros(t.shape[1], np.float32)
    if not n:
        return w, b
    share = (1.0 / per / (1.0 / per).sum()).astype(np.float32)[:, None]
    vw, vb, rate = np.zeros_like(w), np.zeros_like(b), 4.0
    for _ in range(epochs):
        lw, lb = w + 0.9 * vw, b + 0.9 * vb
        g = -t / (1 + np.exp(np.clip(t * (x @ lw + lb), -30, 30))) * share
        vw, vb = 0.9 * vw - rate * (x.T @ g + 1e-5 * lw), 0.9 * vb - rate * g.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs with the predicted language, its score and whether it is ambiguous (columns of these names are replaced).

    Whole texts are read, in blocks, however long. Null texts and texts without letters are `und` with score 0. Languages
    that score alike: the first by name. Null ids are kept, repeated rows are judged each. Empty table: empty result.
    """
    rest = [c for c in docs.columns if c not in out]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages * bits + buckets * bits numbers
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in rest]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            p = [m.predict(t.as_py()) if m.languages else ("und", 0.0, False) for t in b.column(text_col)]
            cols = [pa.array([r[i] for r in p], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *out])

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, f"{kinds}, {out[0]} string, {out[1]} double, {out[2]} boolean")


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves `fold` modulo folds; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
