"""LM scoring: a gated recurrent model with a class-factored softmax over the common words, beside smoothed counts."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import byte_blocks, release, spill

#: The end of a text, which no word equals.
END = b""
BLOCK = 2048
LIMIT = 60.0


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, null as empty, and the end."""
    out: list[bytes] = []
    for part in byte_blocks((text or "").encode()):
        out += part
    out.append(END)
    return out


@dataclass(frozen=True)
class Config:
    """head: words whose counts every task holds, of at most max_bytes bytes each; vocab: those the network models.

    Every window of `chunk` words of every training document is trained on once. lanes and train_lanes step together;
    the update is made each `window` steps of a lane, which is where back-propagation ends. rounds: how often copies are
    averaged; copy_words: about how many words a copy learns from in a round. group_words: words that a task scores at a
    time, so that long texts, whose lanes end last, share their steps with others.
    """

    head: int = 65536
    max_bytes: int = 64
    vocab: int = 2048
    classes: int = 48
    dim: int = 16
    hidden: int = 16
    chunk: int = 256
    window: int = 32
    train_lanes: int = 256
    lanes: int = 512
    step: float = 0.01
    rounds: int = 4
    copy_words: int = 500_000
    group_words: int = 4_000_000


# ------------------------------------------------------------------------------------------------------- counts


def token_counts(docs: DataFrame, text_col: str, flush: int = 400_000) -> DataFrame:
    """(token, n) over all rows of docs; each task sums what it reads before the shuffle, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["token", "n"])

        for b in batches:
            for t in b.column(0):
                c.update(words_of(t.as_py()))
                if len(c) > flush:
                    yield out()
                    c.clear()
        yield out()

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------------------------------------------- network


@dataclass
class Net:
    """Weights: emb [V+1, D], wx [D, 3H], b [3H], u [H, 3H], wc [H, C+1], bc [C+1], ww [V, H], bw [V].

    Words are numbered by class; class c has the words cuts[c]:cuts[c+1]. Number V and class C stand for all rare words.
    """

    cfg: Config
    cuts: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def vocab(self) -> int:
        return int(self.cuts[-1])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(np.float32)

    def loaded(self, v: np.ndarray) -> Net:
        out, at = {}, 0
        for k in sorted(self.p):
            n = self.p[k].size
            out[k] = v[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return replace(self, p=out)


def new_net(cfg: Config, counts: list[int], rare: int) -> tuple[Net, np.ndarray]:
    """A network that starts as the unigram model of the counts (most frequent first), and each word's number.

    Classes hold words of near frequency, of about even sums of square roots, so that none is large.
    """
    v, h, d = len(counts), cfg.hidden, cfg.dim
    n = np.maximum(np.array(counts, np.float64), 1.0)
    mass = np.cumsum(np.sqrt(n))
    c = max(1, min(cfg.classes, v))
    cls = np.minimum((mass / mass[-1] * c).astype(int), c - 1) if v else np.zeros(0, int)
    cuts = np.searchsorted(cls, np.arange(c + 1)) if v else np.zeros(c + 1, int)
    rng = np.random.default_rng(11)
    per_class = np.array([n[cuts[i] : cuts[i + 1]].sum() for i in range(c)] + [max(rare, 1)])
    draw = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
    p = {"emb": draw(v + 1, d), "wx": draw(d, 3 * h), "b": np.zeros(3 * h, np.float32), "u": draw(h, 3 * h), "wc": draw(h, c + 1) * 0, "bc": np.log(np.maximum(per_class, 0.5) / per_class.sum()).astype(np.float32), "ww": draw(v, h) * 0, "bw": np.concatenate([np.log(n[cuts[i] : cuts[i + 1]] / per_class[i]) for i in range(c)] or [np.zeros(0)]).astype(np.float32)}
    return Net(cfg, cuts, p), np.append(cls, c)


def _order(x: np.ndarray, most: int) -> np.ndarray:
    """The stable order of numbers from 0 to most; 16 bits are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if most < 1 << 16 else x, kind="stable")


class Runner:
    """Steps of a network over lanes of words; the state h of each lane goes on from window to window.

    Gates are kept apart, as [3, lanes, H] arrays (reset, update, candidate), so that all arithmetic runs over whole
    arrays.
    """

    def __init__(self, net: Net, cls: np.ndarray, lanes: int):
        self.net, self.cls = net, cls
        self.h = np.zeros((lanes, net.cfg.hidden), np.float32)
        self.refresh()

    def _gates(self, w: np.ndarray) -> np.ndarray:
        """[N, 3H] as [3, N, H]."""
        return np.ascontiguousarray(w.reshape(len(w), 3, -1).transpose(1, 0, 2))

    def refresh(self) -> None:
        p = self.net.p
        self.u, self.wx = self._gates(p["u"]), self._gates(p["wx"])
        self.x = p["emb"] @ self.wx + p["b"].reshape(3, 1, -1)
        # states lie within 1, so these bound the logits
        most = lambda w, b: float((np.abs(w).sum(axis=1) + np.abs(b)).max(initial=0))
        self.clip_c, self.clip_w = most(p["wc"].T, p["bc"]) > LIMIT, most(p["ww"], p["bw"]) > LIMIT

    def forward(self, prev: np.ndarray, fresh: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """States [T, B, H] after each word of prev [T, B]; fresh marks where a lane's state starts anew."""
        t, b = prev.shape
        hid, kind = self.net.cfg.hidden, self.x.dtype
        out = np.empty((t, b, hid), kind)
        gates, inner = (np.empty((t if keep else 1, 3, b, hid), kind) for _ in range(2))
        before = np.empty((t if keep else 0, b, hid), kind)
        h, some = self.h[:b].astype(kind), fresh.any(axis=1)
        with np.errstate(over="ignore"):
            for i in range(t):
                if some[i]:
                    h = np.where(fresh[i][:, None], kind.type(0), h)
                g, c = gates[i if keep else 0], inner[i if keep else 0]
                for k in range(3):
                    self.x[k].take(prev[i], axis=0, out=g[k], mode="clip")
                np.matmul(h, self.u, out=c)
                rz, n = g[:2], g[2]
                rz += c[:2]
                np.negative(rz, out=rz)
                np.exp(rz, out=rz)
                rz += 1
                np.reciprocal(rz, out=rz)
                n += g[0] * c[2]
                np.tanh(n, out=n)
                if keep:
                    before[i] = h
                new = np.subtract(h, n, out=out[i])
                new *= g[1]
                new += n
                h = new
        self.h[:b] = h
        return out, (before, gates, inner)

    def losses(self, hs: np.ndarray, want: np.ndarray, grad: bool = False):
        """ln P of each wanted word given its state; with grad also what the loss's gradients need."""
        p, cuts = self.net.p, self.net.cuts
        cls = self.cls[want]
        # by class, so that each class's rows are one slice
        order = _order(cls, len(cuts))
        hs, want, cls = hs[order], want[order], cls[order]
        ends = np.searchsorted(cls, np.arange(len(cuts)))
        row = np.arange(len(want))
        # logits are kept within LIMIT, where neither sums nor their logarithms overflow: no row needs its own maximum
        e = hs @ p["wc"]
        e += p["bc"]
        if self.clip_c:
            np.clip(e, -LIMIT, LIMIT, out=e)
        lp = e[row, cls]
        np.exp(e, out=e)
        one = np.ones(max(e.shape[1], int(np.diff(cuts).max(initial=0))), e.dtype)
        s = e @ one[: e.shape[1]]
        lp -= np.log(s)
        if grad:
            e *= np.reciprocal(s)[:, None]
            e[row, cls] -= 1
            g = {"wc": hs.T @ e, "bc": e.sum(axis=0), "ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"])}
            dh = e @ p["wc"].T
        for c in range(len(cuts) - 1):
            lo, hi = ends[c], ends[c + 1]
            a, z = cuts[c], cuts[c + 1]
            if lo == hi or z - a < 2:
                continue
            hc, w, k = hs[lo:hi], want[lo:hi] - a, row[: hi - lo]
            ex = hc @ p["ww"][a:z].T
            ex += p["bw"][a:z]
            if self.clip_w:
                np.clip(ex, -LIMIT, LIMIT, out=ex)
            part = ex[k, w]
            np.exp(ex, out=ex)
            sx = ex @ one[: z - a]
            lp[lo:hi] += part - np.log(sx)
            if grad:
                ex *= np.reciprocal(sx)[:, None]
                ex[k, w] -= 1
                g["ww"][a:z] = ex.T @ hc
                g["bw"][a:z] = ex.sum(axis=0)
                dh[lo:hi] += ex @ p["ww"][a:z]
        back = np.empty(len(order), np.int64)
        back[order] = row
        return (lp[back], g, dh[back]) if grad else lp[back]

    def gradients(self, prev: np.ndarray, fresh: np.ndarray, want: np.ndarray, valid: np.ndarray) -> tuple[float, dict]:
        """Mean loss of a window over its valid places and the gradients, truncated at the window's start."""
        t, b = prev.shape
        hid, p, kind = self.net.cfg.hidden, self.net.p, self.x.dtype
        hs, (before, gates, inner) = self.forward(prev, fresh, keep=True)
        ok = valid.ravel()
        if ok.all():
            lp, g, part = self.losses(hs.reshape(-1, hid), want.ravel(), grad=True)
            dout = part.reshape(t, b, hid)
        else:
            lp, g, part = self.losses(hs.reshape(-1, hid)[ok], want.ravel()[ok], grad=True)
            dout = np.zeros((t * b, hid), kind)
            dout[ok] = part
            dout = dout.reshape(t, b, hid)
        r, z, n = (gates[:, k] for k in range(3))
        # what a state's gradient is multiplied by for each gate, for the whole window at once
        keep_z = 1 - z
        by_n = keep_z * (1 - n * n)
        by_z = (before - n) * z * keep_z
        by_r = by_n * inner[:, 2] * r * (1 - r)
        by_h = by_n * r
        # gradients at the gates, and for the third at the recurrent part of it
        dhu, dn = np.empty((t, 3, b, hid), kind), np.empty((t, b, hid), kind)
        dh = np.zeros((b, hid), kind)
        ut, some = np.ascontiguousarray(self.u.transpose(0, 2, 1)), fresh.any(axis=1)
        for i in range(t - 1, -1, -1):
            dh += dout[i]
            np.multiply(dh, by_r[i], out=dhu[i, 0])
            np.multiply(dh, by_z[i], out=dhu[i, 1])
            np.multiply(dh, by_n[i], out=dn[i])
            np.multiply(dh, by_h[i], out=dhu[i, 2])
            back = dhu[i] @ ut
            dh *= z[i]
            dh += back[0]
            dh += back[1]
            dh += back[2]
            if some[i]:
                dh[fresh[i]] = 0
        # the steps' products, summed from the last step to the first
        du = np.matmul(before.transpose(0, 2, 1)[:, None], dhu)[::-1].sum(axis=0)
        words = prev.ravel()
        order = _order(words, self.net.vocab)
        first = np.flatnonzero(np.diff(words[order], prepend=-1))
        seen = words[order[first]]
        demb, emb = np.zeros_like(p["emb"]), p["emb"][seen]
        dwx, db = np.empty_like(self.wx), np.empty((3, hid), kind)
        for k in range(3):
            per = np.add.reduceat((dhu[:, k] if k < 2 else dn).reshape(-1, hid)[order], first)
            demb[seen] += per @ self.wx[k].T
            dwx[k], db[k] = emb.T @ per, per.sum(axis=0)
        flat = lambda w: w.transpose(1, 0, 2).reshape(w.shape[1], -1)
        g |= {"u": flat(du), "b": db.ravel(), "wx": flat(dwx), "emb": demb}
        n_all = max(1, int(ok.sum()))
        return -float(lp.sum()) / n_all, {k: v / n_all for k, v in g.items()}


def train(net: Net, cls: np.ndarray, chunks: Iterator[np.ndarray], start: int) -> tuple[Net, int]:
    """The network after Adam steps over the windows of the chunks (numbers of words), and how many words it saw."""
    cfg = net.cfg
    net = net.loaded(net.flat())
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps = seen = 0
    held: list[np.ndarray] = []

    def lesson(group: list[np.ndarray]) -> None:
        nonlocal steps, seen
        run = Runner(net, cls, len(group))
        size = max(len(c) for c in group) - 1
        grid = np.full((size + 1, len(group)), start, np.int64)
        sizes = np.array([len(c) for c in group])
        for j, c in enumerate(group):
            grid[: len(c), j] = c
        for at in range(0, size, cfg.window):
            part = grid[at : at + cfg.window + 1]
            fresh = np.zeros((len(part) - 1, part.shape[1]), bool)
            there = np.arange(at + 1, at + len(part))[:, None] < sizes
            if not there.any():
                continue
            _, g = run.gradients(part[:-1], fresh, part[1:], there)
            steps += 1
            seen += int(there.sum())
            norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
            cut = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            rate, grow = np.float32(cfg.step / (1 - 0.9**steps)), np.float32(1 / (1 - 0.99**steps))
            for k, v in g.items():
                v *= cut
                m[k] += np.float32(0.1) * (v - m[k])
                v *= v
                v -= s[k]
                v *= np.float32(0.01)
                s[k] += v
                np.multiply(s[k], grow, out=v)
                np.sqrt(v, out=v)
                v += np.float32(1e-7)
                np.divide(m[k], v, out=v)
                v *= rate
                net.p[k] -= v
            run.refresh()

    def lessons() -> None:
        # windows of near length together, so that few places of a lesson are empty; the order of lessons is mixed again
        held.sort(key=len)
        groups = [held[a : a + cfg.train_lanes] for a in range(0, len(held), cfg.train_lanes)]
        for j in np.random.default_rng(len(held)).permutation(len(groups)).tolist():
            lesson(groups[j])
        held.clear()

    for c in chunks:
        held.append(c)
        if len(held) >= 8 * cfg.train_lanes:
            lessons()
    lessons()
    return net, seen


def score(net: Net, cls: np.ndarray, docs: list[np.ndarray], start: int) -> np.ndarray:
    """ln P of each document (numbers of words with the end), each from a fresh state, carried over its windows.

    Documents are dealt to lanes of near length, which step together; longer lanes go first, so ended ones drop off.
    """
    cfg = net.cfg
    if not docs:
        return np.zeros(0)
    k = min(cfg.lanes, len(docs))
    heap = [(0, j) for j in range(k)]
    lanes: list[list[int]] = [[] for _ in range(k)]
    for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, j = heapq.heappop(heap)
        lanes[j].append(d)
        heapq.heappush(heap, (n + len(docs[d]), j))
    lanes = sorted((x for x in lanes if x), key=lambda x: -sum(len(docs[d]) for d in x))
    every = [d for x in lanes for d in x]
    words = np.concatenate([docs[d] for d in every])
    owner = np.repeat(np.array(every), [len(docs[d]) for d in every])
    size = np.array([sum(len(docs[d]) for d in x) for x in lanes])
    first = np.cumsum(size) - size
    run, out = Runner(net, cls, len(lanes)), np.zeros(len(docs))
    last = np.full(len(lanes), -1)
    prev_word = np.full(len(lanes), start)
    states: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def weigh() -> None:
        # the softmax of many windows at once: few lanes are left at the end of a long text
        hs, want, own = (np.concatenate(x) for x in zip(*states, strict=True))
        np.add(out, np.bincount(own, weights=run.losses(hs, want), minlength=len(docs)), out=out)
        states.clear()

    rows = 0
    for at in range(0, int(size[0]), cfg.window):
        b = int(np.searchsorted(-size, -at, side="left"))
        place = np.arange(at, at + cfg.window)[:, None]
        there, place = place < size[:b], np.minimum(place, size[:b] - 1) + first[:b]
        want = np.where(there, words[place], start)
        own = np.where(there, owner[place], -1)
        before = np.vstack([last[:b], own[:-1]])
        fresh = (own != before) & (own >= 0)
        prev = np.vstack([prev_word[:b], want[:-1]])
        prev[fresh] = start
        hs, _ = run.forward(prev, fresh)
        valid = own.ravel() >= 0
        states.append((hs.reshape(-1, cfg.hidden)[valid], want.ravel()[valid], own.ravel()[valid]))
        rows += len(states[-1][1])
        if rows >= 1 << 14:
            weigh()
            rows = 0
        last[:b], prev_word[:b] = own[-1], want[-1]
    if states:
        weigh()
    return out


# ------------------------------------------------------------------------------------------------------- whole tables


def _numbers(words: list[bytes], index: dict[bytes, int], other: int) -> np.ndarray:
    """Each word's number, `other` for words that have none."""
    return np.fromiter(map(index.get, words, repeat(other)), np.int64, len(words))


def _chunks(texts: Iterator[str | None], index: dict[bytes, int], cfg: Config, start: int) -> Iterator[np.ndarray]:
    """All windows of the texts: the word before each, then its words, as numbers; len(index) is any other word's."""
    for text in texts:
        words = words_of(text)
        n = len(words)
        ids = np.concatenate(([start], _numbers(words, index, len(index))))
        for i in range(0, n, cfg.chunk):
            yield ids[i : i + cfg.chunk + 1]


def _summed(parts: DataFrame, fan: int = 64) -> DataFrame:
    """(block, seen, v) with a row a block: weights summed in a tree, `fan` rows of a block at most in each task's turn."""

    def add(t: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x.as_py(), np.float64) for x in t.column("v"))
        return pa.table({"block": t.column("block").slice(0, 1), "part": t.column("part").slice(0, 1), "seen": pa.array([sum(t.column("seen").to_pylist())], pa.int64()), "v": pa.array([v.tobytes()], pa.binary())})

    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while n > 1:
        n = -(-n // fan)
        parts = parts.withColumn("part", F.floor(F.col("part") / fan)).groupBy("block", "part").applyInArrow(add, "block int, part long, seen long, v binary")
    return parts


def dealt(docs: DataFrame, id_col: str, text_col: str, rounds: int, copies: int) -> DataFrame:
    """(t, h, round, copy): each row's round and copy, by a hash of its id and text, whatever partition it lies in.

    Copies of a text go their own ways by their ids. Rows without one are dealt by their place in the table instead, so
    that a text which very many of them hold is not one copy's.
    """
    place = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    x = docs.select(F.col(text_col).alias("t"), F.xxhash64(F.col(id_col), F.col(text_col), place).alias("h"))
    return x.withColumn("round", F.pmod("h", F.lit(rounds)).cast("int")).withColumn("copy", F.pmod(F.xxhash64("h"), F.lit(copies)).cast("int"))


def fit(docs: DataFrame, id_col: str, text_col: str, head: list[tuple[bytes, int]], total: int, cfg: Config) -> tuple[Net, np.ndarray, np.ndarray, int]:
    """(network, classes, number of each head word, number of the end) learned from all rows of docs.

    The network starts as the unigram model of the counts. Documents are dealt by hash to cfg.rounds rounds, and in each
    to as many copies of the network as hold cfg.copy_words of its words each. In a round every copy starts from the last
    average and is trained, by truncated backpropagation, on all windows of all its documents, in the order of their
    hashes; then the copies are averaged, weighted by the words they saw. So every window is trained on once, and the
    result follows from the rows and `total`, the words, not from how the table is partitioned (null ids apart).
    A copy's documents stream through its task. Weights are averaged in blocks on the executors; one network a round
    comes to the driver.
    """
    spark = docs.sparkSession
    model = [t for t, _ in head[: cfg.vocab]]
    if END not in model:
        model = [*model[: cfg.vocab - 1], END]
    have = dict(head)
    net, cls = new_net(cfg, [have.get(t, 1) for t in model], total - sum(have.get(t, 0) for t in model))
    at = {t: i for i, t in enumerate(model)}
    number = np.array([at.get(t, len(model)) for t, _ in head] + [len(model)], np.int64)  # the last, index -1: not in the head
    start = at[END]
    copies = max(1, round(total / (cfg.rounds * cfg.copy_words)))
    rows = dealt(docs, id_col, text_col, cfg.rounds, copies)
    for turn in range(cfg.rounds):
        sent = spark.sparkContext.broadcast((net, cls, at))  # at most vocab words of max_bytes, and the weights

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            net, cls, at = sent.value
            texts = ((c.as_py(), t.as_py()) for b in batches for c, t in zip(b.column(0), b.column(1), strict=True))
            for copy, own in groupby(texts, key=lambda x: x[0]):
                got, seen = train(net, cls, _chunks((t for _, t in own), at, cfg, start), start)
                v = got.flat().astype(np.float64) * seen
                cuts = range(0, len(v), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK for a in cuts], pa.int32()), pa.array([copy] * len(cuts), pa.int64()), pa.array([seen] * len(cuts), pa.int64()), pa.array([v[a : a + BLOCK].tobytes() for a in cuts], pa.binary())], names=["block", "part", "seen", "v"])

        now = rows.filter(F.col("round") == turn).repartitionById(copies, "copy").sortWithinPartitions("copy", "h", "t")
        made = spill(now.select("copy", "t").mapInArrow(run, "block int, part long, seen long, v binary"), "weights")
        got = sorted((r["block"], np.frombuffer(bytes(r["v"]), np.float64) / r["seen"]) for r in _summed(made).collect())
        release(made)
        if got:
            net = net.loaded(np.concatenate([v for _, v in got]).astype(np.float32))
        sent.unpersist()
    return net, cls, number, start


def _commonest(counts: DataFrame, cfg: Config) -> list[tuple[bytes, int]]:
    """The commonest words, most frequent first: as many whole grades of frequency as cfg.head words hold.

    Grades are 64 a doubling, so their table is small however many words there are; then only the head itself comes
    to the driver.
    """
    short = counts.filter(F.octet_length("token") <= cfg.max_bytes).withColumn("grade", F.floor(F.log2("n") * 64).cast("int"))
    left, cut = cfg.head, None
    for r in sorted(short.groupBy("grade").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["grade"]):
        if (left := left - r["k"]) < 0:
            break
        cut = r["grade"]
    top = [] if cut is None else short.filter(F.col("grade") >= cut).collect()
    return sorted(((r["token"].encode(), r["n"]) for r in top), key=lambda x: (-x[1], x[0]))


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", cfg: Config | None = None) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Tokens are the lower-cased words and one end; a null text has the end alone. base_score: log10 of the product of
    (c + 1) / (N + V + 1), c a token's count in the rows where `training` holds (null: not), N all, V distinct ones.
    score: the network's log10 probability of the whole text. A rare word's is that of a rare word at its place, times
    (c + 1) / (n + v + 1), n and v the sum and number of rare words; words never seen share the +1.

    Counts cover all training rows. The commonest words' counts go to every task (cfg.head words of max_bytes at most);
    the others are joined by word, a document's distinct words at a time. No training row: N and V are 0, and the
    network is untrained. Repeated rows are scored each; null ids are kept; an empty table gives an empty result.
    A very long text is scored whole, in one lane whose state goes on; its words are held by one task.
    """
    cfg = cfg or Config()
    spark = docs.sparkSession
    flag = F.coalesce(training, F.lit(False))
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), flag.alias("train"))
    seen = x.filter("train")
    counts = spill(token_counts(seen, "t"), "counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head = _commonest(counts, cfg)
    net, cls, number, start = fit(seen, "id", "t", head, sums["n"], cfg)
    c = np.array([n for _, n in head] + [0], np.float64)
    is_rare = number == net.vocab
    n_rare, v_rare = sums["n"] - float(c[~is_rare].sum()), sums["v"] - int(((c > 0) & ~is_rare).sum())
    sent = spark.sparkContext.broadcast(({t: i for i, (t, _) in enumerate(head)}, net, cls, number, start, np.log10(c + 1)))
    kind = x.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, net, cls, number, start, lc = sent.value
        row = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        docs: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            nonlocal held, docs
            g = score(net, cls, docs, start) / np.log(10)
            cols = list(zip(*held, strict=True))
            ids = pa.array(cols[1], id_type)
            done = pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), ids, pa.array(cols[2], pa.bool_()), *[pa.array(cols[i], pa.int64()) for i in (3, 4, 5)], *[pa.array(cols[i], pa.float64()) for i in (6, 7)], pa.array(g, pa.float64()), pa.array(cols[8], pa.list_(pa.string())), pa.array(cols[9], pa.list_(pa.int32()))],
                names=["rid", "id", "train", "n_tokens", "n_head", "n_rare", "s_head", "s_rare", "g", "tail", "tail_n"],
            )
            held, docs = [], []
            return done

        id_type, load = None, 0
        for b in batches:
            id_type = b.column(0).type
            for key, t, tr in zip(b.column(0), b.column(1), b.column(2), strict=True):
                w = words_of(t.as_py())
                at = _numbers(w, index, -1)
                nums = number[at]
                rare = nums == net.vocab
                tail = Counter(map(w.__getitem__, np.flatnonzero(at < 0).tolist()))
                s = lc[at]
                held.append((row, key.as_py(), tr.as_py(), len(w), int((at >= 0).sum()), int(rare.sum()), float(s.sum()), float(s[rare].sum()), list(tail), list(tail.values())))
                docs.append(nums.astype(np.int32))
                row, load = row + 1, load + len(w)
                if load >= cfg.group_words:
                    yield out()
                    load = 0
        if held:
            yield out()

    schema = f"rid long, id {kind}, train boolean, n_tokens long, n_head long, n_rare long, s_head double, s_rare double, g double, tail array<string>, tail_n array<int>"
    part = spill(x.mapInArrow(run, schema), "scores")
    tail = part.select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("w")).select("rid", F.col("w.tail").alias("word"), F.col("w.tail_n").alias("k"))
    met = tail.join(counts, F.col("word") == F.col("token"))
    per = met.groupBy(F.col("rid").alias("r")).agg(F.sum("k").alias("tail_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("tail_s"))
    y = part.drop("tail", "tail_n").join(per, F.col("rid") == F.col("r"), "left")
    tail_s = F.coalesce("tail_s", F.lit(0.0))
    nt, base = F.lit(sums["n"]).cast("long"), float(np.log10(sums["n"] + sums["v"] + 1))
    rare = float(np.log10(n_rare + v_rare + 1))
    return y.select(
        F.col("id").alias(id_col), "train", "n_tokens", (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), nt.alias("train_tokens"),
        (F.col("s_head") + tail_s - F.col("n_tokens") * base).alias("base_score"), (F.col("g") + F.col("s_rare") + tail_s - F.col("n_rare") * rare).alias("score"),
    )
