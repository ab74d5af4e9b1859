"""SimHash near-dedup: fingerprints of word shingles, linked by multi-index hashing, grouped by components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import byte_blocks, give_back, lower_blocks, release, spill
from voxelweave.llm.components import components

#: Odd multipliers of the finaliser that gives further words of a wide fingerprint.
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 (UTF-8, seed 42) of the text's k-word shingles in order, in blocks; A-Z is lower-cased first.

    Fewer than k words: the whole sequence is one shingle. No word: nothing.
    """
    h = xxhash.xxh64_intdigest
    tail: list[bytes] = []
    some = False
    for words in byte_blocks((text or "").encode()):
        words = tail + words
        if len(words) >= k:
            some = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
            spans = zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)
            yield np.array([h(joined[a:b], 42) for a, b in spans], np.uint64)
            tail = words[len(words) - k + 1 :]
        else:
            tail = words
    if tail and not some:
        yield np.array([h(b" ".join(tail), 42)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: one to one, every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _word(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th 64-bit word of a shingle's wide hash; the first is the hash itself."""
    if not i:
        return h
    return _mixed(h + np.uint64(_MIX[2] * i & (1 << 64) - 1))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of 64 bits is set; summed in bytes over 255 rows at a time."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 128):
        bits = np.unpackbits(h[at : at + 255 * 128].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            out += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if whole < len(bits):
            out += bits[whole:].sum(axis=0, dtype=np.uint8)
    return out


def fingerprint(text: str | None, k: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit number: a bit is 1 if set in over half the shingles' hashes.

    Repeated shingles count each. No word: zero. Texts are read in blocks, so a long one needs no more memory.
    """
    n, counts = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, k):
        n += len(h)
        counts += _bit_counts(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp) for each row of docs; null texts have the fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), k) for t in b.column(1)], pa.int64())], names=["id", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def segments(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: 64 bits dealt as evenly as they go."""
    cuts = [round(64 * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _ball(x: Column, width: int, radius: int) -> Column:
    """Keys that differ from x in one of its zero bits (radius 1; none for radius 0).

    Of two keys at distance 1 one has the other in this half of its ball, so no pair is looked up twice.
    """
    if radius not in (0, 1):
        raise ValueError("balls of radius 0 and 1 are built")
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(width if radius else 0)]).cast("array<long>")
    return F.transform(F.filter(bits, lambda f: x.bitwiseAND(f) == 0), lambda f: x.bitwiseOR(f))


def in_blocks(df: DataFrame, group: str, row: str, size: Column, most: int) -> DataFrame:
    """df with `unit` long: each group's rows dealt to blocks, every two of which meet in one unit.

    A group whose sizes sum to `most` or less is one unit; of a larger one, the rows are dealt by the hash of `row` to
    blocks of about `most`, and come once for each block that theirs meets. So no group is one task's alone, and any
    two rows of a group share a unit.
    """
    large = df.groupBy(F.col(group).alias("__g")).agg(F.ceil(F.sum(size) / most).cast("int").alias("__blocks")).filter("__blocks > 1")
    x = df.join(large, F.col(group) == F.col("__g"), "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    x = x.withColumn("__own", F.expr(f"pmod(xxhash64(`{row}`), __blocks)")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    unit = F.when(F.col("__blocks") == 1, F.col(group)).otherwise(F.xxhash64(group, F.least("__own", "__other"), F.greatest("__own", "__other")))
    return x.withColumn("unit", unit).drop("__g", "__blocks", "__own", "__other")


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    """df by its first order column in tasks, sorted; so many tasks as the session has shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order[0]).sortWithinPartitions(*order)


def _forest(ids: np.ndarray, near, root: np.ndarray | None = None, block: int = 1 << 12) -> list[tuple[int, int]]:
    """Links that join the rows as all pairs would for which near(row, other rows) holds: n - 1 at most.

    root: trees that the rows are in already, as numbers below n. near is asked of rows in different trees only.
    """
    n, out = len(ids), []
    root = np.arange(n) if root is None else root
    # rows outside the largest tree: all that its members have to meet
    largest = int(np.bincount(root, minlength=n).argmax())
    outside = np.flatnonzero(root != largest)
    for i in range(n):
        if not len(outside):
            break
        others = outside if root[i] == largest else np.flatnonzero(root != root[i])
        others = others[others > i]  # earlier rows have met i
        got = [part[near(i, part)] for part in (others[at : at + block] for at in range(0, len(others), block))]
        if not any(map(len, got)):
            continue
        got = np.concatenate(got)
        trees, first = np.unique(root[got], return_index=True)
        out += [(int(ids[i]), int(ids[j])) for j in got[first].tolist()]
        root[np.isin(root, trees)] = root[i]
        largest = int(np.bincount(root, minlength=n).argmax())
        outside = np.flatnonzero(root != largest)
    return out


def _pairs(x: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(x, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in (0, 1)], names=["src", "dst"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        first = int(np.searchsorted(key, key[-1]))
        if held and (first or held[-1].column(0)[-1].as_py() != key[-1]):
            yield pa.Table.from_batches([*held, b.slice(0, first)])
            held = []
        elif first:
            yield pa.Table.from_batches([b.slice(0, first)])
        held.append(b.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of each run of equal numbers."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True)


def _bucket_links(most: int):
    """Function over Arrow batches (unit, node) sorted by both: the links of each unit as a spanning forest.

    A node is its fingerprint. Rows are compared with those of other trees only, so n rows give at most n - 1 links,
    which join whatever the links of all pairs would.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            unit, fp = (t.column(i).to_numpy() for i in (0, 1))
            out = []
            for a, z in _runs(unit):
                v = np.unique(fp[a:z])
                out += _forest(v, lambda i, js, v=v: np.bitwise_count((v[js] ^ v[i]).view(np.uint64)) <= most)
            yield _pairs(out)
        give_back()

    return run


#: Rows of a bucket that one task compares at a time, and sets that one turn compares with their hub.
BLOCK, MEMBERS = 1 << 14, 1 << 8


def links(fps: DataFrame, most: int = 3, count: int = 2, radius: int = 1) -> DataFrame:
    """(src, dst) that join the rows of fps (node: distinct fingerprints) as all pairs within `most` bits would.

    Multi-index hashing: every fingerprint is entered in a table under each of its `count` segments, and looks up the
    ball of keys around each of them; table entries that a look-up meets are verified by their complete distance, in
    the join. Most buckets end there. In the others the links go on as a spanning forest, so the output stays below
    the number of entries whatever a bucket's size; large buckets are compared in blocks of rows. All links are found,
    as most < count * (radius + 1) is asked for.
    """
    if most >= count * (radius + 1) or count > 128:
        raise ValueError("these segments and balls don't find all pairs")
    segs = segments(count)
    if max(n for _, n in segs) > 56:
        raise ValueError("segments of 56 bits at most")
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def part(i: int) -> Column:
        first, width = segs[i]
        return F.shiftrightunsigned(F.col("node"), first).bitwiseAND((1 << width) - 1)

    def where(i: int):
        return lambda x: x.bitwiseOR(F.lit(i << 56)) if i else x

    own = F.array(*[where(i)(part(i)) for i in range(len(segs))])
    balls = F.flatten(F.array(*[F.transform(_ball(part(i), s[1], radius), where(i)) for i, s in enumerate(segs)]))
    table = spill(fps.select("node", F.explode(own).alias("key")), "table")
    probes = table.unionByName(fps.select("node", F.explode(balls).alias("key")))
    there = table.select(F.col("node").alias("n2"), F.col("key").alias("k2"))
    met = (F.col("key") == F.col("k2")) & (F.col("node") != F.col("n2")) & (F.bit_count(F.col("node").bitwiseXOR(F.col("n2"))) <= most)
    found = spill(probes.join(there, met, "left_semi").distinct(), "found")
    # Ball members need the entries they met; entries that met other entries are there already.
    live = found.select(F.col("key").alias("k2")).distinct()
    hit = table.join(live, F.col("key") == F.col("k2"), "left_semi")
    full = in_blocks(found.unionByName(hit).distinct(), "key", "node", F.lit(1), BLOCK).select("unit", "node")
    return _dealt(full, "unit", "node").mapInArrow(_bucket_links(most), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, most: int = 3, count: int = 2, radius: int = 1) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest id that links reach.

    Every pair of 64-bit fingerprints at `most` or fewer differing bits is a link. Equal fingerprints are one node, so
    copies never meet in pairs. Null and empty texts have the fingerprint zero and are linked like any other. Null ids
    take their class's component (null if all ids of it are null). Repeated rows are in one class. Other columns of
    docs are not read. Very long texts are read in blocks. Empty table: empty result.
    """
    fp = spill(fingerprints(docs, id_col, text_col, k), "fingerprints")
    nodes = spill(fp.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("least")), "nodes")
    cc = components(spill(links(nodes.select("node"), most, count, radius), "links")).select(F.col("node").alias("n"), "component")
    own = nodes.join(cc, F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    own = spill(own, "classes")
    named = own.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    own = own.join(named, F.col("component") == F.col("c")).select("node", "component_id")
    return fp.join(own, F.col("fp") == F.col("node")).select(F.col("id").alias(id_col), "fp", "component_id")


# ------------------------------------------------------------------------------------------------------- near copies

#: Sets with fewer shingles are not judged by their fingerprints, which ties and few votes make unsteady.
SMALL = 64


#: A number for each byte, an odd base, and the longest word that is hashed by these.
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MIX[2]))
_BASE, SHORT = 0xD1342543DE82EF95 | 2, 32


@lru_cache(maxsize=2)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2^64."""
    up = lambda x: np.cumprod(np.append(np.uint64(1), np.full(count - 1, x, np.uint64)))
    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


def _word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of data, in order: a polynomial in the base, from sums over all bytes; XXH64 of long words."""
    a = np.frombuffer(data, np.uint8)
    word = np.zeros(len(a) + 2, np.int8)
    np.logical_not((a - np.uint8(9) <= 4) | (a == 32), out=word[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(word))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(1 << max(14, len(a).bit_length()))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
    h = _mixed((sums[ends] - sums[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > SHORT).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], 42)
    return h


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct hashes of a text's k-word shingles, sorted: of the same words as shingle_hashes() takes, but a word
    is hashed once, and a shingle's hash is made of its words' ones by an odd factor for each place. Shingles of different
    words have one hash by chance alone, as with XXH64.

    Fewer than k words: the whole sequence is one shingle. No word: nothing.
    """
    out, tail = [], np.zeros(0, np.uint64)
    for data in lower_blocks((text or "").encode(), 1 << 16):
        h = np.concatenate([tail, _word_hashes(data)])
        if len(h) >= k:
            out.append(_placed(h, k))
        tail = h[max(0, len(h) - k + 1) :]
    if not out and len(tail):
        out.append(_placed(tail, len(tail)))
    h = np.sort(np.concatenate([np.zeros(0, np.uint64), *out]))
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def _placed(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k hashes in a row, and of how many these are."""
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x += h[i : i + n] * np.uint64(_MIX[2] * (2 * i + 1) ** 5 & (1 << 64) - 1)
    return _mixed(x)


def majority(h: np.ndarray, words: int, block: int = 255 << 5) -> np.ndarray:
    """The wide fingerprint [words] of hashes h: a bit is 1 if set in over half of their wide hashes (see _word); all
    bits of a row are unpacked at once, and summed in bytes over 255 rows at a time."""
    counts, steps = np.zeros(64 * words, np.int64), np.array([_MIX[2] * i & (1 << 64) - 1 for i in range(words)], np.uint64)
    for at in range(0, len(h), block):
        part = h[at : at + block]
        wide = _mixed(part[:, None] + steps)
        wide[:, 0] = part
        bits = np.unpackbits(wide.view(np.uint8).ravel(), bitorder="little").reshape(len(part), -1)
        for lo in range(0, len(part), 255):
            counts += bits[lo : lo + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)


def _set_node(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def _common(docs: DataFrame, text_col: str, k: int, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Commonest shingles in a sixteenth of the texts: sorted hashes, and a grade for each one's count.

    They only set the order in which shingles are entered; any order finds all pairs, a good one in small buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                h = [shingle_set(t.as_py(), k) for t in b.column(0).slice(lo, 64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], names=["h"])
        give_back()

    some = docs.filter(F.xxhash64(text_col) % 16 == 0).select(F.col(text_col).alias("t"))
    top = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 3").orderBy(F.desc("n"), "h").limit(most).collect()
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.floor(np.log2(np.array([r["n"] for r in top], np.float64)))[order]


def _rarest(h: np.ndarray, common: tuple[np.ndarray, np.ndarray], share: tuple[int, int]) -> np.ndarray:
    """The shingles under which a set is entered: the first n - ceil(n * share) + 1, uncommon ones first, then by hash.

    Two sets whose Jaccard similarity is the share or more have at least one of these in common.
    """
    keys, grades = common
    if not len(h):
        return h
    size = len(h) + (-len(h) * share[0] // share[1]) + 1
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        if hit.any():
            return h[np.argsort(np.where(hit, grades[at], 0), kind="stable")[:size]]
    return h[:size]


def _set_rows(k: int, words: int, common, share: tuple[int, int]):
    """Function over Arrow batches (id, text): the id, the set's node, size and fingerprint, and its entries.

    A set that its task has met of late, as copies are, gives no entries again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            node, n, w, keys = [], [], [], []
            for t in b.column(1):
                h = shingle_set(t.as_py(), k)
                node.append(_set_node(h))
                n.append(len(h))
                w.append(majority(h, words))
                keys.append(np.zeros(0, np.int64) if node[-1] in met else _rarest(h, common.value, share).view(np.int64))
                if len(met) >= 1 << 16:
                    met.clear()
                met.add(node[-1])
            w = np.array(w, np.int64).reshape(-1, words)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int64()), *[pa.array(np.ascontiguousarray(w[:, i])) for i in range(words)], keys], names=["id", "node", "n", *[f"w{i}" for i in range(words)], "keys"])
        give_back()

    return run


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, node) sorted by both: each pair once with its key's least node as `hub`, without keys of one node alone.

    One row is held between batches, however many a key has.
    """
    last, hub, met = np.zeros((0, 2), np.int64), 0, False  # the last pair, its key's hub, and whether that had another node
    for b in batches:
        x = np.concatenate([last, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)])
        if not len(x):
            continue
        x = x[np.append(True, (x[1:] != x[:-1]).any(axis=1))]
        same = x[1:, 0] == x[:-1, 0]
        first = np.maximum.accumulate(np.where(np.append(False, ~same), np.arange(len(x)), 0))
        hubs = np.where(first > 0, x[first, 1], hub if len(last) else x[0, 1])
        before = np.append(met, same)
        go = np.flatnonzero(before[:-1] | same)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[go, 0], x[go, 1], hubs[go])], names=["key", "node", "hub"])
        last, hub, met = x[-1:], int(hubs[-1]), bool(before[-1])
    if met:
        yield pa.RecordBatch.from_arrays([pa.array(last[:, 0]), pa.array(last[:, 1]), pa.array([hub])], names=["key", "node", "hub"])


def _maybe(n: np.ndarray, fp: np.ndarray, m: np.ndarray, fq: np.ndarray, share: tuple[int, int], most: int) -> np.ndarray:
    """Where sets of n and m shingles with fingerprints fp and fq can be as alike as the share."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    ok = low * share[1] >= high * share[0]
    return ok & ((low < SMALL) | (np.bitwise_count((fp ^ fq).view(np.uint64)).sum(axis=-1) <= most))


def _can_be(words: int, share: tuple[int, int], most: int) -> Column:
    """The same as a column, for n, w0, ... and m, v0, ..."""
    low, high = F.least("n", "m"), F.greatest("n", "m")
    far = sum((F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(1, words)), F.bit_count(F.col("w0").bitwiseXOR(F.col("v0"))))
    return (low * share[1] >= high * share[0]) & ((low < SMALL) | (far <= most))


def _alike(own: np.ndarray, sets: np.ndarray, sizes: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Which of the sets, laid end to end, have a Jaccard similarity of the share or more to `own`; none is empty."""
    at = np.minimum(np.searchsorted(own, sets), len(own) - 1)
    both = np.add.reduceat(own[at] == sets, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both * share[1] >= (len(own) + sizes - both) * share[0]


def _with_hub(share: tuple[int, int]):
    """Function over Arrow batches (unit, member, node, h) sorted by unit and member: (hub, node) of those alike.

    A unit's first row is its hub, whose set alone is held; the members pass by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = 0, np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            unit, member, node = (b.column(i).to_numpy() for i in range(3))
            h, out = b.column(3), []
            ends = np.frombuffer(h.buffers()[1], np.int32)[h.offset : h.offset + len(h) + 1]
            data = np.frombuffer(h.buffers()[2], np.uint8)
            for a, z in _runs(unit):
                if not member[a]:
                    hub, own = int(node[a]), data[ends[a] : ends[a + 1]].copy().view(np.uint64)
                    a += 1
                if a < z:
                    ok = _alike(own, data[ends[a] : ends[z]].view(np.uint64), np.diff(ends[a : z + 1]).astype(np.int64) // 8, share)
                    out += [(hub, x) for x in node[a:z][ok].tolist()]
            yield _pairs(out)
        give_back()

    return run


def _hub_links(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (hub, node) whose sets (node, h) are alike. Members of a hub come in parts of about MEMBERS, each with its set."""
    n = pairs.groupBy(F.col("hub").alias("h0")).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    s = sets.select(F.col("node").alias("m"), "h")
    heads = n.select(F.col("h0").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("unit", F.xxhash64("node", "part")).withColumn("member", F.lit(0))
    members = pairs.join(n, F.col("hub") == F.col("h0")).select("node", F.xxhash64("hub", F.expr("pmod(xxhash64(node), parts)").cast("int")).alias("unit"), F.lit(1).alias("member"))
    both = heads.select("unit", "member", "node").unionByName(members.select("unit", "member", "node"))
    both = both.join(s, F.col("node") == F.col("m")).select("unit", "member", "node", "h")
    return _dealt(both, "unit", "member", "node").mapInArrow(_with_hub(share), "src long, dst long")


#: Rows of a unit whose pairs are looked at together with those of other such units.
LITTLE = 8


def _little(t: pa.Table, rows: np.ndarray, pairs) -> pa.RecordBatch:
    """The links (label, label) of all pairs that meet in the units of these rows, which are little: by rows' distance in the table."""
    unit, label = (t.column(c).to_numpy() for c in ("unit", "label"))
    out = []
    for step in range(1, LITTLE):
        i = np.flatnonzero(rows[:-step] & (unit[step:] == unit[:-step]) & (label[step:] != label[:-step]))
        out.append(np.stack([i, i + step]))
    i, j = np.concatenate(out, axis=1)
    ok = pairs(t, i, j)
    return pa.RecordBatch.from_arrays([pa.array(label[x[ok]]) for x in (i, j)], names=["src", "dst"])


def _unit_links(near, words: int, pairs=None):
    """Function over Arrow batches (unit, label, node, n, w0, ..., more) sorted by unit and node: forests over labels.

    Rows of one label are one tree from the start. near(table) gives the test of a unit's rows. pairs(table, i, j), if
    given, tests pairs of rows: all those of little units at once, which give a link for each pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            unit = t.column("unit").to_numpy()
            runs = np.array(list(_runs(unit)))
            large = np.diff(runs, axis=1)[:, 0] > LITTLE
            if pairs is not None and not large.all():
                yield _little(t, np.repeat(~large, np.diff(runs, axis=1)[:, 0]), pairs)
            for a, z in runs[large if pairs is not None else slice(None)].tolist():
                part = t.slice(a, z - a)
                label = part.column("label").to_numpy()
                first, root = np.unique(label, return_index=True, return_inverse=True)[1:]
                if len(first) > 1:
                    yield _pairs(_forest(label, near(part), first[root]))
        give_back()

    return run


def _near_rows(words: int, share: tuple[int, int], most: int, exact: bool):
    """The test of a unit's rows for _unit_links: whether they can be alike, and, if exact, whether their sets are."""

    def of(t: pa.Table):
        n = t.column("n").to_numpy()
        fp = np.stack([t.column(f"w{i}").to_numpy() for i in range(words)], axis=1)
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for c in t.column("h").chunks for v in c] if exact else []

        def near(i: int, js: np.ndarray) -> np.ndarray:
            ok = _maybe(n[i], fp[i], n[js], fp[js], share, most)
            some = js[ok]
            if exact and len(some):
                ok[ok] = _alike(sets[i], np.concatenate([sets[j] for j in some.tolist()]), n[some], share)
            return ok

        return near

    return of


def _near_pairs(words: int, share: tuple[int, int], most: int):
    """The test of pairs of rows for _unit_links: whether they can be alike."""

    def pairs(t: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = t.column("n").to_numpy()
        fp = np.stack([t.column(f"w{x}").to_numpy() for x in range(words)], axis=1)
        return _maybe(n[i], fp[i], n[j], fp[j], share, most)

    return pairs


#: Shingles of a group of candidates that one task compares at a time: twice this, 8 bytes each, and their texts' sets once more.
BLOCK_SHINGLES = 1 << 22


def _joined(nodes: DataFrame, links: DataFrame, col: str) -> DataFrame:
    """nodes (node, ...) with the least node of the links' component, itself for others, in a column."""
    cc = components(links).select(F.col("node").alias("c0"), F.col("component").alias("c1"))
    return nodes.join(cc, F.col(col) == F.col("c0"), "left").withColumn(col, F.coalesce("c1", col)).drop("c0", "c1")


def _fingerprint_pairs(nodes: DataFrame, bits: int) -> DataFrame:
    """(hub, node): sets (node, n, w0) joined as by all pairs of 64-bit fingerprints w0 at `bits` or fewer, n - 1 pairs at most.

    The look-ups of links(): of equal fingerprints the least set is the hub of the others and meets what its fingerprint
    is linked to. Sets without shingles are one and have no pair.
    """
    nodes = nodes.filter("n > 0").select("node", "w0")
    least = spill(nodes.groupBy(F.col("w0").alias("fp")).agg(F.min("node").alias("least")), "least")
    equal = nodes.join(least, F.col("w0") == F.col("fp")).filter("node != least").select(F.col("least").alias("hub"), "node")
    near = links(least.select(F.col("fp").alias("node")), bits)
    near = near.join(least.select(F.col("fp").alias("f0"), F.col("least").alias("hub")), F.col("src") == F.col("f0"))
    near = near.join(least.select(F.col("fp").alias("f1"), F.col("least").alias("node")), F.col("dst") == F.col("f1"))
    return equal.unionByName(near.select("hub", "node"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, words: int = 8, share: tuple[int, int] = (4, 5), most: int = 144, bits: int = 3) -> DataFrame:
    """(doc_id, component_id) for each row of docs: groups of texts linked by a Jaccard similarity of share or more.

    The similarity is that of the sets of k-word shingles, counted exactly. No group is ever one task's:

    1. SimHash: sets whose 64-bit fingerprints differ in `bits` or fewer, found by the look-ups of near_duplicates(), are
       compared, and those alike are a group from then on.
    2. At the share most fingerprints are farther apart than any look-up reaches (at 0.8 about 10 of 64 bits). An exact
       way for these follows: sets are entered under so many of their rarest shingles that all pairs as alike as that
       share an entry. Of these, pairs of different groups whose sizes and, from 64 shingles on, fingerprints (64 * words
       bits, `most` differing; at 512 bits and 0.8 about 78 +- 8 differ) allow it are candidates. Each entry's least set
       is its hub, and its other sets are compared with the hub, in work and memory in proportion to the entries.
    3. Sets that share an entry without its hub, and are in different groups yet, can still be alike. Where they are
       candidates, their groups' sets that take part meet in blocks, every two of which are a unit of work. A set is
       compared with sets of other groups only, and a unit gives fewer links than rows.

    Equal sets are one node; null and empty texts are one set, without entries. Ids, repeated rows and empty tables as
    in near_duplicates; other columns of docs are not read. A very long text's set, 8 bytes a shingle, is held whole.
    """
    spark, ws = docs.sparkSession, [f"w{i}" for i in range(words)]
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    common = spark.sparkContext.broadcast(_common(x, "t", k))
    fp = spill(x.mapInArrow(_set_rows(k, words, common, share), f"id {kind}, node long, n long, {', '.join(f'{w} long' for w in ws)}, keys array<long>"), "sets")
    nodes = spill(fp.groupBy("node", "n", *ws).agg(F.min("id").alias("least")), "nodes")
    crowd = spill(_dealt(fp.select(F.explode("keys").alias("key"), "node"), "key", "node").mapInArrow(_crowded, "key long, node long, hub long"), "crowd")

    def sets_of(some: DataFrame) -> DataFrame:
        """(node, h) of nodes, made again from the texts that have the sets' least ids."""
        some = spill(some.distinct(), "some")
        least = nodes.join(some, nodes["node"] == some["node"], "left_semi").select("least").distinct()
        # ids of 8 bytes or so: at most some MB are broadcast, more are joined by shuffles
        least = F.broadcast(least) if some.count() <= 1 << 19 else least

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 500):
                    h = [shingle_set(t.as_py(), k) for t in b.column(0).slice(lo, 500)]
                    yield pa.RecordBatch.from_arrays([pa.array([_set_node(v) for v in h], pa.int64()), pa.array([v.tobytes() for v in h], pa.binary())], names=["m", "h"])
            give_back()

        # another text that has the same id may have been made too: its set is no node of these, or is its own node's
        every = x.join(least, F.col("id").eqNullSafe(F.col("least")), "left_semi").select("t").mapInArrow(made, "m long, h binary")
        return spill(every.join(some, F.col("m") == F.col("node"), "left_semi").dropDuplicates(["m"]).withColumnRenamed("m", "node"), "made")

    # SimHash: sets that the look-ups of fingerprints find
    pairs = spill(_fingerprint_pairs(nodes, bits), "looked-up")
    sets = sets_of(pairs.select(F.explode(F.array("hub", "node")).alias("node")))
    looked = spill(_hub_links(pairs, sets, share), "by-fingerprint")
    release(sets)
    own = spill(_joined(nodes.select("node", "least", F.col("node").alias("label")), looked, "label"), "classes")
    # every set with its entries' hubs, where these are in different groups
    group = own.select(F.col("node").alias("g0"), "label")
    pairs = crowd.filter("node != hub").select("hub", "node").distinct()
    pairs = pairs.join(group, F.col("node") == F.col("g0")).select("hub", "node", F.col("label").alias("mine"))
    pairs = pairs.join(group, F.col("hub") == F.col("g0")).filter("label != mine").select("hub", "node")
    side = nodes.select(F.col("node").alias("m0"), F.col("n").alias("m"), *[F.col(w).alias(f"v{i}") for i, w in enumerate(ws)])
    pairs = pairs.join(nodes.select(F.col("node").alias("n0"), "n", *ws), F.col("node") == F.col("n0")).join(side, F.col("hub") == F.col("m0"))
    pairs = spill(pairs.filter(_can_be(words, share, most)).select("hub", "node"), "pairs")
    sets = sets_of(pairs.select(F.explode(F.array("hub", "node")).alias("node")))
    found = spill(_hub_links(pairs, sets, share).unionByName(looked), "links")
    release(sets)
    own = spill(_joined(nodes.select("node", "least", F.col("node").alias("label")), found, "label"), "classes")
    # entries whose sets, the hub left out, are not all of one group yet
    rest = crowd.filter("node != hub").join(own.select(F.col("node").alias("n0"), "label"), F.col("node") == F.col("n0")).select("key", "node", "label")
    mixed = rest.groupBy(F.col("key").alias("k0")).agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b").select("k0")
    rest = spill(rest.join(mixed, F.col("key") == F.col("k0"), "left_semi"), "mixed")
    told = nodes.select(F.col("node").alias("n0"), "n", *ws)
    units = in_blocks(rest, "key", "node", F.lit(1), BLOCK).join(told, F.col("node") == F.col("n0")).select("unit", "label", "node", "n", *ws)
    maybe = _dealt(units, "unit", "node").mapInArrow(_unit_links(_near_rows(words, share, most, False), words, _near_pairs(words, share, most)), "src long, dst long")
    maybe = spill(maybe.distinct(), "candidates")
    cand = components(maybe).select(F.col("node").alias("l0"), F.col("component").alias("grp"))
    active = rest.select("node", "label").distinct().join(cand, F.col("label") == F.col("l0")).join(told, F.col("node") == F.col("n0"))
    active = spill(active.select("node", "label", "grp", "n", *ws), "active")
    more = sets_of(active.select("node"))
    units = in_blocks(active, "grp", "node", F.col("n"), BLOCK_SHINGLES).join(more.withColumnRenamed("node", "m0"), F.col("node") == F.col("m0")).select("unit", "label", "node", "n", *ws, "h")
    alike = spill(_dealt(units, "unit", "node").mapInArrow(_unit_links(_near_rows(words, share, most, True), words), "src long, dst long"), "more")
    own = spill(_joined(own, alike, "label"), "classes")
    named = own.groupBy(F.col("label").alias("c")).agg(F.min("least").alias("component_id"))
    own = own.join(named, F.col("label") == F.col("c")).select(F.col("node").alias("m"), "component_id")
    return fp.select("id", "node").join(own, F.col("node") == F.col("m")).select(F.col("id").alias(id_col), "component_id")


def hexed(w: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(w), 16, "0"))
