"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: The piece types of the model file, and how far an unknown character scores below the worst piece.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message; nested messages stay bytes."""

    def varint(i: int) -> tuple[int, int]:
        r = s = 0
        while True:
            r |= (b[i] & 127) << s
            s += 7
            i += 1
            if b[i - 1] < 128:
                return r, i

    i = 0
    while i < len(b):
        k, i = varint(i)
        kind = k & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            v, i = b[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v, i = b[i : i + n], i + n
        else:
            raise ValueError("not a model file")
        yield k >> 3, v


@dataclass
class Pieces:
    """The pieces of a model file, in order of their ids: text, score and type; and its normaliser's switches."""

    pieces: list[tuple[str, float, int]]
    dummy_prefix: bool
    unk: int
    digest: str

    @classmethod
    def parse(cls, data: bytes) -> Pieces:
        out, prefix = [], True
        for f, v in _fields(data):
            if f == 1:
                d = dict(_fields(v))
                out.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif f == 3:
                d = dict(_fields(v))
                prefix = bool(d.get(3, 1))
                if d.get(1, b"identity") != b"identity" or d.get(4, 1):
                    raise ValueError("the model's normaliser changes texts: a round trip would not be exact")
        return cls(out, prefix, next((i for i, p in enumerate(out) if p[2] == UNKNOWN), 0), hashlib.sha256(data).hexdigest())


class Stretches(dict):
    """The ids of stretches met before, as int32 bytes, which take less room than lists; others are made when looked up.

    A look-up of what is there runs no Python. At `limit` entries the older generation gives way to this one, of which
    what is used again comes back.
    """

    def __init__(self, make: Callable[[str], list[int]], limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, s: str) -> bytes:
        got = self.older.get(s)
        if got is None:
            got = array("i", self.make(s)).tobytes()
        if len(s) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[s] = got
        return got


class Tokenizer:
    """Encodes texts to piece ids by the best sum of scores, and decodes them; decode(encode(text)) == text.

    Characters that no piece covers become their bytes' pieces (without these, the unknown id, and the round trip is not
    exact). A literal U+2581 in a text becomes bytes as well, since the piece stands for a space. The empty text has
    no ids. Pieces hold the space mark only in front, and no newline, so the best segmentation of a text is that of
    its stretches between these; stretches met before are looked up in two generations of `cache` entries.
    """

    def __init__(self, model: Pieces, cache: int = 100_000):
        self.model = model
        self.auto = ahocorasick.Automaton()
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.single, worst = set(), 0.0
        texts = [(i, p, s) for i, (p, s, t) in enumerate(model.pieces) if t in (NORMAL, USER)]
        for i, p, s in texts:
            self.auto.add_word(p, (i, len(p), s))
            worst = min(worst, s)
            if len(p) == 1:
                self.single.add(p)
        self.auto.make_automaton()
        self.unknown = worst - UNKNOWN_PENALTY
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in texts):
            cut = r"(?s).+"
        elif any("\n" in p for _, p, _ in texts):
            cut = rf"{SPACE}*[^{SPACE}]+|{SPACE}+"
        else:
            cut = rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
        self.stretches = re.compile(cut).findall
        self.table = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL, UNUSED) else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in model.pieces]
        self.cache = Stretches(self.viterbi, cache)

    def _char(self, c: str) -> list[int]:
        raw = [self.bytes.get(b) for b in c.encode()]
        return [self.model.unk] if None in raw else raw

    def viterbi(self, s: str) -> list[int]:
        """The ids of the best segmentation of one stretch.

        The automaton reports, at each end position, every piece that ends there by its output links; each relaxes the
        best score of its end. A character that is no piece itself may be passed at the unknown score.
        """
        n, neg = len(s), float("-inf")
        if self.single.issuperset(s):
            # every character is a piece, as in most stretches: none is passed as unknown. What ends with a character
            # stands at its index; the start, before the first, is index -1
            score, last = [neg] * n + [0.0], [(-1, 1, 0.0)] * n
            for end, piece in self.auto.iter(s):
                _, size, own = piece
                v = score[end - size] + own
                if v > score[end]:
                    score[end], last[end] = v, piece
            ids, at = [], n - 1
            while at >= 0:
                i, size, _ = last[at]
                ids.append(i)
                at -= size
            ids.reverse()
            return ids
        best, back = [0.0] + [neg] * n, [(-1, 0)] * (n + 1)
        done = 0

        def settle(to: int) -> None:
            nonlocal done
            while done < to:
                done += 1
                if s[done - 1] not in self.single and best[done - 1] + self.unknown > best[done]:
                    best[done], back[done] = best[done - 1] + self.unknown, (-1, 1)

        for end, (i, size, score) in self.auto.iter(s):
            settle(end)  # positions up to this piece's last character are final
            v = best[end + 1 - size] + score
            if v > best[end + 1]:
                best[end + 1], back[end + 1] = v, (i, size)
        settle(n)
        out: list[list[int]] = []
        at = n
        while at:
            i, size = back[at]
            out.append(self._char(s[at - 1]) if i < 0 else [i])
            at -= size
        return list(chain.from_iterable(reversed(out)))

    def _marked(self, s: str) -> Iterator[bytes]:
        return map(self.cache.__getitem__, self.stretches(s))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as int32."""
        if not text:
            return np.zeros(0, np.int32)
        parts: list[bytes] = []
        for i, part in enumerate(text.split(SPACE)):
            if i:
                parts.append(array("i", self._char(SPACE)).tobytes())
            lead = SPACE if i == 0 and self.model.dummy_prefix else ""
            parts += self._marked(lead + part.replace(" ", SPACE))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no valid UTF-8 are replaced."""
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


_made: dict[str, Tokenizer] = {}


def _tokenizer(model: Pieces) -> Tokenizer:
    """This worker's tokenizer of the model: the last one is kept, and serves every task that has the same file."""
    if model.digest not in _made:
        _made.clear()
        _made[model.digest] = Tokenizer(model)
    return _made[model.digest]


def load(path: str = MODEL, most: int = 64 << 20) -> Pieces:
    """The model at path, read on the driver; files over `most` bytes are refused, for it is sent to every task."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} holds over {most} bytes")
    return Pieces.parse(data)


def encode(docs: DataFrame, model: Pieces, text_col: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the piece ids of each whole text, and, if `decoded` is named, the text decoded from these ids.

    Null texts have null ids and a null decoded text; empty texts no ids. Columns of docs that have these names are
    replaced. Repeated rows are encoded each; an empty table gives an empty result.
    """
    new = [ids] + [decoded] * (decoded is not None)
    rest = [c for c in docs.columns if c not in new or c == text_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its file's size is checked in load()
    at = rest.index(text_col)
    keep = [c for c in rest if c not in new]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    names = [f.name for f in docs.schema if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                got = [None if t is None else tok.encode(t) for t in part.column(at).to_pylist()]
                null = np.array([g is None for g in got])
                ends = np.concatenate(([0], np.cumsum([0 if g is None else len(g) for g in got]))).astype(np.int32)
                values = np.concatenate([g for g in got if g is not None] or [np.zeros(0, np.int32)])
                cols = [pa.ListArray.from_arrays(pa.array(ends, mask=np.append(null, False)), pa.array(values, pa.int32()))]
                if decoded is not None:
                    cols.append(pa.array([None if g is None else tok.decode(g) for g in got], pa.string()))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i, c in enumerate(rest) if c in keep], *cols], names=[*[c for c in rest if c in keep], *new])
            give_back()

    order = [c for c in rest if c in keep]
    kinds = [kinds[names.index(c)] for c in order]
    out = [f"`{ids}` array<int>"] + [f"`{decoded}` string"] * (decoded is not None)
    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, ", ".join([*kinds, *out]))


def decode(rows: DataFrame, model: Pieces, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of their ids (a column of that name is replaced); null ids give a null text."""
    rest = [c for c in rows.columns if c != text]
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(sent.value)
        for b in batches:
            got = [None if v is None else tok.decode(np.array(v, np.int32)) for v in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, text])

    return rows.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, f"{kinds}, `{text}` string")
