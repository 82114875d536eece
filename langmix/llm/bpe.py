"""Byte-level BPE encoding and decoding by a rank file.

A piece of text (one match of the split pattern) is merged with a segment tree
over its byte positions: the leaf of a live position holds the rank of the pair
that starts there, inner nodes the smallest (rank, position), so the root names
the leftmost pair of minimum rank. A merge changes three leaves, each with a
logarithmic walk to the root; very long pieces cost n log n.

Texts run whole through ``mapInArrow``; there is no shuffle. Null texts encode
as empty. A worker remembers the ids of recent units (text between isolated
spaces) in a bounded cache, which never changes a result. Ids that the rank
file doesn't have are an error when decoding. Columns of the input pass through
with any names and values; the operator's own output replaces a column of the
same name. Empty tables give empty tables."""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm.common import table, without
from langmix.llm.worker import cached, tidy
from langmix.session import ship_package

CACHE_UNITS = 200_000   # remembered units in each of two generations
CACHE_CHARS = 64        # longer units are not remembered
LONG_PIECE = 64         # bytes; longer pieces have a tree of their own
BLOCK_CELLS = 1 << 18   # bytes of pieces merged at once
BLOCK_ROWS = 512        # rows handed on at once
BLOCK_CHARS = 1 << 20   # characters of text encoded at once, or one text

#: split patterns of which no match goes on over an isolated space: it may begin with one, and then holds no other. Texts
#: are cut there into units that are remembered; with any other pattern a text is one unit
CUT_AT_SPACES = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}

_SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace()]
_NEAR = [pair for c in _SPACES for pair in ({c + " ", " " + c})]   # a space that isn't isolated
_NO_PAIR = 1 << 62
_SHIFT = 40


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: repeatedly join the leftmost pair of minimum rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get = ranks.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NO_PAIR] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            tree[size + i] = r << _SHIFT | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n))
    low = (1 << _SHIFT) - 1
    while (best := tree[1]) != _NO_PAIR:
        i = best & low
        gone = after[i]
        end = after[gone]
        after[i] = end
        changed = [(gone, _NO_PAIR)]
        if end < n:
            before[end] = i
            r = get(piece[i:after[end]])
            changed.append((i, _NO_PAIR if r is None else r << _SHIFT | i))
        else:
            before[n] = i
            changed.append((i, _NO_PAIR))
        p = before[i]
        if p >= 0:
            r = get(piece[p:end])
            changed.append((p, _NO_PAIR if r is None else r << _SHIFT | p))
        for leaf, key in changed:
            at = leaf + size
            if at >= 2 * size or tree[at] == key:
                continue
            tree[at] = key
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                key = a if a < b else b
                if tree[at] == key:
                    break
                tree[at] = key
                at >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


class Merger:
    """The same merges for many short pieces at once: one row of a matrix is
    the segment tree of one piece, a round does one merge in every row."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.ranks, self.none = ranks, max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * (self.none + 1) + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.found = np.array([pairs[k] for k in self.keys.tolist()] + [0], np.int64)
        self.single = np.array([ranks.get(bytes([i]), self.none) for i in range(256)], np.int64)

    def leaves(self, left, right, place):
        """Leaf keys (rank, position) of neighbouring tokens; none if they don't join."""
        import numpy as np

        key = left * (self.none + 1) + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == key
        return np.where(hit, self.found[at] << _SHIFT | place, _NO_PAIR)

    def run(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Packed ids of pieces of 2 to ``size`` bytes (a power of two)."""
        import numpy as np

        m, rows = len(pieces), np.arange(len(pieces))
        n = np.array([len(x) for x in pieces])
        inside = np.arange(size + 1) < n[:, None]
        ids = np.full((m, size + 1), self.none, np.int64)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, size + 2), (m, 1))
        before = np.tile(np.arange(-1, size), (m, 1))
        tree = np.full((m, 2 * size), _NO_PAIR, np.int64)
        tree[:, size:] = self.leaves(ids[:, :-1], ids[:, 1:], np.arange(size))
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        alive = inside
        while True:
            best = tree[rows, 1]
            rows = rows[best != _NO_PAIR]
            if not len(rows):
                break
            best = best[best != _NO_PAIR]
            i, rank = best & ((1 << _SHIFT) - 1), best >> _SHIFT
            gone = after[rows, i]
            end = after[rows, gone]
            ids[rows, i], after[rows, i], before[rows, end] = rank, end, i
            alive[rows, gone] = False
            p = before[rows, i]
            has = p >= 0
            tree[rows, size + gone] = _NO_PAIR
            tree[rows, size + i] = self.leaves(rank, ids[rows, end], i)
            tree[rows[has], size + p[has]] = self.leaves(ids[rows[has], p[has]], rank[has], p[has])
            for which, leaf in ((rows, gone), (rows, i), (rows[has], p[has])):
                at = (leaf + size) >> 1
                for _ in range(size.bit_length() - 1):
                    tree[which, at] = np.minimum(tree[which, 2 * at], tree[which, 2 * at + 1])
                    at = at >> 1
        flat, cut = ids[alive].astype(np.int32).tobytes(), [0, *(4 * np.cumsum(alive.sum(1))).tolist()]
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def many(self, pieces) -> dict[str, bytes]:
        """Packed ids of distinct pieces of text."""
        import numpy as np

        pieces = list(pieces)
        raw = [p.encode() for p in pieces]
        out = [None if r is None else r.to_bytes(4, "little") for r in map(self.ranks.get, raw)]
        rest = np.array([i for i, r in enumerate(out) if r is None], np.int64)
        n = np.array([len(raw[i]) for i in rest], np.int64)
        size = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
        for one in np.unique(size):
            group = rest[size == one].tolist()
            if one > LONG_PIECE:
                for i in group:
                    out[i] = np.array(merge(raw[i], self.ranks), np.int32).tobytes()
                continue
            rows = BLOCK_CELLS // int(one)
            for at in range(0, len(group), rows):
                part = group[at:at + rows]
                for i, got in zip(part, self.run([raw[i] for i in part], int(one))):
                    out[i] = got
        return dict(zip(pieces, out))


class Codec:
    """Encoder and decoder of one rank file; lives as long as the worker."""

    def __init__(self, data: bytes, pattern: str):
        import numpy as np
        import regex

        self.ranks = read_ranks(data)
        self.merger = Merger(self.ranks)
        # the property, not the regex library's own idea of white space
        own = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pieces = regex.compile(own).findall
        self.split = re.compile(r"(?<=\S) (?=\S)").split
        self.cut = pattern in CUT_AT_SPACES
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = max(self.ranks.values()) + 1
        table = [b""] * size
        known = np.zeros(size, bool)
        for token, i in self.ranks.items():
            table[i], known[i] = token, True
        self.known = known
        self.lengths = np.array([len(x) for x in table], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed 32-bit ids of each text. Where an isolated space starts a new
        piece and no piece crosses it, the units between such spaces are
        encoded on their own (a leading space marks all but the first)."""
        if len(self.young) >= CACHE_UNITS:
            self.young, self.old = {}, self.young
        young, old, units, missing = self.young, self.old, [], set()
        for text in texts:
            near = text[:1] == " " or text[-1:] == " " or any(pair in text for pair in _NEAR)
            parts = (self.split(" " + text) if near else (" " + text).split(" ")) if text and self.cut else []
            # the first unit has no space of its own: its key can't be any other's
            if parts:
                parts = [" " + parts[1], *parts[2:]] if parts[0] == "" else [" " + parts[0][1:], *parts[1:]]
            if text and not self.cut:
                parts = [" " + text]
            units.append(parts)
            for u in set(parts).difference(young):
                known = old.get(u)
                if known is None:
                    missing.add(u)
                else:
                    young[u] = known
        long = {}
        if missing:
            keys = list(missing)
            split = list(map(self.pieces, [u[1:] if u[0] == " " else " " + u for u in keys]))
            ids = self.merger.many(set(chain.from_iterable(split)))
            for u, x in zip(keys, split):
                got = ids[x[0]] if len(x) == 1 else b"".join([ids[p] for p in x])
                if len(u) <= CACHE_CHARS:
                    young[u] = got
                else:
                    long[u] = got
        return [b"".join([young[u] if u in young else long[u] for u in parts] if long else
                         list(map(young.__getitem__, parts))) for parts in units]

    def decode(self, ids, offsets):
        """Bytes of many id lists at once: (flat bytes, byte offsets)."""
        import numpy as np

        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id that the rank file doesn't have")
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        out = []
        for at in range(0, len(ids), BLOCK_CHARS // 4):
            part = ids[at:at + BLOCK_CHARS // 4]
            n = self.lengths[part]
            before = np.cumsum(n) - n
            out.append(self.flat[np.repeat(self.starts[part] - before, n) + np.arange(n.sum())])
        return np.concatenate(out) if out else self.flat[:0], ends[offsets]


def codec(data: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    return cached(f"bpe {key}", lambda: Codec(data, pattern))


def load_ranks(path: str) -> bytes:
    """The rank file, read on the driver (a bounded vocabulary, about 1 MB)
    and sent to the workers, which need no such path."""
    with open(path, "rb") as f:
        return f.read()


def _map(df: DataFrame, used: str, added: str, kind: str, work) -> DataFrame:
    import pyarrow as pa  # noqa: F401

    ship_package(df.sparkSession)
    rest = without(df, added).columns
    place = df.columns.index(used)
    keep = [i for i, c in enumerate(df.columns) if c in rest]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], work(batch.column(place))],
                                                 names=[batch.schema.names[i] for i in keep] + [added])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in rest]
                       + [f"{added} {kind}"])
    return df.mapInArrow(tidy(run, "bpe"), schema)


def encode(df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All rows with ``ids`` (array<int>); matches of ``pattern`` are encoded
    separately, special tokens are ordinary text."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def work(texts):
        import numpy as np
        import pyarrow as pa

        c = codec(shared.value, pattern)
        parts, block, chars = [], [], 0
        for x in texts:
            block.append(x.as_py() or "")
            chars += len(block[-1])
            if chars >= BLOCK_CHARS:
                parts += c.encode(block)
                block, chars = [], 0
        parts += c.encode(block)
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in parts]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))

    return _map(df, text_col, ids_col, "array<int>", work)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All rows with ``decoded`` (binary), the bytes of the ids; null ids as
    empty."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def work(ids):
        import numpy as np
        import pyarrow as pa

        lengths = np.nan_to_num(np.asarray(ids.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
        values = ids.flatten()
        if values.null_count:
            raise ValueError("a null id")
        flat, at = codec(shared.value, pattern).decode(values.to_numpy(zero_copy_only=False),
                                                       np.concatenate(([0], np.cumsum(lengths))))
        return pa.BinaryArray.from_buffers(pa.binary(), len(ids),
                                           [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])

    return _map(df, ids_col, out_col, "binary", work)


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the bytes they decode to."""
    got = decode(encode(docs.select("doc_id", "text"), ranks, pattern).drop("text"), ranks, pattern)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_byte_bpe(spark, sf_dir):
    """Ids of every whole document by the 50k byte-level ranks, and their decoding."""
    import public_tokenizers as P

    return digests(table(spark, sf_dir, "documents"), load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
SQL: dict[str, str] = {}
