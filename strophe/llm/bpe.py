"""Byte-level BPE by a published rank file: encoding and decoding, whole texts, exact.

Each match of the split pattern is merged on its own. A segment tree over the byte positions
of a piece holds the leftmost minimum pair rank; a merge updates the tree at the merged
position and its live neighbours, one path to the root each. The distinct new pieces of a
batch go through their trees side by side as numpy columns, in groups of equal tree size.
Work is per row: there is no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import bounded_batches

#: Distinct pieces that a worker remembers before it starts anew, and characters encoded at a time.
CACHE_PIECES = 200_000
CHUNK_CHARS = 1_000_000
#: Tree leaves worked on side by side.
LEAVES = 1 << 21
NONE = np.int64(1) << 62
#: Up to so many trees of one size, plain lists are quicker than columns.
FEW = 24


class Vocabulary:
    """Ranks of a tiktoken file; ``pairs`` maps two adjacent tokens to the rank of their union."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.size = max(self.tokens) + 1
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, ranks = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    ranks.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ranks = np.array(ranks, dtype=np.int64)[order]
        self.pair_rank = dict(zip(keys, ranks, strict=True))

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the union is no token."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of pieces of two bytes or more."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            groups.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for leaves, members in groups.items():
            if len(members) < FEW:
                for i in members:
                    out[i] = self._merge_one(pieces[i], leaves)
                continue
            step = max(1, LEAVES // leaves)
            for s in range(0, len(members), step):
                part = members[s:s + step]
                for i, ids in zip(part, self._merge_equal([pieces[i] for i in part], leaves), strict=True):
                    out[i] = ids
        return out

    def _merge_equal(self, pieces: list[bytes], leaves: int) -> list[np.ndarray]:
        """Pieces of at most ``leaves`` bytes (a power of two), one tree each."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), dtype=np.uint8).reshape(n, leaves)
        position = np.arange(leaves, dtype=np.int64)
        live = position < size[:, None]
        token = self.bytes[raw]
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)
        rank = self.pair(token[:, :-1], token[:, 1:])
        # a node holds rank * leaves + position, so that the minimum is the leftmost of the lowest rank
        tree[:, leaves:-1] = np.where(live[:, 1:] & (rank < NONE), rank * leaves + position[:-1], NONE)
        level = leaves
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        after = np.broadcast_to(position + 1, (n, leaves)).copy()
        before = np.broadcast_to(position - 1, (n, leaves)).copy()
        tree, token, after, before, alive = tree.reshape(-1), token.reshape(-1), after.reshape(-1), before.reshape(-1), live.reshape(-1).copy()
        row = np.flatnonzero(tree[1::2 * leaves] < NONE)
        while len(row):
            best = tree[row * 2 * leaves + 1]
            ids, p = best // leaves, best % leaves
            at = row * leaves
            q = after[at + p]
            r = after[at + q]
            token[at + p] = ids
            alive[at + q] = False
            after[at + p] = r
            has_r = r < size[row]
            before[(at + r)[has_r]] = p[has_r]
            o = before[at + p]
            has_o = o >= 0
            self._update(tree, row, leaves, q, np.full(len(row), NONE))
            right = np.full(len(row), NONE)
            right[has_r] = self.pair(ids[has_r], token[(at + r)[has_r]])
            self._update(tree, row, leaves, p, np.where(right < NONE, right * leaves + p, NONE))
            left = self.pair(token[(at + o)[has_o]], ids[has_o])
            self._update(tree, row[has_o], leaves, o[has_o], np.where(left < NONE, left * leaves + o[has_o], NONE))
            row = row[tree[row * 2 * leaves + 1] < NONE]
        flat = token[alive]
        ends = np.cumsum(alive.reshape(n, leaves).sum(axis=1))
        return np.split(flat, ends[:-1])

    def _merge_one(self, piece: bytes, leaves: int) -> np.ndarray:
        """The same tree for a single piece, in plain lists."""
        n, size, rank_of, none = len(piece), self.size, self.pair_rank, int(NONE)
        token = [int(self.bytes[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)

        def value(p: int) -> int:
            r = after[p]
            rank = rank_of.get(token[p] * size + token[r]) if r < n else None
            return none if rank is None else rank * leaves + p

        for p in range(n - 1):
            tree[leaves + p] = value(p)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, p = divmod(tree[1], leaves)
            q = after[p]
            token[p], token[q] = rank, -1
            after[p] = after[q]
            if after[q] < n:
                before[after[q]] = p
            o = before[p]
            for leaf, new in ((q, none), (p, value(p)), *(((o, value(o)),) if o >= 0 else ())):
                node = leaf + leaves
                tree[node] = new
                while node > 1:
                    node >>= 1
                    a, b = tree[2 * node], tree[2 * node + 1]
                    tree[node] = a if a < b else b
        return np.array([t for t in token if t >= 0], dtype=np.int64)

    @staticmethod
    def _update(tree: np.ndarray, row: np.ndarray, leaves: int, leaf: np.ndarray, value: np.ndarray) -> None:
        """Set one leaf of each tree and the nodes above it."""
        base = row * 2 * leaves
        node = leaf + leaves
        tree[base + node] = value
        for _ in range(leaves.bit_length() - 1):
            node = node >> 1
            tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary, self.find, self.cache = vocabulary(path), regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache = {}
        cache, ranks = self.cache, self.vocabulary.ranks
        new = []
        for pieces in cut:
            for p in pieces:
                if p not in cache:
                    b = p.encode()
                    whole = ranks.get(b)
                    cache[p] = b"" if whole is None else whole.to_bytes(4, "little")
                    if whole is None:
                        new.append((p, b))
        for (p, _), ids in zip(new, self.vocabulary.merge([b for _, b in new]), strict=True):
            cache[p] = ids.astype("<u4").tobytes()
        return [b"".join([cache[p] for p in pieces]) for pieces in cut]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= CHUNK_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encoded(docs: DataFrame, path: str, pattern: str, decode: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens, and with ``decode`` the column bytes: the
    ids turned back in the same worker. One row per row of ``docs``.

    Null and empty texts have no tokens; repeated rows and null ids come out as they came in;
    other columns of ``docs`` are ignored. ``path`` is a rank file that every worker can open,
    ``pattern`` the split pattern; special tokens are ordinary text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, token = Encoder(path, pattern), vocabulary(path).tokens.__getitem__
        for batch in batches:
            ids, at = batch.column(0), 0
            for part in _chunks([t or "" for t in batch.column(1).to_pylist()]):
                found = enc.encode(part)
                out = [ids.slice(at, len(part)), pa.array(found, pa.binary())]
                if decode:
                    out.append(pa.array([turned_back(x, token) for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names)
                at += len(part)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary" + ", bytes binary" * decode
    names = ["doc_id", "ids", "bytes"][:2 + decode]
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, schema).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def turned_back(ids: bytes, token) -> bytes:
    return b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``encoded`` rows with the column ``bytes`` (binary): the ids turned back. Null ids give null bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(path).tokens.__getitem__
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            back = [None if x is None else turned_back(x, token) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], [*batch.schema.names, "bytes"])

    from pyspark.sql.types import BinaryType

    schema = type(tokens.schema)(list(tokens.schema.fields)).add("bytes", BinaryType())
    return bounded_batches(tokens).mapInArrow(run, schema)
