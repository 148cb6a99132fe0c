"""Byte-level BPE: encode whole texts to the ids of a public vocabulary, and decode them.

Each match of the splitting pattern is encoded by itself.  Distinct pieces that are no token
as they stand go into padded matrices, one per length bucket, of their single-byte ids.  In every round
each row merges its leftmost pair of least rank; pairs are looked up in a hash table of all (left,
right) splits of every token, and rows move left over the gap, finished rows leave the matrix.  A pair's rank
depends on the joined bytes alone, as in the tiktoken library.

Pieces above LONG bytes would cost rounds times length there; they keep their pairs in a heap instead,
with the same order of merges.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from assetspan.llm._common import chunks

LONG = 1024
#: Distinct pieces that a worker remembers; above it forgets all and starts again.
REMEMBERED = 250_000
NONE = np.int64(1 << 40)


class PairTable:
    """Open addressing with linear probing over 64-bit keys, all lookups in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            slot = (self._home(keys[left]) + probe) & self.mask
            free = self.keys[slot] == -1
            cand, at = left[free], slot[free]
            at, first = np.unique(at, return_index=True)
            self.keys[at], self.values[at] = keys[cand[first]], values[cand[first]]
            placed = np.zeros(len(keys), bool)
            placed[cand[first]] = True
            left, probe = left[~placed[left]], probe + 1
        self.probes = probe

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined tokens, NONE where there is none; negative ids never join."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._home(keys)
        out = np.full(len(keys), NONE, np.int64)
        todo = np.arange(len(keys))
        for probe in range(self.probes):
            at = (slot[todo] + probe) & self.mask
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (found != -1)]
            if not len(todo):
                break
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {
            (ranks[t[:i]] << 32) | ranks[t[i:]]: r
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self.table = PairTable(np.fromiter(self.pairs, np.int64), np.fromiter(self.pairs.values(), np.int64))
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(ranks, pattern)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers, by rounds over length buckets."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = self.ranks[p].to_bytes(4, "little")
            elif len(p) > LONG:
                out[i] = np.array(self._long(p), "<u4").tobytes()
            elif p:
                buckets.setdefault(len(p) if len(p) <= 32 else 1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 18) // width)
            for k in range(0, len(rows), step):
                self._rounds(pieces, rows[k : k + step], width, out)
        return out

    def _rounds(self, pieces: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        size = np.fromiter((len(pieces[i]) for i in rows), np.int64, len(rows))
        row = np.array(rows)
        ids = np.where(np.arange(width) < size[:, None], self.single[flat], -1)
        rank = self.table.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(row):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            r = np.arange(len(row))
            best = rank[r, at] if rank.shape[1] else np.full(len(row), NONE)
            over = best == NONE
            if over.any():
                n = (ids[over] >= 0).sum(1)
                block, stride = ids[over].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (i, m) in enumerate(zip(row[over].tolist(), n.tolist())):
                    out[i] = block[k * stride : k * stride + 4 * m]
                live = ~over
                row, ids, rank, at, best = row[live], ids[live], rank[live], at[live], best[live]
                r = np.arange(len(row))
                if not len(row):
                    break
            w = ids.shape[1] - 1
            column = np.arange(w)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            ids[r, at] = best
            column = column[:-1]
            rank = np.take_along_axis(rank, column + (column >= at[:, None]), 1)
            right = at < w - 1
            rank[r[right], at[right]] = self.table.get(ids[r[right], at[right]], ids[r[right], at[right] + 1])
            left = at > 0
            rank[r[left], at[left] - 1] = self.table.get(ids[r[left], at[left] - 1], ids[r[left], at[left]])

    def _long(self, piece: bytes) -> list[int]:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pair = lambda i: self.pairs.get((ids[i] << 32) | ids[after[i]]) if after[i] < len(ids) else None
        heap = [(r, i) for i in range(len(ids)) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or pair(i) != r:
                continue
            gone = after[i]
            ids[i], after[i], ids[gone] = r, after[gone], -1
            if after[i] < len(ids):
                before[after[i]] = i
            for j in (i, before[i]):
                if j >= 0 and (q := pair(j)) is not None:
                    heapq.heappush(heap, (q, j))
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        parts = [self.split(t) if t else [] for t in texts]
        new = set().union(*parts).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*parts)
        fresh = list(new)
        self.known.update(zip(fresh, self.merge([p.encode() for p in fresh])))
        return [b"".join(map(self.known.__getitem__, s)) for s in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder.load(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with `ids` the ids themselves.

    path must be readable on every executor.  Null and empty texts have no tokens; repeated rows give
    repeated rows; other columns of docs are ignored; an empty table gives an empty one.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in chunks(batches, "text"):
            coded = enc.encode(b.column(1).to_pylist())
            cols = [
                b.column(0).cast(pa.int64()),
                pa.array([len(x) // 4 for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in coded]),
            ]
            if ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in coded], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of rows with a column ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            out = [b"".join(map(enc.bytes_of.__getitem__, x or [])) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
