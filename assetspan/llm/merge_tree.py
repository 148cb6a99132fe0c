"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A leaf of the tree holds the rank of the pair that starts at its place, joined with the place, and every
inner node the least of its two children: the root is the leftmost pair of least rank.  A merge changes
three leaves, those of the pair itself, of the pair before and of the pair that is swallowed, and each
change goes up to the root in as many steps as the tree has levels.  Pieces of one width go through a
forest, one tree a row, whose roots are merged together; where few pieces share a width, each has a tree of its own.

Texts are first cut at special tokens, then at spaces between other characters, where no piece goes on,
then by the splitting pattern.  What a word between two such spaces gives is remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from assetspan.llm._common import chunks
from assetspan.llm.bpe import PairTable

#: Letters and numbers that Unicode got after its version 16, which the tokenizers library takes for neither (fixed values).
LATER = (
    "՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9"
    "\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: The byte-level splitting pattern, as that library reads it.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{LATER}]]+| ?[\p{{N}}--[{LATER}]]+| ?[^\s[[\p{{L}}\p{{N}}]--[{LATER}]]]+|\s+(?!\S)|\s+"
#: Spaces at which every piece ends: between two characters that are no white space.
SAFE = re.compile(r"(?<=\S) (?=\S)")
NONE = 1 << 62
#: Words that a worker remembers; above it forgets all and starts again.
REMEMBERED = 500_000
#: From so many pieces of a width on they go through one forest, which pays for its numpy calls.
FOREST = 24
#: Places of a forest.
CELLS = 1 << 16


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Encoder:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int] | None = None):
        """specials: strings that are one token wherever they stand in a text; none for plain text."""
        letters = byte_letters()
        number = {c: i for i, c in enumerate(letters)}
        self.specials = specials or {}
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *self.specials.values()]))
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(map(number.__getitem__, token)) if set(token) <= number.keys() else token.encode()
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.at_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.split = regex.compile(PATTERN, regex.V1).findall
        self.single = np.array([vocabulary[c] for c in letters], np.int64)
        self.ranks = {(vocabulary[a] << 32) | vocabulary[b]: r for r, (a, b) in reversed([*enumerate(merges)])}
        self.joined = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.table = PairTable(np.fromiter(self.ranks, np.int64, len(self.ranks)), np.fromiter(self.ranks.values(), np.int64, len(self.ranks)))
        self.words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, specials: bool = True) -> Encoder:
        """From a tokenizer file; without `specials` their strings are plain text."""
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["model"]["merges"]]
        return cls(d["model"]["vocab"], merges, {t["content"]: t["id"] for t in d["added_tokens"]} if specials else None)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) == 1:
                out[i] = int(self.single[p[0]]).to_bytes(4, "little")
            elif p:
                widths.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in widths.items():
            step = max(FOREST, CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                if len(part) < FOREST:
                    for i in part:
                        out[i] = self._tree(pieces[i], width)
                else:
                    self._forest(pieces, part, width, out)
        return out

    def _tree(self, piece: bytes, width: int) -> bytes:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n, ranks, joined = len(ids), self.ranks, self.joined
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [NONE] * (2 * width)

        def leaf(i: int, j: int) -> int:
            """What the leaf of the pair (i, j) holds."""
            r = ranks.get((ids[i] << 32) | ids[j]) if i >= 0 and j < n else None
            return NONE if r is None else r * width + i

        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while (root := tree[1]) != NONE:
            rank, at = divmod(root, width)
            gone = after[at]
            ids[at], ids[gone], after[at] = int(joined[rank]), -1, after[gone]
            if after[at] < n:
                before[after[at]] = at
            changes = [(at, leaf(at, after[at])), (gone, NONE)]
            if before[at] >= 0:
                changes.append((before[at], leaf(before[at], at)))
            for place, value in changes:
                node = width + place
                tree[node] = value
                while node > 1:
                    node >>= 1
                    least = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == least:
                        break
                    tree[node] = least
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _forest(self, pieces: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        n, none = len(rows), np.int64(NONE)
        flat = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(n, width)
        size = np.fromiter((len(pieces[i]) for i in rows), np.int64, n)
        row = width + 1  # cells of a row: its last one, to which both ends lead, stands for "nothing there"
        ids = np.full((n, row), -1, np.int64)
        ids[:, :width] = np.where(np.arange(width) < size[:, None], self.single[flat], -1)
        first = np.arange(n) * row
        after = (first[:, None] + np.arange(1, row + 1)).ravel()
        before = (first[:, None] + np.arange(-1, width)).ravel()
        before[first] = first + width
        ids = ids.ravel()

        def leaves(i: np.ndarray, j: np.ndarray, place: np.ndarray) -> np.ndarray:
            rank = self.table.get(ids[i], ids[j])
            return np.where(rank < len(self.joined), rank * width + place, none)

        tree = np.full((n, 2 * width), none, np.int64)
        pair = (first[:, None] + np.arange(width - 1)).ravel()
        tree[:, width:-1] = leaves(pair, pair + 1, np.tile(np.arange(width - 1), n)).reshape(n, width - 1)
        level = width
        while level > 1:
            level >>= 1
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        tree, live = tree.ravel(), np.arange(n)
        while True:
            root = tree[live * (2 * width) + 1]
            more = root != none
            live, root = live[more], root[more]
            if not len(live):
                break
            rank, place = np.divmod(root, width)
            start = live * row
            at = start + place
            gone = after[at]
            right, left = after[gone], before[at]
            ids[at], ids[gone] = self.joined[rank], -1
            after[at], before[right] = right, at
            ends = left - start == width  # nothing before: the swallowed leaf is set in its stead
            base = live * (2 * width) + width
            node = np.concatenate([base + place, base + np.where(ends, gone, left) - start, base + gone - start])
            tree[node] = np.concatenate([leaves(at, right, place), leaves(left, at, left - start), np.full(len(live), none)])
            node = np.concatenate([place, np.where(ends, gone, left) - start, gone - start]) + width
            base = np.tile(live * (2 * width), 3)
            for _ in range(width.bit_length() - 1):
                node >>= 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree[child], tree[child + 1])
        alive = ids >= 0
        flat_ids, stops = ids[alive].astype("<u4").tobytes(), (4 * np.cumsum(alive.reshape(n, row).sum(1))).tolist()
        for k, (start, stop) in enumerate(zip([0, *stops], stops)):
            out[rows[k]] = flat_ids[start:stop]

    def _pieces(self, units: list[str]) -> list[bytes]:
        """Ids of each of these texts, which hold no special token."""
        parts = [[u] if u[1:].isalpha() and u[0] == " " else self.split(u) for u in units]  # a space and letters are one piece
        new = list(set().union(*parts))
        ids = dict(zip(new, self.merge([p.encode() for p in new])))
        return [ids[p[0]] if len(p) == 1 else b"".join(map(ids.__getitem__, p)) for p in parts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        if self.at_specials is None:
            return self.encode_plain([t or "" for t in texts])
        parts = [self.at_specials.split(t) if t else [""] for t in texts]
        coded = iter(self.encode_plain([p for s in parts for p in s[::2]]))
        special = {t: i.to_bytes(4, "little") for t, i in self.specials.items()}
        return [b"".join(special[p] if k % 2 else next(coded) for k, p in enumerate(s)) for s in parts]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """The same for texts whose first word stands alone and whose other words follow a space."""
        units = [cut_at_spaces(t) for t in texts]
        rest = self.led([u[1:] for u in units])
        return [a + b for a, b in zip(self._pieces([u[0] for u in units]), rest)]

    def led(self, units: list[list[str]]) -> list[bytes]:
        """Ids of " " + unit for all units of each list, joined."""
        new = set().union(*units).difference(self.words)
        if len(self.words) + len(new) > REMEMBERED:
            self.words = {}
            new = set().union(*units)
        marked = {u for u in new if u[-1:] in MARKS and u[:-1].isalpha()}  # letters and a mark: the mark is a piece of its own
        fresh = list((new - marked) | {u[:-1] for u in marked}.difference(self.words))
        self.words.update(zip(fresh, self._pieces([" " + u for u in fresh])))
        marks = dict(zip(MARKS, self._pieces([*MARKS])))
        self.words.update((u, self.words[u[:-1]] + marks[u[-1]]) for u in marked)
        return [b"".join(map(self.words.__getitem__, u)) for u in units]

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def cut_at_spaces(text: str) -> list[str]:
    """The text's parts between safe spaces, which are left out."""
    parts = text.split(" ")
    if "" in parts or ODD.search(text):
        return SAFE.split(text)
    return parts


#: Marks after which a word is looked up without them.
MARKS = (".", ",", ";", ":", "!", "?")
#: White space beside a space.
ODD = re.compile(r" \s|\s ")

_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, specials: bool = True) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if (path, specials) not in _encoders:
        _encoders[path, specials] = Encoder.load(path, specials)
    return _encoders[path, specials]


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with `ids` the ids themselves.

    path names a byte-level BPE file of the tokenizers library and must be readable on every executor.  Special
    tokens whose strings stand in a text are single tokens, none is added.  Null and empty texts have no tokens;
    a text of any length is read whole by one worker; repeated rows give repeated rows; other columns of docs
    are ignored; an empty table gives an empty one.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in chunks(batches, "text"):
            coded = enc.encode(b.column(1).to_pylist())
            cols = [
                b.column(0).cast(pa.int64()),
                pa.array([len(x) // 4 for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in coded], pa.string()),
            ]
            if ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in coded], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of rows with a column ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            out = [enc.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
