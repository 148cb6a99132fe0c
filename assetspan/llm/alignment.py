"""Cross-tokenizer alignment: where two tokenizers' tokens end together, and which of their ids are linked there.

The token streams of a text are cut into byte ranges, each a token belongs to the range in which it ends.  A range
becomes a fragment: an open prefix up to its first common end, closed groups, and an open suffix after its last.  Two
neighbours compose: the suffix of one and the prefix of the next close one group together; a range without a common end
is open as a whole.  This is associative, so fragments are folded in any bracketing: those of short texts inside the
task that reads them, those of long texts as a tree over Spark tasks, SEGMENT bytes a leaf and FAN neighbours a node.

Tokens are made per word between two spaces at which neither tokenizer's tokens go on, and remembered: byte-level pieces
end there, and no piece of the second vocabulary holds a space after another character (checked when it is loaded).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspan.llm import merge_tree
from assetspan.llm._common import chunks, cut

#: Bytes of a range, of a segment that one task reads of a long text, and how many neighbours a node of the tree composes.
RANGE, SEGMENT, FAN = 1 << 14, 1 << 18, 16
EMPTY = np.zeros(0, np.int64)
#: Words that a worker remembers; above it forgets all and starts again.
REMEMBERED = 400_000


class Tokens:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = merge_tree.encoder(path_a, specials=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on after a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([*map(len, self.a.bytes_of)], np.int64)
        self.b_size = np.array([*map(len, self.b_bytes)], np.int64)
        #: Decimal ids before each sign that may follow: a comma inside a side of a group, a bar after a side, a semicolon after a group.
        said = [b"%d%s" % (i, s) for signs, n in ((b",|", len(self.a_size)), (b",;", len(self.b_size))) for s in (signs[:1], signs[1:]) for i in range(n)]
        self.said = np.array(said)  # padded with zero bytes
        self.kind = "<u2" if len(self.b_size) < 1 << 16 else "<u4"
        self.b_words: dict[str, bytes | None] = {}

    def b_led(self, units: list[list[str]]) -> list[bytes | None]:
        """The second tokenizer's ids of " " + unit for all units of each list; None where their bytes are others than the text's."""
        new = set().union(*units).difference(self.b_words)
        if len(self.b_words) + len(new) > REMEMBERED:
            self.b_words = {}
            new = set().union(*units)
        fresh = list(new)
        self.b_words.update(zip(fresh, self._b_ids(fresh)))
        out = []
        for u in units:
            ids = [*map(self.b_words.__getitem__, u)]
            out.append(None if None in ids else b"".join(ids))
        return out

    def _b_ids(self, units: list[str]) -> list[bytes | None]:
        """Ids of " " + unit; the bytes of all are compared at once, and one by one only where they differ."""
        ids = self.b.encode(units, num_threads=1)
        ends = np.cumsum([*map(len, ids)])
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(ends[-1]) if len(ends) else 0)
        sizes = np.diff(np.concatenate([[0], np.cumsum(self.b_size[flat])])[np.concatenate([[0], ends])] if len(ends) else [0])
        text = [(" " + u).encode() for u in units]
        same = b"".join(map(self.b_bytes.__getitem__, flat.tolist())) == b"".join(text) and sizes.tolist() == [*map(len, text)]
        block, width = flat.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        stops = (ends * width).tolist()
        out = [block[i:j] for i, j in zip([0, *stops], stops)]
        if not same:
            out = [x if b"".join(map(self.b_bytes.__getitem__, i)) == t else None for x, i, t in zip(out, ids, text)]
        return out

    def streams(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both id streams of " " + text for each text that is not empty; None where their bytes are not the text's."""
        units = [merge_tree.cut_at_spaces(t) for t in texts]
        return [None if b is None else (np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, self.kind).astype(np.int64)) for a, b in zip(self.a.led(units), self.b_led(units))]

    def rendered(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> bytes:
        """`a1,a2|b1;` for each group, from both id streams and the groups, numbered from 0, that their tokens are in."""
        after_a = np.searchsorted(b_group, a_group)  # tokens of the other stream that stand before each
        after_b = np.searchsorted(a_group, b_group, side="right")
        last_a = np.append(a_group[1:] != a_group[:-1], True)
        last_b = np.append(b_group[1:] != b_group[:-1], True)
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + after_a] = a + last_a * len(self.a_size)
        code[np.arange(len(b)) + after_b] = b + last_b * len(self.b_size) + 2 * len(self.a_size)
        signs = self.said[code].view(np.uint8)
        return signs[signs != 0].tobytes()


@dataclass
class Fragment:
    """A range of tokens: `common` says whether two tokens end together in it; without that, all its tokens are in the head."""

    common: bool = False
    head_a: np.ndarray = field(default_factory=lambda: EMPTY)
    head_b: np.ndarray = field(default_factory=lambda: EMPTY)
    groups: bytes = b""
    links: np.ndarray = field(default_factory=lambda: EMPTY)
    tail_a: np.ndarray = field(default_factory=lambda: EMPTY)
    tail_b: np.ndarray = field(default_factory=lambda: EMPTY)


def closed(a: np.ndarray, b: np.ndarray) -> bytes:
    """One group of these tokens."""
    return (",".join(map(str, a.tolist())) + "|" + ",".join(map(str, b.tolist())) + ";").encode()


def leaf(tokens: Tokens, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of one range."""
    at = np.searchsorted(a_ends, b_ends)
    together = a_ends[np.minimum(at, len(a_ends) - 1)] == b_ends if len(a_ends) else np.zeros(len(b), bool)
    j = np.flatnonzero(together)
    if not len(j):
        return Fragment(head_a=a, head_b=b)
    i = at[j]
    inside_a, inside_b = slice(i[0] + 1, i[-1] + 1), slice(j[0] + 1, j[-1] + 1)
    groups = b""
    if len(j) > 1:
        a_group = np.repeat(np.arange(len(i) - 1), np.diff(i))
        b_group = np.repeat(np.arange(len(j) - 1), np.diff(j))
        groups = tokens.rendered(a[inside_a], b[inside_b], a_group, b_group)
    links = a[i] * len(tokens.b_size) + b[j]
    return Fragment(True, a[: i[0] + 1], b[: j[0] + 1], groups, links, a[i[-1] + 1 :], b[j[-1] + 1 :])


def compose(x: Fragment, y: Fragment) -> Fragment:
    """Associative, with Fragment() as neutral element."""
    join = lambda p, q: np.concatenate([p, q]) if len(p) and len(q) else p if len(p) else q
    if not x.common:
        return replace(y, head_a=join(x.head_a, y.head_a), head_b=join(x.head_b, y.head_b))
    if not y.common:
        return replace(x, tail_a=join(x.tail_a, y.head_a), tail_b=join(x.tail_b, y.head_b))
    middle = closed(join(x.tail_a, y.head_a), join(x.tail_b, y.head_b))
    return Fragment(True, x.head_a, x.head_b, x.groups + middle + y.groups, join(x.links, y.links), y.tail_a, y.tail_b)


def fold(parts: list[Fragment]) -> Fragment:
    """Neighbours are composed pair by pair, level by level, so that bytes are copied as often as the tree has levels."""
    while len(parts) > 1:
        parts = [compose(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else Fragment()


def fragment(tokens: Tokens, a: np.ndarray, b: np.ndarray, size: int = RANGE) -> Fragment:
    """The fragment of two whole streams, folded from those of their byte ranges."""
    a_ends, b_ends = np.cumsum(tokens.a_size[a]), np.cumsum(tokens.b_size[b])
    upto = int(a_ends[-1]) if len(a_ends) else 0
    if upto <= size:
        return leaf(tokens, a, a_ends, b, b_ends)
    stops = np.arange(size, upto + size, size)
    i, j = (np.concatenate([[0], np.searchsorted(e, stops, side="right")]) for e in (a_ends, b_ends))
    return fold([leaf(tokens, a[p:q], a_ends[p:q], b[r:s], b_ends[r:s]) for p, q, r, s in zip(i, i[1:], j, j[1:])])


def whole(f: Fragment) -> bytes:
    """The groups of a fragment that is a whole text, whose end is a common one: `a1,a2|b1;a3|b2`."""
    return (closed(f.head_a, f.head_b) + f.groups)[:-1] if f.common else b""


_tokens: dict[tuple[str, str], Tokens] = {}


def tokenizers(path_a: str, path_b: str) -> Tokens:
    """Both tokenizers, loaded once per worker process."""
    if (path_a, path_b) not in _tokens:
        _tokens[path_a, path_b] = Tokens(path_a, path_b)
    return _tokens[path_a, path_b]


RESULT = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<{link}>"
PARTS = "doc_id long, text_sha256 string, no int, copies long, valid boolean, n_a long, n_b long, common boolean, head_a array<int>, head_b array<int>, groups binary, links array<{link}>, tail_a array<int>, tail_b array<int>"


def align(docs: DataFrame, path_a: str, path_b: str, groups: bool = False, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, groups_sha256, links, and with `groups` the groups as text.

    A link is a's id times the size of b's vocabulary plus b's id; n_groups is also how many there are.  Texts null,
    empty, or that either tokenizer does not give back byte by byte have no tokens.  Texts above `segment` bytes
    are cut at safe spaces and tokenised by as many tasks as they have parts; a part without one is tokenised whole.
    Repeated rows give repeated rows; other columns of docs are ignored; an empty table gives an empty one.
    """
    sizes = tokenizers(path_a, path_b)
    kind = "int" if len(sizes.a_size) * len(sizes.b_size) < 1 << 31 else "long"
    schema = RESULT.format(link=kind) + ", groups string" * groups
    number = pa.int32() if kind == "int" else pa.int64()
    given = docs.select("doc_id", "text")
    is_long = F.coalesce(F.octet_length("text") > segment, F.lit(False))

    def result(ids, found: list[tuple[int, int, Fragment]]) -> pa.RecordBatch:
        said = [whole(f) for _, _, f in found]
        cols = [
            ids,
            pa.array([n for n, _, _ in found], pa.int64()),
            pa.array([n for _, n, _ in found], pa.int64()),
            pa.array([len(f.links) for _, _, f in found], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in said], pa.string()),
            pa.array([f.links for _, _, f in found], pa.list_(number)),
        ]
        names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
        return pa.RecordBatch.from_arrays(cols + [pa.array([x.decode() for x in said], pa.string())] * groups, names + ["groups"] * groups)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for b in chunks(batches, "text"):
            texts = b.column(1).to_pylist()
            streams = iter(t.streams([x for x in texts if x]))
            found = []
            for x in texts:
                s = next(streams) if x else None
                found.append((0, 0, Fragment()) if s is None else (len(s[0]), len(s[1]), fragment(t, *s)))
            yield result(b.column(0).cast(pa.int64()), found)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                digest, start, no = hashlib.sha256(text.encode()).hexdigest(), 0, 0
                while start <= len(text):
                    m = merge_tree.SAFE.search(text, start + segment)
                    stop = m.start() if m else len(text)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text_sha256": [digest], "no": pa.array([no], pa.int32()), "text": [text[start:stop]]})
                    start, no = stop + 1, no + 1

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for b in chunks(batches, "text"):
            streams = t.streams(b.column("text").to_pylist())
            yield packed(b.select(["doc_id", "text_sha256", "no", "copies"]), [(s is not None, *((0, 0, Fragment()) if s is None else (len(s[0]), len(s[1]), fragment(t, *s)))) for s in streams])

    def packed(keys: pa.RecordBatch, rows: list[tuple[bool, int, int, Fragment]]) -> pa.RecordBatch:
        valid, n_a, n_b, f = zip(*rows)
        ids = lambda name: pa.array([getattr(x, name) for x in f], pa.list_(pa.int32()))
        cols = [pa.array(valid, pa.bool_()), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array([x.common for x in f], pa.bool_()), ids("head_a"), ids("head_b"), pa.array([x.groups for x in f], pa.binary()), pa.array([x.links for x in f], pa.list_(number)), ids("tail_a"), ids("tail_b")]
        return pa.RecordBatch.from_arrays([*keys.columns, *cols], [*keys.schema.names, "valid", "n_a", "n_b", "common", "head_a", "head_b", "groups", "links", "tail_a", "tail_b"])

    def unpacked(rows: pd.DataFrame) -> list[Fragment]:
        as_ids = lambda x: np.asarray(x, np.int64)
        return [Fragment(r.common, as_ids(r.head_a), as_ids(r.head_b), r.groups, as_ids(r.links), as_ids(r.tail_a), as_ids(r.tail_b)) for r in rows.itertuples()]

    def composed(group: pa.Table) -> pa.Table:
        rows = group.to_pandas().sort_values("no")
        keys = pa.RecordBatch.from_pydict({"doc_id": group.column("doc_id").combine_chunks().slice(0, 1), "text_sha256": [rows.text_sha256.iloc[0]], "no": pa.array([rows.no.iloc[0] // fan], pa.int32()), "copies": pa.array([rows.copies.iloc[0]], pa.int64())})
        return pa.Table.from_batches([packed(keys, [(bool(rows.valid.all()), int(rows.n_a.sum()), int(rows.n_b.sum()), fold(unpacked(rows)))])])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = b.slice(k, 1).to_pandas()
                found = [(int(rows.n_a[0]), int(rows.n_b[0]), unpacked(rows)[0]) if rows.valid[0] else (0, 0, Fragment())]
                for _ in range(int(rows.copies[0])):
                    yield result(b.column("doc_id").slice(k, 1), found)

    cut_up = given.where(is_long).mapInArrow(parts, "doc_id long, text_sha256 string, no int, text string")
    tree = cut_up.groupBy("doc_id", "text_sha256", "no", "text").agg(F.count("*").alias("copies")).mapInArrow(fragments, PARTS.format(link=kind))
    tree = cut(tree)
    most = tree.agg(F.max("no")).first()[0] or 0
    while most:
        tree = tree.groupBy("doc_id", "text_sha256", F.expr(f"no div {fan}").alias("node")).applyInArrow(composed, PARTS.format(link=kind))
        most //= fan
    return given.where(~is_long).mapInArrow(short, schema).unionByName(tree.mapInArrow(ended, schema))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """link and count: how many links of the corpus hold each id pair.

    Tokens that end together end in the same bytes, so one is a suffix of the other: there are at most as many pairs as
    both vocabularies' tokens have bytes, whatever the corpus holds.
    """
    return aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("count"))


def best_links(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """aligned without its links, with n_links, n_best and count_sum.

    n_best counts the links whose pair is its b id's most frequent one in the corpus, ties included; count_sum adds up their
    pairs' counts.  The pairs go through the driver: their number is bounded by the vocabularies (see pair_counts).
    """
    base = len(tokenizers(path_a, path_b).b_size)
    pairs = pair_counts(aligned).toArrow().sort_by("link")
    link, count = (pairs.column(c).to_numpy().astype(np.int64) for c in ("link", "count"))
    highest = np.zeros(base, np.int64)
    np.maximum.at(highest, link % base, count)
    best = count == highest[link % base]
    kept = [f for f in aligned.schema.fields if f.name != "links"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_links long, n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = b.column("links")
            sums = []
            for k in range(b.num_rows):
                pair, n = np.unique(links[k].values.to_numpy(), return_counts=True)
                at = np.searchsorted(link, pair)
                sums.append((int(n.sum()), int(n @ best[at]), int(n @ count[at])))
            cols = [b.column(f.name) for f in kept] + [pa.array([s[i] for s in sums], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in kept] + ["n_links", "n_best", "count_sum"])

    return aligned.mapInArrow(run, schema)


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """align() with the links weighed by the whole corpus; what align() gives is kept in the checkpoint folder meanwhile."""
    return best_links(cut(align(docs, path_a, path_b)), path_a, path_b)
