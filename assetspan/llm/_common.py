"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from assetspan.session import BROADCAST_ROWS, cut, small

__all__ = ["ALNUM", "BROADCAST_ROWS", "Rolling", "chunks", "cut", "lengths", "mix", "packed", "raw", "small", "suffix_array", "table", "unpacked", "word_bounds", "word_hashes"]

#: Byte table: A-Z become a-z, every other ASCII character that is no digit or lower-case letter becomes a
#: space, bytes of non-ASCII characters stay.  Splitting at spaces then gives [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
ALNUM = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches' rows, regrouped so that one batch holds about `most` bytes of the column and `rows` rows at most, and one row at least.

    A text larger than that is a batch of its own, as no row can be split; a worker needs some 20 times its bytes for it.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(lengths(col))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, base + most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def lengths(col: pa.Array) -> np.ndarray:
    """Bytes of each value; null counts as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The column's values as UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a public 64-bit mixing function (fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2^64 of all runs of symbols, from prefix sums; base is odd, so it has an inverse."""

    def __init__(self, base: int):
        self.base = np.uint64(base | 1)
        self.inverse = np.uint64(pow(base | 1, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _upto(self, n: int) -> None:
        if len(self.powers) < n:
            m = max(n, 2 * len(self.powers))
            for name, b in (("powers", self.base), ("inverses", self.inverse)):
                x = np.full(m, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self._upto(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols.astype(np.uint64) * self.powers[: len(symbols)], dtype=np.uint64, out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (prefix[ends] - prefix[starts]) * self.inverses[starts]


def word_bounds(buffer: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    flag = np.zeros(len(buffer) + 2, np.int8)
    flag[1:-1] = is_word[buffer]
    step = np.diff(flag)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


#: Base of the words' hashes, the longest stretch of a word that is hashed at once, and how many bytes are hashed at a time.
WORD_BASE, STRETCH = 0x3C6EF372FE94F82B, 1 << 12
HASHED_BYTES = 1 << 18


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, by its bytes alone, in memory that does not grow with the bytes."""
    size = ends - starts
    longest = int(size.max(initial=0))
    if longest > STRETCH:  # hash stretches, then sum them by their number in the word
        count = -(-size // STRETCH)
        first = np.cumsum(count) - count
        number = np.arange(int(count.sum())) - np.repeat(first, count)
        at = np.repeat(starts, count) + number * STRETCH
        parts = word_hashes(buffer, at, np.minimum(at + STRETCH, np.repeat(ends, count)))
        parts += number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return np.where(count == 1, parts[first], mix(np.add.reduceat(mix(parts), first)))
    out = np.empty(len(starts), np.uint64)
    powers = np.full(longest, WORD_BASE, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    upto = np.cumsum(size)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(upto, (int(upto[a - 1]) if a else 0) + HASHED_BYTES, side="right")))
        n = size[a:b]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        values = buffer[np.repeat(starts[a:b], n) + inside].astype(np.uint64)
        values += np.uint64(1)
        values *= powers[inside]
        out[a:b] = mix(np.add.reduceat(values, first))
        a = b
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; equal symbols past the first differing one never remain, as the last symbol is unique."""
    _, rank = np.unique(text, return_inverse=True)
    n, k = len(text), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:] if k < n else []
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([0], np.diff(key[order]) != 0)).cumsum()
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        k *= 2


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns inside one struct, where their names clash with nothing."""
    from pyspark.sql import functions as F

    rest = [docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("_row"))


def unpacked(df: DataFrame, like: DataFrame, changed=None) -> DataFrame:
    """The columns of `like` from a packed frame; n_chars is counted anew where `changed` holds."""
    from pyspark.sql import functions as F

    out = []
    for field in like.schema:
        c = field.name
        col = F.col(c) if c in ("doc_id", "text") else F.col("_row").getField(c)
        if c == "n_chars" and changed is not None:
            col = F.when(changed, F.char_length("text").cast(field.dataType)).otherwise(col)
        out.append(col.alias(c))
    return df.select(*out)
