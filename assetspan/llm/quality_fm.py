"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Inputs of a text: its distinct words, hashed into 2^BITS slots and weighted 1 + ln(count), scaled to unit length; the statistics of STATS,
standardised; and the metadata column n_chars as a logarithm.  The pairwise term is scored in linear time: half the sum over factors of (sum of
v x)^2 minus the sum of (v x)^2.  Fitted on the driver by AdaGrad from a bounded sample of labelled documents (TRAIN_ROWS) whose inputs
the executors compute.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspan.llm._common import chunks
from assetspan.llm.docstats import STATS, Stats
from assetspan.llm.labelled import remainder, sample

TRAIN_ROWS = 4000
BITS, FACTORS = 16, 6
EPOCHS, BATCH, RATE, RIDGE = 8, 64, 0.1, 1e-4
DENSE = len(STATS) + 1


def inputs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, slot and value of hashed words, and the dense inputs [texts, DENSE], not yet standardised."""
    s = Stats(batch)
    slot = (s.word_hash >> np.uint64(64 - BITS)).astype(np.int64)
    value = 1 + np.log(s.word_count)
    norm = np.sqrt(np.bincount(s.word_doc, weights=value * value, minlength=batch.num_rows))
    n_chars = batch.column(batch.schema.get_field_index("n_chars")).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    return s.word_doc, slot, value / norm[s.word_doc], np.column_stack([s.matrix, np.log1p(np.maximum(n_chars, 0))])


class Machine:
    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        size = (1 << BITS) + DENSE
        self.mean, self.scale, self.bias = mean, scale, 0.0
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(7).normal(0, 0.05, (size, FACTORS)).astype(np.float32)

    def rows(self, doc: np.ndarray, slot: np.ndarray, value: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One sparse row per text, in order: text, slot, value."""
        n = len(dense)
        z = np.clip((dense - self.mean) / self.scale, -4, 4)
        doc = np.concatenate([doc, np.repeat(np.arange(n), DENSE)])
        slot = np.concatenate([slot, np.tile((1 << BITS) + np.arange(DENSE), n)])
        value = np.concatenate([value, z.ravel() / np.sqrt(DENSE)]).astype(np.float32)
        order = np.argsort(doc, kind="stable")
        return doc[order], slot[order], value[order]

    def margin(self, doc: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Margins and the sums of v x, by sum of squares; every text has at least the dense inputs."""
        starts = np.searchsorted(doc, np.arange(n))
        vx = self.v[slot] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[slot] * value, starts) + 0.5 * (sums * sums - squares).sum(1), sums

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(3)
        gw, gv, gb = np.full(len(self.w), 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
                size = [len(texts[i][0]) for i in part]
                doc, slot, value = self.rows(np.repeat(np.arange(len(part)), size), np.concatenate([texts[i][0] for i in part]), np.concatenate([texts[i][1] for i in part]), dense[part])
                margin, sums = self.margin(doc, slot, value, len(part))
                g = ((1 / (1 + np.exp(-margin)) - y[part]) / len(part)).astype(np.float32)
                gx = g[doc] * value
                used, at = np.unique(slot, return_inverse=True)
                dw = np.bincount(at, weights=gx).astype(np.float32) + RIDGE * self.w[used]
                each = gx[:, None] * (sums[doc] - self.v[slot] * value[:, None])
                dv = np.stack([np.bincount(at, weights=each[:, k]) for k in range(FACTORS)], 1).astype(np.float32) + RIDGE * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += g.sum() ** 2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
                self.bias -= RATE * float(g.sum()) / np.sqrt(gb)

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        doc, slot, value, dense = inputs(batch)
        margin, _ = self.margin(*self.rows(doc, slot, value, dense), batch.num_rows)
        return 1 / (1 + np.exp(-margin.astype(np.float64)))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        doc, slot, value, dense = inputs(b)
        ends = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (slot, value)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists, pa.array(list(dense))], ["doc_id", "label", "slot", "value", "dense"])


def _with_n_chars(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.char_length("text").cast("double")
    return docs.select("doc_id", "text", n.alias("n_chars"))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine | None:
    """A machine from labels of documents whose crc32(doc_id) mod 3 is not 1; None if these don't hold both labels."""
    train = sample(_with_n_chars(docs), labels, "quality", remainder(F.col("doc_id"), 3) != 1, rows)
    got = train.select("doc_id", F.col("_label").cast("long").alias("label"), "text", "n_chars").mapInArrow(_examples, "doc_id long, label long, slot array<long>, value array<double>, dense array<double>").toPandas()
    if got["label"].nunique() < 2:
        return None
    got = got.sort_values("doc_id", kind="stable")
    dense = np.stack(got["dense"])
    machine = Machine(dense.mean(0), dense.std(0) + 1e-6)
    machine.fit(list(zip(got["slot"], got["value"])), dense, got["label"].to_numpy(float))
    return machine


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts are scored by their statistics (all zero).  Without a machine every score is 0.5.  A row without doc_id is not
    held out.  Repeated rows give repeated rows; columns other than text and n_chars are ignored; without n_chars (null, or no such column) it counts
    as 0 or is counted.  An empty table gives an empty one; a text of any length is read whole by one worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            s = machine.score(b) if machine else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s)], ["doc_id", "score"])

    out = _with_n_chars(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
