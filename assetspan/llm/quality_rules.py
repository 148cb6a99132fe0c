"""Quality rules: base counts, then gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of labelled documents (TRAIN_ROWS, half of each label as far as there are so many) whose
statistics the executors compute.  Every tree is a complete one of depth DEPTH in three node arrays (feature, threshold, leaf value);
scoring walks all rows of a batch down all trees at once.  Features in FALLING may only lower the
score as they rise: a split that would break this is not taken, and bounds pass down to both sides.
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

TRAIN_ROWS = 6000
TREES, DEPTH, RATE, BINS, RIDGE, LEAST_ROWS = 60, 3, 0.2, 32, 1.0, 10
FALLING = {"symbols_per_word", "dup_lines_share", "repeat_words_share", "top_word_share"}
KEEP = 0.5


class Trees:
    """Boosted trees as node arrays; node i has children 2i+1 and 2i+2."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.threshold, self.value = start, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        n, t = len(x), len(self.feature)
        tree, row = np.arange(t)[None, :], np.arange(n)[:, None]
        node = np.zeros((n, t), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        margin = self.start + self.value[tree, node - (2**DEPTH - 1)].sum(1) if t else np.full(n, self.start)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, falling: np.ndarray) -> Trees:
    """Logistic loss, histogram splits, second-order leaf values."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    base = np.clip(y.mean(), 0.01, 0.99)
    start = float(np.log(base / (1 - base)))
    margin = np.full(n, start)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, threshold, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        rows: dict[int, np.ndarray] = {0: np.arange(n)}
        bound: dict[int, tuple[float, float]] = {0: (-np.inf, np.inf)}
        for node in range(inner):
            at, (low, high) = rows[node], bound[node]
            best, gain = None, 1e-6
            leaf = lambda a, b: np.clip(-a / (b + RIDGE), low, high)
            worth = lambda a, b, w: -(a * w + 0.5 * (b + RIDGE) * w * w)
            G, H = g[at].sum(), h[at].sum()
            for j in range(f) if len(at) >= 2 * LEAST_ROWS else ():
                k = len(edges[j]) + 1
                gs, hs, cs = (np.cumsum(np.bincount(binned[at, j], weights=w, minlength=k))[:-1] for w in (g[at], h[at], None))
                if not len(gs):
                    continue
                left, right = leaf(gs, hs), leaf(G - gs, H - hs)
                score = worth(gs, hs, left) + worth(G - gs, H - hs, right) - worth(G, H, leaf(G, H))
                ok = (cs >= LEAST_ROWS) & (len(at) - cs >= LEAST_ROWS) & (~falling[j] | (right <= left))
                score = np.where(ok, score, -np.inf)
                if score.max() > gain:
                    i = int(score.argmax())
                    best, gain = (j, i, left[i], right[i]), score[i]
            a, b = 2 * node + 1, 2 * node + 2
            if best is None:
                rows[a], rows[b], bound[a], bound[b] = at, at[:0], (low, high), (low, high)
                continue
            j, i, left, right = best
            feature[t, node], threshold[t, node] = j, edges[j][i]
            side = binned[at, j] <= i
            rows[a], rows[b] = at[side], at[~side]
            middle = (left + right) / 2
            bound[a], bound[b] = ((middle, high), (low, middle)) if falling[j] else ((low, high), (low, high))
        for leaf_at in range(leaves):
            at, (low, high) = rows[inner + leaf_at], bound[inner + leaf_at]
            w = np.clip(-g[at].sum() / (h[at].sum() + RIDGE), low, high) if len(at) else (np.clip(0.0, low, high))
            value[t, leaf_at] = RATE * w
            margin[at] += RATE * w
    return Trees(start, feature, threshold, value)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(Stats(b).matrix))], ["label", "stats"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees from labels of documents whose crc32(doc_id) mod 3 is not 1; None if these don't hold both labels."""
    train = sample(docs.select("doc_id", "text"), labels, "quality", remainder(F.col("doc_id"), 3) != 1, rows)
    got = train.select(F.col("_label").cast("long").alias("label"), "text").mapInArrow(_measure, "label long, stats array<double>").toPandas()
    if got["label"].nunique() < 2:
        return None
    got = got.sort_values("label", kind="stable")
    x = np.stack(got["stats"])
    order = np.lexsort((*x.T, got["label"]))  # whatever order the rows came in
    return fit(x[order], got["label"].to_numpy(float)[order], np.array([s in FALLING for s in STATS]))


def judge(docs: DataFrame, trees: Trees | None, keep: float = KEEP) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    Words are runs of anything but \\x20 and \\x09-\\x0D; null and empty texts have none and so fail.  Without trees the base rules decide alone.
    Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty one.  A text of any length is read whole by one
    worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            s = Stats(b)
            failed = (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)
            score = trees.score(s.matrix) if trees else np.ones(b.num_rows)
            longs = [pa.array(x, pa.int64()) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *longs, pa.array(failed), pa.array(~failed & (score >= keep)), pa.array(score)], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
