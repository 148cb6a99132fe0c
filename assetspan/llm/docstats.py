"""Statistics of whole texts, computed for a batch at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from assetspan.llm._common import raw
from assetspan.llm.substring import WORDS, Part

SYMBOLS = b"#*$%&|<>"
STATS = [
    "log_words", "chars_per_word", "symbols_per_word", "dup_lines_share", "repeat_words_share", "upper_share", "digit_share", "punct_share",
    "foreign_share", "words_per_line", "distinct_share", "top_word_share", "short_word_share", "long_word_share",
]


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


CLASSES = {
    "upper": _mask(bytes(range(65, 91))),
    "digit": _mask(bytes(range(48, 58))),
    "punct": _mask(b"!\"'(),-./:;?@[]_`{}~"),
    "foreign": _mask(bytes(range(0xC0, 0x100))),
}


class Stats:
    """Words of a batch and, per text, the counts of the base rules and the shares named in STATS (columns of `matrix`)."""

    def __init__(self, batch: pa.RecordBatch):
        part = self.part = Part(raw(batch, "text"))
        n, texts = batch.num_rows, [t or b"" for t in part.texts]
        begin = part.begin
        self.n_words = np.diff(begin)
        doc = np.repeat(np.arange(n), self.n_words)
        total = lambda x: np.bincount(doc, weights=x, minlength=n)
        buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        points = np.concatenate(([0], np.cumsum((buffer & 0xC0) != 0x80)))
        length = points[part.ends] - points[part.starts]
        self.word_chars = total(length).astype(np.int64)
        self.n_symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
        self.n_lines = np.array([len(x) for x in lines], np.int64)
        self.n_dup_lines = self.n_lines - np.array([len(set(x)) for x in lines], np.int64)
        self.n_repeat_words = self._repeats(doc)
        order = np.lexsort((part.word, doc))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(doc[order]) != 0) | (np.diff(part.word[order]) != 0)
        at = np.flatnonzero(new)
        #: Distinct words: text, hash, count.
        self.word_doc, self.word_hash, self.word_count = doc[order][at], part.word[order][at], np.diff(np.append(at, len(order)))
        top = np.zeros(n, np.int64)
        np.maximum.at(top, self.word_doc, self.word_count)
        share = {k: np.diff(np.concatenate(([0], np.cumsum(m[buffer])))[part.base]) for k, m in CLASSES.items()}
        w, c = np.maximum(self.n_words, 1), np.maximum(self.word_chars, 1)
        self.matrix = np.column_stack(
            [
                np.log1p(self.n_words), self.word_chars / w, self.n_symbols / w, self.n_dup_lines / np.maximum(self.n_lines, 1), self.n_repeat_words / w,
                share["upper"] / c, share["digit"] / c, share["punct"] / c, share["foreign"] / c, self.n_words / np.maximum(self.n_lines, 1),
                np.bincount(self.word_doc, minlength=n) / w, top / w, total(length <= 3) / w, total(length >= 12) / w,
            ]
        )

    def _repeats(self, doc: np.ndarray) -> np.ndarray:
        """Words in windows of three words that occur twice or more in their text."""
        n, words = len(self.n_words), self.part.word
        if len(words) < 3:
            return np.zeros(n, np.int64)
        gram = self.part.runs(3, WORDS)
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        order = inside[np.lexsort((gram[inside], doc[inside]))]
        same = (np.diff(doc[order]) == 0) & (np.diff(gram[order]) == 0)
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.zeros(len(words), bool)
        for k in range(3):
            hit[order[twice] + k] = True
        return np.bincount(doc, weights=hit, minlength=n).astype(np.int64)
