"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A text's bytes are cut into windows of WINDOW bytes.  In each window one recurrent layer of HIDDEN units runs forwards and one
backwards; at every byte the two states give probabilities of the languages, and the mean over all bytes of the text
is the text's.  Gates are hard sigmoids and candidates hard tangents, which cost no exponentials:
    z, r = clip(0.25 (x + U h) + 0.5, 0, 1)    n = clip(x_n + r (U_n h), -1, 1)    h' = n + z (h - n)
Trained on the driver by backpropagation through time with Adam, from a bounded sample: for each language at most TRAIN_TEXTS
documents, chosen by hash, and of each at most TRAIN_WINDOWS stretches of TRAIN_WIDTH bytes, spread over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetspan.llm._common import chunks, packed, raw, unpacked
from assetspan.llm.labelled import remainder

HIDDEN, WINDOW = 8, 64
TRAIN_TEXTS, TRAIN_WINDOWS, TRAIN_WIDTH = 300, 16, 32
STEPS, BATCH, RATE = 250, 256, 0.02
LANES = 2048
PAD = 256
UNKNOWN = "und"
#: Pipeline: documents whose best language is less likely than this are rejected.
LEAST_SCORE = 0.35

#: A letter is a character of category L.
has_letter = regex.compile(r"\p{L}").search


class Network:
    """Weights: e [2, 3H, 257] input and bias of each byte, u [2, 3H, H], w [2, K, H], b [K]; rows are z, r, n."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng, h, k = np.random.default_rng(seed), HIDDEN, len(languages)
        self.languages = languages
        self.e = rng.normal(0, 0.5, (2, 3 * h, 257)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (2, 3 * h, h)).astype(np.float32)
        self.w = rng.normal(0, 0.3, (2, k, h)).astype(np.float32)
        self.b = np.zeros(k, np.float32)
        self._pad()

    def _pad(self) -> None:
        self.e[:, :, PAD] = 0
        self.e[:, :HIDDEN, PAD] = 1e3  # z = 1: the state stays as it is

    def states(self, text: np.ndarray, keep: bool = False) -> tuple:
        """text [T, B] bytes; states [T, 2, H, B], the backward ones at T - 1 - t, and with `keep` what training needs."""
        t_all, lanes = text.shape
        h = np.zeros((2, HIDDEN, lanes), np.float32)
        out = np.empty((t_all, 2, HIDDEN, lanes), np.float32)
        x = np.empty((2, 3 * HIDDEN, lanes), np.float32)
        saved = []
        g2 = 2 * HIDDEN
        for t in range(t_all):
            np.take(self.e[0], text[t], axis=1, out=x[0], mode="clip")
            np.take(self.e[1], text[t_all - 1 - t], axis=1, out=x[1], mode="clip")
            u = np.matmul(self.u, h)
            gate = x[:, :g2] + u[:, :g2]
            gate *= 0.25
            gate += 0.5
            np.clip(gate, 0, 1, out=gate)
            n = gate[:, HIDDEN:] * u[:, g2:]
            n += x[:, g2:]
            np.clip(n, -1, 1, out=n)
            if keep:
                saved.append((h, gate, n, u[:, g2:]))
            h = h - n
            h *= gate[:, :HIDDEN]
            h += n
            out[t] = h
        return out, saved

    def probabilities(self, text: np.ndarray, states: np.ndarray) -> np.ndarray:
        """[T, K, B] probabilities at each byte."""
        t_all = len(text)
        logits = np.matmul(self.w[0], states[:, 0])
        logits += np.matmul(self.w[1], states[::-1, 1])
        logits += self.b[:, None]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits.reshape(t_all, len(self.b), -1)

    def gradients(self, text: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean cross-entropy over all bytes."""
        t_all, lanes = text.shape
        states, saved = self.states(text, True)
        p = self.probabilities(text, states)
        loss = -float(np.log(p[:, label, np.arange(lanes)] + 1e-9).mean())
        d = p
        d[:, label, np.arange(lanes)] -= 1
        d /= t_all * lanes
        de, du = np.zeros_like(self.e), np.zeros_like(self.u)
        dw = np.stack([np.einsum("tkb,thb->kh", d, states[:, 0]), np.einsum("tkb,thb->kh", d, states[::-1, 1])])
        db = d.sum((0, 2))
        dh = np.zeros((2, HIDDEN, lanes), np.float32)
        for t in range(t_all - 1, -1, -1):
            h, gate, n, un = saved[t]
            dh[0] += self.w[0].T @ d[t]
            dh[1] += self.w[1].T @ d[t_all - 1 - t]
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            dn = dh * (1 - z) * (np.abs(n) < 1)
            dz = dh * (h - n) * 0.25 * ((z > 0) & (z < 1))
            dr = dn * un * 0.25 * ((r > 0) & (r < 1))
            dx = np.concatenate([dz, dr, dn], 1)
            dpre = np.concatenate([dz, dr, dn * r], 1)
            du += np.matmul(dpre, h.transpose(0, 2, 1))
            for side, at in ((0, text[t]), (1, text[t_all - 1 - t])):
                np.add.at(de[side].T, at, dx[side].T)
            dh = dh * z + np.matmul(self.u.transpose(0, 2, 1), dpre)
        return [de, du, dw, db], loss

    def train(self, windows: np.ndarray, label: np.ndarray, steps: int = STEPS) -> list[float]:
        """windows [N, T] bytes with the index of their language each; languages are drawn alike often."""
        rng = np.random.default_rng(11)
        rows = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        weights = [self.e, self.u, self.w, self.b]
        first, second = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
        losses = []
        for step in range(1, steps + 1):
            k = rng.integers(len(rows), size=BATCH)
            pick = np.array([rows[i][rng.integers(len(rows[i]))] for i in k])
            grads, loss = self.gradients(windows[pick].T.astype(np.int64), k)
            losses.append(loss)
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for x, g, m, v in zip(weights, grads, first, second):
                np.clip(g, -0.5, 0.5, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self._pad()
        return losses

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """[texts, K]: the mean over all bytes of each text; empty texts have zeros."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        count = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(texts)), count)
        flat = np.full((int(count.sum()), WINDOW), PAD, np.int16)
        place = np.repeat((np.cumsum(count) - count) * WINDOW, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat.ravel()[place] = np.frombuffer(b"".join(texts), np.uint8)
        total = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(flat), LANES):
            text = np.ascontiguousarray(flat[a : a + LANES].T)
            p = self.probabilities(text, self.states(text)[0])
            if (text[-1] == PAD).any():
                p *= (text != PAD)[:, None, :]
            np.add.at(total, doc[a : a + LANES], p.sum(0).T)
        return total / np.maximum(size, 1)[:, None]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        lang, out = [], []
        for name, text in zip(b.column(0).to_pylist(), raw(b, "text")):
            n = len(text) // TRAIN_WIDTH
            at = sorted({round(i * (n - 1) / max(1, TRAIN_WINDOWS - 1)) for i in range(TRAIN_WINDOWS)}) if n else []
            parts = [text[i * TRAIN_WIDTH : (i + 1) * TRAIN_WIDTH] for i in at]
            out += parts
            lang += [name] * len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["lang", "bytes"])


def learn(docs: DataFrame, texts: int = TRAIN_TEXTS) -> Network | None:
    """A network from text and lang of documents whose crc32(doc_id) mod 3 is not 1; None if none of them has both.

    Texts of fewer than TRAIN_WIDTH bytes are not learned from.  Of rows with the same doc_id and lang the least text counts.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(remainder(F.col("doc_id"), 3) != 1)
    slot = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(texts))
    chosen = known.groupBy("lang", slot.alias("slot")).agg(F.min("doc_id").alias("doc_id")).select("lang", "doc_id")
    once = docs.select("doc_id", "lang", "text").where("text is not null").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    got = once.select("lang", "text").mapInArrow(_windows, "lang string, bytes binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "bytes"], kind="stable")
    languages = sorted(got["lang"].unique())
    network = Network(languages)
    windows = np.frombuffer(b"".join(got["bytes"]), np.uint8).reshape(-1, TRAIN_WIDTH)
    network.train(windows, np.searchsorted(languages, got["lang"]))
    return network


def _predict(network: Network | None):
    """Adds lang_pred and score; without a network lang_pred of a text with a letter is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            texts = raw(b, "text")
            ok = [t is not None and has_letter(t.decode()) is not None for t in texts]
            p = network.pooled([t if k else b"" for t, k in zip(texts, ok)]) if network else np.zeros((len(texts), 1))
            best = p.argmax(1)
            lang = [UNKNOWN if not k else network.languages[i] if network else None for i, k in zip(best.tolist(), ok)]
            score = np.clip(np.where(ok, p.max(1), 0.0), 0, 1)
            yield b.append_column("lang_pred", pa.array(lang, pa.string())).append_column("score", pa.array(score))

    return run


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0, as is all text without a network.  A row without doc_id is not held out.
    Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty one.  Texts of any length are read whole.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(network), "doc_id long, text string, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), "score")


def accepted(docs: DataFrame, network: Network | None, least: float = LEAST_SCORE) -> DataFrame:
    """docs without those whose language is unknown or less likely than `least`; without a network those with a letter stay.

    Null texts and texts without a letter go; repeated rows are judged alike; an empty table gives an empty one.
    """
    p = packed(docs)
    schema = T.StructType([*p.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = p.mapInArrow(_predict(network), schema)
    return unpacked(out.where("lang_pred is null" if network is None else (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs)
