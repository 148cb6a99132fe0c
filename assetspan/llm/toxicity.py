"""Toxicity: a weighted finite-state grammar over the words of clauses.

Words are read as symbols: insult, threat verb, intent (will, going to), target (you, they), negation, reported speech, other.  One small transducer for each
of insult, threat, target, negation and reported speech maps a clause's symbols to factors; composed, they are one machine whose factor at an
insult or threat, times that word's weight, is added up over the clause.  So an insult weighs more next to a target, less after
a negation or under reported speech, and a single word is not judged by itself.  A document's score is a logistic function
of its clauses' total and highest weight.

Insult stems come from a bounded sample of labelled documents (TRAIN_ROWS): word beginnings that stand after many different words in
toxic documents (LEAST_CONTEXTS, so that copies of one document don't count) and hardly ever in others, weighted by their log-odds.
The sample also fits the logistic function.  The short lists below are a prior for words the sample lacks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetspan.llm._common import chunks
from assetspan.llm.labelled import remainder, sample

TRAIN_ROWS = 4000
STEMS, LEAST_CONTEXTS, LEAST_ODDS, WHOLE = (4, 5, 6), 15, 20.0, 24
#: A beginning is passed over for a longer one with odds so many times higher.
SHARPER = 1.5

WORDS = {
    "insult": "idiot moron stupid imbecile scum loser pathetic worthless disgusting trash clown bastard dumbass arschloch trottel dummkopf connard abruti crétin gilipollas imbécil estúpido".split(),
    "threat": "kill hurt destroy beat punch strangle shoot stab töten umbringen tuer frapper matar golpear".split(),
    "intent": "will gonna going shall should werde werden vais voy".split(),
    "target": "you your youre he she they them him her du dich dein ihr euch tu toi vous ton tú te ti usted ustedes".split(),
    "negation": "not never no isnt arent wasnt dont hardly nicht kein keine nie pas jamais aucun nunca jamás ni".split(),
    "report": "said says wrote called calls quoted quote according alleged reported sagte schrieb nannte dit écrit appelé dijo escribió llamó".split(),
}
PRIOR = 1.0
WORD = re.compile(r"\w+")
#: Words of a clause; a verb with a shortened "not" is one word, and a negation.
SPOKEN = re.compile(r"\w+n['’]t\b|\w+")
CLAUSE = re.compile(r"[.!?;:\n\"“”«»]")


class Machine:
    """A deterministic transducer: (state, symbol) -> (state, factor); symbols without a rule keep the state, at factor 1."""

    def __init__(self, start: object, rules: dict[tuple[object, str], tuple[object, float]]):
        self.start, self.rules = start, rules

    def step(self, state: object, symbol: str) -> tuple[object, float]:
        return self.rules.get((state, symbol), (state, 1.0))

    def compose(self, other: Machine) -> Machine:
        """Both on the same input, factors multiplied; only states that can be reached."""
        symbols = {*WORDS, "other"}
        start, rules = (self.start, other.start), {}
        todo = [start]
        seen = {start}
        while todo:
            state = todo.pop()
            for symbol in symbols:
                (a, x), (b, y) = self.step(state[0], symbol), other.step(state[1], symbol)
                rules[state, symbol] = ((a, b), x * y)
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return Machine(start, rules)


#: After one insult, the next in the clause weighs more.
INSULT = Machine(0, {(0, "insult"): (1, 1.0), (1, "insult"): (1, 1.2)})
#: A threat verb counts in full after a word of intent, else little.
THREAT = Machine(0, {(0, "intent"): (1, 1.0), (0, "threat"): (0, 0.3), (1, "threat"): (0, 1.0)})
#: Once the clause has named a target, insults and threats weigh more.
TARGET = Machine(0, {(0, "target"): (1, 1.0), (1, "insult"): (1, 1.5), (1, "threat"): (1, 1.5)})
#: A negation weakens what follows within three words.
NEGATION = Machine(
    0,
    {(0, "negation"): (3, 1.0)}
    | {(k, s): (k - 1, 0.3 if s in ("insult", "threat") else 1.0) for k in (1, 2, 3) for s in (*WORDS, "other") if s != "negation"}
    | {(k, "negation"): (3, 1.0) for k in (1, 2, 3)},
)
#: Reported speech weakens the rest of the clause.
REPORT = Machine(0, {(0, "report"): (1, 1.0), (1, "insult"): (1, 0.6), (1, "threat"): (1, 0.6)})
GRAMMAR = INSULT.compose(THREAT).compose(TARGET).compose(NEGATION).compose(REPORT)


class Scorer:
    """stems: beginning -> weight of an insult; a beginning that ends in "$" is a whole word."""

    def __init__(self, stems: dict[str, float]):
        words = {w + "$": PRIOR for w in WORDS["insult"]} | stems
        self.weight = words | {w + "$": PRIOR for w in WORDS["threat"]}
        self.symbol = {w: s for s, ws in WORDS.items() for w in ws}
        ordered = sorted(self.weight, key=lambda w: (-len(w), w))
        self.search = re.compile(r"\b(?:" + "|".join(re.escape(w[:-1]) + r"\b" if w.endswith("$") else re.escape(w) for w in ordered) + ")")
        self.logit = np.array([-4.0, 2.0, 1.0])

    def hit(self, word: str) -> float:
        for w in (word + "$", *(word[:k] for k in STEMS[::-1])):
            if w in self.weight:
                return self.weight[w]
        return 0.0

    def clauses(self, text: str | None) -> list[float]:
        """Weights of the clauses that hold an insult or a threat."""
        if not text:
            return []
        text, out, end = text.lower(), [], -1
        for m in self.search.finditer(text):
            if m.start() < end:
                continue
            start = max(end, *(text.rfind(c, max(0, end), m.start()) for c in ".!?;:\n\"“”«»")) + 1  # from the last clause's end on, so that the text is read once
            stop = CLAUSE.search(text, m.end())
            end = stop.start() if stop else len(text)
            state, total = GRAMMAR.start, 0.0
            for word in SPOKEN.findall(text[start:end]):
                weight = self.hit(word)
                symbol = "threat" if self.symbol.get(word) == "threat" else "insult" if weight else "negation" if word.endswith(("n't", "n’t")) else self.symbol.get(word, "other")
                state, factor = GRAMMAR.step(state, symbol)
                total += factor * weight
            if total > 0:
                out.append(total)
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        weights = self.clauses(text)
        return (float(np.log1p(sum(weights))), max(weights)) if weights else (0.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps."""
        x = np.column_stack([np.ones(len(x)), x])
        b = np.zeros(3)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            b = b - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (p - y) + 0.05 * b)
        self.logit = b

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit[0] + features @ self.logit[1:], -30, 30)))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (beginning, word before, label) of each batch."""
    for b in chunks(batches, "text"):
        found = set()
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            before = ""
            for word in WORD.findall((text or "").lower()):
                if len(word) >= STEMS[0] and not word.isdigit():
                    found.update((word[:k], before, label) for k in STEMS if k < len(word))
                    if len(word) <= WHOLE:
                        found.add((word + "$", before, label))
                before = word
        rows = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64())], ["stem", "before", "label"])


def stems(train: DataFrame) -> dict[str, float]:
    """Beginnings of words that mark toxic documents, from rows (_label, text); none has another one of them as its beginning."""
    sides = train.select(F.col("_label").cast("long").alias("label"), "text")
    n = {r[0]: r[1] for r in sides.groupBy("label").count().collect()}
    if len(n) < 2:
        return {}
    found = (
        sides.mapInArrow(_contexts, "stem string, before string, label long").groupBy("stem")
        .agg(F.countDistinct(F.when(F.col("label") == 1, F.col("before"))).alias("toxic"), F.countDistinct(F.when(F.col("label") == 0, F.col("before"))).alias("clean"))
        .where(f"toxic >= {LEAST_CONTEXTS}")
        .withColumn("odds", (F.col("toxic") + 0.5) / n[1] / ((F.col("clean") + 0.5) / n[0]))
        .where(f"odds >= {LEAST_ODDS}")
    )
    odds = {r["stem"]: r["odds"] for r in found.collect()}  # of a bounded sample
    out: dict[str, float] = {}
    for stem in sorted(odds, key=lambda w: (len(w.rstrip("$")) + w.endswith("$"), w)):
        word = stem.rstrip("$")
        sharper = any(odds[x] >= SHARPER * odds[stem] for x in odds if x != stem and x.startswith(word) and not stem.endswith("$"))
        if not sharper and not any(word[:k] in out for k in STEMS):
            out[stem] = float(np.log(odds[stem]))
    return out


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Scorer:
    """A scorer from labels of documents whose crc32(doc_id) mod 5 is not 0; where these don't hold both labels, the lists and fixed factors."""
    train = sample(docs.select("doc_id", "text"), labels, "toxic", remainder(F.col("doc_id"), 5) != 0, rows)
    scorer = Scorer(stems(train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            x = np.array([scorer.features(t) for t in b.column(1).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], ["label", "total", "top"])

    got = train.select(F.col("_label").cast("long").alias("label"), "text").mapInArrow(run, "label long, total double, top double").toPandas()
    if got["label"].nunique() == 2:
        got = got.sort_values(["label", "total", "top"])
        scorer.fit(got[["total", "top"]].to_numpy(), got["label"].to_numpy(float))
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_clauses (those with an insult or threat).

    Null and empty texts have no clause and the score that goes with none.  A row without doc_id is not held out.  Repeated rows give
    repeated rows; other columns are ignored; an empty table gives an empty one.  A text of any length is read whole, once from left to right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            weights = [scorer.clauses(t) for t in b.column(1).to_pylist()]
            x = np.array([(np.log1p(sum(w)), max(w)) if w else (0.0, 0.0) for w in weights]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(scorer.score(x)), pa.array(list(map(len, weights)), pa.int64())], ["doc_id", "score", "n_clauses"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_clauses long")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")
