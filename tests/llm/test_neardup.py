"""Near-duplicate classes against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assetspan.llm import neardup
from assetspan.llm._common import ALNUM

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    sets, parent = {}, {}
    for i, t in rows:
        parent[i] = i
        w = (t or "").encode().translate(ALNUM).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, t in rows:
        for j, u in rows:
            if i < j and t is not None and u is not None:
                o = len(sets[i] & sets[j])
                if t == u or (sets[i] and sets[j] and o >= 0.8 * (len(sets[i]) + len(sets[j]) - o)):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(base)]
    for k in range(60):  # a large group of near copies, some of them too far from the rest
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 8])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [texts[3]] * 5 + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    texts += ["", "", None, None, "!!!", "!!!", "one two", "One, two.", "a", " ".join(rng.choice(words) for _ in range(20000))]
    order = list(enumerate(texts))
    rng.shuffle(order)
    return [(k, t) for k, (_, t) in enumerate(order)]


def run(spark, rows):
    return neardup.classes(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA))


@pytest.mark.parametrize(("small", "block"), [(32, 2048), (3, 2048), (3, 6)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK_OUTSIDE", block)
    monkeypatch.setattr(neardup, "BLOCK_ALL", block)
    rows = corpus()
    found = {r[0]: r[1] for r in run(spark, rows).collect()}
    assert found == brute(rows)


def test_near_copies_that_repeat_different_passages_are_linked(spark):
    """Set Jaccard is a little over 0.8, whatever each text repeats."""
    rng, texts = random.Random(5), []
    for _ in range(16):
        words = ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(600)]
        shared, tails = words[:500], (words[500:550], words[550:])
        for k, tail in enumerate(tails):
            passage = shared[100 * k + 50 : 100 * k + 150]
            texts.append(" ".join(shared + tail + passage * 20))
    rows = list(enumerate(texts))
    expected = brute(rows)
    assert set(expected.values()) == set(range(0, 32, 2))
    assert {r[0]: r[1] for r in run(spark, rows).collect()} == expected


def test_blocks_find_links_between_classes():
    rng = np.random.default_rng(0)
    base = np.sort(rng.choice(10**6, 100, replace=False))
    far = np.sort(np.concatenate([base[:50], rng.choice(10**6, 50)]))
    rows = [("x", 5, 5, 100, base), ("y", 1, 1, 100, base), ("y", 2, 2, 100, far), ("y", 5, 5, 100, base)]
    pdf = pd.DataFrame(rows, columns=["role", "node", "label", "common", "set"])
    assert neardup._compare(pdf).values.tolist() == [[1, 5]]


def test_signature_agreement_estimates_probability_jaccard():
    shared, a, b = np.arange(400, dtype=np.uint64), np.arange(1000, 1100, dtype=np.uint64), np.arange(2000, 2100, dtype=np.uint64)
    from assetspan.llm._common import mix

    s = mix(np.concatenate([shared, a, shared, b]))
    doc = np.repeat([0, 1], 500)
    sig = neardup.signatures(doc, s, np.ones(1000), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.05


def test_odd_rows(spark):
    df = run(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)])
    assert sorted(df.collect(), key=str) == sorted([(1, 1), (1, 1), (None, None), (2, 1), (3, 3)], key=str)
    assert run(spark, []).count() == 0


def test_one_of_each_class_stays(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (3, "quite another text", "y"), (1, "a b c d e f", "x"), (None, "z", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    left = neardup.survivors(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3]
    assert left.where(F.col("class_id") == "y").count() == 1


def test_rows_of_one_id_with_different_texts_are_different_documents(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a, "first"), (2, b, "x"), (2, a, "copy"), (2, b, "again"), (3, b.replace("v7 ", "u "), "near"), (3, "alone", "y"), (None, a, "no id"), (4, None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    assert sorted(docs.select("doc_id").join(neardup.classes(docs).distinct(), "doc_id").distinct().collect(), key=str) == sorted([(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 4)], key=str)
    kept = neardup.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(r.th for r in kept.collect() if r.doc_id != 2) == ["first", "no id", "null", "y"]
    assert [r.text for r in kept.where("doc_id = 2").collect()] == [b]
    assert neardup.survivors(docs.limit(0)).count() == 0


def test_word_hashes_depend_on_the_word_alone():
    from assetspan.llm import _common

    words = [b"a", b"ab" * 5000, b"b", b"a", b"ab" * 5000, b"c" * 9000, b"ab" * 4999]
    buffer = np.frombuffer(b" ".join(words), np.uint8)
    hashes = _common.word_hashes(buffer, *_common.word_bounds(buffer, neardup.IS_WORD)).tolist()
    assert hashes[0] == hashes[3] and hashes[1] == hashes[4] and len(set(hashes)) == 5
