"""The pipeline against its stages' rules on a small corpus."""

import random

import corpus_pipeline
from assetspan.llm import queries
from assetspan.llm._common import ALNUM


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    alphabets = {"aa": "abcdefg", "bb": "uvwxyzé"}

    def say(n, lang):
        return " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(3, 8))) for _ in range(n))

    rows = [(i, say(90, lang), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    leak, passage = say(20, "aa"), say(60, "bb")
    rows += [(100, rows[3][1], "bb"), (101, rows[4][1] + " " + say(3, "aa"), "aa"), (102, "123 456", None), (103, None, None), (104, say(40, "aa") + " " + leak + " " + say(40, "aa"), "aa"), (105, say(30, "bb") + " " + passage, "bb"), (106, passage + " " + say(30, "bb"), None)]
    docs = spark.createDataFrame([(i, t, k, "s", len(t or ""), "kept") for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "encoding"]
    state, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        state = stage(spark, state, str(tmp_path))
        state.write.parquet(f"{tmp_path}/{i}")
        state = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({r.doc_id: r for r in state.collect()})
        if name != "encoding":
            assert state.columns == docs.columns and {r.extra for r in seen[-1].values()} == {"kept"}
    language, near, cut, clean, coded = seen
    assert set(language) == {i for i, _, _ in rows} - {102, 103}
    assert set(near) == set(language) - {100, 101}
    assert near[105].text == language[105].text and cut[106].text.split() == near[106].text.split()[60:] and cut[106].n_chars == len(cut[106].text)
    assert set(clean) == set(cut) and b" ".join(clean[104].text.encode().translate(ALNUM).split()).find(leak.encode()) < 0 and len(clean[104].text.split()) == 80
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r.ids_sha256 for i, r in coded.items()} and set(whole) == set(clean)


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_stages_take_empty_tables_and_odd_rows(spark, tmp_path):
    words = [f"word{i} and more of it" for i in range(40)]
    long = " ".join(words)
    rows = [(1, long, "en"), (1, long, "en"), (1, "a text of its own, " + " ".join(words[:3]), "en"), (2, long + " end", None), (None, long, "en"), (None, None, None), (3, None, "en"), (4, "", "en"), (5, "x", "en")]
    docs = spark.createDataFrame([(i, t, k, "s", None, k) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars int, _row string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = {"language_id": [None, 1, 1, 1, 2, 5], "near_dedup": [None, None, 1, 1, 3, 4, 5], "substring_dedup": [None, None, 1, 1, 1, 2, 3, 4, 5], "decontamination": [None, None, 1, 1, 1, 2, 3, 4, 5], "encoding": [None, None, 1, 1, 1, 2, 3, 4, 5]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert sorted((r.doc_id for r in out.collect()), key=lambda i: -1 if i is None else i) == expected[name], name
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == out.columns
        if name != "encoding":
            assert out.columns == docs.columns
