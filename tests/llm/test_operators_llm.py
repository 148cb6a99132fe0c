"""Operators of the subpackage against brute force, round trips and held-out labels, with odd rows of every kind."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from assetspan.llm import bpe, decontaminate, extract, langid, quality_fm, quality_rules, queries, sharding, substring, toxicity
from assetspan.llm.html_pages import PAGES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _words int, starts string"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 7))) for _ in range(400)]


def say(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, 1, "x") for i, t in rows], SCHEMA)


def odd_rows():
    passage, hot = say(70, 1), "the same line again and again " * 3
    rows = [(i, f"{say(30 + i, 10 + i)} {passage if i % 3 == 0 else ''} {hot} {say(20, 50 + i)}") for i in range(24)]
    rows += [(24, rows[0][1]), (25, rows[3][1]), (26, None), (27, ""), (28, " \n\t "), (29, "x" * 3000), (30, say(15000, 9) + passage), (30, say(5, 3)), (5, rows[5][1]), (None, passage), (31, "ÄÖ ñ!\n\nÄÖ ñ!\n"), (32, "日本語 text 12345")]
    return rows


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_encoding_is_that_of_tiktoken_and_comes_back(spark):
    path, pattern = queries.VOCABULARY, public_tokenizers.PATTERN
    ranks = bpe.encoder(path, pattern).ranks
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = odd_rows() + [(40, "<|endoftext|> it's  a\t\ttest \n\n "), (41, "é" * 1500 + "ab" * 900)]
    out = bpe.encode(frame(spark, rows), path, pattern)
    expected = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert by_id(out) == sorted(expected, key=str)
    back = {(r[0], bytes(r[1]).decode()) for r in bpe.decode(out, path, pattern).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert bpe.encode(frame(spark, []), path, pattern).count() == 0


def test_pair_table_holds_all_pairs():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 45, 5000))
    t = bpe.PairTable(keys, np.arange(len(keys)))
    assert (t.get(keys >> 32, keys & 0xFFFFFFFF) == np.arange(len(keys))).all() and t.get(np.array([-1]), np.array([3]))[0] == bpe.NONE


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(10, len(w))
        for i in range(max(0, len(w) - k + 1) if w else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_decontamination(spark, block):
    a = say(40, 77)
    items = [(1, a), (2, "Three Small words"), (10, a[: len(a) // 2]), (3, None), (4, "..."), (5, "the same line again"), (5, say(12, 78)), (None, say(11, 79))]
    rows = [(i, (t + " " + a.upper() if i == 2 else t)) for i, t in odd_rows() if t is None or len(t) < 5000] + [(50, "x three, small! WORDS three small words y"), (51, say(12, 78) + "\n" + say(11, 79))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    found = decontaminate.report(decontaminate.find(docs.select("doc_id", "text"), bench, block_bytes=block))
    assert by_id(found) == sorted(((i, *brute_hits(t, items)) for i, t in rows), key=str)
    clean = decontaminate.clean(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns and decontaminate.decontaminate(clean, bench).where("n_hit > 0 and n_words > 60").count() == 0
    assert {r.doc_id: r.text for r in clean.collect()}[50] == "x y"
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_blocks_of_a_benchmark_are_bounded(spark):
    items = [(i, "x" * (10 + i % 7)) for i in range(300)] + [(1, "x" * 11)] * 500 + [(7, "y" * 900)]
    parts = list(decontaminate.blocks(spark.createDataFrame(items, "item_id long, text string"), 100))
    assert all(len(p) == 1 or sum(len(t) for _, t in p) <= 100 for p in parts)
    assert sorted(x for p in parts for x in p) == sorted({(i, t.encode()) for i, t in items})


def brute_removed(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            if i is not None:
                key = b" ".join(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[b" ".join(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 12])
def test_substring_dedup(spark, window):
    rows = odd_rows()
    assert by_id(substring.dedup(frame(spark, rows), window)) == brute_removed(rows, window)
    docs = frame(spark, [(i, t) for i, t in rows if i is not None])
    clean = substring.clean(docs, window)
    assert clean.columns == docs.columns
    kept = {(r.doc_id, len((r.text or "").encode().split())) for r in clean.collect()}
    assert kept <= {(i, n - m) for i, n, m, _ in brute_removed(rows, window)}
    assert substring.dedup(frame(spark, []), window).count() == 0


def test_factors_are_the_longest_matches_with_earlier_documents():
    rng = np.random.default_rng(2)
    words = [b"w%d" % i for i in rng.integers(0, 3, 400)]
    segments = [(1, words[:120]), (2, words[60:90] + [b"x"] + words[:70]), (3, words[20:110] + words[:40]), (3, words[200:260]), (2, words[200:250])]
    window = 12
    block = substring.Block([b" ".join(w) for _, w in segments], np.array([d for d, _ in segments]), window)

    def longest(doc, words):
        best = 0
        for d, other in segments:
            if d < doc:
                for k in range(len(other)):
                    n = 0
                    while n < len(words) and k + n < len(other) and words[n] == other[k + n]:
                        n += 1
                    best = max(best, n)
        return best if best >= window else 0

    size, ref = block.longest()
    at = 0
    expected = []
    for s, (d, w) in enumerate(segments):
        upto = -1
        for p in range(len(w)):
            n = longest(d, w[p:])
            assert size[at] == n
            assert not n or ref[at] < d
            if n and p > upto - window:
                expected.append((s, p, n))
                upto = p + n
            at += 1
    assert [f[:3] for f in block.parse()] == expected and len(expected) >= 4


def test_spans_come_from_factors(spark, monkeypatch):
    """Without the factors of the blocks only whole copies would go."""
    rows = odd_rows()
    monkeypatch.setattr(substring, "_factors", lambda window: lambda batches: iter(()))
    found = {r.doc_id: r.n_removed for r in substring.dedup(frame(spark, rows), 12).collect() if r.doc_id is not None}
    full = {i: m for i, _, m, _ in brute_removed(rows, 12) if i is not None}
    assert any(found[i] < m for i, m in full.items())


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_lose_no_run(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([f"a{rng.randrange(9)}" for _ in range(30)] + passage[rng.randrange(5) :] + [f"b{rng.randrange(9)}" for _ in range(30)])) for i in range(12)]
    assert by_id(substring.dedup(frame(spark, rows), 20)) == brute_removed(rows, 20)


@pytest.mark.parametrize("hot", [1, 3000, substring.HOT])
def test_every_level_of_anchors_finds_all_runs(spark, monkeypatch, hot):
    """A phrase of 25 words in many contexts, a passage of 70 words with edges of its own, long texts that repeat one phrase, and repeated rows."""
    monkeypatch.setattr(substring, "HOT", hot)
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    phrase, passage, contexts = some(25), some(70), [some(40) for _ in range(4)]
    rows = [(i, " ".join(rng.choice(contexts)[rng.randrange(12) :] + phrase + rng.choice(contexts)[: rng.randrange(20, 40)] + some(9))) for i in range(30)]
    rows += [(i, " ".join(some(i % 7) + passage[i % 3 : 68 + i % 2] + some(5))) for i in range(30, 50)]
    rows += [(i, " ".join((phrase + ["and"]) * (40 + i % 3) + some(i % 2))) for i in range(50, 56)]
    rows += [rows[31], rows[31], (None, rows[31][1]), (60, None), (61, "")]
    assert by_id(substring.dedup(frame(spark, rows), 50)) == brute_removed(rows, 50)


def test_segments_are_bounded_whatever_a_text_repeats():
    """A million bytes of one phrase give a handful of segments, texts that only come near to that give none above 80 words."""
    rng = random.Random(3)
    phrase = [f"p{i}" for i in range(23)]
    again = " ".join(phrase * 13_000)
    near = " ".join(x for _ in range(2000) for x in phrase[:20] + [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(3))])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([again, near])], ["doc_id", "_th", "text"])
    out = pa.Table.from_batches(list(substring._segments(50, 20, "text", ("doc_id", "_th"))(iter([batch])))).to_pylist()
    assert len([r for r in out if r["doc_id"] == 1]) <= 4 and len(out) > 100
    assert all(len(r["words"].split()) == r["runs"] + 49 <= 80 for r in out)


def test_a_hot_anchor_makes_no_large_block(spark, monkeypatch):
    """300 texts that repeat one phrase, each with ends of its own: what a block gets stays below its bounds."""
    monkeypatch.setattr(substring, "HOT", 4000)
    factors = substring._factors
    monkeypatch.setattr(substring, "_factors", lambda window: factors(window, 4000))
    sizes = spark.sparkContext.accumulator(0)

    class Bounded(substring.Block):
        def __init__(self, texts, doc, window):
            if sum(map(len, texts)) > 8000:
                sizes.add(1)
            super().__init__(texts, doc, window)

    monkeypatch.setattr(substring, "Block", Bounded)
    phrase = [f"p{i}" for i in range(27)]
    rows = [(i, " ".join([f"a{i}", f"b{i}"] + phrase * 12 + [f"c{i}", f"d{i}"])) for i in range(300)]
    assert by_id(substring.dedup(frame(spark, rows), 50)) == brute_removed(rows, 50)
    assert sizes.value == 0


def test_base_rules(spark):
    rows = odd_rows()
    out = quality_rules.judge(frame(spark, rows), None)

    def base(t):
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 2000 else None
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep and len(rep) or 0 if rep is not None else None

    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect()), key=str)
    want = sorted(((i, *base(t)) for i, t in rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(w[5] is None or w[5] == g[5] for g, w in zip(got, want))
    for r in out.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)


def test_trees_keep_monotonic_features():
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 3))
    y = ((x[:, 0] + 0.3 * np.sin(6 * x[:, 1])) < 0.2).astype(float)
    trees = quality_rules.fit(x, y, np.array([True, False, False]))
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.93
    probe = np.repeat(r.normal(size=(50, 3)), 40, axis=0)
    probe[:, 0] = np.tile(np.linspace(-3, 3, 40), 50)
    assert (np.diff(trees.score(probe).reshape(50, 40), axis=1) <= 1e-12).all()


def labelled(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = say(80, i) if not bad else " ".join(w + "###" for w in say(40, i).split()) + "\n" + "buy now " * 20
        rows.append((i, text if i % 5 else f"{text} you vequx{i % 7} {WORDS[i]} vequy{i % 3} {WORDS[i + 1]}"))
        labels.append((i, int(not bad), int(i % 5 == 0)))
    return frame(spark, rows + [(1000, None), (1001, ""), (None, "x")]), spark.createDataFrame(labels + [(9999, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_learned_quality_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    scored = quality_fm.score(docs, quality_fm.learn(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held) and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, quality_rules.learn(docs, labels)).collect()}
    assert np.mean([kept[i] == bool(q) for i, q in truth.items() if i in kept]) > 0.9
    assert quality_fm.learn(docs, labels.where("quality = 1")) is None
    assert {r.score for r in quality_fm.score(docs, None).collect()} == {0.5}


def test_factorisation_machine_equals_the_sum_over_pairs():
    m = quality_fm.Machine(np.zeros(quality_fm.DENSE), np.ones(quality_fm.DENSE))
    r = np.random.default_rng(2)
    m.w[:], m.bias = r.normal(size=len(m.w)), 0.3
    slot, value = np.array([5, 9, 77]), np.array([0.5, 1.5, -2.0], np.float32)
    got = m.margin(np.zeros(3, int), slot, value, 1)[0][0]
    want = m.bias + (m.w[slot] * value).sum() + sum(m.v[slot[a]] @ m.v[slot[b]] * value[a] * value[b] for a in range(3) for b in range(a))
    assert got == pytest.approx(want, rel=1e-4)


def test_grammar_scores_clauses():
    s = toxicity.Scorer({"vequ": 2.0})
    one = lambda t: sum(s.clauses(t))
    plain = one("a vequant thing")
    assert plain == 2.0 and one("you are a vequant thing") == 3.0 and one("it is not a vequant thing") == pytest.approx(0.6)
    assert one("he said a vequant thing") == pytest.approx(2 * 1.5 * 0.6) and one("you. a vequant thing") == 2.0
    assert one("will kill you") == 1.0 and one("kill time") == pytest.approx(0.3)
    assert s.clauses("") == s.clauses(None) == s.clauses("nothing here") == []
    assert one("they are not an idiot") == one("they aren't an idiot") == one("They AREN’T an idiot") == one("they arent an idiot") < one("they are an idiot")
    assert one("I don't hurt you") == one("I dont hurt you") < one("I hurt you") and one("you're an idiot") == one("you are an idiot")
    assert len(s.clauses("vequa one. vequb two! you vequc\nnone")) == 3


def test_learned_toxicity_on_held_out_labels(spark, monkeypatch):
    docs, labels = labelled(spark)
    monkeypatch.setattr(toxicity, "LEAST_CONTEXTS", 8)
    scorer = toxicity.learn(docs, labels)
    assert "vequ" in scorer.weight
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    out = toxicity.score(docs, scorer).collect()
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(out) == docs.count() and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert toxicity.learn(docs, labels.limit(0)).clauses("you idiot") and toxicity.score(docs.limit(0), scorer).count() == 0


def test_sharding_is_even_and_keeps_groups(spark):
    rows = odd_rows() * 3 + [(i, say(1 + i % 60, i)) for i in range(100, 900)]
    out = sharding.shard(frame(spark, rows), 10).toPandas()
    assert len(out) == len(rows) and set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    big = max(16 + len((t or "").encode()) for _, t in rows) * 3
    sums = out.groupby("shard")["size"].sum()
    rest = sums.drop(sums.idxmax())
    assert sums.max() <= max(big, rest.max()) and rest.max() - rest.min() <= 0.02 * rest.max() + 64
    texts = pd.DataFrame([(zlib.crc32((t or "").encode()), 16 + len((t or "").encode())) for _, t in rows], columns=["c", "s"]).drop_duplicates()
    assert set(zip(out["text_crc32"], out["size"])) == set(texts.itertuples(index=False, name=None))
    assert (out.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
    assert sharding.shard(frame(spark, [])).count() == 0


def test_differencing_matches_a_plain_version():
    sizes = np.random.default_rng(4).integers(1, 1000, 60)
    sums = np.zeros((60, 4), np.int64)
    sums[:, -1] = sizes
    total, slots = sharding.difference(sums)
    heap = [(-int(s), i, [0, 0, 0, int(s)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        c = sorted(x + y for x, y in zip(a, b[::-1]))
        heapq.heappush(heap, (-(c[-1] - c[0]), n, c))
        n += 1
    assert total.tolist() == heap[0][2] and np.bincount(slots[:, -1], weights=sizes, minlength=4).tolist() == total.tolist()


@pytest.mark.parametrize("page", PAGES)
def test_labelled_pages_give_their_main_text(page):
    inside = page[page.index("[[") + 2 : page.index("]]")]
    blocks = [re.sub(r"\s+", " ", re.sub("<[^>]*>", "", b)).strip() for b in re.split(r"</?(?:p|h1|h2|li|ul|pre|blockquote)>", inside)]
    assert extract.main_text(page.replace("[[", "").replace("]]", "")) == "\n\n".join(b for b in blocks if b)


def test_extraction_of_odd_pages(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<p>Fish &amp; chips&nbsp;&#8211; a <b>lot</b> of\n words<br>here</p><script>var t='</p>';</script>"), (4, "u", "<nav>only a menu</nav>"), (5, "u", "no tags at all"), (6, "u", "<article><p>" + "long " * 30000 + "</p>"), (1, "u", None), (None, "v", "<p>x y z"), (7, "u", "<div class='ad'>buy this<article><h1>T</h1><p>real text of some length</p></article>")]
    out = {r.page_id: r for r in extract.extract(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, n_chars int")).collect()}
    assert out[3].text == "Fish & chips – a lot of words here" and out[1].text == out[2].text == out[4].text == "" and out[5].text == "no tags at all"
    assert out[6].n_chars == 5 * 30000 - 1 and out[None].text == "x y z" and out[7].text == "T\n\nreal text of some length"
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_clauses_are_read_from_their_start():
    s, long = toxicity.Scorer({"vequ": 2.0}), "some | " * 400
    near, far = s.clauses("you are vequal"), s.clauses("Before. you are " + long + "vequal. It is " + long + "vequal; you " + long + "vequal")
    assert far[0] == far[2] == near[0] == pytest.approx(1.5 * far[1])


BODY = "<h1>Title of it</h1><p>" + "The text goes on for a while here. " * 6 + "</p><p>And then it ends at last.</p>"
ASIDE = '<div class="sidebar"><p>Popular guides</p><p><a href="/s">Salt and pepper</a></p></div><div class="comments"><p>Ann: mine never rises, what can I do?</p></div>'


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="content with-sidebar"><div>{BODY}</div>{ASIDE}</div></body>',
        f'<body><div id="page" class="right-sidebar"><div class="post"><article>{BODY}</article></div>{ASIDE}</div></body>',
        f'<body><nav>Home</nav><article class="post comments-open category-social">{BODY}</article>{ASIDE}</body>',
        f'<body>{ASIDE}<main class="has-sidebar"><section>{BODY}</section></main></body>',
        f'<body><div id="share-page"><div class="tabs"><section class="x">{BODY}</section></div></div>{ASIDE}</body>',
        f'<body><div class="layout side"><article>{BODY}</article><div class="comment-list"><article class="comment">Bob: try fresher yeast.</article></div></div></body>',
        f'<body><div class="ad">buy this<article>{BODY}</article></body>',
    ],
)
def test_class_words_of_wrappers_and_articles_lose_no_text(page):
    assert extract.main_text(page) == "Title of it\n\n" + ("The text goes on for a while here. " * 6).strip() + "\n\nAnd then it ends at last."


def test_formulas_stay():
    page = f'<article>{BODY}<p>Area: <math><mi>A</mi><mo>=</mo><msup><mi>s</mi><mn>2</mn></msup><annotation encoding="application/x-tex">A=s^2</annotation></math> always.</p><p>More text.</p></article>'
    assert extract.main_text(page).endswith("\n\nArea: A=s2 always.\n\nMore text.")


def test_best_run_is_that_of_all_runs():
    r = random.Random(3)
    for _ in range(200):
        s = [r.randrange(-5, 6) for _ in range(r.randrange(0, 12))]
        a, b = extract.best_run(s)
        assert sum(s[a:b]) == max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])


def test_backpropagation_through_time():
    net = langid.Network(["a", "b", "c"], 1)
    net.e, net.u, net.w, net.b = (x.astype(np.float64) for x in (net.e * 0.3, net.u, net.w, net.b))
    net._pad()
    text, label = np.random.default_rng(0).integers(0, 256, (7, 5)), np.array([0, 1, 2, 1, 0])
    grads, _ = net.gradients(text, label)
    r = np.random.default_rng(1)
    for x, g, step in ((net.u, grads[1], 1e-3), (net.w, grads[2], 1e-3), (net.b, grads[3], 1e-3)):
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in x.shape)
            old = x[at]
            x[at] = old + step
            up = net.gradients(text, label)[1]
            x[at] = old - step
            down = net.gradients(text, label)[1]
            x[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=0.1, abs=2e-3)


def test_languages_on_held_out_texts(spark):
    alphabets = {"aa": "abcde ", "bb": "vwxyzé ", "cc": "mnopq "}
    r = random.Random(1)
    rows = [(i, "".join(r.choice(alphabets[k]) for _ in range(150)), k) for i, k in enumerate(list(alphabets) * 60)]
    rows += [(500, None, "aa"), (501, "123 ...", "aa"), (502, "abc", None), (None, "abcde", "aa"), (1, rows[1][1], "bb")]
    docs = spark.createDataFrame([(i, t, k, 1.0) for i, t, k in rows], "doc_id long, text string, lang string, score double")
    net = langid.learn(docs)
    out = langid.predict(docs, net).collect()
    truth = {i: k for i, _, k in rows}
    assert len(out) == len(rows) and np.mean([r.lang_pred == truth[r.doc_id] for r in out if r.held_out and r.doc_id < 500]) > 0.97
    odd = {r.doc_id: (r.lang_pred, r.score) for r in out if r.doc_id in (500, 501)}
    assert odd == {500: ("und", 0.0), 501: ("und", 0.0)}
    kept = langid.accepted(docs, net)
    assert kept.columns == docs.columns and not {500, 501} & {r.doc_id for r in kept.collect()}
    assert langid.learn(docs.where("lang is null")) is None and langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0
    assert langid.accepted(docs.limit(0), net).count() == 0


def test_composed_grammar_equals_its_machines_run_apart(spark):
    """A brute-force score: clauses split at the marks, each machine by itself, factors multiplied."""
    scorer = toxicity.Scorer({"vequ": 2.0, "snor$": 1.5})
    machines = [toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT]
    pool = [w for ws in toxicity.WORDS.values() for w in ws] + ["vequal", "vequ", "snor", "snore", "grass", "river", "ist", "é"] * 6

    def brute(text):
        out = []
        for clause in re.split(r"[.!?;:\n\"“”«»]", (text or "").lower()):
            states, total = [m.start for m in machines], 0.0
            for word in re.findall(r"\w+", clause):
                weight = next((scorer.weight[w] for w in (word + "$", *(word[:k] for k in (6, 5, 4))) if w in scorer.weight), 0.0)
                symbol = "threat" if word in toxicity.WORDS["threat"] else "insult" if weight else next((s for s, ws in toxicity.WORDS.items() if word in ws), "other")
                for i, m in enumerate(machines):
                    states[i], factor = m.step(states[i], symbol)
                    weight *= factor
                total += weight
            if total > 0:
                out.append(total)
        return out

    r = random.Random(8)
    texts = [" ".join(r.choice(pool) + r.choice(["", "", "", ",", ".", "!", ";", ' "', "\n"]) for _ in range(r.choice([0, 1, 5, 40, 400]))) for _ in range(200)] + [None, "", "...", "vequal " * 3000]
    for text in texts:
        assert scorer.clauses(text) == pytest.approx(brute(text))
    rows = {r.doc_id: r for r in toxicity.score(frame(spark, list(enumerate(texts))), scorer).collect()}
    for i, text in enumerate(texts):
        w = brute(text)
        margin = scorer.logit @ np.array([1.0, np.log1p(sum(w)), max(w, default=0.0)])
        assert rows[i].score == pytest.approx(1 / (1 + np.exp(-margin))) and rows[i].n_clauses == len(w)


def test_node_arrays_equal_a_plain_walk_down_each_tree():
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 4))
    trees = quality_rules.fit(x, (x[:, 0] * x[:, 1] > 0.1).astype(float), np.zeros(4, bool))

    def walk(row):
        margin = trees.start
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (1 if row[feature[node]] <= threshold[node] else 2)
            margin += value[node - len(feature)]
        return 1 / (1 + np.exp(-margin))

    probe = np.concatenate([x[:100], r.normal(size=(50, 4)), np.zeros((1, 4))])
    assert trees.score(probe) == pytest.approx([walk(row) for row in probe])


def test_pooled_probabilities_equal_a_recurrence_byte_by_byte():
    network = langid.Network(["a", "b", "c"], seed=3)
    h = langid.HIDDEN

    def states(data, side):
        s, out = np.zeros(h), []
        for byte in data:
            x, u = network.e[side][:, byte], network.u[side] @ s
            z, g = (np.clip(0.25 * (x[k : k + h] + u[k : k + h]) + 0.5, 0, 1) for k in (0, h))
            n = np.clip(x[2 * h :] + g * u[2 * h :], -1, 1)
            s = n + z * (s - n)
            out.append(s)
        return out

    def pooled(text):
        total = np.zeros(3)
        for at in range(0, len(text), langid.WINDOW):
            data = text[at : at + langid.WINDOW]
            for forth, back in zip(states(data, 0), states(data[::-1], 1)[::-1]):
                logits = network.w[0] @ forth + network.w[1] @ back + network.b
                p = np.exp(logits - logits.max())
                total += p / p.sum()
        return total / max(1, len(text))

    texts = ["Ein Satz.".encode(), b"", "é日本".encode() * 40, bytes(range(32, 127)) * 3, b"x"]
    got = network.pooled(texts)
    for row, text in zip(got, texts):
        assert row == pytest.approx(pooled(text), abs=2e-4)


def test_texts_without_a_character_of_category_l_are_und(spark):
    docs = spark.createDataFrame([(1, "²½①Ⅷ 12"), (2, "a"), (3, "日本"), (4, None), (5, "")], "doc_id long, text string")
    network = langid.Network(["a"])
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, network).collect()} == {1: "und", 2: "a", 3: "a", 4: "und", 5: "und"}
    for n in (network, None):
        assert sorted(r.doc_id for r in langid.accepted(docs, n, 0.0).collect()) == [2, 3]
        assert langid.accepted(docs.limit(0), n).count() == 0


def test_samples_are_bounded_however_often_a_row_is_repeated(spark):
    from assetspan.llm.labelled import sample

    docs = spark.createDataFrame([(i % 3, f"text {i}", 1) for i in range(300)] + [(7, "x" * 200, 1)], "doc_id long, text string, n_chars int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] * 2, "doc_id long, quality int")
    got = sample(docs, labels, "quality", F.lit(True), 10, text_bytes=100).collect()
    assert sorted((r.doc_id, r.text, r["_label"]) for r in got) == [(0, "text 0", 0), (1, "text 1", 1), (2, "text 101", 0)]
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    known = spark.createDataFrame([(a, f"{i} some words of a language that go on", "en") for i in range(50)] + [(b, "des mots d'une autre langue qui continue", "fr")], "doc_id long, text string, lang string")
    assert langid.learn(known).languages == ["en", "fr"]


def test_sharding_over_many_buckets(spark, monkeypatch):
    """Large groups, several buckets and several slot buckets, with repeated rows."""
    monkeypatch.setattr(sharding, "CHUNK", 50)
    monkeypatch.setattr(sharding, "LARGE", 9)
    monkeypatch.setattr(sharding, "RANK_ROWS", 300)
    rows = [(i, say(1 + i % 40, i)) for i in range(1200)] + [(5000 + i, say(3000, i % 3)) for i in range(9)] + [(7, say(8, 7))] * 40
    out = sharding.shard(frame(spark, rows), 8).toPandas()
    assert len(out) == len(rows)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (out.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
    sums = out.groupby("shard")["size"].sum()
    group = out.groupby(["text_crc32", "size"])["size"].transform("sum")
    ordinary = sums.drop(out["shard"][group > sums.sum() / 8].unique())  # a group above a fair share makes its shard as large
    assert len(sums) == 8 and len(ordinary) >= 4 and ordinary.max() - ordinary.min() <= 0.02 * ordinary.max() + 200


ARTICLE = "<article><h1>T</h1><p>The first paragraph of the text is long enough to count as its main part.</p>%s<p>And the last one ends the story with a few more words.</p></article>"


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ('<section id="discussion"><h2>Discussion</h2><p>We discuss.</p></section>', "Discussion\n\nWe discuss."),
        ('<p class="alert">Hot oil burns.</p>', "Hot oil burns."),
        ('<div class="tabs"><p>Tab text.</p></div>', "Tab text."),
        ('<figure class="side"><figcaption>A caption.</figcaption></figure>', "A caption."),
        ("<dialog open>Dialog words.</dialog>", "Dialog words."),
        ("<blockquote><p>Quote.</p><footer>Someone</footer></blockquote>", "Quote.\n\nSomeone"),
        ('<p>Her <span class="share">share of votes</span> rose.</p>', "Her share of votes rose."),
        ("<p>The <label>label words</label> stay.</p>", "The label words stay."),
        ('<div class="share"><a href="1">Share</a> <a href="2">Print</a></div>', None),
        ('<div class="ad">Buy lamps now, half price.</div>', None),
        ('<section class="comments"><p>Bob: nice text.</p></section>', None),
        ('<div class="comment-body"><p>Bob: nice text.</p></div>', None),
        ("<form><label>Mail</label><input></form>", None),
        ("<footer>Filed under news.</footer>", None),
    ],
)
def test_of_an_article_only_what_the_contract_names_is_left_out(inside, text):
    page = f'<body><nav><a href="1">Home</a></nav>{ARTICLE % inside}<footer>foot</footer></body>'
    blocks = ["T", "The first paragraph of the text is long enough to count as its main part.", text, "And the last one ends the story with a few more words."]
    assert extract.main_text(page) == "\n\n".join(b for b in blocks if b)


def test_columns_around_a_menu_are_one_region():
    column = "<div><p>%s words that go on for long enough to be a text of their own, and then some.</p></div>"
    menu = "<ul>" + "".join(f'<li><a href="{i}">Link number {i}</a></li>' for i in range(9)) + "</ul>"
    text = extract.main_text(f"<body>{column % 'First'}{menu}{column % 'Second'}</body>")
    assert text.startswith("First words") and "Second words" in text and "Link" not in text
    beside = extract.main_text(f"<body><div><p>{'Some words to read. ' * 9}</p>{menu}<p>{'More of them. ' * 9}</p></div></body>")
    assert "Link number 8" in beside and "More of them." in beside
