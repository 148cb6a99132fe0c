"""The filter audit, the segment-tree encoder and the alignment of tokenizers against brute force and the tokenizers' own libraries."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer, pre_tokenizers
from pyspark.sql import functions as F

from assetspan.llm import alignment, filter_audit, merge_tree, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, links string"
rng = random.Random(3)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, "own", "own") for i, t, lang in rows], SCHEMA)


PIECES = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "'s", "'ll", ".", "!!", "<|endoftext|>", "<|endo", " ", "\x1c", "\x85", "　", "Ġ", "😀", "\U0001e6c0", "\r\n", "x" * 70, "\0", "▁", " the end,", "<0x41>", "<s>"]


def odd_texts(n=150):
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 50))) for _ in range(n)]
    return texts + ["", None, " ", "  ", "\n", "a ", " a", "ab " * 900, "q" * 3000, "日本語" * 700, "<|endoftext|>", "x <|endoftext|> y", "A plain sentence, and a second one.", "A plain sentence, and a second one."]


# --- filter audit


def brute_audit(rows, labels):
    fails, lost = [], []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        own = [x for x in labels if i is not None and x[0] == i]
        fails.append((lang or "", f, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        removed_by = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if x[1][c]]
                left = [x for x in left if not x[1][c]]
                failing = [x for x in own if x[1][c]]
                removed_by[c] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(x[1].values()) == 1 for x in failing), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def test_audit_equals_brute_force(spark):
    words = ["ab", "Cd", "ef x", "GH", "é"]
    say = lambda n, k: " ".join(rng.choice(words[:k]) + str(rng.randrange(400) if k > 3 else "") for _ in range(n))
    rows = [(i, say(rng.choice([3, 199, 200, 201, 400]), rng.choice([1, 2, 5])) + rng.choice(["", "", " #", "\n|"]), rng.choice(["en", "de"])) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1], rng.choice(["en", None, ""])) for i in range(20)]
    rows += [(3, rows[3][1], "en"), (3, "other", "en"), (None, rows[2][1], "de"), (None, None, "de"), (200, None, "en"), (201, "", "en"), (202, " \n\t", "en"), (203, "X " * 30000, "fr"), (-1, rows[5][1], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in list(range(0, 60, 2)) + [3, 4, 4, 103, 203]] + [(None, 1, 1)]
    made = filter_audit.audit(frame(spark, rows), spark.createDataFrame([(*x, "own") for x in labels], "doc_id long, quality int, toxic int, part string"))
    assert made.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in made.collect()} == brute_audit(rows, labels)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, []), empty).count() == 0
    assert filter_audit.audit(frame(spark, rows), empty).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_own_filters(spark):
    rows = [(1, "x", None), (2, "xy", None), (3, "y", None), (4, "z", None)]
    own = lambda text: {"P": text.contains("x"), "Q": text.contains("y")}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(frame(spark, rows), labels, own, copies=None).collect()}
    assert out == {("PQ", 1): (2, 2, 0, 1, 3), ("PQ", 2): (1, 1, 1, 1, 3), ("QP", 1): (2, 2, 0, 1, 3), ("QP", 2): (1, 1, 1, 1, 3)}


# --- segment tree


def test_tree_encodes_and_decodes_as_the_library_does(spark):
    lib = Tokenizer.from_file(queries.BYTE_LEVEL)
    texts = odd_texts()
    rows = [(i if i % 9 else None, t, "en") for i, t in enumerate(texts)]
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids))
        assert back == (t or "")
    out = merge_tree.encode(frame(spark, rows), queries.BYTE_LEVEL)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, merge_tree.decode(out, queries.BYTE_LEVEL).collect()), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert merge_tree.encode(frame(spark, []), queries.BYTE_LEVEL, ids=False).count() == 0
    broken = [[50256, 220, 447], [187, 1], [], [98, 98, 98]]
    assert [merge_tree.encoder(queries.BYTE_LEVEL).decode(np.array(x, "<u4").tobytes()) for x in broken] == [lib.decode(x, skip_special_tokens=False) for x in broken]


def test_pieces_are_cut_where_the_library_cuts_them():
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False)
    split = merge_tree.encoder(queries.BYTE_LEVEL).split
    letters = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    text = " ".join(f"a{c}1 {c}{c}." for c in letters[::7] + merge_tree.LATER)
    assert [len(p) for p in split(text)] == [b - a for _, (a, b) in cut.pre_tokenize_str(text)]


def test_forest_and_trees_merge_the_leftmost_least_pair_as_a_plain_scan_does():
    with open(queries.BYTE_LEVEL, encoding="utf-8") as f:
        model = json.load(f)["model"]
    enc, rank, letters = merge_tree.encoder(queries.BYTE_LEVEL), {tuple(m): r for r, m in enumerate(model["merges"])}, merge_tree.byte_letters()

    def plain(piece):
        parts = [letters[b] for b in piece]
        while len(parts) > 1 and (best := min((rank.get(p, 1 << 30), i) for i, p in enumerate(itertools.pairwise(parts))))[0] < 1 << 30:
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        return [model["vocab"][p] for p in parts]

    pieces = ["".join(rng.choice("aeinorst") for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 31, 64, 100]))).encode() for _ in range(900)] + ["é".encode() * 40, bytes(range(256))]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.merge(pieces)] == [plain(p) for p in pieces]
    assert [np.frombuffer(enc.merge([p])[0], "<u4").tolist() for p in pieces[-60:]] == [plain(p) for p in pieces[-60:]]


# --- alignment


def streams_of(texts):
    a, b = Tokenizer.from_file(queries.BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    a.encode_special_tokens = True
    of_letter = {c: i for i, c in enumerate(merge_tree.byte_letters())}
    names = {i: t for t, i in a.get_vocab().items()}
    for t in texts:
        if not t:
            yield [], []
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bytes_a = [bytes(of_letter[c] for c in names[i]) for i in ids_a]
        said = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, said)]
        same = b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode()
        yield ([*zip(ids_a, bytes_a)], [*zip(ids_b, bytes_b)]) if same else ([], [])


def brute_alignment(texts):
    docs = []
    for a, b in streams_of(texts):
        ends_a, ends_b = ([*itertools.accumulate(len(x) for _, x in s)] for s in (a, b))
        links = [(i, j) for (i, _), p in zip(a, ends_a) for (j, _), q in zip(b, ends_b) if p == q] if len(a) < 4000 else [(a[ends_a.index(q)][0], j) for (j, _), q in zip(b, ends_b) if q in set(ends_a)]
        groups, start = [], 0
        for stop in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(i) for (i, _), e in zip(s, ends) if start < e <= stop) for s, ends in ((a, ends_a), (b, ends_b))))
            start = stop
        docs.append((len(a), len(b), groups, links))
    count = Counter(x for *_, links in docs for x in links)
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [(len(g), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), n_a, n_b, hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", ";".join(g)) for n_a, n_b, g, links in docs]


@pytest.mark.parametrize("segment, fan", [(alignment.SEGMENT, alignment.FAN), (40, 2)])
def test_alignment_equals_brute_force(spark, segment, fan):
    texts = odd_texts(60)
    rows = [(i if i % 11 else None, t, "en") for i, t in enumerate(texts)] + [(1, texts[1], "en"), (1, texts[1], "en"), (1, "ab " * 900, "en")]
    want = sorted(((i, *x) for (i, _, _), x in zip(rows, brute_alignment([t for _, t, _ in rows]))), key=str)
    aligned = alignment.align(frame(spark, rows), queries.BYTE_LEVEL, queries.PIECES, True, segment, fan)
    out = alignment.best_links(aligned, queries.BYTE_LEVEL, queries.PIECES)
    got = out.select("doc_id", "n_groups", "n_links", "n_best", "count_sum", "n_a", "n_b", "groups_sha256", "groups")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert alignment.alignment(frame(spark, []), queries.BYTE_LEVEL, queries.PIECES).count() == 0


def test_fragments_compose_in_any_bracketing():
    t = alignment.tokenizers(queries.BYTE_LEVEL, queries.PIECES)
    text = " ".join("".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(1, 30))) for _ in range(200))
    (a, b), = t.streams([text])
    one = alignment.fragment(t, a, b, 1 << 30)
    for size in (1, 3, 17, 100):
        many = alignment.fragment(t, a, b, size)
        assert alignment.whole(many) == alignment.whole(one) and many.links.tolist() == one.links.tolist()
    a_ends, b_ends = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    places = [0, *sorted(rng.sample(range(1, int(a_ends[-1])), 3)), int(a_ends[-1])]
    i, j = (np.searchsorted(e, places, side="right") for e in (a_ends, b_ends))
    p = [alignment.leaf(t, a[i[k] : i[k + 1]], a_ends[i[k] : i[k + 1]], b[j[k] : j[k + 1]], b_ends[j[k] : j[k + 1]]) for k in range(4)]
    c, none = alignment.compose, alignment.Fragment()
    for f in (c(c(c(p[0], p[1]), p[2]), p[3]), c(p[0], c(p[1], c(p[2], p[3]))), c(c(p[0], c(p[1], p[2])), p[3]), c(none, c(c(p[0], p[1]), c(p[2], c(p[3], none))))):
        assert alignment.whole(f) == alignment.whole(one)


def test_pairs_that_link_end_alike(spark):
    t = alignment.tokenizers(queries.BYTE_LEVEL, queries.PIECES)
    rows = [(i, x, "en") for i, x in enumerate(odd_texts(40))]
    for r in alignment.pair_counts(alignment.align(frame(spark, rows), queries.BYTE_LEVEL, queries.PIECES)).collect():
        x, y = t.a.bytes_of[r.link // len(t.b_size)], t.b_bytes[r.link % len(t.b_size)]
        assert x.endswith(y) or y.endswith(x)
