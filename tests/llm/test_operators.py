"""Every operator against brute force or an exact round trip, over hard rows and empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolspark.llm import decontaminate, huffman, kneser_ney, langid, linear, near_dups, ordinal, pieces, spotsigs, store, substrings, toxicity
from poolspark.llm import words as W

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# The kernel.

def test_words_of_a_batch_are_those_of_the_pattern(hard_rows):
    texts = [r[1] for r in hard_rows]
    data, offsets = W.texts(pa.array(texts))
    start, end, doc = W.spans(data, offsets)
    got = [[] for _ in texts]
    for a, b, d in zip(start, end, doc):
        got[d].append(data[a:b].tobytes().decode())
    assert got == [WORD.findall(t or "") for t in texts]
    assert W.join_words(data, start, end, doc, len(texts)).to_pylist() == [" ".join(w) for w in got]


def test_hash_of_a_word_does_not_depend_on_its_place_or_length_class():
    word = "x" * (W._BLOCK + 5000)
    data, offsets = W.texts(pa.array(["ab cd ab", word, "cd " + word]))
    start, end, _ = W.spans(data, offsets)
    h = W.span_hashes(data, start, end)
    assert h[0] == h[2] and h[1] == h[4] and h[3] == h[5] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("size", [1, 2, 5, 24])
def test_slide_is_the_minimum_of_each_run(size):
    x = np.random.default_rng(size).integers(0, 99, 60).astype(np.uint64)
    assert W.slide(x, size).tolist() == [min(x[i:i + size]) for i in range(len(x) - size + 1)]


# Operator 5.

def brute_repeats(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    runs = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if runs[tuple(w[i:i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substrings_equal_brute_force(hard, hard_rows):
    out = substrings.dedup_substrings(hard).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out)
    assert got == Counter((r[0], *b) for r, b in zip(hard_rows, brute_repeats([r[1] for r in hard_rows], 35)))
    for r in out:
        assert all(f.length >= 35 for f in r.factors)


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_words(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    out = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == [
        (i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows], 7))]


# Operator 1.

def test_probabilities_of_a_context_add_up_to_one(spark, prose):
    docs = spark.createDataFrame([(i, prose(50, i % 7)) for i in range(20)], "doc_id long, text string")
    model = kneser_ney.fit(docs)
    data, offsets = W.texts(pa.array([" ".join(sorted(set(prose(50, k).split()))) for k in range(7)]))
    start, end, _ = W.spans(data, offsets)
    known = np.unique(np.append(W.span_hashes(data, start, end), kneser_ney.END))
    assert len(known) == model.kinds
    unknown = W.mix(np.array([987654321], np.uint64))
    for context in [known[0], known[5], unknown[0]]:
        token = np.column_stack([np.full(len(known) + 1, context), np.append(known, unknown)]).ravel()
        doc = np.repeat(np.arange(len(known) + 1), 2)
        p = 10 ** model.score(token, doc)[2][1::2]
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-9)


def test_base_score_and_counts(hard, hard_rows):
    model = kneser_ney.fit(hard)
    out = kneser_ney.score(hard, model).collect()
    train = Counter(t for r in hard_rows for t in [*WORD.findall(ascii_lower(r[1] or "")), None])
    n, v = sum(train.values()), len(train)
    assert (model.tokens, model.kinds) == (n, v)
    want = Counter()
    for r in hard_rows:
        toks = [*WORD.findall(ascii_lower(r[1] or "")), None]
        want[r[0], len(toks), round(sum(math.log10((train[t] + .5) / (n + .5 * (v + 1))) for t in toks), 2)] += 1
    assert Counter((r.doc_id, r.n_tokens, round(r.base_score, 2)) for r in out) == want


def test_model_of_nothing(hard, empty):
    model = kneser_ney.fit(empty)
    assert model.tokens == model.kinds == 0
    assert {(r.score, r.n_known) for r in kneser_ney.score(hard, model).collect()} == {(0.0, 0)}
    assert kneser_ney.score(empty, model).count() == 0


# Operator 6.

def test_code_lengths_are_those_of_the_best_limited_code():
    rng = np.random.default_rng(1)
    counts = np.concatenate([np.zeros(3), 2.0 ** np.arange(30)]).astype(np.int64)
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() == 8 and (lengths[:3] == 0).all() and (0.5 ** lengths[3:].astype(float)).sum() == 1.0
    ids = rng.choice(33, 5000, p=counts / counts.sum())
    full = huffman.code_lengths(counts)
    size = np.array([1, 4000, 999])
    data, edge, marks, blocks = huffman.pack_bits(ids, size, full, huffman.canonical(full))
    bit = marks + 8 * np.repeat(edge[:-1], blocks)
    n = np.concatenate([np.append(np.full(b - 1, huffman.BLOCK), s - huffman.BLOCK * (b - 1)) for s, b in zip(size, blocks)])
    assert (huffman.unpack_bits(data, bit, n, huffman.decode_table(full)) == ids).all()
    last = int(np.flatnonzero(n)[-1])  # a block without its neighbours
    assert (huffman.unpack_bits(data, bit[last:], n[last:], huffman.decode_table(full)) == ids[-int(n[-1]):]).all()


def test_files_hold_the_ids_of_the_tokenizer(spark, hard, hard_rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    rows = [*hard_rows[:11], (100, "a <|endoftext|>b  c\xa0 d    e  ", None, None, None, None, None)]
    folder = store.shared_folder(spark, "t")
    huffman.write(spark.createDataFrame(rows, hard.schema), folder, path)
    out = huffman.read(spark, folder).orderBy("doc_id").collect()
    at = 0
    for r, got in zip(rows, out, strict=True):
        ids = own.encode(r[1] or "", add_special_tokens=False).ids + [0]
        assert (got.doc_id, got.start, got.n_tokens, bytes(got.ids)) == (r[0], at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    folder = store.shared_folder(spark, "t")
    huffman.write(empty, folder, path)
    assert huffman.read(spark, folder).count() == 0


# Operator 7.

def test_pieces_are_those_of_the_library(hard, hard_rows, empty):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = SentencePieceProcessor(model_file=path)
    out = pieces.decode(pieces.encode(hard, path), path).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out) == Counter(
        (r[0], tuple(own.encode(r[1] or "")), own.decode(own.encode(r[1] or ""))) for r in hard_rows)
    both = pieces.round_trip(hard.withColumn("decoded", F.lit("x")), path).select("doc_id", "ids", "decoded").collect()
    assert sorted((r["doc_id"] or -1, r["ids"], r["decoded"]) for r in both) == sorted((r["doc_id"] or -1, r["ids"], r["decoded"]) for r in out)
    assert pieces.round_trip(empty, path).count() == 0
    assert pieces.decode(pieces.encode(empty, path), path).count() == 0


# Operators 4 and 8.

def test_toxic_words_are_learnt(spark, prose):
    rows = [(i, prose(60, i) + (" vileword badword " + prose(20, -i) if i % 5 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in out if r.doc_id >= 400]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)


def test_scores_of_hard_rows(hard, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(hard, labels)
    assert {r.score for r in toxicity.score(hard, model).collect()} == {0.5} and toxicity.score(empty, model).count() == 0
    grades = ordinal.fit(hard, labels, F.col("toxic"), 3)
    out = ordinal.score(hard, grades).collect()
    assert all(math.isclose(r.expected_grade, 1.0) and math.isclose(r.tail_probability, 2 / 3) for r in out) and ordinal.score(empty, grades).count() == 0


def test_grades_are_ordered(spark, prose):
    mark = ["junkone", "middling", "finest"]
    rows = [(i, prose(50, i) + f" {mark[i % 3]} {mark[i % 3]}{i % 4} ") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(450)], "doc_id long, g int")
    out = ordinal.score(docs, ordinal.fit(docs, labels, F.col("g"), 3)).where("doc_id >= 450").collect()
    mean = [np.mean([r.expected_grade for r in out if r.doc_id % 3 == k]) for k in range(3)]
    assert mean[0] + 0.4 < mean[1] < mean[2] - 0.4


def plain_ftrl(weights, state, at, slope, alpha=1.0, beta=1.0):
    """One step of FTRL-proximal, a coordinate at a time; ``state``: z and n by coordinate."""
    for i in at:
        z, n = state.get(i, (0.0, 0.0))
        rise = (math.sqrt(n + slope * slope) - math.sqrt(n)) / alpha
        state[i] = z + slope - rise * weights.get(i, 0.0), n + slope * slope
        z, n = state[i]
        weights[i] = 0.0 if abs(z) <= 6.0 else -(z - math.copysign(6.0, z)) / ((beta + math.sqrt(n)) / alpha)


def graded(spark, prose, grades):
    rng = random.Random(grades)
    rows = []
    for i in range(260):
        y = rng.randrange(grades)
        rows.append((i, prose(20, i) + f" sign{y}x sign{rng.choice([y, y, 0])}y", y))
    rows += [(900, None, 0), (901, "", 1), (902, prose(9, 1), None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1)], "doc_id long, grade int")
    order = [r.doc_id for r in labels.where("doc_id is not null and grade is not null").orderBy(F.xxhash64("doc_id")).collect()]
    known = {r[0]: r for r in rows if r[1] is not None}
    return docs, labels, [known[i] for i in order if i in known]


def of_each(features, texts):
    feature, doc = features(pa.array(texts))
    return [feature[doc == i].tolist() for i in range(len(texts))]


def test_toxicity_equals_plain_ftrl(spark, prose, hard, hard_rows):
    docs, labels, rows = graded(spark, prose, 2)
    model = toxicity.fit(docs, labels, label="grade")
    own = of_each(lambda c: linear.distinct(*linear.text_features(c)), [t for _, t, _ in rows])
    weights, state = {}, {}
    for _ in range(4):
        for (_, _, y), at in zip(rows, own):
            at = [*at, "bias"]
            slope = 1 / (1 + math.exp(-sum(weights.get(i, 0.0) for i in at))) - y
            plain_ftrl(weights, state, at, slope)
    used = {i: w for i, w in weights.items() if w and i != "bias"}
    assert len(used) > 2 and model.bias == pytest.approx(weights["bias"], abs=1e-9)
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(used, rel=1e-5)
    # Hard rows under a model that has learnt: every text has the sum of its own weights, whatever stands around it.
    got = toxicity.score(hard, model).collect()
    texts = [r[1] or "" for r in hard_rows]
    want = [1 / (1 + math.exp(-model.bias - sum(used.get(i, 0.0) for i in at)))
            for at in of_each(lambda c: linear.distinct(*linear.text_features(c)), texts)]
    assert sorted((r.text or "", r.predicted) for r in got) == sorted((t, int(w >= 0.7)) for t, w in zip(texts, want))
    assert sorted(r.score for r in got) == pytest.approx(sorted(want), rel=1e-5)


def test_grades_equal_a_plain_cumulative_link(spark, prose, hard, hard_rows):
    docs, labels, rows = graded(spark, prose, 3)
    model = ordinal.fit(docs, labels, F.col("grade"), 3)
    own = of_each(ordinal.features, [t for _, t, _ in rows])
    weights, state = {}, {}
    first, gap, spent = math.log(1 / 2), math.log(math.log(2 / 1) - math.log(1 / 2)), [1.0, 1.0]
    link = lambda x: 1 / (1 + math.exp(-x))

    def loss(s, y, a, b):
        """-log P(y) of a score and the two numbers that the thresholds come from."""
        low, high = link(a - s), link(a + math.exp(b) - s)
        return -math.log((low, high - low, 1 - high)[y])

    for _ in range(4):
        for (_, _, y), at in zip(rows, own):
            s, h = sum(weights.get(i, 0.0) for i in at), 1e-5
            # Slopes by central differences: nothing of the operator's own derivation is used.
            by = [(loss(s + h * (k == 0), y, first + h * (k == 1), gap + h * (k == 2))
                   - loss(s - h * (k == 0), y, first - h * (k == 1), gap - h * (k == 2))) / (2 * h) for k in range(3)]
            plain_ftrl(weights, state, at, by[0])
            spent = [spent[0] + by[1] ** 2, spent[1] + by[2] ** 2]
            first, gap = first - 0.1 * by[1] / math.sqrt(spent[0]), gap - 0.1 * by[2] / math.sqrt(spent[1])
    used = {i: w for i, w in weights.items() if w}
    assert len(used) > 2 and model.thresholds.tolist() == pytest.approx([first, first + math.exp(gap)], abs=1e-5)
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(used, abs=1e-4)
    got = ordinal.score(hard, model).collect()
    totals = [sum(used.get(i, 0.0) for i in at) for at in of_each(ordinal.features, [r[1] or "" for r in hard_rows])]
    above = [[1 - link(t - s) for t in model.thresholds] for s in totals]
    assert sorted(r.tail_probability for r in got) == pytest.approx(sorted(a[0] for a in above), abs=1e-4)
    assert sorted(r.expected_grade for r in got) == pytest.approx(sorted(map(sum, above)), abs=1e-4)


def test_grades_of_unseen_texts(spark, prose):
    docs, labels, _ = graded(spark, prose, 3)
    model = ordinal.fit(docs, labels, F.col("grade"), 3)
    unseen = [(i, prose(20, 5000 + i) + f" sign{i % 3}x sign{i % 3}y", i % 3) for i in range(90)]
    out = ordinal.score(spark.createDataFrame(unseen, "doc_id long, text string, grade int"), model).collect()
    right = sum(r.expected_grade < o.expected_grade for r in out for o in out if r.grade < o.grade)
    assert right / (3 * 30 * 30) > 0.95


# Operator 10.

def test_marginals_equal_a_plain_forward_backward():
    rng = np.random.default_rng(0)
    size = np.array([1, 64, 65, 200, 2])
    e, a = rng.normal(size=(size.sum(), 3)) * 2, rng.normal(size=(3, 3))
    got, at = langid.marginals(e, size, a), 0
    for n in size:
        emit, step = np.exp(e[at:at + n]), np.exp(a)
        ahead, behind, state = np.zeros((n, 3)), np.ones((n, 3)), np.ones(3) / 3
        for t in range(n):
            state = (state @ step) * emit[t]
            state /= state.sum()
            ahead[t] = state
        for t in range(n - 2, -1, -1):
            behind[t] = step @ (emit[t + 1] * behind[t + 1])
            behind[t] /= behind[t].sum()
        p = ahead * behind
        assert np.allclose(got[at:at + n], p / p.sum(1, keepdims=True))
        at += n


def test_switches_inside_a_text_are_found(spark, hard, empty):
    rng = random.Random(2)
    word = {"xx": lambda: "xa" + "".join(rng.choice("aeiou") for _ in range(4)), "yy": lambda: "yk" + "".join(rng.choice("krtsz") for _ in range(4))}
    rows = [(i, " ".join(word["xx" if i % 2 else "yy"]() for _ in range(60)), "xx" if i % 2 else "yy") for i in range(80)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = " ".join([word["xx"]() for _ in range(30)] + [word["yy"]() for _ in range(50)])
    out = langid.label(spark.createDataFrame([(1, mixed), (2, "12 34"), (3, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [(r.start, r.length, r.lang) for r in out[0].runs] == [(0, 30, "xx"), (30, 50, "yy")] and out[0].lang_pred == "yy"
    assert [(r.lang_pred, r.score) for r in out[1:]] == [("und", 0.0)] * 2
    assert langid.label(hard, model).count() == hard.count() and langid.label(empty, model).count() == 0
    assert {r.lang_pred for r in langid.label(hard, langid.fit(empty)).collect()} == {"und"}


def test_words_to_learn_from_are_spread_over_the_whole_text():
    assert langid.stretches(5).tolist() == [[0, 4]] and langid.stretches(2000).tolist() == [[0, 1999]]
    for n in (2001, 2500, 10_000, 123_457):
        taken = langid.stretches(n)
        assert taken[0, 0] == 0 and taken[-1, 1] == n - 1 and (taken[:, 1] - taken[:, 0] == 39).all() and len(taken) == 50
        gap = np.diff(taken[:, 0])
        assert gap.min() >= 40 and gap.max() - gap.min() <= 1


def test_rare_languages_are_learnt(spark):
    # 70 languages, one of them with nearly all rows and one that shows itself only behind 3,000 words without a letter.
    rng = random.Random(4)
    word = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 2 + rng.choice("aeiou") + rng.choice("rstk")
    text = lambda i, n=40: " ".join(word(i) for _ in range(n))
    rows = [(i, text(0), "l00") for i in range(800)] + [(1000 + i, text(i % 70), f"l{i % 70:02}") for i in range(140)]
    rows += [(2000, "7 " * 3000 + text(75, 3000), "late")] + [(2001, text(1), "l01")] * 300
    rows += [(3000, text(72, 5 + i % 60), "same") for i in range(900)]  # one id on many texts
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=142)
    assert model.langs == sorted({r[2] for r in rows})
    asked = [(i, text(i), f"l{i:02}") for i in range(70)] + [(75, text(75), "late")]
    got = langid.label(spark.createDataFrame(asked, "doc_id long, text string, expected string"), model)
    assert got.where("lang_pred = expected").count() >= 69


def test_training_slope_equals_finite_differences():
    rng = np.random.default_rng(3)
    size, k = np.array([7, 1, 12]), 3
    emission, transition = rng.normal(size=(size.sum(), k)), rng.normal(size=(k, k))
    lang = rng.integers(0, k, size.sum())
    gold = np.eye(k)[lang]

    def loss(e, t):
        total, at = 0.0, 0
        for n in size:
            before = np.logaddexp.reduce(t, axis=0)  # an unseen word of any language stands first
            state = before + e[at]
            for i in range(at + 1, at + n):
                state = np.logaddexp.reduce(state[:, None] + t, axis=0) + e[i]
            own = (before[lang[at]] + e[np.arange(at, at + n), lang[at:at + n]].sum()
                   + t[lang[at:at + n - 1], lang[at + 1:at + n]].sum())
            total, at = total + np.logaddexp.reduce(state) - own, at + n
        return total

    def slope(f, x):
        out = np.zeros_like(x)
        for i in np.ndindex(x.shape):
            step = np.zeros_like(x)
            step[i] = 1e-5
            out[i] = (f(x + step) - f(x - step)) / 2e-5
        return out

    p, pairs, seen = langid._expected(emission, gold, size, transition)
    assert np.allclose(p - gold, slope(lambda e: loss(e, transition), emission), atol=1e-6)
    assert np.allclose(pairs - seen, slope(lambda t: loss(emission, t), transition), atol=1e-6)


# Operator 9.

def test_classes_equal_brute_force(spark, prose):
    rng = random.Random(8)
    texts = []
    for f in range(6):
        base = prose(300, 50 + f).split()
        texts.append(" ".join(base))
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(1, 9)):
                own[rng.randrange(300)] = f"edit{rng.random()}"
            texts.append(" ".join(own))
    sets = [frozenset(tuple(t.split()[i:i + 5]) for i in range(296)) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    out = near_dups.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.id: r.class_id for r in out} == {i: root(i) for i in range(len(texts))}


def test_links_of_texts_that_repeat_unequally(spark, prose):
    pairs = []
    for k in range(40):
        base, line = prose(200, 1000 + k).split(), prose(50, 2000 + k)
        other = base[:185] + prose(15, 3000 + k).split()
        pairs.append((" ".join(base) + (" " + line) * 50, " ".join(other) + " " + line))
    texts = [t for p in pairs for t in p]

    def plain(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    links = [k for k, (a, b) in enumerate(pairs) if len(plain(a) & plain(b)) >= 0.8 * len(plain(a) | plain(b))]
    assert len(links) == 40
    out = near_dups.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.id: r.class_id for r in out} == {i: i - i % 2 for i in range(len(texts))}


def test_registers_agree_as_often_as_the_sets(prose):
    a, b = prose(400, 1), " ".join(prose(400, 1).split()[:350] + prose(50, 2).split())
    element, doc, _ = near_dups.shingles(pa.array([a, b]))
    element, doc, count = near_dups._distinct(element, doc)
    x, y = near_dups.signatures(element, doc, count, 2, 4000)
    p, q = set(element[doc == 0].tolist()), set(element[doc == 1].tolist())
    assert abs((x == y).mean() - len(p & q) / len(p | q)) < 0.04


@pytest.mark.parametrize("shared", [0, 5, 200, 390, 400])
def test_parities_differ_in_no_more_bits_than_the_sets_in_elements(shared):
    rng = np.random.default_rng(shared)
    pool = np.unique(rng.integers(0, 2**63, 800 - shared, dtype=np.uint64))
    rng.shuffle(pool)
    a, b = np.sort(pool[:400]), np.sort(pool[400 - shared:])
    size, parity = near_dups.parities(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
    p, q = ({int(x) >> 32 for x in s} for s in (a, b))
    bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in parity[0] ^ parity[1])
    assert size.tolist() == [len(p), len(q)] and bits <= len(p ^ q)
    assert parity.shape == (2, near_dups.PARITY) and (shared < 400 or bits == 0)


def test_sets_of_wanted_ids_move_no_text(spark, prose, tmp_path):
    docs = spark.createDataFrame([(i, prose(30, i % 7)) for i in range(-9, 9)] + [(None, prose(9)), (3, prose(9, 8)), (5, None)], "doc_id long, text string")
    wanted = near_dups.wanted_ids(spark.createDataFrame([(-8,), (3,), (3,), (5,), (77,)], "id long"), str(tmp_path))
    sets = near_dups.shingle_sets(docs, wanted, "text", "doc_id")
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    element, doc, whole = near_dups.shingles(pa.array([prose(30, -8 % 7), prose(30, 3), prose(9, 8), prose(30, 5)]))
    told = {int(whole[i].astype(np.int64)): np.unique(element[doc == i] >> np.uint64(32)).astype(np.uint32).tobytes() for i in range(4)}
    assert {k: told.get(k) for k in told} == {r.node: bytes(r.elements) for r in sets.collect() if r.elements}


def test_dedup_of_hard_rows(hard, empty):
    out = near_dups.deduplicate(hard)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert out.where("doc_id is null").count() == 1 and near_dups.classes(empty).count() == 0


def test_decisions_hold_for_an_id_with_its_text(spark, prose):
    a, b, near = prose(60, 1), prose(60, 2), prose(59, 1) + " end"
    rows = [(1, a), (2, a), (2, b), (3, b), (3, near), (3, near), (4, prose(30, 3)), (4, prose(30, 3))]
    docs = spark.createDataFrame([(str(i), t, "x", "y") for i, t in rows] + [("none", a, "", ""), (None, a, "", "")], "doc_id string, text string, gone_id string, __id string")
    got = near_dups.deduplicate(docs).collect()
    assert sorted((r.doc_id or "-", r.text) for r in got) == sorted(
        [("1", a), ("2", b), ("4", prose(30, 3)), ("none", a), ("-", a)])
    assert got[0].asDict().keys() == {"doc_id", "text", "gone_id", "__id"}


def test_short_texts_are_taken_in_parts(prose):
    texts = pa.array([prose(6, i) for i in range(700)])
    element, doc, _ = near_dups.shingles(texts)
    element, doc, count = near_dups._distinct(element, doc)
    whole = near_dups.signatures(element, doc, count, 700)
    for i in (0, 255, 256, 699):
        on = doc == i
        assert (near_dups.signatures(element[on], doc[on] - i, count[on], 1)[0] == whole[i]).all()


# Operator 2.

def edit_distance_infix(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        nxt = [i]
        for j, d in enumerate(text, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (c != d)))
        row = nxt
    return min(row)


@pytest.mark.parametrize("seed", range(30))
def test_distance_equals_dynamic_programming(seed):
    rng = random.Random(seed)
    p, t = ("".join(rng.choice("abc ") for _ in range(n)) for n in (rng.randint(1, 80), rng.randint(0, 120)))
    assert decontaminate.distance_within(p, t)[0] == edit_distance_infix(p, t)


def test_planted_passages(spark, hard, empty, prose):
    rng = random.Random(3)
    items = [(k, prose(35, 100 + k)) for k in range(12)]
    rows = []
    for k, t in items:
        rows.append((k, prose(100, k) + " " + t.upper().replace(" ", " \n") + " " + prose(30, k + 50)))
        own = list(t)
        for _ in range(len(own) // 25):
            own[rng.randrange(len(own))] = "q"
        rows.append((100 + k, prose(20, k) + " " + "".join(own)))
        rows.append((200 + k, prose(150, 300 + k)))
    benchmark = spark.createDataFrame([*items, (90, None), (91, " ")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark).collect()}
    want = {(k, k) for k, _ in items} | {(100 + k, k) for k, _ in items}
    assert got <= want and len(got & want) >= 23 and {(k, k) for k, _ in items} <= got
    assert decontaminate.clean(hard, benchmark).count() == hard.count() and decontaminate.matches(empty, benchmark).count() == 0
    assert decontaminate.matches(docs, benchmark.limit(0)).count() == 0


def test_copies_whose_distinctive_words_are_edited(spark, prose):
    rng = random.Random(8)
    items, rows = [], []
    for k in range(40):
        words = prose(50, 500 + k).split()
        own = rng.sample(range(50), 12)
        for i in own:
            words[i] = f"z{k}x{i}w"
        items.append((k, " ".join(words)))
        for i in own:
            words[i] = words[i][:-1] + "v"
        rows.append((k, prose(30, k) + " " + " ".join(words) + " " + prose(30, 90 + k)))
    benchmark, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.matches(docs, benchmark).collect()}
    assert got == {(k, k): 12 for k in range(40)}


def test_recall_of_copies_edited_to_the_limit(spark, prose):
    rng = random.Random(9)
    items, rows = [(k, prose(45, 700 + k)) for k in range(150)], []
    for k, t in items:
        own = list(t)
        for _ in range(len(t) // 10):
            at = rng.randrange(len(own))
            own[at:at + 1] = rng.choice([["q"], [], ["q", own[at]]])
        rows.append((k, prose(20, k) + " " + "".join(own) + " " + prose(20, 90 + k)))
    benchmark, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark).collect()}
    assert got <= {(k, k) for k, _ in items} and len(got) >= decontaminate.RECALL * len(items)
    # Without sampling every copy within the limit is found.
    everything = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark, recall=1.1).collect()}
    assert everything == {(k, k) for k, _ in items}


def test_only_the_contaminated_rows_of_an_id_go(spark, prose):
    item, other = prose(40, 61), prose(60, 62)
    rows = [(1, item), (1, other), (2, prose(10, 63) + " " + item), (3, other), (None, item), (None, other), (4, None)]
    out = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, other), (3, other), (None, other), (4, None)], key=str)


# Operator 3.

def test_next_rows_and_edited_texts(spark, hard, empty):
    rows = [(5000 - 7 * i if i % 3 else -(2**50) - i, ("the word é " * (i % 5)) + f"of item {i} and so") for i in range(900)]
    out = {r.doc_id: r for r in spotsigs.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    ordered = sorted(rows, reverse=True)
    for i, (k, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(t) // 2
        assert out[k].edited == t[:len(t) - half] + after[:half] and out[k].n_chars == len(t)
    assert spotsigs.compare_edited(hard).count() == hard.count() and spotsigs.compare_edited(empty).count() == 0


def test_likeness_is_the_jaccard_similarity(spark):
    df = spark.createDataFrame([("the cat sat the dog ran of mice men", "the cat sat the dog ran of mice men"),
                                ("the cat sat the dog ran", "the cat sat the bird flew"), ("", ""), ("", "the cat")], "a string, b string")
    a, b = (spotsigs.fingerprint(spotsigs.signatures(F.col(c))) for c in "ab")
    assert [r[0] for r in df.select(spotsigs.likeness(a, b)).collect()] == [1.0, pytest.approx(1 / 3), 1.0, 0.0]
    assert len({r[0] for r in df.limit(1).select(F.explode(F.array(spotsigs.as_text(a), spotsigs.as_text(b)))).collect()}) == 1


def test_likeness_of_long_texts_is_exact(spark):
    words = [f"w{i}" for i in range(1500)]
    rows = [(" ".join(words[:n]), " ".join(words[a:b])) for n, a, b in ((1000, 0, 999), (1000, 3, 1000), (1200, 700, 1400), (500, 400, 1500), (1500, 0, 1500))]
    df = spark.createDataFrame(rows, "a string, b string")
    prints = [spotsigs.fingerprint(F.split(c, " ")) for c in "ab"]
    got = df.select(spotsigs.likeness(*prints), *[spotsigs.as_text(p) for p in prints]).collect()
    for (a, b), (near, own, other) in zip(rows, got):
        p, q = set(a.split()), set(b.split())
        assert near == pytest.approx(len(p & q) / len(p | q), abs=1e-12) and (own == other) == (p == q)


def test_pairs_that_are_alike_equal_brute_force(spark, hard, empty):
    rng, rows = random.Random(12), []
    for k in range(30):
        own = [f"the c{rng.randrange(40)} d{rng.randrange(3)}" for _ in range(rng.randint(5, 60))]
        rows += [(4 * k + i, " ".join(x for x in own if rng.random() > 0.1 * i)) for i in range(4)]
    rows += [(900, rows[4][1]), (901, None), (902, ""), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {}
    for r in docs.where("doc_id is not null").select("doc_id", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect():
        if r.s:
            sets[frozenset(r.s)] = min(r.doc_id, sets.get(frozenset(r.s), r.doc_id))
    for least in (0.3, 0.5, 0.8):
        want = {(min(i, j), max(i, j)): len(p & q) / len(p | q) for p, i in sets.items() for q, j in sets.items() if i != j and len(p & q) >= least * len(p | q) - 1e-9}
        got = spotsigs.alike(docs, least).collect()
        assert len(got) == len(want) > 20 and {(r.a, r.b): r.likeness for r in got} == pytest.approx(want)
    assert spotsigs.alike(empty).count() == 0 and spotsigs.alike(hard).count() >= 0


def test_crc_is_that_of_zlib(spark):
    from poolspark.llm.q_kneser_ney import remainder

    assert [r[0] for r in spark.range(50).select(remainder("id", 5)).collect()] == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]
