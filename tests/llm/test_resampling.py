"""Resampling: span values against zlib, weights and ranks against a plain loop, hard rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from poolspark.llm import resampling
from poolspark.llm.crc import DEPTH, span_crcs


@given(st.lists(st.binary(max_size=5 * DEPTH + 3), max_size=20))
@settings(max_examples=60, deadline=None)
def test_span_values_equal_zlib(spans):
    data = np.frombuffer(b"".join(spans), np.uint8)
    end = np.cumsum([len(s) for s in spans]).astype(np.int64)
    start = end - np.array([len(s) for s in spans], np.int64)
    assert span_crcs(data, start, end).tolist() == [zlib.crc32(s) for s in spans]


@pytest.mark.parametrize("n", [0, 1, DEPTH - 1, DEPTH, DEPTH + 1, 2 * DEPTH, 10 * DEPTH + 7, 100_000])
def test_lengths_around_the_table(n):
    data = np.frombuffer(np.random.default_rng(n).bytes(n + 3), np.uint8)
    assert span_crcs(data, np.array([1]), np.array([n + 1])).tolist() == [zlib.crc32(data[1:n + 1].tobytes())]


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_features(text, longest):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, longest, buckets, percent, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, table in ((s, [x for _, x in docs]), (t, target)):
        for text in table:
            for f in plain_features(text, longest):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out, able = [], []
    for i, text in docs:
        f = plain_features(text, longest)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(words(text)) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for rank, row in enumerate(able[:percent * len(able) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest,percent", [(1, 10), (1, 100), (3, 35)])
def test_equals_plain_loop(spark, prose, hard_rows, longest, percent):
    docs = [(r[0], r[1]) for r in hard_rows] + [(100 + i, prose(15 + i % 40, i, " -") + " Ünï É" * (i % 3)) for i in range(150)]
    target = [prose(30, 7), prose(50, 12), None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame, bench, longest=longest, buckets=500, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, longest, 500, percent)


def test_features_of_runs_do_not_cross_texts():
    n_words, buckets, owner = resampling.features(pa.array(["a b", None, "B, c"]), 2, 1 << 31)
    assert n_words.tolist() == [2, 0, 2]
    want = {0: ["a", "b", "a b"], 2: ["b", "c", "b c"]}
    for i, fs in want.items():
        assert sorted(buckets[owner == i].tolist()) == sorted(zlib.crc32(f.encode()) % (1 << 31) for f in fs)


def test_empty_tables(spark, empty, hard):
    bench = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, bench).count() == 0
    got = resampling.resample(hard, bench).collect()
    assert len(got) == hard.count() and all(r["score"] is not None for r in got)
    assert resampling.resample(hard, bench).columns == ["doc_id", "n_features", "weight", "score", "rank"]
