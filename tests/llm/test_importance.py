"""Importance resampling: against SQL, against a plain model, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from propflow.llm import importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features_of(text, longest):
    words = words_of(text)
    return [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute(rows, target, percent=10, least=20, seed=2024, longest=1, buckets=10_000):
    """(id, n_features, weight, score, rank) of each row, feature by feature."""
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for text in texts for x in features_of(text, longest)) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    scored = []
    for doc_id, text in rows:
        features = features_of(text, longest)
        weight = sum(gain(bucket(x)) for x in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least))
    fit = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    ranks = [k + 1 if k < percent * len(fit) // 100 else None for k in range(len(fit))]
    return Counter([(*r[:4], k) for r, k in zip(fit, ranks)] + [(*r[:4], None) for r in scored if not r[4]])


def test_sql(spark, sf_dir, duck):
    got = importance.op12_importance(spark, sf_dir)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    assert got.dtypes == [(n, "bigint") for n in names]
    rows = Counter(tuple(r) for r in got.collect())
    assert rows == Counter(duck.execute(f"SELECT {', '.join(names)} FROM ({importance.SQL})").fetchall())
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    assert rows == brute([(r.doc_id, r.text) for r in read("documents")], [r.text for r in read("benchmark")])


@pytest.mark.parametrize("longest", [1, 3])
def test_odd_rows(spark, odd, none, odd_rows, longest, monkeypatch):
    """Nulls, ties, clashing columns, a target that shares nothing, and tries and blocks that are sent again and again."""
    monkeypatch.setattr(importance, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(importance, "MOST_NODES", 20)
    monkeypatch.setattr(importance.words_of, "__defaults__", (3000,))
    target = odd.where("doc_id > 120").select("text")
    want = brute([(i, t) for i, t, _ in odd_rows], [t for i, t, _ in odd_rows if (i or 0) > 120], percent=40, least=3, longest=longest)
    got = importance.resampled(odd, target, percent=40, least_words=3, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert importance.resampled(none, target).count() == 0
    assert Counter(tuple(r) for r in importance.resampled(odd, none, longest=longest).collect()) == brute([(i, t) for i, t, _ in odd_rows], [], longest=longest)


def test_hot_rows(spark):
    """A third of all rows have one identifier and text: each is ranked, and the ranks leave no hole."""
    rows = [(7, "one hot text " * 9) if i % 3 == 0 else (i, f"text {i % 13} of some words " * (i % 7)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("hot text",)], "text string")
    got = [tuple(r) for r in importance.resampled(docs, target, percent=50).collect()]
    assert Counter(got) == brute(rows, ["hot text"], percent=50)
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=6) | st.sampled_from([b"a", b"ab", b"abc", b"abd", b"b"]), max_size=30), st.integers(1, 50))
def test_trie(features, buckets):
    """Counts, checksums and gains of a trie against a dictionary."""
    trie, held = importance.WordTrie(), Counter(features)
    for feature, n in held.items():
        trie.add(feature, n)
    want = np.zeros(buckets, np.int64)
    for feature, n in held.items():
        want[zlib.crc32(feature) % buckets] += n
    assert trie.totals(buckets).tolist() == want.tolist()
    gains = list(range(100, 100 + buckets))
    assert [trie.gain(x, gains) for x in features] == [100 + zlib.crc32(x) % buckets for x in features]
    assert len(trie) <= 1 + 2 * len(held)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aB9é .-\0\x7f漢"), max_size=40), st.integers(1, 12))
def test_words(text, most):
    """Parts are cut between words, however small they are."""
    assert [w for part in importance.words_of(text.encode(), most) for w in part] == [w.encode() for w in words_of(text)]
