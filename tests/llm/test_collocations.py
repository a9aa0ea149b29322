"""Collocations: against SQL, against a plain count, and on odd rows and hot phrases."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from propflow.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, least, longest=4, covered=80, top=2000):
    """The contract's words, phrase by phrase."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in lines_of(text):
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    of = f.setdefault(lang, Counter())
                    of[tuple(words[k : k + size])] += 1
    out = []
    for lang, of in f.items():
        able = {p: a for p, a in of.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in able.items():
            cuts = [(int(Fraction(2_000_000 * a, of[p[:k]] + of[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in able.items())
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(docs, **more):
    return sorted(tuple(r) for r in collocations.collocations(docs, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_sql(spark, sf_dir, duck):
    """The production query; and with a lower threshold and ranks cut off, the plain count."""
    got = collocations.op11_collocations(spark, sf_dir)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got.columns == names and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(tuple(r) for r in got.collect()) == sorted(duck.execute(f"SELECT {', '.join(names)} FROM ({collocations.SQL})").fetchall())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    want = brute(rows, 9, top=40)
    assert len(want) > 60 and mined(docs, least=9, top=40) == want


def test_odd_rows(odd, none):
    rows = [(r.text, r.lang) for r in odd.collect()]
    want = brute(rows, 4)
    assert want and mined(odd, least=4) == want
    assert mined(none) == []


@pytest.mark.parametrize("most", [1, 7, 50])
def test_shards_and_ranges_do_not_matter(spark, monkeypatch, most):
    """Small shards, parts and ranges; a third of all rows repeat one passage, overlapping itself."""
    rnd = random.Random(11)
    words = ["a", "b", "Cé", "d\0e", "漢", "f\x1cg"]
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(["", "", "", ",", "\n", ".\t"]) for _ in range(rnd.randrange(30))), rnd.choice(["x", "y", None])) for i in range(40)]
    rows += [(100 + i, "hot hot hot hot, hot words\vstand here. stand HERE", "x") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(collocations, "PART_BYTES", most)
    monkeypatch.setattr(collocations, "RANGE_ONES", most)
    monkeypatch.setattr(collocations._pieces, "__defaults__", (most,))
    monkeypatch.setattr(collocations.extended, "__defaults__", (None, most))
    monkeypatch.setattr(collocations.shards, "__defaults__", ("text", "lang", most))
    assert mined(docs, least=3) == brute([(t, lang) for _, t, lang in rows], 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 20), st.integers(2, 5))
def test_bitmaps(line, most, longest):
    """Extension of bitmaps against counting, with and without a set of pairs."""
    line = np.array(line, np.int32)

    def runs(size, allowed):
        return Counter(tuple(w.tolist()) for k in range(len(line) - size + 1) if (w := line[k : k + size]).all() and all((a, b) in allowed for a, b in zip(w.tolist(), w.tolist()[1:])))

    every = {(a, b) for a in range(5) for b in range(5)}
    got = Counter({tuple(p): n for phrases, counts in collocations.extended(line, longest, None, most) for p, n in zip(phrases.tolist(), counts.tolist())})
    assert got == sum((runs(s, every) for s in range(2, longest + 1)), Counter())
    some = {(a, b) for a, b in every if a and b and (a + b) % 3}
    pairs = np.array(sorted(a << 32 | b for a, b in some), np.int64)
    got = Counter({tuple(p): n for phrases, counts in collocations.extended(line, longest, pairs, most) for p, n in zip(phrases.tolist(), counts.tolist())})
    assert got == sum((runs(s, some) for s in range(3, longest + 1)), Counter())


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab é.,\n\t\v"), max_size=40), st.integers(1, 9))
def test_pieces(text, most):
    words = [w for part in collocations._pieces(text.encode(), most) for w in part]
    want = [w.encode() for line in lines_of(text) for w in [*line, "."]]

    def joined(x):  # gaps side by side are one
        return [w for k, w in enumerate(x) if w != b"." or k and x[k - 1] != b"."]

    assert joined([b".", *words]) == joined([b".", *want])
