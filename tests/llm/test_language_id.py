"""Language identification: against sets of n-grams without filters, by held-out accuracy, and on odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from propflow.llm import language_id


def plain_grams(text):
    """The n-grams of a text, character by character."""
    line, word = ["_"], False
    for c in text.lower():
        if c.isalpha():
            line.append(c)
        elif word:
            line.append("_")
        word = c.isalpha()
    if word:
        line.append("_")
    return ["".join(line[k : k + 3]) for k in range(len(line) - 2)] if len(line) > 1 else []


def as_text(gram):
    return "".join(chr(p) if p else "_" for p in (int(gram) >> 42, int(gram) >> 21 & 0x1FFFFF, int(gram) & 0x1FFFFF))


@pytest.mark.parametrize("most", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("text", ["", "a", "ab c", "  Ab,, c\n", "1234 ...", "été ß 漢字 x1y", "a.b.c", "...word", "word...", "x" * 40])
def test_grams(text, most):
    got = [as_text(g) for block in language_id.grams(text, language_id.letters(), most) for g in block]
    assert got == plain_grams(text)


def brute(rows, learned_from, share=language_id.SHARE, ratio=language_id.RATIO):
    """Decisions by exact sets of n-grams: {text: (popcounts by language, n)}."""
    counts = {}
    for text, lang in learned_from:
        counts.setdefault(lang, Counter()).update(plain_grams(text))
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    highest = Counter()
    for lang, c in counts.items():
        for gram, n in c.items():
            highest[gram] = max(highest[gram], n / totals[lang])
    sets = {lang: {g for g, n in c.items() if n / totals[lang] >= share and n / totals[lang] >= ratio * highest[g]} for lang, c in counts.items()}
    return {t: ({lang: sum(g in known for g in plain_grams(t)) for lang, known in sets.items()}, len(plain_grams(t))) for t in rows}


def test_against_sets(spark, sf_dir):
    """Filters give every n-gram that the sets hold, and hardly any other; the decisions are those of the sets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    want = brute([r.text for r in rows], [(r.text, r.lang) for r in rows if not fold[r.doc_id] and r.lang is not None and r.text is not None])
    model = language_id.learn(docs.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.op13_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows) and set(got[rows[0].doc_id].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    for r in rows:
        mine, (counts, n) = got[r.doc_id], want[r.text]
        assert mine.held_out == fold[r.doc_id] and 0 <= mine.score <= 1
        if n:
            popcounts = sum(model.popcounts(b) for b in language_id.grams(r.text, language_id.letters()))
            for name, bits in zip(model.names, popcounts):
                assert counts[name] <= bits <= counts[name] + 0.01 * n
            best = max(counts.values())
            assert counts[mine.lang_pred] >= best - 0.01 * n
            assert abs(mine.score - counts[mine.lang_pred] / n) < 0.01


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = language_id.op13_language_id(spark, sf_dir).where("held_out").join(docs, "doc_id").where("lang IS NOT NULL")
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.98


def test_odd_rows(spark, odd, none, odd_rows):
    got = language_id.identified(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((i is None, i) for i, _, _ in odd_rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id in (1, 2, 3):  # null, empty and blank
        assert by_id[doc_id].lang_pred == "und" and by_id[doc_id].score == 0
    assert {r.lang_pred for r in got} <= {"en", "fr", "de", "und"}
    assert language_id.identified(none).count() == 0
    # nothing to learn from: no language is known
    model = language_id.learn(none)
    assert {(r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()} == {("und", 0.0)}


def test_very_many_languages(spark):
    """More languages than a mask has bits, one of which holds a third of all rows."""
    rng = np.random.default_rng(4)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    words = {f"l{k:03d}": ["".join(rng.choice(alphabet, 4)) for _ in range(12)] for k in range(130)}
    rows = [(i, lang, " ".join(rng.choice(words[lang], 15))) for i, lang in enumerate([*words] * 4 + ["l007"] * 260)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    model = language_id.learn(docs, bits=14)
    assert model.masks.shape == (3, 1 << 14) and (model.chance > 0).all()
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert sum(got[i] == lang for i, lang, _ in rows) >= 0.99 * len(rows)


def test_filters_do_not_grow(spark):
    """A language keeps no more n-grams than its least share allows, however many it has."""
    rng = np.random.default_rng(5)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(20_000))
    docs = spark.createDataFrame([(1, "xx", text)], "doc_id long, lang string, text string")
    model = language_id.learn(docs, share=1e-4)
    assert 0 < sum(bin(int(m)).count("1") for m in model.masks.ravel()) <= 3 / 1e-4
