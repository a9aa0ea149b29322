import random

import pytest

#: Names that operators use inside.
CLASHING = ("id", "fp", "digest", "text_hash", "sid", "range", "next", "size", "score", "kept", "group", "tie", "spans", "block", "n_tokens", "ids", "_id", "_hash", "range_id", "rank", "component_id")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rnd = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "delta.", "the", "of", "ÉTÉ", "maß", "x1", "###"]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long = " ".join(f"{rnd.choice(words)}{i % 97}" for i in range(60_000))
    shared = "\n".join(line(30) for _ in range(3))
    rows = [
        (1, None, "en", None), (2, "", "en", "a"), (3, " \t\n ", None, "a"), (4, "one", "en", "b"), (5, "one", "en", None), (6, long, "fr", "a"), (7, long, "fr", "b"), (8, long + " end", "fr", "b"),
        (9, "same row", "en", "c"), (9, "same row", "en", "c"), (10, "one id", "en", "a"), (10, "two texts", "en", "a"), (None, "no id", "en", "a"), (None, "no id", "en", "a"), (None, None, None, None),
        (11, shared, "en", "a"), (12, line(5) + "\n" + shared + "\n" + line(5), "en", "a"), (13, shared + "\n" + shared, "en", "b"), (-5, "an identifier below zero", "en", "Z"), (14, "a\0b c <|endoftext|> d", "en", "b"), (15, "tab\tand  two\r\nlines, then some more", "de", "ż"),
    ] + [(100 + i, line(rnd.randrange(1, 80)), "en", rnd.choice("abc")) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r.doc_id, r.text, r.source) for r in odd.collect()]
