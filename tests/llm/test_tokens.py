import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from propflow.llm import byte_bpe, token_counts, token_store, trie_bpe

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", " ", "\n\n", " a", "a ", "a\n b\tc\r\nd", "it's DON'T we'll 'S ''s", "x<|endoftext|>y <|startoftext|>\n", "日本 語\nбв ΣΑΣ İstanbul é ñ", "a\x1cb c\x85d\xa0e\u3000f", "a" * 300, "!?!?.,,,", "12,000.50%",
    "\x00:", "\x00\x00", "\x00!! ok", "日\x00: x", "ab\x00cd", "haha" * 50, "😀👍🏽 ok", "ß ẞ ﬁ ½ ①", "word, word. word; Word! (word)", "ªº ʰ ǅ", "'tis 's're''ll'v x've'd 'S", "a \n\n b\xa0 c \x85\x85 d\xa0", "x\xa0", "'", "'r", "\xa0're", "²³ a1²",
]
texts = st.text(st.sampled_from(list("abcdetheingou éèÉİß'’.,!09 \n\t|<>#")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@pytest.fixture(scope="module")
def coder():
    return trie_bpe.TrieBPE(open(WORD, encoding="utf-8").read())


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.ByteEncoder(open(BYTE, encoding="utf-8").read())


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, max_size=6))
def test_trie_is_the_library(coder, some):
    library = Tokenizer.from_file(WORD)
    for text, raw in zip(HARD + some, coder.encode(HARD + some), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids
        assert coder.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, max_size=6))
def test_chunks_are_the_library(encoder, some):
    for text, raw in zip(HARD + some, encoder.encode(HARD + some), strict=True):
        assert raw.tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_bpe_of_a_small_vocabulary():
    """Merges that overlap, against merging pair by pair."""
    import json

    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "ab"), ("aa", "a"), ("ab", "a")]
    letters = ["a", "b"]
    vocab = {t: i for i, t in enumerate(letters + list(dict.fromkeys(x + y for x, y in merges)))}
    file = json.loads(open(WORD, encoding="utf-8").read()) | {"added_tokens": [], "normalizer": None}
    file["model"] |= {"vocab": vocab, "merges": merges, "end_of_word_suffix": None}
    coder = trie_bpe.TrieBPE(json.dumps(file))
    rank = {m: i for i, m in reversed(list(enumerate(merges)))}

    def plain(word):
        parts = list(word)
        while True:
            best = min((rank.get(p, 99), i) for i, p in enumerate([*zip(parts, parts[1:]), ("", "")]))
            if best[0] == 99:
                return [vocab[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = {"".join(w) for n in range(1, 9) for w in __import__("itertools").product("ab", repeat=n)}
    got = coder.encode_words(words)
    assert {w: np.frombuffer(x, "<u4").tolist() for w, x in got.items()} == {w: plain(w) for w in words}


def test_operators_over_odd_rows(odd, none, odd_rows):
    library = Tokenizer.from_file(WORD)
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for t in {t for _, t, _ in odd_rows}}
    want = Counter((i, len(ids[t]), hashlib.sha256(np.array(ids[t], "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids[t], skip_special_tokens=False).encode()).hexdigest()) for i, t, _ in odd_rows)
    assert Counter(map(tuple, trie_bpe.digests(odd, WORD).collect())) == want
    encoded = trie_bpe.encode(odd, WORD)
    assert Counter((r.doc_id, bytes(r.ids)) for r in encoded.collect()) == Counter((i, np.array(ids[t], "<u4").tobytes()) for i, t, _ in odd_rows)
    assert Counter(r.text for r in trie_bpe.decode(encoded, WORD).collect()) == Counter(library.decode(ids[t], skip_special_tokens=False) for _, t, _ in odd_rows)
    assert trie_bpe.digests(none, WORD).count() == 0 and trie_bpe.decode(trie_bpe.encode(none, WORD), WORD).count() == 0


def test_counts(odd, none, odd_rows):
    library = Tokenizer.from_file(BYTE)
    n = np.array([len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in odd_rows])
    got = token_counts.length_histogram(token_counts.encoded_lengths(odd, BYTE)).collect()
    assert {r.n_tokens for r in got} == set(n.tolist()) and len(got) == len(set(n.tolist()))
    for r in got:
        at = r.n_tokens
        assert (r.docs, r.tokens, r.docs_up_to, r.docs_from, r.tokens_from, r.truncated_total) == ((n == at).sum(), at * (n == at).sum(), (n <= at).sum(), (n >= at).sum(), n[n >= at].sum(), np.minimum(n, at).sum())
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(odd, BYTE)).cache()
    asked = [0, 1, 2, 7, 50, 1000, 10**6]
    assert sorted(map(tuple, token_counts.limits(histogram, asked).collect())) == [(x, (n >= x).sum(), n[n >= x].sum(), np.minimum(n, x).sum()) for x in asked]
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    assert [tuple(r) for r in token_counts.quantiles(histogram, shares).collect()] == [(q, np.quantile(n, q, method="inverted_cdf")) for q in shares]
    empty = token_counts.length_histogram(token_counts.encoded_lengths(none, BYTE)).cache()
    assert empty.count() == 0 and [tuple(r) for r in token_counts.limits(empty, [5]).collect()] == [(5, 0, 0, 0)]
    assert [tuple(r) for r in token_counts.quantiles(empty, [0.5]).collect()] == [(0.5, None)]


@pytest.mark.parametrize("change", ["normalizer", "pattern", "spaces"])
def test_other_tokenizer_files(change, tmp_path):
    """Files whose parts are others than the known ones: ids are still the library's."""
    import json

    word, byte = (json.loads(open(f, encoding="utf-8").read()) for f in (WORD, BYTE))
    if change == "normalizer":
        word["normalizer"], byte["normalizer"] = None, {"type": "Lowercase"}
    elif change == "pattern":
        word["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[\\p{L}]{1,3}|[^\\s]"}
        byte["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    else:
        for t in word["added_tokens"] + byte["added_tokens"]:
            t["lstrip"] = t["rstrip"] = True
    for make, file in ((trie_bpe.TrieBPE, word), (byte_bpe.ByteEncoder, byte)):
        library = Tokenizer.from_str(json.dumps(file))
        for text, ids in zip(HARD + ["Hello World"], make(json.dumps(file)).encode(HARD + ["Hello World"]), strict=True):
            ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    word["model"]["dropout"] = 0.5
    with pytest.raises(ValueError):
        trie_bpe.TrieBPE(json.dumps(word))


def ends_of(stream):
    return token_store.cuts(len(stream), token_store.places(stream).tolist())


def test_neighbours_do_not_move_cuts():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 50_000, n).astype("<u2") for n in (1, 70, 5000, 64, 65, 20_000, 3)]
    joined, start = token_store.places(np.concatenate(docs)), 0
    for d in docs:
        mine = joined[(joined > start) & (joined <= start + len(d))] - start
        assert token_store.cuts(len(d), mine.tolist()) == ends_of(d)
        start += len(d)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=300), st.integers(1, 60))
def test_cuts(ids, copies):
    stream = np.array(ids * copies, "<u2")
    ends = ends_of(stream)
    sizes = np.diff([0, *ends])
    assert sum(sizes) == len(stream) and (sizes <= token_store.MOST).all() and (sizes[:-1] >= min(token_store.LEAST, len(stream))).all()


def test_equal_passages_give_equal_chunks():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 50_000, 20_000)
    a, b = (np.concatenate([rng.integers(0, 50_000, n), shared]).astype("<u2") for n in (777, 3333))

    def chunks(s):
        ends = ends_of(s)
        return {s[x:y].tobytes() for x, y in zip([0, *ends], ends)}

    assert len(chunks(a) & chunks(b)) > 0.8 * len(chunks(shared.astype("<u2")))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=50), min_size=1, max_size=6), min_size=1, max_size=6))
def test_joined_checksums(groups):
    parts = [p for g in groups for p in g]
    got = token_store.crc_joined(np.array([zlib.crc32(p) for p in parts], np.uint32), np.array([len(p) for p in parts]), np.array([len(g) for g in groups]))
    assert got.tolist() == [zlib.crc32(b"".join(g)) for g in groups]


def test_store(spark, odd, none, odd_rows, tmp_path):
    library = Tokenizer.from_file(BYTE)
    path = str(tmp_path / "store")
    token_store.write_store(odd, path, BYTE)
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 0] for t in {t for _, t, _ in odd_rows}}
    got = sorted(token_store.read_checksums(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t, _ in odd_rows)
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in odd_rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    # an exact round trip, and each chunk there once
    assert Counter((r.doc_id, tuple(r.ids)) for r in token_store.read_ids(spark, path).collect()) == Counter((i, tuple(ids[t])) for i, t, _ in odd_rows)
    chunks = token_store.chunks_of(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()
    token_store.write_store(none, str(tmp_path / "none"), BYTE)
    assert token_store.read_checksums(spark, str(tmp_path / "none")).count() == 0


def in_files(path):
    """Identifiers and places of recipes as they stand in the files, taken in name order."""
    import pyarrow.parquet as pq

    tables = [pq.read_table(f) for f in sorted(Path(path, "recipes").glob("part-*"))]
    return [(n, d) for t in tables for n, d in zip(t["nth"].to_pylist(), t["doc_id"].to_pylist())]


def test_files_ascend(spark, sf_dir, tmp_path, monkeypatch):
    """Files in name order hold the documents in ascending order, whatever sizes their scans have."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.rand(3)).repartition(7)
    sizes = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        token_store.write_store(docs, str(tmp_path / "store"), BYTE)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", sizes[0])
        spark.conf.set("spark.sql.files.openCostInBytes", sizes[1])
    got = in_files(tmp_path / "store")
    assert [n for n, _ in got] == list(range(docs.count()))
    assert [d for _, d in got] == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_store_finds_damage(spark, odd, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(odd.limit(5), path, BYTE)
    parts = spark.read.parquet(f"{path}/parts")
    parts.withColumn("data", F.when(F.col("data").isNotNull(), F.concat("data", F.lit(b"\1\0")))).write.partitionBy("kind").parquet(str(tmp_path / "bad" / "parts"))
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(str(tmp_path / "bad" / name))
    with pytest.raises(Exception, match="digest"):
        token_store.read_checksums(spark, str(tmp_path / "bad")).count()

    def with_recipes(name, change):
        spark.read.parquet(f"{path}/parts").write.partitionBy("kind").parquet(str(tmp_path / name / "parts"))
        change(spark.read.parquet(f"{path}/recipes")).write.parquet(str(tmp_path / name / "recipes"))
        spark.read.parquet(f"{path}/manifest").write.parquet(str(tmp_path / name / "manifest"))
        with pytest.raises(Exception, match="manifest|recipe"):
            token_store.read_checksums(spark, str(tmp_path / name)).count()

    with_recipes("id", lambda r: r.withColumn("doc_id", F.coalesce(F.col("doc_id") + 1, F.lit(0))))
    with_recipes("start", lambda r: r.withColumn("start", F.col("start") + 1))
    with_recipes("less", lambda r: r.where("nth > 0"))
    with_recipes("root", lambda r: r.withColumn("root", F.unhex(F.sha2("root", 256))))
    with_recipes("chunks", lambda r: r.withColumn("digests", F.concat("digests", "digests")))


def test_store_of_one_hot_identifier(spark, tmp_path, monkeypatch):
    """A third of all rows have one identifier and text; nodes of the manifest are small, so there are several levels."""
    monkeypatch.setattr(token_store, "FAN", 4)
    rows = [(7 if i % 3 == 0 else i, "the same text" if i % 3 == 0 else f"text {i % 11}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, BYTE)
    got = sorted(token_store.read_checksums(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    levels = spark.read.parquet(f"{path}/manifest").where("level > 0").groupBy("level").count().collect()
    assert {r.level: r["count"] for r in levels} == {1: 75, 2: 19, 3: 5, 4: 2, 5: 1}
