import random
import struct
import pandas as pd
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propflow.llm import components, exact_dedup, line_dedup, order_minhash, registry, simhash

NO_ID = lambda i: (i is None, i or 0)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_against_sql(name, spark, sf_dir, duck):
    same_rows(registry.QUERIES[name](spark, sf_dir), duck.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("keep,rows", [("smallest", 65_536), ("largest", 3)])
def test_exact(odd, none, odd_rows, keep, rows):
    groups = defaultdict(list)
    for i, t, _ in odd_rows:
        groups[t or ""].append(i)
    got = exact_dedup.exact_dedup(odd, keep=keep, memtable_rows=rows).collect()
    assert len(got) == len(odd_rows) and exact_dedup.exact_dedup(none, keep=keep).count() == 0
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r.text_sha256]
        known = [i for i in ids if i is not None]
        want = (min(known) if keep == "smallest" else max(known)) if known else None
        assert (r.keep_id, r.group_size, r.kept) == (want, len(ids), r.doc_id == want)


def test_exact_keeps_one_row_of_each_text(odd, none, odd_rows):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter({t or "": 1 for _, t, _ in odd_rows})
    assert exact_dedup.keep_one(none).count() == 0


def test_runs_merge_like_one_table():
    rng = np.random.default_rng(1)
    pool = np.array([hashlib.sha256(bytes([i])).digest() for i in range(200)], "S32")

    def run(k):
        d = np.sort(rng.choice(pool, k, replace=False))
        return exact_dedup.Run(d, rng.integers(0, 1000, k), rng.integers(1, 5, k))

    parts = [run(k) for k in (150, 80, 40, 1)]
    want = defaultdict(lambda: [10**9, 0])
    for p in parts:
        for d, i, c in zip(p.digests, p.ids, p.counts):
            want[d] = [min(want[d][0], i), want[d][1] + c]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.merge(p, np.minimum)
    assert {d: [i, c] for d, i, c in zip(merged.digests, merged.ids, merged.counts)} == dict(want)
    assert merged.maybe(merged.digests).all() and (np.sort(merged.digests) == merged.digests).all()


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
    counts = np.zeros(64, int)
    for h in hashes:
        counts += (h >> np.arange(64, dtype=np.uint64).astype(object) & 1).astype(int)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=200), min_size=1, max_size=20), st.sampled_from([0, 42]))
def test_xxh64(parts, seed):
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    got = simhash.xxh64(data, ends - [len(p) for p in parts], ends, np.uint64(seed))
    assert got.tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB é\t\n\x0b "), max_size=40), max_size=8))
def test_fingerprints(texts):
    raw = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    got = simhash.fingerprints(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert got.tolist() == [fingerprint(t) for t in texts]


def brute_components(prints, ids, distance=2):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    order = sorted(prints)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if bin(a ^ b).count("1") <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, p in ids:
        r = find(p)
        least[r] = min(least.get(r, i), i, key=NO_ID)
    return {p: least[find(p)] for p in prints}


def test_simhash(odd, none, odd_rows):
    got = simhash.near_duplicates(odd).collect()
    prints = {t: fingerprint(t) for _, t, _ in odd_rows}
    want = brute_components(set(prints.values()), [(i, prints[t]) for i, t, _ in odd_rows])
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{prints[t]:016x}", want[prints[t]]) for i, t, _ in odd_rows)
    assert simhash.near_duplicates(none).count() == 0


def test_similar_of_odd_rows(odd, none, odd_rows):
    """Every row has a class with its smallest identifier; one row of each class stays."""
    got = simhash.similar(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in odd_rows)
    classes = defaultdict(list)
    for r in got:
        classes[r.component].append(r)
    for rows in classes.values():
        known = [r.doc_id for r in rows if r.doc_id is not None]
        assert {r.component_id for r in rows} == {min(known, default=None)}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(classes)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(rows[0].component_id for rows in classes.values())
    assert simhash.similar(none).count() == 0 and simhash.keep_one(none).count() == 0


def wide_fingerprint(text, words=5):
    """Bits set in over half the derived hashes, lane after lane, from the definition."""
    full = (1 << 64) - 1
    p1, p2, p3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    out = 0
    for k in range(simhash.TABLES // 2):
        votes = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, seed=42)
            if k:
                h = (h + k * p3) * p1 & full
                h = (h ^ h >> 29) * p2 & full
                h ^= h >> 32
            for b in range(64):
                votes[b] += h >> b & 1
        out |= sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles)) << 64 * k
    return out


def test_similar_against_exact_similarity(spark):
    """Links of the stage against all pairs: 0.9 of those alike by 0.8 share a class, and no class is held by longer links."""
    rnd = random.Random(3)
    texts = []
    for n in range(40):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 160))]
        for c in range(rnd.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rnd.randrange(3) if c else 0):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(5000)}"
            texts.append(" ".join(copy))
    # copies of one text, in number far beyond the others
    texts += [texts[0]] * 300
    got = {r.doc_id: r.component for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    distinct = {t: i for i, t in reversed(list(enumerate(texts)))}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t, i in distinct.items()}
    prints = {i: wide_fingerprint(t) for t, i in distinct.items()}
    alike = same = 0
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    alike += 1
                    same += got[a] == got[b]
                if (prints[a] ^ prints[b]).bit_count() <= simhash.WIDE_DISTANCE:
                    root[find(a)] = find(b)
    assert alike > 100 and same >= 0.9 * alike
    assert all(find(a) == find(b) for a in sets for b in sets if got[a] == got[b])
    assert len({got[i] for i, t in enumerate(texts) if t == texts[0]}) == 1


def test_every_colliding_pair_counts(spark):
    """Components are those of all pairs that share a word up to two bits and are near: with a hot group, a chain and strays."""
    rng = np.random.default_rng(17)
    lanes = simhash.TABLES // 2

    def turned(x, n):
        bits = np.unpackbits(x.view(np.uint8))
        bits[rng.choice(len(bits), n, replace=False)] ^= 1
        return np.packbits(bits).view(np.uint64)

    base = rng.integers(0, 2**63, (30, lanes), dtype=np.uint64) * np.uint64(2)
    prints = [*base] + [turned(base[0], int(n)) for n in rng.integers(1, 90, 150)]  # a group of two thirds of all
    for b in base[1:12]:
        prints += [turned(b, int(n)) for n in rng.integers(30, 80, 3)]
    link = base[20]
    for _ in range(12):  # each is near the one before only
        link = turned(link, 50)
        prints.append(link)
    # a stray that shares one word with the group and is far from it, and one near it that shares none exactly
    stray = rng.integers(0, 2**63, lanes, dtype=np.uint64)
    stray[0] = base[0][0]
    near = base[0].copy()
    near.view(np.uint32)[:] ^= np.uint32(1 << 9)
    prints = np.unique(np.stack([*prints, stray, near]), axis=0)
    words = prints.view(np.uint32).reshape(len(prints), -1)
    least = {i: i for i in range(len(prints))}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in range(len(prints)):
        apart = np.bitwise_count(words[a] ^ words[a + 1 :])
        for b in np.flatnonzero((apart.min(1) <= 2) & (apart.sum(1) <= simhash.WIDE_DISTANCE)) if len(apart) else ():
            x, y = sorted((find(a), find(a + 1 + int(b))))
            least[y] = x
    frame = spark.createDataFrame([(i, p.view(np.int64).tolist()) for i, p in enumerate(prints)], "node long, fp array<long>").repartition(3)
    got = {r.node: r.comp for r in simhash.wide_components(frame).collect()}
    assert len(got) == len(prints)
    assert len({find(i) for i in got}) == len(set(got.values())) == len({(find(i), c) for i, c in got.items()})


def rows_of_joins(spark, since):
    """Rows that joins made in all executions after the first ``since``."""
    store, found = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList(since, 1000)
    for r in range(runs.size()):
        values, nodes = store.executionMetrics(runs.apply(r).executionId()), store.planGraph(runs.apply(r).executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and (got := values.get(m.accumulatorId())).isDefined():
                    found += int(re.sub(r"\D", "", got.get().split("\n")[-1].split(" ")[0]) or 0)
    return found


def test_pairs_of_a_common_word_are_no_rows(spark):
    """Texts that share one word and are far apart are all compared, and joins make a few rows for each of them, not for each pair."""
    n, lanes = 400, simhash.TABLES // 2
    prints = np.random.default_rng(5).integers(-(2**63), 2**63, (n, lanes))
    prints[:, 0] = (prints[:, 0] & ~0xFFFFFFFF) | 12345
    prints[1] = prints[0]
    prints[1, 1:] ^= 1 << 40
    frame = spark.createDataFrame([(i, p.tolist(), i) for i, p in enumerate(prints)], "node long, fp array<long>, comp long")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert {frozenset(r) for r in simhash.colliding_links(frame).collect()} == {frozenset((0, 1))}
    assert 0 < rows_of_joins(spark, since) < 20 * n


@pytest.mark.parametrize("block", [1, 8, 64])
def test_buckets_in_blocks(spark, block):
    """Links between single texts, of buckets that are dealt in blocks and read in small batches, are those of all pairs."""
    rng, lanes = np.random.default_rng(block), simhash.TABLES // 2
    base = rng.integers(0, 2**63, lanes, dtype=np.uint64)
    prints = []
    for n in rng.integers(1, 70, 60):
        bits = np.unpackbits(base.view(np.uint8))
        bits[rng.choice(len(bits), int(n), replace=False)] ^= 1
        prints.append(np.packbits(bits).view(np.uint64))
    prints = np.unique(np.stack(prints), axis=0)
    words = prints.view(np.uint32).reshape(len(prints), -1)
    comp = [int(i) % 50 for i in range(len(prints))]  # some are of one component from the start
    want = set()
    for a in range(len(prints)):
        for b in range(a):
            apart = np.bitwise_count(words[a] ^ words[b])
            if comp[a] != comp[b] and apart.min() <= 2 and apart.sum() <= simhash.WIDE_DISTANCE:
                want.add(frozenset((comp[a], comp[b])))
    frame = spark.createDataFrame([(i, p.view(np.int64).tolist(), comp[i]) for i, p in enumerate(prints)], "node long, fp array<long>, comp long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {frozenset(r) for r in simhash.colliding_links(frame, block=block).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # a bucket's largest component meets all others there, so every link of two components is found
    assert len(want) > 100 and got == want


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_connect_all_within_distance(spark, distance):
    rng = np.random.default_rng(distance)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    prints = {b ^ sum(1 << int(k) for k in rng.integers(0, 64, n)) for b in base for n in range(7)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "fp long")
    found = components.components(simhash.links(frame, distance)).collect()
    label = {r.u: r.v for r in found}
    want = brute_components(prints, [(p, p) for p in prints], distance)
    groups = defaultdict(set)
    for p in prints:
        groups[label.get(p - (1 << 64) if p >> 63 else p, p - (1 << 64) if p >> 63 else p)].add(want[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_long_chains(spark):
    n = 3000
    order = np.random.default_rng(0).permutation(n)
    links = [(int(order[i]), int(order[i + 1])) for i in range(n - 1)] + [(n + i, n + i + 1) for i in range(5)] + [(n, n), (n + 1, n)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, n)} | {n + i: n for i in range(1, 6)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_lines(rows, least=50):
    """Line numbers to delete: lines of any run of whole lines, of so many words, that stands somewhere before."""
    docs = []
    for key, text in rows:
        found = []
        for n, line in enumerate(text.split("\n")):
            w = len(re.findall(r"[^\x20\x09-\x0D]+", line))
            if w:
                found.append((n, line.strip(" \t\x0b\x0c\r"), w))
        docs.append((key, found))
    seen, gone = {}, defaultdict(set)
    for key, lines in docs:
        for i in range(len(lines)):
            total = 0
            for j in range(i, len(lines)):
                total += lines[j][2]
                if total >= least:
                    run = tuple(x[1] for x in lines[i : j + 1])
                    first = seen.setdefault(run, (key, i))
                    if first != (key, i):
                        gone[key] |= set(range(lines[i][0], lines[j][0] + 1))
                    if total >= least + 60:
                        break
    return gone


def test_lines(spark, odd, none, odd_rows):
    short = [(i, t, s) for i, t, s in odd_rows if not (t and len(t) > 100_000)]
    frame = odd.where("text IS NULL OR length(text) < 100000")
    got = line_dedup.line_dedup(frame).collect()
    hashed = {t: spark.createDataFrame([(t,)], "text string").select(F.xxhash64(F.lit(5), F.coalesce("text", F.lit("")))).first()[0] for t in {t for _, t, _ in short}}
    unique = sorted({(i if i is not None else 2**63 - 1, hashed[t], t or "") for i, t, _ in short})
    gone = brute_lines([((i, h), t) for i, h, t in unique])
    assert len(got) == len(short)
    want = Counter()
    for i, t, _ in short:
        removed = gone[i if i is not None else 2**63 - 1, hashed[t]]
        lines = (t or "").split("\n")
        want[i, "\n".join(x for n, x in enumerate(lines) if n not in removed), len(lines), tuple(sorted(removed))] += 1
    assert Counter((r.doc_id, r.text, r.n_lines, tuple(r.removed)) for r in got) == want
    assert sum(1 for r in got if r.removed) >= 2 and line_dedup.line_dedup(none).count() == 0
    assert line_dedup.line_dedup(odd).count() == len(odd_rows)


def sketch_model(text, k=order_minhash.WORDS):
    """The fingerprint by its definition, k-mer by k-mer."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    xx = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    seen = Counter()
    bins = defaultdict(list)
    for i in range(max(1, len(words) - k + 1)) if words else []:
        h = 42
        for w in words[i : i + k]:
            h = xx(w.encode(), h)
        nth = seen[h]
        seen[h] += 1
        if nth:
            h = xx(struct.pack("<i", nth), xx(struct.pack("<Q", h)))
        value = h >> (64 - order_minhash._VALUE)
        bins[value >> (order_minhash._VALUE - order_minhash.BIN_BITS)].append((value, i))
    out = []
    for number in sorted(bins):
        chosen = sorted(sorted(bins[number])[: order_minhash.TUPLE], key=lambda x: x[1])
        h = 42
        for value, _ in chosen:
            h = xx(struct.pack("<q", value), h)
        out.append(number << 32 | h >> 32)
    return out


def likeness_model(a, b):
    either = {x >> 32 for x in a} | {x >> 32 for x in b}
    return len({*a} & {*b}) / len(either) if either else 1.0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("moved,least", [(False, 0.9), (True, 0.6)])
def test_likeness_falls_with_edit_distance(moved, least):
    """Rank correlation with the distance in words: of texts with scattered edits, and with some texts turned round as well.

    A scattered edit spoils five k-mers and a moved block few, so likeness ranks
    the two kinds apart, and the correlation over both is weaker.
    """
    rnd = random.Random(11)
    pairs = []
    for n in range(150):
        words = [f"w{rnd.randrange(500)}" for _ in range(200)]
        other = list(words)
        for _ in range(n // 5):
            at = rnd.randrange(len(other))
            other[at : at + 1] = rnd.choice([[], [f"v{n}"], [other[at], f"v{n}"]])
        if moved and n % 3 == 0:
            cut = rnd.randrange(1, 60)
            other = other[cut:] + other[:cut]
        pairs.append((edit_distance(words, other), likeness_model(sketch_model(" ".join(words)), sketch_model(" ".join(other)))))
    distance, like = (pd.Series(x).rank() for x in zip(*pairs))
    print(distance.corr(like))
    assert distance.corr(like) < -least


def test_order_minhash(spark, odd, none, odd_rows):
    got = order_minhash.fingerprint_edits(odd).collect()
    assert len(got) == len(odd_rows) and order_minhash.fingerprint_edits(none).count() == 0
    hashed = {t: spark.createDataFrame([(t,)], "text string").select(F.xxhash64("text")).first()[0] for t in {t or "" for _, t, _ in odd_rows}}
    order = sorted(((i is None, -(i or 0), hashed[t or ""], t or "", i) for i, t, _ in odd_rows))
    want = Counter()
    for k, (_, _, _, t, i) in enumerate(order):
        after = order[(k + 1) % len(order)][3]
        cut = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    model = {t: sketch_model(t) for t in {x[3] for x in order}}
    likes = Counter()
    for k, (_, _, _, t, i) in enumerate(order):
        after = order[(k + 1) % len(order)][3]
        cut = len(t) // 3
        edited = sketch_model(t[: len(t) - cut] + after[:cut])
        likes[i, "".join(f"{x:010x}" for x in model[t]), "".join(f"{x:010x}" for x in edited), likeness_model(model[t], edited), likeness_model(model[t], model[after])] += 1
    assert Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == likes
    by_length = defaultdict(set)
    for r in got:
        by_length[r.n_chars].add(r.fingerprint)
    assert by_length[0] == {""} and len(by_length[len("same row")]) >= 1
    long = [r.fingerprint for r in got if r.doc_id in (6, 7)]
    assert long[0] == long[1]


def test_order_minhash_sees_order_and_counts(spark):
    words = [f"w{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    near = words[:390] + [f"v{i}" for i in range(10)]
    repeated = words[:100] * 4
    texts = {"a": words, "same": words, "swapped": swapped, "near": near, "far": [f"z{i}" for i in range(400)], "repeated": repeated, "once": words[:100], "none": [], "blank": []}
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, text string")
    rows = {r.k: r.s for r in frame.select("k", order_minhash.sketch(F.col("text")).alias("s")).collect()}

    def like(a, b):
        pair = spark.createDataFrame([(rows[a], rows[b])], "a array<long>, b array<long>")
        return pair.select(order_minhash.likeness(F.col("a"), F.col("b"))).first()[0]

    assert like("a", "same") == 1 and like("none", "blank") == 1 and like("a", "none") == 0 and like("a", "far") == 0
    assert like("a", "near") > 0.75 and like("a", "swapped") < like("a", "near")  # the same words in another order are not alike
    assert 0 < like("a", "swapped") < 0.8 and like("repeated", "once") < 0.9
    # against the definition: of each bin the two smallest numbered k-mers, in text order
    for k in ("a", "repeated"):
        assert len(rows[k]) == len({x >> 32 for x in rows[k]}) <= 32
    assert {k: sorted(rows[k]) for k in rows} == {k: sketch_model(" ".join(v)) for k, v in texts.items()}
