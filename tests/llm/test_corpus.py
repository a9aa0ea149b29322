import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from propflow.llm import mixing, quality, registry, url_filter


def water(sizes, share=1.5, most=2.0):
    """Targets by taking those held out one round after another."""
    weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))]
    held, left = {}, share * sum(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in held]
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i] + 1e-9]
        if not over:
            return [held.get(i, left * weights[i] / total if total else 0) for i in range(len(sizes))]
        for i in over:
            held[i] = most * sizes[i]
        left = share * sum(sizes) - sum(held.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert got == pytest.approx(water(sizes), abs=1e-6) and sum(got) == pytest.approx(1.5 * sum(sizes))


def test_mixing(odd, none, odd_rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.mix(odd).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in odd_rows)
    names = sorted({s for _, _, s in odd_rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(size(t) for _, t, s in odd_rows if s == n) for n in names]
    goal = dict(zip(totals, mixing.targets(totals)))
    assert len(goal) == len(totals)  # each source is known by its size
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.target == goal[r.source_size]
        taken[r.source_size] += r.taken
    assert all(abs(taken[n] - goal[n]) <= 1 for n in totals)
    again = mixing.mix(odd.repartition(5)).collect()
    key = lambda r: (r.text_hash, str(r.doc_id), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0 and mixing.mixed(odd).columns == odd.columns


def test_schedule_is_spread(spark):
    plan = [{"sid": i, "source": str(i), "source_size": n, "target": float(n), "quota": q, "block": 10, "blocks": -(-n // 10), "groups": 1} for i, (n, q) in enumerate([(5000, 6000), (2000, 1500), (105, 210)])]
    rows = mixing.schedule(spark, plan).orderBy("k").collect()
    assert {p["sid"]: sum(r["take"] for r in rows if r.sid == p["sid"]) for p in plan} == {p["sid"]: p["quota"] for p in plan}
    need = [600, 150, 22]
    order = [r.sid for r in rows]
    for cut in range(50, len(order), 50):
        for s, n in enumerate(need):
            assert abs(order[:cut].count(s) - cut * n / sum(need)) < 6
    for s in range(3):
        assert [r["rank"] for r in rows if r.sid == s] == list(range(need[s]))


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality_on_held_out_rows(spark):
    got = quality.op3_quality(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id").quality
    held = got[got.held_out].join(labels, how="inner")
    assert auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.95
    assert ((held.score >= 0.3) == held.quality).mean() > 0.93


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and auc(y[3000:], model.score(x[3000:])) > 0.97


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, "x"), (4, 1, None), (9, 1, "x"), (9, None, "x"), (None, 1, "x"), (11, 0, "x")], "doc_id long, quality int, score string")
    for rows, known in ((odd, labels), (odd, labels.limit(0)), (none, labels), (odd, labels.where("quality = 1"))):
        model = quality.train(rows, known)
        got = quality.score(rows, model).collect()
        assert len(got) == rows.count() and all(0 <= r.score <= 1 for r in got)
        kept = quality.keep_good(rows, model)
        assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in got)


URLS = [None, "", "no scheme", "http://EXAMPLE.net/en/a?x", "https://a.example.net/en/", "http://example.net", "http://example.net/fr/", "http://notexample.net/en/", "ftp://x.example.com/de/#f", "http://example.com/DE/", "http://x.org/fr/", "http://x.org/en/", "a://b://net/", "://net/", "http://net/x", "http://net?x", "http://net/x"]


def judge(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {i: judge(u) for i, u in enumerate(URLS)}
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_native_queries_have_no_python(spark, sf_dir):
    for name in ("op6_url_filter", "op8_order_minhash", "op10_line_dedup"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, stage(spark, seen, sf_dir)
        if name == "bpe":
            assert seen.count() == before.count()
        else:
            assert seen.columns == docs.columns
        if name in ("quality", "exact_dedup", "near_dedup"):
            assert seen.join(before, "doc_id", "left_anti").count() == 0 and 0 < seen.count() <= before.count()
        if name == "exact_dedup":
            assert seen.count() == before.select("text").distinct().count()


def test_pipeline_of_odd_rows(spark, odd, none, odd_rows, tmp_path):
    """Each stage on nulls, blanks, ties, repeated rows, very long texts and clashing columns; and on nothing."""
    labels = spark.createDataFrame([(4, 1), (9, 1), (1, 0)], "doc_id long, quality int")
    for name, rows in (("odd", odd), ("none", none)):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    seen, texts = odd, {t or "" for _, t, _ in odd_rows}
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, stage(spark, seen, str(tmp_path / "odd")).cache()
        rows = [(r.doc_id, r.text or "") for r in before.collect()]
        if name == "bpe":
            assert seen.columns == ["doc_id", "n_tokens", "ids_sha256", "ids"] and seen.count() == len(rows)
            continue
        got = [(r.doc_id, r.text or "") for r in seen.collect()]
        assert seen.columns == odd.columns and set(got) <= set(rows)
        if name == "exact_dedup":
            # of each text one row stays, that of the smallest identifier; null comes after all others
            assert sorted(t for _, t in got) == sorted({t for _, t in rows})
            assert all(i == min((j for j, u in rows if u == t and j is not None), default=None) for i, t in got)
        if name == "near_dedup":
            assert len({t for _, t in got}) == len(got) > 0 and not any(t.endswith(" end") for _, t in got)
        if name == "mixing":
            # what has no words is never taken
            assert all(t.split() for _, t in got)
        texts &= {t for _, t in got}
    nothing = none
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path / "none"))
        assert nothing.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
