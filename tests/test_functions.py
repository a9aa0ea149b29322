import hashlib
import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propflow.functions import hashing, rules, text, urls


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return row if len(columns) > 1 else row[0]


def test_collapse_and_address(spark):
    assert one(spark, a=text.collapsed(F.lit("  a \t b  c\n"), 4)) == "a b "
    assert one(spark, a=text.collapsed(F.lit(" \n"), 4)) is None
    parts = [F.lit(x) for x in ("Street 1", " ", "Town", "Town", "PL")]
    assert one(spark, a=text.address(parts)) == "Street 1, Town, PL"
    assert one(spark, a=text.address([F.lit(None).cast("string")])) is None


@pytest.mark.parametrize("value,want", [("30000/1001", 30000 / 1001), ("25", 25.0), ("1/0", None), ("x", None), ("inf", None), ("1e400", None), ("nan", None), ("-3/4", -0.75)])
def test_rational(spark, value, want):
    assert one(spark, a=text.rational(F.lit(value))) == want


def test_srcset(spark):
    assert one(spark, a=text.srcset(F.lit(" /a.jpg 1x,\n/b.jpg  2x, ,/c.jpg"))) == ["/a.jpg", "/b.jpg", "/c.jpg"]
    assert one(spark, a=text.srcset(F.lit("a" * 20_001))) == []
    assert one(spark, a=text.srcset(F.lit(None).cast("string"))) == []


def test_sample_times(spark):
    assert one(spark, a=text.sample_times(F.lit(10.0))) == [0.0, 2.5, 5.0, 7.5, 9.96]
    assert one(spark, a=text.sample_times(F.lit(0.1)))[-1] == pytest.approx(0.09)


def test_times(spark):
    assert one(spark, a=text.utc_text(text.utc_time(F.lit("2024-01-02T03:04:05Z")))) == "2024-01-02T03:04:05Z"
    assert one(spark, a=text.utc_time(F.lit("2024-01-02T03:04:05+00:00"))) is None
    assert one(spark, a=text.utc_time(F.lit("soonZ"))) is None


def test_names(spark):
    assert one(spark, a=text.revision_name(F.lit(7), F.lit("a" * 64), F.lit(".MP4"))) == "rev-007-aaaaaaaaaaaa.mp4"
    assert [one(spark, a=text.plain_number(F.lit(x))) for x in (5.0, 2.5, 0.125, 10.0)] == ["5", "2.5", "0.125", "10"]


def test_slug_and_collisions(spark):
    names = spark.createDataFrame([("Łódź – Dom 3",), ("***",), (None,)], "n string").select(text.slug("n")).toPandas().iloc[:, 0].tolist()
    assert names == ["lodz-dom-3", None, None]
    keys = spark.createDataFrame([("Straße",), ("STRASSE",), ("é",), ("é",)], "n string").select(text.collision_key("n")).toPandas().iloc[:, 0].tolist()
    assert keys[0] == keys[1] and keys[2] == keys[3]


GOOD = ("https://www.site.pl/a?b=c", "http://8.8.8.8/x", "https://żółw.pl/", "http://site.pl:8080/")
BAD = {
    "": "text", " http://a.pl": "text", "http://a.pl/\x01": "control", "ftp://a.pl/": "scheme", "http:///a": "scheme", "http://u:p@a.pl/": "credentials", "http://a.pl/#x": "fragment",
    "http://a.pl:0/": "port", "http://a.pl./": "trailing_dot", "http://localhost/": "local", "http://a.local/": "local", "http://intranet/": "local", "http://a.example/": "local",
    "http://10.0.0.1/": "address", "http://127.0.0.1/": "address", "http://0x7f.0.0.1/": "numeric_host", "http://2130706433.0/": "numeric_host", "http://-a.pl/": "host", "http://a_b.pl/": "host", "x" * 5000: "text",
}


def test_url_policy(spark):
    assert [urls.problem_of(u) for u in GOOD] == [None] * len(GOOD)
    assert {u: urls.problem_of(u) for u in BAD} == BAD
    assert urls.problem_of("http://site.pl/", https_only=True) == "scheme"
    frame = spark.createDataFrame([(u,) for u in [*GOOD, *BAD]], "u string")
    rows = frame.select("u", urls.problem("u", F.lit(False)).alias("full"), urls.problem_sql(F.col("u")).alias("sql")).toPandas()
    for row in rows.itertuples():
        assert (row.full or None) == BAD.get(row.u)
        # the SQL part never refuses what the policy allows, and agrees on what it can tell
        assert row.sql is None or row.sql == row.full


def test_resolve():
    assert urls.resolved("https://a.pl/x/y", "../z.jpg") == "https://a.pl/z.jpg"
    assert urls.resolved(None, "z.jpg") is None
    assert urls.resolved("https://a.pl/", "data:image/png,x") is None
    assert urls.resolved(None, "http://b.pl/") == "http://b.pl/"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.integers(-5, 5), st.floats(0.001, 9_999_999)), min_size=1, max_size=20))
def test_canonical_json(spark, rows):
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["s", "i", "d"]), "s string, i int, d double")
    got = frame.select("s", "i", "d", hashing.object_json({"z": hashing.text_json(F.col("s")), "a": hashing.int_json(F.col("i")), "m": hashing.double_json(F.col("d"))}).alias("j")).collect()
    for r in got:
        assert json.loads(r.j) == {"z": r.s, "a": r.i, "m": r.d}
        if r.s.isprintable():
            assert r.j == hashing.canonical({"z": r.s, "a": r.i, "m": r.d})


def test_canonical_sha256(spark):
    frame = spark.createDataFrame([('{"b": 1, "a": [1.5, null]}',), ("{",), ("NaN",)], "t string")
    got = frame.select(hashing.canonical_sha256("t")).toPandas().iloc[:, 0].tolist()
    assert got == [hashlib.sha256(b'{"a":[1.5,null],"b":1}').hexdigest(), None, None]


def test_session_scope(spark):
    assert one(spark, a=hashing.session_scope(F.lit("s" * 16))) == hashlib.sha256(b"s" * 16).hexdigest()
    assert all(one(spark, a=hashing.session_scope(F.lit(x))) is None for x in ("short", " " + "s" * 16, "s" * 16 + "\x7f", "s" * 257))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=72, max_size=72), st.lists(st.integers(0, 255), min_size=72, max_size=72))
def test_dhash_and_hamming(spark, a, b):
    def model(p):
        bits = "".join("1" if p[r * 9 + c] > p[r * 9 + c + 1] else "0" for r in range(8) for c in range(8))
        return f"{int(bits, 2):016x}"

    frame = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    row = frame.select(hashing.dhash(F.col("a")).alias("a"), hashing.dhash(F.col("b")).alias("b")).select("a", "b", hashing.hamming(F.col("a"), F.col("b")).alias("d")).first()
    assert (row.a, row.b) == (model(a), model(b))
    assert row.d == bin(int(row.a, 16) ^ int(row.b, 16)).count("1")


def test_json_equal():
    assert hashing.json_equal(1, 1.0) and not hashing.json_equal(1, True) and not hashing.json_equal([1], [True])
    assert hashing.json_equal({"a": [1, None]}, {"a": [1.0, None]}) and not hashing.json_equal("1", 1)


def test_identifiers(spark):
    assert one(spark, a=rules.is_project_id(F.lit("dom-3"))) and not one(spark, a=rules.is_project_id(F.lit("dom--3")))
    assert not one(spark, a=rules.is_scene_id(F.lit("scn_" + "a" * 12 + "\n"))) and one(spark, a=rules.is_scene_id(F.lit("scn_" + "a" * 12)))
    digest = "0f" * 32
    assert one(spark, a=rules.is_image_id(F.lit("img_" + digest), F.lit(digest))) and not one(spark, a=rules.is_image_id(F.lit("img_" + digest), F.lit("1" + digest[1:])))


@pytest.mark.parametrize("path,good", [("a/b.jpg", True), ("../a", False), ("/a", False), ("C:/a", False), ("a\\b", False), ("", False), ("a/../b", False), (".", False)])
def test_relative_path(spark, path, good):
    assert one(spark, a=rules.is_relative_path(F.lit(path))) is good


@pytest.mark.parametrize("name,want", [("a/b.png", None), ("../b.png", "traversal"), ("a/../b", "traversal"), ("/b", "absolute"), ("c:b", "absolute"), ("a\\b", "backslash"), ("a//b", "ambiguous"), ("a/b.", "segment"), ("a\x01", "control"), ("", "name")])
def test_archive_name(spark, name, want):
    assert one(spark, a=rules.archive_name_problem(F.lit(name), F.lit(False))) == want


def test_movement_and_secrets(spark):
    assert one(spark, a=rules.is_single_movement(F.lit("slow push-in"))) and not one(spark, a=rules.is_single_movement(F.lit("push and pan"))) and not one(spark, a=rules.is_single_movement(F.lit(" ")))
    assert rules.secret_paths_of('{"a": [{"api-key": 1}], "secret_reference": "env:X"}') == ["$['a'][0]['api-key']", "$['secret_reference']"]
    assert rules.secret_paths_of('{"secret_reference": "env:X"}', ("$['secret_reference']",)) == []
    assert one(spark, a=rules.looks_secret(F.lit("sk-abc"))) and not one(spark, a=rules.looks_secret(F.lit("a" * 64))) and one(spark, a=rules.looks_secret(F.lit("abcdefghijklmnopqrstuvwxyz0123456789ABCD")))
    assert one(spark, a=rules.is_secret_reference(F.lit("env:KEY"))) and not one(spark, a=rules.is_secret_reference(F.lit("KEY")))
    assert one(spark, a=rules.has_secret_name(F.array(F.lit("x"), F.lit("Api-Key"))))
