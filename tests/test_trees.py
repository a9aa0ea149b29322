"""Documents as rows, against the definitions over nested values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from propflow.functions.hashing import canonical
from propflow.functions.rules import secret_paths_of
from propflow.operators import trees
from propflow.operators.state import deep_merge

ODD = ["", "a", "b c", "é", "漢", "😀", 'q"q', "it's", "\\", "line\nend", "\x01\x1f", "\x7f", "ü\t", "$x", "0"]
NUMBERS = [0, -1, 7, 2**53, -(2**63), 12345678901234567890123, 0.5, -0.25, 1.5e300, 1e16, 123456789.5, 1e-7, 0.0001, 0.00012, 1e22, 9007199254740993.0, 3.14, 100.0, -2.5e-10, 1e7, 12345678.9]


def value(rnd, depth):
    kind = rnd.randrange(8 if depth else 5)
    if kind < 2:
        return rnd.choice(ODD)
    if kind == 2:
        return rnd.choice(NUMBERS)
    if kind < 5:
        return rnd.choice([True, False, None])
    if kind == 5:
        return [value(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return {rnd.choice(ODD[1:] + ["api_key", "x-password", "secret_reference", "cookies", "k2", "k10"]): value(rnd, depth - 1) for _ in range(rnd.randrange(5))}


@pytest.fixture(scope="module")
def documents():
    rnd = random.Random(5)
    return [value(rnd, 4) for _ in range(120)] + [[], {}, {"a": {}, "b": [[], {}]}, "text", None, [[1, [2, {"z": 1, "a": [3]}]], 4], {f"k{i}": i for i in range(30)}, NUMBERS, ODD]


def frame(spark, values, name="document"):
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id int, t string").repartition(3).select("id", F.parse_json("t").alias(name))


def test_canonical_text(spark, documents):
    got = {r.id: r.text for r in trees.canonical_texts(frame(spark, documents), "id", "document").collect()}
    assert got == {i: canonical(v) for i, v in enumerate(documents)}


def test_secret_fields(spark, documents):
    some = [*documents, {"a": [{"access_token": {"password": 1}}]}, {"secret_reference": "env:X", "p": {"secret-reference": 1}}]
    got = {}
    for r in trees.secret_fields(frame(spark, some), "id", "document", ("$['secret_reference']",)).collect():
        got.setdefault(r.id, []).append(r.path)
    want = {i: found for i, v in enumerate(some) if (found := secret_paths_of(json.dumps(v), ("$['secret_reference']",)))}
    assert len(want) > 10 and {i: sorted(p) for i, p in got.items()} == {i: sorted(p) for i, p in want.items()}


def test_merged(spark):
    rnd = random.Random(8)
    names = ["a", "b", "c"]

    def tree(depth):
        kind = rnd.randrange(6 if depth else 3)
        return rnd.choice([1, "x", None, [], [1, {"z": [2]}], {}]) if kind < 3 else {rnd.choice(names): tree(depth - 1) for _ in range(rnd.randrange(4))}

    base, new = ([tree(3) for _ in range(150)] for _ in range(2))
    got = {r.id: r.text for r in trees.merged(frame(spark, base), frame(spark, new, "patch").where("id < 140"), "id", "document", "patch").collect()}
    assert got == {i: canonical(deep_merge(b, p) if i < 140 else b) for i, (b, p) in enumerate(zip(base, new))}


def test_patched(spark):
    projects = frame(spark, [{"name": "a", "n": {"x": 1}}] * 5).withColumn("revision", F.lit(3))
    new = [{"n": {"y": [2]}}, {"n": 1}, {"project_id": None}, {"timestamps": {"t": 1}}, {"x: OBJECT<project_id: ": 1}, {"a": 1}]
    patches = frame(spark, new, "patch").withColumn("expected", F.when(F.col("id") == 1, 2).otherwise(3))
    got = {r.id: (r.status, r.revision, r.text) for r in trees.patched(projects, patches, "id").collect()}
    assert got == {
        0: ("applied", 4, '{"n":{"x":1,"y":[2]},"name":"a"}'), 1: ("stale", 3, None), 2: ("managed", 3, None), 3: ("managed", 3, None),
        4: ("applied", 4, '{"n":{"x":1},"name":"a","x: OBJECT<project_id: ":1}'), 5: ("absent", None, None),
    }


def test_no_documents(spark):
    none = frame(spark, [{}]).limit(0)
    assert trees.canonical_texts(none, "id", "document").count() == 0 and trees.secret_fields(none, "id", "document").count() == 0


SCHEMA = {
    "type": "object", "required": ["id", "items"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z]+$", "minLength": 2, "maxLength": 4}, "n": {"type": ["integer", "null"], "minimum": -1, "maximum": 5}, "kind": {"enum": ["a", 1, None, False]},
        "items": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["it's"], "properties": {"it's": {"type": "number", "minimum": 0.5}, "deep": {"type": "array", "items": {"const": True}}}}},
        "map": {"type": "object", "additionalProperties": {"type": "string", "maxLength": 1}}, "free": {},
    },
}


def spoilt(rnd):
    """A document of the schema, with a fault or two or none."""
    pick = lambda good, *bad: rnd.choice([good] * 12 + list(bad))
    item = lambda: pick({"it's": pick(1.5, 0.25, "x", None, 1), **pick({}, {"deep": pick([True], [True, 1], {}, [])})}, {}, 5)
    doc = {"id": pick("abc", "A", "abcde", 7, ""), "items": pick([item() for _ in range(rnd.randrange(1, 4))], [], [item()] * 4, {}), "n": pick(3, None, 1.0, 9, True, -2, 12345678901234567890123), "kind": pick("a", 1, None, False, True, "b", 1.0, [])}
    doc["map"] = pick({"x": "y"}, {"x": "long"}, {"it\"s": 1}, {})
    doc |= pick({}, {"more": 1}, {"free": {"any": [1]}}, {"it's\n": 0})
    return pick({k: v for k, v in doc.items() if rnd.random() < 0.97}, [], None, "x")


def test_nested_faults(spark):
    from propflow.operators.validation import SchemaError, first_fault, nested_faults

    rnd = random.Random(12)
    docs = [spoilt(rnd) for _ in range(300)]
    got = {r.id: r.fault for r in nested_faults(frame(spark, docs), "id", "document", SCHEMA).collect()}
    want = {i: first_fault(json.loads(json.dumps(d, sort_keys=True)), SCHEMA) for i, d in enumerate(docs)}
    assert got == want and len({f for f in want.values()}) > 12 and None in want.values()
    none = spark.sql("SELECT 1 AS id, cast(null AS variant) AS document")
    assert nested_faults(none, "id", "document", SCHEMA).first().fault == "$: not a document"
    with pytest.raises(SchemaError):
        nested_faults(none, "id", "document", {"enum": [[1]]}).collect()


def test_patches_take_documents_apart_once(spark, sf_dir):
    """What several joins read is computed before them, not again by each."""
    from propflow.plans.document_queries import document_patches

    assert "UnionLoop" not in document_patches(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
