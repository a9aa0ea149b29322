"""Document validation: a closed subset of JSON Schema, and rules between fields.

A schema is checked once, on the driver.  It then becomes one list of rules with
paths in the order of traversal; documents (JSON texts) are walked in batches
and give the first rule each breaks.  For documents that are typed columns
already, ``column_rules`` gives the same rules as columns, so that Spark
evaluates them inside the scan.
"""

from __future__ import annotations

import json
import math
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propflow.functions.hashing import json_equal
from propflow.functions.rules import is_image_id, is_project_id, is_relative_path, is_scene_id, is_sha256, is_single_movement
from propflow.functions.text import quoted_name, utc_time
from propflow.functions.urls import host, problem_sql

#: Levels of a document that a compiled schema follows.
MOST_NESTED = 64
KEYWORDS = (
    "type", "properties", "required", "additionalProperties", "items", "minItems", "maxItems",
    "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum",
)


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


_TYPES = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "number": _number,
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
}


class SchemaError(ValueError):
    """A schema outside the subset, or one that contradicts itself."""


def check_schema(schema, path: str = "$schema") -> None:
    """Raise SchemaError, with the path, at the first fault of a schema."""
    if not isinstance(schema, dict):
        raise SchemaError(f"{path}: not an object")
    if unknown := [k for k in schema if k not in KEYWORDS]:
        raise SchemaError(f"{path}: {unknown[0]}: unknown keyword")
    faults = {
        "type": lambda v: not (names := [v] if isinstance(v, str) else v) or not isinstance(names, list) or any(not isinstance(n, str) or n not in _TYPES for n in names) or len({*names}) < len(names),
        "properties": lambda v: not isinstance(v, dict),
        "required": lambda v: not isinstance(v, list) or any(not isinstance(n, str) for n in v) or len({*v}) < len(v) or "properties" in schema and any(n not in schema["properties"] for n in v),
        "additionalProperties": lambda v: not isinstance(v, (bool, dict)),
        "pattern": lambda v: not isinstance(v, str) or not _compiles(v),
        "enum": lambda v: not isinstance(v, list) or not v or any(json_equal(a, b) for i, a in enumerate(v) for b in v[:i]),
        **{k: (lambda v: not _TYPES["integer"](v) or v < 0) for k in ("minItems", "maxItems", "minLength", "maxLength")},
        **{k: (lambda v: not _number(v)) for k in ("minimum", "maximum")},
    }
    for keyword, faulty in faults.items():
        if keyword in schema and schema[keyword] is not None and faulty(schema[keyword]):
            raise SchemaError(f"{path}: {keyword}")
    for low, high in (("minItems", "maxItems"), ("minLength", "maxLength"), ("minimum", "maximum")):
        if low in schema and high in schema and schema[low] > schema[high]:
            raise SchemaError(f"{path}: {low} is over {high}")
    for name, child in (schema.get("properties") or {}).items():
        check_schema(child, f"{path}.properties[{name!r}]")
    for keyword in ("items", "additionalProperties"):
        if isinstance(schema.get(keyword), dict):
            check_schema(schema[keyword], f"{path}.{keyword}")


def _compiles(pattern: str) -> bool:
    try:
        return bool(re.compile(pattern))
    except re.error:
        return False


def first_fault(value, schema: dict, path: str = "$") -> str | None:
    """``path: keyword`` of the first rule that a value breaks, in the order of traversal."""
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{path}: type"
    if "enum" in schema and not any(json_equal(value, x) for x in schema["enum"]):
        return f"{path}: enum"
    if "const" in schema and not json_equal(value, schema["const"]):
        return f"{path}: const"
    checks: list[tuple[str, bool]] = []
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}: required {name!r}"
        more = schema.get("additionalProperties", True)
        for name, child in value.items():
            rule = schema.get("properties", {}).get(name, more)
            if rule is False:
                return f"{path}: additionalProperties {name!r}"
            if isinstance(rule, dict) and (fault := first_fault(child, rule, f"{path}[{name!r}]")):
                return fault
    elif isinstance(value, list):
        checks = [("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", len(value)))]
    elif isinstance(value, str):
        checks = [
            ("minLength", len(value) < schema.get("minLength", 0)),
            ("maxLength", len(value) > schema.get("maxLength", len(value))),
            ("pattern", "pattern" in schema and not re.search(schema["pattern"], value)),
        ]
    elif _number(value):
        checks = [("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))]
    for keyword, broken in checks:
        if broken:
            return f"{path}: {keyword}"
    if isinstance(value, list) and "items" in schema:
        return next((f for i, x in enumerate(value) if (f := first_fault(x, schema["items"], f"{path}[{i}]"))), None)
    return None


def _no_repeats(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def validate(documents: DataFrame, column: str, schema: dict) -> DataFrame:
    """Documents (JSON texts) with ``fault``: the first rule broken, or why a text is no document; null if none."""
    check_schema(schema)

    @F.pandas_udf("string")
    def fault(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return first_fault(json.loads(text, object_pairs_hook=_no_repeats), schema)
            except (TypeError, ValueError):
                return "$: not a document"
            except RecursionError:
                return "$: too deep"

        return texts.map(one)

    return documents.withColumn("fault", fault(F.col(column)))


def column_rules(schema: dict) -> Column:
    """The first fault of flat typed columns, by the same rules: ``path: keyword``, or null.

    A null column is an absent property.  Types are those of the columns.
    """
    check_schema(schema)
    faults = [F.when(F.col(n).isNull(), f"$: required {n!r}") for n in schema.get("required", [])]
    for name, rule in schema.get("properties", {}).items():
        c, path = F.col(name), f"$[{name!r}]"
        tests = {
            "enum": lambda v, c=c: ~c.isin(*v),
            "const": lambda v, c=c: c != v,
            "minLength": lambda v, c=c: F.length(c) < v,
            "maxLength": lambda v, c=c: F.length(c) > v,
            "pattern": lambda v, c=c: ~c.rlike(v),
            "minimum": lambda v, c=c: c < v,
            "maximum": lambda v, c=c: c > v,
            "minItems": lambda v, c=c: F.size(c) < v,
            "maxItems": lambda v, c=c: F.size(c) > v,
        }
        faults += [F.when(c.isNotNull() & test(rule[k]), f"{path}: {k}") for k, test in tests.items() if k in rule]
    return F.coalesce(*faults) if faults else F.lit(None).cast("string")


def project_fault(version: Column, project_id: Column, revision: Column, created: Column, updated: Column, url: Column, domain: Column) -> Column:
    """The first rule between a project's own fields that is broken (its scenes and files have theirs)."""
    made, changed = utc_time(created), utc_time(updated)
    return (
        F.when(~version.eqNullSafe(F.lit("1.0")), "schema_version")
        .when(~is_project_id(project_id), "project_id")
        .when(~F.coalesce(revision >= 1, F.lit(False)), "manifest_revision")
        .when(made.isNull(), "created_at")
        .when(changed.isNull(), "updated_at")
        .when(changed < made, "updated_before_created")
        .when(url.isNotNull() & problem_sql(url).isNotNull(), "url")
        .when(~domain.eqNullSafe(host(url)), "domain")
    )


def analysis_fault(image_id: Column, sha256: Column, path: Column, status: Column, kind: Column, room: Column, instance: Column) -> Column:
    chosen = status == "selected"
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    return (
        F.when(~is_image_id(image_id, sha256), "image_id")
        .when(~is_relative_path(path), "relative_path")
        .when(chosen & ~kind.eqNullSafe(F.lit("photo")), "asset_kind")
        .when(chosen & (blank(room) | blank(instance)), "room")
    )


def scene_fault(scene_id: Column, index: Column, image_id: Column, sha256: Column, movement: Column, path: Column, digest: Column) -> Column:
    return (
        F.when(~is_scene_id(scene_id), "scene_id")
        .when(~F.coalesce(index >= 0, F.lit(False)), "sequence_index")
        .when(~is_image_id(image_id, sha256), "source_image_id")
        .when(~is_single_movement(movement), "camera_motion")
        .when(~is_relative_path(path), "source_path")
        .when(~is_sha256(digest), "dependency_hash")
    )


#: Rules between fields by kind of document.
SEMANTICS = {"project": project_fault, "image-analysis": analysis_fault, "scene-plan": scene_fault}


def _subschemas(schema: dict) -> tuple[list[dict], dict[str, int]]:
    """All schemas within one, the whole first, and the steps between them: ``from|segment`` to where it leads.

    A segment is ``k`` and a name, ``*`` for any other name, or ``i`` for an item.
    Where names that are not known are barred, the step leads to -1.
    """
    rules, steps, waiting = [schema], {}, [0]
    while waiting:
        at = waiting.pop(0)
        rule, more = rules[at], rules[at].get("additionalProperties", True)
        inner = {f"k{n}": s for n, s in rule.get("properties", {}).items()} | ({"i": rule["items"]} if "items" in rule else {})
        if more is False:
            steps[f"{at}|*"] = -1
        elif isinstance(more, dict):
            inner["*"] = more
        for segment, child in inner.items():
            steps[f"{at}|{segment}"] = len(rules)
            waiting.append(len(rules))
            rules.append(child)
    return rules, steps


def _kinds(kind: Column, number: Column, text: Column) -> dict[str, Column]:
    # whole numbers beyond 64 bits are decimals to the parser, as 1.0 is
    whole = (kind == "BIGINT") | ((kind == "DECIMAL") & (F.abs(number) >= F.lit(2.0**63)) & ~F.contains(text, F.lit(".")))
    real = whole | (kind.isin("DECIMAL", "DOUBLE", "FLOAT") & (F.abs(number) < F.lit(math.inf)))
    return {"object": kind == "OBJECT", "array": kind == "ARRAY", "string": kind == "STRING", "number": real, "integer": whole, "boolean": kind == "BOOLEAN", "null": kind == "VOID"}


def _node_fault(rule: dict, kind: Column, value: Column) -> Column:
    """The keyword that a node breaks, of its own schema, in the order of checks; null if none."""
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    is_a = _kinds(kind, number, text)
    real, faults = is_a["number"], []

    def equals(x) -> Column:
        if isinstance(x, bool):
            return is_a["boolean"] & (text == str(x).lower())
        if x is None:
            return is_a["null"]
        if isinstance(x, str):
            return is_a["string"] & (text == x)
        if isinstance(x, (int, float)):
            return real & (number == F.lit(float(x)))
        raise SchemaError("enum and const of arrays and objects are not compiled")

    def any_of(tests: list[Column]) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | F.coalesce(t, F.lit(False))
        return out

    if rule.get("type") is not None:
        kinds = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
        faults.append((~any_of([is_a[k] for k in kinds]), "type"))
    if "enum" in rule:
        faults.append((~any_of([equals(x) for x in rule["enum"]]), "enum"))
    if "const" in rule:
        faults.append((~any_of([equals(rule["const"])]), "const"))
    for name in rule.get("required", []):
        member = F.try_variant_get(value, "$[" + json.dumps(name, ensure_ascii=False) + "]", "variant")
        faults.append((is_a["object"] & F.schema_of_variant(member).isNull(), f"required {name!r}"))
    size, length = F.size(F.try_variant_get(value, "$", "array<variant>")), F.length(text)
    tests = {
        "minItems": lambda v: is_a["array"] & (size < v), "maxItems": lambda v: is_a["array"] & (size > v),
        "minLength": lambda v: is_a["string"] & (length < v), "maxLength": lambda v: is_a["string"] & (length > v), "pattern": lambda v: is_a["string"] & ~text.rlike(v),
        "minimum": lambda v: real & (number < F.lit(float(v))), "maximum": lambda v: real & (number > F.lit(float(v))),
    }
    faults += [(test(rule[k]), k) for k, test in tests.items() if k in rule]
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), k) for broken, k in faults], F.lit(None).cast("string"))


def nested_faults(docs: DataFrame, key: str, document: str, schema: dict) -> DataFrame:
    """(key, fault) of each document, a variant of any depth, without Python.

    The schema is compiled: its parts are numbered, and the recursion that takes
    documents apart steps from part to part as it goes from node to node.  The
    fault is the first in the order of paths, which is that of ``first_fault``
    for members in the order of their names; null if there is none.
    """
    check_schema(schema)
    rules, steps = _subschemas(schema)
    spark = docs.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    table = "map(" + ", ".join(f"{quoted(k)}, {v}" for k, v in steps.items()) + ")" if steps else "cast(map() AS map<string, int>)"
    view = f"_documents_{uuid.uuid4().hex}"
    rows = docs.select(F.col(key).alias("key"), F.col(document).alias("document"))
    rows.where("document IS NOT NULL").createOrReplaceTempView(view)
    found = spark.sql(
        f"""WITH RECURSIVE w(key, path, shown, rule, barred, value) AS (
              SELECT key, cast(array() AS array<string>), '$', 0, cast(null AS string), document FROM {view}
              UNION ALL
              SELECT key, path, shown, if(rule >= 0, rule, null), if(rule = -1, name, null), value FROM (
                SELECT w.key, array_append(w.path, coalesce(concat('k', e.key), concat('i', lpad(e.pos, 10, '0')))) AS path, concat(w.shown, '[', coalesce({quoted_name("e.key")}, cast(e.pos AS string)), ']') AS shown,
                  coalesce({table}[concat(w.rule, '|', coalesce(concat('k', e.key), 'i'))], if(e.key IS NULL, null, {table}[concat(w.rule, '|*')])) AS rule, {quoted_name("e.key")} AS name, e.value
                FROM w, LATERAL variant_explode(w.value) e WHERE w.rule IS NOT NULL AND size(w.path) < {MOST_NESTED})
              WHERE rule IS NOT NULL)
            SELECT * FROM w"""
    )
    spark.catalog.dropTempView(view)
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    own = F.coalesce(*[F.when(F.col("rule") == k, _node_fault(rule, F.col("kind"), F.col("value"))) for k, rule in enumerate(rules)])
    # a barred member is a fault of the object that holds it
    parent = F.substring("shown", F.lit(1), F.length("shown") - F.length("barred") - 2)
    told = F.when(F.col("barred").isNotNull(), F.concat(parent, F.lit(": additionalProperties "), F.col("barred"))).otherwise(F.concat("shown", F.lit(": "), own))
    faults = found.withColumn("kind", kind).select("key", "path", told.alias("fault")).where("fault IS NOT NULL")
    first = faults.groupBy("key").agg(F.min_by("fault", "path").alias("fault"))
    return rows.select("key", F.col("document").isNull().alias("none")).join(first, "key", "left").select(F.col("key").alias(key), F.when(F.col("none"), "$: not a document").otherwise(F.col("fault")).alias("fault"))
