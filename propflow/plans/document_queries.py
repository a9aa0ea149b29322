"""Queries over nested documents, made from rows of the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.functions.rules import SECRET_KEY
from propflow.operators.trees import canonical_texts, json_string, patched, secret_fields
from propflow.operators.validation import nested_faults
from propflow.plans.common import spread, table


def _variant(template: str, *values: Column) -> Column:
    return F.parse_json(F.format_string(template, *values))


def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each turn of a conversation: names out of order, escapes, numbers, empty and nested containers."""
    turns = spread(table(spark, sf_dir, "conversations").where("text IS NOT NULL"), "conv_id", "turn")
    document = _variant(
        '{"role": %s, "text":%s, "n": {"third": %s, "big": 12345678901234567890, "e": [], "d": {}},\n "items": [null, {"k2": true, "k10": [%d, 1.50, -0.25]}]}',
        json_string(F.col("role")), json_string(F.col("text")), (F.col("turn") / 4).cast("string"), F.col("turn"),
    )
    docs = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), document.alias("document"))
    return canonical_texts(docs, "id", "document")


def secret_fields_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer, with names that would hold secrets at depths that its number settles."""
    named = F.element_at(F.array(*[F.lit(x) for x in ("api_key", "access-token", "secret_reference", "tokens", "my_Cookie_jar")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    reference = F.when(named == "secret_reference", "").otherwise(', "secret_reference": "env:A"')  # no name twice
    document = _variant('{"%s": {"a": [1, {"%s": [{"private_key": 1}, {"secretary": 2}]}]}%s, "nation": {"it\'s": {"password": %d}}}', named, named, reference, F.col("c_nationkey"))
    docs = spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", document.alias("document"))
    return secret_fields(docs, "c_custkey", "document", ("$['secret_reference']",))


def document_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each customer and a patch for each, of five kinds; every seventh was written from an older revision."""
    customers = spread(table(spark, sf_dir, "customer"), "c_custkey")
    document = _variant('{"tags": ["a", {"x": 1}], "customer": {"name": %s, "address": {"phone": %s, "nation": %d}}, "note": null}', json_string(F.col("c_name")), json_string(F.col("c_mktsegment")), F.col("c_nationkey"))
    kinds = ('{"customer": {"address": {"phone": "new"}}}', '{"tags": [1, {"b": 2, "a": []}], "new": {"k": {}}}', '{"customer": 7.50}', '{"project_id": "x"}', '{"note": {"by": null}, "customer": {"address": {}}}')
    patch = F.parse_json(F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("c_custkey") % 5 + 1).cast("int")))
    revision = F.col("c_custkey") % 3
    projects = customers.select(F.col("c_custkey").alias("project_id"), revision.alias("revision"), document.alias("document"))
    patches = customers.select(F.col("c_custkey").alias("project_id"), (revision - F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0)).alias("expected"), patch.alias("patch"))
    return patched(projects, patches).select("project_id", "status", F.col("revision").cast("long").alias("revision"), "text")


#: Closed objects within arrays within an object.
PLAN_SCHEMA = {
    "type": "object", "required": ["name", "scenes"], "additionalProperties": False,
    "properties": {
        "name": {"type": "string", "maxLength": 40},
        "scenes": {"type": "array", "minItems": 1, "maxItems": 3, "items": {
            "type": "object", "required": ["move"], "additionalProperties": False,
            "properties": {"move": {"enum": ["pan", "hold", None]}, "seconds": {"type": "number", "minimum": 2, "maximum": 45.5}, "tags": {"type": "array", "items": {"type": "string", "pattern": "^[A-Z]"}}},
        }},
    },
}


def schema_rules_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of one to four scenes for each part, with faults that its columns settle."""
    scene = F.format_string(
        '{"move": %s, "seconds": %d, "tags": ["A", %s]%s}', F.when(F.col("p_partkey") % 11 == 0, '"zoom"').when(F.col("p_partkey") % 2 == 0, "null").otherwise('"pan"'), F.col("p_size"),
        json_string(F.col("p_type")), F.when(F.col("p_partkey") % 13 == 0, ', "more": {}').otherwise(""),
    )
    scenes = F.concat(F.repeat(F.lit('{"move": "hold"}, '), (F.col("p_partkey") % 4).cast("int")), scene)
    document = F.when(F.col("p_partkey") % 17 != 0, F.parse_json(F.concat(F.lit('{"scenes": ['), scenes, F.lit('], "name": '), json_string(F.col("p_name")), F.lit("}"))))
    return nested_faults(spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", document.alias("document")), "p_partkey", "document", PLAN_SCHEMA)


QUERIES = {f.__name__: f for f in (canonical_documents, secret_fields_by_depth, document_patches, schema_rules_nested)}

_NODE_NAME = "CASE WHEN contains(t.key, '''') AND NOT contains(t.key, '\"') THEN '\"' || t.key || '\"' ELSE '''' || t.key || '''' END"

SQL = {
    "canonical_documents": """
        WITH d AS (SELECT conv_id * 1000 + turn AS id, '{"items":[null,{"k10":[' || turn || ',1.5,-0.25],"k2":true}],"n":{"big":12345678901234567890,"d":{},"e":[],"third":' || (turn / 4)::DOUBLE::VARCHAR
          || '},"role":' || to_json(role)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}' AS text FROM conversations WHERE text IS NOT NULL)
        SELECT id, text, sha256(text) AS sha256 FROM d""",
    "secret_fields_by_depth": f"""
        WITH RECURSIVE n AS (SELECT c_custkey, c_nationkey, ['api_key', 'access-token', 'secret_reference', 'tokens', 'my_Cookie_jar'][c_custkey % 5 + 1] AS x FROM customer),
        d AS (SELECT c_custkey, ('{{"' || x || '": {{"a": [1, {{"' || x || '": [{{"private_key": 1}}, {{"secretary": 2}}]}}]}}'
          || CASE WHEN x = 'secret_reference' THEN '' ELSE ', "secret_reference": "env:A"' END || ', "nation": {{"it''s": {{"password": ' || c_nationkey || '}}}}}}')::JSON AS document FROM n),
        t AS (SELECT d.c_custkey, t.id, t.parent, t.key, p.type AS kind FROM d, json_tree(d.document) t, json_tree(d.document) p WHERE p.id = t.parent),
        w AS (SELECT c_custkey, 0::UBIGINT AS id, '$' AS path, NULL::VARCHAR AS name FROM customer
          UNION ALL SELECT t.c_custkey, t.id, w.path || '[' || CASE t.kind WHEN 'ARRAY' THEN t.key ELSE {_NODE_NAME} END || ']', CASE t.kind WHEN 'ARRAY' THEN NULL ELSE replace(t.key, '-', '_') END
          FROM w JOIN t ON t.c_custkey = w.c_custkey AND t.parent = w.id)
        SELECT c_custkey, path FROM w WHERE CASE WHEN name = 'secret_reference' THEN path <> '$[''secret_reference'']' ELSE regexp_matches(name, '(?i){SECRET_KEY}') END""",
    "schema_rules_nested": """
        WITH p AS (SELECT *, '$[''scenes''][' || p_partkey % 4 || ']' AS scene FROM part)
        SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN '$: not a document' WHEN length(p_name) > 40 THEN '$[''name'']: maxLength' WHEN p_partkey % 4 = 3 THEN '$[''scenes'']: maxItems'
          WHEN p_partkey % 13 = 0 THEN scene || ': additionalProperties ''more''' WHEN p_partkey % 11 = 0 THEN scene || '[''move'']: enum' WHEN p_size < 2 THEN scene || '[''seconds'']: minimum'
          WHEN p_size > 45.5 THEN scene || '[''seconds'']: maximum' WHEN NOT regexp_matches(p_type, '^[A-Z]') THEN scene || '[''tags''][1]: pattern' END AS fault FROM p""",
    "document_patches": """
        WITH c AS (SELECT c_custkey AS project_id, c_custkey % 3 AS revision, c_custkey % 5 AS kind, c_custkey % 7 = 0 AS older, '"name":' || to_json(c_name)::VARCHAR AS name, '"nation":' || c_nationkey AS nation, to_json(c_mktsegment)::VARCHAR AS phone FROM customer),
        s AS (SELECT *, CASE WHEN older THEN 'stale' WHEN kind = 3 THEN 'managed' ELSE 'applied' END AS status FROM c)
        SELECT project_id, status, revision + CASE status WHEN 'applied' THEN 1 ELSE 0 END AS revision, CASE WHEN status = 'applied' THEN CASE kind
          WHEN 0 THEN '{"customer":{"address":{' || nation || ',"phone":"new"},' || name || '},"note":null,"tags":["a",{"x":1}]}'
          WHEN 1 THEN '{"customer":{"address":{' || nation || ',"phone":' || phone || '},' || name || '},"new":{"k":{}},"note":null,"tags":[1,{"a":[],"b":2}]}'
          WHEN 2 THEN '{"customer":7.5,"note":null,"tags":["a",{"x":1}]}'
          WHEN 4 THEN '{"customer":{"address":{' || nation || ',"phone":' || phone || '},' || name || '},"note":{"by":null},"tags":["a",{"x":1}]}' END END AS text FROM s""",
}
