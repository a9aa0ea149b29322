"""Documents as rows: one for each node, for questions about any depth of very many documents at once.

A document (a variant) is taken apart by recursion in Spark: each step explodes the
objects and arrays of the step before.  A node has the path of segments from the
root, ``k`` and a member's name or ``i`` and an item's place padded with zeros, so
paths sort as canonical text does.  Patches merge as joins of paths, and text is
put together again from sorted leaves, each of which knows by its neighbours which
containers it opens and closes.  No Python runs for any of it.

Limits: 64 levels (deeper containers stay whole, and are told by ``depth``);
integers of more than 38 digits are doubles to the parser, and decimals of 19 digits
and more before a point and nothing but zeros behind it are integers; a double that
this Java prints with more digits than it needs keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propflow.functions.rules import SECRET_KEY
from propflow.functions.text import quoted_name
from propflow.operators.state import MANAGED

MOST_DEPTH = 64
#: What JSON text escapes by name.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
#: Digits that an item's place is padded to.
_PLACE = 10


def nodes(docs: DataFrame, key: str, document: str, arrays: bool = True) -> DataFrame:
    """(key, path, shown, kind, value) of each node, the root first; without ``arrays`` an array is one node.

    A null document has no nodes.
    """
    spark = docs.sparkSession
    # the default bound is a million rows, whatever the documents
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    rows = docs.select(F.col(key).alias("key"), F.col(document).alias("document")).where("document IS NOT NULL")
    within = "w.kind IN ('OBJECT', 'ARRAY')" if arrays else "w.kind = 'OBJECT'"
    found = spark.sql(
        f"""WITH RECURSIVE w(key, path, shown, kind, value) AS (
              SELECT key, cast(array() AS array<string>), '$', regexp_extract(schema_of_variant(document), '^[A-Z]+', 0), document FROM {{rows}}
              UNION ALL
              SELECT w.key, array_append(w.path, coalesce(concat('k', e.key), concat('i', lpad(e.pos, {_PLACE}, '0')))),
                concat(w.shown, '[', coalesce({quoted_name("e.key")}, cast(e.pos AS string)), ']'), regexp_extract(schema_of_variant(e.value), '^[A-Z]+', 0), e.value
              FROM w, LATERAL variant_explode(w.value) e WHERE {within} AND size(w.path) < {MOST_DEPTH})
            SELECT * FROM w""",
        rows=rows,
    )
    return found.withColumnRenamed("key", key)


def _kept(rows: DataFrame) -> DataFrame:
    """Rows that are used several times, computed once: in the shared folder, where there is one."""
    spark = rows.sparkSession
    return rows.checkpoint() if spark.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def secret_fields(docs: DataFrame, key: str, document: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(key, path) of each field, at any depth, whose name would hold a secret; a reference to one is fine where it is allowed."""
    last = F.element_at("path", -1)
    name = F.regexp_replace(F.substr(last, F.lit(2)), "-", "_")
    secret = F.when(name == "secret_reference", ~F.col("shown").isin(*allowed) if allowed else F.lit(True)).otherwise(name.rlike(f"(?i){SECRET_KEY}"))
    return nodes(docs, key, document).where((F.size("path") > 0) & F.startswith(last, F.lit("k")) & secret).select(key, F.col("shown").alias("path"))


def json_string(text: Column) -> Column:
    """A text as a JSON literal with raw Unicode."""
    out = text
    for raw, escaped in _ESCAPES.items():
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    for code in [c for c in range(32) if chr(c) not in _ESCAPES]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    odd = text.rlike('[\\x00-\\x1f"\\\\\\\\]')
    return F.concat(F.lit('"'), F.when(odd, out).otherwise(text), F.lit('"'))


def float_text(value: Column) -> Column:
    """A double as Python prints it: positional from 0.0001 to below 10 ** 16, else with an exponent of two digits or more."""
    text = value.cast("string")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    plain = F.regexp_replace(text, "^-", "")
    mantissa, power = F.regexp_extract(plain, r"^([0-9.]+)", 1), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(plain, r"E(-?[0-9]+)$", 1), F.lit("")), F.lit("S999")).cast("int"), F.lit(0))
    whole, part = F.regexp_extract(mantissa, r"^([0-9]+)", 1), F.regexp_extract(mantissa, r"\.([0-9]+)$", 1)
    digits = F.concat(whole, F.when(part == "0", "").otherwise(part))
    # the place of the point within the digits
    point = F.length(whole) + power
    right = F.concat(F.rpad(digits, F.greatest(point, F.length(digits)).cast("int"), F.lit("0")), F.when(F.length(digits) <= point, "0").otherwise(""))
    moved = F.concat(F.substr(right, F.lit(1), point), F.lit("."), F.substr(right, point + 1))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    steps = point - 1
    scientific = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), F.when(steps < 0, "-").otherwise("+"), F.lpad(F.abs(steps).cast("string"), F.greatest(F.lit(2), F.length(F.abs(steps).cast("string"))).cast("int"), F.lit("0")))
    far = F.when((steps < -4) | (steps >= 16), scientific).when(point <= 0, small).otherwise(moved)
    return F.when(F.contains(plain, F.lit("E")), F.concat(sign, far)).otherwise(text)


def leaf_text(kind: Column, value: Column) -> Column:
    """Canonical text of a leaf; null for a number that is not finite."""
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    # the parser takes 100.0 for a decimal and drops its zero, but keeps whole numbers of 64 bits as such
    fraction = (kind == "DOUBLE") | (kind == "FLOAT") | ((kind == "DECIMAL") & (F.contains(text, F.lit(".")) | (F.abs(number) < F.lit(2.0**63))))
    return (
        F.when(kind == "STRING", json_string(text))
        .when(kind == "VOID", "null")
        .when(kind == "OBJECT", "{}")
        .when(kind == "ARRAY", "[]")
        .when(fraction, F.when(F.abs(number) < F.lit(float("inf")), float_text(number)))
        .otherwise(text)
    )


def leaves(docs: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, text, bare): nodes that hold no others, as canonical text; ``bare`` marks empty objects."""
    found = nodes(docs, key, document)
    empty = F.to_json("value").isin("{}", "[]")
    some = found.where(~F.col("kind").isin("OBJECT", "ARRAY") | empty)
    return some.select(key, "path", leaf_text(F.col("kind"), F.col("value")).alias("text"), (F.col("kind") == "OBJECT").alias("bare"))


def _common(a: Column, b: Column) -> Column:
    """Segments that two paths begin with alike."""
    least = F.least(F.size(a), F.size(b))
    differs = F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.coalesce(F.try_element_at(a, i) != F.try_element_at(b, i), F.lit(False)))
    at = F.array_position(differs, F.lit(True)).cast("int")
    return F.when(least == 0, 0).when(at > 0, at - 1).otherwise(least)


def text_of_leaves(found: DataFrame, key: str) -> DataFrame:
    """(key, text) of the documents whose leaves are given: sorted members, no blanks; null text if a leaf has none."""
    line = Window.partitionBy(key).orderBy("path")
    near = found.withColumns({"before": F.lag("path").over(line), "after": F.lead("path").over(line)})
    n, p = F.size("path"), F.col("path")
    shared_before = F.when(F.col("before").isNull(), 0).otherwise(_common(p, F.col("before")))
    shared_after = F.when(F.col("after").isNull(), 0).otherwise(_common(p, F.col("after")))
    member = lambda s: F.startswith(s, F.lit("k"))
    name = lambda s: F.when(member(s), F.concat(json_string(F.substr(s, F.lit(2))), F.lit(":"))).otherwise("")
    bracket = lambda s, a, b: F.when(member(s), a).otherwise(b)
    new = F.slice(p, shared_before + 1, n)
    # the first new segment goes on in a container that is open, unless it is the first of all; each other opens its own
    opened = F.transform(new, lambda s, i: F.concat(F.when((i > 0) | F.col("before").isNull(), bracket(s, "{", "[")).otherwise(","), name(s)))
    # a segment's container closes if what comes after does not go on in it
    ending = F.when(F.col("after").isNull(), 0).otherwise(shared_after + 1)
    closed = F.reverse(F.array_join(F.transform(F.slice(p, ending + 1, F.greatest(n, F.lit(1))), lambda s: bracket(s, "}", "]")), ""))
    piece = F.when(n == 0, F.col("text")).otherwise(F.concat(F.array_join(opened, ""), F.col("text"), closed))
    pieces = near.select(key, "path", piece.alias("piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy(key).agg(F.when(F.bool_and(F.col("piece").isNotNull()), whole).alias("text"))


def canonical_texts(docs: DataFrame, key: str, document: str) -> DataFrame:
    """(key, text, sha256) of each document in canonical form."""
    return text_of_leaves(leaves(docs, key, document), key).withColumn("sha256", F.sha2("text", 256))


def _array_leaves(docs: DataFrame, key: str, document: str) -> DataFrame:
    """Leaves of objects, with whole arrays as leaves: what a patch replaces."""
    found = _kept(leaves(docs, key, document))
    at = F.array_position(F.transform("path", lambda s: F.startswith(s, F.lit("i"))), F.lit(True)).cast("int")
    inner = found.withColumn("_at", at)
    flat = inner.where("_at = 0").select(key, "path", "text", "bare")
    # text of an array from its own leaves: its path is its key, as long as it is taken for a document
    held = inner.where("_at > 0").select(F.struct(F.col(key).alias("k"), F.slice("path", F.lit(1), F.col("_at") - 1).alias("p")).alias("of"), F.slice("path", F.col("_at"), F.size("path")).alias("path"), "text")
    whole = text_of_leaves(held, "of").select(F.col("of.k").alias(key), F.col("of.p").alias("path"), "text", F.lit(False).alias("bare"))
    return flat.unionByName(whole)


def merged(documents: DataFrame, patches: DataFrame, key: str, document: str, patch: str) -> DataFrame:
    """(key, text): documents with their patches, objects merged member by member and all else replaced.

    One patch a document at most; documents without one come out as they are.
    """
    # each would be taken apart several times, by all who read it
    base, new = _kept(_array_leaves(documents, key, document)), _kept(_array_leaves(patches, key, patch))
    up_to = lambda last: F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("path", F.lit(1), k)))
    # leaves above a patch's give way to what the patch puts there
    above = new.where("size(path) > 0").select(key, up_to(F.size("path") - 1).alias("path")).distinct()
    left = base.join(above, [key, "path"], "left_anti")
    # so do leaves at or under a patch's; an empty object replaces no object
    over = left.select(key, F.col("path").alias("whole"), up_to(F.size("path")).alias("path")).join(new.select(key, "path", "bare"), [key, "path"])
    gone = over.where(~F.col("bare") | (F.col("whole") == F.col("path"))).select(key, F.col("whole").alias("path")).distinct()
    idle = over.where(F.col("bare") & (F.col("whole") != F.col("path"))).select(key, "path").distinct()
    # an empty object that the patch itself fills elsewhere is no leaf of it, so what is left is the result
    return text_of_leaves(left.join(gone, [key, "path"], "left_anti").unionByName(new.join(idle, [key, "path"], "left_anti")), key)


def patched(projects: DataFrame, patches: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, status, revision, text): very many projects patched at once, each from the revision that its writer read.

    projects: key, revision, document (variant).  patches: key, expected, patch
    (variant), one a project.  A patch is ``stale`` if the project has another
    revision by now, ``managed`` if it would change a field that only the store
    sets, ``absent`` without a project; those change nothing.  ``text`` is the new
    document of an ``applied`` one, in canonical form.
    """
    barred = F.exists(F.array(*[F.lit(f"$.{m}") for m in MANAGED]), lambda _: F.lit(False))
    for m in MANAGED:
        # a member that is there with null counts, too
        barred = barred | F.coalesce(F.schema_of_variant("patch").rlike(rf"^OBJECT<(?:.*, )?{m}: "), F.lit(False)) & F.schema_of_variant(F.try_variant_get("patch", f"$.{m}", "variant")).isNotNull()
    met = patches.join(projects, key, "left").withColumn(
        "status", F.when(F.col("revision").isNull(), "absent").when(F.col("expected") != F.col("revision"), "stale").when(barred, "managed").otherwise("applied")
    )
    able = met.where("status = 'applied'")
    texts = merged(able.select(key, "document"), able.select(key, "patch"), key, "document", "patch")
    out = met.select(key, "status", "revision").join(texts, key, "left")
    return out.withColumn("revision", F.col("revision") + F.when(F.col("status") == "applied", 1).otherwise(0))
