"""Digests of canonical text, and perceptual hashes."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_json(value: Column) -> Column:
    """A string as a JSON literal with raw Unicode; null as ``null``."""
    inner = F.to_json(F.struct(value.cast("string").alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substr(inner, F.lit(6), F.length(inner) - 6))


def object_json(fields: dict[str, Column]) -> Column:
    """An object with sorted keys from columns that already hold JSON text."""
    parts = [F.concat(F.lit(json.dumps(k) + ":"), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def array_json(items: Column) -> Column:
    """An array from an array column of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def int_json(value: Column) -> Column:
    return F.coalesce(value.cast("long").cast("string"), F.lit("null"))


def double_json(value: Column) -> Column:
    """A double as Python prints it, for magnitudes from 0.001 to 9999999 (Spark prints those alike)."""
    return F.coalesce(value.cast("double").cast("string"), F.lit("null"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical(value) -> str:
    """Canonical JSON of a value: sorted keys, no blanks, raw Unicode, finite numbers only."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


@F.pandas_udf(T.StringType())
def canonical_sha256(documents: pd.Series) -> pd.Series:
    """Digest of the canonical form of JSON texts; null where one is not JSON or not finite."""

    def one(text):
        try:
            return hashlib.sha256(canonical(json.loads(text)).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return documents.map(one, na_action="ignore")


def session_scope(session: Column) -> Column:
    """Digest of a session's nonce; null where it breaks the rules for one."""
    good = F.length(session).between(16, 256) & ~session.rlike(r"(?U)^\s|\s$") & ~session.rlike(r"[\x00-\x1f\x7f]")
    return F.when(good, F.sha2(session, 256))


def dhash_bits(pixels: Column, size: int) -> Column:
    """Bits by row of ``size`` rows of ``size + 1`` pixels: whether each is brighter than the next."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size * size - 1)),
        lambda i: F.when(F.get(pixels, F.floor(i / size).cast("int") * (size + 1) + i % size) > F.get(pixels, F.floor(i / size).cast("int") * (size + 1) + i % size + 1), 1).otherwise(0),
    )


def dhash(pixels: Column, size: int = 8) -> Column:
    """A hash of size * size bits (size 4 to 32) as hex digits, the first bit the highest."""
    if not 4 <= size <= 32:
        raise ValueError("a hash has 4 to 32 rows")
    digits = math.ceil(size * size / 4)
    bits = dhash_bits(pixels, size)
    if digits * 4 > size * size:
        bits = F.concat(F.array_repeat(F.lit(0), digits * 4 - size * size), bits)
    # a number of 64 bits holds 16 digits, so longer hashes are made of several
    starts = F.array(*[F.lit(4 * at) for at in range(0, digits, 15)])

    def piece(at: Column) -> Column:
        some = F.slice(bits, at + 1, F.lit(60))
        number = F.aggregate(some, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))
        return F.lpad(F.hex(number), F.floor(F.size(some) / 4).cast("int"), F.lit("0"))

    return F.lower(F.array_join(F.transform(starts, piece), ""))


def hex_long(digits: Column) -> Column:
    """64 bits of at most 16 hex digits as a signed number; more digits stop the query."""
    return F.when(F.length(digits) > 16, F.raise_error(F.lit("more than 64 bits")).cast("long")).otherwise(F.conv(digits, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hex hashes of equal length differ; null for unequal lengths."""

    def differing(at: Column) -> Column:
        part = (F.conv(F.substring(x, at, F.lit(15)), 16, 10).cast("long") for x in (a, b))
        left, right = part
        return F.bit_count(left.bitwiseXOR(right))

    longer = F.aggregate(F.sequence(F.lit(1), F.length(a), F.lit(15)), F.lit(0), lambda acc, at: acc + differing(at))
    short = F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long")))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) <= 16, short).otherwise(longer))


def json_equal(a, b) -> bool:
    """Equality of JSON values: true is not 1, but 1 is 1.0."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(json_equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(json_equal(v, b[k]) for k, v in a.items())
    return type(a) is type(b) and a == b
