"""Scalar functions over text, numbers and times."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapsed(text: Column, most: int) -> Column:
    """White space (Unicode) to single blanks, trimmed, cut to ``most`` code points; null when nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")
    return F.when(clean != "", F.left(clean, F.lit(most)))


def finite(number: Column) -> Column:
    """A double, or null where the text or number is none or not finite."""
    value = number.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def rational(text: Column) -> Column:
    """A number, or a fraction ``a/b``; null where it is neither or b is 0."""
    cut = F.instr(text, "/")
    top, bottom = finite(F.substring_index(text, "/", 1)), finite(F.substr(text, cut + 1))
    return F.when(cut > 0, F.try_divide(top, bottom)).otherwise(finite(text))


def address(parts: list[Column]) -> Column:
    """Distinct non-empty parts in order, joined by a comma and a blank; null if none."""
    kept = F.array_distinct(F.array_compact(F.array(*[collapsed(p, 300) for p in parts])))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", "))


def srcset(value: Column) -> Column:
    """Image addresses of a srcset attribute, in order; none where it is overlong."""
    items = F.transform(F.split(F.when(F.length(value) <= 20_000, value), ","), lambda x: F.split(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+")[0])
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def sample_times(duration: Column) -> Column:
    """Seconds of the five sample frames; the last keeps clear of the end."""
    end = F.greatest(F.lit(0.0), duration - F.least(F.lit(0.04), duration / 10))
    return F.array(F.lit(0.0), duration * 0.25, duration * 0.5, duration * 0.75, end)


def utc_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_time(text: Column) -> Column:
    """A timestamp from ISO text that ends in Z; null for any other."""
    return F.when(text.endswith("Z"), F.try_to_timestamp(text))


def revision_name(revision: Column, sha256: Column, suffix: Column) -> Column:
    return F.format_string("rev-%03d-%s%s", revision, F.left(sha256, F.lit(12)), F.lower(suffix))


def plain_number(value: Column) -> Column:
    """A double as Python's ``%g`` prints it, for values from 0.0001 to 999999 of six digits."""
    fixed = F.format_string("%.6f", value)
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")


#: Letters that decomposition leaves whole.
_LETTERS = str.maketrans({"ł": "l", "Ł": "L"})


def slug_of(name: str | None, most: int = 64) -> str | None:
    if name is None:
        return None
    ascii_text = unicodedata.normalize("NFKD", name.strip().translate(_LETTERS)).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "-", ascii_text).strip("-")[:most].rstrip("-") or None


@F.pandas_udf(T.StringType())
def slug(names: pd.Series) -> pd.Series:
    """A file-safe name of a-z, 0-9 and single hyphens; null where nothing is left."""
    return names.map(slug_of, na_action="ignore")


@F.pandas_udf(T.StringType())
def collision_key(names: pd.Series) -> pd.Series:
    """Names equal after NFC and case folding have equal keys."""
    return names.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")


def collision_key_ascii(name: Column) -> Column:
    """The same for names of ASCII letters, without Python."""
    return F.lower(name)


def quoted_name(name: str) -> str:
    """SQL of a member's name in quotes, with control characters escaped."""
    single, double, back = "char(39)", "char(34)", "char(92)"
    escaped = f"replace({name}, {back}, concat({back}, {back}))"
    plain = escaped
    for code in (*range(32), 127):
        escaped = f"replace({escaped}, char({code}), concat({back}, '{ {9: 't', 10: 'n', 13: 'r'}.get(code, f'x{code:02x}') }'))"
    body = f"CASE WHEN {name} RLIKE '[\\\\x00-\\\\x1f\\\\x7f]' THEN {escaped} ELSE {plain} END"
    return f"CASE WHEN contains({name}, {single}) AND NOT contains({name}, {double}) THEN concat({double}, {body}, {double}) ELSE concat({single}, replace({body}, {single}, concat({back}, {single})), {single}) END"
