"""Predicates over identifiers, paths and secrets."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The patterns of identifiers (for whole texts).
PROJECT_ID = r"[a-z0-9]+(?:-[a-z0-9]+)*"
SCENE_ID = r"scn_[a-z0-9]{12,32}"
IMAGE_ID = r"(?:img_)?[0-9a-f]{64}"
SHA256 = r"[0-9a-f]{64}"
SECRET_REFERENCE = r"(?:env|keychain|secret-store|mcp-oauth):[A-Za-z0-9_.@/:-]{1,240}"
SECRET_KEY = (
    r"(^|_)(api_?key|access_?token|refresh_?token|password|passwd|authorization|"
    r"credential|secret|client_?secret|private_?key|cookie)(_|$)"
)
#: Names of profile fields that would hold a secret.
SECRET_NAMES = ("api_key", "apikey", "authorization", "bearer", "credential", "credentials", "password", "secret", "token")
#: What shuts two movements into one.
MOVEMENT_JOINS = (",", "+", ";", " then ", " and ", " oraz ")


def matches(value: Column, pattern: str) -> Column:
    """Whether the whole text fits; null counts as no."""
    return F.coalesce(value.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def is_project_id(value: Column, most: int = 64) -> Column:
    return matches(value, PROJECT_ID) & (F.length(value) <= most)


def is_scene_id(value: Column) -> Column:
    return matches(value, SCENE_ID)


def is_image_id(value: Column, sha256: Column) -> Column:
    """An image's identifier is its digest, with or without ``img_``."""
    return matches(value, IMAGE_ID) & matches(sha256, SHA256) & ((value == sha256) | (value == F.concat(F.lit("img_"), sha256)))


def is_sha256(value: Column) -> Column:
    return matches(value, SHA256)


def is_relative_path(value: Column) -> Column:
    """A portable relative path: no NUL, backslash, drive, ``..`` part or leading slash."""
    parts = F.split(value, "/")
    # a single-dot or empty part between others is dropped by the path rules, and so allowed
    bad = F.exists(parts, lambda p: p == "..") | ~F.exists(parts, lambda p: (p != "") & (p != "."))
    return F.coalesce((value != "") & ~value.rlike(r"[\x00\\]") & ~value.rlike("^[A-Za-z]:") & ~value.startswith("/") & ~bad, F.lit(False))


def is_inside(path: Column, folder: Column) -> Column:
    """Whether a normalised path lies in a folder (text only; no links are followed)."""
    return (path == folder) | path.startswith(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))


def archive_name_problem(name: Column, directory: Column) -> Column:
    """Why an archive member's name is unsafe; null if it is safe."""
    cut = F.when(directory, F.regexp_replace(name, "/$", "")).otherwise(name)
    parts = F.split(cut, "/")
    return (
        F.when(name.isNull() | (name == "") | (F.instr(name, "\0") > 0), "name")
        .when(F.instr(name, "\\") > 0, "backslash")
        .when(name.startswith("/") | name.rlike("^[A-Za-z]:"), "absolute")
        .when((cut == "") | (F.instr(cut, "//") > 0), "ambiguous")
        .when(F.exists(parts, lambda p: p == "..") | (cut == ".") , "traversal")
        .when(F.exists(parts, lambda p: (F.length(p) > 255) | p.rlike(r"[ .]$") & (p != ".")), "segment")
        .when(name.rlike(r"[\x00-\x1f]"), "control")
        .when(F.length(cut) > 1024, "length")
    )


def is_single_movement(movement: Column) -> Column:
    text = F.coalesce(movement, F.lit(""))
    joined = F.lit(False)
    for mark in MOVEMENT_JOINS:
        joined = joined | (F.instr(text, mark) > 0)
    return text.rlike(r"(?U)\S") & ~joined


def is_secret_reference(value: Column) -> Column:
    return matches(value, SECRET_REFERENCE)


#: How known secrets start.
SECRET_STARTS = ("sk-", "ghp_", "github_pat_", "xoxb-", "xoxp-", "AIza")


def looks_secret(value: Column, prefixes: tuple[str, ...] = SECRET_STARTS) -> Column:
    """Whether a text has the shape of a secret: a known start, or 40 or more mixed characters."""
    started = F.lit(False)
    for p in prefixes:
        started = started | value.startswith(p)
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 12
    # a text with white space has the shape of no secret but by its start
    return F.coalesce(started | ((F.length(value) >= 40) & matches(value, "[A-Za-z0-9_+./=-]+") & varied), F.lit(False))


def secret_paths_of(document: str | None, allowed: tuple[str, ...] = ()) -> list[str]:
    """Paths of fields, at any depth, whose names would hold a secret."""
    found: list[str] = []

    def walk(value, path):
        if isinstance(value, dict):
            for key, child in value.items():
                here = f"{path}[{key!r}]"
                name = key.replace("-", "_")
                if name == "secret_reference":
                    if here not in allowed:
                        found.append(here)
                elif re.search(SECRET_KEY, name, re.IGNORECASE):
                    found.append(here)
                walk(child, here)
        elif isinstance(value, list):
            for i, child in enumerate(value):
                walk(child, f"{path}[{i}]")

    try:
        walk(json.loads(document or "null"), "$")
    except ValueError:
        return ["$"]
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def secret_paths(documents: pd.Series) -> pd.Series:
    return documents.map(secret_paths_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def profile_secret_paths(documents: pd.Series) -> pd.Series:
    """As above, where the profile's own ``secret_reference`` is allowed."""
    return documents.map(lambda d: secret_paths_of(d, ("$['secret_reference']",)))


def has_secret_name(keys: Column) -> Column:
    """Whether any of an array of field names is, exactly, one that would hold a secret."""
    return F.exists(keys, lambda k: F.lower(F.regexp_replace(k, "-", "_")).isin(*SECRET_NAMES))
