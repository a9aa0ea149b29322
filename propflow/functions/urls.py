"""Policy and parts of web addresses.

The policy is syntactic: no name is looked up.  A cheap SQL part rejects most
addresses inside the scan; what only Python's standard library can judge (IP
classes, IDNA) runs batched, on what the SQL part lets through.
"""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CHARS = 4096
#: Suffixes that are never public.
LOCAL_SUFFIXES = ("corp", "example", "home", "home.arpa", "internal", "invalid", "lan", "local", "localdomain", "onion", "test", "localhost")


def host(url: Column) -> Column:
    """Host of an address in lower case; null where it has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def problem_sql(url: Column, https_only: bool = False) -> Column:
    """The first reason to refuse an address that SQL can find; null if there is none."""
    authority = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    name = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    schemes = r"(?i)^https://" if https_only else r"(?i)^https?://"
    local = F.lit(False)
    for suffix in LOCAL_SUFFIXES:
        local = local | (name == suffix) | name.endswith("." + suffix)
    return (
        F.when(url.isNull() | (url == "") | (F.length(url) > MOST_CHARS) | url.rlike(r"(?U)^\s|\s$"), "text")
        .when(url.rlike(r"[\x00-\x1f\x7f]"), "control")
        .when(~url.rlike(schemes) | (name == ""), "scheme")
        .when(F.instr(authority, "@") > 0, "credentials")
        .when(url.rlike("#."), "fragment")
        .when((port != "") & ~F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False)), "port")
        .when(name.endswith("."), "trailing_dot")
        .when(local | ((F.instr(name, ".") == 0) & ~name.startswith("[")), "local")
    )


def problem_of(url: str | None, https_only: bool = False) -> str | None:
    """The first reason to refuse one address, or None."""
    if not url or len(url) > MOST_CHARS or url != url.strip():
        return "text"
    if any(c < " " or c == "\x7f" for c in url):
        return "control"
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return "syntax"
    if parts.scheme.casefold() not in (("https",) if https_only else ("http", "https")) or not parts.hostname:
        return "scheme"
    if parts.username is not None or parts.password is not None:
        return "credentials"
    if parts.fragment:
        return "fragment"
    if port is not None and not 1 <= port <= 65535:
        return "port"
    name = parts.hostname.casefold()
    if name.endswith("."):
        return "trailing_dot"
    if "." not in name or any(name == s or name.endswith("." + s) for s in LOCAL_SUFFIXES):
        return "local"
    try:
        return None if ipaddress.ip_address(name).is_global else "address"
    except ValueError:
        pass
    if all(re.fullmatch("0x[0-9a-f]+|[0-9]*", label) for label in name.split(".")):
        return "numeric_host"
    try:
        labels = name.encode("idna").decode("ascii").casefold().split(".")
    except UnicodeError:
        return "host"
    if len(".".join(labels)) > 253 or not all(re.fullmatch("[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?", label) for label in labels):
        return "host"
    return None


@F.pandas_udf(T.StringType())
def problem(urls: pd.Series, https_only: pd.Series) -> pd.Series:
    return pd.Series([problem_of(u, bool(h)) for u, h in zip(urls, https_only)], dtype=object)


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, reference: pd.Series) -> pd.Series:
    """Addresses of references relative to a base; null for other schemes, or without base."""
    return pd.Series([resolved(b, r) for b, r in zip(base, reference)], dtype=object)


def resolved(base: str | None, reference: str | None) -> str | None:
    if reference is None:
        return None
    try:
        scheme = urlsplit(reference).scheme.casefold()
        if scheme:
            return reference if scheme in ("http", "https") else None
        return urljoin(base, reference) if base else None
    except ValueError:
        return None
