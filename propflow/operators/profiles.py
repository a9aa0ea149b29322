"""Provider profiles: freshness, rules by status, life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propflow.functions.rules import is_secret_reference, looks_secret

MAX_AGE_DAYS, AHEAD_MINUTES = 7, 5
METHODS = ("MCP", "API")
#: Capabilities a profile must list, and those that must be verified.
CAPABILITIES = ("image_to_video", "submission", "polling", "download", "idempotency_key", "ratios", "durations_seconds", "cost_status")
VERIFIED = ("image_to_video", "submission", "polling", "download")


def freshness(verified_at: Column, now: Column, days: int = MAX_AGE_DAYS) -> Column:
    """fresh, stale, unverified, or ``future`` for a time that has not come."""
    return (
        F.when(verified_at.isNull(), "unverified")
        .when(verified_at > now + F.expr(f"INTERVAL {AHEAD_MINUTES} MINUTES"), "future")
        .when(now > verified_at + F.expr(f"INTERVAL {days} DAYS"), "stale")
        .otherwise("fresh")
    )


def semantics_problem(status: Column, name: Column, method: Column, reference: Column, verified_at: Column, authorized: Column, sources: Column, errors: Column, capability: dict[str, Column], ratios: Column, durations: Column) -> Column:
    """The first rule of its status that a profile breaks; null if none."""
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    none = lambda a: F.coalesce(F.size(a) == 0, F.lit(True))
    configured = status != "not_configured"
    unverified = F.lit(False)
    for c in VERIFIED:
        unverified = unverified | ~F.coalesce(capability[c].cast("string") == "true", F.lit(False))
    return (
        F.when(~configured & ~(blank(name) & blank(method) & blank(reference) & blank(verified_at)), "not_configured")
        .when(configured & F.coalesce(F.trim(name) == "", F.lit(True)), "name")
        .when(configured & ~F.coalesce(method.isin(*METHODS), F.lit(False)), "method")
        .when(status.isin("pending_validation", "validated", "stale") & ~is_secret_reference(reference), "secret_reference")
        .when(configured & ~blank(reference) & ~is_secret_reference(reference), "secret_reference")
        .when(configured & ~blank(verified_at) & (~verified_at.endswith("Z") | F.try_to_timestamp(verified_at).isNull()), "verified_at")
        .when(~authorized.eqNullSafe(F.lit(False)), "generation_authorized")
        .when(status.isin("validated", "stale") & blank(verified_at), "verified_at")
        .when(status.isin("validated", "stale") & none(sources), "official_sources")
        .when((status == "validated") & unverified, "capabilities")
        .when((status == "validated") & (none(ratios) | none(durations)), "formats")
        .when(status.isin("stale", "blocked") & none(errors), "verification_errors")
    )


def profile_problem(name: Column, expected: Column, method: Column, authorized: Column, reference: Column, listed: Column) -> Column:
    """Why a profile is refused whatever its status; null if it is not."""
    return (
        F.when(F.coalesce((name == "") | (name != F.trim(name)), F.lit(True)), "name")
        .when(looks_secret(name), "name_is_secret")
        .when(expected.isNotNull() & (name != expected), "another_provider")
        .when(~F.coalesce(method.isin(*METHODS), F.lit(False)), "method")
        .when(~authorized.eqNullSafe(F.lit(False)), "generation_authorized")
        .when(~is_secret_reference(reference), "secret_reference")
        .when(F.size(F.array_except(F.array(*[F.lit(c) for c in CAPABILITIES]), listed)) > 0, "capabilities")
    )


def aged(status: Column, verified_at: Column, now: Column, days: int = MAX_AGE_DAYS) -> Column:
    """Status after time has passed: a validated profile goes stale."""
    return F.when((status == "validated") & (freshness(verified_at, now, days) == "stale"), "stale").otherwise(status)


def configured(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """New profiles, pending validation; refused where the provider's name, method or reference is."""
    met = requests.join(existing.select("profile_id", F.col("provider_name").alias("_known")), "profile_id", "left")
    name, method = F.col("provider_name"), F.upper("connection_method")
    refused = (
        F.when(F.coalesce((name == "") | (name != F.trim(name)) | (F.length(name) > 160) | name.rlike(r"[\x00-\x1f]"), F.lit(True)), "name")
        .when(looks_secret(name), "name_is_secret")
        .when(~F.coalesce(method.isin(*METHODS), F.lit(False)), "method")
        .when(~is_secret_reference(F.col("secret_reference")), "secret_reference")
        .when(F.col("_known").isNotNull() & (F.col("_known") != "") & (F.col("_known") != name), "another_provider")
    )
    return met.withColumns({"connection_method": method, "problem": refused, "status": F.when(refused.isNull(), "pending_validation"), "generation_authorized": F.lit(False)}).drop("_known")


def with_evidence(profiles: DataFrame, evidence: DataFrame) -> DataFrame:
    """Profiles met with the evidence for their provider and method."""
    return profiles.join(evidence, ["provider_name", "connection_method"])
