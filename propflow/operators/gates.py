"""Gates before anything leaves the house: rights, privacy, cost, consent.

Every gate is closed unless all its conditions are known to hold; a null never
opens one.  Reasons are collected in order, so that a caller sees all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propflow.functions.hashing import array_json, double_json, int_json, object_json, text_json

COST_STATES = ("known", "unknown", "unavailable")
#: Job states that forbid another submission.
BLOCKING = ("submission_pending", "submitted", "queued", "running", "completed")
#: The questions a consent must have been asked, word for word.
CONSENT_QUESTION = (
    "Czy wyrażasz zgodę na przesłanie wskazanych zdjęć do skonfigurowanego "
    "dostawcy i uruchomienie generowania zaplanowanych klipów walkthrough?"
)
COST_QUESTION = "Czy potwierdzasz również wskazany koszt generowania?"
UNKNOWN_COST = "Koszt generowania nie został zweryfikowany."


def strictly(value: Column) -> Column:
    """True for true alone."""
    return F.coalesce(value, F.lit(False))


def rights_and_privacy(rights: Column, reviewed: Column, contains: Column) -> dict[str, Column]:
    return {
        "rights_confirmed": strictly(rights),
        "rights_status": F.when(strictly(rights), "confirmed").otherwise("unconfirmed"),
        "pii_reviewed": strictly(reviewed),
        "contains_pii": strictly(contains),
        "pii_status": F.when(strictly(contains), "contains_pii").when(strictly(reviewed), "clear").otherwise("unreviewed"),
    }


def entries(scenes: DataFrame, classifications: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Scenes with their images' rights and privacy; an override's value, where it has one, wins."""
    flags = ["rights_confirmed", "pii_reviewed", "contains_pii"]
    base = classifications.select(*keys, *[F.col(f).alias(f"_c_{f}") for f in flags])
    over = overrides.select(*keys, *[F.col(f).alias(f"_o_{f}") for f in flags])
    met = scenes.join(base, keys, "left").join(over, keys, "left")
    judged = rights_and_privacy(*[F.coalesce(f"_o_{f}", f"_c_{f}") for f in flags])
    return met.withColumns(judged).drop(*[f"_{k}_{f}" for k in "co" for f in flags])


def good_number(value: Column) -> Column:
    return F.coalesce((value >= 0) & ~F.isnan(value) & (value != float("inf")), F.lit(False))


def cost_problem(status: Column, amount: Column, budget: Column) -> Column:
    """Why a cost statement is refused when a batch is prepared; null if it is not."""
    return (
        F.when(~F.coalesce(status.isin(*COST_STATES), F.lit(False)), "status")
        .when(amount.isNotNull() & ~good_number(amount), "amount")
        .when(budget.isNotNull() & ~good_number(budget), "budget")
        .when((status == "known") & amount.isNull(), "amount_needed")
        .when((status != "known") & amount.isNotNull(), "amount_of_unknown_cost")
        .when((status == "known") & (amount > budget), "over_budget")
    )


def batch_payload(entries: DataFrame, keys: list[str], head: dict[str, Column]) -> DataFrame:
    """Canonical JSON of a batch's scope: named head fields (JSON texts), and its entries in order.

    ``entries`` has keys, sequence_index, scene_id, original_sha256,
    upload_derivative_sha256, duration_seconds and aspect_ratio.
    """
    asset = object_json(
        {
            "scene_id": text_json(F.col("scene_id")),
            "original_sha256": text_json(F.col("original_sha256")),
            "upload_derivative_sha256": text_json(F.col("upload_derivative_sha256")),
            "duration_seconds": double_json(F.col("duration_seconds")),
            "aspect_ratio": text_json(F.col("aspect_ratio")),
        }
    )
    item = F.struct(F.coalesce("sequence_index", F.lit(0)).alias("o"), text_json(F.col("scene_id")).alias("s"), asset.alias("a"))
    listed = entries.groupBy(*keys, *[c.alias(f"_{k}") for k, c in head.items()]).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    fields = {k: F.col(f"_{k}") for k in head} | {
        "scene_ids": array_json(F.transform("_items", lambda x: x["s"])),
        "assets": array_json(F.transform("_items", lambda x: x["a"])),
        "job_count": int_json(F.size("_items")),
    }
    out = listed.select(*keys, F.size("_items").alias("job_count"), object_json(fields).alias("payload"))
    return out.withColumn("batch_fingerprint", F.sha2("payload", 256))


def same_list(a: Column, b: Column) -> Column:
    """Equality of lists in order; nulls equal nulls."""
    return a.eqNullSafe(b)


def submittable(intents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Intents (scene, batch) without a job that forbids another."""
    busy = jobs.where(F.col("status").isin(*BLOCKING)).select("scene_id", "batch_fingerprint")
    return intents.join(busy, ["scene_id", "batch_fingerprint"], "left_anti")


def consent_reasons(fp: Column, consent_fp: Column, question: Column, approved: Column, scope: Column, manifest_scope: Column, consent_scope: Column) -> list[Column]:
    no = F.lit(False)
    return [
        F.when(~F.coalesce(F.length(fp) == 64, no), "no_fingerprint"),
        F.when(~consent_fp.eqNullSafe(fp), "consent_for_another_batch"),
        F.when(~F.coalesce(question == CONSENT_QUESTION, no), "consent_question"),
        F.when(~strictly(approved), "not_approved"),
        F.when(scope.isNull(), "no_session").when(~manifest_scope.eqNullSafe(scope), "manifest_of_another_session"),
        F.when(scope.isNotNull() & ~consent_scope.eqNullSafe(scope), "consent_of_another_session"),
    ]


def cost_reasons(status: Column, amount: Column, budget: Column, question: Column, confirmed: Column, message: Column, risk: Column, retry: Column, retry_confirmed: Column) -> list[Column]:
    known = F.coalesce(status == "known", F.lit(False))
    paid = ~known | ~good_number(amount) | (amount > 0)
    open_cost = F.coalesce(status.isin("unknown", "unavailable"), F.lit(False))
    good_budget = budget.isNull() | good_number(budget)
    return [
        F.when(~F.coalesce(status.isin(*COST_STATES), F.lit(False)), "cost_status"),
        F.when(known & ~good_number(amount), "cost_amount"),
        F.when(~good_budget, "budget"),
        F.when(known & good_number(amount) & good_budget & (amount > budget), "over_budget"),
        F.when(paid & ~F.coalesce(question == COST_QUESTION, F.lit(False)), "cost_question"),
        F.when(paid & ~strictly(confirmed), "cost_not_confirmed"),
        F.when(open_cost & ~F.coalesce(message == UNKNOWN_COST, F.lit(False)), "unknown_cost_message"),
        F.when(open_cost & ~strictly(risk), "risk_not_confirmed"),
        F.when(strictly(retry) & paid & ~strictly(retry_confirmed), "retry_not_confirmed"),
    ]


def entry_reasons(entry: DataFrame, keys: list[str]) -> DataFrame:
    """All reasons against a batch's entries, by batch, in the order of entries."""
    reasons = F.array_compact(
        F.array(
            F.when(~strictly(F.col("original_substitution_forbidden")), "original_not_barred"),
            F.when(~strictly(F.col("rights_confirmed")), F.concat(F.lit("rights:"), "scene_id")),
            F.when(~strictly(F.col("pii_reviewed")) | strictly(F.col("contains_pii")), F.concat(F.lit("pii:"), "scene_id")),
            F.when(F.col("upload_derivative_path").eqNullSafe(F.col("original_path")), "original_as_upload"),
        )
    )
    item = F.struct(F.coalesce("sequence_index", F.lit(0)).alias("o"), F.col("scene_id").alias("s"), reasons.alias("r"))
    return entry.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"])).alias("entry_reasons"))


def verdict(reasons: list[Column], more: Column | None = None) -> dict[str, Column]:
    """All reasons in order, and whether there is none."""
    all_of = F.array_compact(F.array(*reasons))
    if more is not None:
        all_of = F.concat(all_of, F.coalesce(more, F.array(F.lit("no_entries"))))
    return {"reasons": all_of, "allowed": F.size(all_of) == 0}
