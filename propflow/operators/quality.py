"""Manual quality control: which revision of a scene counts."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Issues that no approval may pass over.
CRITICAL = (
    "bent_walls", "decode_error", "disappearing_objects", "distorted_windows", "duplicates",
    "geometry_drift", "impossible_reveal", "morphing", "new_geometry", "scene_replacement",
)


def clean_issues(issues: Column) -> Column:
    """Trimmed, distinct, sorted issues without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(issues, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")))


def critical_issues(issues: Column) -> Column:
    return F.array_sort(F.array_intersect(issues, F.array(*[F.lit(x) for x in CRITICAL])))


def lacks_evidence(compared: Column, evidence: Column) -> Column:
    return F.coalesce(compared, F.lit(False)) & F.coalesce(F.trim(evidence) == "", F.lit(True))


def refusal(status: Column, technical: Column, critical: Column, sha256: Column, actual: Column, lacking: Column) -> Column:
    """Why a review is refused, from what was judged of its issues and evidence."""
    approves = status == "approved"
    return (
        F.when(lacking, "evidence_needed")
        .when(approves & (technical == "failed"), "technical_failure")
        .when(approves & critical, "critical_issue")
        .when(approves & ~sha256.eqNullSafe(actual), "file_changed")
    )


def approval_problem(status: Column, technical: Column, issues: Column, sha256: Column, actual: Column, compared: Column, evidence: Column) -> Column:
    """Why a review is refused; null if it is recorded."""
    return refusal(status, technical, F.size(critical_issues(issues)) > 0, sha256, actual, lacks_evidence(compared, evidence))


#: Reviews of a scene in a block, on average.
BLOCK_REVIEWS = 20_000


def _dealt(events: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """``events`` with ``_block``: ranges of a scene's events in order, of about ``size`` each.

    Ranges begin at events that a hash of their order picks, so the block of an
    event is a function of the table: it is the same in whatever part of a plan,
    and however often, it is computed.
    """
    first = events.where(F.pmod(F.xxhash64(order), F.lit(size)) == 0).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.array_sort(F.collect_set(order)).alias("_firsts"))
    met = events.join(first, functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left")
    # how many of the sorted firsts are at or below the event's order, by halving
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(24))])
    at = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.coalesce(F.try_element_at("_firsts", n + step) <= F.col(order), F.lit(False)), n + step).otherwise(n))
    return met.withColumn("_block", F.when(F.col("_firsts").isNull(), 0).otherwise(at)).drop("_firsts", *[f"_{k}" for k in keys])


def selections(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The state of each scene after its reviews, in order.

    ``events`` has keys, order (distinct for a scene), clip_id, revision, sha256,
    status and compared.  An approval selects its clip.  Another status revokes
    the selection only if it is about the selected clip; about another clip, it is
    noted as the candidate beside the selection.

    A review is a small map of states, and runs of reviews compose.  An approval
    settles what is selected whatever was before, so what a block of reviews does
    is told by its approvals, and what it does to a selection made before it by
    the first review of that selection's clip.  Reviews are dealt into blocks by
    range of order within a scene; each block finds the approval before each review, blocks hand
    on their last approvals, and the runs that approvals begin are aggregated.  So
    a scene of very many reviews is spread over many tasks, and no array holds
    them.
    """
    review = F.struct(F.col(order).alias("at"), "clip_id", F.col("revision").cast("int").alias("revision"), "sha256", "status", F.coalesce("compared", F.lit(False)).alias("compared"))
    dealt = _dealt(events, keys, order, BLOCK_REVIEWS).select(*keys, review.alias("e"), "_block")
    approves = F.col("e.status").eqNullSafe(F.lit("approved"))
    approval = F.when(approves, F.col("e"))
    here = Window.partitionBy(*keys, "_block").orderBy("e.at")
    inner = dealt.withColumns(
        {
            "_run": F.last(approval, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_former": F.last(approval, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    # a row for each block that a scene lies in: what it hands on
    blocks = dealt.groupBy(*keys, "_block").agg(F.max_by("e", F.when(approves, F.col("e.at"))).alias("_last"))
    handed = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_of"), handed.alias("_handed")).where("_handed IS NOT NULL")
    same = F.col("_block") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    runs = inner.join(carried, same, "left").select(*keys, "e", F.coalesce("_run", "_handed").alias("run"), F.coalesce("_former", "_handed").alias("former"))
    # a run: an approval and the reviews up to the next one; the reviews before any have a run of their own
    revokes = ~approves & (F.col("e.clip_id") == F.col("run.clip_id"))
    found = runs.groupBy(*keys, "run").agg(
        F.max_by("e", "e.at").alias("last"),
        F.bool_or(F.coalesce(revokes, F.lit(False))).alias("revoked"),
        F.max_by("former", F.when(approves, F.col("e.at"))).alias("former"),
    )
    # a run changes the selection unless the one before held the same clip to its end
    held = found.where(F.col("run").isNotNull() & ~F.col("revoked")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("run.at").alias("_at"), F.col("run.clip_id").alias("_clip"))
    same = (F.col("former.at") == F.col("_at")) & (F.col("run.clip_id") == F.col("_clip"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    judged = found.join(held, same, "left").select(*keys, "run", "last", "revoked", (F.col("run").isNotNull() & F.col("_at").isNull()).cast("int").alias("changes"))
    final = judged.groupBy(*keys).agg(F.max_by(F.struct("run", "last", "revoked"), F.col("last.at")).alias("f"), F.sum("changes").cast("int").alias("n_changes"), F.count_if("revoked").cast("int").alias("n_revoked"))
    selected = F.col("f.run").isNotNull() & ~F.col("f.revoked")
    noted = ~selected | (F.col("f.last.at") != F.col("f.run.at"))
    kept = [F.when(selected, F.col(f"f.run.{c}")).alias(a) for c, a in (("clip_id", "clip"), ("revision", "revision"), ("sha256", "sha256"), ("compared", "compared"))]
    beside = [F.when(selected & noted, F.col("f.last.status")).alias("candidate_status"), F.when(noted, F.col("f.last.clip_id")).alias("candidate_clip"), F.when(noted, F.col("f.last.revision")).alias("candidate_revision")]
    return final.select(*keys, F.when(selected, "approved").otherwise(F.col("f.last.status")).alias("status"), *kept, *beside, "n_changes", "n_revoked")


def stage_complete(scenes: DataFrame, selected: DataFrame, project: str) -> DataFrame:
    """By project: complete if every scene is approved after comparison, and there is one."""
    good = selected.where("status = 'approved' AND compared").select(project, "scene_id").distinct().withColumn("_good", F.lit(True))
    met = scenes.select(project, "scene_id").join(good, [project, "scene_id"], "left")
    return met.groupBy(project).agg(
        F.count(F.lit(1)).alias("n_scenes"),
        F.count_if("_good").alias("n_approved"),
        F.when(F.bool_and(F.coalesce("_good", F.lit(False))), "complete").otherwise("pending").alias("stage"),
    )
