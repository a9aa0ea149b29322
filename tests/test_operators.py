import itertools
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propflow.operators import analysis, assets, clips, gates, media, planning, profiles, quality, rendering, resume, state, validation
from propflow.streaming import clip_events


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 255).map(lambda x: x * 0x0101010101010101) | st.integers(0, 2**64 - 1), min_size=2, max_size=25), st.integers(0, 12), st.randoms(use_true_random=False))
def test_near_pairs_lose_nothing(spark, values, distance, rnd):
    values = values + [v ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) & (2**64 - 1) for v in values]
    rows = [(f"{i:03d}", f"{v & (2**64 - 1):016x}") for i, v in enumerate(values)]
    got = assets.near_pairs(spark.createDataFrame(rows, "asset_id string, dhash string"), 64, distance).collect()
    want = {(a, b): bin(int(x, 16) ^ int(y, 16)).count("1") for (a, x), (b, y) in itertools.combinations(rows, 2)}
    assert {(r.left_asset_id, r.right_asset_id): r.distance for r in got} == {k: d for k, d in want.items() if d <= distance}
    assert len(got) == len({(r.left_asset_id, r.right_asset_id) for r in got})


@pytest.mark.parametrize(("cost", "bits", "distance"), [(1e9, 64, 6), (0.0, 64, 6), (0.0, 100, 30), (1e9, 49, 12)])
def test_near_hashes_by_bands_and_in_blocks(spark, monkeypatch, cost, bits, distance):
    """Both ways give all pairs, and neither leaves the work to one task, however few bytes the hashes are."""
    monkeypatch.setattr(assets, "PAIR_COST", cost, raising=False)
    rnd = random.Random(7)
    values = [rnd.getrandbits(bits) for _ in range(150)]
    values += [v ^ sum(1 << k for k in rnd.sample(range(bits), rnd.randrange(distance + 3))) for v in values] + values[:20]
    texts = [f"{v:0{-(-bits // 4)}x}" for v in values]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "dhash string")
    got = assets.near_hashes(frame, bits, distance)
    want = {(a, b): bin(int(a, 16) ^ int(b, 16)).count("1") for a, b in itertools.combinations(sorted(set(texts)), 2)}
    rows = got.collect()
    assert {(r.a, r.b): r.distance for r in rows} == {k: d for k, d in want.items() if d <= distance}
    assert len(rows) == len({(r.a, r.b) for r in rows})
    # neither planner nor table size may put the tasks together
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_upsert_again_changes_nothing(spark):
    rows = [("h1", 1, ("photo", "a.jpg"), False, "00"), ("h1", 2, ("photo", "b.jpg"), True, "00"), ("h2", 3, ("photo", "c.jpg"), False, "01"), ("h2", 4, ("photo", "c.jpg"), False, "02")]
    found = spark.createDataFrame(rows, "sha256 string, position int, source struct<kind:string,path:string>, preferred boolean, dhash string")
    batch = assets.exact_assets(found)
    got = {r.sha256: (r.first.position, r.exact_duplicate_count, r.preferred, r.conflict) for r in batch.collect()}
    assert got == {"h1": (1, 1, True, False), "h2": (3, 0, False, True)}
    again = assets.upsert(batch, batch)
    assert sorted(map(str, again.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert {r.sha256 for r in assets.replace_by_key(batch, batch.where("sha256 = 'h1'"), "sha256").collect()} == {"h1", "h2"}


def test_grid_and_layout(spark):
    wide, high = assets.grid(F.col("id"))
    got = {r.id: (r.w, r.h) for r in spark.range(1, 12).select("id", wide.alias("w"), high.alias("h")).collect()}
    assert got[1] == (1, 1) and got[5] == (3, 2) and got[9] == (3, 3) and got[10] == (4, 3)
    assert assets.xstack_layout(3) == "0_0|320_0|0_240"
    w, h = assets.fitted_size(F.lit(4000), F.lit(1000))
    assert tuple(spark.range(1).select(w, h).first()) == (320, 80)


def test_sheets_do_not_depend_on_order(spark):
    rows = [("s", f"{i}") for i in range(7)]
    a, b = (assets.sheet_fingerprint(spark.createDataFrame(r, "sheet string, asset_id string").repartition(3), "sheet").collect() for r in (rows, rows[::-1]))
    assert a == b


def test_overlay_by_presence(spark):
    base = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "k string, v string, w string")
    middle = spark.createDataFrame([("a", None, True)], "k string, v string, has_v boolean")
    top = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = {r.k: (r.v, r.w) for r in planning.overlay([base, middle, top], "k", ["v", "w"]).collect()}
    assert got == {"a": (None, "x"), "b": ("2", "y"), "c": (None, None)}


def test_selection_and_moves(spark):
    def problem(*v):
        return spark.range(1).select(planning.selection_problem(*[F.lit(x).cast("string") for x in v])).first()[0]

    assert problem("photo", "kitchen", "selected", "h", "h") is None
    assert problem("painting", "kitchen", "selected", "h", "h") == "asset_kind" and problem("photo", "cellar", "selected", "h", "h") == "room_type"
    assert problem("photo", "kitchen", "reserve", "h", "h") == "curation_status" and problem("map", "kitchen", "selected", "h", "h") == "not_a_photo"
    assert problem("photo", "kitchen", "selected", "h", None) == "no_file" and problem("photo", "kitchen", "selected", "h", "g") == "hash" and problem("photo", "kitchen", "selected", None, "g") is None

    def move(*v):
        return spark.range(1).select(planning.camera_move(*[F.lit(x).cast("string") for x in v])).first()[0]

    assert move("static_hold", "low", "kitchen") == "static_hold" and move("fly", "low", "kitchen") is None and move(None, "HIGH", "garden") == "static_hold"
    assert move(None, None, "garden") == "gentle_pan_right" and move(None, "low", "kitchen") == "slow_push_in"


def test_plan_keeps_ten_after_judging_all(spark):
    rows = [("p", f"{i:02d}", "kitchen" if i == 11 else f"room{i}", i == 0) for i in range(12)] + [("q", "x", "kitchen", False), ("q", "y", "kitchen", False)]
    frame = spark.createDataFrame(rows, "project string, image string, room string, angle boolean").repartition(4)
    key = planning.scene_order(F.lit(None).cast("int"), planning.room_rank(F.col("room")), F.col("image"))
    plan = planning.planned(frame, "project", key, F.col("room"), F.col("angle")).collect()
    mine = sorted((r.sequence_index, r.image) for r in plan if r.project == "p")
    assert len(mine) == 10 and mine[0] == (0, "11") and [i for i, _ in mine] == list(range(10))
    assert {r.project: r.unexplained_angle for r in plan} == {"p": False, "q": True} and {r.n_selected for r in plan if r.project == "p"} == {12}


def test_scene_ids_and_tombstones(spark):
    scenes = spark.createDataFrame([("p", "i1", "s1", 0), ("p", "i2", "s2", 1), ("p", "i3", "s3", 2)], "project string, image string, scene_id string, sequence_index int")
    plan = spark.createDataFrame([("p", "i3"), ("p", "i1"), ("p", "i4")], "project string, image string")
    old = spark.createDataFrame([("p", "i4", "s9")], "project string, image string, scene_id string")
    got = {r.image: (r.scene_id, r.reused) for r in planning.scene_ids(plan, scenes, old, "project", "image").collect()}
    assert got["i1"] == ("s1", True) and got["i3"] == ("s3", True) and not got["i4"][1] and got["i4"][0].startswith("scn_") and len(got["i4"][0]) == 24
    other = {r.image: r.scene_id for r in planning.scene_ids(plan, scenes, old.limit(0), "project", "image").collect()}
    assert other["i4"] != got["i4"][0]  # a removed scene's identifier never comes back
    assert [r.scene_id for r in planning.new_tombstones(scenes, plan, old, "project", "image").collect()] == ["s2"]
    left, gone = planning.tombstone(scenes, spark.createDataFrame([("p", "s2", "r")], "project string, scene_id string, reason string"), "project")
    assert {r.scene_id: r.sequence_index for r in left.collect()} == {"s1": 0, "s3": 1} and gone.first().last_sequence_index == 1
    added = planning.add_scene(scenes, spark.createDataFrame([("p", "i5", "s5", 1), ("p", "i6", "s6", None)], scenes.schema), "project")
    assert [r.scene_id for r in added.orderBy("sequence_index").collect()] == ["s1", "s5", "s2", "s3", "s6"]
    assert planning.reused_tombstones(scenes, scenes.where("scene_id = 's1'"), "project").count() == 1
    assert planning.repeated(scenes.union(scenes.limit(1)), "project", "image").count() == 1


def test_reordering_undoes_no_clip(spark):
    a = spark.createDataFrame([("p", "s1", 0, "x"), ("p", "s2", 1, "y")], "project string, scene_id string, sequence_index int, sig string")
    b = spark.createDataFrame([("p", "s2", 0, "y"), ("p", "s1", 1, "x")], a.schema)
    changed = planning.changed_scenes(a, b, "project", "sig")
    assert changed.count() == 0 and planning.render_undone(a, b, changed, "project").count() == 1


def test_clip_revisions(spark):
    old = spark.createDataFrame([("s", "h1", 1), ("s", "h2", 2)], "scene string, sha256 string, revision int")
    new = spark.createDataFrame([("s", "h1", 1), ("s", "h3", 2), ("s", "h3", 3), ("s", "h4", 4), ("t", "h1", 5)], "scene string, sha256 string, n int").repartition(3)
    got = {r.n: (r.revision, r.replayed) for r in clips.revisions(old, new, ["scene"], ["n"]).collect()}
    assert got == {1: (1, True), 2: (3, False), 3: (3, True), 4: (4, False), 5: (1, False)}


@pytest.mark.parametrize("values,want", [
    ((1, 5.0, 5.0, 1920, 1080, "16:9", "1:1"), ([], "passed")), ((1, 5.75, 5.0, 1920, 1080, "16:9", None), ([], "passed")), ((1, 5.76, 5.0, 1920, 1080, "16:9", None), (["duration_mismatch"], "needs-manual-review")),
    ((1, 1.59, 1.0, 1920, 1080, "16:9", None), ([], "passed")), ((2, 5.0, 5.0, 1080, 1920, "4:3", "N/A"), (["video_stream_count"], "failed")), ((1, None, 5.0, 1080, 1080, "16:9", "4:3"), (["aspect_ratio_mismatch", "duration_missing", "non_square_pixels", "sample_frames_unavailable"], "failed")),
    ((1, 5.0, 5.0, 0, 5, "16:9", None), (["resolution_missing"], "failed")),
])
def test_technical_issues(spark, values, want):
    kinds = ("int", "double", "double", "int", "int", "string", "string")
    issues = clips.technical_issues(*[F.lit(v).cast(k) for v, k in zip(values, kinds)])
    assert tuple(spark.range(1).select(issues, clips.technical_status(issues)).first()) == want


def test_probe_summary(spark):
    from propflow.sources.images import probe_clip

    text = '{"streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": 4, "height": 3, "avg_frame_rate": "30000/1001", "duration": "2.5"}], "format": {"duration": "inf", "format_name": "mov"}}'
    row = spark.range(1).select(probe_clip(F.lit(text)).alias("p")).select(*[c.alias(k) for k, c in clips.probe_summary(F.col("p")).items()]).first()
    assert (row.duration_seconds, row.video_stream_count, row.audio_stream_count, row.width) == (2.5, 1, 1, 4) and row.average_fps == pytest.approx(29.97, abs=0.001)
    assert spark.range(1).select(rendering.output_problem(probe_clip(F.lit(text)), "16x9")).first()[0] == "codec"


def fold(events):
    """The rules of review, one event at a time."""
    s = {"status": None, "clip": None, "candidate_status": None, "n_changes": 0, "n_revoked": 0}
    for clip, status in events:
        held = s["clip"] if s["status"] == "approved" else None
        if status == "approved":
            s = {"status": "approved", "clip": clip, "candidate_status": None, "n_changes": s["n_changes"] + (held != clip), "n_revoked": s["n_revoked"]}
        elif held is not None and held != clip:
            s = {**s, "candidate_status": status}
        else:
            s = {"status": status, "clip": None, "candidate_status": None, "n_changes": s["n_changes"], "n_revoked": s["n_revoked"] + (held == clip)}
    return s


def test_review_fold(spark):
    """Short histories, and one scene with most of all reviews, which lie in every block."""
    rnd = random.Random(4)
    review = lambda approved: (rnd.choice("abc"), rnd.choices(["approved", "rejected", "needs-manual-review"], (approved, 1, 1))[0])
    runs = {f"s{i}": [review(1) for _ in range(rnd.randrange(1, 9))] for i in range(60)}
    # long stretches without an approval lie between the hot scene's
    runs["s30x"] = [review(0.02) for _ in range(900)]
    rows = [(k, n, c, 1, "h", s, True) for k, run in runs.items() for n, (c, s) in enumerate(run)]
    frame = spark.createDataFrame(rows, "scene string, n int, clip_id string, revision int, sha256 string, status string, compared boolean").orderBy(F.rand(1))
    got = {r.scene: r for r in quality.selections(frame, ["scene"], "n").collect()}
    assert set(got) == set(runs)
    for scene, run in runs.items():
        want = fold(run)
        assert {k: got[scene][k] for k in want} == want
    assert quality.selections(frame.limit(0), ["scene"], "n").count() == 0


@pytest.mark.parametrize("size", [20_000, 50])
def test_review_fold_of_sampled_ranges(spark, monkeypatch, size):
    """More reviews than are looked at to deal ranges evenly; scenes lie in one block, or in many."""
    monkeypatch.setattr(quality, "BLOCK_REVIEWS", size, raising=False)
    rnd = random.Random(5)
    runs = {f"s{i}" if i else None: [(rnd.choice("abc"), rnd.choices(["approved", "rejected", "needs-manual-review"], (0.3, 1, 1))[0]) for _ in range(400)] for i in range(60)}
    rows = [(k, n, c, 1, "h", s, True) for k, run in runs.items() for n, (c, s) in enumerate(run)]
    frame = spark.createDataFrame(rows, "scene string, n int, clip_id string, revision int, sha256 string, status string, compared boolean").repartition(4)
    got = {r.scene: r for r in quality.selections(frame, ["scene"], "n").collect()}
    assert set(got) == set(runs)
    for scene, run in runs.items():
        want = fold(run)
        assert {k: got[scene][k] for k in want} == want


def test_issues_are_trimmed(spark):
    found = F.array(*[F.lit(x) for x in (" morphing\t", "morphing", "0noise", " ", "\u00a0a")])
    assert spark.range(1).select(quality.clean_issues(found)).first()[0] == ["0noise", "a", "morphing"]


def test_approvals(spark):
    def problem(status, technical, issues, actual="h", compared=True, evidence="seen"):
        c = quality.approval_problem(F.lit(status), F.lit(technical), F.array(*[F.lit(x) for x in issues]).cast("array<string>"), F.lit("h"), F.lit(actual).cast("string"), F.lit(compared), F.lit(evidence))
        return spark.range(1).select(c).first()[0]

    assert problem("approved", "passed", ["noise"]) is None and problem("approved", "failed", []) == "technical_failure" and problem("approved", "passed", ["morphing"]) == "critical_issue"
    assert problem("approved", "passed", [], actual=None) == "file_changed" and problem("rejected", "failed", ["morphing"], actual="x") is None and problem("rejected", "passed", [], evidence=" ") == "evidence_needed"


def test_gates(spark):
    row = spark.range(1).select(*[v.alias(k) for k, v in gates.rights_and_privacy(F.lit(None).cast("boolean"), F.lit(True), F.lit(None).cast("boolean")).items()]).first()
    assert (row.rights_status, row.pii_status, row.contains_pii) == ("unconfirmed", "clear", False)

    def cost(status, amount, budget):
        return spark.range(1).select(gates.cost_problem(F.lit(status), F.lit(amount).cast("double"), F.lit(budget).cast("double"))).first()[0]

    assert cost("known", 5.0, 5.0) is None and cost("known", 5.1, 5.0) == "over_budget" and cost("known", None, None) == "amount_needed" and cost("unknown", 1.0, None) == "amount_of_unknown_cost"
    assert cost("known", float("nan"), None) == "amount" and cost("known", 1.0, float("inf")) == "budget" and cost("cheap", None, None) == "status"
    fp = "f" * 64
    reasons = gates.consent_reasons(*[F.lit(x) for x in (fp, fp, gates.CONSENT_QUESTION, True, "s", "s", "s")])
    out = gates.verdict(reasons, F.array().cast("array<string>"))
    assert spark.range(1).select(out["allowed"]).first()[0] is True
    closed = gates.verdict(gates.consent_reasons(*[F.lit(None).cast("string")] * 3, F.lit(None).cast("boolean"), *[F.lit(None).cast("string")] * 3), F.lit(None).cast("array<string>"))
    assert spark.range(1).select(closed["allowed"], closed["reasons"]).first()[1] == ["no_fingerprint", "consent_question", "not_approved", "no_session", "no_entries"]
    jobs = spark.createDataFrame([("s1", "b", "queued"), ("s2", "b", "failed")], "scene_id string, batch_fingerprint string, status string")
    intents = spark.createDataFrame([("s1", "b"), ("s2", "b"), ("s1", "c")], "scene_id string, batch_fingerprint string")
    assert sorted(map(tuple, gates.submittable(intents, jobs).collect())) == [("s1", "c"), ("s2", "b")]
    entries = spark.createDataFrame([("b", 1, "s", True, True, True, False, "u", "o"), ("b", 0, "t", None, False, None, None, "o", "o")], "b string, sequence_index int, scene_id string, original_substitution_forbidden boolean, rights_confirmed boolean, pii_reviewed boolean, contains_pii boolean, upload_derivative_path string, original_path string")
    assert gates.entry_reasons(entries, ["b"]).first().entry_reasons == ["original_not_barred", "rights:t", "pii:t", "original_as_upload"]


def test_profiles(spark):
    now = F.lit(datetime(2024, 1, 10))

    def fresh(ts):
        return spark.range(1).select(profiles.freshness(F.lit(ts).cast("timestamp"), now)).first()[0]

    assert [fresh(x) for x in ("2024-01-03 00:00:00", "2024-01-02 23:59:59", "2024-01-10 00:05:00", "2024-01-10 00:05:01", None)] == ["fresh", "stale", "fresh", "future", "unverified"]

    def semantics(status, **over):
        v = {"name": "X", "method": "MCP", "reference": "env:K", "verified_at": "2024-01-01T00:00:00Z", "authorized": False, "sources": ["u"], "errors": ["e"], "ratios": ["16:9"], "durations": ["5"], "cap": "true"} | over
        arrays = {k: F.array(*[F.lit(x) for x in v[k]]).cast("array<string>") for k in ("sources", "errors", "ratios", "durations")}
        cap = {c: F.lit(v["cap"]) for c in profiles.VERIFIED}
        c = profiles.semantics_problem(F.lit(status), F.lit(v["name"]), F.lit(v["method"]), F.lit(v["reference"]), F.lit(v["verified_at"]), F.lit(v["authorized"]), arrays["sources"], arrays["errors"], cap, arrays["ratios"], arrays["durations"])
        return spark.range(1).select(c).first()[0]

    assert semantics("validated") is None and semantics("validated", cap="unverified") == "capabilities" and semantics("validated", sources=[]) == "official_sources" and semantics("stale", errors=[]) == "verification_errors"
    assert semantics("validated", authorized=True) == "generation_authorized" and semantics("pending_validation", reference="K") == "secret_reference" and semantics("not_configured") == "not_configured"
    assert semantics("not_configured", name="", method="", reference="", verified_at="") is None and semantics("validated", verified_at="2024-01-01") == "verified_at"
    asked = spark.createDataFrame([("p", "New", "api", "env:K"), ("q", "Old", "mcp", "env:K"), ("r", "sk-1", "mcp", "env:K")], "profile_id string, provider_name string, connection_method string, secret_reference string")
    known = spark.createDataFrame([("q", "Other")], "profile_id string, provider_name string")
    assert {r.profile_id: (r.status, r.problem) for r in profiles.configured(asked, known).collect()} == {"p": ("pending_validation", None), "q": (None, "another_provider"), "r": (None, "name_is_secret")}


def test_approvals_compare_any_digest(spark):
    """Digests are packed on their way: unlike strings never meet, and the kept one comes out as it was; rows carry two of them at most."""
    hexes = "41" * 32
    odd = ["", "a", hexes, hexes[:-1], hexes.upper().replace("41", "4A"), "A" * 32, "\u0001" + "A" * 32, "A" * 31, "\u00e9" * 16, None]
    pairs = [(i * len(odd) + j, a, b) for i, a in enumerate(odd) for j, b in enumerate(odd)]
    rows = spark.createDataFrame(pairs, "id long, a string, b string").withColumn("p", F.lit(1))
    scenes = rows.select("p", F.col("id").alias("scene_id"), F.lit("d").alias("dependency_hash"))
    chosen = rows.select("p", F.col("id").alias("scene_id"), F.lit("approved").alias("status"), F.lit(True).alias("compared"), F.col("id").alias("selected_clip_id"), F.col("a").alias("selected_sha256"))
    path = F.col("id").cast("string").alias("path")
    clips = rows.select("p", F.col("id").alias("clip_id"), path, F.lit(None).cast("string").alias("approved_copy_path"), F.col("a").alias("sha256"), F.lit("d").alias("input_dependency_hash"), F.lit(True).alias("input_dependency_valid"))
    files = rows.select("p", path, F.col("b").alias("sha256"))
    frame = resume.approvals(scenes, chosen, clips, files, "p")
    got = {r.scene_id: (r.reason, r.preserved_sha256) for r in frame.collect()}
    assert got == {i: ("no_clip", None) if a is None else ("no_file", None) if b is None else (None, b) if a == b else ("file_changed", None) for i, a, b in pairs}
    bad = {int(r.path): r.problem for r in resume.file_problems(clips.select("p", "path", "sha256"), files, ["p", "path"]).collect()}
    assert bad == {i: "missing" if b is None else "changed" for i, a, b in pairs if b is None or (a is not None and a != b)}

    def inputs(plan):
        kids = [plan.children().apply(k) for k in range(plan.children().size())]
        for kid in kids:
            if "Join" in plan.nodeName():
                yield [(o.name(), o.dataType().simpleString()) for o in (kid.output().apply(k) for k in range(kid.output().size()))]
            yield from inputs(kid)

    seen = list(inputs(frame._jdf.queryExecution().optimizedPlan()))
    assert seen and not any(t == "string" and n not in ("path", "_early", "_late") for row in seen for n, t in row)
    assert max(sum(t == "binary" for _, t in row) for row in seen) <= 2


def test_resume_columns(spark):
    def stage(*v):
        first = resume.first_stage(*[F.lit(x) for x in v])
        return tuple(spark.range(1).select(first, F.size(resume.preserved_stages(first))).first())

    assert stage(0, 5, True, True, 5, 5, True) == ("curation", 0) and stage(1, 0, True, True, 0, 0, True) == ("scene_planning", 1) and stage(1, 2, True, True, 1, 1, True) == ("clip_import", 4)
    assert stage(1, 2, True, True, 2, 1, True) == ("quality_control", 6) and stage(1, 2, True, True, 2, 2, None) == ("rendering", 6) and stage(1, 2, True, True, 2, 2, True) == ("complete", 7)
    act = lambda s, j: spark.range(1).select(resume.job_action(F.lit(s).cast("string"), F.lit(j).cast("string"))).first()[0]
    assert (act("submitted", "j"), act("submitted", None), act("submission_pending", None), act("failed", "j"), act("completed", "j"), act(None, None)) == (
        "poll_existing", "manual_review", "reconcile_manually", "retry_requires_new_consent", "import_result_if_available", "manual_review")


def test_render_memo(spark):
    wanted = spark.createDataFrame([("p", "16x9", "d"), ("q", "16x9", "d"), ("r", "16x9", "d")], "project string, target string, dependency_hash string")
    done = spark.createDataFrame([("p", "16x9", "o", "h", "d"), ("q", "16x9", "o", "h", "old")], "project string, target string, path string, sha256 string, dependency_hash string")
    files = spark.createDataFrame([("p", "o", "h"), ("q", "o", "h")], "project string, path string, sha256 string")
    assert {r.project: r.reuse for r in rendering.memoised(wanted, done, files, "project").collect()} == {"p": True, "q": False, "r": False}
    assert spark.range(1).select(rendering.concat_line(F.lit("a/b.mp4"))).first()[0] is None


def test_schemas(spark):
    good = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["string", "null"], "pattern": "^x"}, "n": {"type": "integer", "minimum": 1}, "l": {"type": "array", "maxItems": 2, "items": {"enum": [1, "1"]}}}, "additionalProperties": False}
    validation.check_schema(good)
    for bad in ({"typ": "object"}, {"type": "text"}, {"type": []}, {"required": ["a"], "properties": {}}, {"minItems": 2, "maxItems": 1}, {"enum": [1, 1.0]}, {"pattern": "("}, {"minimum": True}, {"items": {"x": 1}}, {"minLength": -1}):
        with pytest.raises(validation.SchemaError):
            validation.check_schema(bad)
    cases = {
        '{"a": "x"}': None, '{"a": null}': None, "{}": "$: required 'a'", '{"a": "y"}': "$['a']: pattern", '{"a": 1}': "$['a']: type", '{"a": "x", "n": true}': "$['n']: type", '{"a": "x", "n": 0}': "$['n']: minimum",
        '{"a": "x", "b": 1}': "$: additionalProperties 'b'", '{"a": "x", "l": [1, "1"]}': None, '{"a": "x", "l": [1, 1, 1]}': "$['l']: maxItems", '{"a": "x", "l": [true]}': "$['l'][0]: enum", '{"a": 1, "a": 2}': "$: not a document", "[": "$: not a document", "5": "$: type",
    }
    frame = spark.createDataFrame([(c,) for c in cases], "d string")
    assert {r.d: r.fault for r in validation.validate(frame, "d", good).collect()} == cases


def test_project_rules(spark):
    def fault(**over):
        v = {"version": "1.0", "project_id": "dom", "revision": 1, "created": "2024-01-01T00:00:00Z", "updated": "2024-01-02T00:00:00Z", "url": "https://WWW.site.pl/a", "domain": "www.site.pl"} | over
        return spark.range(1).select(validation.project_fault(*[F.lit(v[k]).cast("int" if k == "revision" else "string") for k in v])).first()[0]

    assert fault() is None and fault(url=None, domain=None) is None and fault(domain="site.pl") == "domain" and fault(updated="2023-01-01T00:00:00Z") == "updated_before_created"
    assert fault(version="1") == "schema_version" and fault(project_id="Dom") == "project_id" and fault(revision=0) == "manifest_revision" and fault(created="x") == "created_at" and fault(url="http://localhost/") == "url"


def test_store_never_loses_a_write(spark, tmp_path):
    store = state.Store(spark, str(tmp_path))
    assert store.write("dom", {"name": "Dom", "output": {"a": 1}}, 0) == 1
    with pytest.raises(state.StaleRevision):
        store.write("dom", {}, 0)
    assert store.patch("dom", {"output": {"b": [1]}}, expected=1) == 2
    assert store.read("dom")["output"] == {"a": 1, "b": [1]} and store.read("dom", 1)["output"] == {"a": 1}
    with pytest.raises(ValueError):
        store.patch("dom", {"project_id": "x"})
    with pytest.raises(state.StaleRevision):
        store.mutate("dom", lambda d: d, expected=1)
    store.record_hash("dom", "provider/provider-profile.snapshot.json", "h")
    assert store.read("dom")["provider_profile"]["snapshot_sha256"] == "h"
    assert [(r.project_id, r.revision) for r in store.documents().collect()] == [("dom", 3)]


def test_merge(spark):
    assert state.deep_merge({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": [2]}, "d": None}) == {"a": {"b": 1, "c": [2]}, "d": None}
    row = spark.range(1).select(state.merge_maps(F.expr("map('a', '1', 'b', '2')"), F.expr("map('b', CAST(NULL AS STRING), 'c', '3')")).alias("m"), state.managed_fields(F.expr("map('project_id', 1, 'x', 2)")).alias("f")).first()
    assert row.m == {"a": "1", "b": None, "c": "3"} and row.f == ["project_id"]


def test_media_adapter(spark):
    plan = spark.createDataFrame([(1, ["true"]), (2, ["false"]), (3, ["no-such-tool"])], "id int, arguments array<string>")
    assert {r.id: (r.exit_code, r.problem) for r in media.run_plan(plan).collect()} == {1: (0, None), 2: (1, "failed"), 3: (None, "no_tool")}
    assert media.bounded(["sleep", "5"], 0.2)[2] == "timeout" and media.preflight(spark).count() == 2


def test_analysis(spark):
    found = spark.createDataFrame([("p", "i1", "h1"), ("p", "i2", "h2")], "project_id string, image_id string, sha256 string")
    seen = spark.createDataFrame([("p", "i1", "selected", 1), ("p", "i2", "selected", 0)], "project_id string, image_id string, curation_status string, ord int")
    got = {r.image_id: (r.selected_ord, r.contains_pii) for r in analysis.apply_analysis(found, seen, True, True, ("i2",)).collect()}
    assert got == {"i1": (1, False), "i2": (0, True)}
    files = spark.createDataFrame([("a", "h1"), ("b", "x")], "path string, sha256 string")
    rows = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "relative_path string, sha256 string")
    assert {r.relative_path: r.state for r in analysis.asset_map(rows, files).collect()} == {"a": "ok", "b": "changed", "c": "absent"}
    stages = spark.createDataFrame([("curation", "pending"), ("prompts", "complete"), ("listing", "complete")], "stage string, status string")
    assert dict(map(tuple, analysis.reset_stages(stages).collect())) == {"curation": "complete", "prompts": "pending", "listing": "complete"}


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    events.union(events).write.parquet(str(tmp_path / "in"))
    stream = clip_events.without_replays(clip_events.event_stream(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " ")), ["event_id"], late="40 days")
    query = stream.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == events.select("event_id").distinct().count()
    counted = clip_events.counts(clip_events.event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string"), "event_type", width="1 day")
    query = counted.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("daily").agg(F.sum("n")).first()[0] == 2 * events.count()
    visits = clip_events.sessions(clip_events.event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string"), "user_id")
    query = visits.writeStream.format("memory").queryName("visits").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("visits").agg(F.sum("n")).first()[0] == 2 * events.count()
