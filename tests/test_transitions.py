from pyspark.sql import functions as F
from test_sources import jpeg, png

from propflow.functions.hashing import session_scope
from propflow.operators import gates, media, transitions
from propflow.sources.images import FFPROBE

SESSION = "a session nonce of size"


def test_ingest(spark):
    rows = [("h1", 1, "a.png", png(), "00ff", ("file", "a.png"), False), ("h1", 2, "b.png", png(), "00ff", ("file", "b.png"), True), ("h2", 3, "c.jpg", jpeg(), "00fe", ("file", "c.jpg"), False), ("h3", 4, "d.png", jpeg(), "0000", ("file", "d.png"), False)]
    batch = spark.createDataFrame([(*r[:3], bytearray(r[3]), *r[4:]) for r in rows], "sha256 string, position int, relative_path string, content binary, dhash string, source struct<kind:string,path:string>, preferred boolean")
    empty = spark.createDataFrame([], "sha256 string, dhash string, format string, width int, height int, size_bytes int, sources array<struct<kind:string,path:string>>, preferred boolean, exact_duplicate_count int")
    got = transitions.ingest(empty, batch, 2, 16)
    assert {r.sha256: (r.format, r.exact_duplicate_count, r.preferred) for r in got["assets"].collect()} == {"h1": ("png", 1, True), "h2": ("jpeg", 0, False)}
    assert [tuple(r) for r in got["rejected"].collect()] == [("d.png", "suffix_and_magic")]
    assert [(r.left_asset_id, r.right_asset_id, r.distance) for r in got["near_duplicates"].collect()] == [("h1", "h2", 1)]


def selected(spark, images):
    rows = [("p", i, i, "kitchen", f"k{i}", None, False, None, "low", i) for i in images]
    return spark.createDataFrame(rows, "project_id string, image_id string, sha256 string, room_type string, room_instance_id string, sequence_index int, additional_angle_value boolean, camera_move string, deformation_risk string, actual_sha256 string")


def test_plans_clips_reviews_and_renders(spark):
    none = spark.createDataFrame([], "project_id string, image_id string, scene_id string, sequence_index int, dependency_hash string")
    gone = spark.createDataFrame([], "project_id string, image_id string, scene_id string")
    first = transitions.plan(selected(spark, ["i1", "i2"]), none, gone)
    scenes = first["scenes"].cache()
    assert first["changed"].count() == 2 and {r.sequence_index for r in scenes.collect()} == {0, 1}
    again = transitions.plan(selected(spark, ["i2", "i3"]), scenes, gone)
    kept = {r.image_id: r.scene_id for r in scenes.collect()}
    assert {r.image_id: r.reused for r in again["scenes"].collect()} == {"i2": True, "i3": False}
    assert {(r.scene_id == kept["i1"], r.change) for r in again["changed"].collect()} == {(True, "removed"), (False, "new")}
    assert [r.scene_id for r in again["tombstones"].collect()] == [kept["i1"]] and again["render_undone"].count() == 1

    probe = '{"streams":[{"codec_type":"video","width":1920,"height":1080}],"format":{"duration":"5.1"}}'
    files = spark.createDataFrame([("p", s, f"{s}.mp4", f"h{n}", 5, probe, n) for n, s in enumerate(sorted(kept.values()))] + [("p", kept["i1"], "x.exe", "hx", 5, probe, 8)], "project_id string, scene_id string, name string, sha256 string, size_bytes long, probe string, n int")
    files = files.withColumn("probe", F.from_json("probe", FFPROBE))
    empty = spark.createDataFrame([], "project_id string, scene_id string, clip_id string, revision int, path string, sha256 string, technical_status string, technical_issues array<string>, qc_status string, input_dependency_hash string, input_dependency_valid boolean")
    done = transitions.import_clips(empty, files, scenes, gone)
    assert [(r.name, r.reason) for r in done["refused"].collect()] == [("x.exe", "suffix")]
    clips = done["clips"].cache()
    assert {(r.technical_status, r.revision, r.input_dependency_valid) for r in clips.collect()} == {("passed", 1, True)} and clips.count() == 2
    assert transitions.import_clips(clips, files, scenes, gone)["clips"].count() == 2
    expected = spark.createDataFrame([("p", kept["i1"], "other.mp4")], "project_id string, scene_id string, expected_filename string")
    refused = transitions.import_clips(empty, files, scenes, scenes.where(F.col("scene_id") == kept["i2"]).select("project_id", "image_id", "scene_id"), expected)["refused"]
    assert {(r.scene_id, r.reason) for r in refused.collect()} == {(kept["i1"], "unexpected_name"), (kept["i1"], "suffix"), (kept["i2"], "scene_not_active")}

    there = clips.select("project_id", "path", "sha256")
    reviews = clips.select("project_id", "scene_id", "revision", F.lit("approved").alias("status"), F.array(F.lit(" ")).alias("issues"), F.lit(True).alias("compared"), F.lit("seen").alias("evidence"), F.lit(1).alias("n"))
    done = transitions.record_reviews(reviews.unionByName(reviews.limit(1).withColumns({"issues": F.array(F.lit("morphing")), "n": F.lit(2)})), clips, there)
    assert [r.problem for r in done["reviews"].where("problem IS NOT NULL").collect()] == ["critical_issue"]
    chosen = done["selections"].select("project_id", "scene_id", "status", "compared", F.col("clip").alias("selected_clip_id"), F.col("sha256").alias("selected_sha256"))
    held = clips.withColumn("approved_copy_path", F.lit(None).cast("string"))
    plain = scenes.select("project_id", "scene_id", "sequence_index", "dependency_hash")
    assert transitions.render_inputs(plain, chosen, held, there).count() == 2
    assert transitions.render_inputs(plain, chosen, held, there.limit(1)).count() == 0


def test_authorise(spark):
    payload = '{"a":1}'
    fp = spark.range(1).select(F.sha2(F.lit(payload), 256)).first()[0]
    scope = spark.range(1).select(session_scope(F.lit(SESSION))).first()[0]
    manifests = spark.createDataFrame([(b, fp, p, scope, "known", a, 9.0, False) for b, p, a in (("good", payload, 0.0), ("edited", '{"a":2}', 0.0), ("dear", payload, 10.0), ("bare", payload, 0.0))], "batch string, batch_fingerprint string, payload string, session_scope string, cost_status string, cost_amount double, cost_budget double, paid_retry boolean")
    consents = manifests.select("batch", F.lit(fp).alias("consent_fingerprint"), F.lit(gates.CONSENT_QUESTION).alias("consent_question"), F.lit(True).alias("approved"), F.lit(scope).alias("consent_scope"), F.lit(None).cast("string").alias("cost_question"), F.lit(None).cast("boolean").alias("cost_confirmed"), F.lit(None).cast("string").alias("cost_message"), F.lit(None).cast("boolean").alias("risk_confirmed"), F.lit(None).cast("boolean").alias("retry_confirmed"))
    entries = spark.createDataFrame([(b, 0, "s", True, True, True, False, "u", "o") for b in ("good", "edited", "dear")], "batch string, sequence_index int, scene_id string, original_substitution_forbidden boolean, rights_confirmed boolean, pii_reviewed boolean, contains_pii boolean, upload_derivative_path string, original_path string")
    got = {r.batch: r.reasons for r in transitions.authorise(manifests, consents, entries, SESSION).collect()}
    assert got == {"good": [], "edited": ["changed:payload"], "dear": ["over_budget", "cost_question", "cost_not_confirmed"], "bare": ["no_entries"]}
    assert not transitions.authorise(manifests, consents, entries, None).where("allowed").count()


def test_media_plans(spark):
    clips = spark.createDataFrame([("c.mp4", 10.0, "out")], "source string, duration double, folder string")
    rows = media.sample_frames(clips, "source", "duration", "folder").collect()
    assert [r.arguments[5] for r in rows] == ["0.000", "2.500", "5.000", "7.500", "9.960"] and rows[4].arguments[-1] == "out/sample-4.jpg"
    made = clips.select(*[f(F.col("source"), F.lit("t")).alias(f.__name__) for f in (media.thumbnail, media.upload_derivative, media.concatenate)], media.normalise(F.col("source"), F.lit("t"), F.lit("null")).alias("n"), media.decode_check(F.col("source")).alias("d")).first()
    assert made.thumbnail[-1] == "t" and "-map_metadata" in made.upload_derivative and made.n[7] == "-vf" and made.d[-1] == "-"
