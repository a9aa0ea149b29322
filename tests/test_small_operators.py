import pytest
import json

from pyspark.sql import functions as F

from propflow.operators import gates, profiles, validation
from propflow.sources import archives, manifests, sinks


def test_missing_clips_and_kinds(spark):
    expected = spark.createDataFrame([("s1", "s1.mp4"), ("s2", "b.mp4")], "scene_id string, expected_filename string")
    found = spark.createDataFrame([("s1.mp4",)], "name string")
    assert [r.scene_id for r in archives.missing_clips(expected, found).collect()] == ["s2"]
    names = spark.createDataFrame([("a.ZIP", False), ("a.jpg", False), ("d", True), ("a.txt", False)], "n string, d boolean")
    assert [r[0] for r in names.select(archives.source_kind(F.col("n"), F.col("d"))).collect()] == ["zip", "file", "directory", "unsupported"]


def test_evidence(spark):
    a = spark.createDataFrame([("X", "MCP", 1), ("Y", "API", 2)], "provider_name string, connection_method string, id int")
    b = spark.createDataFrame([("X", "MCP", "u"), ("Y", "MCP", "v")], "provider_name string, connection_method string, url string")
    assert [r.id for r in profiles.with_evidence(a, b).collect()] == [1]
    problem = profiles.profile_problem(F.lit("X"), F.lit("Y"), F.lit("MCP"), F.lit(False), F.lit("env:K"), F.array(*[F.lit(c) for c in profiles.CAPABILITIES]))
    assert spark.range(1).select(problem).first()[0] == "another_provider"


def test_asset_integrity(spark):
    rows = [("p", "a", "a", "1"), ("p", "b", "c", "2"), ("p", "d", "d", "3"), ("p", "e", "e", "4"), ("p", "f", "f", "5"), ("p", "f", "f", "5")]
    assets = spark.createDataFrame(rows, "project_id string, asset_id string, sha256 string, relative_path string")
    files = spark.createDataFrame([("p", "1", "a"), ("p", "2", "c"), ("p", "3", "x"), ("p", "5", "f")], "project_id string, path string, sha256 string")
    got = {(r.asset_id, r.problem) for r in manifests.asset_integrity(assets, files).collect()}
    assert got == {("a", None), ("b", "id"), ("d", "changed"), ("e", "absent"), ("f", "repeated")}


def test_shot_list_json(spark):
    rows = [("p", 1, "s2", "i", "r", "m", 2.0, "16:9", "t"), ("p", 0, "s1", "i", "r", "m", 2.0, "16:9", "t")]
    scenes = spark.createDataFrame(rows, "project_id string, sequence_index int, scene_id string, source_image_id string, room_type string, camera_motion string, duration_seconds double, aspect_ratio string, prompt_en string")
    text = scenes.groupBy("project_id").agg(sinks.shot_list_json(F.col("project_id")).alias("t")).first().t
    assert [s["scene_id"] for s in json.loads(text)["scenes"]] == ["s1", "s2"]


def test_faults(spark):
    digest = "a" * 64
    scene = validation.scene_fault(*[F.lit(x) for x in ("scn_" + "a" * 12, 0, digest, digest, "pan", "a/b.jpg", digest)])
    bad = validation.scene_fault(*[F.lit(x) for x in ("scn_" + "a" * 12, 0, digest, digest, "pan then tilt", "a/b.jpg", digest)])
    chosen = validation.analysis_fault(*[F.lit(x) for x in (digest, digest, "a.jpg", "selected", "map", "r", "i")])
    assert tuple(spark.range(1).select(scene, bad, chosen).first()) == (None, "camera_motion", "asset_kind")
    assert spark.range(1).select(gates.same_list(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1)))).first()[0] is False


def test_hashes_of_every_size(spark):
    import random

    from propflow.functions.hashing import dhash, hamming

    rnd = random.Random(3)
    for size in (4, 5, 8, 9, 16, 32):
        pixels = [[rnd.randrange(4) for _ in range(size * (size + 1))] for _ in range(3)]
        rows = spark.createDataFrame([(p,) for p in pixels], "p array<int>").select(dhash(F.col("p"), size).alias("h")).collect()
        want = [sum((p[r * (size + 1) + c] > p[r * (size + 1) + c + 1]) << (size * size - 1 - r * size - c) for r in range(size) for c in range(size)) for p in pixels]
        assert [r.h for r in rows] == [format(w, f"0{(size * size + 3) // 4}x") for w in want]
        pair = spark.createDataFrame([(rows[0].h, rows[1].h)], "a string, b string").select(hamming(F.col("a"), F.col("b"))).first()[0]
        assert pair == bin(want[0] ^ want[1]).count("1")
    with pytest.raises(ValueError):
        dhash(F.col("p"), 33)


@pytest.mark.parametrize("bits,distance", [(64, 6), (64, 0), (49, 12), (256, 6), (16, 1)])
def test_near_pairs_against_all_pairs(spark, bits, distance):
    import random

    from propflow.operators import assets

    rnd = random.Random(bits)
    hashes = [rnd.getrandbits(bits) for _ in range(40)]
    for h in hashes[:20]:
        hashes.append(h ^ sum(1 << b for b in rnd.sample(range(bits), rnd.randrange(0, min(bits, 9)))))
    width = (bits + 3) // 4
    frame = spark.createDataFrame([(i, format(h, f"0{width}x")) for i, h in enumerate(hashes)], "asset_id int, dhash string").repartition(3)
    got = sorted(tuple(r)[:3] for r in assets.near_pairs(frame, bits, distance).collect())
    assert got == [(i, j, d) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (d := bin(a ^ b).count("1")) <= distance]


def test_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from propflow.operators import state

    store = state.Store(spark, str(tmp_path))
    store.write("p", {"a": 0}, 0)

    def write(n):
        try:
            return store.write("p", {"a": n}, 1)
        except state.StaleRevision:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, range(4)))
    assert sorted(done, key=str) == [2, None, None, None] and store.last("p") == 2 and store.read("p")["a"] == done.index(2)


def test_two_contents_in_a_batch(spark, tmp_path):
    from propflow.sources import sinks

    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, v int")
    sinks.append_new(rows, str(tmp_path / "t"), "k", "v")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(sinks.Conflict):
        sinks.append_new(spark.createDataFrame([("c", 1), ("c", None)], "k string, v int"), str(tmp_path / "t"), "k", "v")


def test_process_that_prints_too_much():
    import time

    from propflow.operators import media

    began = time.monotonic()
    assert media.bounded(["yes"], 30)[2] == "too_much_output" and time.monotonic() - began < 20
    assert media.bounded(["echo", "x"], 10) == (0, b"x\n", None) and media.bounded(["false"], 10)[2] == "failed"


def test_archive_over_its_limits_is_not_inflated(spark):
    import io
    import zipfile

    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(4):
            z.writestr(f"{i}.jpg", bytes(300_000))
    frame = spark.createDataFrame([("z", bytearray(body.getvalue()))], "k string, b binary")
    tight = archives.Limits(file_bytes=400_000, total_bytes=1_000_000, ratio=10_000.0)
    found = archives.zip_entries(frame, "k", "b", True, tight)
    assert found.where("content IS NOT NULL").count() == 0
    assert {r.archive_problem for r in archives.entry_problems(found, tight).collect()} == {"total_size"}


def test_folder_listing(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("x.jpg", "a/y.png", "a/b/z.zip"):
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "a" / "link.jpg").symlink_to(tmp_path / "x.jpg")
    found = archives.folder_entries(spark.createDataFrame([("f", str(tmp_path))], "n string, p string"), "n", "p")
    assert [(r.relative_path, r.kind, r["size"]) for r in found.collect()] == [("a/b/z.zip", "file", 5), ("a/link.jpg", "symlink", 0), ("a/y.png", "file", 5), ("x.jpg", "file", 5)]
    judged = {r.relative_path: r.problem for r in archives.folder_problems(found).collect()}
    assert judged == {"a/b/z.zip": "nested", "a/link.jpg": "symlink", "a/y.png": None, "x.jpg": None}


def test_a_lapsed_claim_belongs_to_its_new_owner(spark, tmp_path, monkeypatch):
    """A writer that comes back after its claim lapsed leaves the claim of the one that took it over."""
    import os

    from propflow.operators import state

    store = state.Store(spark, str(tmp_path))
    claim = store._claim("p", 1, "first")
    path = claim.toUri().getPath()
    with pytest.raises(state.StaleRevision):
        store._claim("p", 1, "second")
    os.utime(path, (0, 0))
    store._claim("p", 1, "second")
    assert store._owner(claim) == "second"
    # the first one's write ends: what it finds is not its own
    monkeypatch.setattr(store, "_claim", lambda project, revision, owner: claim)
    assert store.write("p", {"a": 1}, 0) == 1
    assert os.path.exists(path) and store._owner(claim) == "second"
