"""Archives and files on disk: the data source, digests, and input that once stopped a job."""

import hashlib
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from propflow.operators.resume import file_problems
from propflow.sources import archives, files, html, zip_source


def damaged(path, name):
    """Turn bytes of a member's packed data, past its header."""
    with zipfile.ZipFile(path) as z:
        info = z.getinfo(name)
    data = bytearray(path.read_bytes())
    at = info.header_offset + 30 + len(name)
    data[at : at + 12] = b"\xff" * 12
    path.write_bytes(bytes(data))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("zips")
    noise = {f"a/{k:03d}.png": os.urandom(3000 + k) for k in range(60)}
    with zipfile.ZipFile(top / "large.zip", "w") as z:
        for name, data in noise.items():
            z.writestr(name, data)
    for k in range(4):
        with zipfile.ZipFile(top / f"small{k}.zip", "w") as z:
            z.writestr("x.txt", f"text {k}")
            z.mkdir("d")
    with zipfile.ZipFile(top / "bad.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.txt", "fine " * 50)
        z.writestr("bad.txt", "spoilt " * 50)
    damaged(top / "bad.zip", "bad.txt")
    (top / "none.zip").write_bytes(b"no archive")
    (top / "other.txt").write_text("not read")
    os.symlink(top / "large.zip", top / "link.zip")
    return top, noise


def test_one_archive_is_read_by_many_tasks(spark, folder):
    top, noise = folder
    found = zip_source.archives(spark, str(top), blockBytes=20_000, content=True).withColumn("task", F.spark_partition_id())
    rows = found.collect()
    large = [r for r in rows if r.archive == "large.zip"]
    assert len({r.task for r in large}) > 4 and [r.ix for r in sorted(large, key=lambda r: r.ix)] == list(range(60))
    assert {r.name: (r.sha256, bytes(r.content)) for r in large} == {n: (hashlib.sha256(d).hexdigest(), d) for n, d in noise.items()}
    # small archives share a task; a corrupt member and a file that is no archive are rows
    assert len({r.task for r in rows if r.archive.startswith("small")}) == 1
    assert {(r.archive, r.name) for r in rows if r.damaged} == {("bad.zip", "bad.txt"), ("none.zip", None)}
    assert {r.name for r in rows if r.archive == "small0.zip" and r.directory} == {"d/"}
    assert {r.archive for r in rows} == {"large.zip", "bad.zip", "none.zip", *(f"small{k}.zip" for k in range(4))}
    # the policies take its rows as they take those of archives in cells
    judged = archives.entry_problems(found.drop("task", "sha256")).where("archive IN ('bad.zip', 'none.zip', 'small1.zip')")
    assert {r.archive: r.archive_problem for r in judged.collect()} == {"bad.zip": "damaged", "none.zip": "not_an_archive", "small1.zip": None}


def test_conditions_come_before_inflating(spark, folder, monkeypatch):
    top, noise = folder
    where = [("archive", "=", "large.zip"), ("file_size", ">", 3050), ("name", "in", ["a/055.png", "a/057.png", "a/001.png"]), ("name", "contains", "57")]
    found = zip_source.archives(spark, str(top), where, content=True)
    assert [(r.name, len(r.content)) for r in found.collect()] == [("a/057.png", 3057)]
    # in one process: what does not hold is not opened
    reads = []
    monkeypatch.setattr(zip_source, "opened", lambda archive, info, member, *_: reads.append(info.filename) or member)
    reader = zip_source.ZipReader({"path": str(top), "where": '[["name", "suffix", ".txt"], ["file_size", "<", 100]]', "blockbytes": "20000"})
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert reads == ["x.txt"] * 4 == [r["name"] for r in rows]
    with pytest.raises(ValueError):
        zip_source.ZipReader({"path": str(top), "where": '[["sha256", "=", "x"]]'})
    # filters of a query do not touch other scans of the frame
    every = zip_source.archives(spark, str(top))
    assert every.where("name = 'x.txt'").unionByName(every).count() == 4 + every.count() == 4 + 60 + 8 + 3


def test_damaged_cells_are_rows(spark, folder):
    top, _ = folder
    cells = spark.createDataFrame([(n, bytearray((top / n).read_bytes())) for n in ("bad.zip", "none.zip", "small2.zip")], "k string, b binary")
    rows = archives.zip_entries(cells, "k", "b", with_content=True).collect()
    assert {(r.archive, r.name) for r in rows if r.damaged} == {("bad.zip", "bad.txt"), ("none.zip", None)}


def test_file_digests(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 10_000_001)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "large").write_bytes(b"y" * 3000)
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.mkfifo(tmp_path / "pipe")
    names = ["a", "empty", "link", "gone", "pipe", "large"]
    frame = spark.createDataFrame([(str(tmp_path / n),) for n in [*names, "a"]] + [(None,)], "path string")
    got = {os.path.basename(r.path): (r.size, r.sha256, r.problem) for r in files.file_digests(frame, most=20_000_000).collect()}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    assert got == {
        "a": (10_000_001, sha(b"x" * 10_000_001), None), "empty": (0, sha(b""), None), "link": (None, None, "symlink"), "gone": (None, None, "absent"), "pipe": (None, None, "special"), "large": (3000, sha(b"y" * 3000), None),
    }
    assert files.digest_of(str(tmp_path / "large"), most=2999) == (3000, None, "too_large")
    tracked = spark.createDataFrame([(str(tmp_path / n), got[n][1] or "h") for n in ("a", "gone")] + [(str(tmp_path / "large"), "old")], "path string, sha256 string")
    problems = file_problems(tracked, files.file_digests(tracked).where("problem IS NULL"), ["path"]).collect()
    assert {(os.path.basename(r.path), r.problem) for r in problems} == {("gone", "missing"), ("large", "changed")}


def test_memory_of_a_digest_is_bounded(tmp_path):
    """A file far larger than a piece is hashed a piece at a time."""
    import tracemalloc

    with open(tmp_path / "big", "wb") as f:
        f.truncate(256 << 20)
    tracemalloc.start()
    size, sha, problem = files.digest_of(str(tmp_path / "big"), piece=1 << 20)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (size, problem) == (256 << 20, None) and len(sha) == 64 and most < 4 << 20


def test_a_file_that_grows_is_refused(tmp_path, monkeypatch):
    path = tmp_path / "f"
    path.write_bytes(b"a" * 100)
    real = os.fstat

    def late(fd):
        found = real(fd)
        with open(path, "ab") as f:
            f.write(b"more")
        return found

    monkeypatch.setattr(files.os, "fstat", late)
    assert files.digest_of(str(path))[2] == "changed_while_read"


def test_json_that_no_cell_holds(spark):
    """Integers of very many digits and lone surrogates are warnings or replaced, and no end of the job."""
    block = '<script type="application/ld+json">{"@type": "Apartment", "name": "%s", "offers": {"price": %s}}</script>'
    pages = [("long", block % ("n", "1" * 5000)), ("lone", block % ("a\\ud800b", "5")), ("pair", block % ("\\ud83d\\ude00", "5")), ("good", block % ("flat", "7"))]
    frame = spark.createDataFrame([(k, f"<html><head>{b}</head></html>") for k, b in pages], "page string, html string")
    got = {r.page: r for r in html.listings(html.candidates(frame, "page", "html")).collect()}
    assert set(got) == {"long", "lone", "pair", "good"}
    assert got["lone"].title.value == "a�b" and got["pair"].title.value == "\U0001f600" and got["good"].title.value == "flat"
    assert got["long"].title is None or got["long"].title.value is None


def test_zlib_damage_is_known():
    assert zlib.error in archives.DAMAGE


def test_packages_appear_whole(spark, tmp_path):
    """Writers at once each get a version; the same content again is none; what fails leaves nothing."""
    from concurrent.futures import ThreadPoolExecutor

    from propflow.sources import sinks

    root = str(tmp_path / "package")
    frames = lambda k: {"scenes": spark.createDataFrame([(k, "s")], "k int, s string"), "prompts": spark.createDataFrame([(k,)], "k int")}
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: sinks.publish_package(frames(k), root, f"content {k}"), range(4)))
    assert sorted(versions) == [1, 2, 3, 4]
    for k, version in enumerate(versions):
        assert {name: [r.k for r in df.collect()] for name, df in sinks.package(spark, root, version).items()} == {"scenes": [k], "prompts": [k]}
    last = versions.index(4)
    assert sinks.publish_package(frames(last), root, f"content {last}") == 4
    assert len(os.listdir(f"{root}/data")) == 4
    bad = {"a": spark.range(1), "b": spark.range(1).select(F.raise_error(F.lit("stop")).alias("x"))}
    with pytest.raises(Exception):
        sinks.publish_package(bad, root, "bad")
    assert len(os.listdir(f"{root}/data")) == 4 and set(sinks.package(spark, root)) == {"scenes", "prompts"}
    assert not [n for n in os.listdir(root) if "pointer" in n]


def test_package_manifest_is_canonical(spark):
    from propflow.functions.hashing import canonical
    from propflow.operators.packages import manifests

    scenes = [("p", f"s{i}", i, "i", "h", path, 'say "hi"\n', 2.5, "16:9", "d") for i, path in ((1, "o/a.PNG"), (0, "o/.hidden"))]
    frame = spark.createDataFrame(scenes, "project_id string, scene_id string, sequence_index int, source_image_id string, source_sha256 string, source_path string, prompt_en string, duration_seconds double, aspect_ratio string, dependency_hash string")
    row = manifests(frame, spark.createDataFrame([("p", 3)], "project_id string, revision int")).first()
    depends = canonical({"plan_revision": 3, "scenes": [{"scene_id": f"s{i}", "sequence_index": i, "dependency_hash": "d"} for i in (0, 1)]})
    entries = [
        {"scene_id": f"s{i}", "sequence_index": i, "source_image_id": "i", "source_sha256": "h", "curated_image_path": f"generation-package/curated-images/s{i}{s}", "prompt": 'say "hi"\n', "duration_seconds": 2.5, "ratio": "16:9", "expected_filename": f"s{i}.mp4"}
        for i, s in ((0, ".img"), (1, ".png"))
    ]
    core = {"schema_version": 1, "project_id": "p", "mode": "manual", "plan_dependency_hash": hashlib.sha256(depends.encode()).hexdigest(), "provider_configured": False, "external_generation_authorized": False, "entries": entries}
    assert row.manifest == canonical(core) and row.package_fingerprint == hashlib.sha256(row.manifest.encode()).hexdigest() and row.n_scenes == 2


def test_very_many_blocks_are_put_together(tmp_path):
    """Tasks do not grow in number with blocks, and no member is read twice or left out."""
    from propflow.sources import zip_source

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        for k in range(1500):
            archive.writestr(f"{k:04d}.txt", "x" * 50)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as archive:
        archive.writestr("only.txt", "y")
    reader = zip_source.ZipReader({"path": str(tmp_path), "blockbytes": "40", "entries": "2000", "ratio": "1000"})
    parts = reader.partitions()
    assert len(parts) <= 512
    names = [n for part in parts for batch in reader.read(part) for n in batch.column("name").to_pylist()]
    assert names == [f"{k:04d}.txt" for k in range(1500)] + ["only.txt"]
