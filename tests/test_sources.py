import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from propflow.sources import archives, html, images, manifests, sinks


def listing(spark, page, url=None):
    pages = spark.createDataFrame([("p", bytearray(page.encode() if isinstance(page, str) else page), url)], "page string, html binary, url string")
    found = html.candidates(pages, "page", "html", "url")
    return html.listings(found).first()


def test_json_ld_wins_over_open_graph(spark):
    row = listing(spark, """<meta property="og:title" content="og"><meta property="og:image" content="https://b.pl/2.jpg">
      <script type="application/ld+json">{"@type": "Apartment", "name": " A  flat ", "offers": {"price": 799000}, "floorSize": {"value": 61.5}, "numberOfRooms": 3, "floorLevel": "2",
      "address": {"streetAddress": "S 1", "addressLocality": "T", "addressCountry": "T"}, "description": "d", "image": ["https://a.pl/1.jpg", "http://127.0.0.1/x.jpg"]}</script>""")
    assert (row.title.value, row.title.source, row.title.path) == ("A flat", "json_ld", "json_ld[0]$.name")
    assert (row.price.value, row.price.value_type, row.area.value, row.area.value_type) == ("799000", "integer", "61.5", "number")
    assert row.location.value == "S 1, T" and row.property_type.value == "Apartment"
    assert [x.url for x in row.images] == ["https://a.pl/1.jpg", "https://b.pl/2.jpg"] and row.status == "ok"


def test_nodes_rank_within_their_block_only(spark):
    row = listing(spark, """<script type="application/ld+json">[{"name": "worst"}, {"@type": "House", "headline": "best"}]</script>
      <script type="application/ld+json">{"@type": "Apartment", "name": "later", "price": "5"}</script>""")
    assert row.title.value == "best" and row.title.path == "json_ld[0]$[1].headline" and row.price.value == "5"


def test_first_present_name_is_the_path(spark):
    row = listing(spark, '<meta property="realestate:location" content=" "><meta property="og:locality" content="Town">')
    assert (row.location.value, row.location.path) == ("Town", "realestate:location")


def test_images_of_tags_in_document_order(spark):
    page = """<link rel="image_src" href="/1.jpg"><img src="2.jpg" data-src="https://a.pl/3.jpg" srcset="/4.jpg 1x, 5.jpg 2x"><source srcset="/1.jpg"><img src="data:x"><img src="http://u@a.pl/6.jpg">
      <meta name="twitter:image" content="/7.jpg">"""
    row = listing(spark, page, "https://www.site.pl/x/y")
    assert [x.url for x in row.images] == ["https://www.site.pl/1.jpg", "https://www.site.pl/x/2.jpg", "https://a.pl/3.jpg", "https://www.site.pl/4.jpg", "https://www.site.pl/x/5.jpg", "https://www.site.pl/7.jpg"]
    assert not listing(spark, page).images[1:]


@pytest.mark.parametrize("block", ['{"name": "a", "name": "b"}', '{"price": NaN}', "", "{"])
def test_bad_blocks_are_warnings(spark, block):
    row = listing(spark, f'<meta property="og:title" content="og"><script type="application/ld+json">{block}</script>')
    assert row.title.value == "og" and len(row.warnings) == 1 and row.status == "partial"


def test_deep_blocks_are_warnings(spark):
    row = listing(spark, '<meta property="og:title" content="og"><script type="application/ld+json">' + "[" * 100_000 + "]" * 100_000 + "</script>")
    assert row.title.value == "og" and len(row.warnings) == 1 and row.status == "partial"


def test_tags_that_mean_nothing(spark):
    row = listing(spark, '<svg><image href="https://a.pl/1.jpg"/></svg><sets srcset="https://a.pl/2.jpg"><reader><handle_data><IMG SRC="https://a.pl/3.jpg">')
    assert [x.url for x in row.images] == ["https://a.pl/3.jpg"]


def test_listings_read_pages_once(spark):
    pages = spark.createDataFrame([("p", "<title>x</title>"), ("q", None)], "page string, html string")
    made = html.listings(html.candidates(pages, "page", "html"))
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.page: r.status for r in made.collect()} == {"p": "partial", "q": "refused"}


def test_not_finite_is_null(spark):
    assert listing(spark, '<script type="application/ld+json">{"price": 1e400, "name": true}</script>').present == 0


@pytest.mark.parametrize("body,why", [(b"", "empty"), (b"\xff\xfe", "not_utf8"), (b"a\0b", "nul"), (b"x" * ((2 << 20) + 1), "too_large"), (b'<script type="application/ld+json">{}', "a JSON-LD block is not closed")])
def test_refused_pages(spark, body, why):
    row = listing(spark, body)
    assert row.status == "refused" and row.errors == [why]


def test_blocked(spark):
    rows = html.blocked(spark.createDataFrame([("https://a.pl", " no  access "), ("https://b.pl", " ")], "url string, reason string"), "url", F.col("reason")).collect()
    assert [(r.status, r.errors, r.title) for r in rows] == [("blocked", ["no access"], None)]


def png(width=4, height=3, crc=True):
    head = b"IHDR" + struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head) ^ (not crc))


def jpeg(width=4, height=3, orientation=None):
    exif = b""
    if orientation is not None:
        tiff = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x0112, 3, 1, orientation, 0)
        body = b"Exif\0\0" + tiff
        exif = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + exif + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, height, width, 1) + b"\xff\xd9"


def test_image_headers(spark):
    cases = {
        ("a.png", png()): ("png", 4, 3, 1, None), ("a.PNG", png(crc=False)): (None, None, None, None, "png_checksum"), ("a.jpg", png()): (None, None, None, None, "suffix_and_magic"),
        ("b.jpeg", jpeg(7, 5, 6)): ("jpeg", 7, 5, 6, None), ("c.jpg", jpeg(orientation=9)): (None, None, None, None, "exif_orientation"), ("d.jpg", b"\xff\xd8\xff\xda"): (None, None, None, None, "jpeg_no_size"),
        ("e.gif", b"GIF8"): (None, None, None, None, "suffix"), ("f.png", b""): (None, None, None, None, "empty"), ("g.png", png(40_000)): (None, None, None, None, "size"), ("h.png", b"x"): (None, None, None, None, "magic"),
    }
    frame = spark.createDataFrame([(n, bytearray(b)) for n, b in cases], "n string, b binary")
    for r in frame.select("n", "b", images.probe_image(F.col("n"), F.col("b")).alias("p")).collect():
        assert (r.p.format, r.p.width, r.p.height, r.p.orientation, r.p.problem) == cases[r.n, bytes(r.b)]


def zipped(entries, **attributes):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            info.external_attr = attributes.get(name, 0o100644) << 16
            z.writestr(info, body)
    return out.getvalue()


def test_archives(spark):
    cases = {
        "good": (zipped([("a.png", b"1"), ("d/b.txt", b"2")]), None), "traversal": (zipped([("../a.png", b"1")]), "traversal"), "absolute": (zipped([("/a.png", b"1")]), "absolute"),
        "collision": (zipped([("A.png", b"1"), ("a.png", b"2")]), "collision"), "ratio": (zipped([("a.png", b"0" * 2_000_000)]), "ratio"), "nested": (zipped([("a.zip", b"x")]), "nested"),
        "hidden": (zipped([("a.png", zipped([("x", b"y")]))]), "nested"), "symlink": (zipped([("a.png", b"1")], **{"a.png": 0o120777}), "symlink"), "special": (zipped([("a.png", b"1")], **{"a.png": 0o020666}), "special"),
        "clash": (zipped([("a", b"1"), ("a/b.png", b"2")]), "file_and_folder"), "none": (b"no archive", "not_an_archive"),
    }
    frame = spark.createDataFrame([(k, bytearray(b)) for k, (b, _) in cases.items()], "k string, b binary")
    judged = archives.entry_problems(archives.zip_entries(frame, "k", "b", with_content=True)).collect()
    assert {r.archive: r.archive_problem for r in judged} == {k: p for k, (_, p) in cases.items()}
    assert [(r.name, bytes(r.content)) for r in judged if r.accepted] == [("a.png", b"1")]


def test_limits():
    with pytest.raises(ValueError):
        archives.Limits(entries=0)
    with pytest.raises(ValueError):
        archives.Limits(images=True)
    with pytest.raises(ValueError):
        archives.Limits(images=300)


def test_folders(spark):
    rows = [("b", "x/A.png", "file", 5), ("b", "x/a.PNG", "file", 5), ("c", "y.png", "file", 5), ("c", "y.txt", "file", 5), ("d", "z.tar", "file", 1), ("e", "l.png", "symlink", 1)]
    got = archives.folder_problems(spark.createDataFrame(rows, "batch string, relative_path string, kind string, size long")).collect()
    assert {r.batch: r.batch_problem for r in got} == {"b": "collision", "c": None, "d": "nested", "e": "symlink"}
    assert [(r.relative_path, r.accepted, r.reason) for r in got if r.batch == "c"] == [("y.png", True, None), ("y.txt", False, "unsupported_suffix")]


def test_documents(spark, tmp_path):
    (tmp_path / "dom").mkdir()
    (tmp_path / "dom" / "project.json").write_text('{"project_id": "dom", "clips": [{"clip_id": "c", "revision": 2}, 5]}')
    (tmp_path / "twice").mkdir()
    (tmp_path / "twice" / "project.json").write_text('{"a": 1, "a": 2}')
    docs = manifests.documents(spark, str(tmp_path))
    got = {r.path.split("/")[-2]: r.p for r in docs.select("path", manifests.project_problem(F.col("document"), F.col("path")).alias("p")).collect()}
    assert got == {"dom": None, "twice": "not_a_document"}
    rows = manifests.collection(docs.where("document IS NOT NULL"), "document", "path", "$.clips", {"clip_id": "string", "revision": "int"}).collect()
    assert [(r.ord, r.clip_id, r.revision) for r in rows] == [(0, "c", 2), (1, None, None)]


def test_sinks(spark, tmp_path):
    base = str(tmp_path)
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.append_new(frame, f"{base}/t", "k", "v")
    sinks.append_new(frame, f"{base}/t", "k", "v")
    assert spark.read.parquet(f"{base}/t").count() == 2
    with pytest.raises(sinks.Conflict):
        sinks.append_new(spark.createDataFrame([("a", 9)], "k string, v int"), f"{base}/t", "k", "v")
    sinks.publish(frame, f"{base}/p")
    sinks.publish(frame.limit(1), f"{base}/p")
    assert spark.read.parquet(f"{base}/p").count() == 1
    with pytest.raises(sinks.Conflict):
        sinks.publish_all({f"{base}/new": frame, f"{base}/p": frame})
    assert not (tmp_path / "new").exists()
    sinks.create_project(spark, base, "dom", {"name": "Dom"})
    assert (tmp_path / "dom" / "scenes" / "approved").is_dir()
    with pytest.raises(sinks.Conflict):
        sinks.create_project(spark, base, "dom", {})
    with pytest.raises(ValueError):
        sinks.write_document(spark, f"{base}/nan", {"x": float("nan")})
