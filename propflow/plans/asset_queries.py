"""Queries over files, addresses, snapshots and listings, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.functions.hashing import dhash
from propflow.functions.rules import archive_name_problem, is_relative_path, is_sha256, looks_secret
from propflow.functions.text import collapsed, collision_key_ascii, rational, srcset
from propflow.functions.urls import LOCAL_SUFFIXES, host, problem, problem_sql
from propflow.operators.analysis import coverage, path_conflicts
from propflow.operators.assets import contact_sheet, exact_assets, near_classes, near_pairs, provenance, sheet_fingerprint, upsert
from propflow.operators.planning import overlay
from propflow.plans.common import spread, table
from propflow.sources.archives import folder_fingerprint
from propflow.sources.html import candidates, listings, readable


def _candidates(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.sha2("text", 256).alias("sha256"),
        F.col("doc_id").alias("position"),
        provenance(F.col("source"), F.col("doc_id").cast("string")).alias("source"),
        (F.col("lang") == "en").alias("preferred"),
    )


def asset_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = exact_assets(_candidates(table(spark, sf_dir, "documents")))
    return assets.select("sha256", F.col("first.position").alias("first_doc_id"), F.size("sources").cast("long").alias("n_sources"), F.col("exact_duplicate_count").cast("long").alias("exact_duplicate_count"), "preferred")


def asset_upsert_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first, second = (exact_assets(_candidates(docs.where(c))).withColumn("doc_id", F.col("first.position")).drop("first") for c in ("source < 'src2'", "source >= 'src2' OR source IS NULL"))
    return upsert(first, second).select("sha256", "doc_id", F.col("exact_duplicate_count").cast("long").alias("exact_duplicate_count"), "preferred")


def _hashes_49(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), dhash(F.col("embedding"), 7).alias("dhash"))


def _hashes_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of 64 bits, one for the sign of each number; each asset again with some bits turned, for near ones to be there.

    Of asset v the copies 1 and 2 have 3 and 9 bits turned from bit v on, and copy 3 none.
    """
    signs = F.transform(F.slice("embedding", 1, 64), lambda x: F.when(x > 0, 1).otherwise(0))
    copies = table(spark, sf_dir, "embeddings").select("vec_id", signs.alias("bits"), F.explode(F.array(*[F.struct(F.lit(c).alias("copy"), F.lit(n).alias("turned")) for c, n in enumerate((0, 3, 9, 0))])).alias("c"))
    bits = F.transform("bits", lambda b, i: F.when(F.pmod(i - F.col("vec_id"), F.lit(64)) < F.col("c.turned"), 1 - b).otherwise(b).cast("string"))
    turned = copies.select((F.col("vec_id") * 4 + F.col("c.copy")).alias("asset_id"), F.array_join(bits, "").alias("bits"))
    half = [F.lpad(F.conv(F.substring("bits", at, 32), 2, 16), 8, "0") for at in (1, 33)]
    return turned.select("asset_id", F.lower(F.concat(*half)).alias("dhash"))


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(_hashes_49(spark, sf_dir), 49, 12).select("left_asset_id", "right_asset_id", F.col("distance").cast("long").alias("distance"))


def near_duplicate_pairs_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the usual distance of 6."""
    return near_pairs(_hashes_64(spark, sf_dir), 64, 6).select("left_asset_id", "right_asset_id", F.col("distance").cast("long").alias("distance"))


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset with its class and the number of assets near it."""
    members, _ = near_classes(_hashes_64(spark, sf_dir), 64, 6)
    return members.select("asset_id", "class_id", *[F.col(c).cast("long").alias(c) for c in ("copies", "n_links")])


def near_duplicate_class_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links = near_classes(_hashes_49(spark, sf_dir), 49, 12)
    return links.select("left_class", "right_class", *[F.col(c).cast("long").alias(c) for c in ("distance", "left_copies", "right_copies")])


def contact_sheet_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = contact_sheet(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"])
    return cells.select("source", "doc_id", *[F.col(c).cast("long").alias(c) for c in ("index", "row", "column", "x", "y")], "too_large")


def contact_sheet_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_fingerprint(table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("asset_id")).distinct(), "source")


def directory_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("source", F.format_string("%012d.txt", "doc_id").alias("name"), F.sha2("text", 256).alias("sha256"))
    return folder_fingerprint(files, "source", "name", "sha256")


def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", problem_sql(F.col("url")).alias("problem"), problem_sql(F.col("url"), True).alias("problem_https"))


def url_policy_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", problem(F.col("url"), F.lit(False)).alias("problem"))


def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"))


def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("size_bytes"), F.sha2("html", 256).alias("sha256"), readable(body).alias("problem"))


def _listing_rows(found: DataFrame, key: str) -> DataFrame:
    fields = ("title", "location", "price", "area", "rooms", "floor", "property_type", "description")
    return listings(found).select(
        F.col("page").cast("long").alias(key),
        *[F.col(f"{f}.value").alias(f) for f in fields],
        *[F.col(f"{f}.value_type").alias(f"{f}_type") for f in ("price", "rooms")],
        F.col("title.path").alias("title_path"),
        F.array_join(F.transform("images", lambda x: x["url"]), " ").alias("images"),
        F.size("warnings").cast("long").alias("n_warnings"),
        "status",
    )


def listing_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return _listing_rows(candidates(pages, "page_id", "html", "url"), "page_id")


def jsonld_pages(parts: DataFrame) -> DataFrame:
    """Snapshots made from parts: JSON-LD of an apartment, an Open Graph title that must lose, a local image that must go."""
    listing = F.to_json(
        F.struct(
            F.lit("Apartment").alias("@type"),
            F.col("p_name").alias("name"),
            F.concat(F.lit("  a "), F.col("p_brand"), F.lit("\n"), F.col("p_type"), F.lit(" ")).alias("description"),
            F.struct(F.concat(F.lit("Street "), F.col("p_size").cast("string")).alias("streetAddress"), F.col("p_brand").alias("addressLocality"), F.col("p_brand").alias("addressRegion"), F.lit("PL").alias("addressCountry")).alias("address"),
            F.struct(F.col("p_partkey").alias("price")).alias("offers"),
            F.struct(F.col("p_size").alias("value")).alias("floorSize"),
            F.col("p_size").alias("numberOfRooms"),
            F.col("p_type").alias("floorLevel"),
            F.array(F.concat(F.lit("https://img.site-a.com/"), F.col("p_partkey").cast("string"), F.lit(".jpg")), F.lit("http://127.0.0.1/x.jpg")).alias("image"),
        )
    )
    html = F.concat(
        F.lit('<html><head><meta property="og:title" content="other"><meta property="og:image" content="https://img.site-b.com/og.jpg"><script type="application/ld+json">'),
        listing, F.lit("</script></head><body><p>x</p></body></html>"),
    )
    return parts.select("p_partkey", html.alias("html"))


def listing_roundtrip_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = jsonld_pages(spread(table(spark, sf_dir, "part"), "p_partkey"))
    return _listing_rows(candidates(pages, "p_partkey", "html"), "p_partkey")


def listing_roundtrip_og(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    meta = lambda name, c: F.concat(F.lit(f'<meta property="{name}" content="'), c.cast("string"), F.lit('">'))
    html = F.concat(
        F.lit("<html><head>"), meta("og:title", F.col("s_name")), meta("product:price:amount", F.col("s_suppkey")), meta("realestate:type", F.lit("flat")),
        meta("og:street-address", F.lit(" ")), meta("og:locality", F.col("n_name")), meta("realestate:rooms", F.col("s_nationkey")),
        F.lit('<meta property="og:image" content="https://img.site-c.com/a.jpg"><meta property="og:image:url" content="https://img.site-c.com/a.jpg"></head></html>'),
    )
    pages = spread(met, "s_suppkey").select("s_suppkey", html.alias("html"))
    return _listing_rows(candidates(pages, "s_suppkey", "html"), "s_suppkey")


def srcset_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit(" /a/"), F.col("p_brand"), F.lit(" 1x, /b/"), F.col("p_partkey").cast("string"), F.lit("  2x,, /a/"), F.col("p_brand"), F.lit(" 3x"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(srcset(value)).alias("pos", "url"))
    return rows.groupBy("p_partkey", "url").agg(F.min("pos").cast("long").alias("first_pos"))


def id_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def path_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_name").alias("path"))
    other = part.withColumn("path", F.when(F.col("p_partkey") % 7 == 0, F.upper("path")).when(F.col("p_partkey") % 11 == 0, F.lit(None)).otherwise(F.col("path")))
    return path_conflicts(part, other, "p_partkey", "path")


def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    base = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("size"))
    there = F.col("p_partkey") % 3 == 0
    top = part.select("p_partkey", F.when(there, F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))).alias("name"), there.alias("has_name"))
    return overlay([base, top], "p_partkey", ["name", "kind", "size"]).select("p_partkey", "name", "kind", "size")


def collision_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    from pyspark.sql import Window

    order = Window.partitionBy(collision_key_ascii(F.col("name"))).orderBy("p_partkey")
    return part.withColumns({"first_key": F.first("p_partkey").over(order), "collides": F.row_number().over(order) > 1}).select("p_partkey", "first_key", "collides")


def rational_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 4).cast("string")))
        .when(F.col("p_partkey") % 5 == 1, F.col("p_size").cast("string"))
        .when(F.col("p_partkey") % 5 == 2, F.lit("n/a"))
        .otherwise(F.concat(F.lit("30000/"), F.col("p_size").cast("string")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", rational(text).alias("value"))


def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 9
    name = F.col("p_name")
    made = (
        F.when(k == 0, F.concat(F.lit("../"), name)).when(k == 1, F.concat(F.lit("/"), name)).when(k == 2, F.concat(F.lit("a\\"), name)).when(k == 3, F.concat(F.lit("a//"), name))
        .when(k == 4, F.concat(F.lit("C:"), name)).when(k == 5, F.concat(name, F.lit("."))).when(k == 6, F.concat(F.lit("a/./"), name)).when(k == 7, F.lit("")).otherwise(F.concat(F.lit("a/"), name))
    )
    return table(spark, sf_dir, "part").select("p_partkey", archive_name_problem(made, F.lit(False)).alias("problem"), is_relative_path(made).alias("safe_path"))


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("  "), F.col("p_name"), F.lit(" \n\t "), F.col("p_type"), F.lit("  "))
    digest = F.sha2(F.col("p_partkey").cast("string"), 256)
    secret = F.when(F.col("p_partkey") % 3 == 0, digest).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("sk-"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", collapsed(text, 14).alias("title"), is_sha256(secret).alias("is_digest"), looks_secret(secret).alias("looks_secret"))


_LOCAL = " OR ".join(f"h = '{s}' OR ends_with(h, '.{s}')" for s in LOCAL_SUFFIXES)


def _policy_sql(scheme: str) -> str:
    return f"""CASE WHEN url IS NULL OR url = '' OR length(url) > 4096 OR regexp_matches(url, '^\\s|\\s$') THEN 'text'
      WHEN regexp_matches(url, '[\\x00-\\x1f\\x7f]') THEN 'control'
      WHEN NOT regexp_matches(url, '{scheme}') OR h = '' THEN 'scheme'
      WHEN contains(a, '@') THEN 'credentials'
      WHEN regexp_matches(url, '#.') THEN 'fragment'
      WHEN ends_with(h, '.') THEN 'trailing_dot'
      WHEN {_LOCAL} OR NOT contains(h, '.') THEN 'local' END"""


_FIELDS_SQL = {
    "location": "NULL::VARCHAR", "price": "NULL::VARCHAR", "area": "NULL::VARCHAR", "rooms": "NULL::VARCHAR", "floor": "NULL::VARCHAR", "property_type": "NULL::VARCHAR",
    "description": "NULL::VARCHAR", "title": "NULL::VARCHAR", "price_type": "NULL::VARCHAR", "rooms_type": "NULL::VARCHAR", "title_path": "NULL::VARCHAR", "images": "''", "n_warnings": "0::BIGINT", "status": "'partial'",
}


def _listing_sql(key: str, source: str, **fields: str) -> str:
    columns = ", ".join(f"{v} AS {k}" for k, v in (_FIELDS_SQL | fields).items())
    return f"SELECT {key}, {columns} FROM {source}"


#: h: id and bits, as text.
_HASHES_49_SQL = """h AS (SELECT vec_id AS id, array_to_string(list_transform(range(49), lambda i: CASE WHEN embedding[(i // 7) * 8 + i % 7 + 1] > embedding[(i // 7) * 8 + i % 7 + 2] THEN '1' ELSE '0' END), '') AS b FROM embeddings)"""
_HASHES_64_SQL = """h AS (SELECT vec_id * 4 + c AS id, array_to_string(list_transform(range(64), lambda i: CASE WHEN (embedding[i + 1] > 0) = ((i - vec_id % 64 + 64) % 64 >= t) THEN '1' ELSE '0' END), '') AS b
    FROM embeddings, (VALUES (0, 0), (1, 3), (2, 9), (3, 0)) v(c, t))"""
_APART_SQL = "hamming(x.b, y.b)"

QUERIES = {f.__name__: f for f in (
    asset_exact_dedup, asset_upsert_two_batches, near_duplicate_pairs, near_duplicate_pairs_64, near_duplicate_classes, near_duplicate_class_links, contact_sheet_grid, contact_sheet_digest, directory_fingerprint, url_policy, url_policy_full, url_domain,
    snapshot_stats, listing_from_pages, listing_roundtrip_jsonld, listing_roundtrip_og, srcset_explode, id_coverage, path_consistency, overlay_merge, collision_keys, rational_parse, archive_names, text_rules,
)}

SQL = {
    "asset_exact_dedup": """
        SELECT sha256(text) AS sha256, min(doc_id) AS first_doc_id, count(DISTINCT (source, doc_id)) AS n_sources,
               count(DISTINCT (source, doc_id)) - 1 AS exact_duplicate_count, bool_or(lang = 'en') AS preferred
        FROM documents GROUP BY sha256(text)""",
    "asset_upsert_two_batches": """
        SELECT sha256(text) AS sha256, coalesce(min(doc_id) FILTER (WHERE source < 'src2'), min(doc_id)) AS doc_id,
               count(*) - 1 AS exact_duplicate_count, bool_or(lang = 'en') AS preferred
        FROM documents GROUP BY sha256(text)""",
    "near_duplicate_pairs": f"""
        WITH {_HASHES_49_SQL}, p AS (SELECT x.id AS left_asset_id, y.id AS right_asset_id, {_APART_SQL} AS distance FROM h x JOIN h y ON x.id < y.id)
        SELECT * FROM p WHERE distance <= 12""",
    "near_duplicate_pairs_64": f"""
        WITH {_HASHES_64_SQL}, p AS (SELECT x.id AS left_asset_id, y.id AS right_asset_id, {_APART_SQL} AS distance FROM h x JOIN h y ON x.id < y.id)
        SELECT * FROM p WHERE distance <= 6""",
    "near_duplicate_classes": f"""
        WITH {_HASHES_64_SQL}, p AS (SELECT x.id, count(*) AS n_links FROM h x JOIN h y ON x.id <> y.id AND {_APART_SQL} <= 6 GROUP BY x.id)
        SELECT id AS asset_id, min(id) OVER (PARTITION BY b) AS class_id, count(*) OVER (PARTITION BY b) AS copies, coalesce(n_links, 0) AS n_links FROM h LEFT JOIN p USING (id)""",
    "near_duplicate_class_links": f"""
        WITH {_HASHES_49_SQL}, c AS (SELECT b, min(id) AS id, count(*) AS copies FROM h GROUP BY b),
        p AS (SELECT x.id AS left_class, y.id AS right_class, {_APART_SQL} AS distance, x.copies AS left_copies, y.copies AS right_copies FROM c x JOIN c y ON x.id < y.id)
        SELECT * FROM p WHERE distance <= 12""",
    "contact_sheet_grid": """
        WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS index, count(*) OVER (PARTITION BY source) AS n FROM documents),
        g AS (SELECT *, ceil(sqrt(n))::BIGINT AS c FROM n)
        SELECT source, doc_id, index, index // c AS "row", index % c AS "column", (index % c) * 320 AS x, (index // c) * 240 AS y,
               c * 320 > 16384 OR ceil(n / c) * 240 > 16384 OR c * ceil(n / c) * 320 * 240 > 100000000 AS too_large FROM g""",
    "contact_sheet_digest": """
        SELECT source, sha256(string_agg(a, chr(10) ORDER BY a) || chr(10) || '320x240') AS fingerprint
        FROM (SELECT DISTINCT source, sha256(text) AS a FROM documents) GROUP BY source""",
    "directory_fingerprint": """
        SELECT source, count(*) AS n_files, sha256(string_agg(printf('%012d.txt', doc_id) || chr(0) || sha256(text) || chr(0), '' ORDER BY doc_id)) AS fingerprint
        FROM documents GROUP BY source""",
    "url_policy": f"""
        WITH s AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS a FROM pages),
        t AS (SELECT *, lower(regexp_replace(regexp_replace(a, '^.*@', ''), ':[0-9]*$', '')) AS h FROM s)
        SELECT page_id, {_policy_sql('(?i)^https?://')} AS problem, {_policy_sql('(?i)^https://')} AS problem_https FROM t""",
    "url_domain": "SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages",
    "snapshot_stats": "SELECT page_id, octet_length(encode(html))::BIGINT AS size_bytes, sha256(html) AS sha256, CASE WHEN octet_length(encode(html)) > 2097152 THEN 'too_large' END AS problem FROM pages",
    "listing_from_pages": _listing_sql("page_id", "pages", n_warnings="1::BIGINT"),
    "listing_roundtrip_jsonld": _listing_sql(
        "p_partkey", "part", title="p_name", description="'a ' || p_brand || ' ' || p_type", location="'Street ' || p_size || ', ' || p_brand || ', PL'", price="p_partkey::VARCHAR", area="p_size::VARCHAR",
        rooms="p_size::VARCHAR", floor="p_type", property_type="'Apartment'", price_type="'integer'", rooms_type="'integer'", title_path="'json_ld[0]$.name'",
        images="'https://img.site-a.com/' || p_partkey || '.jpg https://img.site-b.com/og.jpg'", status="'ok'",
    ),
    "listing_roundtrip_og": _listing_sql(
        "s_suppkey", "supplier JOIN nation ON s_nationkey = n_nationkey", title="s_name", price="s_suppkey::VARCHAR", property_type="'flat'", location="n_name", rooms="s_nationkey::VARCHAR",
        price_type="'string'", rooms_type="'string'", title_path="'og:title'", images="'https://img.site-c.com/a.jpg'",
    ),
    "srcset_explode": """
        SELECT p_partkey, '/a/' || p_brand AS url, 0::BIGINT AS first_pos FROM part
        UNION ALL SELECT p_partkey, '/b/' || p_partkey, 1::BIGINT FROM part""",
    "id_coverage": """
        SELECT DISTINCT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT DISTINCT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "path_consistency": """
        WITH p AS (SELECT p_partkey, p_brand || '/' || p_name AS asset_path,
                   CASE WHEN p_partkey % 7 = 0 THEN upper(p_brand || '/' || p_name) WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand || '/' || p_name END AS analysis_path FROM part)
        SELECT * FROM p WHERE asset_path IS DISTINCT FROM analysis_path""",
    "overlay_merge": """
        SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_brand END ELSE p_name END AS name, p_type AS kind, p_size::BIGINT AS size FROM part""",
    "collision_keys": """
        SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS first_key, p_partkey > min(p_partkey) OVER (PARTITION BY lower(p_name)) AS collides FROM part""",
    "rational_parse": """
        SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_partkey % 4 <> 0 THEN p_size::DOUBLE / (p_partkey % 4) END WHEN 1 THEN p_size::DOUBLE
               WHEN 2 THEN NULL ELSE CASE WHEN p_size <> 0 THEN 30000.0::DOUBLE / p_size END END AS value FROM part""",
    "archive_names": """
        SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'traversal' WHEN 1 THEN 'absolute' WHEN 2 THEN 'backslash' WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'absolute' WHEN 5 THEN 'segment'
               WHEN 7 THEN 'name' END AS problem, p_partkey % 9 NOT IN (0, 1, 2, 4, 7) AS safe_path FROM part""",
    "text_rules": """
        WITH s AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN sha256(p_partkey::VARCHAR) WHEN 1 THEN 'sk-' || p_name ELSE p_name END AS v FROM part)
        SELECT p_partkey, left(p_name || ' ' || p_type, 14) AS title, regexp_full_match(v, '[0-9a-f]{64}') AS is_digest,
               starts_with(v, 'sk-') OR (length(v) >= 40 AND regexp_full_match(v, '[A-Za-z0-9_+./=-]+') AND len(list_distinct(string_split(v, ''))) >= 12) AS looks_secret FROM s""",
}
