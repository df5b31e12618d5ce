"""Queries on dates, names, metadata texts and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.functions import geometry as Y
from rasterloom.functions import metadata as M
from rasterloom.functions import times as D
from rasterloom.operators import statistics as S
from rasterloom.plans import views as V
from rasterloom.plans.catalogue import register


@register("date_range", f"SELECT DISTINCT date, CAST(unnest(generate_series(date, date + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM {V.STACK_ORD}")
def _(spark, d):
    return V.stack_ord(spark, d).select("date").distinct().select("date", F.explode(D.date_range(F.col("date"), F.date_add("date", 3))).alias("day"))


@register("date_range_empty", f"SELECT date, CAST(0 AS INTEGER) AS n FROM (SELECT DISTINCT date FROM {V.STACK_ORD})")
def _(spark, d):
    return V.stack_ord(spark, d).select("date").distinct().select("date", F.size(D.date_range(F.col("date"), F.date_sub("date", 2))).alias("n"))


@register("next_prev", f"SELECT DISTINCT date, CAST(date + INTERVAL 1 DAY AS DATE) AS next, CAST(date - INTERVAL 1 DAY AS DATE) AS prev, strftime(date, '%Y-%m-%d') AS iso FROM {V.STACK_ORD}")
def _(spark, d):
    t = V.stack_ord(spark, d).select("date").distinct()
    return t.select("date", D.next_date(F.col("date")).alias("next"), D.prev_date(F.col("date")).alias("prev"), D.to_iso(F.col("date")).alias("iso"))


@register("doy_to_date", f"SELECT DISTINCT strftime(date, '%Y%j') AS dn, strftime(date, '%Y%m%d') AS ymd FROM {V.STACK_ORD}")
def _(spark, d):
    t = V.stack_ord(spark, d).select("date").distinct().select(F.date_format("date", "yyyyDDD").alias("dn"))
    return t.select("dn", D.day_of_year_date(F.col("dn")).alias("ymd"))


@register("beijing_window", f"SELECT DISTINCT date, strftime(CAST(date AS TIMESTAMP) - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') AS start, strftime(CAST(date AS TIMESTAMP) + INTERVAL 15 HOUR, '%Y-%m-%dT%H:%M:%S') AS stop FROM {V.STACK_ORD}")
def _(spark, d):
    a, b = D.beijing_window(F.col("date"))
    return V.stack_ord(spark, d).select("date").distinct().select("date", a.alias("start"), b.alias("stop"))


@register("parse_time", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS iso FROM orders")
def _(spark, d):
    o = V.table(spark, d, "orders")
    s = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select(F.col("o_orderkey").alias("id"), D.parse_time(s).alias("iso"))


@register("iso_to_date", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderkey % 3 <> 0 AS valid FROM orders")
def _(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("s"))
    return o.select(F.col("o_orderkey").alias("id"), D.iso_date(F.col("s")).alias("day"), D.is_time(F.when(F.col("o_orderkey") % 3 == 0, "no time").otherwise(F.col("s"))).alias("valid"))


_NAME = "CASE id % 8 WHEN 0 THEN 'SV1_P1.img' WHEN 1 THEN 'x_M2.img' WHEN 2 THEN 'a_P2AS.TIL' WHEN 3 THEN 'GF7_BWD.tif' WHEN 4 THEN name || '_MUX_.tif' WHEN 5 THEN 'navp_' || name || '.tiff' WHEN 6 THEN 'bj3_browser.tif' ELSE name || '.TIF' END"


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(f, '{w}')" for w in words) + ")"


@register("image_type", f"SELECT id, CASE WHEN ends_with(f, 'browser.tif') THEN NULL WHEN starts_with(f, 'SV') THEN CASE WHEN regexp_matches(f, 'P[12]\\.img$') THEN 'pan' WHEN regexp_matches(f, 'M[12]\\.img$') THEN 'mss' END WHEN ends_with(f, 'TIL') THEN CASE WHEN contains(f, 'P2AS') THEN 'pan' WHEN contains(f, 'M2AS') THEN 'mss' END WHEN starts_with(upper(f), 'GF7') THEN CASE WHEN contains(f, 'BWD') THEN 'pan' WHEN contains(f, 'MUX') THEN 'mss' END WHEN {_any(M.PAN_WORDS)} THEN 'pan' WHEN {_any(M.MSS_WORDS)} THEN 'mss' END AS kind FROM (SELECT id, {_NAME} AS f FROM {V.NAME_PART})")
def _(spark, d):
    return V.name_part(spark, d).select("id", F.expr(_NAME).alias("f")).select("id", M.image_type(F.col("f")).alias("kind"))


@register("image_list", f"SELECT id, f, {_any(M.LIST_MSS)} AS mss, CASE WHEN starts_with(f, 'GF7') THEN contains(f, '_BWD_') ELSE {_any(M.LIST_PAN)} END AS pan FROM (SELECT id, {_NAME} AS f FROM {V.NAME_PART}) WHERE regexp_matches(f, '\\.(tif|img|tiff|TIF|IMG|TIFF)$') AND NOT (regexp_matches(lower(f), '^(bj3|triplesat)') AND ends_with(f, 'browser.tif'))")
def _(spark, d):
    t = V.name_part(spark, d).select("id", F.expr(_NAME).alias("f"))
    f = F.col("f")
    return t.where(M.is_image(f)).select("id", "f", M.is_image(f, "mss").alias("mss"), M.is_image(f, "pan").alias("pan"))


_XML = "concat('<Meta><SatelliteID>GF', CAST(1 + id % 2 AS VARCHAR), '</SatelliteID><SensorID>S', CAST(id % 4 AS VARCHAR), '</SensorID><TopLeftLatitude>', CAST(id % 50 AS VARCHAR), '.5</TopLeftLatitude><TopLeftLongitude>', CAST(id % 90 AS VARCHAR), '</TopLeftLongitude><TopRightLatitude>', CAST(id % 51 AS VARCHAR), '</TopRightLatitude><TopRightLongitude>', CAST(id % 91 AS VARCHAR), '</TopRightLongitude><BottomRightLatitude>', CAST(id % 49 AS VARCHAR), '</BottomRightLatitude><BottomRightLongitude>', CAST(id % 92 AS VARCHAR), '</BottomRightLongitude><BottomLeftLatitude>', CAST(id % 48 AS VARCHAR), '</BottomLeftLatitude><BottomLeftLongitude>', CAST(id % 89 AS VARCHAR), '</BottomLeftLongitude></Meta>')"
_SCENES = f"(SELECT id, {_XML} AS xml FROM {V.NAME_PART})"


def scenes(spark, d):
    return V.name_part(spark, d).select("id", F.expr(_XML.replace("VARCHAR", "STRING")).alias("xml"))


@register("meta_xml_fields", f"SELECT id, regexp_extract(xml, '<SatelliteID>([^<]*)<', 1) AS sat, regexp_extract(xml, '<SensorID>([^<]*)<', 1) AS sensor, CAST(NULL AS VARCHAR) AS received FROM {_SCENES}")
def _(spark, d):
    return scenes(spark, d).select("id", *M.scene_fields(F.col("xml"))).select("id", F.col("SatelliteID").alias("sat"), F.col("SensorID").alias("sensor"), F.col("ReceiveTime").alias("received"))


_N = [f"CAST(regexp_extract(xml, '<{c}{{}}>([^<]*)<', 1) AS DOUBLE)" for c in ("TopLeft", "TopRight", "BottomRight", "BottomLeft")]


@register("scene_bounds", "SELECT id, " + ", ".join(f"{f}({', '.join(n.format(k) for n in _N)}) AS {a}" for f, k, a in (("least", "Longitude", "xmin"), ("least", "Latitude", "ymin"), ("greatest", "Longitude", "xmax"), ("greatest", "Latitude", "ymax"))) + f" FROM {_SCENES}")
def _(spark, d):
    return scenes(spark, d).select("id", *[c.alias(n) for c, n in zip(M.scene_box(F.col("xml")), ("xmin", "ymin", "xmax", "ymax"))])


@register("scene_bounds_gf7", f"SELECT id, CAST(id % 80 AS DOUBLE) AS xmin, CAST(id % 40 AS DOUBLE) AS ymin, id % 80 + 2.0::DOUBLE AS xmax, id % 40 + 1.0::DOUBLE AS ymax FROM {V.NAME_PART}")
def _(spark, d):
    point = lambda n, dx, dy: f"<{n}Point><Longtitude>', CAST(id % 80 + {dx} AS STRING), '</Longtitude><Latitude>', CAST(id % 40 + {dy} AS STRING), '</Latitude></{n}Point>"
    xml = F.expr("concat('" + point("LeftTop", 0, 1) + point("RightTop", 2, 1) + point("RightBottom", 2, 0) + point("LeftBottom", 0, 0) + "')")
    return V.name_part(spark, d).select("id", *[c.alias(n) for c, n in zip(M.scene_box(xml, True), ("xmin", "ymin", "xmax", "ymax"))])


@register("metadata_paths", f"SELECT id, CASE id % 3 WHEN 0 THEN 'd/GF6_WFV_' || id || '.xml' WHEN 1 THEN 'gf7_' || id || '.xml' ELSE 'd/' || name || '.xml' END AS path FROM {V.NAME_PART}")
def _(spark, d):
    p = F.expr("CASE id % 3 WHEN 0 THEN concat('d/GF6_WFV_', id, '-1.tiff') WHEN 1 THEN concat('gf7_', id, '.tif') ELSE concat('d/', name, '.tiff') END")
    return V.name_part(spark, d).select("id", M.metadata_path(p).alias("path"))


@register("only_rgb", f"SELECT id, '<a><OnlyRGB>true</OnlyRGB></a>' AS xml FROM {V.NAME_PART}")
def _(spark, d):
    return V.name_part(spark, d).select("id", M.only_rgb(F.concat(F.lit("<a><OnlyRGB>"), F.col("id").cast("string"), F.lit("</OnlyRGB></a>"))).alias("xml"))


@register("epsg_from_gml", f"SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE 'EPSG:' || CAST(32600 + id % 60 AS VARCHAR) END AS epsg FROM {V.NAME_PART}")
def _(spark, d):
    gml = F.when(F.col("id") % 5 == 0, "<x/>").otherwise(F.concat(F.lit('<gml:Envelope srsName="urn:ogc:def:crs:EPSG:8.7:'), (32600 + F.col("id") % 60).cast("string"), F.lit('">')))
    return V.name_part(spark, d).select("id", M.epsg_of_gml(gml).alias("epsg"))


@register("atmcorr_parse", f"SELECT id, (id % 100) / 100.0::DOUBLE AS trans, CAST(substr(CAST(id % 9 AS VARCHAR) || '.4567', 1, 4) AS DOUBLE) AS up, CAST(substr(CAST(id % 7 AS VARCHAR) || '.1299', 1, 4) AS DOUBLE) AS down FROM {V.NAME_PART}")
def _(spark, d):
    report = F.format_string("<p><br>Band average atmospheric transmission:    %s<br>Effective bandpass upwelling radiance:   %s W/m^2<br>Effective bandpass downwelling radiance:  %s W<br>", ((F.col("id") % 100) / 100.0).cast("string"), F.concat((F.col("id") % 9).cast("string"), F.lit(".4567")), F.concat((F.col("id") % 7).cast("string"), F.lit(".1299")))
    return V.name_part(spark, d).select("id", *[c.alias(n) for c, n in zip(M.atmosphere(report), ("trans", "up", "down"))])


@register("catalog_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS cloud, 'P' || event_id AS product FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) <= 50")
def _(spark, d):
    e = V.table(spark, d, "events")
    feature = F.from_json(F.concat(F.lit('{"features":[{"properties":{"productIdentifier":"P'), F.col("event_id").cast("string"), F.lit('","cloudCover":'), F.get_json_object("props", "$.k"), F.lit("}}]}")), "features array<struct<properties: struct<productIdentifier: string, cloudCover: int>>>")
    f = e.select("event_id", F.explode(feature["features"]).alias("f")).select("event_id", F.col("f.properties.cloudCover").alias("cloud"), F.col("f.properties.productIdentifier").alias("product"))
    return f.where(F.col("product").isNotNull() & (F.col("cloud") <= 50))


@register("catalog_filter_desc", "SELECT id, n FROM (SELECT event_id AS id, CAST(json_extract(props, '$.k') AS INTEGER) AS n FROM events WHERE starts_with(event_type, 'c') AND ts > TIMESTAMP '2000-01-01') ORDER BY n DESC, id LIMIT 25")
def _(spark, d):
    e = V.table(spark, d, "events").where(F.col("event_type").startswith("c") & (F.col("ts") > F.lit("2000-01-01").cast("timestamp_ntz")))
    return e.select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("n")).orderBy(F.desc("n"), "id").limit(25)


@register("atom_entries", f"SELECT id, 'S2_' || id AS title, CAST(id % 100 AS DOUBLE) AS cloud FROM {V.NAME_PART} WHERE id % 4 <> 0")
def _(spark, d):
    entry = F.concat(F.lit("<entry><title>S2_"), F.col("id").cast("string"), F.lit('</title><double name="cloudcoverpercentage">'), (F.col("id") % 100).cast("string"), F.lit("</double></entry>"))
    feed = F.concat(F.lit("<feed>"), F.when(F.col("id") % 4 == 0, F.concat(entry, entry)).otherwise(entry), F.lit("</feed>"))
    t = V.name_part(spark, d).select("id", feed.alias("x")).where(F.size(F.xpath("x", F.lit("feed/entry/title/text()"))) == 1)
    return t.select("id", F.xpath_string("x", F.lit("feed/entry/title")).alias("title"), F.xpath_double("x", F.lit("feed/entry/double[@name='cloudcoverpercentage']")).alias("cloud"))


@register("preview_names", f"SELECT id, printf('S2_C%02d_T%s_D%s.jpg', CAST(id % 100 AS INTEGER), '50TMK', '20180602') AS name, '50TMK' AS tile, '20180602' AS day FROM {V.NAME_PART}")
def _(spark, d):
    product = F.lit("S2A_MSIL1C_20180602T025551_N0206_R032_T50TMK_20180602T055043")
    name = M.preview_name(product, F.col("id") % 100)
    t = V.name_part(spark, d).select("id", name.alias("name"))
    return t.select("id", "name", *[c.alias(n) for c, n in zip(M.preview_fields(F.col("name"))[1:], ("tile", "day"))])


@register("mgrs_tiles", f"SELECT id, '5' || (id % 10) || 'QCE' AS tile FROM {V.NAME_PART}")
def _(spark, d):
    product = F.concat(F.lit("S2A_MSIL1C_20180602T025551_N0206_R032_T5"), (F.col("id") % 10).cast("string"), F.lit("QCE_20180602T055043.SAFE"))
    return V.name_part(spark, d).select("id", M.mgrs_tile(product).alias("tile"))


@register("aws_tile_urls", f"SELECT DISTINCT date, b, 'http://sentinel-s2-l1c.s3.amazonaws.com/tiles/49/Q/CE/' || year(date) || '/' || month(date) || '/' || day(date) || '/0/' || b AS url FROM {V.STACK_ORD}, (VALUES ('B02.jp2'), ('tileInfo.json')) t(b)")
def _(spark, d):
    t = V.stack_ord(spark, d).select("date").distinct().withColumn("b", F.explode(F.array(F.lit("B02.jp2"), F.lit("tileInfo.json"))))
    return t.select("date", "b", M.aws_tile_url(F.lit("49QCE"), F.col("date"), F.col("b")).alias("url"))


@register("landsat_urls", f"SELECT id, s, 'https://landsat-pds.s3.amazonaws.com/c1/L8/' || substr(s, 11, 3) || '/' || substr(s, 14, 3) || '/' || s || '/' || s || '_B4.TIF' AS url FROM (SELECT id, 'LC08_L1TP_' || lpad(CAST(113 + id % 39 AS VARCHAR), 3, '0') || lpad(CAST(23 + id % 27 AS VARCHAR), 3, '0') || '_20180722_20180731_01_T1' AS s FROM {V.NAME_PART})")
def _(spark, d):
    s = F.concat(F.lit("LC08_L1TP_"), M.path_row(113 + F.col("id") % 39, 23 + F.col("id") % 27), F.lit("_20180722_20180731_01_T1"))
    return V.name_part(spark, d).select("id", s.alias("s")).select("id", "s", M.aws_scene_url(F.col("s"), F.lit("B4")).alias("url"))


@register("byte_ranges", f"SELECT id, CAST(n AS INTEGER) AS n, CASE WHEN n > 1 THEN 'bytes=0-' || CAST(CAST(trunc(len / n) AS BIGINT) AS VARCHAR) END AS first FROM (SELECT id, len, CASE WHEN len / 5.0::DOUBLE < 100000 THEN trunc(len / 100000.0::DOUBLE) ELSE 5 END AS n FROM (SELECT id, CAST(50000 + id * 997 AS DOUBLE) AS len FROM {V.NAME_PART}))")
def _(spark, d):
    t = V.name_part(spark, d).select("id", (50000 + F.col("id") * 997).alias("len")).withColumn("r", M.byte_ranges(F.col("len")))
    n = F.when(F.col("len") / 5.0 < 100000, (F.col("len") / 100000.0).cast("int")).otherwise(5)
    return t.select("id", n.alias("n"), F.get("r", F.lit(0)).alias("first"))


@register("basic_auth", f"SELECT id, 'Basic ' || base64(encode('user' || id || ':word')) AS auth FROM {V.NAME_PART}")
def _(spark, d):
    return V.name_part(spark, d).select("id", M.basic_authorization(F.concat(F.lit("user"), F.col("id").cast("string")), F.lit("word")).alias("auth"))


@register("listing_scan", "SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n FROM pages")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(<p>)"))).cast("long").alias("n"))


_CELL = "SELECT DISTINCT CAST(c_custkey * 7 % 500 AS INTEGER) AS x, CAST(c_custkey * 13 % 300 AS INTEGER) AS y FROM customer"


@register("missing_tiles", f"SELECT x, y FROM ({_CELL}) WHERE (x + y) % 3 <> 0")
def _(spark, d):
    """Tiles of customers that aren't among the names of those that are there."""
    k = F.col("c_custkey")
    wanted = V.table(spark, d, "customer").select((k * 7 % 500).cast("int").alias("x"), (k * 13 % 300).cast("int").alias("y")).distinct()
    there = wanted.where("(x + y) % 3 = 0").select(F.format_string("x=%d&y=%d&z=10", "x", "y").alias("name"))
    x, y, _z = M.tile_of_name(F.col("name"))
    return wanted.join(there.select(x.alias("x"), y.alias("y")), ["x", "y"], "left_anti")


@register("group_files", f"SELECT 'A' || (2000 + id % 20) AS key, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS files FROM {V.NAME_PART} GROUP BY 1")
def _(spark, d):
    t = V.name_part(spark, d).select("id", F.concat(F.lit("MOD13."), F.concat(F.lit("A"), (2000 + F.col("id") % 20).cast("string")), F.lit(".h26v04.hdf")).alias("f"))
    return t.groupBy(M.group_key(F.col("f")).alias("key")).agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string"))).alias("files"))


@register("group_by_longitude", f"SELECT CAST(100 + id % 9 AS VARCHAR) AS lon, count(*) AS n FROM {V.NAME_PART} GROUP BY 1")
def _(spark, d):
    t = V.name_part(spark, d).select(M.longitude_token(F.concat(F.lit("GF_E"), (100 + F.col("id") % 9).cast("string"), F.lit("N20"))).alias("lon"))
    return t.groupBy("lon").agg(F.count("*").alias("n"))


@register("rle_bbox", f"SELECT id, (x0 + x1) / 1536.0::DOUBLE AS xc, (y0 + y1) / 1536.0::DOUBLE AS yc, (y1 - y0) / 768.0::DOUBLE AS h, (x1 - x0) / 768.0::DOUBLE AS w FROM (SELECT id, least((s - 1) // 768, s // 768) AS x0, greatest((s + 9) // 768, (s + 20) // 768) AS x1, CASE WHEN greatest((s - 1) % 768 + 10, s % 768 + 20) > 768 THEN 0 ELSE least((s - 1) % 768, s % 768) END AS y0, CASE WHEN greatest((s - 1) % 768 + 10, s % 768 + 20) > 768 THEN 768 ELSE greatest((s - 1) % 768 + 10, s % 768 + 20) END AS y1 FROM (SELECT id, 1 + (id * 7919) % 500000 AS s FROM {V.NAME_PART}))")
def _(spark, d):
    s = 1 + (F.col("id") * 7919) % 500000
    rle = F.concat_ws(" ", s.cast("string"), F.lit("10"), (s + 1).cast("string"), F.lit("20"))
    box = Y.rle_box(rle)
    return V.name_part(spark, d).select("id", box[0].alias("xc"), box[1].alias("yc"), box[2].alias("h"), box[3].alias("w"))


@register("stratified_sample", f"SELECT id, class FROM (SELECT id, id % 7 AS class, row_number() OVER (PARTITION BY id % 7 ORDER BY md5(CAST(id AS VARCHAR)), id) AS r FROM {V.NAME_PART}) WHERE r <= 20")
def _(spark, d):
    t = V.name_part(spark, d).select("id", (F.col("id") % 7).alias("class"))
    w = Window.partitionBy("class").orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id")
    return t.withColumn("r", F.row_number().over(w)).where("r <= 20").select("id", "class")


@register("cxcywh_to_xyxy", f"SELECT id, ((id % 10) / 10.0::DOUBLE - 0.1::DOUBLE / 2) * 256 AS x1, ((id % 8) / 8.0::DOUBLE - 0.2::DOUBLE / 2) * 256 AS y1, ((id % 10) / 10.0::DOUBLE + 0.1::DOUBLE / 2) * 256 AS x2, ((id % 8) / 8.0::DOUBLE + 0.2::DOUBLE / 2) * 256 AS y2 FROM {V.NAME_PART}")
def _(spark, d):
    c = Y.centre_to_corners((F.col("id") % 10) / 10.0, (F.col("id") % 8) / 8.0, F.lit(0.1), F.lit(0.2))
    return V.name_part(spark, d).select("id", *[x.alias(n) for x, n in zip(c, ("x1", "y1", "x2", "y2"))])


@register("interleave_corners", f"SELECT id, concat_ws(',', id, id + 4, id + 1, id + 5, id + 2, id + 6, id + 3, id + 7) AS c FROM {V.NAME_PART}")
def _(spark, d):
    return V.name_part(spark, d).select("id", F.concat_ws(",", Y.interleaved(F.sequence(F.col("id"), F.col("id") + 7)).cast("array<string>")).alias("c"))


@register("points_to_bbox", f"SELECT id, CAST(id AS DOUBLE) AS x1, 1.0::DOUBLE AS y1, id + 5.0::DOUBLE AS x2, 9.5::DOUBLE AS y2 FROM {V.NAME_PART}")
def _(spark, d):
    pts = F.array(F.concat(F.col("id").cast("string"), F.lit(", 9.5")), F.concat((F.col("id") + 5).cast("string"), F.lit(", 1")))
    return V.name_part(spark, d).select("id", *[c.alias(n) for c, n in zip(Y.points_box(pts), ("x1", "y1", "x2", "y2"))])


@register("tie_merge", f"SELECT lpad(CAST(row_number() OVER (ORDER BY id) AS VARCHAR), 5, ' ') AS n, id FROM {V.NAME_PART} WHERE id % 3 <> 2")
def _(spark, d):
    """Numbers in order without one task for all rows: what comes before a range of ids is summed over ever wider ranges."""
    t = V.name_part(spark, d).select("id")
    both = t.where("id % 3 = 0").unionByName(t.where("id % 3 = 1"))
    return S.numbered(both, "id", "r").select(F.lpad(F.col("r").cast("string"), 5, " ").alias("n"), "id")


@register("label_join", "SELECT p_partkey AS id, 1 + p_partkey % 5 AS label FROM part WHERE p_partkey % 4 <> 0")
def _(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    labels = p.where("id % 4 <> 0").select("id", (1 + F.col("id") % 5).alias("label"))
    return p.join(labels, "id")


@register("calibration_json", f"SELECT id, 'PMS' || (id % 3) AS sensor, CAST(2010 + id % 4 AS VARCHAR) AS year, (id % 11) / 10.0::DOUBLE AS gain FROM {V.NAME_PART}")
def _(spark, d):
    text = F.format_string('{"GF1": {"PMS%d": {"%d": {"gain": [%s]}}}}', F.col("id") % 3, 2010 + F.col("id") % 4, ((F.col("id") % 11) / 10.0).cast("string"))
    m = F.from_json(text, "map<string, map<string, map<string, struct<gain: array<double>>>>>")
    t = V.name_part(spark, d).select("id", F.explode(m["GF1"]).alias("sensor", "years")).select("id", "sensor", F.explode("years").alias("year", "v"))
    return t.select("id", "sensor", "year", F.col("v.gain")[0].alias("gain"))


@register("centroid_json", f"SELECT id, '{{\"lat\":' || CAST(id % 90 AS VARCHAR) || ',\"lon\":' || CAST(id % 180 AS VARCHAR) || '}}' AS json FROM {V.NAME_PART}")
def _(spark, d):
    return V.name_part(spark, d).select("id", F.to_json(F.struct((F.col("id") % 90).alias("lat"), (F.col("id") % 180).alias("lon"))).alias("json"))


@register("ship_balance", f"SELECT k AS n_ships, count(*) AS n FROM (SELECT img, k, row_number() OVER (PARTITION BY k ORDER BY md5(CAST(img AS VARCHAR)), img) AS r FROM (SELECT id % 400 AS img, CAST(sum(CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS k FROM {V.NAME_PART} GROUP BY 1)) WHERE r <= 100 GROUP BY k")
def _(spark, d):
    t = V.name_part(spark, d).groupBy((F.col("id") % 400).alias("img")).agg(F.sum(F.when(F.col("id") % 3 == 0, 0).otherwise(1)).alias("k"))
    w = Window.partitionBy("k").orderBy(F.md5(F.col("img").cast("string").cast("binary")), "img")
    return t.withColumn("r", F.row_number().over(w)).where("r <= 100").groupBy(F.col("k").alias("n_ships")).agg(F.count("*").alias("n"))


_DAY = "(SELECT DISTINCT year(o_orderdate) AS y, dayofyear(o_orderdate) AS n FROM orders)"
_TAIL = "'.1234.061.2018159163511.hdf'"


def _days(spark, d):
    return V.table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.dayofyear("o_orderdate").alias("n")).distinct()


@register("listing_aerosol", f"SELECT y, n, '/archive/allData/61/MYD04_3K/' || y || '/' || n || '/MYD04_3K.A' || y || n || {_TAIL} AS path FROM {_DAY} WHERE n % 3 <> 0")
def _(spark, d):
    """The day's files in a listing that also has files of another product, and of no day."""
    start = F.concat(F.lit("/archive/allData/61/MYD04_3K/"), F.col("y").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("/MYD04_3K.A"), F.col("y").cast("string"), F.col("n").cast("string"))
    page = F.concat(F.lit('<a href="/archive/allData/61/MOD04_3K/1/x.hdf">x</a>'), F.when(F.col("n") % 3 != 0, F.concat(F.lit('<a href="'), start, F.lit('.1234.061.2018159163511.hdf">f</a>'))).otherwise(F.lit("")))
    return _days(spark, d).select("y", "n", F.explode(M.aerosol_files(page, F.col("y"), F.col("n"))).alias("path"))


@register("listing_temperature", f"SELECT y, n, '/archive/allData/6/MYD11A1/' || y || '/' || n || '/MYD11A1.A' || y || n || '.h2' || h || 'v04.006.2018159163511.hdf' AS path FROM {_DAY}, range(6, 8) t(h)")
def _(spark, d):
    """Cells h26 and h27 of row 4 alone, of listings with cells h25 to h28."""
    text = lambda c: F.col(c).cast("string")
    line = lambda h: F.concat(F.lit('<a href="/archive/allData/6/MYD11A1/'), text("y"), F.lit("/"), text("n"), F.lit("/MYD11A1.A"), text("y"), text("n"), F.lit(f'.h{h}v04.006.2018159163511.hdf">'))
    page = F.concat(*[line(h) for h in (25, 26, 27, 28)])
    return _days(spark, d).select("y", "n", F.explode(M.temperature_files(page, F.col("y"), F.col("n"), True)).alias("path"))


@register("scenes_of_tile", f"SELECT id, 'L1C_T' || CASE WHEN id % 3 = 0 THEN '50TMK' ELSE '50TLK' END || '_A015373' AS display FROM {V.NAME_PART} WHERE id % 3 = 0")
def _(spark, d):
    t = V.name_part(spark, d).select("id", F.concat(F.lit("L1C_T"), F.when(F.col("id") % 3 == 0, "50TMK").otherwise("50TLK"), F.lit("_A015373")).alias("display"))
    return t.where(M.of_tile(F.col("display"), F.lit("50TMK")))


@register("clear_scene_urls", f"SELECT id, 'https://code-de.org/download/' || name || '.SAFE.zip' AS url FROM {V.NAME_PART} WHERE id % 100 < 30")
def _(spark, d):
    """Archives of the products whose cloud cover, in percent, is below the most that is wanted."""
    t = V.name_part(spark, d).withColumn("cover", (F.col("id") % 100).cast("string").cast("double")).where("cover < 30")
    return t.select("id", M.scene_archive(F.lit("https://code-de.org/download/"), F.col("name")).alias("url"))


@register("stated_extent", f"SELECT id, CAST(k AS INTEGER) AS k, CASE k WHEN 0 THEN id / 10.0::DOUBLE ELSE id % 90 END AS v FROM {V.NAME_PART}, range(0, 2) t(k)")
def _(spark, d):
    abstract = F.concat(F.lit(" "), (F.col("id") / 10).cast("string"), F.lit("  "), (F.col("id") % 90).cast("string"), F.lit(" "))
    return V.name_part(spark, d).select("id", F.posexplode(M.stated_extent(abstract)).alias("k", "v"))


@register("split_by_crs", f"SELECT id, CASE WHEN id % 4 = (SELECT min(id) FROM {V.NAME_PART}) % 4 THEN 1 ELSE 2 END AS part FROM {V.NAME_PART}")
def _(spark, d):
    """Datasets of the first one's reference system, and the others."""
    t = V.name_part(spark, d).select("id", F.concat(F.lit("EPSG:326"), (F.col("id") % 4).cast("string")).alias("crs"))
    first = t.agg(F.min_by("crs", "id").alias("first"))
    return t.join(F.broadcast(first), F.lit(True)).select("id", F.when(F.col("crs") == F.col("first"), 1).otherwise(2).alias("part"))


@register("image_pairs", f"SELECT id, kind, name || '_' || kind || '.tif' AS file FROM {V.NAME_PART}, (VALUES ('PAN'), ('MSS')) t(kind)")
def _(spark, d):
    """Both files of each pair of a JSON list."""
    pairs = V.name_part(spark, d).select("id", F.to_json(F.struct(F.concat("name", F.lit("_PAN.tif")).alias("pan_file"), F.concat("name", F.lit("_MSS.tif")).alias("mss_file"))).alias("j"))
    pair = pairs.select("id", F.from_json("j", "pan_file string, mss_file string").alias("p"))
    return pair.select("id", F.explode(F.create_map(F.lit("PAN"), F.col("p.pan_file"), F.lit("MSS"), F.col("p.mss_file"))).alias("kind", "file"))


@register("bucket_folders", f"SELECT id, 's3://landsat-pds/c1/L8/' || substr(s, 11, 3) || '/' || substr(s, 14, 3) || '/' || s || '/' AS s3, 'gs://gcp-public-data-landsat/LC08/01/' || substr(s, 11, 3) || '/' || substr(s, 14, 3) || '/' || s || '/' AS gs FROM (SELECT id, 'LC08_L1TP_' || lpad(CAST(113 + id % 39 AS VARCHAR), 3, '0') || lpad(CAST(23 + id % 27 AS VARCHAR), 3, '0') || '_20170304_20170316_01_T1' AS s FROM {V.NAME_PART})")
def _(spark, d):
    s = F.concat(F.lit("LC08_L1TP_"), M.path_row(113 + F.col("id") % 39, 23 + F.col("id") % 27), F.lit("_20170304_20170316_01_T1"))
    return V.name_part(spark, d).select("id", M.scene_folder(s).alias("s3"), M.scene_folder(s, "gs").alias("gs"))


@register("bucket_listing", f"SELECT id, 'S2A_2020' || lpad(CAST(1 + id % 12 AS VARCHAR), 2, '0') || '11.SAFE' AS product FROM {V.NAME_PART} WHERE id % 12 = 9 AND id % 5 <> 0")
def _(spark, d):
    """Products of a month in a listing of a tile; what lies in their folders isn't shown."""
    product = F.concat(F.lit("S2A_2020"), F.lpad((1 + F.col("id") % 12).cast("string"), 2, "0"), F.lit("11.SAFE"))
    key = F.concat(F.lit("gs://gcp-public-data-sentinel-2/tiles/50/S/MJ/"), product, F.when(F.col("id") % 5 == 0, "/GRANULE").otherwise(""))
    return V.name_part(spark, d).where(M.is_listed(key, "gs://gcp-public-data-sentinel-2/tiles/50/S/MJ/*202010*")).select("id", product.alias("product"))


@register("hour_later", "SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') AS t FROM orders")
def _(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), D.to_iso(F.col("o_orderdate").cast("timestamp_ntz") + D.one_hour(), False).alias("t"))
