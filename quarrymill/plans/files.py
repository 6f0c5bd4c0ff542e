"""Sources and sinks: each query writes files to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import learning as lrn
from quarrymill.plans.registry import Family
from quarrymill.scratch import folder
from quarrymill.sources import readers
from quarrymill.tables import load

family = Family()


def _lines(df: DataFrame, path: str, value) -> str:
    df.select(value.alias("value")).write.text(path)
    return path


@family.query("SELECT o_orderkey AS id, o_totalprice::DOUBLE AS total, o_orderpriority AS label FROM orders")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read as JSON with an explicit schema."""
    path = folder(spark, "json")
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("total"), F.col("o_orderpriority").alias("label"))
    readers.write_json(rows, path)
    return spark.read.schema("id long, total double, label string").json(path)


@family.query("SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, event_type AS event, CASE WHEN event_id % 3 <> 0 THEN event_id % 13 END AS pos, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY ALL")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log written in two appends, with lists, junk and fields of the wrong kind among its lines."""
    path = folder(spark, "lines")
    events = load(spark, sf_dir, "events").withColumn("t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    good = F.to_json(F.struct("t", F.col("event_type").alias("event"), (F.col("event_id") % 13).alias("pos")))
    wrong = F.concat(F.lit('{"t":"'), "t", F.lit('","event":"'), "event_type", F.lit('","pos":"many"}'))
    junk = F.when(F.col("event_id") % 2 == 0, F.lit("[1, 2]")).otherwise(F.lit('{"t": '))
    line = F.when(F.col("event_id") % 5 == 0, junk).when(F.col("event_id") % 3 == 0, wrong).otherwise(good)
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).select(line.alias("value")).write.mode("append").text(path)
    return readers.read_json_lines(spark, path).groupBy("t", "event", F.col("pos").cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("n"))


@family.query("SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1")
def appended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers append to one log; each adds files of its own."""
    path = folder(spark, "events")
    events = load(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("t"), F.col("user_id").cast("string").alias("job"), F.lit("s").alias("svg_sha"), F.col("event_type").alias("event"), F.lit(1).alias("pos"), F.lit(None).cast("string").alias("ranker"))
    for half in (0, 1):
        readers.append_events(events.where(F.col("job").cast("long") % 2 == half), path)
    return readers.events_from(spark, path).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@family.query("SELECT 'b' || (p_partkey % 50) AS bucket, count(*) AS attempts, count(*) FILTER (p_size > 25) AS successes, 0 AS shown, false AS veto FROM part GROUP BY 1")
def bucket_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters saved twice, the last one wins; what a record lacks is nought."""
    path = folder(spark, "buckets")
    stats = load(spark, sf_dir, "part").groupBy(F.concat(F.lit("b"), F.col("p_partkey") % 50).alias("bucket")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("p_size") > 25).alias("successes"))
    readers.save_table(stats.withColumn("attempts", F.lit(0).cast("long")), path)
    readers.save_table(stats, path)
    out = readers.load_bucket_stats(readers.load_table(spark, path))
    return out.select("bucket", "attempts", "successes", "shown", "veto")


@family.query("SELECT feature, ord, weight, mean, scale FROM (VALUES ('colours', 0, 0.5::DOUBLE, 4.0::DOUBLE, 2.0::DOUBLE), ('mae_art', 1, -0.25, 5.0, 3.0)) t(feature, ord, weight, mean, scale)")
def model_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranker saved, loaded and given out again as rows."""
    path = folder(spark, "model")
    readers.save_model(spark, {"kind": "pairwise", "features": ["colours", "mae_art"], "weights": {"colours": 0.5, "mae_art": -0.25}, "means": {"colours": 4.0, "mae_art": 5.0}, "scales": {"colours": 2.0, "mae_art": 3.0}}, path)
    return spark.createDataFrame(lrn.model_rows(readers.load_model(spark, path)), "feature string, ord int, weight double, mean double, scale double")


@family.query("SELECT 'doc' || (doc_id // 64) || '.txt' AS file, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id)) AS sha256, octet_length(encode(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id))) AS size FROM documents GROUP BY 1")
def checksum_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 64 documents each, their checksums in a sidecar table, and that table read back."""
    path, side = folder(spark, "files"), folder(spark, "sidecars")
    docs = load(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 64).alias("file")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))).alias("docs"))
    named = docs.select(F.concat(F.lit("doc"), "file", F.lit(".txt")).alias("file"), F.array_join("docs.text", "\n").alias("text"))
    named.write.partitionBy("file").option("lineSep", "\x00").text(path)
    found = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"file=([^/]+)/", 1).alias("file"), F.expr("substring(content, 1, length(content) - 1)").alias("content"))
    readers.stamp_checksums(found, side)
    return spark.read.json(side, schema="algo string, file string, sha256 string, size long").select("file", "sha256", "size")


@family.query("SELECT 'n' || n_nationkey AS key, count(*) AS files FROM nation, range(2) GROUP BY 1")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders are keys; files by pattern, their contents unread."""
    path = folder(spark, "tree")
    nations = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_name").alias("value"))
    for part in ("a", "b"):
        nations.repartition("key").write.partitionBy("key").mode("append").text(f"{path}")
    listed = readers.list_files(spark, path, "*.txt").select(F.regexp_extract("path", "key=([^/]+)/", 1).alias("key"), "length")
    return listed.groupBy("key").agg(F.count(F.lit(1)).alias("files"))


@family.query("SELECT 'n' || n_nationkey AS key FROM nation WHERE n_nationkey % 3 <> 0")
def live_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys out of lines with comments, and out of a JSON list."""
    path = folder(spark, "live")
    nations = load(spark, sf_dir, "nation").coalesce(1)
    k = F.col("n_nationkey")
    _lines(nations.where(k % 2 == 0), f"{path}/lines", F.when(k % 3 == 0, F.concat(F.lit("# n"), k)).otherwise(F.concat(F.lit("  n"), k, F.lit(" # kept"))))
    _lines(nations.where((k % 2 == 1) & (k % 3 != 0)).agg(F.to_json(F.collect_list(F.concat(F.lit("n"), k))).alias("v")), f"{path}/list", F.col("v"))
    return readers.read_live_keys(spark, f"{path}/lines").unionByName(readers.read_live_keys(spark, f"{path}/list"))


@family.query("SELECT n_name AS name, n_regionkey AS kind, n_nationkey::VARCHAR AS object FROM nation WHERE n_nationkey % 2 = 0")
def fixed_width_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "fonts")
    header = "name                     kind   object"
    n = F.col("n_nationkey")
    rows = load(spark, sf_dir, "nation").where(n % 2 == 0).select(F.concat(F.rpad("n_name", 25, " "), F.rpad(F.col("n_regionkey").cast("string"), 7, " "), n.cast("string")).alias("value"))
    spark.createDataFrame([(header,), ("-" * 20,)], "value string").unionByName(rows).write.text(path)
    got = readers.fixed_width(spark.read.text(path), header, ["name", "kind", "object"])
    return got.select("name", F.col("kind").cast("long").alias("kind"), "object")


@family.query("SELECT s_suppkey AS page, s_nationkey AS ppi FROM supplier WHERE s_suppkey % 4 <> 0")
def blank_column_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of masks are left out."""
    path = folder(spark, "images")
    s = F.col("s_suppkey")
    kind = F.when(s % 4 == 0, "smask").otherwise("image")
    _lines(load(spark, sf_dir, "supplier"), path, F.concat_ws("   ", F.lit(" "), s.cast("string"), kind, F.col("s_nationkey").cast("string")))
    got = readers.blank_columns(spark.read.text(path), ["page", "kind", "ppi"], skip=r"\bsmask\b")
    return got.select(F.col("page").cast("long").alias("page"), F.col("ppi").cast("long").alias("ppi"))


@family.query("SELECT 'Size ' || r_regionkey AS key, r_name || ': x' AS val FROM region")
def key_value_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "page")
    rows = load(spark, sf_dir, "region").select(F.concat(F.lit("  Size "), F.col("r_regionkey"), F.lit(" :  "), "r_name", F.lit(": x ")).alias("value"))
    rows.unionByName(spark.createDataFrame([("no pair here",)], "value string")).write.text(path)
    return readers.key_values(spark.read.text(path))


@family.query("SELECT count(*) AS files, count(*) FILTER (n_nationkey % 2 = 0) AS cmyk FROM nation")
def byte_pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "bytes")
    k = F.col("n_nationkey")
    rows = load(spark, sf_dir, "nation").select(k.alias("key"), F.when(k % 2 == 0, "x /DeviceCMYK y").otherwise("x /DeviceRGB y").alias("value"))
    rows.repartition("key").write.partitionBy("key").text(path)
    found = readers.byte_patterns(spark, path, {"cmyk": b"/DeviceCMYK", "rgb": b"/DeviceRGB"})
    return found.agg(F.count(F.lit(1)).alias("files"), F.count_if("cmyk").alias("cmyk"))


@family.query("SELECT 'p' || r_regionkey AS name, 0 AS ord, '#00ff0' || r_regionkey AS colour, CASE WHEN r_regionkey % 2 = 1 THEN 1 ELSE 0 END AS faults FROM region")
def palette_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes with their faulty colours counted, none dropped in silence."""
    path = folder(spark, "palettes")
    k = F.col("r_regionkey")
    colours = F.when(k % 2 == 1, F.array(F.concat(F.lit("#00FF0"), k), F.lit("green"))).otherwise(F.array(F.concat(F.lit("#00FF0"), k)))
    library = load(spark, sf_dir, "region").agg(F.collect_list(F.struct(F.concat(F.lit("p"), k).alias("name"), colours.alias("colors"))).alias("palettes"))
    readers.write_json(library.coalesce(1), path)
    good, bad = readers.read_palettes(spark, path)
    faults = bad.groupBy("name").agg(F.count(F.lit(1)).alias("faults"))
    return good.join(faults, "name", "left").select("name", F.col("ord").cast("long").alias("ord"), "colour", F.coalesce("faults", F.lit(0)).cast("long").alias("faults"))


@family.query("SELECT 'circle' AS tag, 2 AS depth, count(*) AS n FROM nation UNION ALL SELECT 'g', 1, count(*) FROM nation UNION ALL SELECT 'svg', 0, count(*) FROM nation")
def markup_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup files as elements; one with an entity and one that does not parse give no rows."""
    path = folder(spark, "markup")
    k = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><g id="'), k, F.lit('"><circle r="1"/></g></svg>'))
    rows = load(spark, sf_dir, "nation").select(k.alias("key"), body.alias("value"))
    bad = spark.createDataFrame([("x", "<svg><g></svg>"), ("y", '<!DOCTYPE svg [<!ENTITY a "b">]><svg/>')], "key string, value string")
    rows.unionByName(bad).repartition("key").write.partitionBy("key").text(path)
    found = readers.read_elements(spark, path, "*.txt")
    return found.groupBy("tag", F.col("depth").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"))
