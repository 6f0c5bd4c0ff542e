"""Readers and writers.  Everything goes through Spark's own file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.schemas import EVENT

JOB_KEY = r"([^/]+)/[^/]*$"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file; bad input raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def tolerant(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of the lines that are JSON objects; a field of the wrong kind becomes null,
    anything else on a line is passed over."""
    objects = lines.where(F.coalesce(F.schema_of_variant(F.try_parse_json(column)), F.lit("")).startswith("OBJECT"))
    return objects.select(F.from_json(column, schema).alias("_row"), *[c for c in lines.columns if c != column]).select("_row.*", *[c for c in lines.columns if c != column])


def read_json_lines(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    return tolerant(spark.read.text(path), schema)


def read_json_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files as one document each; missing or bad ones give no row."""
    return tolerant(spark.read.text(path, wholetext=True), schema)


def append_events(events: DataFrame, path: str) -> None:
    """Append-only log: each batch adds files of its own, so writers never meet."""
    events.write.mode("append").json(path)


def events_from(spark: SparkSession, source) -> DataFrame:
    """A DataFrame, a path, rows, or nothing."""
    if source is None:
        return spark.createDataFrame([], EVENT)
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return read_json_lines(spark, source)
    return spark.createDataFrame(list(source), EVENT)


def save_table(df: DataFrame, path: str) -> None:
    """A keyed store is a folder of versions: each save writes a new one beside the others and
    is taken up by its marker of success, so a reader never sees half a table."""
    versions = _versions(df.sparkSession, path)
    df.write.parquet(f"{path}/v{max(versions, default=-1) + 1:08d}")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of a keyed store."""
    whole = [v for v, done in _versions(spark, path).items() if done]
    if not whole:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{max(whole):08d}")


def _versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """Versions of a store, and whether each is whole."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    return {int(n[1:]): fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")) for n in names if n[1:].isdigit()}


def load_bucket_stats(source: DataFrame) -> DataFrame:
    """Counters with defaults for the columns and values that a store lacks."""
    from pyspark.sql.types import _parse_datatype_string

    from quarrymill.schemas import BUCKET

    fields = _parse_datatype_string(BUCKET).fields
    raw = source.select(*((F.col(f.name) if f.name in source.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    zero = {c: 0 for c, kind in raw.dtypes if kind == "bigint"}
    return raw.fillna(zero).fillna({"veto": False})


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    from quarrymill.operators.learning import model_rows
    from quarrymill.schemas import MODEL

    save_table(spark.createDataFrame(model_rows(model), MODEL), path)


def load_model(spark: SparkSession, path: str) -> dict:
    from quarrymill.operators.learning import model_of

    return model_of(load_table(spark, path).collect())  # a row for each feature


def checksums(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file, algo, sha256, size, t`` of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), F.lit("sha256").alias("algo"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("t"))


def stamp_checksums(files: DataFrame, path: str) -> None:
    """A sidecar line for each file (``file, content``): algorithm, digest, size and time."""
    stamped = files.select(F.lit("sha256").alias("algo"), "file", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("t"))
    stamped.write.mode("append").json(path)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Metadata of a folder tree, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", "modificationTime", F.regexp_extract("path", JOB_KEY, 1).alias("key"))


def tree_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("key").agg(F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))


def read_live_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys from a JSON list or from lines with # comments."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "array<string>")
    lines = F.transform(F.split("value", "\n"), lambda s: F.trim(F.regexp_replace(s, "#.*$", "")))
    keys = F.when(F.ltrim("value").startswith("["), listed).otherwise(lines)
    return text.select(F.explode(keys).alias("key")).where("key <> ''").distinct()


def read_palettes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``name, ord, colour`` of a palette library, and those entries whose colour is no #rrggbb."""
    raw = read_json(spark, path, "palettes array<struct<name: string, colors: array<string>>>")
    each = raw.select(F.explode("palettes").alias("p")).select("p.name", F.posexplode("p.colors").alias("ord", "colour"))
    plain = F.coalesce(F.col("colour").rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False))
    return each.where(plain).withColumn("colour", F.lower("colour")), each.where(~plain)


def fixed_width(lines: DataFrame, header: str, columns: list[str]) -> DataFrame:
    """A report whose columns begin where the header's words do."""
    starts = [header.index(c) for c in columns] + [len(header) + 1000]
    cut = [F.trim(F.substring("value", a + 1, b - a)).alias(c) for c, a, b in zip(columns, starts, starts[1:], strict=False)]
    return lines.where((F.col("value") != header) & ~F.col("value").rlike("^[- ]*$")).select(*cut)


def blank_columns(lines: DataFrame, columns: list[str], skip: str | None = None) -> DataFrame:
    """A report of columns between blanks; rows that match ``skip`` are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    kept = lines.where(F.size(parts) >= len(columns))
    kept = kept.where(~F.col("value").rlike(skip)) if skip else kept
    return kept.select(*(F.get(parts, i).alias(c) for i, c in enumerate(columns)))


def key_values(lines: DataFrame) -> DataFrame:
    pattern = r"^\s*([^:]+?)\s*:\s*(.*?)\s*$"
    return lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("val"))


def byte_patterns(spark: SparkSession, path: str, patterns: dict[str, bytes]) -> DataFrame:
    """Which patterns each file holds."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", *(F.contains("content", F.lit(bytearray(p))).alias(n) for n, p in patterns.items()))


def read_elements(spark: SparkSession, path: str, glob: str = "*.svg") -> DataFrame:
    """Markup files as a table of elements, numbered in document order, with the ``text`` of style
    elements; no entities, no network; a bad file gives no rows."""
    import pandas as pd

    from quarrymill.schemas import ELEMENTS

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("doc_id"), "content")

    def run(batches):
        from xml.etree import ElementTree

        for pdf in batches:
            rows = []
            for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                if b"<!ENTITY" in content or b"<!DOCTYPE" in content:
                    continue
                try:
                    root = ElementTree.fromstring(content)
                except ElementTree.ParseError:
                    continue
                todo, n = [(root, None, 0, 0)], 0
                while todo:
                    el, parent, place, depth = todo.pop()
                    rows.append((doc_id, n, parent, place, depth, el.tag.rsplit("}", 1)[-1], {k.rsplit("}", 1)[-1]: v for k, v in el.attrib.items()}, "".join(el.itertext()) if el.tag.lower().endswith("style") else None))
                    todo += [(c, n, i, depth + 1) for i, c in reversed(list(enumerate(el)))]
                    n += 1
            frame = pd.DataFrame(rows, columns=["doc_id", "node_id", "parent_id", "ord", "depth", "tag", "attrs", "text"])
            frame["parent_id"] = frame["parent_id"].astype("Int64")
            yield frame

    return files.mapInPandas(run, ELEMENTS + ", text string")
