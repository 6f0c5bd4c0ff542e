"""Findings about documents out of tool reports: an order is a document, its lines the report's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import prepress
from quarrymill.plans.registry import Family
from quarrymill.tables import load

family = Family()

_LINE = "ln AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) AS pk, min(l_suppkey) AS sk, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL)"
FONT_HEADER, FONT_BARE = "name                 type         emb sub uni object", "name                 type         sub uni object"
IMAGE_HEADER = "page   num  type   width height color comp bpc  enc interp  object ID x-ppi y-ppi size ratio"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").cast("long").alias("q"))
    return items.withColumnsRenamed({"l_orderkey": "doc_id", "l_linenumber": "n"})


def _report(rows: DataFrame, header) -> DataFrame:
    """Rows with a header at 0 and a rule of dashes below it."""
    heads = rows.select("doc_id").distinct()
    return rows.select("doc_id", (F.col("n") + 1).alias("n"), "value").unionByName(heads.select("doc_id", F.lit(0).alias("n"), header.alias("value"))).unionByName(heads.select("doc_id", F.lit(1).alias("n"), F.lit("---- --- ---").alias("value")))


@family.query(
    f"""WITH {_LINE} SELECT doc_id, doc_id % 7 <> 0 AS verified, CASE WHEN doc_id % 7 <> 0 THEN count(*) FILTER (q % 3 = 0) ELSE 0 END AS missing,
  CASE WHEN doc_id % 7 <> 0 THEN coalesce(array_to_string((list('Font ' || pk ORDER BY n) FILTER (q % 3 = 0))[1:5], ', '), '') ELSE '' END AS names FROM ln GROUP BY doc_id HAVING doc_id % 7 = 0 OR count(*) FILTER (q % 3 = 0) > 0"""
)
def font_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with fonts that are not embedded, or whose report has no such column."""
    embedded = F.when(F.col("q") % 3 == 0, F.when(F.col("q") % 2 == 0, "no ").otherwise("   ")).otherwise("Yes")
    value = F.concat(F.rpad(F.concat(F.lit("Font "), "pk"), 34, " "), embedded, F.lit(" no  yes 7 0"))
    header = F.when(F.col("doc_id") % 7 == 0, F.lit(FONT_BARE)).otherwise(F.lit(FONT_HEADER))
    return prepress.font_findings(_report(_lines(spark, sf_dir).withColumn("value", value), header))


@family.query(
    f"""WITH {_LINE}, i AS (SELECT doc_id, n, pk AS width, sk AS height, q * 10.0 AS x, 50.0 + sk % 400 AS y FROM ln WHERE pk % 5 <> 0 AND q % 11 <> 0)
SELECT doc_id, count(*) AS weak, arg_min(width, (least(x, y), n)) AS width, arg_min(height, (least(x, y), n)) AS height, min(least(x, y))::DOUBLE AS ppi FROM i WHERE least(x, y) < 300 GROUP BY doc_id"""
)
def image_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with images below the least resolution, and the worst of each."""
    kind = F.when(F.col("pk") % 5 == 0, "SMask").otherwise("image")
    x = F.when(F.col("q") % 11 == 0, F.lit("n/a")).otherwise((F.col("q") * 10).cast("string"))
    value = F.concat_ws("  ", F.lit("  1"), "n", kind, "pk", "sk", F.lit("rgb 3 8 jpeg no 7"), F.lit("0"), x, (50 + F.col("sk") % 400).cast("string"), F.lit("1K 10%"))
    return prepress.image_findings(_report(_lines(spark, sf_dir).withColumn("value", value), F.lit(IMAGE_HEADER)))


@family.query(f"WITH {_LINE}, s AS (SELECT doc_id, bool_or(pk % 4 = 0) AS cmyk, bool_or(pk % 4 = 1) AS rgb, bool_or(pk % 4 = 2) AS gray FROM ln GROUP BY doc_id) SELECT array_to_string(list_filter([CASE WHEN gray THEN 'Gray' END, CASE WHEN rgb THEN 'RGB' END], lambda x: x IS NOT NULL), '/') AS spaces, count(*) AS documents FROM s WHERE NOT cmyk AND (rgb OR gray) GROUP BY 1")
def cmyk_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name colour spaces but not CMYK, by the spaces that they name."""
    mark = F.coalesce(*(F.when(F.col("pk") % 4 == k, F.lit(prepress.COLOUR_SPACES[name].decode())) for k, name in enumerate(("CMYK", "RGB", "Gray"))), F.lit("<< >>"))
    contents = _lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.collect_list(mark), " x ").cast("binary").alias("content"))
    found = prepress.cmyk_findings(prepress.colour_spaces(contents))
    return found.groupBy(F.array_join("spaces", "/").alias("spaces")).agg(F.count(F.lit(1)).alias("documents"))
