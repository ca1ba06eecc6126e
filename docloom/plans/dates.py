"""Date inference over texts, names and folders made from order dates in varying formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dating as D
from .base import query, table

YEAR = 2002


def dated_files(spark, sf_dir):
    date, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    fmt = lambda f: F.date_format(date, f)
    name = F.when(k % 6 == 1, F.concat(fmt("yyyy_MM"), F.lit("_report.txt"))).when(k % 6 == 2, F.concat(fmt("yyyy"), F.lit("_plan.txt"))).when(k % 6 == 3, F.concat(F.lit("d"), fmt("yyyyMMdd"), F.lit(".txt"))).otherwise("notes.txt")
    text = F.when(k % 6 == 0, F.concat(F.lit("지난 1994년 자료\n작성일: "), fmt("yyyy. M. d."), F.lit(" 번호 제 1999호")))
    return table(spark, sf_dir, "orders").select(
        k.alias("doc_id"),
        F.when(text.isNotNull(), F.array(F.lit("표제 1993"), text)).otherwise(F.expr("cast(array() as array<string>)")).alias("sections"),
        name.alias("filename"),
        F.concat(F.lit("data/"), F.when(k % 6 == 4, fmt("yyyy년 M월")).otherwise("misc"), F.lit("/"), name).alias("path"),
        F.lit(None).cast("string").alias("meta_created"),
        F.when(k % 12 == 5, F.concat(F.lit("D:"), fmt("yyyyMMdd"), F.lit("120000"))).alias("meta_modified"),
        date.cast("timestamp").alias("mtime"),
    )


CHOSEN = """c AS (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 6 WHEN 0 THEN 'body' WHEN 4 THEN 'folder' WHEN 5 THEN CASE WHEN o_orderkey % 12 = 5 THEN 'meta' ELSE 'fs' END ELSE 'filename' END AS kind,
  CASE o_orderkey % 6 WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 4 THEN 'month' ELSE 'day' END AS precision FROM orders),
r AS (SELECT doc_id, CAST(CASE precision WHEN 'day' THEN d WHEN 'month' THEN date_trunc('month', d) ELSE date_trunc('year', d) END AS DATE) AS value, kind, precision FROM c)"""


@query(f"WITH {CHOSEN} SELECT doc_id, CAST(value AS VARCHAR) AS value, kind, precision FROM r")
def date_inference(spark, sf_dir):
    return D.resolve(D.candidates(dated_files(spark, sf_dir), YEAR)).withColumn("value", F.col("value").cast("string"))


@query(f"WITH {CHOSEN} SELECT kind, count(*) AS n FROM (SELECT kind FROM r WHERE kind <> 'fs' UNION ALL SELECT 'fs' FROM r) GROUP BY kind")
def date_candidates(spark, sf_dir):
    return D.candidates(dated_files(spark, sf_dir), YEAR).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {CHOSEN} SELECT count(*) AS documents, count(*) FILTER (WHERE kind <> 'fs') AS trusted, round(count(*) FILTER (WHERE kind <> 'fs') / count(*), 6) AS share, CASE WHEN count(*) FILTER (WHERE kind <> 'fs') / count(*) >= 0.8 THEN 'pass' ELSE 'fail' END AS gate FROM r")
def date_trust(spark, sf_dir):
    return D.trust_report(D.resolve(D.candidates(dated_files(spark, sf_dir), YEAR))).withColumn("share", F.round("share", 6))


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS shown FROM orders")
def date_display(spark, sf_dir):
    p = F.when(F.col("o_orderkey") % 3 == 0, "day").when(F.col("o_orderkey") % 3 == 1, "month").otherwise("year")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), D.date_text(F.col("o_orderdate"), p).alias("shown"))


@query("""SELECT o_orderkey AS doc_id, CAST(CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN date_trunc('month', o_orderdate) ELSE date_trunc('year', o_orderdate) END AS DATE)::VARCHAR AS value,
  CASE o_orderkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END AS precision FROM orders""")
def typed_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    f = lambda x: F.date_format("o_orderdate", x)
    typed = D.typed_date(F.when(k % 3 == 0, f("yyyy.M.d")).when(k % 3 == 1, f("yyyy년 M월")).otherwise(f("yyyy")))
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), typed.alias("t")).select("doc_id", F.col("t.value").cast("string").alias("value"), "t.precision")
