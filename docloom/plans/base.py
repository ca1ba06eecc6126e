"""Registry and bindings of the given tables to documents, tasks, vectors and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The day that stands for today in queries.
TODAY = "2001-03-15"


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that it must equal."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


def today() -> Column:
    return F.to_date(F.lit(TODAY))


def dated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated documents of their customer's task; every seventh has only a file date."""
    date = F.to_date("o_orderdate")
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task"),
        key.alias("doc"),
        date.alias("date"),
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.dayofmonth(date).alias("day"),
        F.when(key % 7 == 0, "fs").otherwise("body").alias("kind"),
        (key % 5 != 0).alias("day_known"),
        F.substring("o_orderpriority", 3, 20).alias("label"),
    )


DATED = """d AS (SELECT o_custkey AS task, o_orderkey AS doc, CAST(o_orderdate AS DATE) AS date, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day,
  CASE WHEN o_orderkey % 7 = 0 THEN 'fs' ELSE 'body' END AS kind, o_orderkey % 5 <> 0 AS day_known, substr(o_orderpriority, 3, 20) AS label FROM orders),
t AS (SELECT * FROM d WHERE kind <> 'fs')"""

CYCLES = (
    DATED
    + """,
yc AS (SELECT task, year, count(DISTINCT month) AS n FROM t GROUP BY ALL),
cov AS (SELECT task, count(*) AS years, avg(n / 12.0) AS coverage FROM yc GROUP BY task HAVING count(*) >= 2),
mm AS (SELECT DISTINCT task, year, month FROM t),
cm AS (SELECT m.task, m.month FROM mm m JOIN (SELECT task, count(*) AS years FROM yc GROUP BY task) y ON m.task = y.task GROUP BY m.task, m.month, y.years HAVING count(*) >= greatest(2, round_even(y.years * 0.6, 0))),
cl AS (SELECT task, list(month ORDER BY month) AS common FROM cm GROUP BY task),
rl AS (SELECT c.task, CASE WHEN coverage >= 0.7 THEN 'monthly'
    WHEN len(common) = 4 AND abs(common[2] - common[1] - 3) <= 1 AND abs(common[3] - common[2] - 3) <= 1 AND abs(common[4] - common[3] - 3) <= 1 AND abs(12 + common[1] - common[4] - 3) <= 1 THEN 'quarterly'
    WHEN common IS NOT NULL THEN 'yearly' END AS kind, common FROM cov c LEFT JOIN cl ON c.task = cl.task),
ru AS (SELECT task, kind, CASE WHEN kind = 'monthly' THEN [] ELSE common END AS months FROM rl WHERE kind IS NOT NULL),
hit AS (SELECT t.*, ru.kind AS ckind, months, row_number() OVER (PARTITION BY t.task ORDER BY year, month, doc) AS place FROM t JOIN ru ON t.task = ru.task WHERE ru.kind = 'monthly' OR list_contains(months, month)),
cy AS (SELECT task, ckind AS kind, any_value(months) AS months, count(DISTINCT year) AS years_observed, CASE WHEN count(DISTINCT year) >= 3 THEN 'high' ELSE 'medium' END AS confidence,
  string_agg(CAST(doc AS VARCHAR), ',' ORDER BY year, month, doc) FILTER (WHERE place <= 20) AS evidence FROM hit GROUP BY task, ckind)"""
)
