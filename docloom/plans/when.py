"""Recurrence and step queries over orders as dated documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline as T
from .base import CYCLES, DATED, TODAY, dated_docs, joined, query, today


@query(f"WITH {CYCLES} SELECT task, kind, array_to_string(months, ',') AS months, years_observed, confidence, evidence FROM cy")
def cycle_detection(spark, sf_dir):
    return T.cycles(dated_docs(spark, sf_dir)).withColumns({"months": joined(F.col("months")), "evidence": joined(F.col("evidence"))})


@query(f"WITH {DATED} SELECT task, year, month, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY doc) AS docs FROM t GROUP BY task, year, month")
def task_grid(spark, sf_dir):
    return T.grid(dated_docs(spark, sf_dir)).withColumn("docs", joined(F.col("docs")))


@query(f"WITH {DATED} SELECT task, count(*) AS years, round(avg(n / 12.0), 6) AS coverage FROM (SELECT task, year, count(DISTINCT month) AS n FROM t GROUP BY ALL) GROUP BY task")
def monthly_coverage(spark, sf_dir):
    return T.monthly_coverage(dated_docs(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {DATED}, m AS (SELECT DISTINCT task, year, month FROM t), y AS (SELECT task, count(DISTINCT year) AS years FROM m GROUP BY task)
SELECT m.task, month, count(*) AS years_seen FROM m JOIN y ON m.task = y.task GROUP BY m.task, month, years HAVING count(*) >= greatest(2, round_even(years * 0.6, 0))""")
def common_months(spark, sf_dir):
    return T.common_months(dated_docs(spark, sf_dir))


@query(f"""WITH {DATED} SELECT task, CASE WHEN min(day) = max(day) THEN min(day) || '일' ELSE min(day) || '~' || max(day) || '일' END AS day_hint
FROM t WHERE day_known GROUP BY task HAVING count(*) >= 2 AND max(day) - min(day) <= 10""")
def day_hints(spark, sf_dir):
    return T.day_hint(dated_docs(spark, sf_dir))


_NEXT = f"""CASE WHEN kind = 'monthly' THEN NULL WHEN len(list_filter(months, lambda m: m > month(DATE '{TODAY}'))) > 0
  THEN make_date(year(DATE '{TODAY}'), list_min(list_filter(months, lambda m: m > month(DATE '{TODAY}'))), 1) ELSE make_date(year(DATE '{TODAY}') + 1, list_min(months), 1) END"""


@query(f"""WITH {CYCLES}, n AS (SELECT task, kind = 'monthly' OR list_contains(months, month(DATE '{TODAY}')) AS running, {_NEXT} AS next FROM cy)
SELECT task, running, CAST(next AS VARCHAR) AS next, CASE WHEN running THEN 0 ELSE date_diff('day', DATE '{TODAY}', next) END AS days_away, running OR date_diff('day', DATE '{TODAY}', next) <= 45 AS soon FROM n""")
def upcoming_tasks(spark, sf_dir):
    return T.upcoming(T.cycles(dated_docs(spark, sf_dir)), today()).withColumn("next", F.col("next").cast("string"))


@query(f"""WITH {CYCLES} SELECT task, array_to_string(list_transform(range(1, 13), lambda m: CASE WHEN kind = 'monthly' OR list_contains(months, m) THEN 'true' ELSE 'false' END), ',') AS pattern FROM cy""")
def year_patterns(spark, sf_dir):
    return T.cycles(dated_docs(spark, sf_dir)).select("task", joined(T.year_pattern(F.col("kind"), F.col("months"))).alias("pattern"))


@query(f"""WITH {CYCLES}, e AS (SELECT task, kind, list_filter(months, lambda m: NOT list_contains(months, m - 1)) AS a, list_filter(months, lambda m: NOT list_contains(months, m + 1)) AS b FROM cy)
SELECT task, CASE WHEN kind = 'monthly' THEN '매월' ELSE CASE WHEN kind = 'quarterly' THEN '분기 ' ELSE '매년 ' END ||
  array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] = b[i] THEN a[i] || '월' ELSE a[i] || '~' || b[i] || '월' END), ', ') END AS headline FROM e""")
def cycle_headlines(spark, sf_dir):
    return T.cycles(dated_docs(spark, sf_dir)).select("task", T.headline(F.col("kind"), F.col("months"), F.lit(None).cast("string")).alias("headline"))


@query(f"""WITH {CYCLES}, c AS (SELECT unnest(months) AS month, task FROM cy WHERE kind <> 'monthly')
SELECT m.month, coalesce(string_agg(CAST(task AS VARCHAR), ',' ORDER BY task), '') AS tasks FROM (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN c ON m.month = c.month GROUP BY m.month""")
def annual_calendar(spark, sf_dir):
    return T.annual_calendar(T.cycles(dated_docs(spark, sf_dir))).withColumn("tasks", joined(F.col("tasks")))


@query(f"""WITH {CYCLES} SELECT count(*) AS live, count(*) FILTER (WHERE task % 3 = 0) AS done FROM cy WHERE kind = 'monthly' OR list_contains(months, month(DATE '{TODAY}'))""")
def month_counters(spark, sf_dir):
    return T.month_counts(T.cycles(dated_docs(spark, sf_dir)).withColumn("confirmed", F.col("task") % 3 == 0), today())


@query(f"WITH {CYCLES} SELECT task, kind, confidence FROM cy WHERE task % 3 <> 0")
def cycle_review_queue(spark, sf_dir):
    from ..functions.text import status

    none = F.lit(None).cast("string")
    own = T.cycles(dated_docs(spark, sf_dir)).withColumn("by", F.when(F.col("task") % 3 == 0, "user"))
    return own.filter(status(F.col("confidence"), none, F.col("by"), none, F.lit(True)) != "confirmed").select("task", "kind", "confidence")


def _candidates(spark, sf_dir):
    return T.trusted(dated_docs(spark, sf_dir)).withColumn("day", F.when(F.col("day_known"), F.col("day")))


STEPS = (
    DATED
    + """,
c AS (SELECT task, year, month, CASE WHEN day_known THEN day END AS day, doc, label FROM t),
o AS (SELECT *, row_number() OVER w AS ordinal, CASE WHEN day IS NOT NULL THEN make_date(year, month, day) END AS dt FROM c WINDOW w AS (PARTITION BY task, year ORDER BY month, coalesce(day, 1), doc)),
p AS (SELECT *, date_diff('day', max(dt) OVER (PARTITION BY task, year ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), dt) AS gap FROM o),
st AS (SELECT *, CASE WHEN gap >= 10 THEN CAST(greatest(1, round_even(gap / 7.0, 0)) AS INTEGER) END AS gap_weeks FROM p)"""
)


@query(f"""WITH {STEPS} SELECT task, year, ordinal, doc, label, month,
  CASE WHEN day IS NULL THEN month || '월' ELSE month || '월 ' || CASE WHEN day <= 10 THEN '초' WHEN day <= 20 THEN '중' ELSE '말' END END AS day_hint, gap_weeks,
  CASE WHEN gap_weeks IS NOT NULL THEN (ordinal - 1) || '과 ' || ordinal || ' 사이 약 ' || gap_weeks || '주는 관련 자료가 없어 확인되지 않습니다' END AS gap_note FROM st""")
def step_order(spark, sf_dir):
    return T.steps(_candidates(spark, sf_dir))


@query(f"""WITH {DATED}, y AS (SELECT task, list(DISTINCT year) AS years, list(DISTINCT year) FILTER (WHERE doc % 11 = 0) AS confirmed FROM t GROUP BY task)
SELECT task, coalesce(list_max(list_filter(confirmed, lambda x: list_contains(years, x))), list_max(list_filter(years, lambda x: x < year(DATE '{TODAY}'))), list_max(years)) AS year FROM y""")
def default_how_year(spark, sf_dir):
    own = T.trusted(dated_docs(spark, sf_dir)).groupBy("task").agg(F.collect_set("year").alias("years"), F.collect_set(F.when(F.col("doc") % 11 == 0, F.col("year"))).alias("confirmed"))
    return own.select("task", T.default_year(F.col("years"), today(), F.col("confirmed")).alias("year"))


@query(f"""WITH {STEPS} SELECT task, 2002 AS year, ordinal, label, month, true AS is_inferred FROM st WHERE year = 2000
UNION ALL SELECT task, 1998, ordinal, label, month, true FROM st WHERE year = 1997 AND task NOT IN (SELECT task FROM st WHERE year = 1998)""")
def carry_forward(spark, sf_dir):
    own = T.steps(_candidates(spark, sf_dir))
    return T.carry_forward(own, F.lit(2000), F.lit(2002)).unionByName(T.carry_forward(own, F.lit(1997), F.lit(1998)))


@query(f"""WITH {STEPS}, n AS (SELECT task, replace(label, ' ', '') AS label, count(*) FILTER (WHERE year = 1999) AS n_earlier, count(*) FILTER (WHERE year = 2000) AS n_later FROM st WHERE year IN (1999, 2000) GROUP BY ALL)
SELECT * FROM n WHERE n_earlier > 0 AND n_later > 0 AND n_earlier <> n_later""")
def repeat_changes(spark, sf_dir):
    return T.repeat_changes(T.steps(_candidates(spark, sf_dir)), 1999, 2000)
