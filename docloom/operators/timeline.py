"""When tasks recur and how they run: grids, cycles, occurrences and ordered steps.

Input rows are dated documents: task, doc, date, kind (where the date came from), day_known. Dates
that come from the file system alone do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked

MONTHLY_SHARE, MAJORITY, EVIDENCE, GAP_DAYS, SPREAD = 0.7, 0.6, 20, 10, 10


def trusted(docs: DataFrame) -> DataFrame:
    return docs.filter((F.coalesce("kind", F.lit("fs")) != "fs") & F.col("month").isNotNull())


def grid(docs: DataFrame) -> DataFrame:
    """task, year, month, docs: the trusted documents of each cell in id order."""
    return trusted(docs).groupBy("task", "year", "month").agg(F.sort_array(F.collect_list("doc")).alias("docs"))


def monthly_coverage(docs: DataFrame) -> DataFrame:
    """task, years, coverage: mean over years of the share of months with a document."""
    by_year = trusted(docs).groupBy("task", "year").agg(F.countDistinct("month").alias("months"))
    return by_year.groupBy("task").agg(F.count("*").alias("years"), F.avg(F.col("months") / 12).alias("coverage"))


def common_months(docs: DataFrame) -> DataFrame:
    """task, month, years_seen: months of at least max(2, round(0.6 * years)) years."""
    seen = trusted(docs).select("task", "year", "month").distinct()
    years = seen.groupBy("task").agg(F.countDistinct("year").alias("years"))
    return seen.groupBy("task", "month").agg(F.count("*").alias("years_seen")).join(years, "task").filter(F.col("years_seen") >= F.greatest(F.lit(2), F.bround(F.col("years") * MAJORITY))).select("task", "month", "years_seen")


def evenly_spaced(months: Column) -> Column:
    """Four sorted months whose circular gaps are all within 3±1."""
    nexts = F.concat(F.slice(months, 2, 3), F.transform(F.slice(months, 1, 1), lambda m: m + 12))
    return (F.size(months) == 4) & F.forall(F.zip_with(months, nexts, lambda a, b: b - a), lambda g: F.abs(g - 3) <= 1)


def cycles(docs: DataFrame, min_years: int = 2) -> DataFrame:
    """task, kind, months, years_observed, confidence, evidence.

    One row for each task that recurs: monthly by coverage, quarterly by four even common months,
    else yearly. ``years_observed`` counts years that touch a common month; evidence is the first
    twenty documents by year, month and id.
    """
    own = trusted(docs).select("task", "year", "month", "doc")
    coverage = monthly_coverage(docs).filter(F.col("years") >= min_years)
    common = common_months(docs).groupBy("task").agg(F.sort_array(F.collect_list("month")).alias("common"))
    kind = F.when(F.col("coverage") >= MONTHLY_SHARE, "monthly").when(evenly_spaced(F.col("common")), "quarterly").when(F.col("common").isNotNull(), "yearly")
    rule = coverage.join(common, "task", "left").withColumn("kind", kind).filter(F.col("kind").isNotNull())
    rule = rule.select("task", "kind", F.when(F.col("kind") == "monthly", F.expr("cast(array() as array<int>)")).otherwise(F.col("common")).alias("months"))
    hit = own.join(rule, "task").filter((F.col("kind") == "monthly") | F.array_contains("months", F.col("month")))
    place = F.row_number().over(Window.partitionBy("task").orderBy("year", "month", "doc"))
    seen = hit.groupBy("task", "kind", "months").agg(F.countDistinct("year").alias("years_observed"))
    # a rank filter lets tasks keep the first ones before the shuffle
    first = hit.select("task", "year", "month", "doc").withColumn("place", place).filter(F.col("place") <= EVIDENCE).groupBy("task").agg(F.sort_array(F.collect_list(F.struct("year", "month", "doc"))).alias("first"))
    seen = seen.join(first, "task", "left")
    return seen.select("task", "kind", "months", "years_observed", F.when(F.col("years_observed") >= 3, "high").otherwise("medium").alias("confidence"), F.transform("first", lambda x: x["doc"]).alias("evidence"))


def day_hint(docs: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """task, day_hint: the span of known days if two or more lie within ten days. ``months``
    (task, months) limits the documents."""
    own = trusted(docs).filter("day_known")
    if months is not None:
        own = own.join(months.select("task", "months"), "task").filter((F.size("months") == 0) | F.array_contains("months", F.col("month")))
    span = own.groupBy("task").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count("*").alias("n"))
    text = F.when(F.col("lo") == F.col("hi"), F.concat("lo", F.lit("일"))).otherwise(F.concat("lo", F.lit("~"), "hi", F.lit("일")))
    return span.filter((F.col("n") >= 2) & (F.col("hi") - F.col("lo") <= SPREAD)).select("task", text.alias("day_hint"))


def next_occurrence(kind: Column, months: Column, today: Column) -> Column:
    """The first month after this one, else the first of next year; null for monthly tasks."""
    later = F.array_min(F.filter(months, lambda m: m > F.month(today)))
    date = F.when(later.isNotNull(), F.make_date(F.year(today), later, F.lit(1))).otherwise(F.make_date(F.year(today) + 1, F.array_min(months), F.lit(1)))
    return F.when((kind != "monthly") & (F.size(months) > 0), date)


def applies_to(kind: Column, months: Column, month: Column) -> Column:
    return (kind == "monthly") | F.array_contains(months, month)


def upcoming(found: DataFrame, today: Column, soon_days: int = 45) -> DataFrame:
    """task, running, next, days_away, soon: tasks running now first, then by days away, then task."""
    own = found.select("task", applies_to(F.col("kind"), F.col("months"), F.month(today)).alias("running"), next_occurrence(F.col("kind"), F.col("months"), today).alias("next"))
    own = own.withColumn("days_away", F.when(F.col("running"), 0).otherwise(F.datediff("next", today)))
    own = own.withColumn("soon", F.col("running") | (F.col("days_away") <= soon_days))
    return own.orderBy(F.desc("running"), F.asc_nulls_last("days_away"), "task")


def year_pattern(kind: Column, months: Column) -> Column:
    """Twelve booleans."""
    return F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: applies_to(kind, months, m))


def month_islands(months: Column) -> Column:
    """'9~11월, 3월' style text of runs of consecutive months, in order."""
    starts = F.filter(months, lambda m: ~F.array_contains(months, m - 1))
    ends = F.filter(months, lambda m: ~F.array_contains(months, m + 1))
    text = lambda a, b: F.when(a == b, F.concat(a.cast("string"), F.lit("월"))).otherwise(F.concat(a.cast("string"), F.lit("~"), b.cast("string"), F.lit("월")))
    return F.array_join(F.zip_with(starts, ends, text), ", ")


def headline(kind: Column, months: Column, hint: Column) -> Column:
    """'매월 5~10일', '매년 9~11월', '분기 1월, 4월, 7월, 10월'."""
    tail = F.when(hint.isNotNull() & (kind == "monthly"), F.concat(F.lit(" "), hint)).otherwise("")
    return F.when(kind == "monthly", F.concat(F.lit("매월"), tail)).when(kind == "quarterly", F.concat(F.lit("분기 "), month_islands(months))).otherwise(F.concat(F.lit("매년 "), month_islands(months)))


def annual_calendar(found: DataFrame) -> DataFrame:
    """month 1..12, tasks: sorted tasks of each month; monthly tasks are left out."""
    months = found.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    own = found.filter("kind != 'monthly'").select("task", F.explode("months").alias("month")).groupBy("month").agg(F.sort_array(F.collect_set("task")).alias("tasks"))
    return months.join(own.hint("merge"), "month", "left").select("month", F.coalesce("tasks", F.expr("cast(array() as array<bigint>)")).alias("tasks"))


def month_counts(found: DataFrame, today: Column) -> DataFrame:
    """live, done: tasks that run this month, and those of them whose cycles are all confirmed."""
    own = found.filter(applies_to(F.col("kind"), F.col("months"), F.month(today))).groupBy("task").agg(F.bool_and("confirmed").alias("done"))
    return own.agg(F.count("*").alias("live"), F.count_if("done").alias("done"))


# Steps --------------------------------------------------------------------------------------


def day_bucket(day: Column) -> Column:
    return F.when(day.isNull(), "").when(day <= 10, "초").when(day <= 20, "중").otherwise("말")


def steps(candidates: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """task, year, ordinal, doc, label, month, day_hint, gap_weeks, gap_note.

    Documents of a task and year in the order of month, day (unknown days count as the first) and
    id. A gap is noted between days that are known, whatever stands between them. A task and year of any size
    is split by ranges of that order.
    """
    known = F.when(F.col("day").isNotNull(), F.make_date("year", "month", "day"))
    own = ranked(candidates, ["task", "year"], [F.col("month"), F.coalesce("day", F.lit(1)), F.col("doc")], "ordinal", {"_before": known}).withColumn("_gap", F.datediff(known, "_before"))
    weeks = F.when(F.col("_gap") >= gap_days, F.greatest(F.lit(1), F.bround(F.col("_gap") / 7)).cast("int"))
    hint = F.when(F.col("day").isNull(), F.concat("month", F.lit("월"))).otherwise(F.concat("month", F.lit("월 "), day_bucket(F.col("day"))))
    own = own.withColumn("gap_weeks", weeks)
    note = F.when(F.col("gap_weeks").isNotNull(), F.concat((F.col("ordinal") - 1).cast("string"), F.lit("과 "), F.col("ordinal").cast("string"), F.lit(" 사이 약 "), F.col("gap_weeks").cast("string"), F.lit("주는 관련 자료가 없어 확인되지 않습니다")))
    return own.select("task", "year", "ordinal", "doc", "label", "month", hint.alias("day_hint"), "gap_weeks", note.alias("gap_note"))


def default_year(years: Column, today: Column, confirmed: Column) -> Column:
    """The latest confirmed year, else the latest that is over, else the latest."""
    settled = F.array_max(F.array_intersect(confirmed, years))
    return F.coalesce(settled, F.array_max(F.filter(years, lambda y: y < F.year(today))), F.array_max(years))


def carry_forward(own: DataFrame, source: Column, target: Column) -> DataFrame:
    """Copies of the source year's steps as inferred ones of the target year, without documents;
    tasks that have steps in the target year get none."""
    have = own.filter(F.col("year") == target).select("task").distinct()
    return own.filter(F.col("year") == source).join(have, "task", "left_anti").select("task", target.alias("year"), "ordinal", "label", "month", F.lit(True).alias("is_inferred"))


def repeat_changes(own: DataFrame, earlier: int, later: int) -> DataFrame:
    """task, label, n_earlier, n_later of labels in both years whose counts differ."""
    n = own.filter(F.col("year").isin(earlier, later)).groupBy("task", F.replace("label", F.lit(" "), F.lit("")).alias("label")).agg(F.count_if(F.col("year") == earlier).alias("n_earlier"), F.count_if(F.col("year") == later).alias("n_later"))
    return n.filter("n_earlier > 0 and n_later > 0 and n_earlier != n_later")
