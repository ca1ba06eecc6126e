"""The handover report over the catalogue's tasks, links and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..operators import catalogue as C
from ..operators import report as R
from .base import query
from .how import HEALTH, _health
from .what import files, links, tasks

TODAY = "2001-03-15"


def tables(spark, sf_dir):
    from ..operators import compare as P

    f, own, i, t = files(spark, sf_dir), tasks(spark, sf_dir).filter("not not_a_task and merged_into is null"), F.col("doc_id"), F.col("task_id")
    l = links(spark, sf_dir).join(f.select("doc_id", "missing", "year", "month" if "month" in f.columns else F.month("date").alias("month"), "filename", "path"), "doc_id")
    there = F.when(~F.col("missing"), F.col("year"))
    size = l.groupBy("task_id").agg(F.count("*").alias("doc_count"), F.min(there).alias("first_year"), F.max(there).alias("last_year"), F.countDistinct(there).alias("years"))
    own = own.join(size, "task_id", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
    own = ranked(own, [], [F.desc_nulls_last("last_year"), F.desc_nulls_last("years"), F.desc("doc_count"), F.col("name")], "place")
    own = own.withColumns({"state": F.when(t % 5 == 0, "confirmed").otherwise("inferred"), "description": F.when(t % 3 != 0, F.concat(F.lit("about "), "name"))})
    kinds = F.array(*map(F.lit, ("monthly", "yearly", "none", "quarterly")))
    cycles = own.filter("task_id % 5 != 4").select("task_id", F.when(t % 2 == 0, "confirmed").otherwise("weak").alias("state"), F.element_at(kinds, (t % 4 + 1).cast("int")).alias("kind"), F.when(t % 4 == 1, F.array(F.lit(12), F.lit(3))).when(t % 4 == 3, F.array(*map(F.lit, (1, 4, 7, 10)))).otherwise(F.expr("cast(array() as array<int>)")).alias("months"), F.when(t % 8 == 0, "5~10일").alias("day_hint"))
    steps = ranked(l.filter("doc_id % 10 = 1 and year = 1998"), ["task_id"], [F.asc_nulls_last("month"), i], "ordinal")
    steps = steps.select("task_id", "year", "ordinal", F.concat(F.lit("step "), (i % 6).cast("string")).alias("label"), F.when(i % 4 != 1, F.concat(F.col("month").cast("string"), F.lit("월"))).alias("day_hint"), F.when(t % 6 != 2, F.col("filename")).alias("filename"), (t % 2 == 0).alias("by_user"))
    health = P.health(_health(spark, sf_dir))
    loose = f.filter("not missing and parse_status = 'parsed'").join(links(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")
    last = F.broadcast(f.filter("not missing").agg(F.max("year").alias("corpus_year")))  # one row
    recent = F.col("year") >= F.col("corpus_year") - 2
    leftovers = loose.crossJoin(last).agg(F.count("*").alias("unclassified"), F.count_if(recent).alias("recent"), F.count_if(recent & (i % 2 == 0)).alias("recent_done")).crossJoin(F.broadcast(f.filter("not missing").agg(F.count("*").alias("documents"))))
    return {
        "tasks": own, "cycles": cycles, "steps": steps, "health": health, "leftovers": leftovers,
        "reading": l.filter("doc_id % 4 = 0").select("task_id", (i % 9 + 1).alias("ordinal"), "doc_id", "filename", F.when(i % 8 != 0, "said").alias("reason")),
        "primary": C.top_per_group(l.filter("is_primary"), ["task_id"], [i]).select("task_id", "path"),
        "folders": C.folder_tally(l.select("task_id", "path")),
        "progress": own.agg(F.bround(F.count_if(t % 5 == 0) * 100 / F.count("*")).cast("int").alias("percent")),
    }


def _part(select: str, part: int, place: str, block: int, item: str, sub: str, lines: list[str]) -> str:
    return f"SELECT {part} AS part, {place} AS place, {block} AS block, {item} AS item, {sub} AS sub, unnest(range({len(lines)})) AS pos, unnest([{', '.join(lines)}]) AS line FROM {select}"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_N = "format('{{:,}}', {0})"
_MARK = "CASE {0} WHEN 'confirmed' THEN '✓' WHEN 'inferred' THEN '◐' WHEN 'weak' THEN '△' ELSE '○' END"
_TASK = " JOIN tk ON x.task_id = tk.task_id"
_WHEN = "CASE WHEN kind = 'none' THEN '반복하지 않는 업무입니다' WHEN kind = 'monthly' THEN rtrim('매월 ' || coalesce(day_hint, '')) WHEN len(months) > 0 THEN '매년 ' || array_to_string(list_transform(list_sort(months), lambda m: m || '월'), ', ') ELSE '매년' END"
_STEP = "(SELECT place, max(year) AS y, bool_and(by_user) AS settled, count(filename) AS shown FROM sp x{0} GROUP BY place)".format(_TASK)
LINES = [
    _part("lo", 0, "0", 0, "0", "0", [_q("# 인수인계 보고서"), "''", f"'2001년 3월 15일 만듦 · 전임자 자료 ' || {_N.format('documents')} || '건을 살펴본 결과입니다.'", "''", _q(R.LEGEND), "''", _q(R.WARNING), "''"]),
    _part("sz", 0, "0", 1, "0", "0", [f"CASE WHEN n = 0 THEN {_q(R.NO_TASKS)} END", "CASE WHEN n = 0 THEN '' END"]),
    _part("sz", 1, "0", 0, "0", "0", ["'## 확인 상태'", "''", "'인수인계 진행도 ' || percent || '%'", "''"]),
    _part("(SELECT 1 FROM wk LIMIT 1)", 1, "0", 1, "0", "0", ["'아직 손볼 곳이 있는 업무'", "''"]),
    _part("wk", 1, "0", 2, "r", "0", ["'- ' || name || ' — ' || CASE grade WHEN 'thin' THEN '자료 부족' ELSE '확인 필요' END || ': ' || headline"]),
    _part("(SELECT 1 FROM wk LIMIT 1)", 1, "0", 3, "0", "0", ["''"]),
    _part("sz", 2, "-1", 0, "0", "0", ["CASE WHEN n > 0 THEN '## 인수받은 업무 ' || n || '개' END", "CASE WHEN n > 0 THEN '' END"]),
    _part("tk", 2, "place", 1, "0", "0", ["'### ' || name", "''", f"{_MARK.format('state')} || ' 문서 ' || {_N.format('doc_count')} || '건' || CASE WHEN last_year IS NOT NULL THEN ' · ' || first_year || '~' || last_year || '년' ELSE '' END", "''", f"coalesce(description, {_q(R.NO_DESCRIPTION)})", "''"]),
    _part(f"cyc x{_TASK}", 2, "place", 2, "0", "0", ["'**언제 하는 일인가**'", "''", f"{_MARK.format('x.state')} || ' ' || {_WHEN}", "''"]),
    _part(f"(SELECT DISTINCT place FROM rd x{_TASK})", 2, "place", 3, "0", "0", ["'**먼저 읽을 문서**'", "''"]),
    _part(f"rd x{_TASK}", 2, "place", 4, "ordinal", "doc_id", ["ordinal || '. `' || filename || '`' || CASE WHEN doc_id % 8 <> 0 THEN ' — said' ELSE '' END"]),
    _part(f"(SELECT DISTINCT place FROM rd x{_TASK})", 2, "place", 5, "0", "0", ["''"]),
    _part(_STEP, 2, "place", 6, "0", "0", ["'**어떻게 처리했나** (' || y || '년)'", "''", "CASE WHEN settled THEN '✓' ELSE '◐' END || ' 처리 순서'", "''", f"CASE WHEN shown = 0 THEN {_q(R.BY_HAND)} END", "CASE WHEN shown = 0 THEN '' END"]),
    _part(f"sp x{_TASK}", 2, "place", 7, "ordinal", "0", ["ordinal || '. ' || label || ' (' || coalesce(day_hint, '시점 미상') || ')' || CASE WHEN filename IS NULL THEN ' — 근거 문서 없음' ELSE ' — `' || filename || '`' END"]),
    _part(_STEP, 2, "place", 8, "0", "0", ["''"]),
    _part(f"(SELECT task_id, arg_min(path, doc_id) AS path FROM lx WHERE is_primary GROUP BY task_id) x{_TASK}", 2, "place", 9, "0", "0", ["'**대표 문서**'", "''", "'`' || path || '`'", "''"]),
    _part(f"(SELECT DISTINCT place FROM fo x{_TASK})", 2, "place", 10, "0", "0", ["'**자료가 있는 곳**'", "''"]),
    _part(f"fo x{_TASK}", 2, "place", 11, "r", "0", [f"'- `' || folder || '` (' || {_N.format('x.n')} || '건)'"]),
    _part(f"(SELECT DISTINCT place FROM fo x{_TASK})", 2, "place", 12, "0", "0", ["''"]),
    _part("cn WHERE n > 0", 3, "0", 0, "0", "0", ["'## 연간 일정'", "''", "'| 달 | 업무 |'", "'|---|---|'"]),
    _part("(SELECT m, (SELECT string_agg(DISTINCT name, ', ' ORDER BY name) FROM cyn WHERE kind <> 'monthly' AND list_contains(months, m)) AS names FROM range(1, 13) r(m), cn WHERE n > 0)", 3, "0", 1, "m", "0", ["'| ' || m || '월 | ' || coalesce(names, '—') || ' |'"]),
    _part("cn WHERE n > 0", 3, "0", 2, "0", "0", ["''"]),
    _part("(SELECT string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM cyn WHERE kind = 'monthly' HAVING count(*) > 0)", 3, "0", 3, "0", "0", ["'매월 하는 업무: ' || names", "''"]),
    _part("lo WHERE unclassified > 0", 4, "0", 0, "0", "0", ["'## 아직 정리되지 않은 자료'", "''", f"'어느 업무에도 넣지 못한 문서가 ' || {_N.format('unclassified')} || '건 있습니다.' || CASE WHEN recent > 0 THEN ' 그중 최근 자료는 ' || {_N.format('recent')} || '건이고, ' || {_N.format('recent_done')} || '건은 확인했습니다.' ELSE '' END", "''"]),
    _part("lo", 5, "0", 0, "0", "0", [_q(x) for x in R.ABOUT]),
]
_SCORE = " + ".join(f"CASE WHEN d{i + 1} THEN {w} ELSE 0 END" for i, w in enumerate((2, 3, 2, 2, 2, 2, 1, 2)))


def _oracle() -> str:
    from .how import _LACK

    return f"""WITH {HEALTH}, lx AS (SELECT l.*, missing, year, month(date) AS month, filename, path FROM links l JOIN f ON l.doc_id = f.doc_id),
ts AS (SELECT task_id, count(*) AS doc_count, min(CASE WHEN NOT missing THEN year END) AS first_year, max(CASE WHEN NOT missing THEN year END) AS last_year, count(DISTINCT CASE WHEN NOT missing THEN year END) AS years FROM lx GROUP BY task_id),
tk AS (SELECT t.task_id, name, coalesce(doc_count, 0) AS doc_count, first_year, last_year, CASE WHEN t.task_id % 5 = 0 THEN 'confirmed' ELSE 'inferred' END AS state, CASE WHEN t.task_id % 3 <> 0 THEN 'about ' || name END AS description,
  row_number() OVER (ORDER BY last_year DESC NULLS LAST, years DESC NULLS LAST, coalesce(doc_count, 0) DESC, name) AS place FROM tasks t LEFT JOIN ts ON t.task_id = ts.task_id WHERE NOT not_a_task AND merged_into IS NULL),
cyc AS (SELECT task_id, CASE WHEN task_id % 2 = 0 THEN 'confirmed' ELSE 'weak' END AS state, ['monthly', 'yearly', 'none', 'quarterly'][task_id % 4 + 1] AS kind, CASE task_id % 4 WHEN 1 THEN [12, 3] WHEN 3 THEN [1, 4, 7, 10] ELSE [] END AS months, CASE WHEN task_id % 8 = 0 THEN '5~10일' END AS day_hint FROM tk WHERE task_id % 5 <> 4),
cyn AS (SELECT cyc.*, name FROM cyc JOIN tk ON cyc.task_id = tk.task_id WHERE kind <> 'none'), cn AS (SELECT count(*) AS n FROM cyn),
rd AS (SELECT task_id, doc_id, doc_id % 9 + 1 AS ordinal, filename FROM lx WHERE doc_id % 4 = 0),
sp AS (SELECT task_id, year, row_number() OVER (PARTITION BY task_id ORDER BY month NULLS LAST, doc_id) AS ordinal, 'step ' || (doc_id % 6) AS label, CASE WHEN doc_id % 4 <> 1 THEN month || '월' END AS day_hint, CASE WHEN task_id % 6 <> 2 THEN filename END AS filename, task_id % 2 = 0 AS by_user FROM lx WHERE doc_id % 10 = 1 AND year = 1998),
fo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY n DESC, folder) AS r FROM (SELECT task_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM lx GROUP BY ALL)) WHERE r <= 5),
sz AS (SELECT count(*) AS n, CAST(round_even(count(*) FILTER (WHERE task_id % 5 = 0) * 100 / count(*), 0) AS INTEGER) AS percent FROM tk),
g0 AS (SELECT task_id, name, CAST(round_even(({_SCORE}) * 100 / 16.0, 0) AS INTEGER) AS score, CASE WHEN NOT (d2 AND d3 AND d4 AND d6) THEN 'thin' WHEN NOT (d1 AND d5 AND d7 AND d8) THEN 'attention' ELSE 'good' END AS grade, CASE {_LACK} END AS headline FROM h),
wk AS (SELECT *, row_number() OVER (ORDER BY grade <> 'thin', score, name, task_id) AS r FROM g0 WHERE grade <> 'good'),
un AS (SELECT f.* FROM f WHERE NOT missing AND parse_status = 'parsed' AND doc_id NOT IN (SELECT doc_id FROM links)),
lo AS (SELECT count(un.doc_id) AS unclassified, count(*) FILTER (WHERE un.year >= corpus_year - 2) AS recent, count(*) FILTER (WHERE un.year >= corpus_year - 2 AND un.doc_id % 2 = 0) AS recent_done, (SELECT count(*) FROM f WHERE NOT missing) AS documents FROM y LEFT JOIN un ON true),
al AS ({' UNION ALL '.join(LINES)})
SELECT row_number() OVER (ORDER BY part, place, block, item, sub, pos) AS line_no, line FROM al WHERE line IS NOT NULL"""


@query(_oracle())
def handover_report(spark, sf_dir):
    return R.numbered(R.report_lines(tables(spark, sf_dir), "", TODAY))
