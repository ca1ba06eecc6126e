"""The handover report as ordered lines of Markdown, written by many tasks.

Each section is a frame of (part, place, block, item, pos, line); their union is put in order by ranges, so that
numbered part files, one after the other, are the report. Tables (one row a task unless said otherwise): tasks (task_id,
place, name, state, doc_count, first_year, last_year, description), cycles (task_id, state, kind, months, day_hint),
reading (task_id, ordinal, doc_id, filename, reason; rows), steps (task_id, year, ordinal, label, day_hint, filename,
by_user; the rows of the report's year), primary (task_id, path), folders (task_id, rank, folder, n; rows), health (name,
grade, score, headline), progress (percent) and leftovers (documents, unclassified, recent, recent_done), one row each.

Cases: a task without a description, cycle, list or documents goes without that block (or says so, as below); null names and
texts are empty; without tasks the report says that there are none; empty tables give their sections no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ranked

ORDER = ["part", "place", "block", "item", "sub", "pos"]
# Marks of states, grades and the report's own sentences.
MARKS = {"confirmed": "✓", "inferred": "◐", "weak": "△"}
NO_MARK = "○"
GRADES = {"thin": "자료 부족", "attention": "확인 필요", "good": "양호"}
LEGEND = "✓ 담당자 확인 · ◐ 자료에서 추정 · △ 근거 부족 · ○ 확인할 수 없음"
WARNING = "> 이 보고서는 자료에서 읽어 낸 것과 담당자가 확인한 것을 옮겨 적은 것입니다. 표시 없는 문장은 없습니다 — ◐과 △는 아직 사람이 확인하지 않은 대목이니 넘겨받는 분이 반드시 함께 확인하시기 바랍니다."
NO_TASKS, NO_DESCRIPTION, BY_HAND = "아직 파악된 업무가 없습니다.", "> 이 업무가 무엇인지는 아직 적혀 있지 않습니다.", "이 해 순서는 자료가 아니라 사람이 적어 둔 것입니다."
ABOUT = ["## 이 보고서에 대하여", "", "- 원본 파일은 하나도 고치지 않았습니다. 경로만 읽었습니다.", "- 업무 구분·반복 주기·처리 순서는 문서의 이름과 시점에서 재구성한 것입니다. 담당자가 확인한 대목(✓)만 사실로 보시기 바랍니다.", "- 문서를 외부로 보내지 않았습니다. 분석은 이 PC 안에서만 했습니다.", ""]


def mark(state: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in MARKS.items():
        out = out.when(state == k, v)
    return out.otherwise(NO_MARK)


def text(*parts) -> Column:
    """Strings and columns as one string; nulls are empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _lines(df: DataFrame, part: int, block: int, lines: list, place: Column | None = None, item: Column | None = None, sub: Column | None = None) -> DataFrame:
    """A frame's rows as lines in a block; null entries are no lines."""
    number = lambda c: (F.lit(0) if c is None else c).cast("long")
    own = F.array(*(x if isinstance(x, Column) else F.lit(x) for x in lines))
    return df.select(F.lit(part).alias("part"), number(place).alias("place"), F.lit(block).alias("block"), number(item).alias("item"), number(sub).alias("sub"), F.posexplode(own).alias("pos", "line")).filter("line is not null")


def _block(rows: DataFrame, block: int, head: list, line: list, item: Column, sub: Column | None = None, before: list | None = None) -> list[DataFrame]:
    """A titled list in each task's section: head once, a line a row, a blank at the end."""
    once = rows.groupBy("place", *(before or [])).agg(F.count("*").alias("_n"))
    place = F.col("place")
    return [_lines(once, 2, block, head, place), _lines(rows, 2, block + 1, line, place, item, sub), _lines(once, 2, block + 2, [""], place)]


def cycle_line(kind: Column, months: Column, day_hint: Column) -> Column:
    return F.when(kind == "none", "반복하지 않는 업무입니다").when(kind == "monthly", F.rtrim(text("매월 ", day_hint))).when(F.size(months) > 0, text("매년 ", F.array_join(F.transform(F.array_sort(months), lambda m: F.concat(m.cast("string"), F.lit("월"))), ", "))).otherwise("매년")


def report_lines(tables: dict[str, DataFrame], project: str, today: str) -> DataFrame:
    """part, place, block, item, sub, pos, line of all sections."""
    tasks, place = tables["tasks"], F.col("place")
    year, month, day = (int(x) for x in today.split("-"))
    number = lambda c: F.format_number(c, 0)
    # one row each
    left, ahead, size = tables["leftovers"], tables["progress"], tasks.agg(F.count("*").alias("n"))
    some = lambda x: F.when(F.col("n") > 0, x)
    out = [
        _lines(left, 0, 0, [f"# {project} 인수인계 보고서" if project else "# 인수인계 보고서", "", text(f"{year}년 {month}월 {day}일 만듦 · 전임자 자료 ", number(F.col("documents")), "건을 살펴본 결과입니다."), "", LEGEND, "", WARNING, ""]),
        _lines(size, 0, 1, [F.when(F.col("n") == 0, NO_TASKS), F.when(F.col("n") == 0, "")]),
        _lines(ahead, 1, 0, ["## 확인 상태", "", text("인수인계 진행도 ", F.col("percent"), "%"), ""]),
        _lines(size, 2, 0, [some(text("## 인수받은 업무 ", F.col("n"), "개")), some("")], F.lit(-1)),
        _lines(left, 4, 0, [F.when(F.col("unclassified") > 0, x) for x in ("## 아직 정리되지 않은 자료", "", text("어느 업무에도 넣지 못한 문서가 ", number(F.col("unclassified")), "건 있습니다.", F.when(F.col("recent") > 0, text(" 그중 최근 자료는 ", number(F.col("recent")), "건이고, ", number(F.col("recent_done")), "건은 확인했습니다."))), "")]),
        _lines(left, 5, 0, ABOUT),
    ]
    # tasks that still need work, thin ones first
    grade = F.element_at(F.create_map(*(F.lit(x) for p in GRADES.items() for x in p)), F.col("grade"))
    weak = ranked(tables["health"].filter("grade != 'good'").withColumn("_g", (F.col("grade") != "thin").cast("int")), [], [F.col("_g"), F.col("score"), F.col("name"), F.col("task_id")], "_n")
    any_weak = weak.limit(1).withColumn("_one", F.lit(1))
    out += [_lines(any_weak, 1, 1, ["아직 손볼 곳이 있는 업무", ""]), _lines(weak, 1, 2, [text("- ", F.col("name"), " — ", grade, ": ", F.col("headline"))], item=F.col("_n")), _lines(any_weak, 1, 3, [""])]
    # a section a task
    years = F.when(F.col("last_year").isNotNull(), text(" · ", F.col("first_year"), "~", F.col("last_year"), "년"))
    out.append(_lines(tasks, 2, 1, [text("### ", F.col("name")), "", text(mark(F.col("state")), " 문서 ", number(F.col("doc_count")), "건", years), "", F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(NO_DESCRIPTION), ""], place))
    of = lambda name: tables[name].join(tasks.select("task_id", "place").hint("merge"), "task_id")
    when = cycle_line(F.col("kind"), F.col("months"), F.col("day_hint"))
    out.append(_lines(of("cycles"), 2, 2, ["**언제 하는 일인가**", "", text(mark(F.col("state")), " ", when), ""], place))
    why = F.when(F.coalesce("reason", F.lit("")) != "", text(" — ", F.col("reason")))
    out += _block(of("reading"), 3, ["**먼저 읽을 문서**", ""], [text(F.col("ordinal"), ". `", F.col("filename"), "`", why)], F.col("ordinal"), F.col("doc_id"))
    steps = of("steps")
    about = steps.groupBy("place").agg(F.max("year").alias("year"), F.bool_and("by_user").alias("settled"), F.count("filename").alias("shown"))
    out.append(_lines(about, 2, 6, [text("**어떻게 처리했나** (", F.col("year"), "년)"), "", text(F.when(F.col("settled"), MARKS["confirmed"]).otherwise(MARKS["inferred"]), " 처리 순서"), "", F.when(F.col("shown") == 0, BY_HAND), F.when(F.col("shown") == 0, "")], place))
    source = F.when(F.col("filename").isNotNull(), text(" — `", F.col("filename"), "`")).otherwise(" — 근거 문서 없음")
    out += [_lines(steps, 2, 7, [text(F.col("ordinal"), ". ", F.col("label"), " (", F.coalesce("day_hint", F.lit("시점 미상")), ")", source)], place, F.col("ordinal")), _lines(about, 2, 8, [""], place)]
    out.append(_lines(of("primary"), 2, 9, ["**대표 문서**", "", text("`", F.col("path"), "`"), ""], place))
    out += _block(of("folders"), 10, ["**자료가 있는 곳**", ""], [text("- `", F.col("folder"), "` (", number(F.col("n")), "건)")], F.col("rank"))
    return _union([*out, *_calendar(tables)])


def _calendar(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """A row for each month with the names of its tasks, then those of every month; nothing without cycles. A month's names
    are one line of the report."""
    named = tables["cycles"].filter("kind != 'none'").join(tables["tasks"].select("task_id", "name").hint("merge"), "task_id")
    yearly, monthly = named.filter("kind != 'monthly'"), named.filter("kind = 'monthly'")
    names = lambda df, *by: df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    months = names(yearly.select("name", F.explode(F.col("months").cast("array<int>")).alias("month")), "month")
    months = named.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month")).join(months.hint("merge"), "month", "left")
    begun = F.broadcast(named.agg(F.count("*").alias("n")))  # one row
    some = lambda x: F.when(F.col("n") > 0, x)
    head = _lines(begun, 3, 0, [some(x) for x in ("## 연간 일정", "", "| 달 | 업무 |", "|---|---|")])
    rows = _lines(months.crossJoin(begun), 3, 1, [some(text("| ", F.col("month"), "월 | ", F.coalesce("names", F.lit("—")), " |"))], item=F.col("month"))
    every = names(monthly.withColumn("one", F.lit(1)), "one")
    return [head, rows, _lines(begun, 3, 2, [some("")]), _lines(every, 3, 3, [text("매월 하는 업무: ", F.col("names")), ""])]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def numbered(lines: DataFrame) -> DataFrame:
    """line_no, line: ``lines`` in order, numbered from 1 across all tasks."""
    return ranked(lines, [], [F.col(c) for c in ORDER], "line_no").select("line_no", "line")


def write_text(lines: DataFrame, path: str) -> None:
    """Part files that, in the order of their names, are the report; each task writes a range of it."""
    order = [F.col(c) for c in ORDER]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
