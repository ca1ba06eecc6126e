"""What a page of a task, a document or an answer shows, for all of them at once.

Tables as in ``catalogue``: docs (doc_id, filename, date, year, month, kind, missing), tasks (task_id, name,
not_a_task, merged_into), links (task_id, doc_id, is_primary); cycles, steps, sections and citations as
named below. "Of a task" means one ranked row for each task and item; a page takes one task's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ranks import ranked
from ..functions.text import clip, collapse
from .catalogue import top_per_group, with_copies


#: Most rows of steps that are sent to all tasks.
FIRST = 100_000


def live(tasks: DataFrame) -> DataFrame:
    return tasks.filter(~F.col("not_a_task") & F.col("merged_into").isNull())


def task_documents(links: DataFrame, docs: DataFrame) -> DataFrame:
    """task_id, rank, doc_id, filename, date: the documents of each task, newest first, undated ones last."""
    own = links.select("task_id", "doc_id").join(docs.select("doc_id", "filename", "date"), "doc_id")
    return ranked(own, ["task_id"], [F.desc_nulls_last("date"), F.col("filename"), F.col("doc_id")]).select("task_id", "rank", "doc_id", "filename", "date")


def task_reading(reading: DataFrame, docs: DataFrame) -> DataFrame:
    """task_id, ordinal, doc_id, filename, missing, reason of each reading list."""
    return reading.join(docs.select("doc_id", "filename", "missing"), "doc_id").select("task_id", "ordinal", "doc_id", "filename", "missing", "reason")


def document_tasks(links: DataFrame, tasks: DataFrame) -> DataFrame:
    """doc_id, tasks (names, the primary link's first), is_classified by a live task."""
    own = links.join(live(tasks).select("task_id", "name"), "task_id")
    names = F.transform(F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("later"), "name"))), lambda x: x["name"])
    return own.groupBy("doc_id").agg(names.alias("tasks"))


def live_cycles(cycles: DataFrame, tasks: DataFrame) -> DataFrame:
    """Cycles (task_id, kind, decided_by, years_observed) of live tasks, those marked as none left out."""
    return cycles.filter("kind != 'none'").join(live(tasks).select("task_id", "name"), "task_id")


def effective_cycle(cycles: DataFrame) -> DataFrame:
    """One cycle a task: a user's first, then the one seen in most years; ties by kind."""
    return top_per_group(cycles, ["task_id"], [F.desc(F.col("decided_by") == "user"), F.desc("years_observed"), F.col("kind")]).drop("rank")


def month_documents(links: DataFrame, docs: DataFrame, most: int = 3) -> DataFrame:
    """task_id, month, rank, doc_id: representative, trustworthily dated documents of each month, recent years first."""
    own = links.select("task_id", "doc_id").join(docs.filter("kind != 'fs' and month is not null").select("doc_id", "year", "month"), "doc_id")
    return top_per_group(own, ["task_id", "month"], [F.desc("year"), F.col("doc_id")], most).select("task_id", "month", "rank", "doc_id")


def ordered_steps(steps: DataFrame, docs: DataFrame) -> DataFrame:
    """task_id, year, rank, ordinal, label, filename: the steps of each task and year in order; those without a document
    have no file name. Years of any size are split by ranges."""
    own = steps.join(docs.select("doc_id", "filename").hint("merge"), "doc_id", "left")
    return ranked(own, ["task_id", "year"], [F.col("ordinal"), F.col("label"), F.asc_nulls_first("doc_id")]).select("task_id", "year", "rank", "ordinal", "label", "filename")


def latest_month_step(steps: DataFrame) -> DataFrame:
    """task, month, year, label: the last step of each month, by year and then ordinal."""
    return top_per_group(steps.filter("month is not null"), ["task", "month"], [F.desc("year"), F.desc("ordinal"), F.col("label")]).select("task", "month", "year", "label")


def task_years(links: DataFrame, docs: DataFrame, confirmed: DataFrame, this_year: int) -> DataFrame:
    """task_id, years: those of its documents, of confirmed steps (task_id, year) and this one."""
    own = links.select("task_id", "doc_id").join(docs.filter("year is not null and not missing").select("doc_id", "year"), "doc_id").select("task_id", "year")
    this = links.select("task_id", F.lit(this_year).alias("year"))
    every = own.unionByName(confirmed.select("task_id", "year")).unionByName(this).distinct()
    return every.groupBy("task_id").agg(F.sort_array(F.collect_list("year")).alias("years"))


def document_context(docs: DataFrame, links: DataFrame, tasks: DataFrame) -> DataFrame:
    """doc_id, task (its first live one by name), copies, newest, latest_year of the task, freshness: with
    copies whether it is the newest, else older than its task's latest year or current."""
    own = with_copies(docs).select("doc_id", "year", "mtime", "copies", "newest_copy")
    named = links.join(live(tasks).select("task_id", "name"), "task_id")
    first = named.groupBy("doc_id").agg(F.min(F.struct("name", "task_id")).alias("t")).select("doc_id", "t.name", "t.task_id")
    latest = links.join(docs.filter("not missing").select("doc_id", "year"), "doc_id").groupBy("task_id").agg(F.max("year").alias("latest_year"))
    joined = own.join(first, "doc_id", "left").join(latest, "task_id", "left")
    fresh = (
        F.when(F.col("copies") > 1, F.when(F.col("mtime") >= F.col("newest_copy"), "newest copy").otherwise("newer copy exists"))
        .when(F.col("year") < F.col("latest_year"), "newer year exists")
        .otherwise("current")
    )
    return joined.select("doc_id", F.col("name").alias("task"), F.coalesce("copies", F.lit(1)).alias("copies"), "latest_year", fresh.alias("freshness"))


def evidence_snippets(sections: DataFrame, docs: DataFrame, most: int = 180) -> DataFrame:
    """doc_id, locator, snippet: of a document's first five sections that aren't blank the first that differs
    from the file name's stem, or the first; blanks collapsed, clipped."""
    text = collapse(F.col("text"))
    own = sections.select("doc_id", "ordinal", "locator", text.alias("body")).filter("body != ''")
    early = top_per_group(own, ["doc_id"], [F.col("ordinal")], 5)
    stem = F.regexp_replace("filename", r"\.[A-Za-z0-9]{1,5}$", "")
    named = early.join(docs.select("doc_id", stem.alias("stem")), "doc_id").withColumn("titled", F.col("body") == F.col("stem"))
    return top_per_group(named, ["doc_id"], [F.col("titled"), F.col("ordinal")], 1, "pick").select("doc_id", "locator", clip(F.col("body"), most).alias("snippet"))


def evidence_ids(said: Column) -> Column:
    """The numbers of a comma-separated list, in order."""
    return F.transform(F.filter(F.transform(F.split(said, ","), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("long"))


def evidence_list(rows: DataFrame, docs: DataFrame, most: int = 8) -> DataFrame:
    """key, pos, doc_id, filename of (key, ids array<long>, decided_by): the caller's order, ``most`` at most,
    none for what a user wrote."""
    own = rows.filter("coalesce(decided_by, '') != 'user'").select("key", F.posexplode(F.slice("ids", 1, most)).alias("pos", "doc_id"))
    return own.join(docs.select("doc_id", "filename").hint("merge"), "doc_id").select("key", "pos", "doc_id", "filename")


def unread_picks(reading: DataFrame, checks: DataFrame) -> DataFrame:
    """Reading-list rows whose document is not marked as read."""
    read = checks.filter("kind = 'read' and state = 'done'").select(F.col("target_id").alias("doc_id")).distinct()
    return reading.join(read, "doc_id", "left_anti")


def primary_documents(links: DataFrame, docs: DataFrame) -> DataFrame:
    """task_id, doc_id, filename of each task's primary document; the smallest id if there are several."""
    own = links.filter("is_primary").groupBy("task_id").agg(F.min("doc_id").alias("doc_id"))
    return own.join(docs.select("doc_id", "filename"), "doc_id").select("task_id", "doc_id", "filename")


# Answers ------------------------------------------------------------------------------------


def support_texts(cited: DataFrame, context: DataFrame) -> DataFrame:
    """query_id, doc_id, support: all context chunks (query_id, pos, doc_id, text; eight a query at most) of
    each cited document (query_id, doc_id), in order."""
    own = context.join(cited.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    return own.groupBy("query_id", "doc_id").agg(text.alias("support"))


def cited_sections(cited: DataFrame, sections: DataFrame) -> DataFrame:
    """query_id, pos, doc_id, ordinal, how: the sections that each citation (query_id, pos, doc_id, locator, snippet)
    marks: all of that locator (1), else the one whose ordinal the 'n문단' anywhere in the locator names (2), else
    the first that holds the first 40 characters of the snippet, if these are 8 or more (3)."""
    start = F.substring(collapse(F.coalesce("snippet", F.lit(""))), 1, 40)
    number = F.try_to_number(F.regexp_extract("locator", r"(\d{1,9})\s*문단", 1), F.lit("999999999")).cast("long")
    own = cited.select("query_id", "pos", "doc_id", "locator", number.alias("number"), F.when(F.length(start) >= 8, start).alias("start"))
    both = own.join(sections.select("doc_id", "ordinal", F.col("locator").alias("of"), "text").hint("merge"), "doc_id")
    how = F.when((F.col("of") == F.col("locator")) & (F.col("locator") != ""), 1).when(F.col("ordinal") == F.col("number"), 2).when(F.contains(collapse(F.col("text")), "start"), 3)
    hit = both.withColumn("how", how).filter("how is not null").select("query_id", "pos", "doc_id", "ordinal", "how")
    # the surest way alone counts; in the third only the first section
    best = hit.groupBy("query_id", "pos").agg(F.min("how").alias("best"), F.min_by("ordinal", F.struct("how", "ordinal")).alias("first"))
    return hit.join(best, ["query_id", "pos"]).filter((F.col("how") == F.col("best")) & ((F.col("how") == 1) | (F.col("ordinal") == F.col("first")))).select("query_id", "pos", "doc_id", "ordinal", "how")


def majority_task(cited: DataFrame, links: DataFrame) -> DataFrame:
    """query_id, task_id: the task of most citations (query_id, pos, doc_id); the earliest cited wins ties."""
    own = cited.join(links.select("task_id", "doc_id"), "doc_id").groupBy("query_id", "task_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return top_per_group(own, ["query_id"], [F.desc("n"), F.col("pos"), F.col("task_id")]).select("query_id", "task_id")


def next_steps(cited: DataFrame, links: DataFrame, docs: DataFrame, steps: DataFrame) -> DataFrame:
    """query_id, task_id, year, label: of the majority task's steps (task_id, year, ordinal, label, doc_id) in the
    latest year cited the first whose document isn't cited."""
    task = majority_task(cited, links)
    year = cited.join(docs.select("doc_id", "year"), "doc_id").groupBy("query_id").agg(F.max("year").alias("year"))
    own = cut(task.join(year.hint("merge"), "query_id"))
    placed = ranked(steps.filter("task_id is not null and year is not null").select("task_id", "year", "ordinal", "label", "doc_id"), ["task_id", "year"], [F.col("ordinal"), F.col("label"), F.col("doc_id")], "_place")
    placed = cut(placed.select("task_id", "year", "doc_id", "label", "_place"))
    # a query meets the steps that it cites, not all of its task's year; the first place that none of these has is its own
    cites = cited.select("query_id", "doc_id").distinct().join(own.hint("merge"), "query_id")
    taken = cites.join(placed.hint("merge"), ["task_id", "year", "doc_id"]).select("query_id", "_place").distinct()
    taken = taken.withColumn("_number", F.row_number().over(Window.partitionBy("query_id").orderBy("_place")))
    last = taken.filter("_place = _number").groupBy("query_id").agg(F.max("_place").alias("_last"))
    own = cut(own.join(last.hint("merge"), "query_id", "left").withColumn("_place", F.coalesce("_last", F.lit(0)) + 1))
    # most queries ask for one of a few places
    first = cut(placed.filter(F.col("_place") <= (own.agg(F.max("_place")).first()[0] or 0)))
    first = F.broadcast(first) if first.count() <= FIRST else first.hint("merge")
    return own.join(first, ["task_id", "year", "_place"]).select("query_id", "task_id", "year", "label")


def question_history(questions: DataFrame, most: int = 5) -> DataFrame:
    """question, last: distinct questions (id, question), the most recently asked first."""
    return questions.groupBy("question").agg(F.max("id").alias("last")).orderBy(F.desc("last")).limit(most)


# Proposals ----------------------------------------------------------------------------------


def embed_text(filename: Column, body: Column, most: int = 1200) -> Column:
    """File name, line feed, the first ``most`` characters of the collapsed body."""
    return F.concat(filename, F.lit("\n"), F.substring(collapse(F.coalesce(body, F.lit(""))), 1, most))


def cleared_proposals(tasks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, links) without machine-made links of proposed tasks, then without proposed tasks that have no link."""
    proposed = tasks.filter("status = 'proposed'").select("task_id")
    gone = links.filter("origin != 'user'").join(proposed, "task_id", "left_semi")
    kept = links.join(gone.select("task_id", "doc_id"), ["task_id", "doc_id"], "left_anti")
    empty = proposed.join(kept.select("task_id").distinct(), "task_id", "left_anti")
    return tasks.join(empty, "task_id", "left_anti"), kept


def single_task(links: DataFrame, tasks: DataFrame) -> DataFrame:
    """doc_id, task (first live name), assignments."""
    return links.join(live(tasks).select("task_id", "name"), "task_id").groupBy("doc_id").agg(F.min("name").alias("task"), F.count("*").alias("assignments"))
