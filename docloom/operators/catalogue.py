"""Duplicates, representatives, listings, task summaries, reading lists and version rules.

Documents carry doc_id, hash, missing (boolean), filename, path, mtime and the columns named below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_term, matches_all, search_parts


def _groups(docs: DataFrame) -> DataFrame:
    """hash, n, rep, newest over documents that are there; the null hash is no group."""
    return docs.filter(F.col("hash").isNotNull() & ~F.col("missing")).groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"), F.max("mtime").alias("newest"))


def representatives(docs: DataFrame) -> DataFrame:
    """Documents without a hash, and the smallest id of each hash among those that are there. Hash
    groups are pre-aggregated and joined, so a hash of very many copies is no single window."""
    groups = _groups(docs).select("hash", "rep")
    return docs.filter(F.col("hash").isNull()).unionByName(docs.join(groups, "hash").filter(F.col("doc_id") == F.col("rep")).select(docs.columns))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    return _groups(docs).filter("n > 1").select("hash", "n", F.col("rep").alias("representative")).orderBy(F.desc("n"), "hash")


def duplicate_extra(docs: DataFrame) -> DataFrame:
    """How many copies there are beyond one of each group."""
    return duplicate_groups(docs).agg(F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("extra"))


def with_copies(docs: DataFrame) -> DataFrame:
    """Adds copies and newest_copy of the same hash; null without a hash."""
    groups = _groups(docs).select("hash", F.col("n").alias("copies"), F.col("newest").alias("newest_copy"))
    none = {c: F.lit(None).cast(groups.schema[c].dataType) for c in ("copies", "newest_copy")}
    # rows without a hash are one key, which no join needs to meet
    found = docs.filter("hash is not null").join(groups.hint("merge"), "hash", "left").select("hash", *(c for c in docs.columns if c != "hash"), *none)
    return found.unionByName(docs.filter("hash is null").withColumns(none))


def counters(docs: DataFrame, tasks: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of corpus counters from one aggregate a table. Rejected tasks are counted as tasks."""
    there = ~F.col("missing")
    d = docs.agg(
        F.count_if(there).alias("documents"),
        F.count_if(F.col("missing")).alias("missing"),
        F.count_if(there & (F.col("parse_status") == "parsed")).alias("parsed"),
        F.count_if(there & (F.col("parse_status") == "failed")).alias("failed"),
        F.count_if(there & (F.col("parse_status") == "skipped")).alias("skipped"),
        F.count_if(there & F.col("hash").isNotNull()).alias("hashed"),
        F.count_if(there & F.col("year").isNotNull()).alias("dated"),
    )
    t = tasks.agg(F.count("*").alias("tasks"))
    k = links.agg(F.countDistinct("doc_id").alias("in_task"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count_if("embedded").alias("embedded_chunks"))
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [d, t, k, c])  # one row each


def task_summary(tasks: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """Live tasks with doc_count (missing documents included), first and last year and number of years
    (missing ones not), by last year, number of years and size, largest first."""
    live = tasks.filter(~F.col("not_a_task") & F.col("merged_into").isNull()).select("task_id", "name")
    years = docs.select("doc_id", F.when(~F.col("missing"), F.col("year")).alias("year"))
    own = links.join(years, "doc_id", "left").groupBy("task_id").agg(F.count("*").alias("doc_count"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("year").alias("years"))
    return live.join(own, "task_id", "left").select("task_id", "name", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), "first_year", "last_year", F.coalesce("years", F.lit(0)).alias("years")).orderBy(F.desc_nulls_last("last_year"), F.desc("years"), F.desc("doc_count"), "name")


def count_by(df: DataFrame, *keys, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def never_searchable(chunks: DataFrame) -> DataFrame:
    """Documents none of whose chunks has a vector."""
    return chunks.groupBy("doc_id").agg(F.count_if("embedded").alias("e")).filter("e = 0").select("doc_id")


def needing_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Parsed documents that are there, without chunks or with a chunk without a vector."""
    state = chunks.groupBy("doc_id").agg(F.bool_and("embedded").alias("whole"))
    return docs.filter("not missing and parse_status = 'parsed'").join(state.hint("merge"), "doc_id", "left").filter("whole is null or not whole").select("doc_id")


def folder_tally(docs: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` parent folders of each task with most documents; ties by name."""
    own = docs.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).groupBy("task_id", "folder").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("n"), "folder"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= most)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], most: int = 1, name: str = "rank") -> DataFrame:
    """The first ``most`` rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= most)


def primary_task(links: DataFrame, tasks: DataFrame, by_name: bool = False) -> DataFrame:
    """doc_id, task_id, name: the primary link first, then by id (or, among live tasks, by name)."""
    own = links.join(tasks.filter("not not_a_task and merged_into is null") if by_name else tasks, "task_id")
    order = [F.desc("is_primary"), F.col("name") if by_name else F.col("task_id"), F.col("task_id")]
    return top_per_group(own, ["doc_id"], order).select("doc_id", "task_id", "name")


def find_documents(docs: DataFrame, links: DataFrame, term: str = "", documents_only: bool = False, collapse: bool = False, unclassified: bool = False) -> DataFrame:
    """The listing: composable filters, copies, newest first with undated ones last, then name and id."""
    own = with_copies(docs)
    own = own.filter("parse_status != 'skipped'") if documents_only else own
    if collapse:
        reps = representatives(docs).select("doc_id", F.lit(True).alias("_rep"))
        own = own.join(reps, "doc_id", "left").filter("_rep or missing").drop("_rep")
    if unclassified:
        own = own.join(links.select("doc_id").distinct(), "doc_id", "left_anti")
    if term.strip():
        fields = [contains_term(F.col(c), term.strip()) for c in ("filename", "path", "author")]
        body = contains_term(F.col("body"), term.strip()) if len(term.strip()) < 3 else matches_all([F.col(c) for c in ("filename", "path", "author", "body")], search_parts(F.lit(term)))
        own = own.filter(reduce(lambda a, b: a | b, fields) | body)
    return own.orderBy(F.desc_nulls_last("date"), "filename", "doc_id")


def page(listing: DataFrame, number: int, size: int) -> tuple[DataFrame, int, int]:
    """(rows of the page, total, pages): size within 1..500, page within what there is."""
    size = min(max(size, 1), 500)
    total = listing.count()
    pages = max(1, -(-total // size))
    return listing.offset((min(max(number, 1), pages) - 1) * size).limit(size), total, pages


def stray_recent(docs: DataFrame, links: DataFrame, checks: DataFrame) -> DataFrame:
    """stray, done: parsed documents of the corpus' last three years without a task, and how many are
    marked as seen to."""
    parsed = docs.filter("not missing and parse_status = 'parsed'")
    last = F.broadcast(parsed.agg(F.max("year").alias("last")))  # one row
    own = parsed.crossJoin(last).filter("year >= last - 2").join(links.select("doc_id").distinct(), "doc_id", "left_anti")
    done = checks.filter("kind = 'stray' and state = 'done'").select(F.col("target_id").alias("doc_id"), F.lit(True).alias("done")).distinct()
    return own.join(done, "doc_id", "left").agg(F.count("*").alias("stray"), F.count_if("done").alias("done"))


# Versions and reading order -----------------------------------------------------------------


def version_siblings(docs: DataFrame, steps: DataFrame) -> DataFrame:
    """doc_id, kind, name, size, representative: documents of the same hash ('hash', named by it), or of the
    same task, label and year of a step ('step', named task/label/year), where there are several. Siblings of a
    document are those of its groups; a group of n copies is n rows."""
    by_hash = docs.filter("not missing and hash is not null").select(F.lit("hash").alias("kind"), F.col("hash").alias("name"), "doc_id")
    step = F.concat_ws("/", *(F.col(c).cast("string") for c in ("task_id", "label", "year")))
    own = by_hash.unionByName(steps.filter("doc_id is not null").select(F.lit("step").alias("kind"), step.alias("name"), "doc_id")).distinct()
    groups = own.groupBy("kind", "name").agg(F.count("*").alias("size"), F.min("doc_id").alias("representative")).filter("size > 1")
    return own.join(groups.hint("merge"), ["kind", "name"]).select("doc_id", "kind", "name", "size", "representative")


def latest_version(docs: DataFrame) -> DataFrame:
    """hash, doc_id, undecided: the newest copy of each hash; undecided if two share that time."""
    newest = docs.filter("hash is not null and not missing").groupBy("hash").agg(F.max("mtime").alias("mtime"))
    at = docs.filter("hash is not null and not missing").join(newest, ["hash", "mtime"])
    return at.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), (F.count("*") > 1).alias("undecided"))


#: Weights and reasons of document types and of marks of final copies.
TYPE_WEIGHTS = (
    ("인수인계", 3.0, "인수인계 문서입니다"),
    ("업무계획|주요업무", 2.4, "그 해 업무 전체를 조망하는 문서입니다"),
    ("현황|총괄", 2.0, "현황을 한눈에 정리한 문서입니다"),
    ("지침|매뉴얼|편람", 2.0, "처리 기준을 담은 문서입니다"),
    ("제출자료|답변", 1.6, "실제로 대외에 낸 산출물입니다"),
    ("실적|결산", 1.4, "한 해 결과를 정리한 문서입니다"),
    ("요구자료|접수", 1.2, "업무가 시작되는 지점입니다"),
    ("회의|회의록", 0.6, ""),
    ("참고|기타", 0.2, ""),
)
FINAL_MARKS = (
    ("송부", 1.8, "'송부' 표기가 있어 실제 보낸 판본으로 보입니다"),
    ("결재|결제", 1.8, "'결재' 표기가 있어 확정본으로 보입니다"),
    ("제출", 1.4, "'제출' 표기가 있습니다"),
    ("진짜최종|최최종|final", 1.2, "가장 나중 판본으로 보입니다"),
    ("최종", 1.0, "'최종' 표기가 있습니다"),
)
NO_REASON = "이 업무에서 비교적 최근 자료입니다"


def _first(name: Column, table, default: float) -> tuple[Column, Column]:
    weight = reason = None
    for pattern, w, r in table:
        hit = name.rlike("(?i)" + pattern)
        weight = (F.when if weight is None else weight.when)(hit, w)
        reason = (F.when if reason is None else reason.when)(hit, r)
    return weight.otherwise(default), reason.otherwise("")


def reading_score(docs: DataFrame, this_year: int) -> DataFrame:
    """Adds score and reason from filename, year, date_kind, copies, chars, is_version and pinned."""
    name = F.coalesce("filename", F.lit(""))
    age = F.greatest(F.lit(this_year) - F.col("year"), F.lit(0))
    recency = F.coalesce(F.greatest(F.lit(0.0), (4 - age) / 4.0) * 2.0, F.lit(0.0))
    kind, kind_reason = _first(name, TYPE_WEIGHTS, 1.0)
    mark, mark_reason = _first(name, FINAL_MARKS, 0.0)
    extra = F.when(F.col("copies") > 1, F.least(F.lit(1.5), 0.5 * (F.col("copies") - 1))).otherwise(0.0)
    volume = F.when(F.col("chars") <= 0, -0.5).when(F.col("chars") < 200, 0.0).otherwise(0.5)
    score = F.when(F.col("pinned"), 10.0).otherwise(0.0) + recency + kind + mark + extra + F.when(F.col("is_version"), 0.8).otherwise(0.0) + volume + F.when(F.col("date_kind") == "fs", -0.8).otherwise(0.0)
    said = [
        (100, F.when(F.col("pinned"), "사용자가 대표 문서로 지정했습니다")),
        (70, mark_reason),
        (60, kind_reason),
        (50, F.when(age == 0, "올해 자료입니다").when(age == 1, "작년 자료로, 올해 작성 시 기준이 됩니다")),
        (40, F.when(F.col("copies") > 1, F.concat(F.lit("같은 문서가 "), F.col("copies").cast("string"), F.lit("곳에 복사되어 있습니다")))),
    ]
    texts = F.filter(F.array(*(t for _, t in said)), lambda t: t.isNotNull() & (t != ""))  # by falling priority
    reason = F.when(F.size(texts) == 0, NO_REASON).otherwise(F.array_join(F.slice(texts, 1, 2), ". "))
    return docs.withColumn("score", F.bround(score, 3)).withColumn("reason", reason)


def reading_list(docs: DataFrame, this_year: int, most: int = 5) -> DataFrame:
    """The ``most`` documents of each task to read first: by score, then file name and id."""
    return top_per_group(reading_score(docs, this_year), ["task_id"], [F.desc("score"), F.col("filename"), F.col("doc_id")], most).select("task_id", "rank", "doc_id", "score", "reason")


def freshness(copies: Column, is_newest: Column, year: Column, last_year: Column) -> Column:
    """One of several copies: newest or not; else older than the task's last year or current."""
    return F.when((copies > 1) & is_newest, "newest copy").when(copies > 1, "older copy").when(year < last_year, "older year").otherwise("current")
