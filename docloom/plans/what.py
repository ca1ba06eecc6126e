"""Duplicate, listing, task and reading-list queries.

Documents of ``documents``: hash of the text, path source/lang/doc_id, years by id; every 13th is
missing. Tasks are sources; links join each document of 120 characters or more to its source's task.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as C
from .base import query, table


def files(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(i % 17 != 0, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("hash"),
        (i % 13 == 0).alias("missing"),
        F.concat_ws("/", "source", "lang", F.concat(i.cast("string"), F.lit(".txt"))).alias("path"),
        F.concat(F.element_at(F.array(*map(F.lit, NAMES)), (i % len(NAMES) + 1).cast("int")), F.lit("_"), i.cast("string"), F.lit(".txt")).alias("filename"),
        F.col("lang").alias("author"),
        F.col("text").alias("body"),
        F.timestamp_seconds(F.lit(1600000000) + (i % 50) * 86400).alias("mtime"),
        F.when(i % 9 != 0, (F.lit(1995) + i % 7).cast("int")).alias("year"),
        F.when(i % 9 != 0, F.make_date((F.lit(1995) + i % 7).cast("int"), (i % 12 + 1).cast("int"), (i % 28 + 1).cast("int"))).alias("date"),
        F.when(i % 4 == 0, "fs").otherwise("body").alias("date_kind"),
        F.when(i % 11 == 0, "failed").when(i % 19 == 0, "skipped").otherwise("parsed").alias("parse_status"),
        F.coalesce(F.length("text"), F.lit(0)).alias("chars"),
        F.substring("source", 4, 10).cast("long").alias("task_id"),
    )


NAMES = ("인수인계서", "업무계획", "현황_최종", "처리지침", "제출자료_송부", "결산_final", "요구자료", "회의록", "참고", "report")
_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
FILES = f"""f AS (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN sha256(coalesce(text, '')) END AS hash, doc_id % 13 = 0 AS missing,
  source || '/' || lang || '/' || doc_id || '.txt' AS path, {_NAMES}[doc_id % {len(NAMES)} + 1] || '_' || doc_id || '.txt' AS filename, lang AS author, text AS body,
  1600000000 + (doc_id % 50) * 86400 AS mtime, CASE WHEN doc_id % 9 <> 0 THEN 1995 + doc_id % 7 END AS year,
  CASE WHEN doc_id % 9 <> 0 THEN make_date(1995 + doc_id % 7, doc_id % 12 + 1, doc_id % 28 + 1) END AS date, CASE WHEN doc_id % 4 = 0 THEN 'fs' ELSE 'body' END AS date_kind,
  CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 19 = 0 THEN 'skipped' ELSE 'parsed' END AS parse_status, coalesce(length(text), 0) AS chars, CAST(substr(source, 4) AS BIGINT) AS task_id FROM documents),
g AS (SELECT hash, count(*) AS n, min(doc_id) AS rep, max(mtime) AS newest FROM f WHERE hash IS NOT NULL AND NOT missing GROUP BY hash),
reps AS (SELECT f.* FROM f LEFT JOIN g ON f.hash = g.hash WHERE f.hash IS NULL OR f.doc_id = g.rep),
tasks AS (SELECT DISTINCT task_id, 'task' || task_id AS name, task_id % 10 = 9 AS not_a_task, CASE WHEN task_id % 10 = 8 THEN task_id - 1 END AS merged_into FROM f),
links AS (SELECT task_id, doc_id, doc_id % 3 = 0 AS is_primary FROM f WHERE chars >= 120 UNION ALL SELECT (task_id + 1) % 20, doc_id, doc_id % 5 = 0 FROM f WHERE doc_id % 6 = 0 AND chars >= 120),
chunks AS (SELECT doc_id, unnest(range(1, 1 + CAST((chars + 1499) // 1500 AS BIGINT))) AS ordinal FROM f WHERE parse_status = 'parsed'),
ch AS (SELECT doc_id, ordinal, (doc_id + ordinal) % 5 <> 0 AS embedded FROM chunks)"""


def tasks(spark, sf_dir):
    t = F.col("task_id")
    return files(spark, sf_dir).select("task_id").distinct().select("task_id", F.concat(F.lit("task"), t.cast("string")).alias("name"), (t % 10 == 9).alias("not_a_task"), F.when(t % 10 == 8, t - 1).alias("merged_into"))


def links(spark, sf_dir):
    own = files(spark, sf_dir).filter("chars >= 120").select("task_id", "doc_id")
    more = own.filter("doc_id % 6 = 0").select(((F.col("task_id") + 1) % 20).alias("task_id"), "doc_id", (F.col("doc_id") % 5 == 0).alias("is_primary"))
    return own.withColumn("is_primary", F.col("doc_id") % 3 == 0).unionByName(more)


def chunk_states(spark, sf_dir):
    """A chunk for every 1,500 characters of a parsed document; empty ones have none."""
    own = files(spark, sf_dir).filter("parse_status = 'parsed' and chars > 0")
    n = F.expr("(chars + 1499) div 1500").cast("int")
    return own.select("doc_id", F.explode(F.sequence(F.lit(1), n)).alias("ordinal")).withColumn("embedded", (F.col("doc_id") + F.col("ordinal")) % 5 != 0)


@query(f"WITH {FILES} SELECT doc_id, hash FROM reps")
def representatives(spark, sf_dir):
    return C.representatives(files(spark, sf_dir)).select("doc_id", "hash")


@query(f"WITH {FILES} SELECT hash, n, rep AS representative FROM g WHERE n > 1")
def duplicate_groups(spark, sf_dir):
    return C.duplicate_groups(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT CAST(coalesce(sum(n) - count(*), 0) AS BIGINT) AS extra FROM g WHERE n > 1")
def duplicate_extra(spark, sf_dir):
    return C.duplicate_extra(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT doc_id, n AS copies, newest AS newest_copy FROM f LEFT JOIN g ON f.hash = g.hash")
def document_copies(spark, sf_dir):
    return C.with_copies(files(spark, sf_dir)).select("doc_id", "copies", F.unix_timestamp("newest_copy").alias("newest_copy"))


@query(f"""WITH {FILES}, d AS (SELECT count(*) FILTER (WHERE NOT missing) AS documents, count(*) FILTER (WHERE missing) AS missing, count(*) FILTER (WHERE NOT missing AND parse_status = 'parsed') AS parsed,
  count(*) FILTER (WHERE NOT missing AND parse_status = 'failed') AS failed, count(*) FILTER (WHERE NOT missing AND parse_status = 'skipped') AS skipped,
  count(*) FILTER (WHERE NOT missing AND hash IS NOT NULL) AS hashed, count(*) FILTER (WHERE NOT missing AND year IS NOT NULL) AS dated FROM f)
SELECT d.*, (SELECT count(*) FROM tasks) AS tasks, (SELECT count(DISTINCT doc_id) FROM links) AS in_task, (SELECT count(*) FROM ch) AS chunks, (SELECT count(*) FILTER (WHERE embedded) FROM ch) AS embedded_chunks FROM d""")
def corpus_counters(spark, sf_dir):
    return C.counters(files(spark, sf_dir), tasks(spark, sf_dir), links(spark, sf_dir), chunk_states(spark, sf_dir))


@query(f"""WITH {FILES}, s AS (SELECT l.task_id, count(*) AS doc_count, min(CASE WHEN NOT missing THEN year END) AS first_year, max(CASE WHEN NOT missing THEN year END) AS last_year, count(DISTINCT CASE WHEN NOT missing THEN year END) AS years
  FROM links l LEFT JOIN f ON l.doc_id = f.doc_id GROUP BY l.task_id)
SELECT t.task_id, t.name, coalesce(doc_count, 0) AS doc_count, first_year, last_year, coalesce(years, 0) AS years FROM tasks t LEFT JOIN s ON t.task_id = s.task_id WHERE NOT not_a_task AND merged_into IS NULL""")
def task_summary(spark, sf_dir):
    return C.task_summary(tasks(spark, sf_dir), links(spark, sf_dir), files(spark, sf_dir))


@query(f"WITH {FILES} SELECT date_kind, count(*) AS n FROM f GROUP BY date_kind")
def date_kind_breakdown(spark, sf_dir):
    return C.count_by(files(spark, sf_dir), "date_kind")


@query(f"WITH {FILES} SELECT coalesce(CAST(year AS VARCHAR), 'unknown') AS year, count(*) AS n FROM f GROUP BY 1")
def documents_by_year(spark, sf_dir):
    return C.count_by(files(spark, sf_dir), F.coalesce(F.col("year").cast("string"), F.lit("unknown")).alias("year"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def documents_per_source(spark, sf_dir):
    return C.count_by(table(spark, sf_dir, "documents"), "source")


@query(f"WITH {FILES} SELECT doc_id FROM ch GROUP BY doc_id HAVING count(*) FILTER (WHERE embedded) = 0")
def never_searchable(spark, sf_dir):
    return C.never_searchable(chunk_states(spark, sf_dir))


@query(f"WITH {FILES}, s AS (SELECT doc_id, bool_and(embedded) AS whole FROM ch GROUP BY doc_id) SELECT f.doc_id FROM f LEFT JOIN s ON f.doc_id = s.doc_id WHERE NOT missing AND parse_status = 'parsed' AND (whole IS NULL OR NOT whole)")
def documents_needing_chunks(spark, sf_dir):
    return C.needing_chunks(files(spark, sf_dir), chunk_states(spark, sf_dir))


@query(f"""WITH {FILES}, n AS (SELECT task_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM f GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY n DESC, folder) AS rank FROM n) WHERE rank <= 5""")
def folder_tally(spark, sf_dir):
    return C.folder_tally(files(spark, sf_dir))


@query(f"""WITH {FILES} SELECT doc_id, task_id, name FROM (SELECT l.doc_id, t.task_id, t.name, row_number() OVER (PARTITION BY doc_id ORDER BY is_primary DESC, t.task_id) AS r FROM links l JOIN tasks t ON l.task_id = t.task_id) WHERE r = 1""")
def primary_task(spark, sf_dir):
    return C.primary_task(links(spark, sf_dir), tasks(spark, sf_dir))


@query(f"""WITH {FILES} SELECT doc_id, task_id, name FROM (SELECT l.doc_id, t.task_id, t.name, row_number() OVER (PARTITION BY doc_id ORDER BY is_primary DESC, t.name, t.task_id) AS r
  FROM links l JOIN tasks t ON l.task_id = t.task_id WHERE NOT not_a_task AND merged_into IS NULL) WHERE r = 1""")
def primary_live_task(spark, sf_dir):
    return C.primary_task(links(spark, sf_dir), tasks(spark, sf_dir), by_name=True)


@query(f"""WITH {FILES} SELECT f.doc_id, f.filename, n AS copies FROM f LEFT JOIN g ON f.hash = g.hash WHERE parse_status <> 'skipped' AND (missing OR f.hash IS NULL OR f.doc_id = g.rep)
  AND (contains(lower(filename), 'token') OR contains(lower(path), 'token') OR contains(lower(author), 'token') OR contains(lower(coalesce(body, '')), 'token'))""")
def find_documents(spark, sf_dir):
    return C.find_documents(files(spark, sf_dir), links(spark, sf_dir), "Token", documents_only=True, collapse=True).select("doc_id", "filename", "copies")


@query(f"WITH {FILES} SELECT f.doc_id, f.filename, n AS copies FROM f LEFT JOIN g ON f.hash = g.hash WHERE f.doc_id NOT IN (SELECT doc_id FROM links)")
def unclassified_documents(spark, sf_dir):
    return C.find_documents(files(spark, sf_dir), links(spark, sf_dir), unclassified=True).select("doc_id", "filename", "copies")


@query(f"WITH {FILES} SELECT doc_id, filename, date FROM f ORDER BY date DESC NULLS LAST, filename, doc_id LIMIT 50 OFFSET 50")
def listing_page(spark, sf_dir):
    return C.page(C.find_documents(files(spark, sf_dir), links(spark, sf_dir)), 2, 50)[0].select("doc_id", "filename", "date")


@query(f"""WITH {FILES}, p AS (SELECT * FROM f WHERE NOT missing AND parse_status = 'parsed'), s AS (SELECT * FROM p WHERE year >= (SELECT max(year) FROM p) - 2 AND doc_id NOT IN (SELECT doc_id FROM links))
SELECT count(*) AS stray, count(*) FILTER (WHERE doc_id % 4 = 0) AS done FROM s""")
def stray_recent(spark, sf_dir):
    checks = files(spark, sf_dir).filter("doc_id % 4 = 0").select(F.lit("stray").alias("kind"), F.col("doc_id").alias("target_id"), F.lit("done").alias("state"))
    return C.stray_recent(files(spark, sf_dir), links(spark, sf_dir), checks)


@query(f"""WITH {FILES}, m AS (SELECT 'hash' AS kind, hash AS name, doc_id FROM f WHERE NOT missing AND hash IS NOT NULL UNION SELECT 'step', task_id || '/' || doc_id % 40 || '/' || year, doc_id FROM f WHERE year IS NOT NULL),
z AS (SELECT kind, name, count(*) AS size, min(doc_id) AS representative FROM m GROUP BY ALL HAVING count(*) > 1) SELECT m.doc_id, m.kind, m.name, size, representative FROM m JOIN z ON m.kind = z.kind AND m.name = z.name""")
def version_siblings(spark, sf_dir):
    own = files(spark, sf_dir)
    steps = own.filter("year is not null").select("task_id", (F.col("doc_id") % 40).alias("label"), "year", "doc_id")
    return C.version_siblings(own, steps)


@query(f"""WITH {FILES} SELECT g.hash, min(f.doc_id) AS doc_id, count(*) > 1 AS undecided FROM g JOIN f ON f.hash = g.hash AND f.mtime = g.newest WHERE NOT f.missing GROUP BY g.hash""")
def latest_version(spark, sf_dir):
    return C.latest_version(files(spark, sf_dir))


def _case(table_, default):
    return "CASE " + " ".join(f"WHEN regexp_matches(filename, '(?i){p}') THEN {w}" for p, w, _ in table_) + f" ELSE {default} END"


def _said(table_):
    return "CASE " + " ".join("WHEN regexp_matches(filename, '(?i)" + p + "') THEN '" + r.replace("'", "''") + "'" for p, _, r in table_) + " ELSE '' END"


@query(f"""WITH {FILES}, i AS (SELECT r.task_id, r.doc_id, filename, greatest(2001 - year, 0) AS age, chars, date_kind, coalesce(n, 1) AS copies, r.doc_id % 29 = 0 AS pinned FROM reps r LEFT JOIN g ON r.hash = g.hash WHERE NOT missing),
s AS (SELECT *, round_even(CASE WHEN pinned THEN 10.0 ELSE 0 END + coalesce(greatest(0.0, (4 - age) / 4.0) * 2.0, 0) + {_case(C.TYPE_WEIGHTS, 1.0)} + {_case(C.FINAL_MARKS, 0.0)} + CASE WHEN copies > 1 THEN least(1.5, 0.5 * (copies - 1)) ELSE 0 END
  + CASE WHEN chars <= 0 THEN -0.5 WHEN chars < 200 THEN 0 ELSE 0.5 END + CASE WHEN date_kind = 'fs' THEN -0.8 ELSE 0 END, 3) AS score,
  list_filter([CASE WHEN pinned THEN '사용자가 대표 문서로 지정했습니다' ELSE '' END, {_said(C.FINAL_MARKS)}, {_said(C.TYPE_WEIGHTS)}, CASE WHEN age = 0 THEN '올해 자료입니다' WHEN age = 1 THEN '작년 자료로, 올해 작성 시 기준이 됩니다' ELSE '' END,
    CASE WHEN copies > 1 THEN '같은 문서가 ' || copies || '곳에 복사되어 있습니다' ELSE '' END], lambda x: x <> '') AS said FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, filename, doc_id) AS rank FROM s)
SELECT task_id, rank, doc_id, CAST(score AS DOUBLE) AS score, CASE WHEN len(said) = 0 THEN '{C.NO_REASON}' ELSE array_to_string(said[1:2], '. ') END AS reason FROM k WHERE rank <= 5""")
def reading_list(spark, sf_dir):
    own = files(spark, sf_dir)
    reps = C.with_copies(own).join(C.representatives(own).select("doc_id"), "doc_id", "left_semi").filter("not missing")
    facts = reps.select("task_id", "doc_id", "filename", "year", "date_kind", F.coalesce("copies", F.lit(1)).alias("copies"), "chars", F.lit(False).alias("is_version"), (F.col("doc_id") % 29 == 0).alias("pinned"))
    return C.reading_list(facts, 2001)
