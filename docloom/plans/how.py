"""Comparison, decision, health, progress and ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import compare as P
from ..operators import timeline as T
from ..sources import ingest as I
from .base import CYCLES, dated_docs, query, table
from .what import FILES, chunk_states, files, links, tasks  # noqa: F401
from .when import STEPS, _candidates


def _steps(spark, sf_dir):
    return T.steps(_candidates(spark, sf_dir)).withColumn("doc_key", F.col("doc"))


@query()
def year_comparison(spark, sf_dir):
    return P.compare_years(_steps(spark, sf_dir), 1999, 2000)


@query(f"""WITH {STEPS}, b AS (SELECT task FROM st WHERE year IN (1999, 2000) GROUP BY task HAVING count(DISTINCT year) = 2)
SELECT task, count(*) FILTER (WHERE year = 1999) AS n_earlier, count(*) FILTER (WHERE year = 2000) AS n_later FROM st WHERE task IN (SELECT task FROM b) AND year IN (1999, 2000) GROUP BY task""")
def year_comparison_sizes(spark, sf_dir):
    own = P.compare_years(_steps(spark, sf_dir), 1999, 2000)
    return own.groupBy("task").agg(F.count("earlier_month").alias("n_earlier"), F.count("later_month").alias("n_later"))


def _events(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("target_id"), F.element_at(F.array(F.lit("kind"), F.lit("name")), (F.col("o_orderkey") % 2 + 1).cast("int")).alias("field"), F.concat(F.lit("v"), (F.col("o_orderkey") % 97).cast("string")).alias("after_val"))
    return o.filter("seq % 4 != 0").withColumn("target", F.lit("task"))


@query("""SELECT 'task' AS target, o_custkey AS target_id, ['kind', 'name'][o_orderkey % 2 + 1] AS field, arg_max('v' || (o_orderkey % 97), o_orderkey) AS value FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL""")
def current_decisions(spark, sf_dir):
    return P.current_decisions(_events(spark, sf_dir))


@query(f"""WITH {CYCLES}, e AS (SELECT o_custkey AS task, arg_max('v' || (o_orderkey % 97), o_orderkey) AS v FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 2 = 0 GROUP BY o_custkey)
SELECT cy.task, coalesce(v, kind) AS kind, confidence, v IS NOT NULL AS decided FROM cy LEFT JOIN e ON cy.task = e.task""")
def decision_overlay(spark, sf_dir):
    derived = T.cycles(dated_docs(spark, sf_dir)).select("task", "kind", "confidence")
    return P.overlay(derived, "task", P.current_decisions(_events(spark, sf_dir)), "task", {"kind": "kind"})


@query(f"""WITH {CYCLES} SELECT task, kind, 'machine' AS decided_by FROM cy WHERE task % 5 <> 0 UNION ALL SELECT DISTINCT o_custkey, 'yearly', 'user' FROM orders WHERE o_custkey % 5 = 0""")
def owned_cycles(spark, sf_dir):
    derived = T.cycles(dated_docs(spark, sf_dir)).select("task", "kind", F.lit("machine").alias("decided_by"))
    decided = table(spark, sf_dir, "orders").filter("o_custkey % 5 = 0").select(F.col("o_custkey").alias("task"), F.lit("yearly").alias("kind"), F.lit("user").alias("decided_by")).distinct()
    return P.owned_groups(derived, decided, ["task"])


@query(f"""WITH RECURSIVE m AS (SELECT DISTINCT c_custkey AS task_id, c_custkey - 1 AS merged_into FROM customer WHERE c_custkey % 6 <> 1),
r AS (SELECT task_id, merged_into AS x FROM m UNION ALL SELECT r.task_id, m.merged_into FROM r JOIN m ON m.task_id = r.x) SELECT task_id, min(x) AS into FROM r GROUP BY task_id""".replace(" AS into", ' AS "into"'))
def merged_tasks(spark, sf_dir):
    own = table(spark, sf_dir, "customer").filter("c_custkey % 6 != 1").select(F.col("c_custkey").alias("task_id"), (F.col("c_custkey") - 1).alias("merged_into")).distinct()
    return P.merge_targets(own)


@query()
def replayed_edits(spark, sf_dir):
    own = cut(_steps(spark, sf_dir).select("task", "year", "ordinal", "label"))
    edits = own.filter("task % 7 = 0 and ordinal = 1").select("task", "year", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("relabel").alias("op"), F.lit(1).alias("at"), F.lit("first").alias("label")), F.struct(F.lit(2).alias("seq"), F.lit("add").alias("op"), F.lit(1).alias("at"), F.lit("new").alias("label")), F.struct(F.lit(3).alias("seq"), F.lit("delete").alias("op"), F.lit(3).alias("at"), F.lit("").alias("label")))).alias("e")).select("task", "year", "e.*")
    return P.replay_order(own, edits)


HEALTH = f"""{FILES}, y AS (SELECT max(year) AS corpus_year FROM f WHERE NOT missing), s AS (SELECT l.task_id, count(*) AS doc_count, max(CASE WHEN NOT missing THEN year END) AS latest_year, bool_or(is_primary) AS has_primary, count(*) FILTER (WHERE l.doc_id % 4 = 0) AS reading_count, count(*) FILTER (WHERE l.doc_id % 10 = 1) AS step_count FROM links l JOIN f ON l.doc_id = f.doc_id GROUP BY l.task_id),
h AS (SELECT t.task_id, name, t.task_id % 3 <> 0 AS d1, coalesce(doc_count, 0) > 0 AS d2, coalesce(latest_year >= corpus_year - 2, false) AS d3, coalesce(reading_count, 0) > 0 AS d4, t.task_id % 2 = 0 AS d5, coalesce(step_count, 0) > 0 AS d6, coalesce(has_primary, false) AS d7, t.task_id % 5 = 0 AS d8 FROM tasks t LEFT JOIN s ON t.task_id = s.task_id, y WHERE NOT not_a_task AND merged_into IS NULL)"""


def _health(spark, sf_dir):
    own, f = tasks(spark, sf_dir), files(spark, sf_dir)
    d = F.col("doc_id")
    by = links(spark, sf_dir).join(f.select("doc_id", "missing", "year"), "doc_id").groupBy("task_id").agg(F.count("*").alias("doc_count"), F.max(F.when(~F.col("missing"), F.col("year"))).alias("latest_year"), F.bool_or("is_primary").alias("has_primary"), F.count_if(d % 4 == 0).alias("reading_count"), F.count_if(d % 10 == 1).alias("step_count"))
    last = F.broadcast(f.filter("not missing").agg(F.max("year").alias("corpus_year")))  # one row
    live = own.filter("not not_a_task and merged_into is null").join(by, "task_id", "left").crossJoin(last)
    t = F.col("task_id")
    return live.withColumns({"description": F.when(t % 3 != 0, "said"), "has_cycle": t % 2 == 0, "reviewed": t % 5 == 0, "doc_count": F.coalesce("doc_count", F.lit(0)), "reading_count": F.coalesce("reading_count", F.lit(0)), "step_count": F.coalesce("step_count", F.lit(0))})


_W = (2, 3, 2, 2, 2, 2, 1, 2)
_LACK = " ".join(f"WHEN NOT d{i + 1} THEN '{P.CHECKS[i][1]}'" for i in (1, 0, 2, 3, 4, 5, 7, 6))


@query(f"""WITH {HEALTH} SELECT task_id, name, CAST(round_even(({' + '.join(f'CASE WHEN d{i + 1} THEN {w} ELSE 0 END' for i, w in enumerate(_W))}) * 100 / 16.0, 0) AS INTEGER) AS score,
  CASE WHEN NOT (d2 AND d3 AND d4 AND d6) THEN 'thin' WHEN NOT (d1 AND d5 AND d7 AND d8) THEN 'attention' ELSE 'good' END AS grade, CASE {_LACK} END AS headline FROM h""")
def task_health(spark, sf_dir):
    return P.health_order(P.health(_health(spark, sf_dir)))


PROGRESS = f"""{FILES}, n AS (SELECT (SELECT count(*) FROM tasks) AS a1, (SELECT count(*) FROM tasks WHERE task_id % 3 = 0) AS a2, (SELECT count(*) FROM links) AS b1, (SELECT count(*) FROM links WHERE doc_id % 4 = 0) AS b2, (SELECT count(*) FROM ch) AS c1, (SELECT count(*) FILTER (WHERE embedded) FROM ch) AS c2)"""


@query(f"""WITH {PROGRESS} SELECT CAST(round_even((a2 / a1 + b2 / b1 + c2 / c1) / 3 * 100, 0) AS INTEGER) AS percent, CASE WHEN a2 / a1 <= b2 / b1 AND a2 / a1 <= c2 / c1 THEN 'tasks' WHEN b2 / b1 <= c2 / c1 THEN 'reading' ELSE 'cycles' END AS next_axis FROM n""")
def handover_progress(spark, sf_dir):
    a = tasks(spark, sf_dir).agg(F.count("*").alias("tasks_total"), F.count_if(F.col("task_id") % 3 == 0).alias("tasks_done"))
    b = links(spark, sf_dir).agg(F.count("*").alias("reading_total"), F.count_if(F.col("doc_id") % 4 == 0).alias("reading_done"))
    c = chunk_states(spark, sf_dir).agg(F.count("*").alias("cycles_total"), F.count_if("embedded").alias("cycles_done"))
    return P.progress(a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).withColumns({"steps_total": F.lit(0), "steps_done": F.lit(0)}))  # one row each


def _snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.length("text").alias("size"))
    i = F.col("doc_id")
    before = d.filter("doc_id % 11 != 0").select("path", "size", (i % 50).alias("mtime"), (i % 6 == 0).alias("missing"))
    now = d.filter("doc_id % 7 != 0").select("path", F.when(i % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (i % 50).alias("mtime"), F.lit(True).alias("scan_complete"))
    return before, now


DIFF = """d AS (SELECT doc_id, source, source || '/' || doc_id AS path FROM documents), z AS (SELECT path, source, CASE WHEN doc_id % 11 = 0 THEN 'new' WHEN doc_id % 7 = 0 AND doc_id % 6 = 0 THEN 'still missing' WHEN doc_id % 7 = 0 THEN 'missing'
  WHEN doc_id % 5 = 0 THEN 'changed' WHEN doc_id % 6 = 0 THEN 'restored' ELSE 'unchanged' END AS change FROM d WHERE NOT (doc_id % 11 = 0 AND doc_id % 7 = 0))"""


@query(f"WITH {DIFF} SELECT path, change FROM z")
def snapshot_diff(spark, sf_dir):
    return I.snapshot_diff(*_snapshots(spark, sf_dir))


@query(f"WITH {DIFF} SELECT source, count(*) AS found, {', '.join(f'count(*) FILTER (WHERE change = {chr(39)}{k}{chr(39)}) AS {q}' for k, q in (('new', 'new'), ('changed', 'changed'), ('unchanged', 'unchanged'), ('missing', 'missing'), ('restored', 'restored')))} FROM z GROUP BY source")
def scan_statistics(spark, sf_dir):
    return I.scan_statistics(I.snapshot_diff(*_snapshots(spark, sf_dir)), F.substring_index("path", "/", 1))


@query("""WITH l AS (SELECT o_custkey % 50 AS doc_id, o_orderkey AS t, o_orderkey % 3 = 0 AS ok, o_orderkey % 5 = 0 AS locked FROM orders), m AS (SELECT doc_id, max(t) FILTER (WHERE ok) AS k FROM l GROUP BY doc_id),
n AS (SELECT l.doc_id, count(*) FILTER (WHERE NOT ok AND NOT locked AND (k IS NULL OR t > k)) AS failures FROM l JOIN m ON l.doc_id = m.doc_id GROUP BY l.doc_id)
SELECT 'parse' AS kind, doc_id, failures, CASE WHEN failures >= 3 THEN 'failed_final' WHEN failures > 0 THEN 'retry' ELSE 'ok' END AS state FROM n""")
def retry_ledger(spark, sf_dir):
    k = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(F.lit("parse").alias("kind"), (F.col("o_custkey") % 50).alias("doc_id"), k.alias("at"), (k % 3 == 0).alias("ok"), F.when(k % 5 == 0, "locked").otherwise("broken").alias("error"))
    return I.retry_state(own)


@query("""SELECT doc_id, version, guarded FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY guarded AND version = 1 DESC, version DESC) AS r FROM (
  SELECT o_custkey AS doc_id, 1 AS version, o_custkey % 4 = 0 AS guarded FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 3 <> 0) UNION ALL SELECT o_custkey, 2, false FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 2 = 0))) WHERE r = 1""")
def guarded_upsert(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")).distinct()
    have = own.filter("doc_id % 3 != 0").select("doc_id", F.lit(1).alias("version"), (F.col("doc_id") % 4 == 0).alias("guarded"))
    return I.upsert(have, own.filter("doc_id % 2 = 0").select("doc_id", F.lit(2).alias("version"), F.lit(False).alias("guarded")), ["doc_id"], "version", F.col("guarded"))


@query(f"WITH {FILES} SELECT doc_id FROM f WHERE NOT missing AND doc_id % 4 < 3 AND doc_id % 6 <> 0")
def work_selection(spark, sf_dir):
    own = files(spark, sf_dir).withColumn("attempts", F.col("doc_id") % 4)
    return I.work_needed(own, own.filter("doc_id % 6 = 0").select("doc_id", F.lit("2").alias("version")), "2").select("doc_id")


@query(f"WITH {FILES} SELECT doc_id, ordinal FROM ch WHERE doc_id % 9 <> 0 OR ordinal = 1")
def invalidation(spark, sf_dir):
    own = chunk_states(spark, sf_dir)
    return I.invalidate(own, own.filter("doc_id % 9 = 0").select("doc_id"), "doc_id", F.col("ordinal") == 1).select("doc_id", "ordinal")


@query("""SELECT CASE WHEN doc_id % 9 = 0 THEN 'md' ELSE 'txt' END AS ext, count(*) AS files, count(*) FILTER (WHERE doc_id % 13 <> 0) AS parsed, round(avg(doc_id % 17), 6) AS mean_ms, round(avg(length(text)), 6) AS mean_chars, count(*) FILTER (WHERE len(string_split(text, chr(10))) > 1) AS structured,
  round(count(*) FILTER (WHERE doc_id % 13 <> 0) / count(*), 6) AS rate, CASE WHEN count(*) FILTER (WHERE doc_id % 13 <> 0) / count(*) >= 0.95 THEN 'pass' WHEN count(*) FILTER (WHERE doc_id % 13 <> 0) / count(*) >= 0.8 THEN 'warn' ELSE 'fail' END AS gate FROM documents GROUP BY 1""")
def parse_summary(spark, sf_dir):
    i = F.col("doc_id")
    own = table(spark, sf_dir, "documents").select(F.when(i % 9 == 0, "md").otherwise("txt").alias("ext"), F.when(i % 13 == 0, "failed").otherwise("parsed").alias("status"), (i % 17).alias("elapsed_ms"), F.length("text").alias("chars"), F.size(F.split("text", "\n")).alias("sections"))
    return I.parse_summary(own).withColumns({c: F.round(c, 6) for c in ("mean_ms", "mean_chars", "rate")})


@query("""WITH z AS (SELECT source || '/' || doc_id AS path, doc_id, length(text) AS n FROM documents)
SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'lost' WHEN doc_id % 5 = 0 THEN 'status' WHEN doc_id % 3 = 0 THEN 'text' END AS change, doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 = 0 AND 30 > 0.02 * greatest(n, 1) AS large FROM z
WHERE (doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0) AND NOT (doc_id % 11 = 0 AND doc_id % 7 = 0)""")
def parse_regression(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", i.cast("string")).alias("path"), F.lit(1).alias("sections"), F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"), F.lit("parsed").alias("status"))
    now = d.withColumns({"status": F.when(i % 5 == 0, "failed").otherwise("parsed"), "text_sha256": F.when(i % 3 == 0, "x").otherwise(F.col("text_sha256")), "chars": F.when(i % 3 == 0, F.col("chars") + 30).otherwise(F.col("chars"))})
    return I.parse_regression(d.filter("doc_id % 11 != 0"), now.filter("doc_id % 7 != 0"))


@query("""WITH p AS (SELECT doc_id, list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x) <> '') AS ps, string_split(text, chr(10)) AS rs FROM documents)
SELECT doc_id, CASE WHEN len(ps) > 1 OR len(rs) <= 40 THEN len(ps) ELSE (len(rs) - 1) // 40 + 1 END AS n FROM p WHERE len(ps) > 0""")
def text_sections(spark, sf_dir):
    return I.text_sections(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"))
