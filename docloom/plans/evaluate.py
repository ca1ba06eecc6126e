"""Term, neighbour and evaluation queries. A conversation is a case and its outcome: it wants an answer
unless its number is divisible by four, and cites a document for each of its assistant turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as E
from ..operators import pages as P
from ..operators import search as S
from ..operators import verify as G
from .base import query, table
from .search import LINES, RANKED, chunks, parts
from .what import FILES, files, links

FREQUENCY = """df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT DISTINCT part AS term FROM w) t LEFT JOIN c ON contains(text, substr(term, 1, greatest(2, length(term) - 2))) GROUP BY term),
qt AS (SELECT DISTINCT query_id, part AS term FROM w), fl AS (SELECT query_id, qt.term, df <= 0.5 * (SELECT count(*) FROM documents) AS rare FROM qt JOIN df ON qt.term = df.term),
dt AS (SELECT query_id, term FROM (SELECT *, max(rare) OVER (PARTITION BY query_id) AS hits FROM fl) WHERE rare OR NOT hits)"""


def _distinctive(spark, sf_dir):
    asked = parts(spark, sf_dir).select("query_id", F.col("part").alias("term")).distinct()
    found = S.document_frequency(chunks(spark, sf_dir), asked.select("term").distinct())
    return S.distinctive_terms(asked, found, table(spark, sf_dir, "documents").count())


@query(f"WITH {RANKED}, {FREQUENCY} SELECT query_id, term FROM dt")
def distinctive_terms(spark, sf_dir):
    return _distinctive(spark, sf_dir)


@query(f"""WITH {RANKED}, {FREQUENCY}, a AS (SELECT query_id, chunk_id // {LINES} AS doc_id, chunk_id % {LINES} AS ordinal, rank FROM rk WHERE rank <= 3),
ne AS (SELECT query_id, doc_id, ordinal + d AS ordinal, rank * 3 + i AS pos, i = 0 AS anchor FROM a, (VALUES (0, 0), (1, -1), (2, 1)) o(i, d)),
st AS (SELECT query_id, list(DISTINCT substr(term, 1, greatest(2, length(term) - 2))) AS stems FROM dt GROUP BY query_id),
hi AS (SELECT ne.query_id, c.chunk_id, pos FROM ne JOIN c ON c.doc_id = ne.doc_id AND c.ordinal = ne.ordinal LEFT JOIN st ON st.query_id = ne.query_id WHERE anchor OR len(list_filter(stems, lambda s: contains(c.text, s))) > 0)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos FROM (SELECT query_id, chunk_id, min(pos) AS pos FROM hi GROUP BY query_id, chunk_id)""")
def expanded_context(spark, sf_dir):
    own = chunks(spark, sf_dir)
    first = S.text_rank(own, parts(spark, sf_dir), 3).select("query_id", "rank", F.expr(f"chunk_id div {LINES}").alias("doc_id"), (F.col("chunk_id") % LINES).cast("int").alias("ordinal"))
    return S.expand_neighbours(first, own, _distinctive(spark, sf_dir)).select("query_id", "chunk_id", "pos")


def _cases(spark, sf_dir):
    turns, c = table(spark, sf_dir, "conversations"), F.col("conv_id")
    text = lambda x: x.cast("string")
    cases = turns.select("conv_id").distinct().select(c.alias("id"), F.when(c % 4 == 0, "withhold").otherwise("answer").alias("expect"), F.array(F.concat(F.lit("doc"), text(c % 3))).alias("must_cite_any"), F.when(c % 5 == 0, F.array(F.lit("doc2"))).alias("must_not_cite"), F.array(F.lit("e")).alias("must_contain"), (c % 3).cast("int").alias("min_distinct_docs"))
    said = turns.filter("role = 'assistant'").groupBy(c.alias("id")).agg((F.count_if(F.col("text").isNotNull()) == 0).alias("none"), F.collect_list(F.concat(F.lit("doc"), text(F.col("turn") % 3))).alias("cited"), F.max("text").alias("answer"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("ms"))
    return cases, said.select("id", (F.col("none") | (F.col("id") % 6 == 0)).alias("withheld"), "cited", "answer", "ms")


CASES = """k AS (SELECT DISTINCT conv_id AS id FROM conversations), s AS (SELECT conv_id AS id, count(text) = 0 OR conv_id % 6 = 0 AS withheld, list('doc' || (turn % 3)) AS cited, max(text) AS answer, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS ms FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
v AS (SELECT k.id, NOT coalesce(withheld, true) AS given, coalesce(cited, []) AS cited, coalesce(answer, '') AS answer, ms FROM k LEFT JOIN s ON k.id = s.id),
j AS (SELECT *, list_filter([CASE WHEN (id % 4 <> 0) <> given THEN 'expectation' END, CASE WHEN given AND NOT list_contains(cited, 'doc' || (id % 3)) THEN 'must_cite_any' END, CASE WHEN id % 5 = 0 AND list_contains(cited, 'doc2') THEN 'must_not_cite' END,
  CASE WHEN given AND NOT contains(answer, 'e') THEN 'must_contain' END, CASE WHEN given AND len(list_distinct(cited)) < id % 3 THEN 'min_distinct_docs' END], lambda x: x IS NOT NULL) AS failures FROM v)"""


@query(f"WITH {CASES} SELECT id, array_to_string(failures, ',') AS failures, len(failures) = 0 AS passed FROM j")
def judged_cases(spark, sf_dir):
    return G.judge(*_cases(spark, sf_dir)).withColumn("failures", F.array_join("failures", ","))


@query(f"""WITH {CASES}, o AS (SELECT j.*, row_number() OVER (ORDER BY j.ms, j.id) AS n FROM j JOIN s ON j.id = s.id)
SELECT count(*) AS cases, count(*) FILTER (WHERE len(failures) = 0) AS passed, round(avg(len(list_distinct(cited))), 6) AS mean_cited, max(ms) FILTER (WHERE n = (SELECT count(*) FROM o) // 2 + 1) AS median_ms, max(ms) AS max_ms FROM o""")
def evaluation_summary(spark, sf_dir):
    cases, said = _cases(spark, sf_dir)
    return G.summary(G.judge(cases, said), said).withColumn("mean_cited", F.round("mean_cited", 6))


@query(f"WITH {CASES} SELECT id // 7 AS id, count(*) FILTER (WHERE len(failures) = 0) AS passes, count(*) AS rounds, count(*) FILTER (WHERE len(failures) = 0) BETWEEN 1 AND count(*) - 1 AS unstable FROM j GROUP BY 1")
def case_stability(spark, sf_dir):
    """Seven conversations in a row as rounds of one case."""
    return G.stability(G.judge(*_cases(spark, sf_dir)).select(F.expr("id div 7").alias("id"), (F.col("id") % 7).alias("round"), "passed"))


@query(f"""WITH {RANKED}, hi AS (SELECT query_id, chunk_id, chunk_id // {LINES} AS doc_id FROM rk WHERE rank <= 20), lk AS (SELECT CAST(substr(source, 4) AS BIGINT) AS task_id, doc_id FROM documents WHERE length(text) >= 120
  UNION ALL SELECT (CAST(substr(source, 4) AS BIGINT) + 1) % 20, doc_id FROM documents WHERE doc_id % 6 = 0 AND length(text) >= 120)
SELECT query_id, chunk_id, CASE WHEN query_id % 3 <> 0 THEN EXISTS (SELECT 1 FROM lk WHERE lk.doc_id = hi.doc_id AND lk.task_id = query_id % 20) END AS in_task FROM hi""")
def chunks_in_task(spark, sf_dir):
    """Two of three benchmark items ask within the task of their number."""
    hits = S.text_rank(chunks(spark, sf_dir), parts(spark, sf_dir), 20).select("query_id", "chunk_id", F.expr(f"chunk_id div {LINES}").alias("doc_id"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 != 0, F.col("item_id") % 20).alias("task_id"))
    return S.chunks_in_tasks(hits, asked, links(spark, sf_dir)).select("query_id", "chunk_id", "in_task")


CATEGORIES = ["plan", "report", "minutes"]


@query("""WITH d AS (SELECT doc_id, ['plan', ' report ', 'Minutes', 'other', NULL][doc_id % 5 + 1] AS category, ['HIGH', ' medium', 'sure', NULL][doc_id % 4 + 1] AS confidence, CASE WHEN doc_id % 7 <> 0 THEN list_transform(string_split(coalesce(text, ''), ' '), lambda w: '#' || w || ',') END AS words FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(coalesce(words, []), lambda w: regexp_replace(trim(regexp_replace(w, '\\s+', ' ', 'g')), '^[#·,.]+|[#·,.]+$', '', 'g')), lambda w: w <> '' AND length(w) <= 30) AS ws FROM d),
u AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM k) GROUP BY doc_id, w), f AS (SELECT doc_id, string_agg(w, '|' ORDER BY i) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM u) WHERE r <= 5 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN trim(category) IN ('plan', 'report', 'minutes') THEN trim(category) END AS category, CASE WHEN lower(trim(confidence)) IN ('high', 'medium', 'low') THEN lower(trim(confidence)) ELSE 'low' END AS confidence, coalesce(keywords, '') AS keywords FROM d LEFT JOIN f ON d.doc_id = f.doc_id""")
def cleaned_proposals(spark, sf_dir):
    """Categories, confidences and keywords as a model may give them; the keywords are all words of the text."""
    i = F.col("doc_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    words = F.when(i % 7 != 0, F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.concat(F.lit("#"), w, F.lit(","))))
    return table(spark, sf_dir, "documents").select("doc_id", G.clean_category(pick(["plan", " report ", "Minutes", "other", None]), CATEGORIES).alias("category"), G.clean_confidence(pick(["HIGH", " medium", "sure", None])).alias("confidence"), F.array_join(G.clean_keywords(words), "|").alias("keywords"))


def _steps(spark, sf_dir):
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.year("o_orderdate").alias("year"), (o % 5).alias("ordinal"), F.concat(F.lit("step "), (o % 3).cast("string")).alias("label"), o.alias("doc_id"), F.lit("machine").alias("decided_by"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 6 = 0 AND year(o_orderdate) % 2 = 0 THEN 'user' ELSE 'machine' END AS decided_by FROM orders""")
def confirmed_steps(spark, sf_dir):
    own = _steps(spark, sf_dir)
    return E.confirmed_steps(own, own.filter("task_id % 6 = 0 and year % 2 = 0")).select("doc_id", "decided_by")


@query("""WITH e AS (SELECT o_custkey AS target_id, arg_max(o_orderkey % 3 <> 0, o_orderkey) AS done FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey) SELECT target_id, CASE WHEN done THEN 'done' ELSE 'pending' END AS state FROM e""")
def reading_marks(spark, sf_dir):
    o = F.col("o_orderkey")
    return E.marks(table(spark, sf_dir, "orders").select(o.alias("seq"), F.when(o % 2 == 0, "reading").otherwise("stray").alias("kind"), F.col("o_custkey").alias("target_id"), (o % 3 != 0).alias("done")), "reading")


@query(f"""WITH {FILES}, s AS (SELECT o_custkey AS task_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey % 5 AS ordinal, 'step ' || (o_orderkey % 3) AS label, o_orderkey AS doc_id FROM orders)
SELECT s.task_id, s.year, row_number() OVER (PARTITION BY s.task_id, s.year ORDER BY ordinal, label, s.doc_id) AS rank, ordinal, label, filename FROM s LEFT JOIN f ON s.doc_id = f.doc_id""")
def ordered_steps(spark, sf_dir):
    return P.ordered_steps(_steps(spark, sf_dir), files(spark, sf_dir))
