"""Page, answer, proposal and edit queries.

Tasks, links and files as in ``what``. A conversation cites the documents whose id is its own plus 7 times
the turn, where there are such; questions are its user turns; steps of a task are its documents in order of
date. Edits are derived from ids, so that each table of edits grows with its targets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as E
from ..operators import pages as P
from ..operators import timeline as T
from ..operators import verify as G
from .base import query, table
from .search import SECTIONS, sections
from .what import FILES, files, links, tasks
from .when import STEPS, _candidates


def docs(spark, sf_dir):
    return files(spark, sf_dir).withColumns({"month": F.month("date"), "kind": F.col("date_kind")})


def reading(spark, sf_dir):
    return links(spark, sf_dir).filter("doc_id % 4 = 0").select("task_id", "doc_id", (F.col("doc_id") % 9 + 1).alias("ordinal"), F.lit("said").alias("reason"))


def cycles(spark, sf_dir):
    """One cycle for each task and year-kind of its documents."""
    kind = F.element_at(F.array(*map(F.lit, ("yearly", "monthly", "none"))), (F.col("doc_id") % 3 + 1).cast("int"))
    own = links(spark, sf_dir).join(files(spark, sf_dir).select("doc_id", "year"), "doc_id").select("task_id", kind.alias("kind"), F.when(F.col("task_id") % 4 == 0, "user").otherwise("auto").alias("by"), "year")
    return own.groupBy("task_id", "kind", F.col("by").alias("decided_by")).agg(F.countDistinct("year").cast("long").alias("years_observed"))


CYCLE = """cy AS (SELECT l.task_id, ['yearly', 'monthly', 'none'][l.doc_id % 3 + 1] AS kind, CASE WHEN l.task_id % 4 = 0 THEN 'user' ELSE 'auto' END AS decided_by, count(DISTINCT year) AS years_observed FROM links l JOIN f ON l.doc_id = f.doc_id GROUP BY ALL)"""


def citations(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("long").alias("pos"), (F.col("conv_id") + 7 * F.col("turn")).alias("doc_id"))
    return said.join(files(spark, sf_dir).select("doc_id"), "doc_id").select("query_id", "pos", "doc_id")


CITED = """ci AS (SELECT conv_id AS query_id, CAST(turn AS BIGINT) AS pos, conv_id + 7 * turn AS doc_id FROM conversations WHERE role = 'assistant' AND conv_id + 7 * turn IN (SELECT doc_id FROM f))"""


def questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user' and text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"))


ASKED = """qs AS (SELECT conv_id * 1000 + turn AS id, text AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL)"""
LIVE = "lt AS (SELECT task_id, name FROM tasks WHERE NOT not_a_task AND merged_into IS NULL)"


@query(f"WITH {FILES} SELECT l.task_id, row_number() OVER (PARTITION BY l.task_id ORDER BY date DESC NULLS LAST, filename, l.doc_id) AS rank, l.doc_id, filename, date FROM links l JOIN f ON l.doc_id = f.doc_id")
def task_documents(spark, sf_dir):
    return P.task_documents(links(spark, sf_dir), docs(spark, sf_dir))


@query(f"WITH {FILES} SELECT l.task_id, l.doc_id % 9 + 1 AS ordinal, l.doc_id, filename, missing, 'said' AS reason FROM links l JOIN f ON l.doc_id = f.doc_id WHERE l.doc_id % 4 = 0")
def task_reading(spark, sf_dir):
    return P.task_reading(reading(spark, sf_dir), docs(spark, sf_dir))


@query(f"WITH {FILES}, {LIVE} SELECT doc_id, string_agg(name, ',' ORDER BY is_primary DESC, name) AS tasks FROM links l JOIN lt ON l.task_id = lt.task_id GROUP BY doc_id")
def document_tasks(spark, sf_dir):
    return P.document_tasks(links(spark, sf_dir), tasks(spark, sf_dir)).select("doc_id", F.array_join("tasks", ",").alias("tasks"))


@query(f"WITH {FILES}, {LIVE}, {CYCLE} SELECT cy.task_id, kind, decided_by, years_observed, name FROM cy JOIN lt ON cy.task_id = lt.task_id WHERE kind <> 'none'")
def live_cycles(spark, sf_dir):
    return P.live_cycles(cycles(spark, sf_dir), tasks(spark, sf_dir))


@query(f"WITH {FILES}, {CYCLE} SELECT task_id, kind, decided_by, years_observed FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY decided_by = 'user' DESC, years_observed DESC, kind) AS r FROM cy) WHERE r = 1")
def effective_cycle(spark, sf_dir):
    return P.effective_cycle(cycles(spark, sf_dir)).select("task_id", "kind", "decided_by", "years_observed")


@query(f"""WITH {FILES}, o AS (SELECT l.task_id, month(date) AS month, l.doc_id, row_number() OVER (PARTITION BY l.task_id, month(date) ORDER BY year DESC, l.doc_id) AS rank
  FROM links l JOIN reps ON l.doc_id = reps.doc_id WHERE date_kind <> 'fs' AND date IS NOT NULL) SELECT task_id, month, rank, doc_id FROM o WHERE rank <= 3""")
def month_documents(spark, sf_dir):
    from ..operators.catalogue import representatives

    return P.month_documents(links(spark, sf_dir), representatives(docs(spark, sf_dir)))


@query(f"WITH {STEPS} SELECT task, month, year, label FROM (SELECT *, row_number() OVER (PARTITION BY task, month ORDER BY year DESC, ordinal DESC, label) AS r FROM st WHERE month IS NOT NULL) WHERE r = 1")
def latest_month_step(spark, sf_dir):
    return P.latest_month_step(T.steps(_candidates(spark, sf_dir)))


@query(f"""WITH {FILES}, y AS (SELECT l.task_id, year FROM links l JOIN f ON l.doc_id = f.doc_id WHERE year IS NOT NULL AND NOT missing UNION SELECT task_id, 1990 + task_id FROM tasks UNION SELECT task_id, 2001 FROM links)
SELECT task_id, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years FROM y GROUP BY task_id""")
def task_years(spark, sf_dir):
    confirmed = tasks(spark, sf_dir).select("task_id", (F.col("task_id") + 1990).cast("int").alias("year"))
    own = P.task_years(links(spark, sf_dir), docs(spark, sf_dir), confirmed, 2001)
    return own.select("task_id", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


@query(f"""WITH {FILES}, {LIVE}, fi AS (SELECT doc_id, arg_min(l.task_id, (name, l.task_id)) AS task_id, min(name) AS name FROM links l JOIN lt ON l.task_id = lt.task_id GROUP BY doc_id),
ly AS (SELECT l.task_id, max(year) AS latest_year FROM links l JOIN f ON l.doc_id = f.doc_id WHERE NOT missing GROUP BY l.task_id)
SELECT f.doc_id, fi.name AS task, coalesce(n, 1) AS copies, latest_year, CASE WHEN n > 1 THEN CASE WHEN mtime >= newest THEN 'newest copy' ELSE 'newer copy exists' END WHEN year < latest_year THEN 'newer year exists' ELSE 'current' END AS freshness
FROM f LEFT JOIN g ON f.hash = g.hash LEFT JOIN fi ON f.doc_id = fi.doc_id LEFT JOIN ly ON fi.task_id = ly.task_id""")
def document_context(spark, sf_dir):
    return P.document_context(docs(spark, sf_dir), links(spark, sf_dir), tasks(spark, sf_dir))


BODY = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(f"""WITH {SECTIONS}, e AS (SELECT doc_id, locator, {BODY.format('body')} AS body, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS r FROM s WHERE {BODY.format('body')} <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY body = 'title', r) AS k FROM e WHERE r <= 5)
SELECT doc_id, locator, CASE WHEN length(body) <= 180 THEN body ELSE rtrim(substr(body, 1, 179)) || '…' END AS snippet FROM p WHERE k = 1""")
def evidence_snippets(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select("doc_id", F.lit("title.txt").alias("filename"))
    return P.evidence_snippets(sections(spark, sf_dir), named)


@query("""WITH i AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(source || ', ' || doc_id || ',x,' || doc_id // 2, ','), lambda x: trim(x)), lambda x: regexp_matches(x, '^[0-9]+$')), lambda x: CAST(x AS BIGINT)) AS ids FROM documents)
SELECT doc_id, len(ids) AS n, list_sum(ids) AS total FROM i""")
def evidence_ids(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    said = F.concat("source", F.lit(", "), i, F.lit(",x,"), F.expr("doc_id div 2").cast("string"))
    ids = P.evidence_ids(said)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ids).alias("n"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""WITH {FILES}, r AS (SELECT task_id, list(doc_id ORDER BY doc_id DESC)[1:8] AS ids FROM links WHERE task_id % 4 <> 0 GROUP BY task_id), u AS (SELECT task_id, unnest(range(len(ids))) AS pos, unnest(ids) AS doc_id FROM r)
SELECT u.task_id AS key, pos, u.doc_id, filename FROM u JOIN f ON u.doc_id = f.doc_id""")
def task_evidence(spark, sf_dir):
    from ..operators.catalogue import top_per_group

    last = top_per_group(links(spark, sf_dir).select("task_id", "doc_id"), ["task_id"], [F.desc("doc_id")], 8)
    ids = last.groupBy(F.col("task_id").alias("key")).agg(F.sort_array(F.collect_list("doc_id"), asc=False).alias("ids"))
    return P.evidence_list(ids.withColumn("decided_by", F.when(F.col("key") % 4 == 0, "user")), docs(spark, sf_dir))


@query(f"WITH {FILES} SELECT task_id, doc_id, doc_id % 9 + 1 AS ordinal FROM links WHERE doc_id % 4 = 0 AND doc_id % 3 <> 1")
def unread_picks(spark, sf_dir):
    checks = files(spark, sf_dir).select(F.lit("read").alias("kind"), F.col("doc_id").alias("target_id"), F.when(F.col("doc_id") % 3 == 1, "done").otherwise("open").alias("state"))
    return P.unread_picks(reading(spark, sf_dir), checks).select("task_id", "doc_id", "ordinal")


@query(f"WITH {FILES}, p AS (SELECT task_id, min(doc_id) AS doc_id FROM links WHERE is_primary GROUP BY task_id) SELECT p.task_id, p.doc_id, filename FROM p JOIN f ON p.doc_id = f.doc_id")
def primary_documents(spark, sf_dir):
    return P.primary_documents(links(spark, sf_dir), docs(spark, sf_dir))


@query(f"""WITH {FILES}, {CITED}, k AS (SELECT query_id, doc_id, pos, coalesce(body, '') AS text FROM (SELECT ci.*, body FROM ci JOIN f ON ci.doc_id = f.doc_id))
SELECT query_id, doc_id, sha256(string_agg(text, chr(10) ORDER BY pos, text)) AS support FROM k GROUP BY ALL""")
def support_texts(spark, sf_dir):
    cited = citations(spark, sf_dir)
    context = cited.join(files(spark, sf_dir).select("doc_id", F.coalesce("body", F.lit("")).alias("text")), "doc_id")
    return P.support_texts(cited, context).withColumn("support", F.sha2("support", 256))


@query(f"""WITH {SECTIONS}, d AS (SELECT doc_id, {BODY.format('text')} AS b FROM documents),
c AS (SELECT doc_id, p AS pos, CASE p WHEN 0 THEN (doc_id % 3 + 1) || '문단' WHEN 1 THEN 'page ' || (doc_id % 5) || ' / 2 문단 앞' WHEN 2 THEN '?' END AS locator, CASE p WHEN 3 THEN substr(b, 1, 7) ELSE substr(b, 5, 60) END AS snippet FROM d, range(4) r(p)),
n AS (SELECT *, TRY_CAST(regexp_extract(locator, '([0-9]{{1,9}})\\s*문단', 1) AS BIGINT) AS number, substr({BODY.format('snippet')}, 1, 40) AS start FROM c),
bb AS (SELECT n.doc_id, pos, s.ordinal, CASE WHEN s.locator = n.locator THEN 1 WHEN s.ordinal = number THEN 2 WHEN length(start) >= 8 AND contains({BODY.format('raw')}, start) THEN 3 END AS how
  FROM n JOIN (SELECT s0.doc_id, CAST(s0.ordinal AS INTEGER) + 1 AS ordinal, (s0.ordinal // 2 + 1) || '문단' AS locator, raw FROM s0) s ON n.doc_id = s.doc_id),
z AS (SELECT doc_id, pos, min(how) AS how, arg_min(ordinal, (how, ordinal)) AS first FROM bb WHERE how IS NOT NULL GROUP BY doc_id, pos)
SELECT bb.doc_id AS query_id, bb.pos, bb.doc_id, bb.ordinal, bb.how FROM bb JOIN z ON bb.doc_id = z.doc_id AND bb.pos = z.pos AND bb.how = z.how WHERE bb.how = 1 OR bb.ordinal = first""")
def cited_sections(spark, sf_dir):
    """Four citations of each document; sections count from 1 and two of them share a locator."""
    i = F.col("doc_id")
    where = [F.concat((i % 3 + 1).cast("string"), F.lit("문단")), F.concat(F.lit("page "), (i % 5).cast("string"), F.lit(" / 2 문단 앞")), F.lit("?"), F.lit(None).cast("string")]
    from ..functions.text import collapse

    body = collapse(F.col("text"))
    each = F.array(*(F.struct(F.lit(p).cast("long").alias("pos"), w.alias("locator"), (F.substring(body, 1, 7) if p == 3 else F.substring(body, 5, 60)).alias("snippet")) for p, w in enumerate(where)))
    cited = table(spark, sf_dir, "documents").select(i.alias("query_id"), "doc_id", F.explode(each).alias("c")).select("query_id", "doc_id", "c.*")
    own = sections(spark, sf_dir).withColumns({"locator": F.concat((F.expr("ordinal div 2") + 1).cast("string"), F.lit("문단")), "ordinal": F.col("ordinal") + 1})
    return P.cited_sections(cited, own)


MAJORITY = f"""{FILES}, {CITED}, mj AS (SELECT query_id, task_id FROM (SELECT query_id, task_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(pos), task_id) AS r FROM ci JOIN links l ON ci.doc_id = l.doc_id GROUP BY query_id, task_id) WHERE r = 1)"""


@query(f"WITH {MAJORITY} SELECT query_id, task_id FROM mj")
def majority_task(spark, sf_dir):
    return P.majority_task(citations(spark, sf_dir), links(spark, sf_dir))


@query(f"""WITH {MAJORITY}, ye AS (SELECT query_id, max(year) AS year FROM ci JOIN f ON ci.doc_id = f.doc_id GROUP BY query_id), st AS (SELECT l.task_id, year, month(date) AS ordinal, filename AS label, l.doc_id FROM links l JOIN f ON l.doc_id = f.doc_id WHERE year IS NOT NULL)
SELECT query_id, task_id, year, label FROM (SELECT mj.query_id, mj.task_id, ye.year, label, row_number() OVER (PARTITION BY mj.query_id ORDER BY ordinal, label) AS r FROM mj JOIN ye ON mj.query_id = ye.query_id JOIN st ON st.task_id = mj.task_id AND st.year = ye.year
  WHERE NOT EXISTS (SELECT 1 FROM ci WHERE ci.query_id = mj.query_id AND ci.doc_id = st.doc_id)) WHERE r = 1""")
def next_steps(spark, sf_dir):
    d = docs(spark, sf_dir)
    steps = links(spark, sf_dir).select("task_id", "doc_id").join(d.filter("year is not null").select("doc_id", "year", F.col("month").alias("ordinal"), F.col("filename").alias("label")), "doc_id")
    return P.next_steps(citations(spark, sf_dir), links(spark, sf_dir), d, steps)


@query(f"WITH {ASKED} SELECT question, max(id) AS last FROM qs GROUP BY question ORDER BY last DESC LIMIT 5")
def question_history(spark, sf_dir):
    return P.question_history(questions(spark, sf_dir))


@query(f"WITH {FILES} SELECT doc_id, sha256(filename || chr(10) || substr({BODY.format('coalesce(body, chr(32))')}, 1, 1200)) AS text FROM f")
def embed_texts(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", F.sha2(P.embed_text(F.col("filename"), F.col("body")), 256).alias("text"))


@query(f"""WITH {FILES}, k AS (SELECT task_id, doc_id FROM links WHERE NOT (task_id % 3 = 0 AND NOT is_primary)), t AS (SELECT task_id FROM tasks WHERE task_id % 3 <> 0 OR task_id IN (SELECT task_id FROM k)) SELECT t.task_id, count(k.doc_id) AS n FROM t LEFT JOIN k ON t.task_id = k.task_id GROUP BY t.task_id""")
def cleared_proposals(spark, sf_dir):
    own = tasks(spark, sf_dir).withColumn("status", F.when(F.col("task_id") % 3 == 0, "proposed").otherwise("confirmed"))
    made = links(spark, sf_dir).withColumn("origin", F.when(F.col("is_primary"), "user").otherwise("machine"))
    left, kept = P.cleared_proposals(own, made)
    return left.select("task_id").join(kept.select("task_id", "doc_id"), "task_id", "left").groupBy("task_id").agg(F.count("doc_id").alias("n"))


@query(f"WITH {FILES}, {LIVE} SELECT doc_id, min(name) AS task, count(*) AS assignments FROM links l JOIN lt ON l.task_id = lt.task_id GROUP BY doc_id")
def single_task(spark, sf_dir):
    return P.single_task(links(spark, sf_dir), tasks(spark, sf_dir))


# Edits --------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey // 10 AS g, c_custkey % 10 AS r, count(*) OVER (PARTITION BY c_custkey // 10) AS size FROM customer),
v AS (SELECT k, g, r, size, CASE WHEN size < 10 THEN 'as it was' WHEN g % 4 = 0 THEN CASE WHEN r = 0 THEN 'as it was' ELSE 'down' END WHEN g % 4 = 1 THEN 'as it was' WHEN g % 4 = 2 THEN CASE WHEN r = 9 THEN 'new' ELSE 'as it was' END ELSE CASE WHEN r IN (0, 9) THEN 'new' ELSE 'as it was' END END AS kind FROM c)
SELECT k AS task_id, CASE kind WHEN 'as it was' THEN 'task' || k WHEN 'new' THEN 'new' || g || '_' || r WHEN 'down' THEN 'task' || (k - 1) END AS name, CASE WHEN kind = 'as it was' THEN 'proposed' ELSE 'edited' END AS status,
  CASE WHEN kind = 'as it was' THEN 'machine' ELSE 'user' END AS origin, CASE WHEN kind = 'as it was' THEN 'open' ELSE 'confirmed' END AS review_state FROM v WHERE NOT (g % 4 = 0 AND size = 10 AND r = 0)
UNION ALL SELECT k, 'moved' || g, 'edited', 'user', 'confirmed' FROM v WHERE g % 4 = 0 AND size = 10 AND r = 0""")
def renamed_tasks(spark, sf_dir):
    """Tens of customers: a chain in which each takes the name that the one before has just left; a ring, in which
    nobody can begin; names asked for one by one before they are free; and two that ask for new ones."""
    k, own = F.col("c_custkey"), table(spark, sf_dir, "customer")
    g, r = F.expr("c_custkey div 10"), k % 10
    whole = own.groupBy(g.alias("g")).agg(F.count("*").alias("size")).filter("size = 10")
    text = lambda c: c.cast("string")
    tasks_ = own.select(k.alias("task_id"), F.concat(F.lit("task"), text(k)).alias("name"), F.lit("proposed").alias("status"), F.lit("machine").alias("origin"), F.lit("open").alias("review_state"))
    rows = own.select(k.alias("task_id"), g.alias("g"), r.alias("r")).join(whole.hint("merge"), "g")
    t, g, r = F.col("task_id"), F.col("g"), F.col("r")
    chain = rows.filter("g % 4 = 0").select("task_id", (g * 100 + r).alias("seq"), F.when(r == 0, F.concat(F.lit("moved"), text(g))).otherwise(F.concat(F.lit("task"), text(t - 1))).alias("name"))
    ring = rows.filter("g % 4 = 1").select("task_id", (g * 100 + r).alias("seq"), F.concat(F.lit("task"), text(F.when(r == 0, t + 9).otherwise(t - 1))).alias("name"))
    early = rows.filter("g % 4 = 2").select("task_id", (g * 100 + r).alias("seq"), F.when(r == 9, F.concat(F.lit("new"), text(g), F.lit("_9"))).otherwise(F.concat(F.lit("task"), text(t + 1))).alias("name"))
    free = rows.filter("g % 4 = 3 and r in (0, 9)").select("task_id", (g * 100 + r).alias("seq"), F.concat(F.lit("new"), text(g), F.lit("_"), text(r)).alias("name"))
    return E.renamed(tasks_, chain.unionByName(ring).unionByName(early).unionByName(free))


@query("""WITH e AS (SELECT o_custkey AS task_id, arg_max(o_orderkey % 3 = 0, o_orderkey) AS hide FROM orders GROUP BY o_custkey) SELECT c_custkey AS task_id, coalesce(hide, false) AS not_a_task FROM customer LEFT JOIN e ON task_id = c_custkey""")
def hidden_tasks(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.lit(False).alias("not_a_task"))
    return E.hidden(own, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("task_id"), (F.col("o_orderkey") % 3 == 0).alias("hide")))


@query(f"""WITH {FILES}, m AS (SELECT DISTINCT task_id, doc_id FROM links WHERE doc_id % 7 = 0), n AS (SELECT task_id, doc_id FROM links WHERE doc_id % 7 <> 0 UNION ALL SELECT DISTINCT task_id + 1000, doc_id FROM m),
t AS (SELECT task_id, name FROM tasks UNION ALL SELECT DISTINCT task_id + 1000, 'split' || task_id FROM m) SELECT t.task_id, name, count(doc_id) AS n FROM t LEFT JOIN n ON t.task_id = n.task_id GROUP BY ALL""")
def split_tasks(spark, sf_dir):
    asked = links(spark, sf_dir).filter("doc_id % 7 = 0").select("task_id", "doc_id", (F.col("task_id") + 1000).alias("new_id"), F.concat(F.lit("split"), F.col("task_id").cast("string")).alias("name"))
    after, moved = E.split(tasks(spark, sf_dir), links(spark, sf_dir), asked)
    return after.select("task_id", "name").join(moved.select("task_id", "doc_id"), "task_id", "left").groupBy("task_id", "name").agg(F.count("doc_id").alias("n"))


@query(f"""WITH {FILES}, e AS (SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN 'detach' WHEN doc_id % 3 = 1 THEN 'primary' ELSE 'assign' END AS op, CASE WHEN doc_id % 3 = 0 THEN task_id ELSE (task_id + 3) % 20 END AS task_id, doc_id FROM f WHERE doc_id % 2 = 0),
ch2 AS (SELECT task_id, max(doc_id) AS chosen FROM e WHERE op = 'primary' GROUP BY task_id), o AS (SELECT coalesce(l.task_id, e.task_id) AS task_id, coalesce(l.doc_id, e.doc_id) AS doc_id, is_primary, op FROM links l FULL JOIN e ON l.task_id = e.task_id AND l.doc_id = e.doc_id)
SELECT o.task_id, doc_id, CASE WHEN chosen IS NOT NULL THEN doc_id = chosen ELSE coalesce(is_primary, false) END AS is_primary, CASE WHEN op IS NOT NULL THEN 'user' ELSE 'machine' END AS origin FROM o LEFT JOIN ch2 ON o.task_id = ch2.task_id WHERE op IS NULL OR op <> 'detach'""")
def reassigned_links(spark, sf_dir):
    i = F.col("doc_id")
    op = F.when(i % 3 == 0, "detach").when(i % 3 == 1, "primary").otherwise("assign")
    asked = files(spark, sf_dir).filter("doc_id % 2 = 0").select(i.alias("seq"), op.alias("op"), F.when(i % 3 == 0, F.col("task_id")).otherwise((F.col("task_id") + 3) % 20).alias("task_id"), "doc_id")
    return E.reassigned(links(spark, sf_dir), asked)


@query(f"""WITH {FILES} SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN CASE WHEN doc_id % 16 <> 0 THEN DATE '2000-02-02' END ELSE date END AS date, CASE WHEN doc_id % 8 = 0 THEN 'user' ELSE 'machine' END AS decided_by FROM f""")
def dated_by_user(spark, sf_dir):
    i = F.col("doc_id")
    asked = files(spark, sf_dir).filter("doc_id % 8 = 0").select(i.alias("seq"), "doc_id", F.when(i % 16 != 0, F.to_date(F.lit("2000-02-02"))).alias("date"))
    return E.dated(files(spark, sf_dir).select("doc_id", "date"), asked)


@query(f"""WITH {ASKED}, r AS (SELECT question, arg_max(id % 5, id) AS rating FROM qs WHERE id % 2 = 0 GROUP BY question), m AS (SELECT question, max(id) AS id FROM qs GROUP BY question)
SELECT qs.id, qs.question, r.rating FROM qs LEFT JOIN m ON qs.id = m.id LEFT JOIN r ON m.question = r.question""")
def rated_questions(spark, sf_dir):
    own = questions(spark, sf_dir)
    return E.rated(own, own.filter("id % 2 = 0").select(F.col("id").alias("seq"), "question", (F.col("id") % 5).alias("rating")))


@query("""SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 4 = 1 THEN 'moved/' || s_suppkey ELSE 'root/' || s_suppkey END AS path FROM supplier WHERE s_suppkey % 4 <> 0
UNION ALL SELECT s_suppkey + 1000000, 'root/' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0""")
def sources_after_edits(spark, sf_dir):
    """Every fourth source is removed, the next moves, a new one takes the place of each removed one, and one more asks for a taken path."""
    k = F.col("s_suppkey")
    root = lambda at: F.concat(F.lit(at), k.cast("string"))
    own = table(spark, sf_dir, "supplier").select(k.alias("source_id"), root("root/").alias("path"))
    keys = table(spark, sf_dir, "supplier")
    asked = keys.filter("s_suppkey % 4 = 0").select(k.alias("seq"), F.lit("remove").alias("op"), k.alias("source_id"), F.lit(None).cast("string").alias("path"))
    asked = asked.unionByName(keys.filter("s_suppkey % 4 = 1").select(k.alias("seq"), F.lit("change").alias("op"), k.alias("source_id"), root("moved/").alias("path")))
    asked = asked.unionByName(keys.filter("s_suppkey % 4 = 0").select(k.alias("seq"), F.lit("add").alias("op"), (k + 1000000).alias("source_id"), root("root/").alias("path")))
    asked = asked.unionByName(keys.filter("s_suppkey % 4 = 2").select(k.alias("seq"), F.lit("add").alias("op"), (k + 2000000).alias("source_id"), root("root/").alias("path")))
    return E.sources_after(own, asked)


# Answers ------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, 1 AS n, sha256(text) AS first FROM a""")
def parsed_answers(spark, sf_dir):
    """Turns as JSON answers, every third cut off behind its sentence."""
    own = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    made = F.to_json(F.struct(F.lit(True).alias("answered"), F.array(F.struct(F.col("text").alias("text"), F.array(F.lit(1)).alias("sources"))).alias("sentences")))
    raw = F.when(F.col("turn") % 3 == 0, F.substring(made, F.lit(1), F.length(made) - 2)).otherwise(made)
    got = G.parse_answer(raw)
    return own.select("conv_id", "turn", F.size(got["sentences"]).alias("n"), F.sha2(F.get(got["sentences"], F.lit(0))["text"], 256).alias("first"))


@query(r"""WITH a AS (SELECT conv_id, turn, regexp_replace('see [7] ' || text || ' [1, 2]', '\s*\[\d+(?:\s*,\s*\d+)*\]', '', 'g') AS text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM a)
SELECT conv_id AS query_id, sha256(string_agg(rtrim(text) || ' [' || k || ']', ' ' ORDER BY turn)) AS answer FROM n GROUP BY conv_id""")
def composed_answers(spark, sf_dir):
    """Each turn cites a source of its own, so sources are numbered as turns are; marks that it has already go."""
    own = table(spark, sf_dir, "conversations").filter("role = 'assistant' and text is not null").withColumn("text", F.concat(F.lit("see [7] "), "text", F.lit(" [1, 2]")))
    said = own.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), "text", F.array((F.col("turn") * 3 + 5).cast("long")).alias("sources"))
    return G.compose(said).withColumn("answer", F.sha2("answer", 256))


@query("""WITH a AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE text IS NOT NULL) AS kept FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id, NOT (conv_id % 3 > 0 AND n > 0 AND kept > 0) AS withheld FROM a""")
def withheld_answers(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("n"), F.count("text").alias("kept"))
    return own.select("conv_id", G.withheld(F.col("conv_id") % 3, F.col("n") > 0, F.col("kept")).alias("withheld"))


@query(f"""SELECT doc_id, CASE WHEN length(x) BETWEEN 2 AND 20 THEN x END AS name, CASE WHEN length(b) <= 200 THEN b ELSE rtrim(substr(b, 1, 199)) || '…' END AS summary
FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lang || ' ' || doc_id % 40 || ' 2019년 결산.docx', '(?:19|20)[0-9][0-9]\\s*(?:년도|년)?', ' ', 'g'), '\\s+', ' ', 'g')) AS y, {BODY.format('coalesce(text, chr(32))')} AS b FROM documents) z, LATERAL (SELECT trim(regexp_replace(regexp_replace(y, '\\.[A-Za-z0-9]{{1,5}}$', ''), '\\s+', ' ', 'g')) AS x)""")
def cleaned_output(spark, sf_dir):
    name = F.concat("lang", F.lit(" "), (F.col("doc_id") % 40).cast("string"), F.lit(" 2019년 결산.docx"))
    return table(spark, sf_dir, "documents").select("doc_id", G.clean_name(name).alias("name"), G.clean_summary(F.coalesce("text", F.lit(""))).alias("summary"))
