"""Queries of upkeep: the cascade of a changed document over all that is made from it.

Sections are lines of documents, chunks and links those of the catalogue; every ninth document has changed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade
from ..operators import stages as W
from .base import query, table
from .what import FILES, chunk_states, files, links

CHANGED = "doc_id % 9 = 4"


def derived(spark, sf_dir):
    """The tables made from documents and tasks, with who decided what."""
    f, l, i = files(spark, sf_dir), links(spark, sf_dir), F.col("doc_id")
    one = f.select("doc_id")
    task = l.select("task_id").distinct()
    months = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ordinal")
    by = lambda c: F.when(c % 4 == 1, "user").otherwise("machine")
    chunks = chunk_states(spark, sf_dir).withColumn("chunk_id", i * 1000000 + F.col("ordinal"))
    return {
        "sections": table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ordinal", "text")),
        "text_index": one,
        "dates": f.select("doc_id", F.explode(F.array(F.lit("body"), F.when(i % 6 == 1, "user").otherwise("fs"))).alias("kind")),
        "document_vectors": table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")),
        "chunks": chunks,
        "chunk_vectors": chunks.filter("embedded").select("chunk_id"),
        "proposals": one.withColumn("status", F.when(i % 5 == 0, "edited").otherwise("proposed")),
        "attempts": f.filter("parse_status = 'failed'").select("doc_id"),
        "links": l,
        "cycles": task.withColumn("decided_by", by(F.col("task_id"))),
        "steps": task.select("task_id", months).withColumn("decided_by", by(F.col("task_id") + F.col("ordinal"))),
        "reading": l.filter("doc_id % 4 = 0").select("task_id", "doc_id"),
        "health": task,
    }


_TASKS = "hit AS (SELECT DISTINCT task_id FROM links WHERE doc_id % 9 = 4)"
_ROW = "SELECT '{0}' AS table_name, count(*) AS rows, count(*) FILTER (WHERE h) AS reached, count(*) FILTER (WHERE h AND k) AS kept, count(*) FILTER (WHERE h AND NOT k) AS gone FROM ({1})"
_OF = "task_id IN (SELECT task_id FROM hit) AS h"
ROWS = {
    "sections": "SELECT doc_id % 9 = 4 AS h, false AS k FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents)",
    "text_index": "SELECT doc_id % 9 = 4 AS h, false AS k FROM f",
    "dates": "SELECT doc_id % 9 = 4 AS h, kind = 'user' AS k FROM (SELECT doc_id, unnest(['body', CASE WHEN doc_id % 6 = 1 THEN 'user' ELSE 'fs' END]) AS kind FROM f)",
    "document_vectors": "SELECT vec_id IN (SELECT doc_id FROM f WHERE doc_id % 9 = 4) AS h, false AS k FROM embeddings",
    "chunks": "SELECT doc_id % 9 = 4 AS h, false AS k FROM ch",
    "chunk_vectors": "SELECT doc_id % 9 = 4 AS h, false AS k FROM ch WHERE embedded",
    "proposals": "SELECT doc_id % 9 = 4 AS h, doc_id % 5 = 0 AS k FROM f",
    "attempts": "SELECT doc_id % 9 = 4 AS h, false AS k FROM f WHERE parse_status = 'failed'",
    "links": "SELECT doc_id % 9 = 4 AS h, true AS k FROM links",
    "cycles": f"SELECT {_OF}, task_id % 4 = 1 AS k FROM (SELECT DISTINCT task_id FROM links)",
    "steps": f"SELECT {_OF}, (task_id + o) % 4 = 1 AS k FROM (SELECT DISTINCT task_id FROM links), range(1, 4) r(o)",
    "reading": f"SELECT {_OF}, false AS k FROM links WHERE doc_id % 4 = 0",
    "health": f"SELECT {_OF}, false AS k FROM (SELECT DISTINCT task_id FROM links)",
}


@query(f"WITH {FILES}, {_TASKS} " + " UNION ALL ".join(_ROW.format(n, q) for n, q in ROWS.items()))
def invalidation_cascade(spark, sf_dir):
    changed = table(spark, sf_dir, "documents").filter(CHANGED).select("doc_id")
    return cascade.invalidate(derived(spark, sf_dir), changed)[1]


@query(f"WITH {FILES}, {_TASKS} SELECT task_id, o AS ordinal FROM (SELECT DISTINCT task_id FROM links), range(1, 4) r(o) WHERE task_id NOT IN (SELECT task_id FROM hit) OR (task_id + o) % 4 = 1")
def steps_after_cascade(spark, sf_dir):
    changed = table(spark, sf_dir, "documents").filter(CHANGED).select("doc_id")
    return cascade.invalidate(derived(spark, sf_dir), changed)[0]["steps"].select("task_id", F.col("ordinal").cast("long").alias("ordinal"))


STAGES = [W.Stage("hash", "1"), W.Stage("parse", "7"), W.Stage("date", "2"), W.Stage("embed", "small"), W.Stage("chunk", "3")]


def tried(spark, sf_dir):
    """Order lines as events of documents: the order is the document, the part its stage and version, the supplier the
    outcome; orders are the documents, a few of them missing or of a later revision."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    docs = o.select(k.alias("doc_id"), (k % 11 == 0).cast("int").alias("revision"), (k % 23 == 0).alias("missing"))
    p, s = F.col("l_partkey") % 5, F.col("l_suppkey")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (p + 1).cast("int"))
    version = F.when((F.col("l_partkey") + s) % 4 == 0, "old").otherwise(pick([x.version for x in STAGES]))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("revision"), pick([x.name for x in STAGES]).alias("stage"), version.alias("version"), (s % 4 != 0).alias("ok"), F.when(s % 8 == 0, "locked").otherwise("broken").alias("error"))
    begun = docs.select("doc_id", "revision", F.lit("hash").alias("stage"), F.lit("1").alias("version"), (F.col("doc_id") % 7 != 0).alias("ok"), F.lit("broken").alias("error"))
    return docs, lines.unionByName(begun)


TRIED = """st AS (SELECT * FROM (VALUES (0, 'hash', '1'), (1, 'parse', '7'), (2, 'date', '2'), (3, 'embed', 'small'), (4, 'chunk', '3')) v(i, stage, version)),
dc AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS revision, o_orderkey % 23 = 0 AS missing FROM orders),
ev AS (SELECT l_orderkey AS doc_id, 0 AS revision, l_partkey % 5 AS i, CASE WHEN (l_partkey + l_suppkey) % 4 = 0 THEN 'old' ELSE ['1', '7', '2', 'small', '3'][l_partkey % 5 + 1] END AS version, l_suppkey % 4 <> 0 AS ok, l_suppkey % 8 = 0 AS locked FROM lineitem
  UNION ALL SELECT doc_id, revision, 0, '1', doc_id % 7 <> 0, false FROM dc),
fo AS (SELECT dc.doc_id, missing, st.i, stage, coalesce(bool_or(ok), false) AS done, count(*) FILTER (WHERE NOT ok AND NOT locked) AS failures FROM dc CROSS JOIN st LEFT JOIN ev ON ev.doc_id = dc.doc_id AND ev.revision = dc.revision AND ev.i = st.i AND ev.version = st.version GROUP BY ALL),
nx AS (SELECT doc_id, any_value(missing) AS missing, min(i) FILTER (WHERE NOT done) AS i FROM fo GROUP BY doc_id),
ss AS (SELECT nx.doc_id, CASE WHEN NOT nx.missing THEN fo.stage END AS next_stage, CASE WHEN nx.missing THEN 'missing' WHEN nx.i IS NULL THEN 'done' WHEN failures >= 3 THEN 'failed' WHEN failures > 0 THEN 'retry' ELSE 'due' END AS state, CASE WHEN nx.missing THEN 0 ELSE coalesce(failures, 0) END AS failures, coalesce(nx.i, 5) AS pos
  FROM nx LEFT JOIN fo ON nx.doc_id = fo.doc_id AND nx.i = fo.i)"""


@query(f"WITH {TRIED} SELECT doc_id, next_stage, state, failures FROM ss")
def stage_state(spark, sf_dir):
    return W.stage_state(*tried(spark, sf_dir), STAGES)


@query(f"""WITH {TRIED} SELECT stage, count(*) AS total, count(*) FILTER (WHERE pos > i) AS done, count(*) FILTER (WHERE pos = i AND state <> 'failed') AS due, count(*) FILTER (WHERE pos = i AND state = 'failed') AS failed, count(*) FILTER (WHERE pos < i) AS waiting
FROM ss, st WHERE state <> 'missing' GROUP BY stage""")
def stage_counters(spark, sf_dir):
    return W.stage_counters(W.stage_state(*tried(spark, sf_dir), STAGES), STAGES)
