"""Queries of the stored index: documents under four fields, asked by whole benchmark items and by sources.

The fields of a document are a file name and a path made of its source, language and number, an author by
number, and its text. A benchmark item asks for all its words; a source asks for its name and the word author.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.text_index import TextIndex
from ..sources.shared import scratch
from .base import query, table

FIELDS = ["filename", "path", "author", "body"]


def fielded(docs):
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return docs.select("doc_id", name.alias("filename"), F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), name).alias("path"), F.concat(F.lit("Author "), (F.col("doc_id") % 37).cast("string")).alias("author"), F.col("text").alias("body"))


def asked(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("term"))
    sources = table(spark, sf_dir, "documents").select(F.concat(F.lit("source "), "source").alias("query_id"), F.concat("source", F.lit(" AUTHOR")).alias("term")).distinct()
    return items.unionByName(sources)


ASKED = r"""qs AS (SELECT 'item ' || item_id AS query_id, text AS term FROM benchmark UNION ALL SELECT DISTINCT 'source ' || source, source || ' AUTHOR' FROM documents),
q AS (SELECT query_id, CASE WHEN len(ps) > 0 THEN ps ELSE list_filter([lower(trim(term))], lambda p: length(p) >= 3) END AS ps FROM (SELECT *, list_filter(regexp_split_to_array(lower(trim(term)), '\s+'), lambda p: length(p) >= 3) AS ps FROM qs))"""

#: Over a view ``fd`` (doc_id, filename, path, author, body).
FOUND = f"""{ASKED}, lo AS (SELECT doc_id, [lower(filename), lower(path), lower(author), lower(body)] AS fs FROM fd), sz AS (SELECT doc_id, fs, list_sum(list_transform(fs, lambda f: greatest(length(f) - 2, 0))) AS size FROM lo),
h AS (SELECT query_id, doc_id, fs, size, ps FROM q JOIN sz ON len(ps) > 0 AND len(list_filter(fs, lambda f: contains(f, ps[1]))) > 0 AND len(list_filter(ps, lambda p: len(list_filter(fs, lambda f: contains(f, p))) = 0)) = 0),
pt AS (SELECT query_id, doc_id, fs, size, unnest(ps) AS part FROM h), dp AS (SELECT part, count(*) AS df FROM (SELECT DISTINCT part FROM pt) x JOIN sz ON len(list_filter(fs, lambda f: contains(f, part))) > 0 GROUP BY part),
st AS (SELECT count(*) AS n, avg(size) AS mean FROM sz),
tf AS (SELECT query_id, doc_id, size, part, list_sum(list_transform(fs, lambda f: len(list_filter(range(1, length(f) + 1), lambda i: substr(f, i, length(part)) = part)))) AS tf FROM pt),
sc AS (SELECT query_id, doc_id, sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN dp ON tf.part = dp.part, st GROUP BY query_id, doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM rk WHERE rank <= 500"""
FIELDED = """SELECT doc_id, source || '_' || doc_id || '.' || lang AS filename, '/' || lang || '/' || source || '/' || source || '_' || doc_id || '.' || lang AS path, 'Author ' || (doc_id % 37) AS author, {0} AS body FROM documents"""


def _found(index, spark, sf_dir):
    return index.search(asked(spark, sf_dir)).select("query_id", F.col("key").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(f"WITH fd AS ({FIELDED.format('text')}), {FOUND}")
def document_search(spark, sf_dir):
    index = TextIndex.create(fielded(table(spark, sf_dir, "documents")), scratch(spark, "index"), "doc_id", FIELDS)
    return _found(index, spark, sf_dir)


CHANGED = "CASE WHEN doc_id % 10 = 3 THEN source || ' Author' || chr(10) || text ELSE text END"


@query(f"WITH fd AS ({FIELDED.format(CHANGED)} WHERE doc_id % 17 <> 5), {FOUND}")
def document_search_after_changes(spark, sf_dir):
    """The index of all documents after a tenth of them changed and some went; half of the changes are merged."""
    docs = table(spark, sf_dir, "documents")
    index = TextIndex.create(fielded(docs), scratch(spark, "index"), "doc_id", FIELDS)
    index.upsert(fielded(docs.filter("doc_id % 10 = 3").withColumn("text", F.concat("source", F.lit(" Author\n"), "text"))))
    index.merge()
    index.vacuum()
    index.remove(docs.filter("doc_id % 17 = 5").select("doc_id"))
    return _found(index, spark, sf_dir)
