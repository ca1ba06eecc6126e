"""Retrieval, verification and chunk queries.

Chunks are lines of ``documents`` (packed ones where stated); queries are words of ``benchmark``
items; answers are assistant turns of ``conversations`` with the user turn before as support.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lineage import cut
from ..operators import chunking as K
from ..operators import search as S
from ..operators import vectors as V
from ..operators import verify as G
from .base import query, table
from .vectors import NORMED, vectors

#: Letters of the given languages beside the default ones.
WIDE = r"[가-힣A-Za-z0-9À-ÿ][가-힣A-Za-z0-9À-ÿ,.]*"


def sections(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    kind = F.when(F.col("ordinal") % 7 == 3, "table").when(F.col("ordinal") % 7 > 4, "page").otherwise("paragraph")
    return cut.select("doc_id", kind.alias("kind"), "ordinal", F.concat((F.col("ordinal") + 1).cast("string"), F.lit("문단")).alias("locator"), "text")


SECTIONS = """l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), s0 AS (SELECT doc_id, unnest(range(len(ls))) AS ordinal, unnest(ls) AS raw FROM l),
s AS (SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN ordinal % 7 = 3 THEN 'table' WHEN ordinal % 7 > 4 THEN 'page' ELSE 'paragraph' END AS kind, (ordinal + 1) || '문단' AS locator, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS body FROM s0),
b AS (SELECT *, length(body) AS n, kind <> 'table' AND length(body) < 800 AS mix, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS i FROM s WHERE body <> '')"""


@query(f"""WITH RECURSIVE {SECTIONS}, w AS (
  SELECT doc_id, i, 1 AS grp, CASE WHEN mix THEN n ELSE 0 END AS held, kind FROM b WHERE i = 1
  UNION ALL SELECT b.doc_id, b.i, CASE WHEN b.mix AND w.held > 0 AND w.held < 400 AND w.kind = b.kind THEN w.grp ELSE w.grp + 1 END,
    CASE WHEN b.mix THEN CASE WHEN w.held > 0 AND w.held < 400 AND w.kind = b.kind THEN w.held ELSE 0 END + b.n ELSE 0 END, b.kind FROM w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i + 1),
m AS (SELECT b.doc_id, grp, arg_min(locator, b.i) AS lf, arg_max(locator, b.i) AS lt, string_agg(body, chr(10) ORDER BY b.i) AS text FROM b JOIN w ON b.doc_id = w.doc_id AND b.i = w.i GROUP BY b.doc_id, grp),
p AS (SELECT doc_id, grp, CASE WHEN lf = lt THEN lf ELSE replace(lf, '문단', '') || '~' || lt END AS locator, text, unnest(range((length(text) - 1) // 1200 + 1)) AS pc FROM m),
q AS (SELECT doc_id, grp, pc, locator, substr(text, CAST(pc * 1200 + 1 AS BIGINT), 1200) AS text FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, pc) AS ordinal, locator, sha256(text) AS text FROM q WHERE trim(text) <> ''""")
def packed_chunks(spark, sf_dir):
    return K.pack(sections(spark, sf_dir)).withColumn("text", F.sha2("text", 256))


#: More than any text has lines.
LINES = 2**31


def chunks(spark, sf_dir):
    """Lines that aren't empty, named by doc_id * LINES + line number."""
    own = sections(spark, sf_dir).filter("length(text) > 0")
    return own.select((F.col("doc_id") * LINES + F.col("ordinal")).alias("chunk_id"), "doc_id", "ordinal", "locator", "text")


CHUNKS = f"""l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), s0 AS (SELECT doc_id, unnest(range(len(ls))) AS ordinal, unnest(ls) AS text FROM l),
c AS (SELECT doc_id * {LINES} + ordinal AS chunk_id, doc_id, ordinal, (ordinal + 1) || '문단' AS locator, text FROM s0 WHERE length(text) > 0)"""


def parts(spark, sf_dir):
    """The words of six letters or more of each benchmark item."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 6))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(words).alias("part"))


PARTS = """w AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 6)) AS part FROM benchmark)"""
RANKED = f"""{CHUNKS}, {PARTS}, tm AS (SELECT DISTINCT part AS term FROM w), f AS (SELECT term, chunk_id, length(text) AS size, len(list_filter(range(1, length(text) + 1), lambda i: substr(lower(text), i, length(term)) = term)) AS tf FROM tm JOIN c ON contains(lower(text), term)),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term), n AS (SELECT count(*) AS chunks, avg(length(text)) AS mean FROM c),
sc AS (SELECT f.term, chunk_id, greatest(1e-6, ln((chunks - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS s FROM f JOIN d ON f.term = d.term, n),
sm AS (SELECT query_id, chunk_id, sum(s) AS score FROM (SELECT DISTINCT query_id, part FROM w) q JOIN sc ON sc.term = q.part GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sm)"""


@query(f"WITH {RANKED} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM rk WHERE rank <= 40")
def text_search(spark, sf_dir):
    return S.text_rank(chunks(spark, sf_dir), parts(spark, sf_dir), 40).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {CHUNKS}, {PARTS}, q AS (SELECT query_id, list(DISTINCT part) AS ps FROM w GROUP BY query_id)
SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, documents.doc_id FROM q JOIN (SELECT doc_id, lower(text) AS low FROM documents) documents ON contains(low, ps[1]) AND len(list_filter(ps, lambda p: NOT contains(low, p))) = 0)""")
def documents_with_all_parts(spark, sf_dir):
    return S.with_all_parts(table(spark, sf_dir, "documents"), "doc_id", "text", parts(spark, sf_dir))


FUSED = f"""{RANKED}, t AS (SELECT query_id, chunk_id, rank FROM rk WHERE rank <= 40), {NORMED},
v0 AS (SELECT q.id AS query_id, x.id * {LINES} AS chunk_id, list_dot_product(q.v, x.v) AS cosine FROM x q JOIN benchmark ON q.id = item_id, x),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, chunk_id) AS rank FROM v0),
vv AS (SELECT * FROM v WHERE rank <= 40), fu AS (SELECT coalesce(vv.query_id, t.query_id) AS query_id, coalesce(vv.chunk_id, t.chunk_id) AS chunk_id, vv.rank AS v, t.rank AS t, coalesce(1.0 / (60 + vv.rank), 0) + coalesce(1.0 / (60 + t.rank), 0) AS score FROM vv FULL JOIN t ON vv.query_id = t.query_id AND vv.chunk_id = t.chunk_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, v NULLS LAST, t NULLS LAST, chunk_id) AS rank FROM fu)"""


def _two_lists(spark, sf_dir):
    """A vector and a text ranking. The vector of row i of ``embeddings`` is that of document i's first
    line, and of benchmark item i as a question. Both are stored, since the steps after read them more than once."""
    own = vectors(spark, sf_dir).select("id", "vector")
    asked = own.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")).hint("merge"), "id").select(F.col("id").alias("query_id"), "vector")
    near = V.search(own.withColumn("id", F.col("id") * LINES), asked, 40).withColumnRenamed("id", "chunk_id")
    ranked = S.text_rank(chunks(spark, sf_dir), parts(spark, sf_dir), 40).select("query_id", "chunk_id", "rank")
    return cut(near.select("query_id", "chunk_id", "rank", "cosine")), cut(ranked)


@query(f"WITH {FUSED} SELECT query_id, chunk_id, rank, round(score, 9) AS score FROM fr")
def rank_fusion(spark, sf_dir):
    return S.fuse(*_two_lists(spark, sf_dir)).select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


@query(f"WITH {FUSED} SELECT query_id, chunk_id FROM vv WHERE cosine >= 0.40 UNION SELECT query_id, chunk_id FROM t WHERE rank <= 8")
def strong_evidence(spark, sf_dir):
    return S.strong(*_two_lists(spark, sf_dir))


@query(f"""WITH {FUSED}, o AS (SELECT query_id, chunk_id // {LINES} AS doc_id, min(rank) AS r FROM fr WHERE rank <= 5 GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM o""")
def related_documents(spark, sf_dir):
    own = S.fuse(*_two_lists(spark, sf_dir)).withColumn("doc_id", F.expr(f"chunk_id div {LINES}"))
    return S.related_documents(own)


CONTEXT = f"""{FUSED}, sg AS (SELECT query_id, chunk_id FROM vv WHERE cosine >= 0.40 UNION SELECT query_id, chunk_id FROM t WHERE rank <= 8),
e AS (SELECT fr.query_id, fr.chunk_id, c.doc_id, fr.rank AS r0, score, c.text, 1995 + c.doc_id % 7 AS year, CASE WHEN c.doc_id % 4 = 0 THEN '최종.txt' ELSE 'a.txt' END AS filename FROM fr JOIN sg ON fr.query_id = sg.query_id AND fr.chunk_id = sg.chunk_id JOIN c ON c.chunk_id = fr.chunk_id),
e1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r0) AS rank FROM e), e2 AS (SELECT *, max(doc_id % 5 <> 0) OVER (PARTITION BY query_id) AS anyr FROM e1 WHERE rank <= 16),
e3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY rank) AS k FROM e2 WHERE doc_id % 5 <> 0 OR NOT anyr),
e4 AS (SELECT *, max(year = 1998) OVER (PARTITION BY query_id) AS anyy FROM e3 WHERE k = 1), e5 AS (SELECT * FROM e4 WHERE year = 1998 OR NOT anyy),
ws AS (SELECT query_id, list(DISTINCT substr(part, 1, greatest(2, length(part) - 2))) AS stems FROM w GROUP BY query_id),
e6 AS (SELECT e5.*, score + max(score) OVER (PARTITION BY e5.query_id) * (CASE WHEN filename LIKE '%최종%' THEN 0.15 ELSE 0 END + CASE WHEN year = max(year) OVER (PARTITION BY e5.query_id) THEN 0.20 ELSE 0 END + CASE WHEN len(list_filter(stems, lambda x: contains(text, x))) > 0 THEN 0.30 ELSE 0 END) AS s2 FROM e5 JOIN ws ON e5.query_id = ws.query_id),
e7 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s2, 12) DESC, rank) AS rr FROM e6), e8 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rr) AS pd FROM e7),
e9 AS (SELECT query_id, chunk_id, doc_id, text, filename, row_number() OVER (PARTITION BY query_id ORDER BY rr) AS rank FROM e8 WHERE pd <= 2)"""


def _context(spark, sf_dir):
    v, t = _two_lists(spark, sf_dir)
    own = S.fuse(v, t).join(S.strong(v, t).withColumn("strong", F.lit(True)), ["query_id", "chunk_id"], "left").join(chunks(spark, sf_dir).hint("merge"), "chunk_id")
    terms = parts(spark, sf_dir).groupBy("query_id").agg(F.collect_set("part").alias("terms"))
    d = F.col("doc_id")
    own = own.join(terms.hint("merge"), "query_id").withColumns({"strong": F.coalesce("strong", F.lit(False)), "representative": d % 5 != 0, "in_task": F.lit(True), "year": 1995 + d % 7, "filename": F.when(d % 4 == 0, "최종.txt").otherwise("a.txt")})
    return S.select_context(own.withColumn("in_year", F.col("year") == 1998))


@query(f"WITH {CONTEXT} SELECT query_id, chunk_id, rank FROM e9 WHERE rank <= 8")
def context_selection(spark, sf_dir):
    return _context(spark, sf_dir).select("query_id", "chunk_id", "rank")


@query(f"""WITH {CONTEXT}, k AS (SELECT e9.*, locator FROM e9 JOIN c ON e9.chunk_id = c.chunk_id WHERE rank <= 8)
SELECT query_id, string_agg('[' || rank || '] (' || filename || ' · ' || locator || ') ' || substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 400), chr(10) ORDER BY rank) AS block FROM k GROUP BY query_id""")
def context_blocks(spark, sf_dir):
    return S.context_block(_context(spark, sf_dir).select("query_id", F.col("rank").alias("pos"), "filename", "locator", "text"))


@query(f"""WITH {CHUNKS}, {PARTS} SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT DISTINCT part AS term FROM w) t LEFT JOIN c ON contains(text, substr(term, 1, greatest(2, length(term) - 2))) GROUP BY term""")
def document_frequency(spark, sf_dir):
    return S.document_frequency(chunks(spark, sf_dir), parts(spark, sf_dir).select(F.col("part").alias("term")).distinct())


TOKENS = r"""list_filter(list_transform(regexp_extract_all({0}, '[가-힣A-Za-z0-9À-ÿ][가-힣A-Za-z0-9À-ÿ,.]*'), lambda w: rtrim(w, ',.·:;!?"'')]}}')), lambda w: length(w) >= 2)"""


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, sha256(array_to_string({TOKENS.format('text')}, ' ')) AS tokens FROM documents")
def word_tokens(spark, sf_dir):
    own = X.tokens(F.col("text"), WIDE)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(own).alias("n_tokens"), F.sha2(F.array_join(own, " "), 256).alias("tokens"))


def _answers(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.select("conv_id", "turn", "role", "text", prev.alias("support")).filter("role = 'assistant' and support is not null")


ANSWERS = """a AS (SELECT * FROM (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS support FROM conversations) WHERE role = 'assistant' AND support IS NOT NULL)"""


@query(f"""WITH {ANSWERS}, k AS (SELECT conv_id, turn, support, {TOKENS.format('text')} AS ws FROM a)
SELECT conv_id, turn, round(CASE WHEN len(ws) = 0 THEN 1.0 ELSE len(list_filter(ws, lambda x: contains(support, substr(x, 1, greatest(2, length(x) - 2))))) / len(ws) END, 6) AS overlap FROM k""")
def answer_overlap(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", F.round(X.overlap_ratio(F.col("text"), F.col("support"), WIDE), 6).alias("overlap"))


NUMBERS = """list_distinct(list_transform(regexp_extract_all({0}, '[0-9]+(?:,[0-9][0-9][0-9])*(?:\\.[0-9]+)?%?'), lambda n: regexp_replace(regexp_replace(CASE WHEN contains(n, '.') THEN regexp_replace(regexp_replace(n, '[,%]', '', 'g'), '\\.?0+$', '') ELSE regexp_replace(n, '[,%]', '', 'g') END, '^0+([0-9])', '\\1'), '$', CASE WHEN suffix(n, '%') THEN '%' ELSE '' END)))"""


@query(f"""SELECT doc_id, len({NUMBERS.format('text')}) AS n_numbers FROM documents""")
def number_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(G.numbers(F.col("text"))).alias("n_numbers"))


@query(f"""WITH {ANSWERS}, k AS (SELECT conv_id, turn, text, support, {TOKENS.format('text')} AS ws FROM a), o AS (SELECT *, CASE WHEN len(ws) = 0 THEN 1.0 ELSE len(list_filter(ws, lambda x: contains(support, substr(x, 1, greatest(2, length(x) - 2))))) / len(ws) END AS ov FROM k)
SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN turn % 5 = 0 THEN 'no source' WHEN turn % 7 = 0 THEN 'unknown source'
  WHEN len(list_filter({NUMBERS.format('text')}, lambda n: NOT list_contains({NUMBERS.format('support')}, n))) > 0 THEN 'number' WHEN ov < 0.25 THEN 'overlap' END AS verdict FROM o""")
def answer_verdicts(spark, sf_dir):
    own = _answers(spark, sf_dir)
    t = F.col("turn")
    sources = F.when(t % 5 == 0, F.expr("cast(array() as array<bigint>)")).when(t % 7 == 0, F.array(F.lit(99).cast("long"))).otherwise(F.array(F.lit(1).cast("long")))
    return own.select("conv_id", "turn", G.verdict(F.col("text"), sources, F.array(F.lit(1).cast("long")), F.col("support"), WIDE).alias("verdict"))
