"""Hybrid retrieval in batch: text match and rank, vector rank, fusion, filters, context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grams import gram_counts, grams, led, mapped, marks
from ..functions.lineage import cut
from ..functions.text import SHORTEST, collapse, stem
from ..sources.shared import scratch

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
FUSION_K = 60
#: Most characters of terms that tasks get at once, and what a row counts beside its characters.
CHARACTERS, ROW = 16_000_000, 64
STRONG_COSINE, STRONG_TEXT_RANK, EXPLORED, PER_DOC, CONTEXT = 0.40, 8, 16, 2, 8


def rarest(texts: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(term, gram, rows) of each lower-cased term: the trigram that the fewest texts hold and how many do, with the hash of its
    first six characters instead for a term of so many; no row if one is held by none. Stored. One scan counts the terms' trigrams (a map of a fixed size lets them through)."""
    need = cut(grams(terms.withColumn("_t", F.col("term")), "_t", "term").withColumnRenamed("_t", "term"))
    held = gram_counts(texts, text, texts.sparkSession.sparkContext.broadcast(mapped(need)))
    known = need.join(held.hint("merge"), "gram", "left").groupBy("term").agg(F.min(F.struct("rows", "gram")).alias("rare"), F.count_if(F.col("rows").isNull()).alias("unheld"))
    # many words share a trigram, few share six characters
    return cut(led(known.filter("unheld = 0").select("term", F.col("rare.gram").alias("gram"), F.col("rare.rows").alias("rows"))))


def scanned(texts: DataFrame, carry: list[str], text: str, wanted: DataFrame, weight: Column, keep: Column, out: list[Column | str], most: int = CHARACTERS) -> DataFrame:
    """``out`` of the pairs of a text and a row of ``wanted`` (gram and more) whose trigram it holds, where ``keep`` is true.

    Both may name the columns ``carry`` of ``texts``, those of ``wanted`` and ``low``, the lower-cased text. Texts are
    scanned where they lie and meet ``wanted`` there, so they reach no shuffle. ``wanted`` is stored; what weighs more
    than ``most`` in all comes in as many blocks, a scan each, and a block's result is stored before the next.
    """
    context, found = texts.sparkSession.sparkContext, []
    held, heavy = wanted.agg(F.count("*"), F.sum(weight)).first()
    number = max(1, min(held, -(-int(heavy or 0) // most)))
    for n in range(number):
        own = wanted.filter(F.pmod(F.xxhash64(*wanted.columns), F.lit(number)) == n) if number > 1 else wanted
        marked = marks(texts, carry, text, context.broadcast(mapped(own)))
        met = marked.select(*carry, "low", F.explode("grams").alias("gram")).join(F.broadcast(own), "gram").filter(keep).select(*out)
        found.append(cut(met) if number > 1 else met)
    return reduce(DataFrame.unionByName, found)


def holding(texts: DataFrame, carry: list[str], text: str, terms: DataFrame, out: list[Column | str], keep: Column | None = None) -> DataFrame:
    """``out`` of the pairs of a text and a lower-cased term (term) that it holds, or where ``keep`` is true of pairs that may."""
    keep = F.contains("low", "term") if keep is None else keep
    return scanned(texts, carry, text, rarest(texts, text, terms), F.length("term") + ROW, keep, out)


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder as columns, which for rows of a few numbers take a small part of a checkpoint's room."""
    path = scratch(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_rank(chunks: DataFrame, parts: DataFrame, most: int) -> DataFrame:
    """query_id, chunk_id, score, rank: BM25 of chunks (chunk_id, text) that hold any part (query_id,
    part) as a case-insensitive substring; rank by score, then id.

    Rarest trigrams find the candidates, so queries do not meet chunks that share nothing with
    them; term frequency counts overlapping places, length is in characters.
    """
    asked = parts.select("query_id", F.lower("part").alias("term")).filter(F.length("term") >= 3).distinct()
    terms = asked.select("term").distinct()
    size = F.length("text")
    loops = F.exists(F.sequence(F.lit(1), F.length("term") - 1), lambda i: F.left("term", i) == F.right("term", i))
    wanted = cut(rarest(chunks, "text", terms).select("gram", "term", loops.alias("loops"), F.monotonically_increasing_id().alias("n")))
    # places overlap only of a term that ends as it begins; others are told from what is left without them
    left = F.octet_length(F.replace("low", "term", F.lit("")))
    often = F.when(F.col("loops"), F.regexp_count("low", F.concat(F.lit(r"(?=\Q"), "term", F.lit(r"\E)")))).otherwise(((F.octet_length("low") - left) / F.octet_length("term")).cast("int"))
    tf = kept(scanned(chunks.withColumn("size", size), ["chunk_id", "size"], "text", wanted, F.length("term") + ROW, F.contains("low", "term"), ["n", "chunk_id", "size", often.alias("tf")]))
    total = F.broadcast(chunks.agg(F.count("*").alias("chunks"), F.avg(size.cast("double")).alias("mean")))  # one row
    idf = F.greatest(F.lit(IDF_FLOOR), F.ln((F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    df = cut(asked.join(wanted.select("term", "n").hint("merge"), "term").join(tf.groupBy("n").agg(F.count("*").alias("df")).hint("merge"), "n").select("query_id", "n", "df"))
    # the parts of a chunk lie in one task, which adds them up before the shuffle
    few = df.count() * ROW <= CHARACTERS
    by = tf.join(F.broadcast(df) if few else df.hint("merge"), "n").crossJoin(total).groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    return by.withColumn("rank", rank).filter(F.col("rank") <= most)


def with_all_parts(docs: DataFrame, key: str, text: str, parts: DataFrame, most: int = CHARACTERS) -> DataFrame:
    """query_id and ``key`` of the texts that hold all parts (query_id, part) of a query, without regard to case; parts
    under three characters find nothing. A query's texts are among those of its rarest part, and one part that nothing holds
    ends it."""
    asked = cut(parts.select("query_id", F.lower("part").alias("term")).distinct())
    rare = rarest(docs, text, asked.select("term").distinct())
    own = asked.join(rare.hint("merge"), "term", "left").groupBy("query_id").agg(F.min_by("gram", F.struct("rows", "term")).alias("gram"), F.count_if(F.col("gram").isNull()).alias("none"), F.transform(F.array_sort(F.collect_list(F.struct("rows", "term"))), lambda x: x["term"]).alias("parts"))
    wanted = cut(own.filter("none = 0").select("query_id", "gram", "parts"))
    size = F.aggregate("parts", F.lit(ROW).cast("long"), lambda a, x: a + F.length(x) + ROW)
    return scanned(docs, [key], text, wanted, size, F.forall("parts", lambda p: F.contains("low", p)), ["query_id", key], most).distinct()


def fuse(vector_ranked: DataFrame, text_ranked: DataFrame, k: int = FUSION_K) -> DataFrame:
    """query_id, chunk_id, score, rank: sum of 1 / (k + rank) of both lists; ties keep vector order first."""
    v = vector_ranked.select("query_id", "chunk_id", F.col("rank").alias("v"), F.lit(None).cast("int").alias("t"))
    t = text_ranked.select("query_id", "chunk_id", F.lit(None).cast("int").alias("v"), F.col("rank").alias("t"))
    own = v.unionByName(t).groupBy("query_id", "chunk_id").agg(F.min("v").alias("v"), F.min("t").alias("t"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    own = own.withColumn("score", part("v") + part("t"))
    order = [F.desc(F.round("score", 12)), F.asc_nulls_last("v"), F.asc_nulls_last("t"), F.col("chunk_id")]
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def strong(vector_ranked: DataFrame, text_ranked: DataFrame) -> DataFrame:
    """query_id, chunk_id with strong evidence: a close vector, or a high text rank."""
    v = vector_ranked.filter(F.col("cosine") >= STRONG_COSINE).select("query_id", "chunk_id")
    return v.union(text_ranked.filter(F.col("rank") <= STRONG_TEXT_RANK).select("query_id", "chunk_id")).distinct()


def chunks_in_tasks(hits: DataFrame, asked: DataFrame, links: DataFrame) -> DataFrame:
    """``hits`` (query_id, chunk_id, doc_id and more) with ``in_task``: whether a link puts the document into the task that the
    query asks for (query_id, task_id), null for queries that ask for none. Links are met by query and document, so a task
    of very many documents is as many keys."""
    wanted = hits.select("query_id", "doc_id").distinct().join(asked.filter("task_id is not null").hint("merge"), "query_id")
    held = wanted.join(links.select("task_id", "doc_id").distinct().hint("merge"), ["task_id", "doc_id"], "left_semi").select("query_id", "doc_id").distinct().withColumn("_in", F.lit(True))
    some = asked.filter("task_id is not null").select("query_id").distinct().withColumn("_asks", F.lit(True))
    own = hits.join(held.hint("merge"), ["query_id", "doc_id"], "left").join(some.hint("merge"), "query_id", "left")
    return own.select(*hits.columns, F.when(F.col("_asks"), F.coalesce("_in", F.lit(False))).alias("in_task"))


def soft_filter(ranked: DataFrame, keep: Column) -> DataFrame:
    """Apply a filter to each query only where something survives it."""
    w = Window.partitionBy("query_id")
    flag = F.coalesce(keep, F.lit(False))
    return ranked.withColumn("_any", F.max(flag).over(w)).filter(flag | ~F.col("_any")).drop("_any")


def collapse_equal(ranked: DataFrame) -> DataFrame:
    """Of texts that are equal but for white space, the highest ranked of each query."""
    w = Window.partitionBy("query_id", F.sha2(collapse(F.col("text")), 256)).orderBy("rank")
    return ranked.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


#: Marks of final copies in file names.
FINAL = "최종|송부|결재|결제|제출|final"


def rerank(ranked: DataFrame) -> DataFrame:
    """rank anew by score + max score * (.15 final mark + .20 latest year + .30 a query term in the text);
    ties keep the earlier rank. ranked: query_id, chunk_id, rank, score, filename, year, text, terms."""
    w = Window.partitionBy("query_id")
    bonus = (
        F.when(F.col("filename").rlike("(?i)" + FINAL), 0.15).otherwise(0.0)
        + F.when(F.col("year") == F.max("year").over(w), 0.20).otherwise(0.0)
        + F.when(F.exists("terms", lambda t: F.contains("text", stem(t))), 0.30).otherwise(0.0)
    )
    own = ranked.withColumn("score", F.col("score") + F.max("score").over(w) * bonus)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "rank")))


def select_context(ranked: DataFrame) -> DataFrame:
    """The chain from fused ranks to context: strong ones only, the first 16, representatives (soft),
    equal texts collapsed, task (soft), year (soft), reranked, two a document, eight in all.

    ranked: query_id, chunk_id, doc_id, rank, score, strong, representative, in_task, in_year,
    filename, year, text, terms. Flags that do not apply are null.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    own = ranked.filter("strong").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= EXPLORED)
    own = collapse_equal(soft_filter(own, F.col("representative")))
    own = rerank(soft_filter(soft_filter(own, F.col("in_task")), F.col("in_year")))
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))).filter(F.col("_n") <= PER_DOC).drop("_n")
    return own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= CONTEXT)


def document_frequency(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: documents with a chunk that contains the term's stem; terms of two letters or less are
    matched directly, the others through trigrams."""
    own = terms.select("term", stem(F.col("term")).alias("stem")).distinct()
    long = own.filter(F.length("stem") >= 3).select(F.lower("stem").alias("term"), "stem").distinct()
    rare = rarest(chunks, "text", long.select("term").distinct())
    wanted = cut(rare.select("term", "gram").join(long.hint("merge"), "term").select("gram", "stem", F.monotonically_increasing_id().alias("n")))
    # pairs of numbers, distinct within tasks first
    met = scanned(chunks, ["doc_id", "text"], "text", wanted, F.length("stem") + ROW, F.contains("text", "stem"), ["n", "doc_id"]).filter("doc_id is not null").distinct()
    found = met.groupBy("n").agg(F.count("*").alias("df")).join(wanted.select("n", "stem").hint("merge"), "n").select("stem", "df")
    short = cut(own.filter(F.length("stem") == SHORTEST).select("stem").distinct())
    number = short.count()
    if number:
        letters = chunks.select("doc_id", F.split("text", "").alias("_c"))
        two = F.array_compact(F.transform("_c", lambda c, i: F.concat(c, F.get("_c", i + 1))))
        pairs = letters.select("doc_id", F.explode(F.array_distinct(two)).alias("stem"))
        few = number * ROW <= CHARACTERS
        met = pairs.join(F.broadcast(short) if few else short.hint("shuffle_hash"), "stem").filter("doc_id is not null").distinct()
        found = found.unionByName(met.groupBy("stem").agg(F.count("*").alias("df")))
    return own.join(found.hint("merge"), "stem", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def distinctive_terms(terms: DataFrame, frequency: DataFrame, documents: int, share: float = 0.5) -> DataFrame:
    """(query_id, term) with a stem in at most half of the documents; all of a query's where none is."""
    own = terms.join(frequency.hint("merge"), "term").withColumn("rank", F.lit(0))
    return soft_filter(own, F.col("df") <= documents * share).select("query_id", "term")


def expand_neighbours(context: DataFrame, chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, chunk_id, pos: each anchor, then its neighbours (ordinal - 1, + 1) that contain a
    distinctive term; the first occurrence of a chunk wins."""
    offs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate((0, -1, 1))))
    near = context.select("query_id", "doc_id", "ordinal", "rank", F.explode(offs).alias("o")).select("query_id", "doc_id", (F.col("ordinal") + F.col("o.d")).alias("ordinal"), (F.col("rank") * 3 + F.col("o.i")).alias("pos"), (F.col("o.i") == 0).alias("anchor"))
    words = terms.groupBy("query_id").agg(F.collect_set(stem(F.col("term"))).alias("stems"))
    hit = near.join(chunks.select("doc_id", "ordinal", "chunk_id", "text").hint("merge"), ["doc_id", "ordinal"]).join(words.hint("merge"), "query_id", "left")
    hit = hit.filter(F.col("anchor") | F.coalesce(F.exists("stems", lambda s: F.contains("text", s)), F.lit(False)))
    first = hit.groupBy("query_id", "chunk_id").agg(F.min("pos").alias("pos"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))


def context_block(rows: DataFrame, most: int = 400) -> DataFrame:
    """query_id, block: '[i] (file · locator) text' lines in order. rows: query_id, pos, filename, locator, text."""
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] ("), "filename", F.lit(" · "), "locator", F.lit(") "), F.substring(collapse(F.col("text")), 1, most))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("block"))


def related_documents(fused: DataFrame, most: int = 5) -> DataFrame:
    """query_id, doc_id, rank of the documents of the first five fused chunks, in order."""
    own = fused.filter(F.col("rank") <= most).groupBy("query_id", "doc_id").agg(F.min("rank").alias("r"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).drop("r")


def infer_years(question: Column, this_year: int) -> Column:
    """Years that a question names: 4-digit ones before 년 words, and last, this and next year (fixed values)."""
    own = F.transform(F.regexp_extract_all(question, F.lit(r"(?<!\d)((?:19|20)\d{2})\s*(?:회계연도|년도|년|학년도)(?!\d)"), 1), lambda y: y.cast("int"))
    said = [(r"작년|지난\s*해|전년도?", -1), (r"올해|금년|이번\s*해", 0), (r"내년|다음\s*해", 1)]
    rel = F.array_compact(F.array(*(F.when(question.rlike(p), F.lit(this_year + d)) for p, d in said)))
    return F.array_sort(F.array_distinct(F.concat(own, rel)))


def merged_scope(explicit: Column, inferred: Column) -> Column:
    return F.when(F.coalesce(F.size(explicit), F.lit(0)) > 0, explicit).otherwise(inferred)


def follow_up(question: Column) -> Column:
    """The same question about the year before the earliest one named, else with a prefix."""
    years = F.transform(F.regexp_extract_all(question, F.lit(r"((?:19|20)\d{2})\s*년"), 1), lambda y: y.cast("int"))
    moved = F.regexp_replace(question, F.lit(r"(?:19|20)\d{2}(?=\s*년)"), (F.array_min(years) - 1).cast("string"))
    return F.when(F.size(years) > 0, moved).otherwise(F.concat(F.lit("작년에는 "), question))
