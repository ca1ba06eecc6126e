"""Text search meets its terms where the texts lie."""

from pyspark.sql import functions as F

from docloom.functions.lineage import cut
from docloom.operators import search as S

TEXTS = [(1, "Alpha beta gamma"), (2, "alphabet soup beta"), (3, "gamma only"), (4, None), (5, "x"), (6, "ALPHA, beta, Gamma and more")]


def test_texts_reach_no_shuffle_and_blocks_change_nothing(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    terms = spark.createDataFrame([("alpha",), ("beta",), ("gamma",), ("zeta",)], "term string")
    wanted = cut(S.rarest(docs, "text", terms))
    run = lambda most: S.scanned(docs, ["doc_id"], "text", wanted, F.lit(1), F.contains("low", "term"), ["term", "doc_id"], most)
    plan = run(100)._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    pairs = sorted((r["term"], r["doc_id"]) for r in run(100).collect())
    assert pairs == [("alpha", 1), ("alpha", 2), ("alpha", 6), ("beta", 1), ("beta", 2), ("beta", 6), ("gamma", 1), ("gamma", 3), ("gamma", 6)]
    assert sorted((r["term"], r["doc_id"]) for r in run(1).collect()) == pairs


def test_all_parts_of_a_query_in_one_text(spark):
    docs = spark.createDataFrame([*TEXTS, (1, "beta")], "doc_id long, text string")
    asked = [(1, "alpha"), (1, "Gamma"), (1, "beta"), (2, "beta"), (2, "zeta"), (3, "soup"), (4, "ga")]
    parts = spark.createDataFrame(asked, "query_id long, part string")
    for most in (S.CHARACTERS, 1):
        found = S.with_all_parts(docs, "doc_id", "text", parts, most)
        assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 6), (3, 2)]


def test_document_frequency_counts_documents_once_and_keeps_case(spark):
    chunks = spark.createDataFrame([(1, 1, "abcd xy"), (2, 1, "abcd"), (3, 2, "ABCD"), (4, 3, "zxyz"), (5, None, "abcd"), (6, 4, None)], "chunk_id long, doc_id long, text string")
    terms = spark.createDataFrame([("abcdef",), ("ABCDEF",), ("xyz",), ("none00",), ("a",)], "term string")
    assert {r["term"]: r["df"] for r in S.document_frequency(chunks, terms).collect()} == {"abcdef": 1, "ABCDEF": 1, "xyz": 2, "none00": 0, "a": 0}


def test_overlapping_places_and_terms_without_any_are_counted_alike(spark):
    """Places of a term that ends as it begins overlap; what is kept between the scans is numbers, not terms."""
    chunks = spark.createDataFrame([(1, "anana banana"), (2, "needle needle"), (3, "nothing")], "chunk_id long, text string")
    one = lambda part: {r["chunk_id"]: r["score"] for r in S.text_rank(chunks, spark.createDataFrame([(1, part)], "query_id long, part string"), 5).collect()}
    score = lambda tf, size: 1e-6 * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (32 / 3)))
    idf = 0.5108256237659907  # ln(2.5 / 1.5)
    assert abs(one("ana")[1] - score(4, 12) * idf / 1e-6) < 1e-9
    assert abs(one("needle")[2] - score(2, 13) * idf / 1e-6) < 1e-9


def test_numbers_are_kept_in_little_room(spark):
    import os

    found = S.kept(spark.range(200000).select("id", F.lit(3).alias("tf")))
    path = found.inputFiles()[0].removeprefix("file://")
    assert found.count() == 200000 and sum(os.path.getsize(os.path.join(os.path.dirname(path), f)) for f in os.listdir(os.path.dirname(path))) < 200000 * 16


def test_terms_of_six_characters_meet_few_texts(spark):
    """Texts with a term's trigrams but not its first six characters in a row are no candidates; any place in a text counts."""
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "abcd bcde cdef defg"), (3, "xx ABCDEFG"), (4, "ähnlich \U0001f600bcdéfg")], "doc_id long, text string")
    terms = spark.createDataFrame([("abcdefg",), ("\U0001f600bcdéf",)], "term string")
    met = S.scanned(docs, ["doc_id"], "text", S.rarest(docs, "text", terms), F.lit(1), F.lit(True), ["term", "doc_id"])
    assert sorted((r["term"], r["doc_id"]) for r in met.collect()) == [("abcdefg", 1), ("abcdefg", 3), ("\U0001f600bcdéf", 4)]
