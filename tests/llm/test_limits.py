"""Cases at the limits of line dedup, nearest neighbours and toxicity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ann, line_dedup, toxicity


def words(r, n):
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(n)]


def letters_changed(r, line, n):
    out = list(line)
    for k in r.sample([i for i, c in enumerate(line) if c != " "], n):
        out[k] = r.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != line[k]])
    return "".join(out)


def test_long_and_short_lines_with_changed_letters(spark):
    """100 pairs each: words of a line, letters changed, share of pairs found."""
    r, kinds, texts = random.Random(5), [(80, 10, 1.0), (60, 8, 1.0), (3, 1, 0.98), (5, 1, 0.98), (7, 1, 0.98)], []
    for size, edits, _ in kinds:
        pairs = []
        while len(pairs) < 100:
            a = " ".join(words(r, size))
            if edits * 10 <= len(a):
                pairs.append((a, letters_changed(r, a, edits)))
        texts += [x for p in pairs for x in p]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {x["doc_id"] for x in line_dedup.decisions(docs).collect() if x["n_dropped"]}
    assert all(i % 2 for i in gone)
    for n, (_, _, least) in enumerate(kinds):
        assert sum(i // 200 == n for i in gone) >= least * 100


def test_lines_that_share_phrases_alone_are_not_paired(spark, monkeypatch):
    """150 lines of three phrases that all hold and thirty words of their own: pairs to compare must not be all pairs."""
    r, made = random.Random(8), {}
    phrases, texts = [" ".join(words(r, 2)) + " everywhere" for _ in range(3)], []
    for _ in range(150):
        parts = phrases + words(r, 30)
        r.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [letters_changed(r, t, 3) for t in texts[:50]]
    own = line_dedup.stored

    def stored(df, name="table"):
        out = own(df, name)
        made[name] = max(made.get(name, 0), out.count() if name in ("first", "pairs", "second") else 0)
        return out

    monkeypatch.setattr(line_dedup, "stored", stored)
    gone = {x["doc_id"] for x in line_dedup.decisions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if x["n_dropped"]}
    assert gone == set(range(150, 200))
    print(made)
    assert made.get("second", made.get("pairs")) <= 3 * len(texts)


def test_lines_within_the_bound_by_every_way(spark):
    """The comparison and its bound from below against plain edit distance: common ends, shifts, other scripts, many and few edits."""
    r, rows = random.Random(11), []
    for n in range(400):
        a = " ".join(words(r, r.choice([1, 3, 12, 60, 150])))
        if n % 5 == 0:
            a = "".join(r.choice("가나다라마바사 éüñß") if r.random() < 0.7 else c for c in a)
        b, most = list(a), len(a) // 10
        for _ in range(r.choice([1, most // 2, most, most + 1, 2 * most])):
            k = r.randrange(len(b) + 1) if n % 3 else min(len(b), r.randrange(len(b) // 3 + 1) + len(b) // 3)
            b[k : k + r.choice([0, 1])] = r.choice(["", "x", "q", " ", "é"])
        b = "".join(b) if n % 7 else " ".join(words(r, len(a.split())))
        rows.append((a, b if n % 11 else a[: len(a) - most // 2]))
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"d": F.levenshtein("a", "b"), "most": line_dedup._most(F.length("a"), F.length("b"))})
    df = df.withColumn("apart", line_dedup._apart(line_dedup._counts(F.col("a")), line_dedup._counts(F.col("b")), F.length("a"), F.length("b")))
    found = df.withColumn("close", line_dedup._within(*map(F.col, ("a", "b", "apart", "most")))).collect()
    assert all(x["apart"] <= 2 * x["d"] for x in found)
    assert all(x["close"] == (x["d"] <= x["most"]) for x in found)
    assert 50 < sum(x["close"] for x in found) < 350


def test_later_pairs_are_compared_where_they_meet(spark, monkeypatch):
    """Lines of common phrases: of the later pairs links alone are stored; those to be compared are few, and each one is compared once."""
    r, tables = random.Random(21), []
    phrases = [" ".join(words(r, 2)) + " everywhere" for _ in range(3)]
    texts = []
    for _ in range(60):
        parts = phrases + words(r, 30)
        r.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [letters_changed(r, t, n) for t in texts for n in (3, 9)]
    own = line_dedup.stored

    def stored(df, name="table"):
        out = own(df, name)
        if name == "second":
            tables.append([tuple(x) for x in out.select("a", "b").collect()])
        return out

    monkeypatch.setattr(line_dedup, "stored", stored)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {x["doc_id"] for x in line_dedup.decisions(docs).collect() if x["n_dropped"]}
    assert gone == set(range(60, 180))
    monkeypatch.setattr(line_dedup, "_bare_within", lambda a, b, most: F.lit(True))
    monkeypatch.setattr(line_dedup, "_within", lambda a, b, apart, most: (apart <= 2 * most) & line_dedup._let(F.struct(a, b), lambda p: F.lit(True)))
    line_dedup.decisions(docs).collect()
    links, compared = tables
    base = lambda n: n if n < 60 else (n - 60) // 2
    of = {x["id"]: base(x["doc_id"]) for x in docs.select("doc_id", F.xxhash64(F.lower("text")).alias("id")).collect()}
    assert all(of[a] == of[b] for a, b in links)
    assert len(links) <= len(compared) <= 3 * len(texts)
    assert len(set(compared)) == len(compared)


def test_cuts_show_most_links_of_long_lines(spark):
    """The bound from above is no less than the edits, and within the bound for nearly all lines with letters, words or a block changed."""
    r, rows = random.Random(31), []
    for n in range(200):
        own = words(r, r.choice([40, 150, 600]))
        a = " ".join(own)
        if n % 4 == 0:
            b = letters_changed(r, a, len(a) // 25)
        elif n % 4 == 1:
            for k in r.sample(range(len(own)), len(own) // 25):
                own[k] = " ".join(words(r, r.choice([1, 2])))
            b = " ".join(own)
        elif n % 4 == 2:
            k = r.randrange(len(a) // 2)
            b = letters_changed(r, a[:k] + a[k + len(a) // 25 :], len(a) // 50)
        else:
            b = " ".join(words(r, len(own)))
        rows.append((n % 4, a, b))
    df = spark.createDataFrame(rows, "kind int, a string, b string").withColumns({"d": F.levenshtein("a", "b"), "most": line_dedup._most(F.length("a"), F.length("b"))})
    found = df.withColumn("shown", line_dedup._at_most(*map(F.col, ("a", "b", "most")))).collect()
    assert all(x["shown"] >= min(x["d"], x["most"] + 1) for x in found)
    assert all(x["shown"] > x["most"] for x in found if x["kind"] == 3)
    assert sum(x["shown"] <= x["most"] for x in found) >= 140


@pytest.mark.parametrize("spread", [0.5, 1.0])
def test_recall_where_norms_differ(spark, spread):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float) * np.random.default_rng(1).lognormal(0, spread, (len(rows), 1))
    found = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    near = {}
    for r in found.collect():
        near.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = np.arange(0, len(x), 20)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(near[q] & set(t.tolist())) / 20 for q, t in zip(asked.tolist(), top, strict=True)]) >= 0.95


def test_labels_of_texts_without_words(spark):
    model = toxicity.train(["", "", "1 2", "?"], [0, 1, 1, 0])
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "some words")], "doc_id long, text string")
    assert {r["score"] for r in toxicity.score_documents(docs, model).collect()} == {0.5}


def test_texts_go_only_to_lines_with_a_partner(spark, monkeypatch):
    """Lines that share many words but are of other lengths meet in lists of many components; texts are sent only for those that may be linked to one of another component."""
    r, sent, met = random.Random(5), [], []
    shared, texts = words(r, 30), []
    for k in range(16):
        texts.append(" ".join(shared + words(r, int(40 * 1.12**k) - 30)))
    texts += [letters_changed(r, t, 3) for t in texts]
    own = line_dedup.stored

    def stored(df, name="table"):
        out = own(df, name)
        if name == "texts":
            sent.append(out.count())
        if name == "postings":
            met.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", stored)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, line_dedup.decisions(docs).select("doc_id", "n_dropped").collect()))
    assert [d for d, n in whole if n] == list(range(16, 32))
    assert len(met) == 1 and sent[-1] <= 16
    # the same rows if keys are met, and texts are copied, in slices
    met.clear()
    monkeypatch.setattr(line_dedup, "SLICES", 3)
    monkeypatch.setattr(line_dedup, "SLICE", 4)
    monkeypatch.setattr(line_dedup, "COPIED", 1)
    assert sorted(map(tuple, line_dedup.decisions(docs).select("doc_id", "n_dropped").collect())) == whole
    assert len(met) == 3
