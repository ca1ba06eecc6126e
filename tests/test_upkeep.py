"""The stored index, publication, cascades, ranks in ranges, replayed names, merges and close pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.ranks import ranked
from docloom.operators import cascade
from docloom.operators import compare as P
from docloom.operators import edits as E
from docloom.operators import pages as G
from docloom.operators import vectors as V
from docloom.operators import text_index
from docloom.operators.text_index import TextIndex
from docloom.sources import publish, shared

FIELDS = ["title", "body"]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, body string")


def asked(spark, *terms):
    return spark.createDataFrame(list(enumerate(terms)), "query_id long, term string")


TERMS = ["apple", "pear apple", "APPLE  pears", "zz", "a b c", "missing words", "title1", "apple apple", ".*", "", "한글 문서"]


def corpus(n, seed=3):
    r = random.Random(seed)
    words = ["apple", "pear", "plum", "한글", "문서", "a.*b", "xx", "pears", "가나다라"]
    return [(i * 40000, f"title{i % 4}", " ".join(r.choices(words, k=r.randint(0, 12))) if i % 7 else None) for i in range(n)]


def by_hand(rows, terms):
    """(query_id, doc_id) in order of rank, from the definition."""
    import math

    texts = {k: [(t or "").lower(), (b or "").lower()] for k, t, b in rows}
    size = {k: sum(max(len(f) - 2, 0) for f in fs) for k, fs in texts.items()}
    mean, out = sum(size.values()) / len(size), []
    for q, term in enumerate(terms):
        parts = [p for p in term.lower().split() if len(p) >= 3] or ([term.strip().lower()] if len(term.strip()) >= 3 else [])
        score = {}
        for k, fs in texts.items():
            if parts and all(any(p in f for f in fs) for p in parts):
                total = 0
                for p in parts:
                    df = sum(any(p in f for f in other) for other in texts.values())
                    idf = math.log((len(texts) - df + 0.5) / (df + 0.5))
                    tf = sum(f.startswith(p, i) for f in fs for i in range(len(f)))
                    total += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[k] / mean))
                score[k] = total
        out += [(q, k, n + 1) for n, k in enumerate(sorted(score, key=lambda k: (-round(score[k], 9), k)))]
    return out


def found(index, spark, terms=TERMS):
    return sorted((r["query_id"], r["key"], r["rank"]) for r in index.search(asked(spark, *terms)).collect())


def test_index_after_changes_equals_one_built_anew(spark, tmp_path):
    rows = corpus(60)
    index = TextIndex.create(docs(spark, rows), f"file://{tmp_path}/i", "doc_id", FIELDS, buckets=8)
    assert found(index, spark) == sorted(by_hand(rows, TERMS))
    changed = [(k, "title9 apple", "pear") for k, _, _ in rows[::10]] + [(7, "new", "apple apple plum"), (None, "none", "apple"), (8, None, None)]
    index.upsert(docs(spark, changed))
    index.remove(docs(spark, rows[3:9]).select("doc_id"))
    own = {k: (k, t, b) for k, t, b in rows} | {k: (k, t, b) for k, t, b in changed if k is not None}
    for k, _, _ in rows[3:9]:
        own.pop(k, None)
    expected = sorted(by_hand(list(own.values()), TERMS))
    assert found(index, spark) == expected
    assert index.merge()
    assert found(TextIndex(spark, f"file://{tmp_path}/i"), spark) == expected
    assert index.merge() == []
    index.rebuild("2")
    assert found(index, spark) == expected


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    index = TextIndex.create(docs(spark, corpus(40)), f"file://{tmp_path}/i", "doc_id", FIELDS, buckets=64)
    before = dict(index.state["postings"])
    index.upsert(docs(spark, [(1, "qqq", "")]))
    touched = {b for b in index.state["postings"] if index.state["postings"][b] != before.get(b)}
    assert len(touched) == 1
    index.merge()
    assert {b: n for b, n in index.state["postings"].items() if b not in touched} == {b: n for b, n in before.items() if b not in touched}
    assert found(index, spark, ["qqq"]) == [(0, 1, 1)]


def test_live_documents_are_told_where_they_lie(spark, tmp_path, monkeypatch):
    """Neither reading texts nor merging deals a row for each document or posting; with too many maps to broadcast, joins give the same; vacuum leaves what the state names."""
    rows = corpus(30)
    index = TextIndex.create(docs(spark, rows), f"file://{tmp_path}/i", "doc_id", FIELDS, buckets=8)
    index.upsert(docs(spark, [(k, "title9 apple", "pear") for k, _, _ in rows[::5]] + [(-70000, "below", "apple")]))
    index.remove(docs(spark, rows[3:9]).select("doc_id"))
    assert "SortMergeJoin" not in index.documents()._jdf.queryExecution().executedPlan().toString()
    read = lambda own: sorted(map(tuple, own.documents().collect()))
    entries = lambda own: sorted((r["gram"], r["field"], r["generation"], r["segment"], k) for r in own._live_postings(range(8)).collect() for k in r["keys"])
    whole, expected = (read(index), entries(index)), found(index, spark)
    with monkeypatch.context() as m:
        m.setattr(text_index, "MAPS", 0)
        other = TextIndex(spark, f"file://{tmp_path}/i")
        assert (read(other), entries(other)) == whole and found(other, spark) == expected
    monkeypatch.setattr(text_index, "MERGED", 3)
    merged = index.merge()
    assert merged == sorted(merged) and entries(index) == whole[1]
    index.vacuum()
    base = tmp_path / "i" / "postings" / "version=1"
    assert {(d.parent.name, d.name.removeprefix("bucket=")) for d in base.glob("*/bucket=*")} == {(n, b) for b, sets in index.state["postings"].items() for n in sets}
    assert found(index, spark) == expected


def test_two_writers_of_one_state(spark, tmp_path):
    TextIndex.create(docs(spark, corpus(5)), f"file://{tmp_path}/i", "doc_id", FIELDS)
    one, two = (TextIndex(spark, f"file://{tmp_path}/i") for _ in range(2))
    one.upsert(docs(spark, [(1, "first", "")]))
    with pytest.raises(RuntimeError):
        two.upsert(docs(spark, [(1, "second", "")]))
    assert found(TextIndex(spark, f"file://{tmp_path}/i"), spark, ["first", "second"]) == [(0, 1, 1)]


def test_empty_index(spark, tmp_path):
    index = TextIndex.create(docs(spark, []), f"file://{tmp_path}/i", "doc_id", FIELDS)
    assert found(index, spark) == []
    index.upsert(docs(spark, [(1, None, None)]))
    assert found(index, spark) == [] and index.merge() == []


# Publication ----------------------------------------------------------------------------------


def test_fingerprint_has_no_order_but_counts_repeats(spark):
    rows = [(1, "a", None), (2, None, "b"), (2, None, "b"), (3, "", "c")]
    frame = lambda r: spark.createDataFrame(r, "x long, y string, z string")
    own = publish.fingerprint(frame(rows))
    assert own == publish.fingerprint(frame(rows[::-1]).repartition(3))
    assert own == publish.fingerprint(frame(rows).select("z", "x", "y"))
    for other in (rows[:-1], rows[1:], [*rows, rows[0], rows[0]], [(1, None, "a"), *rows[1:]], [(1, "a", ""), *rows[1:]]):
        assert publish.fingerprint(frame(other)) != own
    assert publish.fingerprint(frame([])) == publish.Fingerprint(0, 0, 0)


def test_a_moved_input_voids_the_batch(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(10).write.parquet(source)
    open_ = {"in": lambda: spark.read.parquet(source)}

    def make(tables, meanwhile=False):
        if meanwhile:
            spark.range(1).write.mode("append").parquet(source)
        return tables["in"].groupBy((F.col("id") % 2).alias("x")).count()

    with pytest.raises(publish.Moved, match="in"):
        publish.publish(spark, open_, lambda t: make(t, True), out)
    assert not shared.exists(spark, out) and shared.names(spark, str(tmp_path)) == ["in"]
    publish.publish(spark, open_, make, out)
    assert spark.read.parquet(out).agg(F.sum("count")).first()[0] == 11
    with pytest.raises(FileExistsError):
        publish.publish(spark, open_, make, out)
    assert shared.names(spark, str(tmp_path)) == ["in", "out"]


# Cascade ----------------------------------------------------------------------------------------


def test_keys_propagate_once_and_user_rows_stay(spark):
    frame = spark.createDataFrame
    graph = (cascade.Derived("chunks", "documents", "doc", key="chunk"), cascade.Derived("vectors", "chunks", "chunk"), cascade.Derived("links", "documents", "doc", key="task", passes=True), cascade.Derived("steps", "links", "task", kept="by = 'user'"))
    tables = {
        "vectors": frame([(10,), (11,), (20,), (None,)], "chunk long"),
        "chunks": frame([(1, 10), (1, 11), (2, 20), (None, 30)], "doc long, chunk long"),
        "links": frame([(1, 7), (2, 8), (1, 9), (1, None)], "doc long, task long"),
        "steps": frame([(7, "user"), (7, "machine"), (8, "machine"), (9, None), (None, "machine")], "task long, by string"),
    }
    left, report = cascade.invalidate(tables, frame([(1,), (1,), (None,), (99,)], "doc long"), graph)
    assert {r[0]: tuple(r)[1:] for r in report.collect()} == {"chunks": (4, 2, 0, 2), "vectors": (4, 2, 0, 2), "links": (4, 3, 3, 0), "steps": (5, 3, 1, 2)}
    assert sorted(map(tuple, left["steps"].collect()), key=repr) == sorted([(7, "user"), (8, "machine"), (None, "machine")], key=repr)
    assert left["links"].count() == 4 and left["vectors"].columns == ["chunk"]


@pytest.mark.parametrize("bad", [(cascade.Derived("a", "b", "x", key="x"), cascade.Derived("b", "a", "x", key="x")), (cascade.Derived("a", "nothing", "x"),), (cascade.Derived("a", "documents", "x"), cascade.Derived("a", "documents", "x")), (cascade.Derived("a", "documents", "x"), cascade.Derived("b", "a", "x"))])
def test_wrong_graphs_are_refused(bad):
    with pytest.raises(ValueError):
        cascade.ordered(bad, "documents")


# Ranks ------------------------------------------------------------------------------------------


def test_ranks_of_a_hot_group_in_several_tasks(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.6 else r.choice("ab") if r.random() < 0.9 else None, r.randint(0, 50), i, r.choice([None, i])) for i in range(3000)]
    own = spark.createDataFrame(rows, "g string, o long, i long, v long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranked(own, ["g"], [F.desc("o"), F.col("i")], carry={"last": F.col("v")}, sums={"before": F.col("o")})
        found = {x["i"]: (x["rank"], x["last"], x["before"]) for x in out.collect()}
        from docloom.functions.ranks import in_ranges

        assert in_ranges(own, ["g"], [F.desc("o"), F.col("i")]).filter("g = 'hot'").select("_range").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("hot", "a", "b", None):
        last, total = None, 0
        for n, (_, o, i, v) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            assert found[i] == (n, last, total)
            last, total = v if v is not None else last, total + o


# Names and merges -------------------------------------------------------------------------------


def one_by_one(held, edits):
    own, edited = dict(held), set()
    for _, i, op, name in sorted(edits, key=lambda e: (e[0], ["remove", "change", "add"].index(e[2]), e[1], e[3] or "")):
        if op == "remove":
            own.pop(i, None)
            edited.discard(i)
        elif (op == "add" or i in own) and not any(n == name and j != i for j, n in own.items()):
            own[i] = name
            edited.add(i)
    return sorted((i, n, i in edited) for i, n in own.items())


@pytest.mark.parametrize("seed", [1])
def test_replayed_names_equal_one_by_one(spark, seed):
    r = random.Random(seed)
    held = [(i, f"n{i}") for i in range(12)]
    edits = [(r.randint(0, 40), r.randint(0, 15), r.choice(["change", "change", "add", "remove"]), f"n{r.randint(0, 14)}") for _ in range(45)]
    edits = [(s, i, op, None if op == "remove" else n) for s, i, op, n in edits]
    found = E.replayed(spark.createDataFrame(held, "id long, name string"), spark.createDataFrame(edits, "seq long, id long, op string, name string"))
    assert sorted(map(tuple, found.collect())) == one_by_one(held, set(edits))


def test_chains_and_rings_of_renames(spark):
    tasks = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "task_id long, name string")
    chain = [(i, f"t{i + 1}" if i < 9 else "end") for i in range(10)]
    blocked = [(i, f"t{i + 1}" if i < 18 else "t29") for i in range(10, 19)]
    ring = [(i, f"t{20 + (i - 19) % 9}") for i in range(20, 29)]
    found = {r["task_id"]: r["name"] for r in E.renamed(tasks, spark.createDataFrame(chain + blocked + ring, "task_id long, name string")).collect()}
    assert len(set(found.values())) == 30
    assert [found[i] for i in range(10)] == [n for _, n in chain]
    assert [found[i] for i in range(10, 19)] == [f"t{i}" for i in range(10, 19)]
    assert [found[i] for i in range(20, 29)] == [n for _, n in ring]


def test_a_refused_source_keeps_its_path(spark):
    own = spark.createDataFrame([(1, "p1"), (2, "p2")], "source_id long, path string")
    edits = spark.createDataFrame([(1, "change", 1, "p2"), (2, "add", 3, "p1")], "seq long, op string, source_id long, path string")
    assert sorted(map(tuple, E.sources_after(own, edits).collect())) == [(1, "p1"), (2, "p2")]


def test_links_of_users_stay_theirs(spark):
    links = spark.createDataFrame([(1, 1, True, "user"), (1, 2, False, None)], "task_id long, doc_id long, is_primary boolean, origin string")
    edits = spark.createDataFrame([(1, "assign", 2, 5)], "seq long, op string, task_id long, doc_id long")
    assert {(r["task_id"], r["doc_id"]): r["origin"] for r in E.reassigned(links, edits).collect()} == {(1, 1): "user", (1, 2): "machine", (2, 5): "user"}


def test_merges_on_and_behind_rings(spark):
    pairs = [(1, 2), (2, 1), (3, 1), (10, 11), (11, 12), (12, 13), (13, 11), (9, 10), *((i, i + 1) for i in range(20, 60)), (60, 20), *((i, i + 1) for i in range(100, 170)), (80, 80)]
    found = dict(map(tuple, P.merge_targets(spark.createDataFrame(pairs, "task_id long, merged_into long")).collect()))
    assert found == {1: 1, 2: 1, 3: 1, **dict.fromkeys((9, 10, 11, 12, 13), 11), **dict.fromkeys(range(20, 61), 20), **dict.fromkeys(range(100, 170), 170), 80: 80}


def test_two_citations_of_one_document(spark):
    sections = spark.createDataFrame([(1, i, f"{i}문단" if i < 4 else "p.4", f"section number {i} text") for i in range(1, 6)], "doc_id long, ordinal int, locator string, text string")
    cited = spark.createDataFrame([(1, 0, 1, "1문단", ""), (1, 1, 1, "3문단", ""), (1, 2, 1, "see 2 문단 앞", ""), (1, 3, 1, "p.4", "x"), (1, 4, 1, None, "section  number"), (1, 5, 1, "", "section"), (1, 6, 1, "9문단", "number 5 text")], "query_id long, pos long, doc_id long, locator string, snippet string")
    found = sorted((r["pos"], r["ordinal"], r["how"]) for r in G.cited_sections(cited, sections).collect())
    assert found == [(0, 1, 1), (1, 3, 1), (2, 2, 2), (3, 4, 1), (3, 5, 1), (4, 1, 3), (6, 5, 3)]


# Close pairs ------------------------------------------------------------------------------------


@pytest.mark.parametrize("threshold", [0.9, 0.3, -0.2])
def test_close_pairs_meet_once_in_some_blocks(spark, threshold):
    r = np.random.default_rng(4)
    middle = np.repeat(r.normal(size=(8, 6)), 30, axis=0)
    rows = [(i, v.tolist()) for i, v in enumerate(middle + 0.1 * r.normal(size=middle.shape))] + [(900, [0.0] * 6), (901, rows_ := (middle[0] * 3).tolist()), (902, rows_)]
    own = spark.createDataFrame(rows, "id long, vector array<double>")
    found = V.edges(own, threshold, pivots=8, size=16).collect()
    m = np.array([v for _, v in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    s, ids = (m / np.where(n == 0, 1, n)) @ (m / np.where(n == 0, 1, n)).T, [i for i, _ in rows]
    expected = sorted((ids[a], ids[b]) for a in range(len(m)) for b in range(len(m)) if a != b and s[a, b] >= threshold)
    assert sorted((x["a"], x["b"]) for x in found) == expected
    if threshold == 0.9:
        blocked = V._blocked(own.select("id", V.normalised(F.col("vector")).alias("v")), 8, 16)
        blocks = blocked.select("block").distinct().count()
        assert V.close_blocks(blocked, threshold).count() < blocks * (blocks + 1) / 4


def test_part_files_in_order_are_the_report(spark, sf_dir, tmp_path):
    from docloom.operators import report as R
    from docloom.plans.report import TODAY, tables

    lines = R.report_lines(tables(spark, sf_dir), "name", TODAY).cache()
    own = [r["line"] for r in R.numbered(lines).orderBy("line_no").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        R.write_text(lines, f"{tmp_path}/report")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "report").glob("part-*"))
    assert len(parts) > 1 and own[0] == "# name 인수인계 보고서"
    assert "".join(p.read_text() for p in parts).splitlines() == own


def test_long_years_align_like_short_ones(spark):
    """Ten thousand steps in one group, and small ones against the definition with all lengths at hand."""
    r = random.Random(6)

    def lengths(a, b):
        own = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                own[i][j] = own[i + 1][j + 1] + 1 if a[i] == b[j] else max(own[i + 1][j], own[i][j + 1])
        return own

    for _ in range(300):
        a, b = (r.choices("abcde", k=r.randint(0, 13)) for _ in range(2))
        own, j = lengths(a, b), 0
        for i, k in P._align(a, b):
            if i is not None and k is None and a[i] in b[j:]:
                assert own[i + 1][j] == own[i][j]
            j = j if k is None else k + 1
        assert sum(i is not None and k is not None for i, k in P._align(a, b)) == own[0][0]
    rows = [(1, y, n, str(r.randint(0, 400)), 1 + n % 12) for y in (1999, 2000) for n in range(10_000)]
    found = P.compare_years(spark.createDataFrame(rows, "task long, year int, ordinal int, label string, month int"), 1999, 2000)
    assert found.filter("earlier_month is not null").count() == 10_000 and found.filter("later_month is not null").count() == 10_000


def test_next_stage_from_events(spark):
    from docloom.operators import stages as W

    stages = [W.Stage("hash", "1"), W.Stage("parse", "2"), W.Stage("embed", "m")]
    docs_ = spark.createDataFrame([(i, 0, i == 7) for i in range(1, 9)], "doc_id long, revision int, missing boolean")
    done = lambda i, *names: [(i, 0, n, v, True, None) for n, v in (("hash", "1"), ("parse", "2"), ("embed", "m")) if n in names]
    bad = lambda i, n, v, e="broken": (i, 0, n, v, False, e)
    events = [*done(1, "hash", "parse", "embed"), *done(2, "hash"), bad(2, "parse", "2"), *done(3, "hash"), *[bad(3, "parse", "2")] * 3, *done(4, "hash", "embed"), bad(4, "parse", "1"), (5, 1, "hash", "1", True, None), bad(6, "hash", "1", "locked"), *done(7, "hash"), (99, 0, "hash", "1", True, None), (8, 0, "other", "1", True, None), bad(1, "embed", "m")]
    state = W.stage_state(docs_, spark.createDataFrame(events, "doc_id long, revision int, stage string, version string, ok boolean, error string"), stages)
    assert {r["doc_id"]: (r["next_stage"], r["state"], r["failures"]) for r in state.collect()} == {1: (None, "done", 0), 2: ("parse", "retry", 1), 3: ("parse", "failed", 3), 4: ("parse", "due", 0), 5: ("hash", "due", 0), 6: ("hash", "due", 0), 7: (None, "missing", 0), 8: ("hash", "due", 0)}
    assert sorted(r[0] for r in W.work(state, "parse").collect()) == [2, 4]
    assert {r["stage"]: (r["total"], r["done"], r["due"], r["failed"], r["waiting"]) for r in W.stage_counters(state, stages).collect()} == {"hash": (7, 4, 3, 0, 0), "parse": (7, 1, 2, 1, 3), "embed": (7, 1, 0, 0, 6)}


def test_years_are_compared_without_a_call_for_each_task(spark):
    r = random.Random(5)
    rows = [(t, y, n, r.choice(["a b", "ab", "c", None]), 1 + n) for t in range(60) for y in (1999, 2000, 2001) if r.random() < 0.8 for n in range(r.randint(1, 5))]
    own = spark.createDataFrame(rows, "task long, year int, ordinal int, label string, month int").repartition(7)
    found = P.compare_years(own, 1999, 2000)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    of = {(t, y): [(label, m) for a, b, _, label, m in rows if (a, b) == (t, y)] for t, y, *_ in rows}
    both = [t for t in range(60) if (t, 1999) in of and (t, 2000) in of]
    seen = {}
    for x in sorted(found.collect(), key=lambda x: (x["task"], x["pos"])):
        seen.setdefault(x["task"], []).append(x)
    assert sorted(seen) == both
    for t in both:
        assert [x["pos"] for x in seen[t]] == list(range(1, len(seen[t]) + 1))
        assert [x["earlier_month"] for x in seen[t] if x["earlier_month"]] == [m for _, m in of[t, 1999]]
        assert [x["later_month"] for x in seen[t] if x["later_month"]] == [m for _, m in of[t, 2000]]
        same = sum(x["change"] == "SAME" for x in seen[t])
        a, b = ([label and label.replace(" ", "") for label, _ in of[t, y]] for y in (1999, 2000))
        assert same == sum(i is not None and k is not None for i, k in P._align(a, b))


def test_edits_are_replayed_without_a_call_for_each_year(spark):
    r = random.Random(6)
    steps = [(t, 2000, n, f"s{n}") for t in range(40) for n in range(1, r.randint(0, 6) + 1)]
    edits = [(t, 2000, s, op, r.randint(-2, 8), str(r.randint(-1, 8)) if op == "move" else f"e{s}") for t in range(0, 40, 2) for s in range(9) for op in [r.choice(["relabel", "add", "delete", "move"])]]
    expected = {}
    for t in range(40):
        rows = [label for a, _, _, label in steps if a == t]
        for _, _, _, op, at, value in sorted(e for e in edits if e[0] == t):
            i = at - 1
            if op == "add":
                rows.insert(min(max(i + 1, 0), len(rows)), value)
            elif 0 <= i < len(rows) and op == "relabel":
                rows[i] = value
            elif 0 <= i < len(rows) and op == "delete":
                rows.pop(i)
            elif 0 <= i < len(rows):
                rows.insert(min(max(int(value) - 1, 0), len(rows) - 1), rows.pop(i))
        expected[t] = rows
    out = P.replay_order(spark.createDataFrame(steps, "task long, year int, ordinal int, label string"), spark.createDataFrame(edits, "task long, year int, seq int, op string, at int, label string"))
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    found = {}
    for x in sorted(out.collect(), key=lambda x: (x["task"], x["ordinal"])):
        found.setdefault(x["task"], []).append(x["label"])
    assert found == {t: rows for t, rows in expected.items() if rows}


def test_parts_are_counted_where_texts_lie(spark):
    from docloom.functions.grams import grams
    from docloom.operators import text_index as T

    r = random.Random(8)
    rows = [tuple("".join(r.choices("abcé \n\xa0\U0001f600", k=r.randint(0, 40))) if r.random() < 0.9 else None for _ in range(2)) for _ in range(700)] + [("x" * 300 + "abcabc", "abcabc")]
    parts = {"".join(r.choices("abcé\xa0\U0001f600", k=r.randint(3, 5))) for _ in range(80)} | {"abcabc", "xxx", "\\E)("}
    own = spark.createDataFrame([(p,) for p in parts], "part string").withColumn("_p", F.col("part"))
    led = grams(own, "_p", "part").groupBy(F.col("_p").alias("part")).agg(F.max("gram").alias("gram"))
    found = T._frequencies(spark.createDataFrame(rows, "low_a string, low_b string").repartition(3), led.localCheckpoint())
    expected = {p: sum(any(p in (f or "") for f in row) for row in rows) for p in parts}
    assert {x["part"]: x["df"] for x in found.collect()} == {p: n for p, n in expected.items() if n}


def test_index_search_of_terms_with_blanks(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x a b y" if i % 3 == 0 else "xaby", f"word{i % 4}") for i in range(40)], "id long, title string, body string")
    index = TextIndex.create(docs, f"file://{tmp_path}/i", "id", ["title", "body"])
    found = index.search(spark.createDataFrame([("p", "a b"), ("q", "WORD1 x")], "query_id string, term string")).collect()
    assert {x["key"] for x in found if x["query_id"] == "p"} == {i for i in range(40) if i % 3 == 0}
    assert {x["key"] for x in found if x["query_id"] == "q"} == {i for i in range(40) if i % 4 == 1}


@pytest.mark.parametrize("threshold", [0.4, -0.2])
def test_close_pairs_and_counts_over_several_groups(spark, monkeypatch, threshold):
    monkeypatch.setattr(V, "GROUP", 40)
    r = np.random.default_rng(3)
    x = r.normal(size=(230, 4)).round(3)
    x[5], x[7] = x[6], 0
    own = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>").repartition(5)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(norm == 0, 1, norm)
    close = (unit @ unit.T >= threshold) & ~np.eye(len(x), dtype=bool)
    edges = V.edges(own, threshold, pivots=6, size=9)
    assert "CoGrouped" not in edges._jdf.queryExecution().executedPlan().toString()
    found = [(e["a"], e["b"]) for e in edges.collect()]
    assert len(found) == len(set(found)) and set(found) == set(zip(*map(np.ndarray.tolist, np.nonzero(close)), strict=True))
    assert {e["id"]: e["n"] for e in V.neighbours(own, threshold).collect()} == {i: n for i, n in enumerate(close.sum(axis=1).tolist()) if n}


def test_search_goes_by_strips(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(150, 5))
    own = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(-np.round(unit @ unit.T, 12), axis=1, kind="stable")[:, :4]
    assert V.STRIP < len(x) <= V.BLOCK
    found = V.search(own, own.withColumnRenamed("id", "query_id"), 4).collect()
    assert {(f["query_id"], f["rank"]): f["id"] for f in found} == {(q, k + 1): int(best[q, k]) for q in range(len(x)) for k in range(4)}


def test_next_steps_do_not_meet_all_steps_of_a_year(spark):
    r = random.Random(9)
    steps = list({(d % 2, 2000 + d % 3, r.randint(1, 3), f"s{d}", d) for d in range(60)})
    links = [(s[0], s[4], True) for s in steps]
    cited = [(q, p, r.randint(0, 70)) for q in range(50) for p in range(r.randint(1, 25))]
    docs = [(s[4], s[1]) for s in steps]
    c = spark.createDataFrame(cited, "query_id long, pos long, doc_id long")
    k = spark.createDataFrame(links, "task_id long, doc_id long, is_primary boolean")
    found = G.next_steps(c, k, spark.createDataFrame(docs, "doc_id long, year int"), spark.createDataFrame(steps, "task_id long, year int, ordinal int, label string, doc_id long"))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    task = {x["query_id"]: x["task_id"] for x in G.majority_task(c, k).collect()}
    expected, year = {}, dict(docs)
    for q, t in task.items():
        own = {d for a, _, d in cited if a == q}
        last = max(year[d] for d in own if d in year)
        rest = sorted((s[2], s[3]) for s in steps if s[0] == t and s[1] == last and s[4] not in own)
        if rest:
            expected[q] = (t, last, rest[0][1])
    assert {x["query_id"]: (x["task_id"], x["year"], x["label"]) for x in found.collect()} == expected
