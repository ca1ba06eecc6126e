"""Operators on hand-made rows, and against brute force where SQL cannot say it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import catalogue as C
from docloom.operators import compare as P
from docloom.operators import dating as D
from docloom.operators import edits as E
from docloom.operators import search as S
from docloom.operators import timeline as T
from docloom.operators import vectors as V
from docloom.operators import verify as G
from docloom.sources import ingest as I

#: Task, years, months: the recurrences that the detection must find.
PLAN = {1: (range(2022, 2026), (9, 10, 11)), 2: (range(2022, 2026), (3, 12)), 3: (range(2024, 2026), range(1, 13)), 4: (range(2023, 2026), (1, 4, 7, 10)), 5: (range(2024, 2025), (5,))}


def planned(spark):
    rows, doc = [], 0
    for task, (years, months) in PLAN.items():
        for y in years:
            for m in months:
                doc += 1
                rows.append((task, doc, y, m, 12, "body", True))
    rows.append((1, 999, 2022, 1, 1, "fs", True))
    return spark.createDataFrame(rows, "task long, doc long, year int, month int, day int, kind string, day_known boolean")


def test_planned_cycles(spark):
    found = {r["task"]: (r["kind"], r["months"], r["confidence"]) for r in T.cycles(planned(spark)).collect()}
    assert found == {1: ("yearly", [9, 10, 11], "high"), 2: ("yearly", [3, 12], "high"), 3: ("monthly", [], "medium"), 4: ("quarterly", [1, 4, 7, 10], "high")}


def test_file_dates_are_not_in_the_grid(spark):
    assert T.grid(planned(spark)).filter("task = 1 and month = 1").count() == 0


def test_gap_skips_steps_without_a_day(spark):
    own = spark.createDataFrame([(1, 2024, 1, 3, 1, "a"), (1, 2024, 2, None, 2, "b"), (1, 2024, 3, 4, 3, "c")], "task long, year int, month int, day int, doc long, label string")
    rows = T.steps(own).orderBy("ordinal").collect()
    assert [r["gap_weeks"] for r in rows] == [None, None, 9]


@pytest.mark.parametrize(
    ("text", "value", "precision"),
    [
        ("2024-02-30 자료", "2024-01-01", "year"),
        ("작성일: 2024. 9. 12. 그리고 2023. 1. 1. 2023년 2023년", "2024-09-12", "day"),
        ("2024년 3월 계획, 2023년", "2024-03-01", "month"),
        ("제 2019호", None, None),
        ("2023년과 2024년과 2024년", "2024-01-01", "year"),
        ("20240229", "2024-02-29", "day"),
        ("20230229", None, None),
        ("", None, None),
    ],
)
def test_dates_in_text(spark, text, value, precision):
    c = spark.createDataFrame([(text,)], "t string").select(D.best_of_text(F.col("t"), 2026).alias("c")).first()["c"]
    assert (None if c is None else (str(c["value"]), c["precision"])) == (None if value is None else (value, precision))


def test_leader_clusters_equal_greedy(spark):
    rng = np.random.default_rng(5)
    for trial in range(2):
        x = rng.normal(size=(60, 4))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
        near = (x @ x.T) >= 0.75
        order = sorted(range(60), key=lambda i: (-near[i].sum(), i))
        seed, expected = {}, {}
        for i in order:
            if i not in seed:
                for j in np.flatnonzero(near[i]):
                    seed.setdefault(int(j), i)
        size = {s: list(seed.values()).count(s) for s in seed.values()}
        expected = {i: (s if size[s] >= 3 else None) for i, s in seed.items()}
        found = {r["id"]: r["seed"] for r in V.leaders(df, V.edges(df, 0.75, blocks=3)).collect()}
        assert found == expected, trial


@pytest.mark.parametrize("ahead, few", [(4, 0), (7, 3), (2048, 32)])
def test_clusters_without_links_equal_leaders_over_them(spark, monkeypatch, ahead, few):
    """Some links, all or none go through the batches; links that are written stay under their bound."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 4))
    x[40:60] = x[40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 4)], "id long, vector array<double>")
    expected = {r["id"]: r["seed"] for r in V.leaders(df, V.edges(df, 0.75)).collect()}
    own, made = V.edges, []
    monkeypatch.setattr(V, "edges", lambda *a, **b: made.append(own(*a, **b)) or made[-1])
    assert {r["id"]: r["seed"] for r in V.clusters(df, 0.75, ahead=ahead, few=few).collect()} == expected
    assert sum(m.count() for m in made) <= few * 92


def test_alignment_is_a_longest_common_subsequence():
    random.seed(3)
    for _ in range(200):
        a = [random.choice("abc") for _ in range(random.randint(0, 7))]
        b = [random.choice("abc") for _ in range(random.randint(0, 7))]
        pairs = P._align(a, b)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a)))
        assert [j for _, j in pairs if j is not None] == list(range(len(b)))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert sum(i is not None and j is not None for i, j in pairs) == best[-1][-1]


def test_moved_and_repeated_steps(spark):
    own = spark.createDataFrame([(1, 2023, i + 1, x, 1) for i, x in enumerate(["a", "b", "c"])] + [(1, 2024, i + 1, x, 4) for i, x in enumerate(["b", "c", "a", "c"])], "task long, year int, ordinal int, label string, month int")
    found = [(r["change"], r["label"]) for r in P.compare_years(own, 2023, 2024).orderBy("pos").collect()]
    assert found == [("MOVED", "a"), ("SAME", "b"), ("SAME", "c"), ("MOVED", "a"), ("REPEAT", "c")]


def test_answer_rules(spark):
    rows = [("", [1], "empty"), ("예산은 1,200만원", [], "no source"), ("예산은 1,200만원", [7], "unknown source"), ("예산은 1,300만원", [1], "number"), ("전혀 다른 이야기", [1], "overlap"), ("예산은 1,200만원", [1], None), ("예산은 변경되지 않았다", [1], None)]
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(rows)], "i int, t string, s array<long>")
    support = F.lit("올해 예산은 1200만원으로 확정")
    found = [r["v"] for r in df.select("i", G.verdict(F.col("t"), F.col("s"), F.array(F.lit(1).cast("long")), support).alias("v")).orderBy("i").collect()]
    assert found == [v for *_, v in rows]


def test_cut_off_json_is_recovered(spark):
    raw = '{"answered": true, "sentences": [{"text": "하나", "sources": [1]}, {"text": "둘", "sources": [2, 3]}, {"text": "세'
    got = spark.createDataFrame([(raw,), ('{"answered": false, "sentences": []}',), ("junk",)], "r string").select(G.parse_answer(F.col("r")).alias("a")).collect()
    assert [s["text"] for s in got[0]["a"]["sentences"]] == ["하나", "둘"]
    assert got[1]["a"]["answered"] is False
    assert got[2]["a"] is None


def test_merges_follow_to_the_end(spark):
    own = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8)], "task_id long, merged_into long")
    assert {r["task_id"]: r["into"] for r in P.merge_targets(own).collect()} == {2: 1, 3: 1, 4: 1, 9: 8}


def test_files_are_listed_and_decoded(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    for name, data in (("a/x.txt", "가나".encode()), ("a/y.txt", "가나".encode("cp949")), ("a/~$z.txt", b"t"), (".git/c.txt", b"t"), ("a/q.exe", b"t"), ("a/old.md", b"t")):
        (tmp_path / name).write_bytes(data)
    found = {r["filename"]: r["state"] for r in I.inventory(spark, f"file://{tmp_path}/a", ("old*",)).collect()}
    assert found == {"x.txt": "pending", "y.txt": "pending", "q.exe": "skipped"}
    raw = spark.read.format("binaryFile").load(f"file://{tmp_path}/a/*.txt").filter("path not like '%~%'")
    assert {r["text"] for r in I.decode(raw).collect()} == {"가나"}


def test_nothing_is_missing_after_a_broken_scan(spark):
    before = spark.createDataFrame([("a", 1, 1, False), ("b", 1, 1, False)], "path string, size long, mtime long, missing boolean")
    now = spark.createDataFrame([("a", 1, 1, False)], "path string, size long, mtime long, scan_complete boolean")
    assert {r["path"]: r["change"] for r in I.snapshot_diff(before, now).collect()} == {"a": "unchanged", "b": "unknown"}


def test_numbers_are_decimals(spark):
    rows = [("08월", "8월"), ("1,200.50", "1200.5"), ("0", "00"), ("0.5%", "00.50%")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert all(r["x"] == [] and r["y"] == [] for r in df.select(G.unsupported_numbers(F.col("a"), F.col("b")).alias("x"), G.unsupported_numbers(F.col("b"), F.col("a")).alias("y")).collect())
    assert spark.createDataFrame([("10과 5%", "1과 5")], "a string, b string").select(G.unsupported_numbers(F.col("a"), F.col("b")).alias("x")).first()["x"] == ["10", "5%"]


def test_a_decimal_point_ends_no_sentence(spark):
    df = spark.createDataFrame([("예산 비율 1.5 수준 유지한다", "예산 비율 1.5 수준 유지하지 않는다", True), ("예산 비율 1.5 수준 유지한다", "예산 비율 1.5 수준 유지한다. 다른 말은 없다", False)], "t string, s string, x boolean")
    assert all(r["x"] == r["p"] for r in df.withColumn("p", G.polarity_conflict(F.col("t"), F.col("s"))).collect())


def test_years_of_questions(spark):
    said = {"전년도 실적": [2025], "지난 해와 이번 해": [2025, 2026], "다음 해 계획": [2027], "2019년도와 작년": [2019, 2025], "12019년": [], "없음": []}
    df = spark.createDataFrame([(q,) for q in said], "q string")
    assert {r["q"]: r["y"] for r in df.select("q", S.infer_years(F.col("q"), 2026).alias("y")).collect()} == said


def test_headline_without_anything_to_compare(spark):
    pairs = spark.createDataFrame([(1, "SAME"), (2, "GONE"), (2, "ADDED")], "task long, change string")
    tasks = spark.createDataFrame([(1,), (2,), (3,)], "task long")
    assert {r["task"]: r["headline"] for r in P.comparison_headline(pairs, tasks).collect()} == {1: "same", 2: "2 changes", 3: "nothing to compare"}


def test_edits_replay_as_lists_do(spark):
    random.seed(6)
    steps, edits, expected = [], [], {}
    for task in range(12):
        rows = [f"s{i}" for i in range(random.randint(1, 6))]
        steps += [(task, 2024, i + 1, x) for i, x in enumerate(rows)]
        for seq in range(random.randint(0, 6)):
            op, at = random.choice(["relabel", "delete", "add", "move"]), random.randint(0, len(rows) + 1)
            label = str(random.randint(1, 7)) if op == "move" else f"n{seq}"
            edits.append((task, 2024, seq, op, at, label))
            if op == "add":
                rows = rows[:at] + [label] + rows[at:]
            elif 1 <= at <= len(rows):
                if op == "relabel":
                    rows = [label if i == at - 1 else x for i, x in enumerate(rows)]
                elif op == "delete":
                    rows = rows[: at - 1] + rows[at:]
                else:
                    moved, rest = rows[at - 1], rows[: at - 1] + rows[at:]
                    rows = rest[: int(label) - 1] + [moved] + rest[int(label) - 1 :]
        expected[task] = rows
    found = {}
    out = P.replay_order(spark.createDataFrame(steps, "task long, year int, ordinal int, label string"), spark.createDataFrame(edits, "task long, year int, seq int, op string, at int, label string"))
    for r in sorted(out.collect(), key=lambda r: (r["task"], r["ordinal"])):
        found.setdefault(r["task"], []).append(r["label"])
    assert found == {t: rows for t, rows in expected.items() if rows}


def test_siblings_are_rows_of_groups(spark):
    docs = spark.createDataFrame([(i, "h" if i < 50 else None, False) for i in range(60)], "doc_id long, hash string, missing boolean")
    steps = spark.createDataFrame([(1, "a", 2024, 3), (1, "a", 2024, 55), (2, "a", 2024, 4)], "task_id long, label string, year int, doc_id long")
    found = C.version_siblings(docs, steps).collect()
    assert len(found) == 52
    assert {(r["kind"], r["size"], r["representative"]) for r in found} == {("hash", 50, 0), ("step", 2, 3)}


def test_names_stay_unique(spark):
    tasks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "task_id long, name string")
    asked = spark.createDataFrame([(1, "b"), (2, "x"), (3, "y"), (4, "y")], "task_id long, name string")
    found = {r["task_id"]: r["name"] for r in E.renamed(tasks, asked).collect()}
    assert len(set(found.values())) == 4 and found[2] == "x" and found[3] == "c" and found[4] == "d"


def test_lines_after_the_thousandth_are_searched(spark, tmp_path):
    from docloom.plans import search

    text = "\n".join(f"line number {i}" for i in range(1500)) + "\nneedle here"
    spark.createDataFrame([(7, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = search.chunks(spark, str(tmp_path))
    found = S.text_rank(own, spark.createDataFrame([(1, "needle")], "query_id long, part string"), 5).collect()
    assert [(r["chunk_id"] // search.LINES, r["chunk_id"] % search.LINES) for r in found] == [(7, 1500)]
