"""Edits of tasks, links and dates as functions from tables to tables; each edit table has one row a target.

An edit that a user makes outranks what is derived later: links made here carry origin 'user', dates
decided_by 'user'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ranks import ranked


def replayed(held: DataFrame, edits: DataFrame) -> DataFrame:
    """id, name, edited: unique names (id, name) after edits (seq, id, op, name), as if replayed one by one.

    ``change`` of an id that is there, or ``add``, takes the name unless another id holds it then; ``remove`` frees
    it. Edits of one seq go in the order remove, change, add, then by id and name. Whether an edit is refused
    depends on earlier ones alone, so guesses are put right from the front: each round derives who holds a name when
    from the last guess, and ends when nothing changes, after as many rounds as the longest chain of edits that wait
    for each other. Long lists of edits of one id or of one name are split by ranges.
    """
    order = ["seq", "turn", "id", "name"]
    turn = F.when(F.col("op") == "remove", 0).when(F.col("op") == "change", 1).otherwise(2)
    asked = edits.select("seq", F.col("id").cast("long").alias("id"), "op", "name").filter("id is not null and (op = 'remove' or name is not null)").withColumn("turn", turn).distinct()
    start = held.select(F.col("id").cast("long").alias("id"), "name").withColumns({"seq": F.lit(None).cast(asked.schema["seq"].dataType), "turn": F.lit(-1), "op": F.lit("start")})
    state = cut(start.unionByName(asked).withColumn("good", F.lit(True)))
    by = [F.asc_nulls_first("seq"), *map(F.col, order[1:])]
    while True:
        kept = F.when(F.col("good"), F.struct(F.when(F.col("op") != "remove", F.col("name")).alias("n")))
        lines = cut(ranked(state, ["id"], by, "_n", {"_was": kept}).withColumn("was", F.col("_was.n")).drop("_n", "_was"))
        takes = lines.filter("good and op != 'remove'").select(F.col("name").alias("on"), *order, F.lit(1).alias("d"))
        frees = lines.filter("good and was is not null and op != 'start'").select(F.col("was").alias("on"), *order, F.lit(-1).alias("d"))
        asks = lines.filter("op in ('change', 'add')").select(F.col("name").alias("on"), *order, F.lit(0).alias("d"), "op", "was", "good")
        events = takes.unionByName(frees).unionByName(asks, allowMissingColumns=True)
        # an edit sees what came before it; its own events come after its question
        seen = ranked(events, ["on"], [*by, F.asc(F.col("d") != 0), F.col("d")], "_n", sums={"holders": F.col("d")}).filter("d = 0")
        free = F.col("holders") - F.when(F.col("was") == F.col("on"), 1).otherwise(0) <= 0
        decided = cut(seen.select("seq", "turn", "id", F.col("on").alias("name"), "op", (free & ((F.col("op") == "add") | F.col("was").isNotNull())).alias("good"), F.col("good").alias("guess")))
        state = state.filter("op in ('start', 'remove')").unionByName(decided.drop("guess"))
        if not decided.filter("good != guess").limit(1).count():
            break
        state = cut(state)
    kept = F.when(F.col("good"), F.struct("seq", "turn", F.col("name").alias("n")))
    last = state.withColumn("name", F.when(F.col("op") != "remove", F.col("name"))).groupBy("id").agg(F.max(kept).alias("x"))
    return last.filter("x.n is not null").select("id", F.col("x.n").alias("name"), (F.col("x.turn") >= 0).alias("edited"))


def renamed(tasks: DataFrame, edits: DataFrame) -> DataFrame:
    """Tasks under the names of edits (task_id, name, and seq if they have an order); blank names are left out.

    In order, a rename is refused while another task has the name. Without an order the edits stand or fall together: a
    name that two of them ask for, or that a task has which keeps it, is refused, and a refusal blocks those behind
    it. ``status``, ``origin`` and ``review_state`` of renamed tasks, where tasks have them, say that a user did it.
    """
    asked = edits.select("task_id", F.trim("name").alias("asked"), *(["seq"] if "seq" in edits.columns else [])).filter("asked != ''")
    if "seq" in edits.columns:
        own = replayed(tasks.select(F.col("task_id").alias("id"), "name"), asked.select("seq", F.col("task_id").alias("id"), F.lit("change").alias("op"), F.col("asked").alias("name")))
        free = own.filter("edited").select(F.col("id").alias("task_id"), F.col("name").alias("asked"))
    else:
        twice = asked.groupBy("asked").agg(F.count("*").alias("n")).filter("n > 1").select("asked")
        free = cut(asked.join(twice, "asked", "left_anti"))
        while True:
            held = tasks.join(free.select("task_id"), "task_id", "left_anti").select(F.col("name").alias("asked")).distinct()
            less = cut(free.join(held, "asked", "left_anti"))
            if less.count() == free.count():
                break
            free = less
    said = {"name": F.coalesce("asked", "name")} | {c: F.when(F.col("asked").isNotNull(), v).otherwise(F.col(c)) for c, v in (("status", "edited"), ("origin", "user"), ("review_state", "confirmed")) if c in tasks.columns}
    return tasks.join(free.select("task_id", "asked"), "task_id", "left").withColumns(said).select(tasks.columns)


def hidden(tasks: DataFrame, edits: DataFrame) -> DataFrame:
    """``not_a_task`` as the last of edits (seq, task_id, hide boolean) says; links stay."""
    last = edits.groupBy("task_id").agg(F.max_by("hide", "seq").alias("hide"))
    return tasks.join(last, "task_id", "left").withColumn("not_a_task", F.coalesce("hide", "not_a_task")).select(tasks.columns)


def split(tasks: DataFrame, links: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, links) after documents of tasks went to new ones: edits (task_id, doc_id, new_id, name). Only
    documents that the task has move; a new task without any does not come to be."""
    moved = edits.join(links.select("task_id", "doc_id"), ["task_id", "doc_id"], "left_semi")
    made = moved.groupBy("new_id").agg(F.min("name").alias("name")).select(F.col("new_id").alias("task_id"), "name", F.lit(False).alias("not_a_task"), F.lit(None).cast("long").alias("merged_into"))
    rest = links.join(moved.select("task_id", "doc_id"), ["task_id", "doc_id"], "left_anti")
    new = moved.select(F.col("new_id").alias("task_id"), "doc_id").distinct().withColumn("is_primary", F.lit(False))
    return tasks.select("task_id", "name", "not_a_task", "merged_into").unionByName(made), rest.select("task_id", "doc_id", "is_primary").unionByName(new)


def reassigned(links: DataFrame, edits: DataFrame) -> DataFrame:
    """Links after edits (seq, op, task_id, doc_id): assign, detach and primary; the last edit of a link holds, and a
    task has one primary document, that of its last edit. Links without an edit keep their ``origin``, if they have one."""
    last = edits.groupBy("task_id", "doc_id").agg(F.max_by("op", "seq").alias("op"))
    links = links if "origin" in links.columns else links.withColumn("origin", F.lit("machine"))
    own = links.join(last, ["task_id", "doc_id"], "full_outer").filter("op is null or op != 'detach'")
    chosen = edits.filter("op = 'primary'").join(last.filter("op = 'primary'").select("task_id", "doc_id"), ["task_id", "doc_id"], "left_semi")
    chosen = chosen.groupBy("task_id").agg(F.max_by("doc_id", "seq").alias("chosen"))
    primary = F.when(F.col("chosen").isNotNull(), F.col("doc_id") == F.col("chosen")).otherwise(F.coalesce("is_primary", F.lit(False)))
    return own.join(chosen, "task_id", "left").select("task_id", "doc_id", primary.alias("is_primary"), F.when(F.col("op").isNotNull(), "user").otherwise(F.coalesce("origin", F.lit("machine"))).alias("origin"))


def dated(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, date, decided_by after edits (seq, doc_id, date); a null date confirms that it is unknown."""
    last = edits.groupBy("doc_id").agg(F.max_by(F.struct("date"), "seq").alias("said"))
    return docs.join(last, "doc_id", "left").select("doc_id", F.when(F.col("said").isNotNull(), F.col("said.date")).otherwise(F.col("date")).alias("date"), F.when(F.col("said").isNotNull(), "user").otherwise("machine").alias("decided_by"))


def confirmed_steps(steps: DataFrame, edits: DataFrame) -> DataFrame:
    """Steps (task_id, year, decided_by and more) after confirmations (task_id, year): one makes all steps of its year a user's."""
    said = edits.select("task_id", "year").distinct().withColumn("_said", F.lit(True))
    own = steps.join(said.hint("merge"), ["task_id", "year"], "left")
    return own.withColumn("decided_by", F.when(F.col("_said"), "user").otherwise(F.col("decided_by"))).select(steps.columns)


def marks(edits: DataFrame, kind: str) -> DataFrame:
    """target_id, state of the last mark of a kind (seq, kind, target_id, done): ``done``, or ``pending`` once it is taken back."""
    last = edits.filter(F.col("kind") == kind).groupBy("target_id").agg(F.max_by("done", "seq").alias("done"))
    return last.select("target_id", F.when(F.col("done"), "done").otherwise("pending").alias("state"))


def rated(questions: DataFrame, ratings: DataFrame) -> DataFrame:
    """id, question, rating: a rating (seq, question, rating) goes to the latest asking of its question."""
    latest = questions.groupBy("question").agg(F.max("id").alias("id"))
    last = ratings.groupBy("question").agg(F.max_by("rating", "seq").alias("rating"))
    at = latest.join(last, "question").select("id", "rating")
    return questions.join(at, "id", "left").select("id", "question", "rating")


def sources_after(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """source_id, path after edits (seq, op, source_id, path), replayed in order: an added source whose path is taken is
    left out, a changed one whose new path is taken keeps its own, a removed one frees its path for later edits."""
    own = replayed(sources.select(F.col("source_id").alias("id"), F.col("path").alias("name")), edits.select("seq", F.col("source_id").alias("id"), "op", F.col("path").alias("name")))
    return own.select(F.col("id").alias("source_id"), F.col("name").alias("path"))


def without_sources(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents of the sources that are left."""
    return docs.join(sources.select("source_id"), "source_id", "left_semi")
