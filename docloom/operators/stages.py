"""What each document needs next, and how far each stage is, from one pass over what was tried.

Events (doc_id, revision, stage, version, ok, error) are appended as stages run; ``version`` is the parser's or
rule's version, or the model's name. An event counts for the revision of its document and the version of its
stage that hold now, so a changed file or a new rule makes a stage due again without deleting anything.

Cases: documents without events need the first stage; events of unknown documents, stages, other revisions or versions count
nothing; a failure by a locked file is no failure; a success outweighs failures before and after it; missing
documents need nothing; repeated events count each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: failures after which a stage is given up.
ATTEMPTS = 3


@dataclass(frozen=True)
class Stage:
    """A stage and the version of it that holds; it waits for the stages before it."""

    name: str
    version: str


def stage_state(docs: DataFrame, events: DataFrame, stages: list[Stage], attempts: int = ATTEMPTS) -> DataFrame:
    """doc_id, next_stage, state, failures for docs (doc_id, revision, missing): the first stage that is not done, with state
    ``due``, ``retry`` or ``failed``; no stage and ``done`` or ``missing``. One aggregate of all events and one join."""
    known = F.create_map(*(F.lit(x) for s in stages for x in (s.name, s.version)))
    own = events.filter(F.element_at(known, F.col("stage")) == F.col("version"))
    here = lambda s: F.col("stage") == s.name
    broken = ~F.col("ok") & ~F.coalesce(F.col("error") == "locked", F.lit(False))
    seen = own.groupBy("doc_id", "revision").agg(*(F.coalesce(F.bool_or(here(s) & F.col("ok")), F.lit(False)).alias(f"done{i}") for i, s in enumerate(stages)), *(F.count_if(here(s) & broken).alias(f"failed{i}") for i, s in enumerate(stages)))
    both = docs.select("doc_id", "revision", "missing").join(seen.hint("shuffle_hash"), ["doc_id", "revision"], "left")
    place, failures = F.lit(None).cast("string"), F.lit(0).cast("long")
    for i in reversed(range(len(stages))):
        done = F.coalesce(f"done{i}", F.lit(False))
        place = F.when(~done, stages[i].name).otherwise(place)
        failures = F.when(~done, F.coalesce(f"failed{i}", F.lit(0))).otherwise(failures)
    gone = F.col("missing")
    state = F.when(gone, "missing").when(place.isNull(), "done").when(failures >= attempts, "failed").when(failures > 0, "retry").otherwise("due")
    return both.select("doc_id", F.when(~gone, place).alias("next_stage"), state.alias("state"), F.when(gone, 0).otherwise(failures).alias("failures"))


def work(state: DataFrame, stage: str) -> DataFrame:
    """doc_id of the documents that a stage has to work on."""
    return state.filter((F.col("next_stage") == stage) & F.col("state").isin("due", "retry")).select("doc_id")


def stage_counters(state: DataFrame, stages: list[Stage]) -> DataFrame:
    """stage, total, done, due, failed, waiting: one row a stage, all from one aggregate of ``stage_state``. A document
    waits for a stage while an earlier one is due or failed; missing documents count nowhere."""
    order = {s.name: i for i, s in enumerate(stages)}
    at = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in order.items() for x in p)), F.coalesce("next_stage", F.lit(""))), F.lit(len(stages)))
    rows = state.filter("state != 'missing'").withColumn("at", at).groupBy("at", "state").agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(s.name).alias("stage"), F.lit(i).alias("i")) for i, s in enumerate(stages)))).alias("s")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    i, here = F.col("s.i"), F.col("at") == F.col("s.i")
    return rows.select("at", "state", "n", each).groupBy(F.col("s.stage").alias("stage")).agg(F.sum("n").alias("total"), count(F.col("at") > i).alias("done"), count(here & (F.col("state") != "failed")).alias("due"), count(here & (F.col("state") == "failed")).alias("failed"), count(F.col("at") < i).alias("waiting"))
