"""Invalidation along a declared graph of derived tables: what a changed document drags with it, in one pass.

A table of the graph names its parent and the column that holds the parent's key. Keys of changed rows go from
parents to children in topological order, once. Rows that are reached go, unless a user decided
them; rows of a table that only links (``passes``) stay and hand on the keys that they hold.

Cases: rows without a parent key are never reached; a key that no row has reaches nothing; repeated keys count
once; empty tables stay empty; a graph with a ring, an unknown parent or a table without frame is refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut


@dataclass(frozen=True)
class Derived:
    """A table made from ``parent``: ``on`` holds the parent's key, ``key`` is what its own children name;
    ``kept`` is a SQL condition on rows that stay, ``passes`` marks links, all of whose rows stay."""

    table: str
    parent: str
    on: str
    key: str | None = None
    kept: str = "false"
    passes: bool = False


#: Fixed value: what is made from documents and, through their links, from tasks.
DOCUMENTS = (
    Derived("sections", "documents", "doc_id"),
    Derived("text_index", "documents", "doc_id"),
    Derived("dates", "documents", "doc_id", kept="kind = 'user'"),
    Derived("document_vectors", "documents", "doc_id"),
    Derived("chunks", "documents", "doc_id", key="chunk_id"),
    Derived("chunk_vectors", "chunks", "chunk_id"),
    Derived("proposals", "documents", "doc_id", kept="status != 'proposed'"),
    Derived("attempts", "documents", "doc_id"),
    Derived("links", "documents", "doc_id", key="task_id", passes=True),
    Derived("cycles", "links", "task_id", kept="decided_by = 'user'"),
    Derived("steps", "links", "task_id", kept="decided_by = 'user'"),
    Derived("reading", "links", "task_id"),
    Derived("health", "links", "task_id"),
)


def ordered(graph: tuple[Derived, ...], root: str) -> list[Derived]:
    """The tables with parents before children."""
    own = {d.table: d for d in graph}
    if len(own) < len(graph) or root in own:
        raise ValueError("a table is derived twice")
    for d in graph:
        if d.parent != root and (d.parent not in own or own[d.parent].key is None):
            raise ValueError(f"{d.table}: {d.parent} has no key in the graph")
    try:
        order = TopologicalSorter({d.table: {d.parent} for d in graph}).static_order()
        return [own[t] for t in order if t != root]
    except CycleError as ring:
        raise ValueError(f"ring of tables: {ring.args[1]}") from None


def invalidate(tables: dict[str, DataFrame], changed: DataFrame, graph: tuple[Derived, ...] = DOCUMENTS, root: str = "documents") -> tuple[dict[str, DataFrame], DataFrame]:
    """(what is left of each table, report). ``changed`` has the root's keys in its first column. The report has a row a
    table: table_name, rows, reached, kept (by users), gone.

    Each table is joined to the distinct keys that reach it, by shuffle; a table with children is stored once with its
    marks, since the children's keys, its rest and its counts all read it.
    """
    keys = {root: cut(changed.select(F.col(changed.columns[0]).alias("_k")).filter("_k is not null").distinct())}
    parents = {d.parent for d in graph}
    left, counts = {}, None
    for d in ordered(graph, root):
        if d.table not in tables:
            raise ValueError(f"no table {d.table}")
        own = tables[d.table]
        hit = keys[d.parent].select(F.col("_k").alias("_p"), F.lit(True).alias("_hit"))
        marked = own.join(hit.hint("shuffle_hash"), own[d.on].eqNullSafe(hit["_p"]) & own[d.on].isNotNull(), "left").drop("_p").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        kept = F.lit(True) if d.passes else F.coalesce(F.expr(d.kept), F.lit(False))
        marked = marked.withColumn("_gone", F.col("_hit") & ~kept)
        if d.table in parents:
            marked = cut(marked)
            passed = marked.filter("_hit" if d.passes else "_gone")
            keys[d.table] = cut(passed.select(F.col(d.key).alias("_k")).filter("_k is not null").distinct())
        left[d.table] = marked.filter("not _gone").drop("_hit", "_gone")
        one = marked.agg(F.count("*").alias("rows"), F.count_if("_hit").alias("reached"), F.count_if(F.col("_hit") & ~F.col("_gone")).alias("kept"), F.count_if("_gone").alias("gone")).select(F.lit(d.table).alias("table_name"), "rows", "reached", "kept", "gone")
        counts = one if counts is None else counts.unionByName(one)
    return left, counts
