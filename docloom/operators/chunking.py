"""Chunk packing: prose sections are merged into windows, other sections stand alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MERGEABLE = ("paragraph", "page")
LEAST, MOST, CUT = 400, 800, 1200


def pack(sections: DataFrame) -> DataFrame:
    """doc_id, ordinal, locator, text from (doc_id, kind, ordinal, locator, text).

    Blank sections go. Paragraphs and pages under 800 characters gather while the kind stays the same,
    until 400 characters are there; other kinds and longer ones stand alone; pieces are cut at 1200.
    The group of each section comes from one fold over the document's lengths, not its texts.
    """
    own = sections.withColumn("body", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("body != ''").withColumn("n", F.length("body"))
    own = own.withColumn("mix", F.col("kind").isin(*MERGEABLE) & (F.col("n") < MOST))
    shape = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "n", "mix"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, places, numbers = [], [], []
            for at, lines in enumerate(batch.column(1).to_pylist()):
                group = held = 0
                kind = None
                for x in lines:
                    goes_on = x["mix"] and 0 < held < LEAST and kind == x["kind"]
                    group, kind = group + (not goes_on), x["kind"]
                    held = (held if goes_on else 0) + x["n"] if x["mix"] else 0
                    docs.append(at)
                    places.append(x["ordinal"])
                    numbers.append(group)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), pa.array(places, pa.int32()), pa.array(numbers, pa.int32())], ["doc_id", "ordinal", "group"])

    groups = shape.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ordinal int, group int")
    joined = own.withColumn("ordinal", F.col("ordinal").cast("int")).join(groups.hint("merge"), ["doc_id", "ordinal"])
    merged = joined.groupBy("doc_id", "group").agg(F.array_sort(F.collect_list(F.struct("ordinal", "locator", "body"))).alias("p"))
    merged = merged.select("doc_id", "group", range_locator(F.element_at("p", 1)["locator"], F.element_at("p", -1)["locator"]).alias("locator"), F.array_join(F.col("p.body"), "\n").alias("text"))
    pieces = merged.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CUT).cast("int")))).withColumn("text", F.substring(F.col("text"), F.col("at") * CUT + 1, F.lit(CUT)))
    return pieces.filter(F.trim("text") != "").select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("group", "at")).alias("ordinal"), "locator", "text")


def range_locator(first, last):
    """'1문단' and '5문단' -> '1~5문단'; other units -> 'a~b'; equal ones stay."""
    unit = lambda x: F.regexp_extract(x, r"^(\d+)(\D.*)$", 2)
    number = lambda x: F.regexp_extract(x, r"^(\d+)(\D.*)$", 1)
    both = (number(first) != "") & (number(last) != "") & (unit(first) == unit(last))
    return F.when(first == last, first).when(both, F.concat(number(first), F.lit("~"), number(last), unit(last))).otherwise(F.concat(first, F.lit("~"), last))


def readiness(chunks: DataFrame) -> DataFrame:
    """chunks, embedded, usable: whether anything can be searched."""
    own = chunks.agg(F.count("*").alias("chunks"), F.count_if("embedded").alias("embedded"))
    return own.withColumn("usable", F.col("embedded") > 0)
