"""Corpus inventory, text sections, snapshot differences, retries, upserts and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Formats whose text can be read, folders and names that are not documents.
SUPPORTED = ("txt", "csv", "md", "log", "pdf", "docx", "pptx", "xlsx", "hwpx", "hwp")
SYSTEM_DIRS = ("$RECYCLE.BIN", "System Volume Information", "__pycache__", "node_modules")
TEMP_NAME = r"^(?:~\$|~|\.)|\.(?:tmp|bak|crdownload|part)$"
HASH_LIMIT, TEXT_LIMIT = 200 * 1024 * 1024, 2_000_000


def glob_pattern(glob: str) -> str:
    """A file-name glob as a regular expression over the whole path segment."""
    out = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in r".^$+{}[]|()\\" else c) for c in glob)
    return f"(?i)^{out}$"


def inventory(spark: SparkSession, root: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """path, filename, ext, size, mtime, state of the files under ``root``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return classify(keep_documents(found, excludes))


def keep_documents(files: DataFrame, excludes: tuple[str, ...] = ()) -> DataFrame:
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    name = F.element_at(parts, -1)
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad_dir = F.exists(dirs, lambda d: d.isin(*SYSTEM_DIRS) | F.startswith(d, F.lit(".")))
    own = files.withColumn("filename", name).filter(~bad_dir & ~name.rlike(TEMP_NAME))
    for glob in excludes:
        own = own.filter(~_any_matches(parts, glob_pattern(glob)))
    return own


def _any_matches(parts: Column, pattern: str) -> Column:
    return F.exists(parts, lambda p: p.rlike(pattern))


def classify(files: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    return files.withColumn("ext", ext).withColumn("state", F.when(ext.isin(*SUPPORTED), "pending").otherwise("skipped"))


def content_hash(content: Column, size: Column) -> Column:
    """SHA-256 of the bytes; null above 200 MB."""
    return F.when(size <= HASH_LIMIT, F.sha2(content, 256))


def snapshot_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, change: new, changed, unchanged, missing, restored or still missing.

    before: path, size, mtime, missing; now: path, size, mtime, scan_complete. Nothing is missing after
    a scan that did not complete.
    """
    complete = F.broadcast(now.agg(F.coalesce(F.bool_and("scan_complete"), F.lit(True)).alias("complete")))  # one row
    b = before.select("path", F.col("size").alias("s0"), F.col("mtime").alias("m0"), F.coalesce("missing", F.lit(False)).alias("was_missing"), F.lit(True).alias("b"))
    n = now.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1"), F.lit(True).alias("n"))
    own = b.join(n, "path", "full_outer").crossJoin(complete)
    same = (F.col("s0") == F.col("s1")) & (F.col("m0") == F.col("m1"))
    change = (
        F.when(F.col("b").isNull(), "new")
        .when(F.col("n").isNull() & F.col("was_missing"), "still missing")
        .when(F.col("n").isNull() & F.col("complete"), "missing")
        .when(F.col("n").isNull(), "unknown")
        .when(~F.coalesce(same, F.lit(False)), "changed")
        .when(F.col("was_missing"), "restored")
        .otherwise("unchanged")
    )
    return own.select("path", change.alias("change"))


def scan_statistics(diff: DataFrame, key: Column) -> DataFrame:
    """Counts of each change by source."""
    kinds = ("new", "changed", "unchanged", "missing", "restored")
    return diff.groupBy(key.alias("source")).agg(F.count("*").alias("found"), *(F.count_if(F.col("change") == k).alias(k) for k in kinds))


def decode(files: DataFrame) -> DataFrame:
    """path, text of (path, content): UTF-8 (with or without a mark) in the JVM; other bytes try cp949,
    euc-kr and latin-1 in batches."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")

    def other(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for raw in f["content"]:
                for name in ("utf-8-sig", "cp949", "euc-kr", "latin-1"):
                    try:
                        out.append(bytes(raw).decode(name))
                        break
                    except UnicodeDecodeError:
                        continue
            yield pd.DataFrame({"path": f["path"], "text": out})

    rest = files.filter(~good).select("path", "content").mapInPandas(other, "path string, text string")
    return files.filter(good).select("path", text.alias("text")).unionByName(rest)


def text_sections(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ordinal, locator, text: paragraphs between blank lines; one paragraph only is kept whole up to
    40 lines, then cut into groups of 40 lines; 2,000,000 characters a document."""
    body = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    paras = F.filter(F.split(body, r"\n\s*\n"), lambda p: F.trim(p) != "")
    rows = F.split(body, "\n")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / 40).cast("int")), lambda g: F.array_join(F.slice(rows, g * 40 + 1, F.lit(40)), "\n"))
    cut = F.when(F.size(paras) > 1, paras).when(F.size(rows) <= 40, paras).otherwise(F.filter(groups, lambda g: F.trim(g) != ""))
    own = texts.select(key, F.posexplode(cut).alias("i", "text"))
    own = own.withColumn("_sum", F.sum(F.length("text")).over(Window.partitionBy(key).orderBy("i")))
    own = own.filter(F.col("_sum") - F.length("text") < TEXT_LIMIT).withColumn("text", F.substring(F.trim("text"), F.lit(1), F.greatest(F.lit(0), TEXT_LIMIT - (F.col("_sum") - F.length("text"))).cast("int")))
    return own.select(key, (F.col("i") + 1).alias("ordinal"), F.concat((F.col("i") + 1).cast("string"), F.lit("문단")).alias("locator"), "text")


def assemble(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, body, char_count: sections in order, joined by line feeds."""
    own = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("s"), F.sum(F.length("text")).alias("char_count"))
    return own.select(key, F.array_join(F.col("s.text"), "\n").alias("body"), "char_count")


def replace_groups(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of a key are swapped as a unit."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def upsert(table: DataFrame, fresh: DataFrame, keys: list[str], version: str, guard: Column | None = None) -> DataFrame:
    """The newest row of each key by ``version``; guarded rows of the table win over fresh ones."""
    first = F.lit(0) if guard is None else F.when(guard, 1).otherwise(0)
    both = table.withColumn("_g", first).unionByName(fresh.withColumn("_g", F.lit(0)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_g"), F.desc(version)))).filter("_r = 1").drop("_g", "_r")


def work_needed(docs: DataFrame, done: DataFrame, version: str, most_attempts: int = 3) -> DataFrame:
    """Documents that are there, not yet done at ``version`` and tried fewer than three times."""
    have = done.filter(F.col("version") == version).select("doc_id").distinct()
    return docs.filter(~F.col("missing") & (F.coalesce("attempts", F.lit(0)) < most_attempts)).join(have, "doc_id", "left_anti")


def retry_state(attempts: DataFrame, most: int = 3) -> DataFrame:
    """kind, doc_id, failures, state since the last success; failures by locked files do not count."""
    last = attempts.filter("ok").groupBy("kind", "doc_id").agg(F.max("at").alias("_ok"))
    own = attempts.join(last, ["kind", "doc_id"], "left").withColumn("_f", ~F.col("ok") & (F.col("_ok").isNull() | (F.col("at") > F.col("_ok"))) & ~F.coalesce(F.col("error") == "locked", F.lit(False)))
    n = own.groupBy("kind", "doc_id").agg(F.count_if("_f").alias("failures"))
    return n.withColumn("state", F.when(F.col("failures") >= most, "failed_final").when(F.col("failures") > 0, "retry").otherwise("ok"))


def invalidate(derived: DataFrame, changed: DataFrame, key: str, decided: Column | None = None) -> DataFrame:
    """Derived rows of changed keys go, those that a user decided stay."""
    kept = F.lit(False) if decided is None else F.coalesce(decided, F.lit(False))
    hit = changed.select(key).distinct().withColumn("_hit", F.lit(True))
    return derived.join(hit.hint("merge"), key, "left").filter(F.col("_hit").isNull() | kept).drop("_hit")


def current_version(derived: DataFrame, version: str) -> DataFrame:
    return derived.filter(F.col("version") == version)


def revision_holds(start: int, end: int) -> bool:
    """Whether a batch's input stayed as it was."""
    return start == end


def parse_regression(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """path, change of two parse runs: added, lost, status, text (with ``large`` above 2 % of length) or
    sections; unchanged files are left out."""
    b, c = (d.select("path", *(F.col(x).alias(x + s) for x in ("status", "sections", "chars", "text_sha256"))) for d, s in ((baseline, "0"), (current, "1")))
    own = b.join(c, "path", "full_outer")
    change = F.when(F.col("status0").isNull(), "added").when(F.col("status1").isNull(), "lost").when(F.col("status0") != F.col("status1"), "status").when(F.col("text_sha2560") != F.col("text_sha2561"), "text").when(F.col("sections0") != F.col("sections1"), "sections")
    large = F.abs(F.col("chars1") - F.col("chars0")) > 0.02 * F.greatest(F.col("chars0"), F.lit(1))
    return own.select("path", change.alias("change"), F.when(change == "text", large).otherwise(False).alias("large")).filter("change is not null")


def parse_summary(results: DataFrame) -> DataFrame:
    """ext, files, parsed, rate, mean_ms, mean_chars, structured, gate (95 and 80 percent)."""
    own = results.groupBy("ext").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "parsed").alias("parsed"), F.avg("elapsed_ms").alias("mean_ms"), F.avg("chars").alias("mean_chars"), F.count_if(F.col("sections") > 1).alias("structured"))
    rate = F.col("parsed") / F.col("files")
    return own.withColumn("rate", rate).withColumn("gate", F.when(F.col("rate") >= 0.95, "pass").when(F.col("rate") >= 0.80, "warn").otherwise("fail"))


def failure_reasons(results: DataFrame, most: int = 5) -> DataFrame:
    """The commonest reasons of each ext, white space collapsed, 72 characters."""
    reason = F.substring(F.trim(F.regexp_replace("error", r"\s+", " ")), 1, 72)
    own = results.filter("status = 'failed'").groupBy("ext", reason.alias("reason")).agg(F.count("*").alias("n"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("ext").orderBy(F.desc("n"), "reason"))).filter(F.col("rank") <= most)


def stratified_sample(results: DataFrame, most: int) -> DataFrame:
    """The first ``most`` paths of each ext."""
    return results.withColumn("_r", F.row_number().over(Window.partitionBy("ext").orderBy("path"))).filter(F.col("_r") <= most).drop("_r")


def truth_labels(spark: SparkSession, path: str) -> DataFrame:
    """filename, label of a two-column CSV with or without a header."""
    own = spark.read.csv(path).select(F.trim("_c0").alias("filename"), F.trim("_c1").alias("label"))
    return own.filter(~F.lower("filename").isin("filename", "file", "파일명") & (F.col("filename") != "") & F.col("label").isNotNull())


def truth_from_name(filename: Column) -> Column:
    """The second '_' part where the first is a year and there are three or more."""
    parts = F.split(filename, "_")
    return F.when((F.size(parts) >= 3) & F.get(parts, F.lit(0)).rlike(r"^\d{4}$"), F.get(parts, F.lit(1)))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    own = spark.read.option("multiLine", True).json(path)
    return own.select(F.explode("cases").alias("c")).select("c.*") if "cases" in own.columns else own


def write_audit_csv(log: DataFrame, path: str) -> None:
    """The whole log in id order in one file, marked as UTF-8 for spreadsheets."""
    first, *rest = log.columns
    log.orderBy("id").select(F.col(first).alias("﻿" + first), *rest).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.mode("overwrite").text(path)
