"""Date inference: every candidate is kept, one is chosen.

A calendar date is valid by the pattern itself (month lengths, leap years, the range of years), so
what a pattern matches can be blanked out before the next, coarser pattern runs; an impossible day
stays open for it. Numbers after 제, 호, 번, 쪽 or p. are no dates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD_CHARS, FIRST_YEAR, HEAD_SECTIONS = 4000, 1990, 6
RANK = {"day": 3, "month": 2, "year": 1}
KINDS = ("body", "filename", "meta", "folder", "fs")
#: Words that announce a document's own date.
LABEL = r"(?:작성일자?|작성|기준일자?|시행일자?|발행일자?|보고일자?|접수일자?|제출일자?|일자)\s*[:：]?\s*"
NOISE = r"(?<!(?:제|호|번|쪽)\s{0,2}|[pP]\.\s?|[pP]\s{0,2})"
SEP = r"[._\-/]"


def _years(last: int) -> str:
    return "(?:" + "|".join(str(y) for y in range(FIRST_YEAR, last + 1)) + ")"


def _leap(last: int) -> str:
    return "(?:" + "|".join(str(y) for y in range(FIRST_YEAR, last + 1) if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)) + ")"


def patterns(this_year: int) -> list[tuple[str, str]]:
    """(pattern, precision), finest first: compact day, written day, month, year. Group y is 1, m 2,
    d 3 in the order of alternatives; digits are read back from the match."""
    last = this_year + 1
    y, leap = _years(last), _leap(last)
    gap_y, gap_m = rf"\s*(?:년\s*|{SEP}\s*)", rf"\s*(?:월\s*|{SEP}\s*)"

    def valid(a: str, b: str, pad: bool) -> str:
        z = "0" if pad else "0?"
        # atomic, so that an impossible day is not cut down to a possible one
        day = rf"(?>3[01]|[12]\d|{z}[1-9])"
        long, short = f"(?:1[02]|{z}[13578])", f"(?:11|{z}[469])"
        return f"(?:{y}{a}(?:{long}{b}{day}|{short}{b}(?!31){day}|{z}2{b}(?!3[01]|29){day})|{leap}{a}{z}2{b}(?!3[01]){day})"

    compact = NOISE + r"(?<!\d)" + valid("", "", True) + r"(?!\d)"
    full = NOISE + r"(?<!\d)" + valid(gap_y, gap_m, False) + r"\s*일?"
    month = NOISE + rf"(?<!\d){y}{gap_y}(?:1[0-2]|0?[1-9])\s*(?:월|\.)?(?![\s._\-/]*\d)"
    year = NOISE + rf"(?<!\d){y}\s*(?:회계연도|년도|년|학년도)?(?!\d)"
    return [("(?U)" + compact, "day"), ("(?U)" + full, "day"), ("(?U)" + month, "month"), ("(?U)" + year, "year")]


def _blank(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, " ")


def _numbers(raw: Column) -> Column:
    """Year, month and day of a match; a compact match is cut by position."""
    parts = F.regexp_extract_all(raw, F.lit(r"(\d+)"), 1)
    packed = F.length(F.element_at(parts, 1)) == 8
    first = F.element_at(parts, 1)
    cut = lambda at, n: F.substring(first, at, n).cast("int")
    return F.when(packed, F.array(cut(1, 4), cut(5, 2), cut(7, 2))).otherwise(F.transform(parts, lambda p: p.cast("int")))


def scan(text: Column, this_year: int, labelled: bool = False) -> Column:
    """array<struct<value date, precision, raw, labeled>> of all hits, finest pattern first."""
    out, left = [], F.coalesce(text, F.lit(""))
    for pattern, precision in patterns(this_year):
        p = "(?U)" + LABEL + pattern.removeprefix("(?U)").removeprefix(NOISE) if labelled else pattern
        out.append(F.transform(F.regexp_extract_all(left, F.lit("(" + p + ")"), 1), _maker(precision, labelled)))
        left = _blank(left, p)
    return F.concat(*out)


def _maker(precision: str, labelled: bool):
    def made(raw: Column) -> Column:
        n = _numbers(raw)
        m = F.coalesce(F.get(n, F.lit(1)), F.lit(1)) if precision != "year" else F.lit(1)
        d = F.coalesce(F.get(n, F.lit(2)), F.lit(1)) if precision == "day" else F.lit(1)
        return F.struct(F.make_date(F.get(n, F.lit(0)), m, d).alias("value"), F.lit(precision).alias("precision"), F.trim(raw).alias("raw"), F.lit(labelled).alias("labeled"))

    return made


def _rank(precision: Column) -> Column:
    return F.when(precision == "day", 3).when(precision == "month", 2).otherwise(1)


def best_of_text(text: Column, this_year: int) -> Column:
    """The candidate of one text: labelled dates win; else the year named most often (the first hit
    breaks ties), then the finest precision, then the earliest position."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD_CHARS)
    def ranked(cs: Column) -> Column:
        keyed = F.transform(cs, lambda c: F.struct((-_rank(c["precision"])).alias("p"), F.call_function("locate", c["raw"], head).alias("at"), c.alias("c")))
        return F.element_at(F.array_sort(keyed), 1)["c"]

    own, free = scan(head, this_year, True), scan(head, this_year)
    votes = F.transform(F.array_distinct(F.transform(free, lambda c: F.year(c["value"]))), lambda y: F.struct((-F.size(F.filter(free, lambda c: F.year(c["value"]) == y))).alias("n"), F.array_position(F.transform(free, lambda c: F.year(c["value"])), y).alias("at"), y.alias("y")))
    top = F.element_at(F.array_sort(votes), 1)["y"]
    return F.when(F.size(own) > 0, ranked(own)).when(F.size(free) > 0, ranked(F.filter(free, lambda c: F.year(c["value"]) == top)))


def finest(text: Column, this_year: int) -> Column:
    """The hit of finest precision; hits come finest first, so it is the first."""
    return F.get(scan(text, this_year), F.lit(0))


def parse_meta(raw: Column, this_year: int) -> Column:
    """Document property dates: D:YYYYMMDD..., YYYYMMDD... or ISO; anything else is null."""
    text = F.regexp_replace(F.trim(raw), "^D:", "")
    packed = F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"^(\d{8})", 1), F.lit("yyyyMMdd")))
    iso = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    date = F.when(text.rlike(r"^\d{8}"), packed).otherwise(F.to_date(iso))
    return F.when(F.year(date).between(FIRST_YEAR, this_year + 1), date)


def candidates(docs: DataFrame, this_year: int) -> DataFrame:
    """doc_id, kind, value, precision, raw, labeled: one candidate a kind at most, all kept.

    docs: doc_id, sections array<string> (or null), filename, path, meta_created, meta_modified, mtime.
    """
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    folders = F.reverse(F.filter(F.slice(F.split("path", r"[/\\]"), 1, F.greatest(F.size(F.split("path", r"[/\\]")) - 1, F.lit(0))), lambda f: f != ""))
    folder_hits = F.filter(F.transform(folders, lambda f: finest(f, this_year)), lambda c: c.isNotNull())
    bodies = F.filter(F.transform(F.slice("sections", 1, HEAD_SECTIONS), lambda s, i: F.struct(best_of_text(s, this_year).alias("c"), i.alias("i"))), lambda x: x["c"].isNotNull())
    body = F.element_at(F.array_sort(F.transform(bodies, lambda x: F.struct((~x["c"]["labeled"]).alias("l"), (-_rank(x["c"]["precision"])).alias("p"), x["i"].alias("i"), x["c"].alias("c")))), 1)["c"]
    day = lambda value, raw: F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit("day").alias("precision"), raw.cast("string").alias("raw"), F.lit(False).alias("labeled")))
    meta = F.coalesce(day(parse_meta(F.col("meta_created"), this_year), F.col("meta_created")), day(parse_meta(F.col("meta_modified"), this_year), F.col("meta_modified")))
    at = F.to_date("mtime")
    fs = day(F.when(F.year(at).between(FIRST_YEAR, this_year + 1), at), F.col("mtime"))
    found = {"body": F.when(F.size("sections") > 0, body), "filename": finest(stem, this_year), "meta": meta, "folder": F.get(folder_hits, F.lit(0)), "fs": fs}
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("c")) for k, c in found.items()))
    return docs.select("doc_id", F.explode(rows).alias("x")).filter("x.c is not null").select("doc_id", "x.kind", "x.c.value", "x.c.precision", "x.c.raw", "x.c.labeled")


def resolve(found: DataFrame) -> DataFrame:
    """doc_id, value, kind, precision: by kind, then labelled, then precision."""
    kind = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), 99)).otherwise(99)
    w = Window.partitionBy("doc_id").orderBy(kind, F.desc("labeled"), F.desc(_rank(F.col("precision"))), "value")
    return found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("doc_id", "value", "kind", "precision")


def typed_date(text: Column) -> Column:
    """A typed date ("2024.3.11", "2024년 3월", "2024") as struct(value, precision); null if impossible."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda p: p.cast("int"))
    padded = F.slice(F.concat(n, F.array(F.lit(1), F.lit(1))), 1, 3)
    value = F.to_date(F.try_to_timestamp(F.array_join(F.transform(padded, lambda x: x.cast("string")), "-"), F.lit("yyyy-M-d")))
    precision = F.when(F.size(n) >= 3, "day").when(F.size(n) == 2, "month").otherwise("year")
    return F.when(F.size(n).between(1, 3) & value.isNotNull(), F.struct(value.alias("value"), precision.alias("precision")))


def trust_report(chosen: DataFrame) -> DataFrame:
    """documents, trusted, share, gate: the share of dates from better sources than the file system."""
    own = chosen.agg(F.count("*").alias("documents"), F.count_if(F.col("kind") != "fs").alias("trusted"))
    share = F.when(F.col("documents") == 0, 0.0).otherwise(F.col("trusted") / F.col("documents"))
    return own.withColumn("share", share).withColumn("gate", F.when(F.col("share") >= 0.8, "pass").when(F.col("share") >= 0.6, "warn").otherwise("fail"))


def year_disagreements(found: DataFrame) -> DataFrame:
    """doc_id, body_year, filename_year where both are there and differ."""
    side = lambda k: found.filter(F.col("kind") == k).select("doc_id", F.year("value").alias(k + "_year"))
    return side("body").join(side("filename"), "doc_id").filter("body_year != filename_year")


def date_text(value: Column, precision: Column) -> Column:
    """A date as precise as it is known."""
    return F.when(precision == "day", F.date_format(value, "yyyy-MM-dd")).when(precision == "month", F.date_format(value, "yyyy-MM")).otherwise(F.date_format(value, "yyyy"))
