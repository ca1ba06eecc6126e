"""Rule checks of generated answers, which are an input table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.text import WORD, clip, collapse, overlap_ratio

#: Numbers, and endings that negate.
NUMBER = r"(?<!\d)\d+(?:,\d{3})*(?:\.\d+)?%?"
NEGATION = "아니(?:다|라|며|고|었)|않(?:다|는|았|습니다)|없(?:다|음|습|었)|불가|금지"
LEAST_OVERLAP, POLARITY_OVERLAP = 0.25, 0.8
ANSWER = "answered boolean, sentences array<struct<text: string, sources: array<bigint>>>"


def parse_answer(raw: Column) -> Column:
    """The answer's struct; whole sentences are recovered from cut-off JSON."""
    whole = F.from_json(raw, ANSWER)
    found = F.regexp_extract_all(raw, F.lit(r'(\{\s*"text"\s*:\s*"(?:[^"\\]|\\.)*"\s*,\s*"sources"\s*:\s*\[[^\]]*\]\s*\})'), 1)
    saved = F.transform(found, lambda s: F.from_json(s, "text string, sources array<bigint>"))
    return F.when(whole["sentences"].isNotNull(), whole).when(F.size(saved) > 0, F.struct(F.lit(True).alias("answered"), saved.alias("sentences")))


def numbers(text: Column) -> Column:
    """Canonical numbers: no thousands marks, no leading zeros, no trailing ones after a point, % kept."""
    def canonical(n: Column) -> Column:
        bare = F.regexp_replace(n, "[,%]", "")
        short = F.when(F.contains(bare, F.lit(".")), F.regexp_replace(bare, r"\.?0+$", "")).otherwise(bare)
        short = F.regexp_replace(short, r"^0+(?=\d)", "")
        return F.concat(short, F.when(F.endswith(n, F.lit("%")), "%").otherwise(""))

    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(" + NUMBER + ")"), 1), canonical))


def unsupported_numbers(text: Column, support: Column) -> Column:
    return F.array_sort(F.array_except(numbers(text), numbers(support)))


def clean_sources(sources: Column, known: Column) -> Column:
    return F.filter(sources, lambda s: s.isNotNull() & F.array_contains(known, s))


def polarity_conflict(text: Column, support: Column, word: str = WORD) -> Column:
    """A mark after a digit ends no part. Parts of the support that say the same (overlap 0.8) all have the opposite negation."""
    parts = F.filter(F.split(support, r"(?<!\d)[.!?]\s*|\n+"), lambda p: (F.trim(p) != "") & (overlap_ratio(text, p, word) >= POLARITY_OVERLAP))
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(NEGATION) != text.rlike(NEGATION))


def verdict(text: Column, sources: Column, known: Column, support: Column, word: str = WORD) -> Column:
    """Null if the sentence stands, else the first rule that it breaks."""
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty")
        .when(F.coalesce(F.size(sources), F.lit(0)) <= 0, "no source")
        .when(F.size(clean_sources(sources, known)) == 0, "unknown source")
        .when(F.size(unsupported_numbers(text, support)) > 0, "number")
        .when(overlap_ratio(text, support, word) < LEAST_OVERLAP, "overlap")
        .when(polarity_conflict(text, support, word), "polarity")
    )


def compose(sentences: DataFrame) -> DataFrame:
    """query_id, answer: kept sentences (query_id, pos, text, sources) in order, inline marks replaced by
    numbers of sources in the order of their first appearance."""
    cited = sentences.select("query_id", "pos", F.posexplode("sources").alias("k", "s"))
    first = cited.groupBy("query_id", "s").agg(F.min(F.struct("pos", "k")).alias("f"))
    number = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("f"))).select("query_id", "s", "n")
    marks = cited.join(number.hint("merge"), ["query_id", "s"]).groupBy("query_id", "pos").agg(F.sort_array(F.collect_set("n")).alias("ns"))
    bare = F.rtrim(F.regexp_replace("text", r"\s*\[\d+(?:\s*,\s*\d+)*\]", ""))
    line = sentences.join(marks.hint("merge"), ["query_id", "pos"], "left").select("query_id", "pos", F.concat(bare, F.coalesce(F.concat(F.lit(" "), F.array_join(F.transform("ns", lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")), F.lit(""))).alias("l"))
    return line.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l"))), lambda x: x["l"]), " ").alias("answer"))


def withheld(strong: Column, answered: Column, kept: Column) -> Column:
    return ~((F.coalesce(strong, F.lit(0)) > 0) & F.coalesce(answered, F.lit(False)) & (F.coalesce(kept, F.lit(0)) > 0))


def clean_name(name: Column) -> Column:
    """A task name without years and file endings, 2 to 20 characters, else null."""
    bare = collapse(F.regexp_replace(F.regexp_replace(name, r"(?:19|20)\d{2}\s*(?:년도|년)?", " "), r"\.[A-Za-z0-9]{1,5}$", ""))
    return F.when(F.length(bare).between(2, 20), bare)


def clean_category(value: Column, categories: list[str]) -> Column:
    """The trimmed value if the closed list has it, else null."""
    return F.when(F.trim(value).isin(*categories), F.trim(value))


def clean_confidence(value: Column) -> Column:
    """high, medium or low in lower case; low for anything else."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("high", "medium", "low"), low).otherwise("low")


def clean_keywords(words: Column) -> Column:
    """The first five distinct words of up to 30 characters, without marks around them; none of null."""
    bare = F.transform(F.coalesce(words, F.expr("cast(array() as array<string>)")), lambda w: F.regexp_replace(collapse(w), r"^[#·,.]+|[#·,.]+$", ""))
    own = F.filter(bare, lambda w: (w != "") & (F.length(w) <= 30))
    return F.slice(F.array_distinct(own), 1, 5)


def clean_summary(text: Column, most: int = 200) -> Column:
    return clip(collapse(text), most)


# Evaluation ---------------------------------------------------------------------------------


def judge(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """id, failures, passed. cases: id, expect, must_cite_any, must_not_cite, must_contain,
    min_distinct_docs; outcomes: id, withheld, cited array<string>, answer."""
    own = cases.join(outcomes, "id", "left")
    cited = F.coalesce("cited", F.expr("cast(array() as array<string>)"))
    given = ~F.coalesce("withheld", F.lit(True))
    tests = [
        ("expectation", (F.col("expect") == "answer") != given),
        ("must_cite_any", given & (F.coalesce(F.size("must_cite_any"), F.lit(0)) > 0) & ~F.exists("must_cite_any", lambda m: F.exists(cited, lambda c: F.contains(c, m)))),
        ("must_not_cite", F.exists("must_not_cite", lambda m: F.exists(cited, lambda c: F.contains(c, m)))),
        ("must_contain", given & ~F.forall("must_contain", lambda m: F.contains(F.coalesce("answer", F.lit("")), m))),
        ("min_distinct_docs", given & (F.size(F.array_distinct(cited)) < F.coalesce("min_distinct_docs", F.lit(0)))),
    ]
    failures = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests)))
    return own.select("id", failures.alias("failures"), (F.size(failures) == 0).alias("passed"))


def summary(judged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """cases, passed, mean_cited, median_ms (upper), max_ms; the median is found by ranks in ranges."""
    own = ranked(judged.select("id", "passed").join(outcomes.hint("merge"), "id"), [], [F.col("ms"), F.col("id")], "_n")
    size = F.broadcast(own.agg(F.count("*").alias("_size")))  # one row
    middle = F.col("_n") == F.floor(F.col("_size") / 2) + 1
    return own.crossJoin(size).agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.avg(F.size(F.array_distinct("cited"))).alias("mean_cited"), F.max(F.when(middle, F.col("ms"))).alias("median_ms"), F.max("ms").alias("max_ms"))


def stability(runs: DataFrame) -> DataFrame:
    """id, passes, rounds, unstable from (id, round, passed)."""
    own = runs.groupBy("id").agg(F.count_if("passed").alias("passes"), F.count("*").alias("rounds"))
    return own.withColumn("unstable", (F.col("passes") > 0) & (F.col("passes") < F.col("rounds")))
