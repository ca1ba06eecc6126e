"""URL filter: hand rules first, then gradient-boosted trees on lexical features.

Rules decide by host and path prefix, the longest winning. The URLs they decide are the labelled
URLs that the trees learn from; the trees judge all others. Everything runs as DataFrame
functions and ``pyspark.ml`` (JVM), without Python code on the executors.

Cases: a null URL or one without ``://`` has an empty host and path, no rule, and is judged by
the trees on its empty features; without labelled URLs of both kinds the default verdict holds;
repeated rows are kept; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "host_labels", "digit_ratio", "hyphen_ratio", "entropy", "params", "fragment", "suffix_share", "suffix_depth")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) by the first ``://``; both empty without one."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.when(has, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    def fits(h: str, p: str) -> Column:
        return ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))

    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    hit = lambda h, p, v: F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
    first, *rest = ordered
    return reduce(lambda out, r: out.when(fits(r[0], r[1]), hit(*r)), rest, F.when(fits(first[0], first[1]), hit(*first)))


def with_parts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, rule_verdict."""
    host, path = split_url(F.col("url"))
    return (
        pages.select("page_id", "url", host.alias("host"), path.alias("path"))
        .withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
        .select("page_id", "url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("rule_verdict"))
    )


def _entropy(text: Column) -> Column:
    """Bits a character over the distinct characters of ``text``; 0 for an empty one."""
    n = F.length(text)
    times = lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double")
    plain = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda total, c: total + F.when(c != "", times(c) * F.log2(times(c))).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - plain / n).otherwise(0.0)


def with_features(parts: DataFrame, suffixes: dict[str, tuple[float, float]], rest: DataFrame | None = None) -> DataFrame:
    """Adds FEATURES. ``suffixes``: the most frequent suffixes with their statistics; ``rest``: a table
    (suffix, share, mean_depth) of all others, each of fewer rows than any of those, so that the join
    has no hot key."""
    if rest is not None:
        own = F.substring_index("host", ".", -1)
        top = own.isin(list(suffixes))
        cold = parts.filter(~top).withColumn("suffix", own).join(rest.hint("merge"), "suffix").drop("suffix")
        known = parts.filter(top).withColumns({"share": F.lit(None).cast("double"), "mean_depth": F.lit(None).cast("double")})
        parts = known.unionByName(cold)
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    suffix = F.substring_index("host", ".", -1)

    def looked_up(i: int) -> Column:
        pairs = [x for k, v in suffixes.items() for x in (F.lit(k), F.lit(float(v[i])))]
        found = [F.try_element_at(F.create_map(*pairs), suffix)] if pairs else []
        return F.coalesce(*found, *([F.col(("share", "mean_depth")[i])] if rest is not None else []), F.lit(0.0))

    return parts.select(
        "*",
        F.length(url).cast("double").alias("url_chars"),
        F.length("host").cast("double").alias("host_chars"),
        F.length("path").cast("double").alias("path_chars"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("depth"),
        F.regexp_count("host", F.lit(r"\.")).cast("double").alias("host_labels"),
        (F.regexp_count(url, F.lit("[0-9]")) / n).alias("digit_ratio"),
        (F.regexp_count(url, F.lit("-")) / n).alias("hyphen_ratio"),
        _entropy(url).alias("entropy"),
        F.regexp_count(url, F.lit("[?&][^=&#]+")).cast("double").alias("params"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        looked_up(0).alias("suffix_share"),
        looked_up(1).alias("suffix_depth"),
    )


def _suffixes(parts: DataFrame, suffix_rows: int) -> tuple[dict[str, tuple[float, float]], DataFrame | None]:
    """(statistics of the most frequent suffixes, table of all others if there are more)."""
    by = parts.groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(F.count("*").alias("n"), F.avg(F.regexp_count("path", F.lit("/"))).alias("depth"))
    n_rows = parts.agg(F.count("*").alias("total"))
    top = by.orderBy(F.desc("n"), "suffix").limit(suffix_rows + 1).collect()
    more, top = len(top) > suffix_rows, top[:suffix_rows]
    rows = max(1, n_rows.first()["total"])
    suffixes = {r["suffix"]: (r["n"] / rows, r["depth"]) for r in top}
    if not more:
        return suffixes, None
    share = F.col("n").cast("double") / F.lit(float(rows))
    return suffixes, stored(by.filter(~F.col("suffix").isin(list(suffixes))).select("suffix", share.alias("share"), F.col("depth").alias("mean_depth")), "suffixes")


def _labelled(parts: DataFrame) -> DataFrame:
    return parts.filter(F.col("rule").isNotNull()).select("page_id", "url", "host", "path", F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0).alias("label"))


def _trees(labelled: DataFrame, statistics: tuple, sample_rows: int, rounds: int, depth: int):
    """Trees fitted on the first ``sample_rows`` of labelled URLs by a hash, or None without both labels."""
    sample = labelled.orderBy(F.xxhash64("url"), "page_id").limit(sample_rows)
    train = with_features(sample, *statistics).select("label", *FEATURES).repartition(6)
    if train.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(labelCol="label", featuresCol="_features", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7).fit(_gather().transform(train))


def _gather() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features")


def _scored(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(_gather().transform(rows)).withColumn("block_score", F.element_at(vector_to_array("probability"), 2))


def url_filter(pages: DataFrame, rules=RULES, sample_rows: int = 20_000, suffix_rows: int = 500, rounds: int = 10, depth: int = 3, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row.

    ``sample_rows`` bounds the labelled URLs that the trees are fitted on (the first by a hash of
    the URL); ``suffix_rows`` bounds the suffixes looked up in memory (the most frequent), all others
    are joined as a table. Statistics are counted over all rows.
    """
    parts = with_parts(pages, rules)
    statistics = _suffixes(parts, suffix_rows)
    trees = _trees(_labelled(parts), statistics, sample_rows, rounds, depth)
    judged = with_features(parts, *statistics)
    if trees is None:
        scored = judged.withColumn("block_score", F.lit(1.0 if default == "block" else 0.0))
    else:
        scored = _scored(trees, judged)
    by_model = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "block_score")


def held_out_accuracy(pages: DataFrame, rules=RULES, sample_rows: int = 20_000, suffix_rows: int = 500, rounds: int = 10, depth: int = 3) -> DataFrame:
    """label, rows, right: how trees fitted on four fifths of the labelled URLs judge the other fifth (by crc32 of the URL)."""
    parts = with_parts(pages, rules)
    statistics = _suffixes(parts, suffix_rows)
    fold = F.crc32(F.col("url").cast("binary")) % 5 == 0
    trees = _trees(_labelled(parts).filter(~fold), statistics, sample_rows, rounds, depth)
    judged = _scored(trees, with_features(_labelled(parts).filter(fold), *statistics))
    return judged.groupBy("label").agg(F.count("*").alias("rows"), F.sum(((F.col("block_score") > 0.5) == (F.col("label") == 1.0)).cast("long")).alias("right"))
