"""Word tokens, stems and fuzzy containment for languages with short word endings, and status folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters (Hangul syllables, Latin letters, digits) and trailing marks.
WORD = r"[가-힣A-Za-z0-9][가-힣A-Za-z0-9,.]*"
TRAILING = ",.·:;!?\"')]}"
SHORTEST, SUFFIX = 2, 2


def collapse(text: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column, word: str = WORD) -> Column:
    """Words of two characters or more, without trailing marks."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(" + word + ")"), 1)
    return F.filter(F.transform(found, lambda w: F.rtrim(w, F.lit(TRAILING))), lambda w: F.length(w) >= SHORTEST)


def stem(word: Column) -> Column:
    """The shortest form that ``contains`` accepts: up to two characters off the end, two kept."""
    bare = F.rtrim(word, F.lit(TRAILING))
    return F.substring(bare, F.lit(1), F.greatest(F.lit(SHORTEST), F.length(bare) - SUFFIX))


def contains(text: Column, word: Column) -> Column:
    """Whether the word, or a form of it up to two characters shorter, is in the text. The shortest
    form is a prefix of all others, so it decides alone."""
    return (F.length(F.rtrim(word, F.lit(TRAILING))) >= SHORTEST) & F.contains(text, stem(word))


def overlap_ratio(text: Column, reference: Column, word: str = WORD) -> Column:
    """Share of the text's tokens that the reference contains; 1 without tokens."""
    own = tokens(text, word)
    hits = F.size(F.filter(own, lambda w: contains(F.coalesce(reference, F.lit("")), w)))
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(hits / F.size(own))


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis if anything was cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def elide(text: Column, most: int) -> Column:
    """The middle cut out, both ends kept."""
    head = (most - 1) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("…"), F.substring(text, -(most - 1 - head), most - 1 - head)))


def search_parts(term: Column) -> Column:
    """Parts of three characters or more; the whole term as one phrase if there is none."""
    parts = F.filter(F.split(F.trim(term), r"\s+"), lambda p: F.length(p) >= 3)
    return F.when(F.size(parts) > 0, parts).otherwise(F.filter(F.array(F.trim(term)), lambda p: F.length(p) >= 3))


def matches_all(fields: list[Column], parts: Column) -> Column:
    """Every part is in some field, ignoring case; nothing matches an empty list."""
    low = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    hit = lambda p: F.array_max(F.array(*(F.contains(f, F.lower(p)) for f in low)))
    return (F.size(parts) > 0) & F.forall(parts, hit)


def matches_any(fields: list[Column], parts: Column) -> Column:
    low = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    return F.exists(parts, lambda p: F.array_max(F.array(*(F.contains(f, F.lower(p)) for f in low))))


def contains_term(field: Column, term: str) -> Column:
    """Substring search that ignores case; wildcards have no meaning."""
    return F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lit(term.lower()))


# Status -------------------------------------------------------------------------------------


def status(confidence: Column, state: Column, decided_by: Column, origin: Column, has_value: Column) -> Column:
    """Any human trace is confirmed; high and medium confidence is inferred, low is weak, no value unknown."""
    human = (state.isin("confirmed", "approved", "edited")) | (decided_by == "user") | (origin == "user")
    return (
        F.when(F.coalesce(human, F.lit(False)), "confirmed")
        .when(~F.coalesce(has_value, F.lit(False)), "unknown")
        .when(confidence.isin("high", "medium"), "inferred")
        .otherwise("weak")
    )


def date_state(kind: Column) -> Column:
    return F.when(kind.isNull(), "unknown").when(kind == "user", "confirmed").when(kind == "fs", "weak").otherwise("inferred")


#: Step names by the first pattern that a file name holds.
STEP_LABELS = (("접수", "접수"), ("요구|요청", "자료 요청"), ("취합", "취합"), ("검토", "검토"), ("결재|결제", "결재"), ("제출", "제출"), ("송부", "송부"), ("질의|답변", "질의응답 대응"), ("회의", "회의"), ("계획", "계획 수립"), ("통계", "통계 작성"), ("현황", "현황 정리"), ("계약", "계약"), ("보고", "보고"))
OTHER_STEP = "문서 처리"


def step_label(filename: Column) -> Column:
    out = None
    for pattern, label in STEP_LABELS:
        out = (F.when if out is None else out.when)(filename.rlike(pattern), label)
    return out.otherwise(OTHER_STEP)
