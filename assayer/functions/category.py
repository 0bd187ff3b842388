"""Keyword categorisation, tags and type match."""

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from assayer import fixed_values as fv
from assayer.functions.text import WORD

LOWERED = "__lowered"


@cache
def category_rule(whole_word: bool = False) -> str:
    """Expression over the lower-cased text: struct(hits, rank, name) of the best
    category; most distinct keywords found, the first category on ties.

    Kept as text, since it has close to a hundred terms and is parsed in one go.
    """
    def found(keyword: str) -> str:
        if whole_word:
            return f"rlike({LOWERED}, r'(?<!{WORD}){keyword}(?!{WORD})')"
        return f"contains({LOWERED}, '{keyword}')"

    ranked = [
        f"named_struct('hits', {' + '.join(f'CAST({found(k)} AS INT)' for k in keywords)}, 'rank', {-i}, 'name', '{name}')"
        for i, (name, keywords) in enumerate(fv.CATEGORY_KEYWORDS.items())
    ]
    return f"array_max(array({', '.join(ranked)}))"


def with_category(df: DataFrame, text: Column, out: str = "category", whole_word: bool = False) -> DataFrame:
    """Add struct ``out`` (category, confidence) by the keywords found in ``text``.

    Keywords match inside words unless ``whole_word`` is set.
    """
    none, one, two, more = fv.CATEGORY_CONFIDENCE
    best = df.withColumn(LOWERED, F.lower(F.coalesce(text, F.lit("")))).withColumn("__best", F.expr(category_rule(whole_word)))
    verdict = F.expr(
        f"named_struct('category', if(__best.hits > 0, __best.name, '{fv.DEFAULT_CATEGORY}'), 'confidence', "
        f"CASE WHEN __best.hits >= 3 THEN {more}D WHEN __best.hits = 2 THEN {two}D WHEN __best.hits = 1 THEN {one}D ELSE {none}D END)"
    )
    return best.withColumn(out, verdict).drop(LOWERED, "__best")


def tags(category: Column, score: Column) -> Column:
    """Category slug plus a readiness tag."""
    readiness = F.when(score >= 90, "production-ready").when(score >= 75, "high-quality").otherwise("needs-cleaning")
    return F.array(F.translate(F.lower(category), "/", "-"), readiness)


def type_match(selected: Column, detected: Column) -> Column:
    """Whether the declared type equals the detected one; null when nothing was detected."""
    return F.when(detected.isNull(), F.lit(None).cast("boolean")).otherwise(selected.eqNullSafe(detected))
