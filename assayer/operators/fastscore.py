"""The fast quality path: profile, scrub, categorise, score and tag one table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayer import fixed_values as fv
from assayer.functions import numeric
from assayer.functions.category import tags, with_category
from assayer.functions.pii import redaction_status
from assayer.operators.categorise import suffix_of, with_dataset_category
from assayer.operators.profile import preview, string_columns, table_stats
from assayer.operators.redaction import redacted_cells, scrub_table
from assayer.session import spread


def score_columns(rows: Column, columns: Column, missing_pct: Column, duplicates: Column) -> dict[str, Column]:
    """Four dimensions rounded to one place, before the overall is built from them."""
    completeness = F.greatest(F.lit(0.0), F.lit(100.0) - F.least(missing_pct, F.lit(100.0)) * 1.6)
    uniqueness = F.greatest(F.lit(0.0), F.lit(100.0) - duplicates / F.greatest(rows, F.lit(1)) * 100.0)
    structure = F.when(columns >= 3, 100.0).when(columns == 2, 72.0).otherwise(55.0)
    volume = numeric.ladder(rows, ((100, 92.0), (10, 84.0), (2, 76.0)), 58.0)
    return {
        "Completeness": numeric.half_even(completeness, 1),
        "Uniqueness": numeric.half_even(uniqueness, 1),
        "Consistency": structure,
        "Representativeness": volume,
    }


def with_quality_score(stats: DataFrame) -> DataFrame:
    """Add dimension columns, ``quality_score`` and ``best_use_case`` to table stats."""
    parts = score_columns(
        F.col("row_count"), F.col("column_count"), F.col("missing_pct_exact"), F.col("duplicate_rows")
    )
    scored = stats.withColumns({name.lower(): col for name, col in parts.items()})
    overall = None
    for name, weight in fv.FAST_WEIGHTS.items():
        part = F.col(name.lower()) * weight
        overall = part if overall is None else overall + part
    scored = scored.withColumn("quality_score", numeric.half_even(overall, 1))
    return scored.withColumn("best_use_case", numeric.best_use(F.col("quality_score")))


def detail_lines(category: Column, score: Column, use: Column, parts: Sequence[tuple[str, Column]]) -> Column:
    """Ordered messages of a report."""
    return F.array(
        F.lit("PII scrubbed with deterministic fast path."),
        F.concat(F.lit("Categorized as "), category, F.lit(".")),
        F.concat(F.lit("Scored "), numeric.one_decimal(score), F.lit("/100.")),
        F.concat(F.lit("Best Use Case: "), use),
        *[F.concat(F.lit(f"{name}: "), numeric.one_decimal(value)) for name, value in parts],
    )


def assess(df: DataFrame, filename: str, order: Sequence) -> DataFrame:
    """One report row for a table.

    Counts, distinct rows and redactions come from one aggregate; the category
    needs the first ten rows in ``order``; only those are scrubbed for it.
    """
    columns = string_columns(df)
    df = spread(df, *order)
    stats = with_quality_score(table_stats(df, {"redacted_cells": redacted_cells(df)}))
    labelled = with_dataset_category(
        stats, df, filename, order, clean=lambda rows: scrub_table(rows, columns=columns)
    ).withColumnRenamed("category", "__c")
    parts = [(name, F.col(name.lower())) for name in fv.FAST_WEIGHTS]
    return labelled.select(
        F.lit(filename).alias("filename"),
        F.col("__c.category").alias("predicted_category"),
        F.col("__c.confidence").alias("confidence"),
        "quality_score",
        numeric.pass_gate(F.col("quality_score")).alias("status"),
        detail_lines(F.col("__c.category"), F.col("quality_score"), F.col("best_use_case"), parts).alias("details"),
        tags(F.col("__c.category"), F.col("quality_score")).alias("generated_tags"),
        "best_use_case",
        F.struct("row_count", "column_count", "missing_cells", "missing_percentage", "duplicate_rows").alias("stats"),
        "redacted_cells",
        redaction_status(F.col("redacted_cells")).alias("pii_status"),
    )


def assess_unread(files: DataFrame, filename: str = "filename", keep: Sequence[str] = ("filename",), suffix: bool = True) -> DataFrame:
    """Reports for files that are not tables: name and suffix give the category,
    the score is the default. ``keep`` columns are carried along; without
    ``suffix`` the name alone decides."""
    name = F.col(filename)
    score = F.lit(fv.UNREAD_SCORE)
    use = F.lit(fv.UNREAD_BEST_USE)
    text = F.concat_ws(" ", name, suffix_of(F.lower(name))) if suffix else name
    labelled = with_category(files, text, "__c")
    return labelled.select(
        *keep,
        F.col("__c.category").alias("predicted_category"),
        F.col("__c.confidence").alias("confidence"),
        score.alias("quality_score"),
        numeric.pass_gate(score).alias("status"),
        detail_lines(F.col("__c.category"), score, use, ()).alias("details"),
        tags(F.col("__c.category"), score).alias("generated_tags"),
        use.alias("best_use_case"),
        F.lit(0).cast("long").alias("redacted_cells"),
        F.lit(fv.PII_STATUS_CLEAN).alias("pii_status"),
    )


def clean_preview(df: DataFrame, order: Sequence, n: int = 5) -> DataFrame:
    """First rows of the scrubbed table; ordered by the values before the scrub."""
    columns = string_columns(df)
    return scrub_table(preview(df, order, n), columns=columns)
