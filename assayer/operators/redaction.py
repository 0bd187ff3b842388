"""Redaction over tables and nested records."""

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer import fixed_values as fv
from assayer.functions import pii
from assayer.functions.literal import literal_table
from assayer.operators.profile import string_columns


def scrub_table(df: DataFrame, labels: Sequence[str] = pii.ALL_LABELS, columns: Sequence[str] | None = None) -> DataFrame:
    """Scrub string columns; null becomes ''."""
    columns = string_columns(df) if columns is None else columns
    return df.withColumns({c: pii.scrub(F.coalesce(F.col(f"`{c}`"), F.lit("")), labels) for c in columns})


def redacted_cells(df: DataFrame, labels: Sequence[str] = pii.ALL_LABELS) -> Column:
    """Aggregate: cells of string columns that the scrub changes."""
    total = F.lit(0)
    for c in string_columns(df):
        source = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        total = total + (pii.scrub(source, labels) != source).cast("int")
    return F.coalesce(F.sum(total), F.lit(0)).cast("long")


def redaction_report(df: DataFrame, labels: Sequence[str] = pii.ALL_LABELS) -> DataFrame:
    counted = df.agg(redacted_cells(df, labels).alias("redacted_cells"))
    return counted.withColumn("status", pii.redaction_status(F.col("redacted_cells")))


def pattern_hits(df: DataFrame, column: str) -> DataFrame:
    """Documents with at least one match, per pattern, on the original text."""
    text = F.col(column)
    return df.agg(*[F.count_if(pii.has_match(text, p)).alias(p.lower()) for p in pii.FOUR_LABELS])


def _scrub_value(value: Column, kind: T.DataType, scrub: Callable[[Column], Column]) -> Column:
    if isinstance(kind, T.StringType):
        return scrub(value)
    if isinstance(kind, T.StructType):
        rebuilt = F.struct(*[_scrub_value(value[f.name], f.dataType, scrub).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: _scrub_value(v, kind.valueType, scrub))
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.ArrayType):
        return F.transform(value, lambda v: _scrub_value(v, kind.elementType, scrub))
    return value  # other types, and lists inside lists, stay as they are


def scrub_nested(df: DataFrame, labels: Sequence[str] = pii.FOUR_LABELS) -> DataFrame:
    """Scrub strings at any depth of structs, maps and lists; null stays null."""

    def scrub(value: Column) -> Column:
        return pii.scrub(value, labels)

    return df.select(*[_scrub_value(F.col(f"`{f.name}`"), f.dataType, scrub).alias(f.name) for f in df.schema.fields])


def mask_entities(df: DataFrame, column: str, find: Callable[[str], list[tuple[int, int, str]]]) -> DataFrame:
    """Mask spans found by a caller's model: ``find(text)`` gives (start, end, label).

    The model runs on Arrow batches inside the tasks.
    """
    def mask(text: str | None) -> str | None:
        if not text:
            return text
        for start, end, label in sorted(find(text), reverse=True):
            text = f"{text[:start]}[{label}_REDACTED]{text[end:]}"
        return text

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            batch[column] = batch[column].map(mask)
            yield batch

    return df.mapInPandas(run, df.schema)


def name_hints(df: DataFrame) -> DataFrame:
    """(column, hint) for headers that contain a personal-data word."""
    rows = [(c, h) for c in df.columns for h in fv.PII_NAME_HINTS if h in c.lower()]
    if not rows:
        return literal_table(df.sparkSession, ["column", "hint"], [("", "")]).limit(0)
    return literal_table(df.sparkSession, ["column", "hint"], rows)
