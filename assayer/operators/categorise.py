"""Domain categorisation of rows and datasets."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayer import fixed_values as fv
from assayer.functions.category import with_category
from assayer.functions.text import strip


def categorise_rows(df: DataFrame, text_column: str = "text", out: str = "category") -> DataFrame:
    """Label each row; a missing column, null or blank text gives the default."""
    if text_column not in df.columns or dict(df.dtypes)[text_column] != "string":
        return df.withColumn(out, F.lit(fv.DEFAULT_CATEGORY))
    text = F.col(f"`{text_column}`")
    label = F.when(strip(text) != "", F.col("__c.category")).otherwise(F.lit(fv.DEFAULT_CATEGORY))
    return with_category(df, text, "__c").withColumn(out, label).drop("__c")


def head_text(df: DataFrame, order: Sequence, n: int = 10, clean: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row: the cells of the first ``n`` rows as one text.

    ``clean`` is applied to those rows only.
    """
    ranks = [f"__o{i}" for i in range(len(order))]
    top = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(r) for o, r in zip(order, ranks)]).orderBy(*ranks).limit(n)
    shown = top if clean is None else clean(top)
    cells = F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    listed = shown.agg(F.sort_array(F.collect_list(F.struct(*ranks, cells.alias("cells")))).alias("rows"))
    return listed.select(F.array_join(F.transform("rows", lambda r: r["cells"]), " ").alias("head"))


def with_dataset_category(row: DataFrame, df: DataFrame, filename: str, order: Sequence, clean: Callable | None = None) -> DataFrame:
    """Add struct ``category`` to a one-row frame: from file name, headers and
    first rows of ``df``."""
    named = F.concat_ws(" ", F.lit(filename), F.lit(" ".join(df.columns)), F.col("__head"))
    head = head_text(df, order, clean=clean)
    return with_category(row.withColumn("__head", head.scalar()), named).drop("__head")


def categorise_dataset(df: DataFrame, filename: str, order: Sequence) -> DataFrame:
    return with_dataset_category(df.sparkSession.range(1), df, filename, order).select("category.*")


def categorise_filename(df: DataFrame, filename: str) -> DataFrame:
    """Category of files that are not read: by name and suffix."""
    name = F.col(filename)
    return with_category(df, F.concat_ws(" ", name, suffix_of(F.lower(name))), "__c").select("*", "__c.*").drop("__c")


def suffix_of(name: Column) -> Column:
    """Last suffix with its dot, '' without one; leading dots do not start a suffix."""
    return F.regexp_extract(F.regexp_extract(name, r"([^/]*)\z", 1), r"(?s)[^.].*(\.[^.]*)\z", 1)


def categorise_first_row(df: DataFrame, order: Sequence) -> DataFrame:
    """Category of the first row's text as proxy for the table."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    first = df.orderBy(*order).limit(1).select(row.alias("t"))
    out = first.agg(F.max("t").alias("t"))  # one row, also for an empty table
    return with_category(out, F.col("t"), "c").select("c.category")
