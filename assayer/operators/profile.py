"""Profiling of whole tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer import fixed_values as fv
from assayer.functions.keys import missing, row_key, value_text
from assayer.functions.numeric import half_even
from assayer.functions.ordered import with_running_sums

# Spark type -> (dtype, inferred kind) as data frames report them.
DTYPE_NAMES = {
    "byte": ("int8", "integer"), "short": ("int16", "integer"),
    "integer": ("int32", "integer"), "long": ("int64", "integer"),
    "float": ("float32", "floating"), "double": ("float64", "floating"),
    "boolean": ("bool", "boolean"), "string": ("object", "string"),
    "timestamp": ("datetime64[ns]", "datetime64"),
    "timestamp_ntz": ("datetime64[ns]", "datetime64"),
    "date": ("object", "date"), "binary": ("object", "bytes"),
}

DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX",
)


def _fields(df: DataFrame, *kinds) -> list[T.StructField]:
    return [f for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; booleans count as numeric."""
    return [f.name for f in _fields(df, T.NumericType, T.BooleanType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in _fields(df, T.StringType)]


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def align_columns(df: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Project both tables to their shared columns, sorted by name; without any,
    the comparison is dropped."""
    df, other = trim_headers(df), trim_headers(other)
    shared = sorted(set(df.columns) & set(other.columns))
    if not shared:
        return df, None
    return df.select(*shared), other.select(*shared)


def valid_roles(df: DataFrame, **roles: str | None) -> tuple[dict[str, str | None], list[str]]:
    """Keep role columns that exist; name the others in warnings."""
    kept, warnings = {}, []
    for role, column in roles.items():
        if column and column not in df.columns:
            warnings.append(f"{role}={column} not found; its checks are skipped.")
            column = None
        kept[role] = column
    return kept, warnings


def parse_date(text: Column) -> Column:
    """Timestamp by the first fitting format, else null. Only text that looks
    like a date is parsed: a failing parse is slow."""
    shaped = text.rlike(r"\A\d{2,4}[-/]\d{2}[-/]\d{2,4}")
    return F.when(shaped, F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]))


def coerce_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn string columns into timestamps; unreadable values become null."""
    known = dict(df.dtypes)
    return df.withColumns({c: parse_date(F.col(f"`{c}`")) for c in columns if known.get(c) == "string"})


def table_stats(df: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row: rows, columns, missing cells and share, duplicate rows.

    One scan and one shuffle: the distinct rows are grouped by narrow keys after
    partial aggregation, so many copies of a row cost nothing downstream.
    ``extra`` aggregates ride along in the same pass.
    """
    nulls = [missing(f).cast("int") for f in df.schema.fields]
    per_row = nulls[0]
    for flag in nulls[1:]:
        per_row = per_row + flag
    width = len(df.columns)
    stats = df.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(per_row), F.lit(0)).alias("missing_cells"),
        F.count_distinct(row_key(df)).alias("__distinct"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    cells = F.col("row_count") * width
    pct = F.when(cells > 0, F.col("missing_cells") / cells * 100).otherwise(0.0)
    return stats.select(
        "row_count",
        F.lit(width).cast("long").alias("column_count"),
        "missing_cells",
        half_even(pct, 2).alias("missing_percentage"),
        (F.col("row_count") - F.col("__distinct")).alias("duplicate_rows"),
        pct.alias("missing_pct_exact"),
        *(extra or {}),
    )


def unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value as text key) rows."""
    fields = {f.name: f for f in df.schema.fields}
    texts = df.select(*[value_text(fields[c]).alias(c) for c in columns])
    return texts.unpivot([], list(columns), "column", "value")


def _type_frame(df: DataFrame, profile: DataFrame) -> DataFrame:
    names = {f.name: DTYPE_NAMES.get(f.dataType.typeName(), ("object", f.dataType.typeName())) for f in df.schema.fields}
    position = {c: i for i, c in enumerate(df.columns)}

    def pick(values) -> Column:
        pairs = [F.lit(x) for c, v in values.items() for x in (c, v)]
        return F.create_map(*pairs)[F.col("column")]

    return profile.withColumns(
        {
            "position": pick(position),
            "dtype": pick({c: n[0] for c, n in names.items()}),
            "inferred": pick({c: n[1] for c, n in names.items()}),
        }
    )


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: dtype, inferred kind, missing share, number of distinct values.

    Exact counts shuffle distinct (column, value) pairs. ``approx`` estimates
    them in one scan without that shuffle.
    """
    if approx:
        fields = df.schema.fields
        wide = df.agg(
            F.count("*").alias("n"),
            *[F.count_if(missing(f)).alias(f"m{i}") for i, f in enumerate(fields)],
            *[F.approx_count_distinct(value_text(f)).alias(f"d{i}") for i, f in enumerate(fields)],
        )
        rows = [
            F.struct(
                F.lit(f.name).alias("column"), F.col("n").alias("rows"),
                (F.col("n") - F.col(f"m{i}")).alias("filled"), F.col(f"d{i}").alias("cardinality"),
            )
            for i, f in enumerate(fields)
        ]
        long = wide.select(F.inline(F.array(*rows)))
    else:
        long = (
            unpivot(df, df.columns)
            .groupBy("column")
            .agg(
                F.count("*").alias("rows"), F.count("value").alias("filled"),
                F.count_distinct("value").alias("cardinality"),
            )
        )
    return _type_frame(df, long).select(
        "position", "column", "dtype", "inferred",
        ((F.col("rows") - F.col("filled")) * 100.0 / F.col("rows")).alias("missing_pct"),
        "cardinality",
    )


def column_roles(df: DataFrame) -> DataFrame:
    """String columns with their role: datetime, categorical, text or other."""
    columns = string_columns(df)
    long = df.select(*[F.col(f"`{c}`").alias(c) for c in columns]).unpivot([], columns, "column", "raw")
    from assayer.functions.keys import narrow_text

    few, many = fv.CATEGORICAL_CARDINALITY
    mean_length, distinct_share = fv.FREE_TEXT_LIMITS
    stats = long.groupBy("column").agg(
        F.count("raw").alias("filled"),
        F.count_distinct(narrow_text(F.col("raw"))).alias("cardinality"),
        F.avg(F.length("raw")).alias("mean_length"),
        F.coalesce(F.bool_and(F.when(F.col("raw").isNotNull(), parse_date(F.col("raw")).isNotNull())), F.lit(False)).alias("dates"),
    )
    share = F.col("cardinality") / F.greatest(F.lit(1), F.col("filled"))
    role = (
        F.when(F.col("dates"), "datetime")
        .when(F.col("cardinality").between(few, many), "categorical")
        .when((F.col("mean_length") > mean_length) & (share > distinct_share), "text")
        .otherwise("other")
    )
    return stats.select("column", "filled", "cardinality", "mean_length", share.alias("distinct_share"), role.alias("role"))


def sample_rows(df: DataFrame, key: str, n: int = fv.SAMPLE_ROWS, seed: int = fv.SAMPLE_SEED) -> DataFrame:
    """Exactly ``n`` rows, chosen by the digest of seed and key; repeatable.

    Counting a digest prefix first finds how far the sample reaches, so only
    about ``n`` rows get to the final top-n and not ``n`` per task.
    """
    keyed = df.withColumn("__digest", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))))
    prefix = F.substring("__digest", 1, 5)
    sizes = keyed.groupBy(prefix.alias("__prefix")).agg(F.count("*").alias("rows"))
    reach = with_running_sums(sizes, [], ["__prefix"], {"seen": F.col("rows")})
    last = reach.filter(F.col("seen") >= n).agg(F.min("__prefix").alias("p"))
    near = keyed.filter(prefix <= F.coalesce(last.scalar(), F.lit("fffff")))
    return near.orderBy("__digest", key).limit(n).drop("__digest")


def category_entropy(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Shannon entropy in bits of the value distribution of each column."""
    columns = list(columns or string_columns(df))
    counts = unpivot(df, columns).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    total = F.sum(n)
    return counts.groupBy("column").agg((F.log2(total) - F.sum(n * F.log2(n)) / total).alias("entropy"))


def mean_entropy(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return category_entropy(df, columns).agg(F.avg("entropy").alias("mean_entropy"))


def preview(df: DataFrame, order: Sequence, n: int = 5) -> DataFrame:
    """First rows as text, null as ''."""
    top = df.orderBy(*order).limit(n)
    return top.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
