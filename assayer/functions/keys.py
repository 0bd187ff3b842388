"""Row and value identity that stays narrow when it is shuffled."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

LONG_VALUE = 64  # characters


def missing(field: T.StructField) -> Column:
    """Null, or not-a-number in a floating column."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def narrow_text(text: Column) -> Column:
    """Text as a grouping key: itself up to 64 characters, else a marked SHA-256.

    A digest key has 65 characters, so it never equals a text kept as it is.
    """
    return F.when(F.length(text) > LONG_VALUE, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def value_key(field: T.StructField) -> Column:
    """A column as a grouping key; missing values become one null."""
    col = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(col), F.lit(None)).otherwise(col)
    if isinstance(kind, T.StringType):
        return narrow_text(col)
    if isinstance(kind, T.BinaryType):
        return F.sha2(col, 256)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return narrow_text(F.to_json(F.struct(col.alias("v"))))
    return col


def row_key(df: DataFrame) -> Column:
    """The whole row as one grouping key, null equal to null."""
    return F.struct(*[value_key(f).alias(f"k{i}") for i, f in enumerate(df.schema.fields)])


def value_text(field: T.StructField) -> Column:
    """A column as text key, for unpivoting columns of mixed types."""
    key = value_key(field)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        key = key + F.lit(0.0).cast(field.dataType)  # -0.0 counts as 0.0
    return key.cast("string")
