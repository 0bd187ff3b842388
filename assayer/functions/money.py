"""Ask prices."""

from pyspark.sql import Column, functions as F

from assayer.functions.numeric import half_even
from assayer.functions.text import strip

NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def parse_price(raw: Column) -> Column:
    """Number rounded to two places; null when blank or unreadable."""
    text = strip(raw.cast("string"))
    return half_even(F.when(text.rlike(NUMBER), text.try_cast("double")), 2)


def normalise_price(raw: Column) -> Column:
    """Price as decimal(18,2); blank, unreadable or negative gives null."""
    price = parse_price(raw)
    return F.when(price >= 0, price.try_cast("decimal(18,2)"))


def price_problem(raw: Column) -> Column:
    """Reason a declared price is refused, null when it is fine or absent."""
    text = strip(raw.cast("string"))
    price = parse_price(raw)
    return (
        F.when(raw.isNull() | (text == ""), F.lit(None).cast("string"))
        .when(price.isNull(), "invalid_ask_price")
        .when(price < 0, "negative_ask_price")
    )
