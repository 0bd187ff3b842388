"""Numeric column helpers."""

from pyspark.sql import Column, functions as F

from assayer import fixed_values as fv


def half_even(value: Column, digits: int) -> Column:
    """Round a double as Python does: by its exact binary value, ties to even.

    ``F.round`` works on the shortest decimal text instead, so 0.145 and 92.25
    come out differently. The comparison with the tie point is exact: the
    fraction is split in two so that both products fit a double.
    Meant for report-sized rows.
    """
    scale = f"{10 ** digits}D"
    rule = f"""v -> if(isnan(v), v, element_at(transform(array(named_struct(
        'whole', cast(floor(abs(v)) AS DOUBLE), 'frac', abs(v) - floor(abs(v)))), p -> element_at(transform(array(
        cast(floor(p.frac * {scale}) AS DOUBLE)), step -> element_at(transform(array(named_struct(
            'units', p.whole * {scale} + step,
            'above', (floor(p.frac * 67108864D) / 67108864D * (2 * {scale}) - (step * 2 + 1))
                     + (p.frac - floor(p.frac * 67108864D) / 67108864D) * (2 * {scale}))),
            u -> signum(v) * (u.units + CASE WHEN u.above > 0 THEN 1D WHEN u.above = 0 THEN u.units % 2 ELSE 0D END) / {scale}
        ), 1)), 1)), 1))"""
    return F.call_function("transform", F.array(value.cast("double")), F.expr(rule))[0]


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Limit to a range; null stays null."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def ladder(value: Column, rungs, otherwise) -> Column:
    """First rung whose lower bound the value reaches."""
    out = None
    for bound, label in rungs:
        cond = value >= bound
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def quality_tier(score: Column) -> Column:
    return ladder(score, fv.TIER_LADDER, fv.TIER_OTHERWISE)


def best_use(score: Column) -> Column:
    return ladder(score, fv.BEST_USE_LADDER, fv.BEST_USE_OTHERWISE)


def pass_gate(score: Column) -> Column:
    return F.when(score >= fv.PASS_SCORE, F.lit("passed")).otherwise(F.lit("needs_review"))


def dimension_status(score: Column) -> Column:
    return ladder(score, ((85.0, "PASS"), (60.0, "WARN")), "FAIL")


def share_status(pct: Column, limits) -> Column:
    """PASS / WARN / FAIL for a percentage against (warn, fail)."""
    warn, fail = limits
    return F.when(pct.isNull(), "SKIP").when(pct > fail, "FAIL").when(pct > warn, "WARN").otherwise("PASS")


def one_decimal(value: Column) -> Column:
    """Text with one decimal, rounded as Python formats it."""
    return F.format_string("%.1f", half_even(value, 1))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; null where one side does not vary."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)
