"""Access policy rules as column expressions over fixed rule tables."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from assayer import fixed_values as fv


def lookup(table: Mapping, key: Column) -> Column:
    """Value of a small constant table; null for an unknown key."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def normalise_sensitivity(value: Column) -> Column:
    name = F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "- ", "__")
    return F.when(name.isin(*fv.SENSITIVITY_RULES), name).otherwise("internal")


def sensitivity(category: Column, redacted_cells: Column) -> Column:
    """Sensitivity of an upload bin, lifted to 'sensitive' by any redaction
    unless it is a special category."""
    base = F.coalesce(lookup(fv.CATEGORY_SENSITIVITY, F.lower(F.trim(F.coalesce(category, F.lit(""))))), F.lit("internal"))
    found = F.coalesce(redacted_cells, F.lit(0)) > 0
    return F.when(found & (base != "special_category"), "sensitive").otherwise(base)


def least_plan(level: Column) -> Column:
    return lookup({k: plan for k, (plan, _) in fv.SENSITIVITY_RULES.items()}, level)


def kyb_needed(level: Column) -> Column:
    return lookup({k: kyb for k, (_, kyb) in fv.SENSITIVITY_RULES.items()}, level)


def plan_rank(plan: Column) -> Column:
    return F.coalesce(lookup(fv.PLAN_RANK, plan), F.lit(0))


def access_policy(category: Column, redacted_cells: Column) -> Column:
    level = sensitivity(category, redacted_cells)
    return F.struct(
        level.alias("sensitivity"), least_plan(level).alias("min_plan"), kyb_needed(level).alias("kyb_required"),
        F.array(*[F.lit(u) for u in fv.PERMITTED_USES]).alias("permitted_uses"),
        F.array(*[F.lit(u) for u in fv.PROHIBITED_USES]).alias("prohibited_uses"),
    )


def listing_decision(level: Column) -> Column:
    return F.when(level.isin("sensitive", "special_category"), "needs_review").otherwise("listable")


def is_admin(user_id: Column, username: Column, admin_ids: Sequence[str] = (), admin_names: Sequence[str] = ()) -> Column:
    """Admin by exact id or by name in any case and without outer blanks."""
    name = F.lower(F.trim(username))
    hits = [user_id.eqNullSafe(i) for i in admin_ids] + [name.eqNullSafe(n.strip().lower()) for n in admin_names]
    return reduce(Column.__or__, hits, F.lit(False))
