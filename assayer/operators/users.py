"""User registration, updates and projections, in batches."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer import fixed_values as fv
from assayer.functions.text import strip
from assayer.operators.catalog import latest
from assayer.session import durable

PUBLIC_COLUMNS = ("id", "username", "email", "plan", "kyb_status", "restricted")


def normal_plan(plan: Column) -> Column:
    name = F.lower(strip(F.coalesce(plan, F.lit("free"))))
    return F.when(name.isin(*fv.PLAN_RANK), name).otherwise("free")


def public_view(users: DataFrame) -> DataFrame:
    """Public columns with defaults; oldest account first."""
    filled = users.withColumns(
        {
            "plan": F.coalesce(F.when(F.col("plan") != "", F.col("plan")), F.lit("free")),
            "kyb_status": F.coalesce(F.when(F.col("kyb_status") != "", F.col("kyb_status")), F.lit("pending")),
            "restricted": F.coalesce("restricted", F.lit(False)),
        }
    )
    order = ["created_at", "id"] if "created_at" in users.columns else ["id"]
    return filled.orderBy(*order).select(*PUBLIC_COLUMNS)


def _won(requests: DataFrame) -> DataFrame:
    """Open requests with ``__wins``: accepted whatever becomes of the others.

    A request that is first for its name and its e-mail wins. One with a single
    earlier rival wins if that rival does not, so along a chain of such requests
    the outcome alternates from its end; pointers to the rival are doubled, which
    takes a logarithmic number of steps for a chain of any length.
    """
    ranked = requests
    for field in ("username", "email"):
        first = ranked.groupBy(field).agg(F.min("__at").alias(f"__1_{field}"))
        ranked = ranked.join(first, field)
        second = ranked.groupBy(field).agg(F.min(F.when(F.col("__at") > F.col(f"__1_{field}"), F.col("__at"))).alias(f"__2_{field}"))
        ranked = ranked.join(second, field)
    own = {(n, field): F.col("__at").eqNullSafe(F.col(f"__{n}_{field}")) for n in (1, 2) for field in ("username", "email")}
    rival = (
        F.when(own[1, "username"] & own[2, "email"], F.col("__1_email")).when(own[2, "username"] & own[1, "email"], F.col("__1_username"))
        .when(own[2, "username"] & own[2, "email"] & (F.col("__1_username") == F.col("__1_email")), F.col("__1_username"))
    )
    ranked = durable(ranked.withColumns({"__wins": own[1, "username"] & own[1, "email"], "__rival": rival}).select(*requests.columns, "__wins", "__rival"))
    links = ranked.where("__rival IS NOT NULL").select("__at", F.col("__rival").alias("end"), F.lit(True).alias("odd"))
    while True:
        onward = links.select(F.col("__at").alias("end"), F.col("end").alias("beyond"), F.col("odd").alias("flip"))
        longer = durable(links.join(onward, "end", "left"))
        if longer.where("beyond IS NOT NULL").isEmpty():
            break
        links = longer.select("__at", F.coalesce("beyond", "end").alias("end"), (F.col("odd") != F.coalesce("flip", F.lit(False))).alias("odd"))
    sure = ranked.where("__wins").select(F.col("__at").alias("end"))
    through = links.where("NOT odd").join(sure, "end", "left_semi").select("__at", F.lit(True).alias("__through"))
    return ranked.drop("__rival").join(through, "__at", "left").withColumn("__wins", F.col("__wins") | F.col("__through").isNotNull()).drop("__through")


def register(requests: DataFrame, users: DataFrame, order: Sequence[str]) -> DataFrame:
    """Registrations (id, username, email, plan) with ``reason``, null when accepted.

    Requests count in ``order``: a name or e-mail belongs to the first request
    accepted with it, and a refused request blocks nobody. Requests that share
    neither are settled at once. The contested ones are settled in rounds: the
    earliest open request of both its name and its e-mail is accepted, and so is
    every request that the chain of single rivals behind it lets through; those that
    clash with an accepted one are refused, and the rest goes on.
    """
    clean = requests.withColumns(
        {
            "username": strip(F.coalesce("username", F.lit(""))),
            "email": F.lower(strip(F.coalesce("email", F.lit("")))),
            "plan": normal_plan(F.col("plan")),
            "__at": F.struct(*order),
        }
    )
    names = users.select("username", F.lit(True).alias("__name_used")).distinct()
    mails = users.select("email", F.lit(True).alias("__mail_used")).distinct()
    known = clean.join(names, "username", "left").join(mails, "email", "left")
    basic = (
        F.when(F.col("username") == "", "username_required")
        .when(F.col("email") == "", "email_required")
        .when(F.col("__name_used"), "username_exists")
        .when(F.col("__mail_used"), "email_exists")
    )
    judged = known.withColumn("reason", basic).drop("__name_used", "__mail_used")
    refused = judged.filter("reason IS NOT NULL")
    open_ones, accepted, clashed = judged.filter("reason IS NULL"), [], []
    while True:
        met = durable(_won(open_ones).select(*judged.columns, "__wins"))
        winners = met.filter("__wins").select(*judged.columns)
        rest = (
            met.filter(~F.col("__wins"))
            .join(winners.select("username", F.lit(True).alias("__n")), "username", "left")
            .join(winners.select("email", F.lit(True).alias("__m")), "email", "left")
            .withColumn("__out", F.coalesce("__n", "__m").isNotNull()).select(*judged.columns, "__out")
        )
        rest = durable(rest)
        accepted.append(winners)
        clashed.append(rest.filter("__out").select(*judged.columns))
        open_ones = rest.filter(~F.col("__out")).select(*judged.columns)
        if open_ones.isEmpty():
            break
    won, lost = reduce(DataFrame.unionByName, accepted), reduce(DataFrame.unionByName, clashed)
    # The name is looked at first, but only when its owner came earlier.
    owners = won.select("username", F.col("__at").alias("__owner_at"))
    why = F.when(F.col("__owner_at") < F.col("__at"), "username_exists").otherwise("email_exists")
    lost = lost.unionByName(refused.filter("reason = 'email_exists'"))
    lost = lost.join(owners, "username", "left").withColumn("reason", why).select(*judged.columns)
    return refused.filter("reason <> 'email_exists'").unionByName(won).unionByName(lost).drop("__at")


def accepted_users(registered: DataFrame, at: Column) -> DataFrame:
    return registered.filter("reason IS NULL").select(
        "id", "username", "email", "plan", F.lit("pending").alias("kyb_status"), F.lit(False).alias("restricted"),
        at.cast("timestamp").alias("created_at"), at.cast("timestamp").alias("updated_at"),
    )


def decide_field(users: DataFrame, requests: DataFrame, field: str, allowed: Sequence[str]) -> DataFrame:
    """Plan or KYB updates (user_id, value, ...) with ``reason``."""
    value = F.lower(strip(F.coalesce("value", F.lit(""))))
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("__known"))
    joined = requests.withColumn("value", value).join(known, "user_id", "left")
    reason = F.when(~F.col("value").isin(*allowed), f"invalid_{field}").when(F.col("__known").isNull(), "user_not_found")
    return joined.withColumn("reason", reason).drop("__known")


def apply_field(users: DataFrame, decided: DataFrame, field: str, order: Sequence[str]) -> DataFrame:
    newest = latest(decided.filter("reason IS NULL"), "user_id", order).select(F.col("user_id").alias("id"), F.col("value").alias("__v"))
    return users.join(newest, "id", "left").withColumn(field, F.coalesce("__v", field)).select(*users.columns)
