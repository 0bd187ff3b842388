"""Upload gate and access decisions, many requests per run."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayer import fixed_values as fv
from assayer.functions import policy
from assayer.functions.money import price_problem
from assayer.operators.catalog import empty_map

ACCESS_CODES = {
    "not_found": 404, "dataset_restricted": 423, "not_authorized": 403, "account_restricted": 423,
    "plan_too_low": 403, "kyb_required": 403, "purpose_not_permitted": 403,
}
ACCESS_MESSAGES = {
    "not_found": "Record not found", "dataset_restricted": "Dataset is restricted", "not_authorized": "Not authorized",
    "account_restricted": "Account is restricted", "plan_too_low": "Licence tier does not permit this dataset",
    "kyb_required": "KYB verification required", "purpose_not_permitted": "Purpose is not permitted for this dataset",
}


def intake_gate(intake: DataFrame, users: DataFrame) -> DataFrame:
    """First failing upload rule as ``reason``, null when accepted.

    ``intake`` has category, user_id, ask_price_usd (text) and bytes.
    """
    sellers = users.select(
        F.col("id").alias("user_id"), F.col("kyb_status").alias("__kyb"), F.col("restricted").alias("__locked"), F.lit(True).alias("__known")
    )
    joined = intake.join(sellers, "user_id", "left")
    trusted = F.col("__known").isNotNull() & ~F.coalesce("__locked", F.lit(False)) & (F.col("__kyb") == "verified")
    reason = (
        F.when(~F.coalesce(F.col("category").isin(*fv.UPLOAD_CATEGORIES), F.lit(False)), "invalid_category")
        .when(F.coalesce("user_id", F.lit("")) == "", "missing_user_id")
        .when(~F.coalesce(trusted, F.lit(False)), "seller_kyb_required")
        .otherwise(F.coalesce(price_problem(F.col("ask_price_usd")), F.when(F.coalesce("bytes", F.lit(0)) == 0, "empty_file")))
    )
    return joined.withColumn("reason", reason).drop("__kyb", "__locked", "__known")


def decide_access(
    requests: DataFrame, catalog: DataFrame, users: DataFrame, admin_ids: Sequence[str] = (), admin_names: Sequence[str] = ()
) -> DataFrame:
    """One decision per request (requester_id, file_hash, purpose).

    Two joins, on the dataset and on the requester. A requester or dataset that
    many requests name is a skewed key of the large side only: the other side
    holds one row per key, so AQE may broadcast it or split the hot partition.
    """
    extra = F.coalesce("extra", empty_map())
    rule = F.coalesce("access_policy", F.from_json(extra["access_policy"], catalog.schema["access_policy"].dataType))
    level = policy.normalise_sensitivity(rule["sensitivity"])
    datasets = catalog.select(
        "file_hash", F.lit(True).alias("__d"), F.col("restriction_status").alias("__lock"),
        F.coalesce(F.nullif("owner", F.lit("")), extra["owner_user_id"]).alias("__owner"),
        F.coalesce(F.when(rule["min_plan"] != "", rule["min_plan"]), policy.least_plan(level)).alias("__plan"),
        F.coalesce(rule["kyb_required"], policy.kyb_needed(level)).alias("__kyb"),
        F.coalesce(rule["permitted_uses"], F.array().cast("array<string>")).alias("__uses"),
    )
    people = users.select(
        F.col("id").alias("requester_id"), F.lit(True).alias("__u"), F.coalesce("plan", F.lit("free")).alias("__has_plan"),
        F.col("kyb_status").alias("__has_kyb"), F.coalesce("restricted", F.lit(False)).alias("__locked"),
        F.col("username").alias("__name"),
    )
    joined = requests.join(datasets, "file_hash", "left").join(people, "requester_id", "left")
    known = F.col("__u").isNotNull()
    purpose_ok = (
        (F.size("__uses") == 0) | F.array_contains(F.col("__uses"), F.col("purpose"))
        | F.col("purpose").isin(*fv.ALWAYS_PERMITTED_PURPOSES)
    )
    # A name sent along with the request is tested instead of the stored one.
    name = F.col("__name")
    if "requester_username" in requests.columns:
        name = F.coalesce(F.nullif("requester_username", F.lit("")), name)
    admin = policy.is_admin(F.col("requester_id"), name, admin_ids, admin_names)
    reason = (
        F.when(F.col("__d").isNull(), "not_found")
        .when(F.coalesce(F.col("__lock") != "active", F.lit(True)), "dataset_restricted")
        .when(~known, "not_authorized")
        .when(F.col("requester_id") == F.col("__owner"), F.lit(None))
        .when(F.col("__locked"), "account_restricted")
        .when(admin, F.lit(None))
        .when(policy.plan_rank(F.col("__has_plan")) < policy.plan_rank(F.col("__plan")), "plan_too_low")
        .when(F.col("__kyb") & ~(F.coalesce(F.col("__has_kyb") == "verified", F.lit(False))), "kyb_required")
        .when(~purpose_ok, "purpose_not_permitted")
    )
    return joined.select(
        *requests.columns, reason.isNull().alias("allowed"),
        F.coalesce(policy.lookup(ACCESS_CODES, reason), F.lit(200)).alias("code"), reason.alias("reason"),
    )


def access_log(decisions: DataFrame, at: Column, action: str = "DOWNLOAD_DATASET") -> DataFrame:
    """Audit rows of access decisions."""
    result = F.when(F.col("allowed"), "SUCCESS").when(F.col("reason") == "not_found", "NOT_FOUND").otherwise("DENIED")
    detail = F.create_map(F.lit("reason"), policy.lookup(ACCESS_MESSAGES, F.col("reason")))
    return decisions.select(
        F.when(F.col("reason") == "not_found", F.lit(None)).otherwise(F.col("requester_id")).alias("actor_id"),
        F.lit(action).alias("action"), F.col("file_hash").alias("resource"), "purpose", result.alias("result"),
        F.when(result == "DENIED", detail).otherwise(empty_map()).alias("metadata"), at.cast("timestamp").alias("created_at"),
    )
