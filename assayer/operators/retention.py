"""Retention stamps, due lists, sweeps and restriction."""

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.times import instant, iso_utc
from assayer.operators.catalog import merge_maps, owner_id, retention_policy

EXPIRED = "retention_expired"


def stamp(days: int, as_of: Column) -> tuple[Column, Column]:
    """(policy, expiry time)."""
    return retention_policy(as_of, days), instant(as_of) + F.make_dt_interval(F.lit(days))


def due_records(catalog: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Active records past their expiry, oldest first, ties by hash."""
    due = catalog.filter(
        F.col("retention_expires_at").isNotNull()
        & (instant(F.col("retention_expires_at")) <= instant(as_of))
        & (F.col("restriction_status") == "active")
    ).orderBy("retention_expires_at", "file_hash")
    return due.limit(limit) if limit else due


def sweep_items(catalog: DataFrame, as_of: Column, dry_run: bool = True, limit: int | None = None, delete_objects: bool = False) -> DataFrame:
    """What a sweep does, one row per due record; objects to delete are listed,
    not deleted here."""
    return due_records(catalog, as_of, limit).select(
        "file_hash", "filename", iso_utc(F.col("retention_expires_at")).alias("retention_expires_at"),
        F.lit(dry_run).alias("dry_run"), F.lit("would_restrict" if dry_run else "restricted").alias("action"),
        (F.lit(delete_objects and not dry_run) & (F.coalesce("object_key", F.lit("")) != "")).alias("object_deleted"),
        "object_key",
    )


def sweep_summary(catalog: DataFrame, as_of: Column, dry_run: bool = True, limit: int | None = None) -> DataFrame:
    """One row for a sweep: whether it only looks, when it was, how many are due."""
    return due_records(catalog, as_of, limit).agg(
        F.lit(True).alias("ok"), F.lit(dry_run).alias("dry_run"), iso_utc(as_of).alias("processed_at"), F.count("*").alias("due_count")
    )


def apply_sweep(catalog: DataFrame, as_of: Column, limit: int | None = None, delete_objects: bool = False) -> DataFrame:
    """Catalogue after an executed sweep.

    Without a limit the due test is a plain condition on each row; with one the
    chosen hashes are joined.
    """
    evidence = F.create_map(
        F.lit("retention"),
        F.to_json(F.struct(
            F.lit(EXPIRED).alias("action"), iso_utc(as_of).alias("processed_at"),
            iso_utc(F.col("retention_expires_at")).alias("retention_expires_at"),
            F.lit(delete_objects).alias("object_deletion_enabled"),
        )),
    )
    notes = F.create_map(F.lit("restriction_status"), F.lit(EXPIRED), F.lit("retention_last_action_at"), iso_utc(as_of))
    if limit:
        chosen = due_records(catalog, as_of, limit).select("file_hash", F.lit(True).alias("__due"))
        marked = catalog.join(chosen, "file_hash", "left").withColumn("__due", F.coalesce("__due", F.lit(False)))
    else:
        due = (F.col("restriction_status") == "active") & (instant(F.col("retention_expires_at")) <= instant(as_of))
        marked = catalog.withColumn("__due", F.coalesce(due, F.lit(False)))
    hit = F.col("__due")
    return marked.withColumns(
        {
            "compliance_evidence": F.when(hit, merge_maps(F.col("compliance_evidence"), evidence)).otherwise(F.col("compliance_evidence")),
            "extra": F.when(hit, merge_maps(F.col("extra"), notes)).otherwise(F.col("extra")),
            "restriction_status": F.when(hit, EXPIRED).otherwise(F.col("restriction_status")),
        }
    ).select(*catalog.columns)


def restrict_users(users: DataFrame, catalog: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set or lift processing restrictions: (user_id, restricted, reason), one per
    user. Lifting sets owned datasets active, whatever their status was."""
    asked = requests.select("user_id", F.col("restricted").alias("__flag"), F.col("reason").alias("__why"))
    people = users.join(asked.withColumnRenamed("user_id", "id"), "id", "left")
    next_users = people.withColumn("restricted", F.coalesce("__flag", "restricted")).select(*users.columns)
    known = asked.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    owned = catalog.withColumn("__owner", owner_id()).join(known.withColumnRenamed("user_id", "__owner"), "__owner", "left")
    status = F.when(F.col("__flag"), "restricted").otherwise("active")
    evidence = F.create_map(
        F.lit("restriction_request"), F.to_json(F.struct(F.col("__flag").alias("restricted"), F.col("__why").alias("reason")))
    )
    hit = F.col("__flag").isNotNull()
    next_catalog = owned.withColumns(
        {
            "restriction_status": F.when(hit, status).otherwise(F.col("restriction_status")),
            "compliance_evidence": F.when(hit, merge_maps(F.col("compliance_evidence"), evidence)).otherwise(F.col("compliance_evidence")),
            "extra": F.when(hit, merge_maps(F.col("extra"), F.create_map(F.lit("restriction_status"), status))).otherwise(F.col("extra")),
        }
    ).select(*catalog.columns)
    return next_users, next_catalog


def restriction_decisions(users: DataFrame, catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of restriction requests (user_id, requester_id, restricted, reason),
    which only the user may make: result, HTTP code, the number of datasets that
    follow, their status, and the metadata of the audit event.

    ``accepted_restrictions`` keeps what ``restrict_users`` may apply.
    """
    owned = catalog.select(owner_id().alias("user_id")).groupBy("user_id").agg(F.count("*").alias("__n"))
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("__known"))
    joined = requests.join(known, "user_id", "left").join(owned, "user_id", "left")
    own = F.coalesce(F.nullif("requester_id", F.lit("")) == F.col("user_id"), F.lit(False))
    result = F.when(~own, "DENIED").when(F.col("__known").isNull(), "NOT_FOUND").otherwise("SUCCESS")
    done = result == "SUCCESS"
    count = F.when(done, F.coalesce("__n", F.lit(0)))
    metadata = F.when(result == "DENIED", F.create_map(F.lit("reason"), F.lit("not_owner"))).when(
        done, F.create_map(F.lit("restricted"), F.col("restricted").cast("string"), F.lit("dataset_count"), count.cast("string"), F.lit("reason"), F.col("reason"))
    ).otherwise(F.create_map(F.lit("reason"), F.lit("User not found")))
    return joined.select(
        "user_id", "requester_id", "restricted", "reason", result.alias("result"), F.when(done, 200).when(result == "DENIED", 403).otherwise(404).alias("code"),
        count.alias("dataset_count"), F.when(done, F.when(F.col("restricted"), "restricted").otherwise("active")).alias("restriction_status"), metadata.alias("metadata"),
    )


def accepted_restrictions(decisions: DataFrame) -> DataFrame:
    return decisions.filter("result = 'SUCCESS'").select("user_id", "restricted", "reason")


def restriction_log(decisions: DataFrame, at: Column) -> DataFrame:
    """Audit events of restriction requests; a denied one is the requester's."""
    actor = F.when(F.col("result") == "DENIED", F.col("requester_id")).otherwise(F.col("user_id"))
    return decisions.select(
        F.lit("RESTRICT_USER_PROCESSING").alias("action"), actor.alias("actor_id"), F.col("user_id").alias("resource"),
        F.lit("data_subject_restriction_request").alias("purpose"), "result", "metadata", at.alias("created_at"),
    )
