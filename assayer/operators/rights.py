"""Subject export and erasure for many users per run."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.times import micros
from assayer.operators.catalog import owner_id, owner_in_extra

REVIEW_COLUMNS = ("id", "review_text", "rating", "status", "created_at", "updated_at")
#: Never part of an export.
PRIVATE_COLUMNS = ("password", "password_hash", "hashed_password")
EXPORT_COLUMNS = ("section", "id", "filename", "category", "status", "restriction_status", "plan", "kyb_status")


def export_sections(subjects: DataFrame, users: DataFrame, catalog: DataFrame, reviews: DataFrame) -> DataFrame:
    """Flat export: user, dataset and review rows of each subject (user_id)."""
    known = subjects.select("user_id").join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    people = users.withColumnRenamed("id", "user_id").join(known, "user_id", "left_semi").select(
        "user_id", F.lit("user").alias("section"), F.col("user_id").alias("id"), "plan", "kyb_status",
        F.when(F.col("restricted"), "restricted").otherwise("active").alias("restriction_status"),
    )
    owned = catalog.withColumn("user_id", owner_id()).join(known, "user_id", "left_semi").select(
        "user_id", F.lit("dataset").alias("section"), F.col("file_hash").alias("id"), "filename", "category", "status", "restriction_status"
    )
    said = reviews.join(known, "user_id", "left_semi").select("user_id", F.lit("review").alias("section"), "id", "status")
    return people.unionByName(owned, allowMissingColumns=True).unionByName(said, allowMissingColumns=True).select("user_id", *EXPORT_COLUMNS)


def export_documents(subjects: DataFrame, users: DataFrame, catalog: DataFrame, reviews: DataFrame, parts: int = 16) -> DataFrame:
    """(user_id, n_datasets, document): all data of a known subject as one JSON text
    with ``user``, ``datasets`` (whole records, newest first) and ``review`` (null if
    there is none).

    A subject's records are put in order in ``parts`` salted lists first, which are
    then merged, so records of a busy owner are gathered by several tasks; the
    document itself is one value by its nature.
    """
    known = subjects.select("user_id").distinct().join(users.withColumnRenamed("id", "user_id"), "user_id")
    people = known.select("user_id", _shaped(users, {"id": F.col("user_id")}).alias("user"))
    record = F.struct((-micros(F.col("timestamp"))).alias("age"), "file_hash", _shaped(catalog).alias("record"))
    owned = catalog.withColumn("user_id", owner_id()).join(known.select("user_id"), "user_id", "left_semi")
    owned = owned.select("user_id", F.pmod(F.xxhash64("file_hash"), F.lit(parts)).alias("salt"), record.alias("r"))
    # a list of records is ordered by age and hash before and after the merge
    lists = owned.groupBy("user_id", "salt").agg(_ordered(F.collect_list("r")).alias("l"))
    datasets = lists.groupBy("user_id").agg(_ordered(F.flatten(F.collect_list("l"))).alias("l"))
    datasets = datasets.select("user_id", F.transform("l", lambda r: r["record"]).alias("datasets"))
    said = reviews.join(known.select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.max_by(F.struct(*REVIEW_COLUMNS), F.struct("updated_at", "id")).alias("review"))
    whole = people.join(datasets, "user_id", "left").join(said, "user_id", "left")
    kind = datasets.schema["datasets"].dataType
    listed = F.coalesce("datasets", F.array().cast(kind))
    document = F.to_json(F.struct("user", listed.alias("datasets"), "review"), {"ignoreNullFields": "false"})
    return whole.select("user_id", F.size(listed).cast("bigint").alias("n_datasets"), document.alias("document"))


def _shaped(df: DataFrame, instead: dict[str, Column] | None = None) -> Column:
    return F.struct(*[(instead or {}).get(c, F.col(c)).alias(c) for c in df.columns if c not in PRIVATE_COLUMNS])


def _ordered(records: Column) -> Column:
    """By age and hash; the records themselves, which hold maps, are not compared."""
    before = lambda a, b: F.when(a["age"] < b["age"], -1).when(a["age"] > b["age"], 1).when(a["file_hash"] < b["file_hash"], -1).when(a["file_hash"] > b["file_hash"], 1).otherwise(0)
    return F.array_sort(records, before)


def write_export(sections: DataFrame, path: str) -> None:
    """CSV files, one folder per subject; a subject with very many datasets gets
    several files rather than one huge one."""
    (sections.repartition("user_id", "section", F.pmod(F.xxhash64("id"), F.lit(16)))
     .sortWithinPartitions("user_id", "section", "id")
     .write.partitionBy("user_id").option("header", True).csv(path))


@dataclass
class Erasure:
    """Next state of the three tables, and what was removed."""

    users: DataFrame
    catalog: DataFrame
    reviews: DataFrame
    object_keys: DataFrame
    counts: DataFrame


def erase(subjects: DataFrame, users: DataFrame, catalog: DataFrame, reviews: DataFrame) -> Erasure:
    """Remove users with their review and the datasets noted as theirs.

    Only known users are erased. Nothing is written here: commit all three
    tables in one version, so that a failure leaves the old state.
    """
    gone = subjects.select("user_id").join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    tagged = catalog.withColumn("__owner", F.coalesce(owner_in_extra(), F.lit("")))
    goners = gone.select(F.col("user_id").alias("__owner"))
    removed = tagged.join(goners, "__owner", "left_semi")
    object_key = F.coalesce(F.when(F.col("object_key") != "", F.col("object_key")), F.col("extra")["object_key"])
    keys = removed.select(F.col("__owner").alias("user_id"), "file_hash", object_key.alias("object_key"))
    return Erasure(
        users.join(gone.withColumnRenamed("user_id", "id"), "id", "left_anti").select(*users.columns),
        tagged.join(goners, "__owner", "left_anti").select(*catalog.columns),
        reviews.join(gone, "user_id", "left_anti").select(*reviews.columns),
        keys.filter("object_key IS NOT NULL"),
        keys.groupBy("user_id").agg(F.count("*").alias("datasets")),
    )
