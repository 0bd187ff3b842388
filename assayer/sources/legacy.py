"""One-time loads of older JSON stores."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.operators.catalog import upsert

USER_STRUCT = "struct<id:string,username:string,email:string,plan:string,kyb_status:string,restricted:boolean>"


def read_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One record per *.json file; unreadable files are skipped and a missing
    owner becomes 'legacy'. The path breaks ties between files."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    with_bad = f"{schema}, _bad STRING"
    parsed = F.from_json("value", with_bad, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = raw.select(parsed.alias("r"), F.col("_metadata.file_path").alias("source_path"))
    good = rows.filter("r IS NOT NULL AND r._bad IS NULL").select("r.*", "source_path").drop("_bad")
    owner = F.when(F.coalesce("owner", F.lit("")) == "", "legacy").otherwise(F.col("owner"))
    return good.withColumn("owner", owner)


def load_records(catalog: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next catalogue, one row with the number migrated)."""
    following = upsert(catalog, records, ["source_path"]).select(*catalog.columns)
    return following, records.agg(F.count("*").alias("migrated"))


def legacy_users(lines: DataFrame, json: Column) -> DataFrame:
    """Users out of JSON maps of id to user."""
    users = lines.select(F.explode(F.map_values(F.from_json(json, f"map<string,{USER_STRUCT}>"))).alias("u")).select("u.*")
    return users.withColumns(
        {
            "plan": F.coalesce("plan", F.lit("free")), "kyb_status": F.coalesce("kyb_status", F.lit("pending")),
            "restricted": F.coalesce("restricted", F.lit(False)),
        }
    )


def load_users(legacy: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, created and skipped counts): rows without id and ids that
    exist already, or earlier in the batch, are skipped."""
    fresh = legacy.filter("coalesce(id, '') <> ''").join(users.select("id"), "id", "left_anti").dropDuplicates(["id"])
    created = fresh.agg(F.count("*").alias("n")).scalar()
    counts = legacy.agg(F.count("*").alias("total")).withColumn("created", created)
    return fresh, counts.select("created", (F.col("total") - F.col("created")).alias("skipped"))
