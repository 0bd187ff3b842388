"""One entry for paths: find the modality, read, assess."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer import fixed_values as fv
from assayer.operators.checks import assess_table, make_context
from assayer.operators.images import assess_images
from assayer.operators.textcorpus import assess_text
from assayer.sources import files

FAMILIES = (("image", fv.IMAGE_SUFFIXES), ("tabular", fv.TABULAR_SUFFIXES), ("text", fv.TEXT_SUFFIXES))


def modality_of(spark: SparkSession, path: str) -> str:
    """By suffix for a file, by the files directly inside for a folder."""
    lowered = path.rstrip("/").lower()
    for name, suffixes in FAMILIES:
        if lowered.endswith(suffixes):
            return name
    return files.detect_modality(spark, path).first()["modality"]


def run_assessment(
    spark: SparkSession, path: str, modality: str = "auto", compare_path: str | None = None, as_of: Column | None = None,
    id_col: str | None = None, time_col: str | None = None, target_col: str | None = None, labels: DataFrame | None = None,
    min_resolution: tuple[int, int] = (224, 224),
) -> DataFrame:
    """Report row of a table, text corpus or image corpus, with its modality."""
    chosen = modality_of(spark, path) if modality.lower() == "auto" else modality.lower()
    if chosen == "tabular":
        table = files.read_table(spark, path)
        other = files.read_table(spark, compare_path) if compare_path else None
        report = assess_table(make_context(table, other, id_col, time_col, target_col, as_of))
        report = report.withColumn("input_hash", files.table_fingerprint(table).scalar())
        report = report.withColumn("compare_hash", F.lit(None).cast("string") if other is None else files.table_fingerprint(other).scalar())
    elif chosen in ("image", "text"):
        times = files.list_files(spark, path) if as_of is not None else None
        if chosen == "text":
            suffixes = fv.TEXT_SUFFIXES
            times = times if times is None else times.filter(F.col("suffix").isin(*suffixes))
            report = assess_text(files.read_text_corpus(spark, path), "text", "path", times, as_of)
        else:
            times = times if times is None else times.filter(F.col("suffix").isin(*fv.IMAGE_SUFFIXES))
            report = assess_images(files.read_image_corpus(spark, path), labels, times, as_of, min_resolution)
    else:
        raise ValueError(f"unsupported modality: {modality}")
    return report.withColumn("modality", F.lit(chosen))
