"""Writing scrubbed tables and reports; always to a new path."""

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    report.write.mode("errorifexists").json(path)


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*")).alias("report"))
