"""Sources and sinks: records from files, findings to partitioned tables and to defused CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.functions.text import csv_cell

CELLS = "record string, event_id long, repeat_key string, instance int, field string, value string, code string, dag string"
FINDINGS = "_record string, _event string, _instance int, _form string, _dag string, rule int, type string, field string, reason string, value string"


def read_cells(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Records in long form."""
    return spark.read.parquet(path) if kind == "parquet" else spark.read.schema(CELLS).option("header", kind == "csv").format(kind).load(path)


def records(cells: DataFrame) -> DataFrame:
    """The ids of all records: only the id column is read."""
    return cells.select("record").where("record is not null").distinct()


def write_findings(findings: DataFrame, path: str, run: str) -> None:
    """A run's findings as one partition; a rerun replaces it whole, so no half of it is ever seen."""
    findings.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


AUDIT = "project int, run string, event string, actor string, detail string, created_at timestamp"


def append_audit(events: DataFrame, path: str) -> None:
    """Adds events (project, run, event, actor, detail) with the time to the audit log, which nothing is ever taken from."""
    columns = ["project", "run", "event", "actor", "detail"]
    events.select(*columns, F.current_timestamp().alias("created_at")).write.mode("append").partitionBy("project").parquet(path)


def write_csv(report: DataFrame, path: str, comment: str = "") -> None:
    """A report as CSV files whose cells no spreadsheet runs; each line is one text, so the writer quotes nothing again. A comment is the first line of each file."""
    head = comment.replace("\n", " ") + "\r\n" * bool(comment)
    head += ",".join(f'"{c}"' for c in report.columns)
    lines = report.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in report.columns]).alias("value"))
    # each file begins with the names, as Spark's own CSV writer has it
    numbered = lines.withColumn("_first", F.monotonically_increasing_id() % (1 << 33) == 0)
    numbered.select(F.when(F.col("_first"), F.concat(F.lit(head + "\r\n"), "value")).otherwise(F.col("value")).alias("value")).write.option("lineSep", "\r\n").text(path)
