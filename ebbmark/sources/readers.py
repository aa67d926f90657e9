"""Readers with explicit schemas, and flattening of nested reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbmark.core import schemas
from ebbmark.core.windows import without_nan


def read_positions(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Raw positioning records, text as delivered (json lines or csv with a header)."""
    reader = spark.read.schema(schemas.POSITIONS_RAW)
    return reader.csv(path, header=True) if kind == "csv" else reader.json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.POSITIONS).parquet(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Long series store; NaN becomes null here and nowhere else."""
    return without_nan(spark.read.schema(schemas.STORED_OBS + ", bucket int").parquet(path), "value").drop("bucket")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROBE_REPORT).json(path, multiLine=True)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOGUE).json(path, multiLine=True)


def flat_report(report: DataFrame) -> DataFrame:
    """(target, label, query, code, n, first_date, last_date, ...): each code once per target, if ok.

    A code that several queries hit comes from the first query by name, then the first hit.
    """
    targets = report.select(F.explode("targets").alias("target", "t"))
    queries = targets.select("target", "t.label", F.explode("t.queries").alias("query", "q"))
    hits = queries.select("target", "label", "query", F.posexplode("q.hits").alias("pos", "hit")).filter("hit.series.ok")
    rows = hits.select("target", "label", "query", "pos", "hit.series.*").drop("ok")
    first = Window.partitionBy("target", "code").orderBy("query", "pos")
    return rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn", "pos")


def flat_catalogue(catalogue: DataFrame, only: list[str] | None = None) -> DataFrame:
    """One row per (input, role, candidate): field by precedence price > series > input > default; extra fields."""
    inputs = catalogue.select(F.explode("inputs").alias("i"), F.col("defaults.field").alias("default_field"))
    if only is not None:
        inputs = inputs.filter(F.col("i.id").isin(only))
    series = inputs.select("i", "default_field", F.explode_outer("i.series").alias("s"))
    return series.select(
        F.col("i.id").alias("input_id"),
        F.col("i.name").alias("input_name"),
        "i.kind",
        "i.frequency",
        "s.role",
        F.posexplode_outer("s.candidates").alias("position", "candidate"),
        F.coalesce("s.price_field", "s.field", "i.field", "default_field").alias("field"),
        F.coalesce("s.field_alternates", "i.field_alternates").alias("field_alternates"),
        F.array_compact(F.array("s.weight_field")).alias("extra_fields"),
    )
