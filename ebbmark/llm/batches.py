"""Bounds on what one Arrow batch holds, so that very long texts do not fill a Python worker, on what a worker keeps, and on what stays on disk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_held: dict[tuple, object] = {}


def held(make: Callable, *args):
    """What make(*args) gives, kept in this Python worker for later tasks until another is asked for.

    Spark hands a worker from one job to the next, so memories that each outlive their job would add up.
    """
    key = (make, *args)
    if key not in _held:
        _held.clear()  # the old one goes before the new one grows
        _held[key] = make(*args)
    return _held[key]


def bounded(spark: SparkSession, rows: int = 500, mb: int = 4) -> SparkSession:
    """Set the session's Arrow batches to ``rows`` rows and ``mb`` MB at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)
    return spark


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of every finished job go at its end; for jobs whose results are written as tables."""
    before = spark.conf.get(_SWEEP, "false")
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SWEEP, before)
