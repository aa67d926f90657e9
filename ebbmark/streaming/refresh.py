"""Incremental refresh of the positioning store as a stream of report files.

The store is a folder of batches: ``data/batch=<name>/alias=<alias>`` holds what a micro-batch added, and
``commits/batch=<name>`` its contracts with their last dates. A batch's name is its number and a hash of its files,
the same when it runs again. Data are written first and count only once the commit is there, so a batch that fails
anywhere leaves nothing visible: when it runs again it writes its folder anew, or sees that it is committed and stops.
What the store has is read from the commits, so a batch's work grows with its own rows and not with the store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ebbmark.core import schemas
from ebbmark.core.tables import small
from ebbmark.operators import positioning

COMMITS = "code string, last_date date, batch string"


def _commits(spark: SparkSession, store: str) -> DataFrame:
    """(code, last_date, batch); none where the store has yet to be begun."""
    try:
        found = spark.read.schema(COMMITS).parquet(f"{store}/commits")
        found.limit(1).count()
        return found
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def read_refreshed(spark: SparkSession, store: str) -> DataFrame:
    """The rows of all committed batches."""
    done = _commits(spark, store).select("batch").distinct()
    if done.isEmpty():
        return spark.createDataFrame([], schemas.POSITIONS)
    rows = spark.read.schema(f"{schemas.POSITIONS}, batch string").parquet(f"{store}/data")
    return rows.join(small(done), "batch", "left_semi").drop("batch")


def _name(batch: DataFrame, number: int) -> str:
    files = batch.select("__file.file_path").distinct().agg(F.bit_xor(F.xxhash64("file_path")).alias("h")).first()["h"]
    return f"{number}-{(files or 0) & (2**64 - 1):016x}"


def added(batch: DataFrame, last: DataFrame, contracts: DataFrame) -> DataFrame:
    """The store's rows from a batch's raw lines: contracts that pass the identity guard, dates after last(code, last_date).

    Of lines for one contract and date that of the later file wins, then the later line: within a file, lines are in
    order by the split that they come from and their number there.
    """
    lines = positioning.typed(batch, "__file").withColumn("__seq", F.struct("__file", F.monotonically_increasing_id().alias("at")))
    wrong = positioning.mismatched_contracts(lines, contracts)
    fresh = positioning.newer(lines.drop("__file").join(small(wrong), "code", "left_anti"), last)
    kept = [c for c in fresh.columns if c not in ("code", "date", "__seq")]
    latest = fresh.groupBy("code", "date").agg(F.max_by(F.struct(*kept), "__seq").alias("x")).select("code", "date", "x.*")
    return positioning.derived(latest, contracts)


def _write_data(rows: DataFrame, path: str) -> None:
    rows.repartition("alias").sortWithinPartitions("alias", "date").write.partitionBy("alias").mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def _commit(spark: SparkSession, store: str, name: str) -> None:
    """One file, which appears whole or not at all."""
    rows = spark.read.schema(schemas.POSITIONS).parquet(f"{store}/data/batch={name}")
    last = positioning.last_dates(rows)
    last.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{store}/commits/batch={name}")


def refresh(spark: SparkSession, arriving: str, store: str, checkpoint: str, contracts: DataFrame) -> StreamingQuery:
    """Take in all report files in ``arriving`` that are new since the checkpoint; read_refreshed() has the result."""

    def take(batch: DataFrame, number: int) -> None:
        name, done = _name(batch, number), _commits(spark, store)
        if not done.filter(F.col("batch") == name).isEmpty():
            return
        last = done.groupBy("code").agg(F.max("last_date").alias("last_date"))
        _write_data(added(batch, last, contracts), f"{store}/data/batch={name}")
        _commit(spark, store, name)

    stream = spark.readStream.schema(schemas.POSITIONS_RAW).json(arriving)
    stream = stream.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("__file"))
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
