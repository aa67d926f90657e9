"""Writers of the stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_store(store: DataFrame, path: str) -> None:
    """Positioning store, one directory per alias, dates ascending; only the aliases at hand are replaced."""
    dealt = store.repartition("alias").sortWithinPartitions("alias", "date")
    dealt.write.partitionBy("alias").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_series(obs: DataFrame, path: str, buckets: int = 64) -> None:
    """Long series store, partitioned by a hash bucket of the series, so files do not multiply with series."""
    bucket = F.pmod(F.xxhash64("entity_id", "series_id"), F.lit(buckets)).cast("int")
    dealt = obs.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "entity_id", "series_id", "date")
    dealt.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)
