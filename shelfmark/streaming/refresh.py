"""An optional extension: a catalog source that arrives as a stream of changed rows.

Each micro-batch is merged by id into the stored source (a null name deletes the row), and a new catalog
version is built beside the one in use. Readers see all tables of one version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import refresh, source
from ..operators.catalog import top


def follow(changes: DataFrame, root: str, checkpoint: str):
    """Start a query over a streaming frame of source rows with ``seq`` (later wins). Replayed batches give the same version."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = top(batch, ["id"], [F.col("seq").desc()], 1)
        try:
            old = spark.read.parquet(f"{root}/source-{number - 1}")
        except Exception as e:
            if number or "PATH_NOT_FOUND" not in str(e):
                raise
            old = source(latest).limit(0)
        kept = old.join(latest.select(F.col("id").cast("string")), "id", "left_anti")
        kept.unionByName(source(latest.where("name is not null"))).write.mode("overwrite").parquet(f"{root}/source-{number}")
        refresh(spark.read.parquet(f"{root}/source-{number}"), root, f"v{number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update")
