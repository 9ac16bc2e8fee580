"""Continuous intake with Structured Streaming (STR-1..3, FTS-6)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.operators import search, state

#: The first two hex digits of md5: 256 partitions, so a batch rewrites only those that its rows fall to.
PART = "_parte"


class Table:
    """A Parquet table by md5, partitioned by PART; a repeated merge of a batch changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _parts(self) -> DataFrame | None:
        fs, path = self._path("rows")
        return self.spark.read.option("basePath", f"{self.root}/rows").parquet(f"{self.root}/rows") if fs.exists(path) else None

    def latest(self) -> DataFrame | None:
        parts = self._parts()
        return None if parts is None else parts.drop(PART)

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """combine(old rows of the batch's partitions, batch) takes their place."""
        part = F.concat(F.lit("p"), F.substring("md5", 1, 2)).alias(PART)
        touched = [r[0] for r in batch.select(part).distinct().collect()]  # 256 at most
        old = self._parts()
        new = batch if old is None else combine(old.filter(F.col(PART).isin(touched)).drop(PART), batch)
        # written beside the table first: a job cannot replace what it reads
        staged = f"staged-{uuid.uuid4().hex}"
        new.withColumn(PART, part).write.parquet(f"{self.root}/{staged}")
        ready = self.spark.read.schema(new.schema.add(PART, "string")).parquet(f"{self.root}/{staged}")
        ready.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.root}/rows")
        fs, path = self._path(staged)
        fs.delete(path, True)


def intake(stream: DataFrame, table: Table, prepare: Callable[[DataFrame], DataFrame], checkpoint: str, keep: list[str] = state.KEEP, index: Table | None = None, fields: list[str] = (), late: tuple[str, str] | None = None):
    """STR-1, STR-3: new rows are prepared once and merged into the registry (and the search index) batch by batch.

    late: (time column, delay) bounds what is remembered of md5s already seen.
    """
    if late:
        stream = stream.withWatermark(*late).dropDuplicatesWithinWatermark(["md5"])

    def merge(batch: DataFrame, number: int) -> None:
        fresh = prepare(batch).dropDuplicates(["md5"]).persist()
        table.merge(fresh, lambda old, new: state.upsert(old, new.select(old.columns), keep))
        if index is not None:
            index.merge(search.build_index(fresh, list(fields)), lambda old, new: old.join(fresh.select("md5").hint("merge"), "md5", "left_anti").unionByName(new))
        fresh.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
