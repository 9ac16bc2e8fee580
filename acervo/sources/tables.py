"""Derived tables kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_KEPT: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode alone (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="acervo-")
    return _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once in the shared folder: cuts its lineage, and its expressions are computed once."""
    path = f"{shared_dir(df.sparkSession)}/acervo-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, folder: str) -> str:
    """Names, sizes and change times in a folder: another text after any table in it was replaced."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return ",".join(sorted(f"{x.getPath().getName()} {x.getLen()} {x.getModificationTime()}" for x in found))


def kept(spark: SparkSession, name: str, folder: str, make: Callable[[], DataFrame] | None = None) -> DataFrame | None:
    """The table make() derives from a folder, written at its first use in this application and read back while the folder stays as it is.  Without make: null if it is not there."""
    at = (spark.sparkContext.applicationId, name, stamp(spark, folder))
    if at not in _KEPT:
        if make is None:
            return None
        path = f"{shared_dir(spark)}/acervo-table-{uuid.uuid4().hex}"
        make().write.option("compression", "zstd").parquet(path)
        _KEPT[at] = path
    return spark.read.parquet(_KEPT[at])
