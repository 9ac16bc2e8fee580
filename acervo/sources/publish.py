"""Exports in two phases (SNK-1, SNK-5, SNK-8): written under a version of their own, checked, then published.

Readers follow the folder's CURRENT file, which is replaced by one rename after every table of
a version was read back and found whole.  A run that dies leaves a version that nobody reads;
readers of the version before keep their files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"
#: Nothing is trimmed and quotes are doubled, so that texts of any kind come back as they were.
CSV = {"header": True, "escape": '"', "multiLine": True, "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "encoding": "UTF-8"}


def _measures(columns: list[str]) -> list[Column]:
    """Number of rows and the sum of their hashes, which no order changes; hashes are of the text form, null as empty."""
    row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    return [F.count(F.lit(1)).alias("linhas"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("soma")]


def _texts(df: DataFrame) -> DataFrame:
    """Every column as text, lists joined with ";", nulls empty."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    text = lambda c: F.array_join(f"`{c}`", ";") if kinds[c] == "array" else F.col(f"`{c}`").cast("string")
    return df.select(*[F.coalesce(text(c), F.lit("")).alias(c) for c in df.columns])


def _read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).options(**CSV).csv(path).na.fill("")


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Writes the tables as CSV under a new version of root, checks and publishes it; returns the version.

    The manifest (tabela, linhas, soma, colunas) is measured while a table is written and compared
    with what its files give back; a difference ends the run before anything is published.
    """
    spark = next(iter(tables.values())).sparkSession
    version, manifest = f"v-{uuid.uuid4().hex}", []
    for name, table in tables.items():
        seen, path = Observation(), f"{root}/{version}/{name}"
        rows = _texts(table)
        rows.observe(seen, *_measures(rows.columns)).write.options(**CSV).csv(path)
        wrote = seen.get
        found = _read(spark, path, rows.columns).agg(*_measures(rows.columns)).first()
        if (wrote["linhas"], wrote["soma"]) != (found.linhas, found.soma):
            raise OSError(f"{path} holds {found.linhas} rows of sum {found.soma}, written were {wrote['linhas']} of {wrote['soma']}")
        manifest.append((name, found.linhas, found.soma, json.dumps(rows.columns)))
    spark.createDataFrame(manifest, "tabela string, linhas long, soma string, colunas string").coalesce(1).write.json(f"{root}/{version}/manifest")
    _point(spark, root, version)
    return version


def _point(spark: SparkSession, root: str, version: str) -> None:
    jvm = spark.sparkContext._jvm
    files, new = _file(spark, f"{root}/{POINTER}-{uuid.uuid4().hex}")
    out = files.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    # one rename over the former pointer
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), how)


def current(spark: SparkSession, root: str) -> str | None:
    """The published version of root, null before the first."""
    files, at = _file(spark, f"{root}/{POINTER}")
    return spark.read.text(f"{root}/{POINTER}").first().value if files.exists(at) else None


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """What the published version holds: (tabela, linhas, soma, colunas)."""
    return spark.read.schema("tabela string, linhas long, soma string, colunas string").json(f"{root}/{current(spark, root)}/manifest")


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the published version, its columns as texts."""
    row = manifest(spark, root).filter(F.col("tabela") == name).first()
    if row is None:
        raise KeyError(name)
    return _read(spark, f"{root}/{current(spark, root)}/{name}", json.loads(row.colunas))
