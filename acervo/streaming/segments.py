"""A search index in segments: a batch appends and rewrites nothing (STR-3, FTS-6).

Segment n holds the postings of batch n and the list of its documents, with their sizes.  That list
is the tombstone of the same documents in every earlier segment; a document whose list entry has
no postings is gone.  `compact` writes what is alive up to a segment into a new base, which counts as
soon as its job is committed; older folders are only removed by `vacuum`, so readers never see a hole.
A batch that is written again replaces its own segment and changes nothing.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.operators import search

POSTING = "term string, md5 string, field string, doc_len int, tf long, positions array<int>, segment long"
DOCUMENT = "md5 string, size int, segment long"


class Segments:
    """Folders segment-n and base-n below a root, each with postings and docs, and a mark once both are there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _folders(self) -> list[tuple[int, str]]:
        """(number, name) of the folders that count: the newest base and the segments behind it."""
        fs, path = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        whole = [(int(n), kind) for name in names if (m := re.fullmatch(r"(base|segment)-(\d+)", name)) for kind, n in [m.groups()] if self._done(name)]
        base = max((n for n, kind in whole if kind == "base"), default=-1)
        return sorted([(n, f"{kind}-{n}") for n, kind in whole if (kind == "base" and n == base) or (kind == "segment" and n > base)])

    def _done(self, name: str) -> bool:
        fs, path = self._fs(f"{name}/docs/_SUCCESS")  # docs are written last
        return fs.exists(path)

    def _write(self, name: str, postings: DataFrame, docs: DataFrame) -> None:
        search.stored_order(postings).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}/postings")
        docs.write.mode("overwrite").parquet(f"{self.root}/{name}/docs")

    def append(self, batch: DataFrame, fields: list[str], number: int) -> None:
        """The documents of a batch (md5 and fields) as segment `number`; those without any token only bury what was there."""
        size = sum((F.size(search.tokens(f)) for f in fields), F.lit(0))
        at = F.lit(number).cast("long").alias("segment")
        self._write(f"segment-{number}", search.build_index(search.dealt(batch), fields).select("*", at), batch.select("md5", size.alias("size"), at))

    def _read(self, kind: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{kind}") for _, name in self._folders()]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else self.spark.createDataFrame([], schema)

    def docs(self) -> DataFrame:
        """(md5, size, segment) of every document, by its last segment."""
        return self._read("docs", DOCUMENT).groupBy("md5").agg(F.max(F.struct("segment", "size")).alias("d")).select("md5", "d.size", "d.segment")

    def postings(self) -> DataFrame:
        """The postings that are alive: the lists of later segments bury them, and only documents that came again are looked up."""
        again = self._read("docs", DOCUMENT).groupBy("md5").agg(F.max("segment").alias("last"), F.min("segment").alias("first")).filter("first < last")
        rows = self._read("postings", POSTING)
        if again.isEmpty():
            return rows
        return rows.join(again.select("md5", "last").hint("merge"), "md5", "left").filter("last IS NULL OR segment = last").drop("last")

    def sizes(self) -> DataFrame:
        """One row: number of documents and their mean length in tokens."""
        return self.docs().agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))

    def compact(self) -> None:
        """All that is alive as one base; without two folders there is nothing to do."""
        folders = self._folders()
        if len(folders) > 1:
            self._write(f"base-{folders[-1][0]}", self.postings(), self.docs())

    def vacuum(self) -> None:
        """Removes folders that no longer count; run it when no reader that began earlier is left."""
        fs, path = self._fs()
        keep = {name for _, name in self._folders()}
        for x in list(fs.listStatus(path)):
            if re.fullmatch(r"(base|segment)-\d+", x.getPath().getName()) and x.getPath().getName() not in keep:
                fs.delete(x.getPath(), True)


def index_stream(stream: DataFrame, index: Segments, fields: list[str], checkpoint: str):
    """STR-3: every batch of documents becomes a segment."""
    def add(batch: DataFrame, number: int) -> None:
        index.append(batch.dropDuplicates(["md5"]), fields, number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
