"""Progress of processing runs as a stateful stream (STR-2).

Events of a run come in any order and over any number of batches: `ready` tells how many files
there are and how many were done before, `file_done` that one more is, well or with an error.
Every run is kept in SHARDS states, so that a large one is not one task's, and each state holds six
numbers whatever has passed.  Of several `ready` events the latest counts, not the last to arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from acervo.streaming.intake import Table

SHARDS = 8
STATE = "at long, number long, total long, already long, success long, errors long"
ROWS = "run string, shard long, " + STATE


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of one shard of a run after a batch's events (event, at, number, total, already, ok)."""
    at, number, total, already, success, errors = state.get if state.exists else (-1, -1, 0, 0, 0, 0)
    for b in batches:
        ready = b[b["event"] == "ready"].sort_values(["at", "number"])
        if len(ready):
            last = ready.iloc[-1]
            if (last["at"], last["number"]) > (at, number):
                at, number, total, already = (int(last[c]) for c in ("at", "number", "total", "already"))
        done = b[b["event"] == "file_done"]
        ok = int(done["ok"].fillna(False).astype(bool).sum())
        success, errors = success + ok, errors + len(done) - ok
    now = (at, number, total, already, success, errors)
    state.update(now)
    yield pd.DataFrame([(*key, *now)], columns=[c.split()[0] for c in ROWS.split(", ")])


def track(events: DataFrame) -> DataFrame:
    """A stream of the states that changed, from a stream (run, event, ts, number, total, already, ok); rows without a run count for none."""
    flat = events.filter("run IS NOT NULL").select(
        F.col("run").cast("string").alias("run"), F.pmod(F.xxhash64("number"), F.lit(SHARDS)).alias("shard"), "event", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.coalesce(F.col("number").cast("long"), F.lit(0)).alias("number"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("total", "already")], F.coalesce("ok", F.lit(False)).alias("ok"),
    )
    return flat.groupBy("run", "shard").applyInPandasWithState(_advance, ROWS, STATE, "update", GroupStateTimeout.NoTimeout)


def follow(events: DataFrame, table: Table, checkpoint: str):
    """Keeps a table of the latest states: a batch writes only those that changed, and writing one again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("md5", F.md5(F.concat_ws("#", "run", "shard"))).persist()
        table.merge(fresh, lambda old, new: old.join(new.select("md5").hint("merge"), "md5", "left_anti").unionByName(new))
        fresh.unpersist()

    return track(events).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def runs(states: DataFrame) -> DataFrame:
    """(run, total, already, done, success, errors, percent): percent of all files that are done, to one decimal, 100 at most; null without files."""
    last = F.max_by(F.struct("total", "already"), F.struct("at", "number"))
    whole = states.groupBy("run").agg(last.alias("r"), F.sum("success").alias("success"), F.sum("errors").alias("errors"))
    done = F.col("success") + F.col("errors")
    tenths = F.expr("(2000 * (r.already + success + errors) + r.total) div (2 * r.total)")
    return whole.select("run", "r.total", "r.already", done.alias("done"), "success", "errors", F.when(F.col("r.total") > 0, F.least(tenths, F.lit(1000)) / F.lit(10.0)).alias("percent"))
