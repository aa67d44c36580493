"""Progress of runs while they go on: keyed state over the stream of their status rows.

Events are status rows as they come (run_id, sample_id, tiling_status, num_tiles, seq).
Of a slide's events the one with the largest seq counts, in whatever order they
arrive and however often, so a repeated batch changes nothing.  A run's slides
are dealt to shards by a hash, so a large run is kept by many tasks; the state of a
shard is one row for each slide and its totals, which move by what an event changes.
A shard that hears nothing for a while says so by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from gridquarry.operators import runs

EVENTS = "run_id string, sample_id string, tiling_status string, num_tiles int, seq bigint"
TOTALS = ("completed", "failed", "pending", "zero_tile", "discovered_tiles")
OUTPUT = "run_id string, shard int, " + ", ".join(f"{c} bigint" for c in TOTALS) + ", last_seq bigint, quiet boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counted(status: str | None, tiles: int | None) -> tuple[int, int, int, int, int]:
    """What one slide adds to the totals, as in `runs.progress`."""
    good, bad = status == runs.SUCCESS, status == runs.FAILED
    return int(good), int(bad), int(status is not None and not good and not bad), int(good and tiles == 0), int(tiles or 0) if good else 0


class Shard(StatefulProcessor):
    def __init__(self, quiet_ms: int | None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        told = StructType([StructField("status", StringType()), StructField("tiles", IntegerType()), StructField("seq", LongType())])
        self.slides = handle.getMapState("slides", StructType([StructField("sample_id", StringType())]), told)
        self.totals = handle.getValueState("totals", StructType([StructField(c, LongType()) for c in (*TOTALS, "last_seq")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        totals = list(self.totals.get()) if self.totals.exists() else [0] * (len(TOTALS) + 1)
        for frame in rows:
            for sample, status, tiles, seq in frame.sort_values("seq")[["sample_id", "tiling_status", "num_tiles", "seq"]].itertuples(index=False):
                before = (0,) * len(TOTALS)
                if self.slides.containsKey((sample,)):
                    old = self.slides.getValue((sample,))
                    if old[2] >= seq:
                        continue
                    before = counted(old[0], old[1])
                tiles = None if tiles is None or tiles != tiles else int(tiles)
                self.slides.updateValue((sample,), (status, tiles, int(seq)))
                for k, (a, b) in enumerate(zip(before, counted(status, tiles), strict=True)):
                    totals[k] += b - a
                totals[-1] = max(totals[-1], int(seq))
        self.totals.update(tuple(totals))
        if self.quiet_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield self._told(key, totals, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self._told(key, list(self.totals.get()), True)

    @staticmethod
    def _told(key, totals: list[int], quiet: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], *totals, quiet)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def shards(events: DataFrame, n: int = 64, quiet_seconds: float | None = None) -> DataFrame:
    """Totals of each shard whenever they may have changed, and once more with quiet set when it has heard nothing for quiet_seconds.

    events: a stream of EVENTS.  With quiet_seconds the query waits for its timers, so it never ends by itself.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    dealt = events.withColumn("shard", F.pmod(F.xxhash64("sample_id"), F.lit(n)).cast("int"))
    return dealt.groupBy("run_id", "shard").transformWithStateInPandas(Shard(None if quiet_seconds is None else int(quiet_seconds * 1000)), OUTPUT, "Update", "None" if quiet_seconds is None else "ProcessingTime")


def snapshot(told: DataFrame) -> DataFrame:
    """The totals of each run, from all that its shards have told so far; the last word of a shard counts."""
    last = told.groupBy("run_id", "shard").agg(F.max(F.struct("batch", "last_seq", *TOTALS)).alias("_l"))
    return last.groupBy("run_id").agg(*(F.sum(f"_l.{c}").cast("bigint").alias(c) for c in TOTALS))


def follow(events: DataFrame, out: str, checkpoint: str, n: int = 64, quiet_seconds: float | None = None, **trigger):
    """Keep what shards tell in a folder, each batch under its number, so that a repeated batch overwrites itself; `read` has the totals at any time.  Without a trigger it takes what is there and ends."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return shards(events, n, quiet_seconds).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark, out: str) -> DataFrame:
    return snapshot(spark.read.option("basePath", out).parquet(out).where(~F.col("quiet")))


def latest(events: DataFrame) -> DataFrame:
    """Of events at rest, each slide's last."""
    newest = W.partitionBy("run_id", "sample_id").orderBy(F.desc("seq"))
    return events.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
