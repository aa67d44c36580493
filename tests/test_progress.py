"""Progress over a stream of status rows against the rows at rest."""

import random
import time

from gridquarry.operators import runs
from gridquarry.streaming import progress
from pyspark.sql import functions as F


def test_totals_after_each_batch_and_over_a_restart(spark, tmp_path):
    random.seed(1)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    events = [(f"run-{k % 2}", f"s{random.randrange(12)}", random.choice(["success", "failed", "queued", None]), random.choice([None, 0, 3, 9]), k) for k in range(80)]
    random.shuffle(events)
    source, out, checkpoint = str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    stream = lambda: spark.readStream.schema(progress.EVENTS).option("maxFilesPerTrigger", 1).json(source)
    seen = []
    for low in (0, 30, 60):
        seen += events[low : low + 30] + events[:5]  # some come again
        spark.createDataFrame(events[low : low + 30] + events[:5], progress.EVENTS).coalesce(1).write.mode("append").json(source)
        query = progress.follow(stream(), out, checkpoint, 3)  # a new query over the same checkpoint each time
        query.awaitTermination(120)
        assert query.exception() is None
        rest = progress.latest(spark.createDataFrame(seen, progress.EVENTS))
        want = {run: tuple(runs.progress(rest.where(F.col("run_id") == run)).first()) for run in ("run-0", "run-1")}
        # a status that is missing counts nowhere, as in the rows at rest
        assert {r.run_id: tuple(r[c] for c in progress.TOTALS) for r in progress.read(spark, out).collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_quiet_shard_says_so(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    source = str(tmp_path / "events")
    spark.createDataFrame([("r", "a", "success", 2, 1)], progress.EVENTS).coalesce(1).write.json(source)
    query = progress.follow(spark.readStream.schema(progress.EVENTS).json(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"), 1, 0.5, processingTime="300 milliseconds")
    try:
        end = time.time() + 60
        told = []
        while time.time() < end and not any(r.quiet for r in told):
            time.sleep(1)
            try:
                told = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).collect()
            except Exception:  # noqa: BLE001, S110
                pass
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r.run_id, r.completed, r.discovered_tiles) for r in told if r.quiet} == {("r", 1, 2)}
