"""Monitoring of land use: drift as a stream with state, saved snapshots, and alerts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DRIFT = "jurisdiction string, parcel_id string, ts timestamp, event_id long, previous_use string, observed_use string"
STATE = "observed_use string, ts timestamp, event_id long"


def landuse_drift_stream(updates: DataFrame) -> DataFrame:
    """A row for each observation (jurisdiction, parcel_id, ts, event_id, observed_use) whose use differs from the parcel's last one.

    State is the last use and its time. Observations of one batch are taken in order of (ts, event_id); one that is older than the
    state is dropped, so batches that come in order of time give what lag gives over all rows. Null uses are skipped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = state.get if state.exists else None
        out = []
        for ts, event_id, use in zip(rows["ts"], rows["event_id"], rows["observed_use"]):
            if use is None or (last and (ts, event_id) < (last[1], last[2])):
                continue
            if last and last[0] != use:
                out.append((*key, ts, event_id, last[0], use))
            last = (use, ts, int(event_id))
        if last:
            state.update(last)
        yield pd.DataFrame(out, columns=["jurisdiction", "parcel_id", "ts", "event_id", "previous_use", "observed_use"])

    return updates.groupBy("jurisdiction", "parcel_id").applyInPandasWithState(step, DRIFT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_drift(updates: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Work through what there is now and stop; a later run goes on from the checkpoint."""
    return landuse_drift_stream(updates).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(out)


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointers that were written whole."""
    fs = spark._jvm.org.apache.hadoop.fs
    p = fs.Path(f"{root}/pointer/*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(f.getPath().getParent().getName()) for f in found or [])


def _pointer(spark: SparkSession, root: str) -> str | None:
    known = _pointers(spark, root)
    return json.loads(spark.read.text(f"{root}/pointer/{known[-1]}").first()[0])["version"] if known else None


def persist_snapshot(current: DataFrame, root: str, version: str) -> None:
    """Current becomes previous: a folder for the version, then a pointer to it of the next number. The greatest number counts, and a pointer only once it is whole, so a run that fails
    at any time leaves the old one in force."""
    current.write.mode("overwrite").parquet(f"{root}/versions/{version}")
    spark = current.sparkSession
    known = _pointers(spark, root)
    spark.createDataFrame([(json.dumps({"version": version}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/pointer/{known[-1] + 1 if known else 0}")


def previous_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The snapshot that the pointer names; None before the first run."""
    version = _pointer(spark, root)
    return spark.read.parquet(f"{root}/versions/{version}") if version else None


def violation_alerts(statuses: DataFrame, thresholds: dict[str, int], run: str) -> DataFrame:
    """(run, status, n, threshold) of statuses whose count is over its threshold."""
    limits = F.create_map(*[F.lit(v) for pair in thresholds.items() for v in pair])
    n = statuses.groupBy("status").agg(F.count("*").alias("n")).withColumn("threshold", F.try_element_at(limits, F.col("status")))
    return n.where(F.col("n") > F.col("threshold")).select(F.lit(run).alias("run"), "status", "n", "threshold")


def alert_stream(drift: DataFrame, threshold: int, out: str, checkpoint: str) -> StreamingQuery:
    """Alerts of each micro-batch: uses that more than ``threshold`` parcels changed to. A batch's alerts have a folder of their own (column epoch), which a batch that is run again overwrites, so each is there once."""

    def batch(df: DataFrame, epoch: int) -> None:
        n = df.groupBy(F.col("observed_use").alias("status")).agg(F.count("*").alias("n")).where(F.col("n") > threshold)
        n.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return drift.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
