"""Incremental views over the change log.

The log is a file stream; its position is the checkpoint's offset, a cursor of
what was consumed, not an event time, so no ``withWatermark``: a delta is never
dropped for being old.  Every batch writes one new version of the view under
its batch id and may be repeated without harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.sources import shared


def view_poll(deltas: DataFrame, cursors: DataFrame, batch: int = 1000) -> DataFrame:
    """Per view (view, shard, position): the smallest new position over its shards.

    A shard advances to the largest sequence among its next ``batch``; a shard
    with nothing new holds the view where it is.
    """
    next_ = (F.col("shard") == F.col("_shard")) & (F.col("seq") > F.col("position")) & (F.col("seq") <= F.col("position") + batch)
    ahead = cursors.join(deltas.select(F.col("shard").alias("_shard"), "seq"), next_, "left")
    per_shard = ahead.groupBy("view", "shard", "position").agg(F.max("seq").alias("top"))
    return per_shard.groupBy("view").agg(F.min(F.coalesce("top", "position")).alias("position"))


def view_advance(views: DataFrame, moves: DataFrame) -> DataFrame:
    """Positions move forward only; a building view is active once over zero; a discarded one refuses."""
    joined = views.join(moves.withColumnRenamed("position", "to"), "view", "left")
    refused = (F.col("state") == "Discarded") & F.col("to").isNotNull()
    position = F.when(F.col("state") == "Discarded", F.col("position")).otherwise(F.greatest("position", F.coalesce("to", "position")))
    state = F.when((F.col("state") == "Building") & (position > 0), "Active").otherwise(F.col("state"))
    return joined.select("view", position.alias("position"), state.alias("state"), refused.alias("refused"))


def latest(deltas: DataFrame) -> DataFrame:
    """Newest delta of each key."""
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return deltas.withColumn("_n", n).filter("_n = 1").drop("_n")


class View:
    """A keep-latest view in versions ``v=<batch>`` under ``root``; ``project`` gives (key, seq, ...)."""

    def __init__(self, spark: SparkSession, root: str, project: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.project = spark, root.rstrip("/"), project

    def _versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in shared.list_dir(self.spark, f"{self.root}/versions") if n.startswith("v="))

    def _merge(self, batch: DataFrame, batch_id: int) -> None:
        older = [v for v in self._versions() if v < batch_id]
        state = self.project(batch)
        if older:
            state = state.unionByName(self.spark.read.parquet(f"{self.root}/versions/v={older[-1]}"))
        latest(state).write.mode("overwrite").parquet(f"{self.root}/versions/v={batch_id}")
        for v in older[:-1]:
            shared.delete(self.spark, f"{self.root}/versions/v={v}")

    def poll(self, log_path: str, schema, files: int = 1) -> None:
        """Takes in what the log has gained since the last poll."""
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(log_path)
        query = stream.writeStream.foreachBatch(self._merge).option("checkpointLocation", f"{self.root}/cursor").trigger(availableNow=True).start()
        query.awaitTermination()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/versions/v={self._versions()[-1]}")

    def discard(self) -> None:
        """Drops versions and cursor; the next poll rebuilds from the start of the log."""
        shared.delete(self.spark, f"{self.root}/versions")
        shared.delete(self.spark, f"{self.root}/cursor")


def append_chunks_and_deltas(spark: SparkSession, stream: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], deltas_of: Callable[[DataFrame], DataFrame], root: str) -> None:
    """Writes, per batch, chunk rows and then deltas; a repeated batch overwrites its own parts.

    A reader takes the batches whose deltas exist, so it never sees a delta without its chunks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        chunks_of(batch).write.mode("overwrite").parquet(f"{root}/chunks/batch={batch_id}")
        deltas_of(batch).write.mode("overwrite").parquet(f"{root}/deltas/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/cursor").trigger(availableNow=True).start()
    query.awaitTermination()


def live_token_bucket(calls: DataFrame, per_second: int) -> DataFrame:
    """Streaming twin of the token bucket: (owner, id, at_ms) -> admitted, with state per owner.

    The state is the current second and how many it has admitted.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        second, used = state.get if state.exists else (-1, 0)
        for batch in batches:
            rows = batch.sort_values(["at_ms", "id"])
            out = []
            for at in rows["at_ms"]:
                now = int(at) // 1000
                second, used = (now, 0) if now > second else (second, used)
                out.append(used < per_second)
                used += out[-1]
            yield pd.DataFrame({"owner": key[0], "id": rows["id"], "admitted": out})
        state.update((second, used))

    return calls.groupBy("owner").applyInPandasWithState(admit, "owner string, id long, admitted boolean", "second long, used long", "append", GroupStateTimeout.NoTimeout)
