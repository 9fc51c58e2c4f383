"""Snapshots of tables: one folder per snapshot, a manifest written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MANIFEST = "manifest"


class Backups:
    """Snapshots under ``root``; one without a manifest does not count (its writer died)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def snapshot(self, name: str, created: int, tables: dict[str, DataFrame]) -> None:
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/{table}")
        manifest = self.spark.createDataFrame([(name, created, sorted(tables))], "id string, created long, tables array<string>")
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.root}/{name}/{MANIFEST}")

    def list(self) -> DataFrame:
        """(id, created, tables) of the snapshots that are whole."""
        found = [n for n in shared.list_dir(self.spark, self.root) if MANIFEST in shared.list_dir(self.spark, f"{self.root}/{n}")]
        schema = "id string, created long, tables array<string>"
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json([f"{self.root}/{n}/{MANIFEST}" for n in found])

    def restore(self, name: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{table}")

    def delete(self, name: str) -> None:
        shared.delete(self.spark, f"{self.root}/{name}")

    def cleanup(self, now: int, days: int) -> list[str]:
        """Deletes snapshots past their retention; names of those."""
        from deltaloom.operators.chunks import backup_retention

        gone = sorted(r["id"] for r in backup_retention(self.list(), now, days).select("id").collect())  # one row per snapshot
        for name in gone:
            self.delete(name)
        return gone


def round_trip(spark: SparkSession, table: DataFrame) -> DataFrame:
    """A table snapshot, listed and read back."""
    backups = Backups(spark, shared.shared_dir(spark, "backups"))
    backups.snapshot("s1", 1_700_000_000, {"t": table})
    return backups.list().filter("id = 's1'").select(F.lit(1)).crossJoin(backups.restore("s1", "t")).drop("1")
