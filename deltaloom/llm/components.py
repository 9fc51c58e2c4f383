"""Connected components of a graph in a table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, settings

#: A hub's partition is split from this size on.
SKEW = {"spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "32m", "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "3"}


def _large_star(both: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour (or itself)."""
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(down: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is hung on the smallest of them."""
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    hung = down.join(least, F.col("a") == F.col("k"))
    return hung.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Nodes are longs.  Every round is a partial aggregate and a join over the
    edges, written to the shared folder; only two sums per round reach the
    driver, to see that nothing moved.  The number of rounds grows with the
    logarithm of a component's diameter.  The smallest neighbours are found by
    partial aggregates, and a hub's edges meet them in a join that splits
    partitions over ``SKEW``.  No edges give an empty table.
    """
    with settings(scratch.spark, **SKEW):
        return _contract(edges, scratch, label)


def _contract(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    down = scratch.narrow(down, f"{label}0")
    state, k = None, 0
    while True:
        now = down.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if now == state or not now["n"]:
            return down.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, k = now, k + 1
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _large_star(both).filter("a <> b").distinct()  # both uses of it read one exchange
        nxt = scratch.narrow(_small_star(large).filter("a <> b").distinct(), f"{label}{k}")
        scratch.drop(f"{label}{k - 1}")
        down = nxt
