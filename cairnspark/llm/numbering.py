"""Gapless numbers within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 5_000
MOST_BLOCKS = 20_000


def in_blocks(rows: DataFrame, group: str, order: list[str], sums: list[str] = (), rows_per_block: int = ROWS_PER_BLOCK, place: str | None = None) -> tuple[DataFrame, list]:
    """Deals every group's rows into blocks by a hash of `order`, numbers rows within blocks, and counts the blocks.

    With `place`, a column of numbers from 0 that are all but dense in each group, blocks are runs of it instead, and
    the numbers follow it.

    Adds block, rn (from 0 in the block) and for each column s of `sums` run_s (its sum over the rows before, in the
    block). The second result has a row for each block: group, block, n and the sums. There are at most MOST_BLOCKS
    blocks more than groups, so that list has a bound whatever the input.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("n")).collect()  # a row for each group; callers bound groups
    per = max(rows_per_block, -(-sum(r["n"] for r in counts) // MOST_BLOCKS))
    spark = rows.sparkSession
    kind = rows.schema[group].dataType.simpleString()
    sizes = spark.createDataFrame([(r[group], max(1, -(-r["n"] // per))) for r in counts], f"{group} {kind}, blocks long")
    dealt = rows.join(F.broadcast(sizes), group).withColumn("_h", F.col(place) if place else F.xxhash64(*order))
    dealt = dealt.withColumn("block", (F.floor(F.col("_h") / per) if place else F.pmod(F.xxhash64(F.col("_h"), F.lit(1)), F.col("blocks"))).cast("int"))
    w = Window.partitionBy(group, "block").orderBy("_h", *order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select(*rows.columns, "block", (F.row_number().over(w) - 1).cast("long").alias("rn"), *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"run_{s}") for s in sums])
    blocks = dealt.groupBy(group, "block").agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect()
    return out, sorted(blocks, key=lambda r: (r[group], r["block"]))
