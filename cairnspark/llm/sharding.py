"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the transfers that move the fewest bytes.

The flow network has an edge from each old to each new shard, with the cost of moving a byte (0 to where it is, 1
elsewhere, or a given matrix); successive shortest paths solve it exactly on the driver, as it has only shards for nodes.
Where old shards stand in an order that new ones are to keep, cost grows with the distance and a sweep over both in
order is the minimum, in time that grows with the number of shards.

The flow is solved for all bytes, and rows carry it out: a row lies where its middle does. Each old shard is laid out by
size, the largest rows first, and cut where its flows end, what stays first; so cuts fall among small rows, and a new
shard differs from its capacity by about half a small row for each cut. Only rows of more than 1/GIANTS of a shard's
capacity (fewer than GIANTS a shard, whatever the input) are placed one by one before, where they are if there is room;
the flow is that of the rest.

Laws: "bytes" (sizes near equal) and "rows" (counts at most one apart). A row's size is its text's UTF-8 bytes plus 1.

Defined cases. Null text: size 1. Null id: a row as others. Equal texts: rows as others, so a group of copies may lie in
several shards. Repeated rows: a place each. Ties: rows of equal id and text are interchangeable. Null old shard: shard
0. Empty table: no rows. Extra columns pass through `resharded`. Fewer rows than shards: some shards are empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import by_row
from .numbering import in_blocks
from .runtime import forget, written

SHARDS = 8
GIANTS = 32


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[float]]) -> list[list[int]]:
    """Units from each old to each new shard: all supply placed, no capacity exceeded, least total cost."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards hold less than there is")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # shortest paths from old shards with supply left, over residual edges (Bellman-Ford; back edges have negative cost)
        far = [0.0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        came: list[int | None] = [None] * (n + m)
        for _ in range(n + m):
            moved = False
            for i in range(n):
                for j in range(m):
                    if far[i] + cost[i][j] < far[n + j] - 1e-12:
                        far[n + j], came[n + j], moved = far[i] + cost[i][j], i, True
                    if flow[i][j] and far[n + j] - cost[i][j] < far[i] - 1e-12:
                        far[i], came[i], moved = far[n + j] - cost[i][j], n + j, True
            if not moved:
                break
        end = min((j for j in range(m) if room[j]), key=lambda j: far[n + j])
        path, at = [], n + end
        while came[at] is not None:
            path.append((came[at], at))
            at = came[at]
        amount = min([left[at], room[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[at] -= amount
        room[end] -= amount
    return flow


def sweep_flow(supply: Sequence[int], capacity: Sequence[int]) -> list[list[tuple[int, int]]]:
    """For each old shard (new shard, units), both in order: the least cost wherever cost grows with the distance between the places of the two."""
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards hold less than there is")
    out, j, room = [], 0, list(capacity)
    for left in supply:
        own = []
        while left:
            take = min(left, room[j])
            if take:
                own.append((j, take))
            left -= take
            room[j] -= take
            j += not room[j]
        out.append(own)
    return out


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def place(docs: DataFrame, old_shard: Column, shards: int = SHARDS, law: str = "bytes", cost: Sequence[Sequence[float]] | None = None, old_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None) -> DataFrame:
    """One row for each row: id, text_hash, size, text_crc32, old_shard, shard, slot (gapless from 0 in its shard).

    With `order`, a row's number from 0 in its old shard, the old shards in order are one sequence that the new ones cut:
    slots follow it (but for giant rows, which come first). Without, rows of an old shard are laid out by size and hash.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"no law {law!r}")
    spark = docs.sparkSession
    old_shards = old_shards or shards
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"), F.pmod(F.coalesce(old_shard.cast("int"), F.lit(0)), F.lit(old_shards)).alias("old_shard"),
        *([order.cast("long").alias("place")] if order is not None else []),
    ).withColumn("w", F.col("size") if law == "bytes" else F.lit(1).cast("long"))
    # a layout group: an old shard's rows of sizes within a factor of 2
    group = F.col("old_shard") * 64 + (F.lit(0) if order is not None else F.lit(63) - F.floor(F.log2("w")).cast("int"))
    rows = written(rows.withColumn("grp", group), "rows")
    sizes = {r["old_shard"]: r["w"] for r in rows.groupBy("old_shard").agg(F.sum("w").alias("w")).collect()}
    supply = [sizes.get(i, 0) for i in range(old_shards)]
    room = even(sum(supply), shards)
    slots = [0] * shards

    # giant rows, one by one
    most = max(1, sum(supply) // (shards * GIANTS))
    by_size = [F.desc("w"), F.asc("old_shard"), F.asc_nulls_first("id"), F.asc("text_hash")]
    giant = rows.where(F.col("w") > most).withColumn("rank", F.row_number().over(Window.orderBy(*by_size)))  # fewer than shards * GIANTS
    giant_at = []
    for r in giant.select("rank", "w", "old_shard").orderBy("rank").collect() if law == "bytes" else ():
        i, w = r["old_shard"], r["w"]
        fits = [j for j in range(shards) if room[j] >= w]
        at = lambda j: ((cost[i][j] if cost else i != j), -room[j])
        j = min(fits, key=at) if fits else max(range(shards), key=lambda j: room[j])
        giant_at.append((r["rank"], j, slots[j]))
        slots[j] += 1
        room[j] -= w
        supply[i] -= w
    # a shard that giant rows have filled beyond its share takes nothing more; the others share what is left evenly
    over = sum(-x for x in room if x < 0)
    room = [max(0, x) for x in room]
    while over:
        j = max(range(shards), key=lambda j: room[j])
        cut = min(over, max(1, room[j] // 8))
        room[j] -= cut
        over -= cut

    if order is not None and cost is None:
        flow = sweep_flow(supply, room)
    else:
        found = min_cost_flow(supply, room, cost or [[int(i != j) for j in range(shards)] for i in range(old_shards)])
        flow = [[(j, found[i][j]) for j in sorted(range(shards), key=lambda j: (j != i, j)) if found[i][j]] for i in range(old_shards)]  # what stays comes first
    cuts = []
    for i, own in enumerate(flow):
        ends = [sum(n for _, n in own[: k + 1]) for k in range(len(own))]
        cuts.append((i, list(zip(ends, [j for j, _ in own]))))

    small = rows.where(F.col("w") <= most) if giant_at else rows
    numbered, blocks = in_blocks(small, "grp", ["id", "text_hash"], ["w"], place="place" if order is not None else None)
    offsets, before, last = [], 0, None
    for b in blocks:
        before = 0 if b["grp"] // 64 != last else before
        offsets.append((b["grp"], b["block"], before))
        before, last = before + b["w"], b["grp"] // 64
    at = spark.createDataFrame(offsets, "grp int, block int, before long")
    cut = spark.createDataFrame(cuts, "old_shard int, cuts array<struct<upto:long,shard:int>>")
    middle = F.col("before") + F.col("run_w") + (F.floor(F.col("w") / 2) if law == "bytes" else F.lit(0))
    laid = numbered.join(F.broadcast(at), ["grp", "block"]).join(F.broadcast(cut), "old_shard").withColumn("middle", middle)
    shard = F.coalesce(F.element_at(F.filter("cuts", lambda c: F.col("middle") < c["upto"]), F.lit(1))["shard"], F.element_at("cuts", -1)["shard"])
    laid = written(laid.select("id", "text_hash", "size", "text_crc32", "old_shard", "grp", "block", "rn", shard.alias("shard")), "laid")
    # slots: runs of one shard within a block are contiguous
    runs = laid.groupBy("shard", "grp", "block").agg(F.count("*").alias("n"), F.min("rn").alias("first")).collect()  # at most a few more than blocks
    starts = []
    for r in sorted(runs, key=lambda r: (r["shard"], r["grp"], r["block"])):
        starts.append((r["shard"], r["grp"], r["block"], slots[r["shard"]] - r["first"]))
        slots[r["shard"]] += r["n"]
    start = spark.createDataFrame(starts, "shard int, grp int, block int, start long")
    columns = ["id", "text_hash", "size", "text_crc32", "old_shard", "shard"]
    out = laid.join(F.broadcast(start), ["shard", "grp", "block"]).select(*columns, (F.col("start") + F.col("rn")).alias("slot"))
    if giant_at:
        table = spark.createDataFrame(giant_at, "rank int, shard int, slot long")
        out = out.unionByName(giant.join(F.broadcast(table), "rank").select(*columns, "slot"))
    out = written(out, "places")
    forget(rows, laid)
    return out.withColumnRenamed("id", id_col)


def resharded(docs: DataFrame, old_shard: Column, shards: int = SHARDS, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 50_000, old_shards: int | None = None, order: Column | None = None, cost: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """All rows of `docs` with their columns and then shard and slot (shard_ and slot_ if those are taken), dealt out so that a shard's rows lie in files of their own, in order."""
    names = docs.columns
    inside = [f"c{i}" for i in range(len(names))]
    own = docs.select("*", old_shard.alias("_old_"), (order if order is not None else F.lit(None)).alias("_at_")).toDF(*inside, "_old_", "_at_")
    ids = [inside[names.index(c)] for c in (id_col, text_col)]
    given = place(own, F.col("_old_"), shards, law, cost, old_shards, ids[0], ids[1], F.col("_at_") if order is not None else None)
    out = by_row(own.drop("_old_", "_at_"), given, ids[0], ids[1], ["shard", "slot"])
    out = out.repartition("_v_shard", F.floor(F.col("_v_slot") / rows_per_file)).sortWithinPartitions("_v_shard", "_v_slot")
    new = ["shard", "slot"]
    for i in range(2):
        while new[i] in names:
            new[i] += "_"
    return out.select(*inside, "_v_shard", "_v_slot").toDF(*names, *new)


def rewrite_affected(docs: DataFrame, old_shard: Column, path: str, shards: int = SHARDS, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", old_shards: int | None = None) -> list[int]:
    """Writes the shards whose rows change, as shard=<n> folders under `path`; returns which. The others' old files stay valid.

    Without old_shards, the old layout has `shards` shards, or as many more as the largest old shard of a row tells; all
    rows of a shard that vanishes move.
    """
    if old_shards is None:
        old_shards = max(shards, (docs.agg(F.max(old_shard.cast("int"))).first()[0] or 0) + 1)
    given = written(place(docs, old_shard, shards, law, old_shards=old_shards, id_col=id_col, text_col=text_col), "placed")
    moved = given.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    affected = sorted(r["s"] for r in moved.collect() if r["s"] < shards)
    if affected:
        out = by_row(docs, given.where(F.col("shard").isin(affected)), id_col, text_col, ["shard", "slot"])
        out.repartition("_v_shard", F.floor(F.col("_v_slot") / 50_000)).sortWithinPartitions("_v_slot").withColumnsRenamed({"_v_shard": "shard", "_v_slot": "slot"}).write.partitionBy("shard").parquet(path)
    forget(given)
    return affected
