"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are put in a fixed random order and cut into blocks of `block_rows`. A source of weight w is a
periodic task: its block j (from 0) has the pseudo-release floor(j / w) and the pseudo-deadline ceil((j + 1) / w), in
slots of one block. Of the blocks released, each slot takes the one with the earliest deadline. As weights sum to 1, no
deadline is missed, so after any number of slots every source deviates from its target by less than one block.

Weights are exact: whole shares of their sum, as their decimals say. Where the shares sum to QUANTA at most, the schedule
repeats after so many slots, and one period is computed; otherwise every block that there is gets its slot, so that the
driver's work and memory grow with the blocks (one for each `block_rows` rows), not with the slots. Either way a row's
slot follows from its source and number. Slots that no block takes stay empty, as when a source has run out; the others
stay within a block of their targets. Positions number the rows that are there, so every row is placed exactly once.

With a second column (`within_col`), the rows of each of its values are spread evenly over their source's rows: within
the source, they are scheduled the same way, with their numbers of rows as weights, so after any number of its slots each
value deviates from its share by less than one block. The sources' places don't change.

Defined cases. Null source: the source "". Sources that have no target get the smallest target; with no targets at all,
weights are the square roots of the sources' row counts. Sources of weight 0 come after all others, one after another.
Negative or infinite weights: ValueError. Null ids and texts: ordinary rows. Repeated rows: a place each.
Null in `within_col`: the value "". Empty table: no rows. More than MAX_SOURCES sources: ValueError. Extra columns pass through `mixed`.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, isfinite, lcm, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import in_blocks
from .runtime import forget, in_full, partitions, ship, written

BLOCK_ROWS = 16
QUANTA = 1_000
MAX_SOURCES = 2_000
BROADCAST_ROWS = 1_000_000


def exact(weights: list[float]) -> list[int]:
    """Whole shares in exactly the proportions of the weights, which are taken as their shortest decimals."""
    if not all(isfinite(w) and w >= 0 for w in weights):
        raise ValueError("weights must be finite and not negative")
    whole = [Fraction(repr(float(w))) for w in weights]
    by = lcm(*[w.denominator for w in whole])
    shares = [int(w * by) for w in whole]
    least = gcd(*shares) or 1
    return [s // least for s in shares]


def quantised(weights: list[float], quanta: int) -> list[int]:
    """Whole shares of `quanta`, at least 1 each, near the weights: for callers that want a given period, the mix doesn't."""
    total = sum(weights)
    spare = quanta - len(weights)
    exact = [w / total * spare for w in weights]
    out = [1 + int(x) for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (int(exact[i]) - exact[i], i))[: quanta - sum(out)]:
        out[i] += 1
    return out


def period(shares: list[int], blocks: list[int] | None = None) -> list[np.ndarray]:
    """For each source, the slots of its first `blocks` blocks, earliest deadline first; without them, of one period of sum(shares) slots.

    Fewer blocks than a period's leave slots empty, but no deadline is missed for that.
    """
    total = sum(shares)
    blocks = shares if blocks is None else blocks
    places = [np.zeros(n, np.int64) for n in blocks]
    done = [0] * len(shares)
    waiting = [(0, i) for i in range(len(shares)) if blocks[i]]  # by release
    ready: list[tuple[int, int]] = []  # by deadline
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[i] + 1) * total // shares[i]), i))
        deadline, i = heapq.heappop(ready)
        assert t < deadline, "a deadline was missed"
        places[i][done[i]] = t
        done[i] += 1
        if done[i] < blocks[i]:
            heapq.heappush(waiting, (done[i] * total // shares[i], i))
        t += 1
    return places


@dataclass
class Plan:
    rows: list[int]
    block_rows: int
    shares: list[int]
    places: list[np.ndarray]
    repeats: bool

    @classmethod
    def of(cls, rows: list[int], weights: list[float], block_rows: int = BLOCK_ROWS, quanta: int = QUANTA) -> "Plan":
        """The plan of exactly these weights; a period of over `quanta` slots isn't repeated, but each block is scheduled."""
        shares = exact(weights) if rows else []
        if all(shares) and sum(shares) <= quanta:
            return cls(rows, block_rows, shares, period(shares), True)
        blocks = [-(-n // block_rows) for n in rows]
        places = period(shares, [n if s else 0 for n, s in zip(blocks, shares)])
        end = max((int(p[-1]) + 1 for p in places if len(p)), default=0)
        for i, s in enumerate(shares):
            if not s:
                places[i] = np.arange(end, end + blocks[i])
                end += blocks[i]
        return cls(rows, block_rows, shares, places, False)

    def slots(self, source: int, block: np.ndarray) -> np.ndarray:
        """The slot of each block of a source."""
        if not self.repeats:
            return self.places[source][block]
        return block // self.shares[source] * sum(self.shares) + self.places[source][block % self.shares[source]]

    def rows_before(self, slot: np.ndarray) -> np.ndarray:
        """How many rows the slots before each of these hold."""
        total = sum(self.shares)
        cycle, rest = (slot // total, slot % total) if self.repeats else (None, slot)
        out = np.zeros(len(slot), np.int64)
        for n, share, places in zip(self.rows, self.shares, self.places):
            before = np.searchsorted(places, rest) + (cycle * share if self.repeats else 0)
            out += np.minimum(n, before * self.block_rows)
        return out


def placed(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", within_col: str | None = None) -> DataFrame:
    """One row for each row: id, text_hash, source, seq (its number in its source), block, slot, position (gapless from 0).

    The driver gets a row for each source and value of `within_col`: few values, such as languages, are meant.
    """
    spark = docs.sparkSession
    ship(spark)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")
    part = F.struct(source, (F.coalesce(F.col(within_col).cast("string"), F.lit("")) if within_col else F.lit("")).alias("kind")).alias("part")
    narrow = written(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), source, part), "sources")
    counts = {r["source"]: r["n"] for r in narrow.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = sorted(counts)
    if weights:
        least = min(weights.values())
        target = [weights.get(s, least) for s in names]
    else:
        target = [sqrt(counts[s]) for s in names]
    plan = Plan.of([counts[s] for s in names], target, block_rows)
    numbered, blocks = in_blocks(narrow, "part", ["id", "text_hash"])
    offsets, before, last, kinds = [], 0, None, [{} for _ in names]
    index = {s: i for i, s in enumerate(names)}
    for r in blocks:
        before = 0 if r["part"] != last else before
        own = kinds[index[r["part"]["source"]]]
        own[r["part"]["kind"]] = own.get(r["part"]["kind"], 0) + r["n"]
        offsets.append((r["part"], r["block"], before))
        before, last = before + r["n"], r["part"]
    inner = [Plan.of(list(n.values()), list(n.values()), block_rows) for n in kinds]
    where = {(s, kind): (i, k) for i, s in enumerate(names) for k, kind in enumerate(kinds[i])}
    held = spark.sparkContext.broadcast((plan, inner, where))

    def run(batches):
        plan, inner, where = held.value
        for b in batches:
            nth = b.column(4).to_numpy(zero_copy_only=False)
            at = np.array([where[p] for p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], np.int64).reshape(-1, 2)
            own, seq = at[:, 0], np.zeros(len(nth), np.int64)
            for i, k in np.unique(at, axis=0):
                rows = (own == i) & (at[:, 1] == k)
                seq[rows] = inner[i].rows_before(inner[i].slots(k, nth[rows] // block_rows)) + nth[rows] % block_rows
            block, slot = seq // block_rows, np.zeros(len(seq), np.int64)
            for i in np.unique(own):
                slot[own == i] = plan.slots(i, block[own == i])
            each, back = np.unique(slot, return_inverse=True)
            position = plan.rows_before(each)[back] + seq % block_rows
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(seq), pa.array(block), pa.array(slot), pa.array(position)], [*b.schema.names[:3], "seq", "block", "slot", "position"])

    table = spark.createDataFrame(offsets, "part struct<source:string,kind:string>, block int, before long")
    nth = numbered.join(F.broadcast(table), ["part", "block"]).select("id", "text_hash", "source", "part.kind", (F.col("before") + F.col("rn")).alias("nth"))
    out = written(nth.mapInArrow(run, "id long, text_hash long, source string, seq long, block long, slot long, position long"), "places")
    forget(narrow)
    return out.withColumnRenamed("id", id_col)


def by_row(docs: DataFrame, given: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """`docs` with the columns of `given`, which has a row for each of theirs with its id and text_hash. Rows of equal id and text get the values in the order of all their columns."""
    keys = [f"_{c}" for c in ("id", "hash", "nth")]
    given = written(given.select(F.coalesce(F.col(id_col), F.lit(0)).alias(keys[0]), F.col(id_col).isNull().alias("_null"), F.col("text_hash").alias(keys[1]), *[F.col(c).alias(f"_v_{c}") for c in columns]), "given")
    own = docs.withColumn(keys[0], F.coalesce(F.col(id_col).cast("long"), F.lit(0))).withColumn("_null", F.col(id_col).isNull()).withColumn(keys[1], F.xxhash64(F.col(text_col).cast("string")))
    on = [keys[0], "_null", keys[1]]
    sizes = given.groupBy(*on).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    if (sizes["most"] or 0) > 1:
        w = Window.partitionBy(*on)
        given = given.withColumn(keys[2], F.row_number().over(w.orderBy(*[f"_v_{c}" for c in columns])))
        own = own.withColumn(keys[2], F.row_number().over(w.orderBy(*in_full(docs))))
        on.append(keys[2])
    if (sizes["rows"] or 0) <= BROADCAST_ROWS:
        given = F.broadcast(given)
    return own.join(given, on).select(*docs.columns, *[F.col(f"_v_{c}") for c in columns])


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", within_col: str | None = None) -> DataFrame:
    """All rows of `docs` with their columns, laid out in the order of the mix: partitions are runs of it, and sorted."""
    names = docs.columns
    inside = [f"c{i}" for i in range(len(names))]
    own = docs.toDF(*inside)
    ids = [inside[names.index(c)] for c in (id_col, source_col, text_col)]
    given = placed(own, weights, block_rows, *ids, within_col=inside[names.index(within_col)] if within_col else None)
    out = by_row(own, given, ids[0], ids[2], ["position"])
    return out.repartitionByRange(partitions(docs.sparkSession), "_v_position").sortWithinPartitions("_v_position").select(*inside).toDF(*names)
