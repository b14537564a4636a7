"""Chunks of files: fixed and content-defined cutting, deduplication, existence, reassembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cairnspark.functions.digest import digest, digest_children
from cairnspark.sources.shipping import ship


@dataclass(frozen=True)
class Policy:
    """Least, aimed-at and most bytes of a content-defined chunk."""

    least: int = 16_384
    average: int = 65_536
    most: int = 262_144


def fixed_chunks(files: DataFrame, size: int = 2048, by: tuple[str, ...] = ("path",), content: str = "content") -> DataFrame:
    """The file's key, ord, off (characters), len, hash and data of every slice of `size` characters; an empty file is one empty chunk."""
    n = F.greatest(F.ceil(F.length(content) / size).cast("int"), F.lit(1))
    cut = files.select(*by, F.col(content).alias("_c"), F.explode(F.sequence(F.lit(0), n - 1)).alias("ord"))
    data = F.substring(F.col("_c"), F.col("ord") * size + 1, F.lit(size))
    return cut.select(*by, "ord", (F.col("ord") * size).cast("long").alias("off"), F.length(data).alias("len"), digest(data).alias("hash"), data.alias("data"))


def _gears():
    """A 64-bit number for each byte value, from a fixed generator."""
    import numpy as np

    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def cut_points(data: bytes, policy: Policy = Policy()) -> list[int]:
    """Ends of the content-defined chunks: a rolling hash of 64 bytes, a strict mask before the average size and a loose one after it."""
    import numpy as np

    n = len(data)
    if n <= policy.least:
        return [n] if n else []
    h = _gears()[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16, 32):  # h[i] comes to depend on the 64 bytes up to i
        h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    bits = max(1, policy.average.bit_length() - 1)
    top = lambda b: (h >> np.uint64(64 - b)) == 0
    strict, loose = np.flatnonzero(top(min(60, bits + 1))) + 1, np.flatnonzero(top(max(1, bits - 1))) + 1
    out, start = [], 0
    while n - start > policy.least:
        middle, end = min(n, start + policy.average), min(n, start + policy.most)
        i = np.searchsorted(strict, start + policy.least)
        if i < len(strict) and strict[i] <= middle:
            start = int(strict[i])
        else:
            i = np.searchsorted(loose, max(middle, start + policy.least))
            start = int(loose[i]) if i < len(loose) and loose[i] <= end else end
        out.append(start)
    if start < n:
        out.append(n)
    return out


def cdc_chunks(files: DataFrame, policy: Policy = Policy(), key: str = "path", content: str = "content") -> DataFrame:
    """key, ord, off, len (bytes), hash, data of content-defined chunks; an empty file is one empty chunk. Cut points come from an Arrow scan, the rest from Catalyst."""
    import pyarrow as pa

    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            ends = [cut_points(x.as_py() or b"", policy) or [0] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends, pa.list_(pa.int64()))], ["key", "content", "ends"])

    kind = files.schema[key].dataType.simpleString()
    ends = files.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content")).mapInArrow(run, f"key {kind}, content binary, ends array<bigint>")
    cut = ends.select("key", "content", "ends", F.posexplode("ends").alias("ord", "end"))
    off = F.when(F.col("ord") == 0, F.lit(0)).otherwise(F.get("ends", F.col("ord") - 1))
    cut = cut.select("key", "content", "ord", off.cast("long").alias("off"), (F.col("end") - off).cast("int").alias("len"))
    data = F.substring(F.coalesce("content", F.lit(b"")), (F.col("off") + 1).cast("int"), F.col("len"))
    return cut.select(F.col("key").alias(key), "ord", "off", "len", digest(data).alias("hash"), data.alias("data"))


def flat_objects(chunks: DataFrame, by: list[str]) -> DataFrame:
    """by, object, children: a file as the flat list of its chunks' digests, under the digest of that list."""
    kids = chunks.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "hash"))), lambda c: c["hash"]).alias("children"))
    return kids.select(*by, digest_children(F.col("children")).alias("object"), "children")


def new_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """One row for each digest that the store doesn't hold."""
    return chunks.dropDuplicates(["hash"]).join(store.select("hash"), "hash", "left_anti")


def existing_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """The digests of `chunks` that the store holds."""
    return chunks.select("hash").distinct().join(store.select("hash"), "hash", "left_semi")


def with_first_seen(chunks: DataFrame, store: DataFrame | None, order: list[str]) -> DataFrame:
    """Adds is_new: the first row of its digest in upload order, and not in the store."""
    # the least row of each digest is found with partial sums, so that a chunk of which there are very many is no hot key
    least = chunks.groupBy("hash").agg(F.min(F.struct(*order)).alias("_least"))
    if store is not None:
        least = least.join(store.select("hash"), "hash", "left_anti")
    return chunks.join(least, "hash", "left").withColumn("is_new", F.coalesce(F.struct(*order) == F.col("_least"), F.lit(False))).drop("_least")


def dedup_stats(chunks: DataFrame, store: DataFrame | None, order: list[str], by: list[str] = ()) -> DataFrame:
    """total, new and dedup chunks and their bytes, of the whole upload or of each `by`."""
    seen = with_first_seen(chunks, store, order)
    known = ~F.col("is_new")
    return seen.groupBy(*by).agg(
        F.count("*").alias("total_chunks"), F.count_if("is_new").alias("new_chunks"), F.count_if(known).alias("dedup_chunks"),
        F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("total_bytes"), F.coalesce(F.sum(F.when(known, F.col("len"))), F.lit(0)).cast("long").alias("dedup_bytes"),
    )


def object_info(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """hash, found, size of digests asked for; size 0 if absent."""
    held = store.select("hash", F.col("len").cast("long").alias("size")).dropDuplicates(["hash"]).withColumn("_f", F.lit(True))
    return wanted.select("hash").distinct().join(held, "hash", "left").select("hash", F.coalesce("_f", F.lit(False)).alias("found"), F.coalesce("size", F.lit(0)).alias("size"))


def reassembled(descriptors: DataFrame, store: DataFrame, by: list[str]) -> DataFrame:
    """by, content, missing (chunks that the store doesn't hold): chunks in order, joined; strings or bytes as the store has them."""
    data = store.select("hash", "data").dropDuplicates(["hash"])
    got = descriptors.select(*by, "ord", "hash").join(data, "hash", "left").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ord", "data"))).alias("x"))
    parts = F.transform("x", lambda c: c["data"])
    if isinstance(store.schema["data"].dataType, BinaryType):  # bytes are joined as characters of one byte each
        content = F.encode(F.array_join(F.transform(parts, lambda d: F.decode(d, "ISO-8859-1")), ""), "ISO-8859-1")
    else:
        content = F.array_join(parts, "")
    return got.select(*by, content.alias("content"), F.size(F.filter(parts, lambda d: d.isNull())).alias("missing"))


def shard_of(h: Column, shards: int) -> Column:
    """The shard of a digest: its first byte modulo `shards`."""
    return (F.conv(F.substring(h, 1, 2), 16, 10).cast("int") % F.lit(max(1, shards))).cast("int")
