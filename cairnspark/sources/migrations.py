"""Steps that bring older stores up to date. A step writes tables to new folders; one pointer swap makes them the store's.

1: chunks of text, lengths and offsets in characters, no node table. 2: chunks of bytes, lengths in bytes, node_entries.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnspark.operators import trees
from cairnspark.sources.pointer import Conflict

CURRENT = 2


def _to_bytes(read, write) -> None:
    chunks = read("chunks", "hash string, data string, len int")
    write("chunks", chunks.select("hash", F.col("data").cast("binary").alias("data"), F.octet_length("data").alias("len")))
    sizes = chunks.select("hash", F.octet_length("data").alias("len")).dropDuplicates(["hash"])
    old = read("file_chunks", "root string, ord int, off bigint, len int, hash string").select("root", "ord", "hash").join(sizes, "hash")
    before = Window.partitionBy("root").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # the chunks of one file
    write("file_chunks", old.select("root", "ord", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long").alias("off"), "len", "hash"))
    index = read("path_index", "path string, node_hash string, is_directory boolean, size bigint, n_children int, version_id string")
    write("node_entries", trees.node_entries(index, ["version_id"]).dropDuplicates(["hash", "kind"]))


STEPS = {1: _to_bytes}


def run(store, version: int) -> dict:
    """Migrates a store from `version` to CURRENT; returns its layout. Of two that try, one wins, and both see its result."""
    spark, folders = store.spark, {}

    def read(name: str, schema: str):
        path = f"{store.root}/{folders.get(name, name)}"
        return spark.read.schema(schema).parquet(path) if store._exists(path) else spark.createDataFrame([], schema)

    while version < CURRENT:
        made = {}

        def write(name: str, rows) -> None:
            made[name] = f"{name}-v{version + 1}"
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{store.root}/{made[name]}")

        STEPS[version](read, write)
        folders |= made
        version += 1
    layout = {"version": version, "folders": folders}
    try:
        store._schema().swap(0, layout)
    except Conflict:
        return store._schema().latest(layout)[1]
    return layout
