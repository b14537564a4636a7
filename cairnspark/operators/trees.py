"""Merkle trees over chunks, and directory trees over files: ordered aggregation, a level at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.digest import digest_children, digest_directory
from cairnspark.sources.scratch import kept

FAN_OUT = 64


def merkle_levels(chunks: DataFrame, by: list[str], fan_out: int = FAN_OUT, write: bool = False) -> list[DataFrame]:
    """Levels from the leaves up: by, ord, h, children. A node alone in its group goes up unwrapped. write: each level is a table, for callers that read several."""
    level = chunks.select(*by, F.col("ord").cast("long").alias("ord"), F.col("hash").alias("h"), F.array().cast("array<string>").alias("children"))
    most = (chunks.agg(F.max("ord")).first()[0] or 0) + 1
    out = [level]
    while most > 1:
        group = F.floor(F.col("ord") / fan_out)
        level = (
            level.groupBy(*by, group.alias("ord")).agg(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("o"), "h"))).alias("x"))  # fan_out entries at most
            .select(*by, "ord", F.transform("x", lambda e: e["h"]).alias("hs"))
            .select(*by, "ord", F.when(F.size("hs") == 1, F.get("hs", F.lit(0))).otherwise(digest_children(F.col("hs"))).alias("h"), F.when(F.size("hs") == 1, F.array().cast("array<string>")).otherwise(F.col("hs")).alias("children"))
        )
        if write:
            level = kept(level, "merkle")
        out.append(level)
        most = -(-most // fan_out)
    return out


def merkle_roots(chunks: DataFrame, by: list[str], fan_out: int = FAN_OUT) -> DataFrame:
    """by, root, size, chunk_count."""
    top = merkle_levels(chunks, by, fan_out)[-1].select(*by, F.col("h").alias("root"))
    size = chunks.groupBy(*by).agg(F.sum("len").cast("long").alias("size"), F.count("*").cast("int").alias("chunk_count"))
    return top.join(size, by)


def tree_nodes(chunks: DataFrame, by: list[str], fan_out: int = FAN_OUT) -> DataFrame:
    """hash, kind (leaf or internal), children: every node once."""
    levels = merkle_levels(chunks, by, fan_out, write=True)
    nodes = levels[0].select(F.col("h").alias("hash"), F.lit("leaf").alias("kind"), "children")
    for level in levels[1:]:
        nodes = nodes.unionByName(level.where(F.size("children") > 0).select(F.col("h").alias("hash"), F.lit("internal").alias("kind"), "children"))
    return nodes.dropDuplicates(["hash"])


def rehydrated(roots: DataFrame, nodes: DataFrame, depth: int, by: list[str]) -> DataFrame:
    """by, leaves: the ordered leaf digests under each root; a missing node counts as a leaf."""
    level = roots.select(*by, F.col("root").alias("hash"), F.array().cast("array<int>").alias("at"))
    inner = nodes.where("kind = 'internal'").select("hash", F.col("children").alias("_kids"))
    for _ in range(depth):
        down = level.join(inner, "hash", "left").select(*by, "at", F.col("hash").alias("own"), F.posexplode(F.coalesce("_kids", F.array("hash"))).alias("i", "hash"))
        level = down.select(*by, "hash", F.concat("at", F.array("i")).alias("at"))
    return level.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda e: e["hash"]).alias("leaves"))


def directory_tree(files: DataFrame) -> DataFrame:
    """path, node_hash, is_directory, size, n_children of every file and directory; the root is "". files: path, hash, size.

    Of equal paths the later (by `seq`, if it is there, else the larger hash) wins. A path that is a file and a directory is
    the directory. A null path or one with an empty part, and no file at all: ValueError. Each level is written once.
    """
    last = F.max_by(F.struct("hash", "size"), F.col("seq") if "seq" in files.columns else F.col("hash")).alias("x")
    files = files.groupBy("path").agg(last).select("path", F.col("x.hash").alias("hash"), F.col("x.size").alias("size"))
    depth = F.size(F.split("path", "/"))
    nodes = kept(files.select("path", F.col("hash").alias("node_hash"), F.lit(False).alias("is_directory"), F.col("size").cast("long").alias("size"), F.lit(0).alias("n_children"), depth.alias("depth")), "level")
    bad = F.col("path").isNull() | F.concat(F.lit("/"), F.col("path"), F.lit("/")).contains("//")
    found = nodes.agg(F.max("depth").alias("most"), F.min(F.when(bad, F.coalesce("path", F.lit("null")))).alias("bad")).first()
    if found["bad"] is not None:
        raise ValueError(f"not a path of a file: {found['bad']!r}")
    if found["most"] is None:
        raise ValueError("a tree needs a file")
    most, out = found["most"], nodes
    below = nodes.where(F.col("depth") == most)
    for d in range(most, 0, -1):
        parent = F.when(F.col("depth") == 1, "").otherwise(F.substring_index("path", "/", d - 1))
        dirs = (
            below.groupBy(parent.alias("parent")).agg(F.collect_list(F.struct(F.substring_index("path", "/", -1).alias("name"), F.col("node_hash").alias("hash"))).alias("e"))
            .select(F.col("parent").alias("path"), digest_directory(F.col("e")).alias("node_hash"), F.lit(True).alias("is_directory"), F.lit(0).cast("long").alias("size"), F.size("e").alias("n_children"), F.lit(d - 1).alias("depth"))
        )
        dirs = kept(dirs, "level")
        own = nodes.where(F.col("depth") == d - 1).join(dirs.select("path"), "path", "left_anti") if d > 1 else None
        below = dirs if own is None else dirs.unionByName(own)
        out = out.unionByName(dirs)
    return out.groupBy("path").agg(F.max_by(F.struct("node_hash", "is_directory", "size", "n_children"), "is_directory").alias("x")).select("path", "x.*")


def node_entries(index: DataFrame, by: list[str] = ()) -> DataFrame:
    """hash, kind (file or directory), size, children (sorted structs of name and hash; empty for files) of every node of a path index, or of one for each `by`, once."""
    parent = F.when(F.instr("path", "/") == 0, "").otherwise(F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)"))
    kids = index.where("path <> ''").groupBy(*by, parent.alias("path")).agg(F.sort_array(F.collect_list(F.struct(F.substring_index("path", "/", -1).alias("name"), F.col("node_hash").alias("hash")))).alias("children"))
    none = F.array().cast("array<struct<name:string,hash:string>>")
    nodes = index.join(kids, [*by, "path"], "left").select(F.col("node_hash").alias("hash"), F.when(F.col("is_directory"), "directory").otherwise("file").alias("kind"), "size", F.when(F.col("is_directory"), F.coalesce("children", none)).otherwise(none).alias("children"))
    return nodes.dropDuplicates(["hash", "kind"])


def walked(roots: DataFrame, nodes: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, path, node_hash, is_directory, size, n_children, missing under each root (by, root), from the node table alone: a level at a time.

    A node that the table lacks is listed as missing, with nothing below it.
    """
    known = nodes.select(F.col("hash").alias("node_hash"), F.lit(True).alias("_known"), (F.col("kind") == "directory").alias("_dir"), "size", "children")
    # one digest may stand for a file and a directory in theory only: the directory counts
    known = known.groupBy("node_hash").agg(F.max_by(F.struct("_known", "_dir", "size", "children"), "_dir").alias("x")).select("node_hash", "x.*")
    level = roots.select(*by, F.lit("").alias("path"), F.col("root").alias("node_hash"))
    out = None
    while True:
        level = kept(level.join(known, "node_hash", "left").select(*by, "path", "node_hash", F.coalesce("_dir", F.lit(False)).alias("is_directory"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(F.size("children"), F.lit(0)).alias("n_children"), F.col("_known").isNull().alias("missing"), "children"), "walk")
        if level.isEmpty():
            break
        out = level.drop("children") if out is None else out.unionByName(level.drop("children"))
        child = F.when(F.col("path") == "", F.col("c.name")).otherwise(F.concat_ws("/", "path", "c.name"))
        level = level.where("is_directory").select(*by, "path", F.explode("children").alias("c")).select(*by, child.alias("path"), F.col("c.hash").alias("node_hash"))
    return level.drop("children") if out is None else out


def upserted(index: DataFrame, entries: DataFrame) -> DataFrame:
    """A path index with entries put in; an entry of a path that is there takes its place, of several the last by node_hash."""
    new = entries.groupBy("path").agg(F.max_by(F.struct(*[c for c in index.columns if c != "path"]), "node_hash").alias("x")).select("path", "x.*")
    return index.join(new.select("path"), "path", "left_anti").unionByName(new.select(*index.columns))


def list_directory(index: DataFrame, directory: str) -> DataFrame:
    """name, path, node_hash, is_directory, size of the immediate children."""
    prefix = f"{directory}/" if directory else ""
    rest = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    return index.where(F.col("path").startswith(prefix) & (F.col("path") != directory) & (F.instr(rest, "/") == 0)).select(F.substring_index("path", "/", -1).alias("name"), "path", "node_hash", "is_directory", "size")


def resolve_paths(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked.path with node_hash and is_directory, null if nothing is there; empty components are skipped."""
    clean = F.array_join(F.filter(F.split("path", "/"), lambda p: p != ""), "/")
    return asked.select("path", clean.alias("_clean")).join(index.select(F.col("path").alias("_clean"), "node_hash", "is_directory"), "_clean", "left").select("path", "node_hash", "is_directory")


def node_metadata(index: DataFrame) -> DataFrame:
    """path, kind, size, children (sorted names joined with commas; null for files)."""
    kids = index.where("path <> ''").groupBy(F.when(F.instr("path", "/") == 0, "").otherwise(F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")).alias("path")).agg(F.array_join(F.sort_array(F.collect_list(F.substring_index("path", "/", -1))), ",").alias("children"))
    return index.join(kids, "path", "left").select("path", F.when(F.col("is_directory"), "directory").otherwise("file").alias("kind"), "size", "children")


def absolute(root: str, path: Column) -> Column:
    """A relative path under a root."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.ltrim(path, F.lit("/")))
