"""Comparing trees: version difference, chunk statistics, working-tree status, checkout plan, partial commit. Each is one outer join on path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.digest import digest, parse_hash


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    o = old.select("path", F.col("hash").alias("old_hash"))
    n = new.select("path", F.col("hash").alias("new_hash"))
    return o.join(n, "path", "full_outer")


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, kind (added, removed, modified), old_hash, new_hash of files that differ."""
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("modified")
    return _sides(old, new).where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select("path", kind.alias("kind"), "old_hash", "new_hash")


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(F.count("*").alias("n"))


def chunk_stats(old: DataFrame, new: DataFrame, old_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """One row: added_chunks, removed_chunks, unchanged_chunks. Modified files count distinct chunks, others all of theirs; equal trees count nothing."""
    diff = version_diff(old, new)
    modified = diff.where("kind = 'modified'").select("path")
    o = old_chunks.join(modified, "path", "left_semi").select("path", "hash").distinct().withColumn("o", F.lit(1))
    n = new_chunks.join(modified, "path", "left_semi").select("path", "hash").distinct().withColumn("n", F.lit(1))
    both = o.join(n, ["path", "hash"], "full_outer").agg(
        F.count_if(F.col("o").isNull()).alias("a"), F.count_if(F.col("n").isNull()).alias("r"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("u"))
    kinds = _sides(old, new).select("path", F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "same").alias("kind"))
    whole = (
        new_chunks.groupBy("path").agg(F.count("*").alias("c")).join(kinds.where("kind IN ('added', 'same')"), "path")
        .unionByName(old_chunks.groupBy("path").agg(F.count("*").alias("c")).join(kinds.where("kind = 'removed'"), "path"))
        .agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("c"))), F.lit(0)).alias(f"w_{k}") for k in ("added", "removed", "same")])
    )
    any_diff = diff.agg((F.count("*") > 0).alias("differs"))
    all_three = both.join(whole).join(any_diff)  # three single rows
    pick = lambda c: F.when(F.col("differs"), c).otherwise(0).cast("long")
    return all_three.select(pick(F.col("a") + F.col("w_added")).alias("added_chunks"), pick(F.col("r") + F.col("w_removed")).alias("removed_chunks"), pick(F.col("u") + F.col("w_same")).alias("unchanged_chunks"))


def with_cached_hashes(local: DataFrame, cache: DataFrame) -> DataFrame:
    """local with every null hash filled in: from the cache where (path, mtime, size) are equal and its hash is one, else from the content."""
    known = cache.select("path", "mtime", "size", parse_hash(F.col("hash")).alias("_cached"))
    fresh = digest(F.col("content")) if "content" in local.columns else F.raise_error(F.concat(F.lit("neither a cached hash nor content: "), F.col("path"))).cast("string")
    return local.join(known, ["path", "mtime", "size"], "left").withColumn("hash", F.coalesce("hash", "_cached", fresh)).drop("_cached")


def working_tree_status(head: DataFrame, local: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """path, change (untracked, modified, deleted), local_size, head_size; unchanged files don't show.

    local: path, hash, size, and with a cache mtime and content; for a null hash a cached one of equal (path, mtime, size)
    stands in, and on a miss the content is hashed.
    """
    if cache is not None:
        local = with_cached_hashes(local, cache)
    h = head.select("path", F.col("hash").alias("hh"), F.col("size").alias("head_size"))
    w = local.select("path", F.col("hash").alias("lh"), F.col("size").alias("local_size"), F.lit(True).alias("_there"))
    change = F.when(F.col("hh").isNull(), "untracked").when(F.col("_there").isNull(), "deleted").when(~F.col("hh").eqNullSafe(F.col("lh")), "modified")
    return h.join(w, "path", "full_outer").select("path", change.alias("change"), "local_size", "head_size").where("change IS NOT NULL")


def checkout_plan(target: DataFrame, local: DataFrame, force: bool) -> DataFrame:
    """path, action: skip (equal), write, conflict (differs, kept), overwrite, delete (force only, local only)."""
    t = target.select("path", F.col("hash").alias("th"))
    w = local.select("path", F.col("hash").alias("lh"))
    action = F.when(F.col("lh").isNull(), "write").when(F.col("th").isNull(), "delete" if force else None).when(F.col("th") == F.col("lh"), "skip").otherwise("overwrite" if force else "conflict")
    return t.join(w, "path", "full_outer").select("path", action.alias("action")).where("action IS NOT NULL")


def partial_commit(head: DataFrame, staged: DataFrame, local: DataFrame) -> DataFrame:
    """The new tree (path, hash, size): head without staged paths, and staged paths as they are on disk; staged but missing is a deletion."""
    if staged.isEmpty():
        raise ValueError("nothing is staged")
    carried = head.select("path", "hash", "size").join(staged.select("path"), "path", "left_anti")
    out = carried.unionByName(local.select("path", "hash", "size").join(staged.select("path").distinct(), "path", "left_semi"))
    if out.isEmpty():
        raise ValueError("the new tree would be empty")
    return out
