"""Working trees on disk: checkout of a version, status against it, and commits of staged paths."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.operators import chunking, diffs, ignore, trees
from cairnspark.sources.scratch import forget, kept
from cairnspark.sources.warehouse import Warehouse, read_tree


def file_roots(files: DataFrame, policy: chunking.Policy = chunking.Policy()) -> DataFrame:
    """path, hash (a file's Merkle root), size of files (path, content), without storing them."""
    return trees.merkle_roots(chunking.cdc_chunks(files.select("path", "content"), policy), ["path"]).select("path", F.col("root").alias("hash"), "size")


def local_tree(w: Warehouse, folder: str, matcher: ignore.Matcher | None = None, workspace: str | None = None) -> DataFrame:
    """path, hash, size of a folder's files that aren't ignored. With a workspace, hashes of files whose time and size are cached aren't computed again, and new ones are cached."""
    matcher = matcher or ignore.Matcher.from_tree(folder)
    files = read_tree(w.spark, folder, matcher)
    if workspace is None:
        return file_roots(files)
    cache = w.control.worktree.rows().where(F.col("workspace") == workspace).select("path", "mtime", "size", "hash")
    hit = files.drop("content").join(cache, ["path", "mtime", "size"])
    miss = kept(files.join(hit.select("path"), "path", "left_anti"), "misses")
    fresh = kept(file_roots(miss).join(miss.select("path", "mtime"), "path"), "hashes")
    out = kept(hit.select("path", "hash", "size").unionByName(fresh.select("path", "hash", "size")), "local")
    w.control.worktree.put(fresh.select(F.lit(workspace).alias("workspace"), "path", "mtime", "size", "hash"))
    forget(miss)
    return out


def status(w: Warehouse, name: str, folder: str, matcher: ignore.Matcher | None = None, workspace: str | None = None) -> DataFrame:
    return diffs.working_tree_status(w.tree(name), local_tree(w, folder, matcher, workspace))


def checkout(w: Warehouse, name: str, folder: str, force: bool = False, matcher: ignore.Matcher | None = None) -> dict[str, int]:
    """Makes a folder hold a version's files; how many were written, overwritten, skipped (equal), in conflict (kept; only without force) and deleted (only with force).

    Executors write the files, so on a cluster the folder must be on a disk they share. A file is replaced in one step.
    """
    folder = folder.removeprefix("file://").rstrip("/")
    os.makedirs(folder, exist_ok=True)
    plan = kept(diffs.checkout_plan(w.tree(name), local_tree(w, folder, matcher), force), "checkout")
    wanted = plan.where("action IN ('write', 'overwrite')")

    def run(batches):
        for b in batches:
            paths = b.column(0).to_pylist()
            for path, content in zip(paths, b.column(1) if b.num_columns > 1 else [None] * len(paths)):
                at = os.path.normpath(os.path.join(folder, path))
                if not at.startswith(folder + os.sep):
                    raise ValueError(f"outside of the folder: {path!r}")
                if content is None:
                    os.remove(at)
                    continue
                os.makedirs(os.path.dirname(at), exist_ok=True)
                own = f"{at}.{os.getpid()}.part"
                with open(own, "wb") as f:
                    f.write(content.as_py() or b"")
                os.replace(own, at)
            yield pa.RecordBatch.from_arrays([pa.array([len(paths)], pa.int64())], ["n"])

    # files that are in the way of a folder, or the reverse, go first
    plan.where("action = 'delete'").select("path").mapInArrow(run, "n long").collect()
    w.files(name, wanted).mapInArrow(run, "n long").collect()
    for top, _, _ in os.walk(folder, topdown=False) if force else ():
        if top != folder and not os.listdir(top):
            os.rmdir(top)
    counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    forget(plan)
    return {k: counts.get(k, 0) for k in ("write", "overwrite", "skip", "conflict", "delete")}


def commit_staged(w: Warehouse, folder: str, staged: DataFrame, message: str, ts: int, branch: str = "main") -> dict:
    """A commit of the branch's tree with staged paths as they are on disk; staged but missing is a deletion."""
    if staged.isEmpty():
        raise ValueError("nothing is staged")
    new = read_tree(w.spark, folder).join(staged.select("path").distinct(), "path", "left_semi").select("path", "content")
    stays = w.files(branch).join(staged.select("path"), "path", "left_anti") if branch in w.refs() else new.limit(0)
    return w.commit(stays.unionByName(new), message, ts, branch)
