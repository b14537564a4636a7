"""Push, pull and clone between two warehouses: negotiate what is missing, copy it in the order that keeps the other side whole, then move refs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.digest import digest
from cairnspark.operators import history, sync
from cairnspark.sources.scratch import forget, kept
from cairnspark.sources.warehouse import RefError, Warehouse


class Refused(ValueError):
    """A quota is broken, or an object isn't what its digest says."""


def contents(w: Warehouse, versions: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table that versions (version_id) need."""
    index = w.table("path_index").join(versions.select("version_id"), "version_id", "left_semi")
    nodes = index.select(F.col("node_hash").alias("hash"), F.when(F.col("is_directory"), "directory").otherwise("file").alias("kind")).distinct()
    roots = kept(nodes.where("kind = 'file'").select(F.col("hash").alias("root")), "roots")
    files = w.table("file_chunks").join(roots, "root", "left_semi")
    # tree nodes below the roots, a level at a time
    level, trees = roots.select(F.col("root").alias("hash")), None
    while True:
        level = kept(w.table("tree_nodes").join(level, "hash", "left_semi"), "trees")
        if level.isEmpty():
            break
        trees = level if trees is None else trees.unionByName(level)
        level = level.select(F.explode("children").alias("hash")).distinct()
    trees = (trees if trees is not None else level).dropDuplicates(["hash"])
    return {
        "chunks": w.table("chunks").join(files.select("hash").distinct(), "hash", "left_semi"),
        "tree_nodes": trees,
        "file_chunks": files,
        "node_entries": w.table("node_entries").join(nodes, ["hash", "kind"], "left_semi"),
        "versions": w.table("versions").join(versions.select("version_id"), "version_id", "left_semi"),
        "path_index": index,
    }


KEYS = {"chunks": ["hash"], "tree_nodes": ["hash"], "file_chunks": ["root", "ord"], "node_entries": ["hash", "kind"], "versions": ["version_id"], "path_index": ["version_id"]}


def inventory(w: Warehouse, versions: DataFrame) -> DataFrame:
    """obj_type, hash of everything that versions need."""
    got = contents(w, versions)
    rows = [got["versions"].select(F.lit("version").alias("obj_type"), F.col("version_id").alias("hash")), got["tree_nodes"].select(F.lit("tree"), "hash"), got["node_entries"].select(F.lit("node"), "hash"), got["chunks"].select(F.lit("chunk"), "hash")]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.distinct()


def transfer(source: Warehouse, to: Warehouse, versions: DataFrame, session: str | None = None, session_limit: int = sync.SESSION_BYTES, object_limit: int = sync.OBJECT_BYTES, progress=None) -> dict[str, int]:
    """Copies what `to` lacks of versions; objects and bytes that were sent. progress(table, rows) is called after each table. Quotas and chunk digests are checked before anything is written."""
    if versions.isEmpty():
        return {"objects": 0, "bytes": 0}
    got, sent, missing = contents(source, versions), 0, {}
    for name, rows in got.items():
        missing[name] = kept(rows.join(to.table(name).select(*KEYS[name]).distinct(), KEYS[name], "left_anti"), f"send-{name}")
    chunks = missing["chunks"]
    if session is not None:
        chunks = sync.resume_filter(chunks, to.control.sent(session))
    over = sync.over_quota(chunks, session_limit, object_limit).first()
    if over["refused"]:
        raise Refused(f"{over['bytes']} bytes, {over['too_large']} objects too large")
    if not chunks.where(digest(F.col("data")) != F.col("hash")).isEmpty():
        raise Refused("a chunk isn't what its digest says")
    for name, rows in (missing | {"chunks": chunks}).items():  # what others refer to comes first
        n = rows.count()
        if n:
            to.append(name, rows, *(["version_id"] if name == "path_index" else []))
        if name == "chunks" and session is not None and n:
            to.control.note_sent(session, rows)
        sent += n if name not in ("file_chunks", "path_index") else 0
        if progress is not None:
            progress(name, n)
    forget(*missing.values())
    return {"objects": sent, "bytes": over["bytes"]}


def _history(w: Warehouse, tips: list[str], depth: int | None = None) -> DataFrame:
    starts = w.spark.createDataFrame([(0, t) for t in tips], "start int, version_id string")
    return history.ancestors(w.edges(), starts, depth)


def push(source: Warehouse, to: Warehouse, refs: list[str], now: int, remote: str = "origin", force: bool = False, **more) -> dict[str, str]:
    """Sends branches and tags: ref -> ok, up-to-date, stale or non-fast-forward. more: limits and progress of `transfer`. A session is noted on the other side, tracking refs on this one."""
    own, theirs = source.refs(), to.refs()
    for r in refs:
        if r not in own:
            raise RefError(f"no ref {r!r}")
    status = {r: "up-to-date" for r in refs if r in theirs and theirs[r]["target"] == own[r]["target"]}
    moving = [r for r in refs if r not in status]
    if moving:
        updates = source.spark.createDataFrame([(r, theirs[r]["target"] if r in theirs else None, own[r]["target"]) for r in moving], "ref string, old string, new string")
        forward = {r["ref"]: r["allowed"] for r in history.is_fast_forward(source.edges(), updates).collect()}  # a row a ref
        status |= {r: "non-fast-forward" for r in moving if not (forward[r] or force)}
        moving = [r for r in moving if r not in status]
    if moving:
        session = to.control.begin(remote, "push", now, {r: own[r]["target"] for r in moving})
        try:
            have = [x["target"] for x in theirs.values()]
            lacks = _history(source, [own[r]["target"] for r in moving]).select("version_id").distinct()
            known = history.ancestors(to.edges(), to.spark.createDataFrame([(0, t) for t in have], "start int, version_id string")).select("version_id")
            total = transfer(source, to, lacks.join(known, "version_id", "left_anti"), session, **more)
            for r in moving:
                try:
                    to.put_ref(r, own[r]["target"], own[r]["kind"], expected=... if force else theirs[r]["target"] if r in theirs else None)
                    status[r] = "ok"
                except RefError:
                    status[r] = "stale"
            to.control.complete(session, now, total["objects"], total["bytes"])
        except Exception as e:
            to.control.fail(session, now, str(e)[:500])
            raise
    done = [(remote, r, own[r]["target"], now) for r in refs if status[r] in ("ok", "up-to-date")]
    if done:
        source.control.remote_refs.put(done)
    return status


def pull(to: Warehouse, source: Warehouse, now: int, refs: list[str] | None = None, remote: str = "origin") -> dict[str, str]:
    """Fetches refs (all without a list): ref -> new, fast-forward, up-to-date or diverged. A diverged branch stays where it is; its tip is tracked."""
    theirs, own = source.refs(), to.refs()
    refs = sorted(theirs) if refs is None else refs
    for r in refs:
        if r not in theirs:
            raise RefError(f"no ref {r!r}")
    session = to.control.begin(remote, "pull", now, {r: theirs[r]["target"] for r in refs})
    try:
        wanted = _history(source, [theirs[r]["target"] for r in refs]).select("version_id").distinct()
        have = history.ancestors(to.edges(), to.spark.createDataFrame([(0, x["target"]) for x in own.values()], "start int, version_id string")).select("version_id")
        total = transfer(source, to, wanted.join(have, "version_id", "left_anti"))
        updates = to.spark.createDataFrame([(r, own[r]["target"] if r in own else None, theirs[r]["target"]) for r in refs], "ref string, old string, new string")
        forward = {r["ref"]: r["allowed"] for r in history.is_fast_forward(to.edges(), updates).collect()}  # a row a ref
        status = {}
        for r in refs:
            target = theirs[r]["target"]
            if r not in own:
                to.put_ref(r, target, theirs[r]["kind"], expected=None)
                status[r] = "new"
            elif own[r]["target"] == target:
                status[r] = "up-to-date"
            elif forward[r] and own[r]["kind"] == "branch":
                to.put_ref(r, target, expected=own[r]["target"])
                status[r] = "fast-forward"
            else:
                status[r] = "diverged"
        to.control.remote_refs.put([(remote, r, theirs[r]["target"], now) for r in refs])
        to.control.complete(session, now, total["objects"], total["bytes"])
        return status
    except Exception as e:
        to.control.fail(session, now, str(e)[:500])
        raise


def clone(source: Warehouse, to: Warehouse, refs: list[str] | None = None, depth: int | None = None) -> dict[str, int]:
    """Copies refs (all without a list) and what they reach. With a depth, versions nearer than it; those at the edge are noted as shallow."""
    theirs = source.refs()
    refs = sorted(theirs) if refs is None else refs
    for r in refs:
        if r not in theirs:
            raise RefError(f"no ref {r!r}")
    known = _history(source, [theirs[r]["target"] for r in refs], depth and depth - 1).select("version_id").distinct()
    total = transfer(source, to, known)
    if depth:
        edge = history.shallow_boundary(known, source.edges())
        if not edge.isEmpty():
            to.control.shallow.put(edge.select("version_id"))
    for r in refs:
        to.put_ref(r, theirs[r]["target"], theirs[r]["kind"])
    return total


def unshallow(source: Warehouse, to: Warehouse) -> dict[str, int]:
    """Fetches all that lies behind a shallow clone's edge, and forgets the edge."""
    edge = [r["version_id"] for r in to.control.shallow.rows().collect()]
    if not edge:
        return {"objects": 0, "bytes": 0}
    total = transfer(source, to, _history(source, edge).select("version_id").distinct())
    to.control.shallow.delete(F.lit(True))
    return total
