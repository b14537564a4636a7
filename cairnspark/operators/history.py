"""The version graph: history, ancestors, fast-forward, ahead and behind, shallow sets, refs, reachability.

edges: version_id, parent_id, ordinal (0: first parent). A graph of at most BROADCAST_EDGES edges, which are counted, is
broadcast, and each start's search runs within one task, however deep the graph. Beyond that a frontier goes a step a
round, as a join; each round is cut from its lineage.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cairnspark.sources.scratch import kept
from cairnspark.sources.shipping import ship

BROADCAST_EDGES = 200_000


def _parents(edges: DataFrame) -> dict | None:
    """Parents of each version, or None if there are more than BROADCAST_EDGES edges."""
    rows = edges.where("parent_id IS NOT NULL").select("version_id", "parent_id").distinct().limit(BROADCAST_EDGES + 1).collect()
    if len(rows) > BROADCAST_EDGES:
        return None
    out = defaultdict(list)
    for r in rows:
        out[r["version_id"]].append(r["parent_id"])
    return dict(out)


def _batches(rows, schema, size: int = 50_000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    yield _batch(held, schema)


def _batch(rows: list, schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema.names)


def first_parent_history(edges: DataFrame, tips: DataFrame, limit: int) -> DataFrame:
    """branch, version_id, depth: from each tip along first parents, newest first, at most `limit` versions."""
    first = edges.where("ordinal = 0").select("version_id", "parent_id")
    level = tips.select("branch", "version_id", F.lit(0).alias("depth"))
    parents = _parents(first)
    if parents is not None:
        ship(tips.sparkSession)
        held, schema = tips.sparkSession.sparkContext.broadcast(parents), to_arrow_schema(level.schema)

        def walked(batches):
            for b in batches:
                for branch, version in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for d in range(limit):
                        yield branch, version, d
                        version = held.value.get(version, [None])[0]
                        if version is None:
                            break

        return level.mapInArrow(lambda batches: _batches(walked(batches), schema), level.schema)
    out = level
    for d in range(1, limit):
        level = level.join(first, "version_id").select("branch", F.col("parent_id").alias("version_id"), F.lit(d).alias("depth"))
        out = out.unionByName(level)
        if d % 8 == 0:
            level = kept(level, "history")
            if level.isEmpty():
                break
    return out


def history_page(history: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """branch, version_id, depth, has_more of one page; depths are the order."""
    total = history.groupBy("branch").agg(F.count("*").alias("_n"))
    page = history.where((F.col("depth") >= offset) & (F.col("depth") < offset + limit))
    return page.join(total, "branch").select("branch", "version_id", "depth", (F.col("_n") > offset + limit).alias("has_more"))


def ancestors(edges: DataFrame, starts: DataFrame, depth: int | None = None, cut: DataFrame | None = None) -> DataFrame:
    """start, version_id, dist (fewest steps): everything reachable from each start, itself included.

    depth: at most that many steps. cut (start, version_id): versions not to enter. Null versions start nothing.
    """
    starts = starts.where("version_id IS NOT NULL")
    parents = _parents(edges)
    if parents is not None:
        return _searched(parents, starts, depth, cut)
    up = edges.select(F.col("version_id").alias("_v"), "parent_id").where("parent_id IS NOT NULL").distinct()
    level = starts.select("start", "version_id", F.lit(0).alias("dist")).distinct()
    if cut is not None:
        level = level.join(cut, ["start", "version_id"], "left_anti")
    seen = level = kept(level, "frontier")
    rounds = [seen]
    d = 0
    while depth is None or d < depth:
        d += 1
        nxt = level.join(up, level["version_id"] == up["_v"]).select("start", F.col("parent_id").alias("version_id")).distinct()
        # a version on the frontier was reached at most now; anything seen before is dropped
        nxt = nxt.join(seen.select("start", "version_id"), ["start", "version_id"], "left_anti")
        if cut is not None:
            nxt = nxt.join(cut, ["start", "version_id"], "left_anti")
        level = kept(nxt.withColumn("dist", F.lit(d)), "frontier")
        if level.isEmpty():
            break
        rounds.append(level)
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.unionByName(r)
    return seen


def _searched(parents: dict, starts: DataFrame, depth: int | None, cut: DataFrame | None) -> DataFrame:
    ship(starts.sparkSession)
    tips = starts.groupBy("start").agg(F.collect_set("version_id").alias("tips"))  # versions of a graph that is broadcast
    if cut is not None:
        tips = tips.join(cut.groupBy("start").agg(F.collect_set("version_id").alias("cut")), "start", "left")
    else:
        tips = tips.withColumn("cut", F.lit(None).cast(tips.schema["tips"].dataType))
    held = starts.sparkSession.sparkContext.broadcast(parents)
    out = starts.select("start", "version_id", F.lit(0).alias("dist")).schema
    schema = to_arrow_schema(out)

    def searched(batches):
        up = held.value
        for b in batches:
            for start, tip, cut in zip(*(c.to_pylist() for c in b.columns)):
                cut = set(cut or ())
                seen, level, d = {}, set(tip) - cut, 0
                while level:
                    seen.update(dict.fromkeys(level, d))
                    if d == depth:
                        break
                    d += 1
                    level = {p for v in level for p in up.get(v, ()) if p not in seen and p not in cut}
                yield from ((start, v, d) for v, d in seen.items())

    return tips.select("start", "tips", "cut").mapInArrow(lambda batches: _batches(searched(batches), schema), out)


def is_fast_forward(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """ref, allowed for updates (ref, old, new): true if old is empty (null, "" or zeros), equal to new, or its ancestor."""
    known = ancestors(edges, updates.select(F.col("ref").alias("start"), F.col("new").alias("version_id")))
    hit = known.select(F.col("start").alias("ref"), F.col("version_id").alias("old")).withColumn("_hit", F.lit(True))
    empty = F.col("old").isNull() | F.col("old").cast("string").rlike("^0*$")
    return updates.join(hit, ["ref", "old"], "left").select("ref", (empty | F.coalesce(F.col("old") == F.col("new"), F.lit(False)) | F.col("_hit").isNotNull()).alias("allowed"))


def ahead_behind(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """ref, ahead, behind for pairs (ref, local, remote): sizes of the two differences of ancestor sets; a null side has none."""
    mine = ancestors(edges, pairs.select(F.col("ref").alias("start"), F.col("local").alias("version_id"))).select("start", "version_id", F.lit(1).alias("m"))
    theirs = ancestors(edges, pairs.select(F.col("ref").alias("start"), F.col("remote").alias("version_id"))).select("start", "version_id", F.lit(1).alias("t"))
    both = mine.join(theirs, ["start", "version_id"], "full_outer").groupBy(F.col("start").alias("ref")).agg(F.count_if(F.col("t").isNull()).alias("ahead"), F.count_if(F.col("m").isNull()).alias("behind"))
    return pairs.select("ref").distinct().join(both, "ref", "left").select("ref", F.coalesce("ahead", F.lit(0)).alias("ahead"), F.coalesce("behind", F.lit(0)).alias("behind"))


def shallow(edges: DataFrame, tips: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Versions nearer than `depth`, and the boundary at exactly that distance; depth 0 has no limit and no boundary."""
    known = ancestors(edges, tips, depth or None)
    if not depth:
        return known, known.limit(0)
    return known.where(F.col("dist") < depth), known.where(F.col("dist") == depth)


def shallow_boundary(received: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents of received versions that weren't received."""
    return edges.join(received.select("version_id"), "version_id", "left_semi").select(F.col("parent_id").alias("version_id")).where("version_id IS NOT NULL").distinct().join(received.select("version_id"), "version_id", "left_anti")


def resolve_refs(asked: DataFrame, versions: DataFrame, refs: DataFrame) -> DataFrame:
    """asked, version_id: an exact version id first, then a ref's target, else null."""
    v = versions.select(F.col("version_id").alias("asked"), F.col("version_id").alias("_v")).distinct()
    r = refs.select(F.col("name").alias("asked"), F.col("target").alias("_t"))
    return asked.join(v, "asked", "left").join(r, "asked", "left").select("asked", F.coalesce("_v", "_t").alias("version_id"))


def list_refs(refs: DataFrame, kind: str | None = None) -> DataFrame:
    """Refs of a kind (branch or tag); any other filter lists all."""
    return refs.where(F.col("kind") == kind) if kind in ("branch", "tag") else refs


def reachable_objects(want: DataFrame, edges: DataFrame, roots: DataFrame, contents: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """start, obj_type, hash: versions reachable from want (start, version_id) but not by way of `cut`, and what their trees hold.

    roots: version_id, root. contents: root, obj_type, hash (a tree's nodes and chunks). Unknown versions are still listed.
    """
    known = ancestors(edges, want, cut=cut)
    versions = known.select("start", F.lit("version").alias("obj_type"), F.col("version_id").cast("string").alias("hash"))
    trees = known.join(roots, "version_id").select("start", "root").distinct().join(contents, "root").select("start", "obj_type", "hash").distinct()
    return versions.unionByName(trees)


def version_dtos(versions: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root, message, ts, parents (strings, in order) of versions, as an interface shows them."""
    p = edges.groupBy(F.col("version_id").cast("string").alias("version_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col("parent_id").cast("string").alias("p")))), lambda x: x["p"]).alias("parents"))
    return versions.join(p, "version_id", "left").select(F.col("version_id").alias("id"), "root", "message", "ts", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))


def ref_dtos(refs: DataFrame) -> DataFrame:
    """name, kind (lower case), target of refs, as an interface shows them."""
    return refs.select("name", F.lower("kind").alias("kind"), F.col("target").cast("string").alias("target"))


def parsed_parents(text: Column) -> Column:
    """Parent ids from a list with commas: empty parts go, blanks around an id too."""
    return F.transform(F.filter(F.split(text, ","), lambda p: p != ""), lambda p: F.trim(p))
