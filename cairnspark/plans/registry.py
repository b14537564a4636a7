"""All queries of the engine by name, and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions import digest as dg
from cairnspark.operators import bloom, chunking, diffs, history, ignore, sync, trees, upkeep
from cairnspark.plans import inputs as i

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- SQL building blocks (DuckDB) ---
_FILES = "f AS (SELECT concat_ws('/', lang, source, CAST(doc_id AS VARCHAR)) path, coalesce(text, '') content, doc_id FROM documents)"
_AB = _FILES + """,
va AS (SELECT path, content, sha256(content) hash, CAST(strlen(content) AS BIGINT) size FROM f WHERE doc_id % 10 <> 0),
vb0 AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN content || 'x' ELSE content END content FROM f WHERE doc_id % 11 <> 0),
vb AS (SELECT path, content, sha256(content) hash, CAST(strlen(content) AS BIGINT) size FROM vb0)"""
_DIFF = _AB + """,
d AS (SELECT coalesce(a.path, b.path) path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END kind,
  a.hash old_hash, b.hash new_hash FROM va a FULL JOIN vb b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash)"""


def _chunks(source: str, name: str, size: int = 2048) -> str:
    return f"""{name} AS (SELECT path, CAST(k AS INTEGER) ord, CAST(k * {size} AS BIGINT) off, CAST(length(substring(content, k * {size} + 1, {size})) AS INTEGER) len,
  sha256(substring(content, k * {size} + 1, {size})) hash, substring(content, k * {size} + 1, {size}) data
  FROM {source}, unnest(range(0, greatest(CAST(ceil(length(content) / {size}.0) AS BIGINT), 1))) t(k))"""


_V = """v AS (SELECT o_custkey branch, o_orderkey version_id, row_number() OVER w seq, lag(o_orderkey, 1) OVER w p0, lag(o_orderkey, 2) OVER w p1
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
e AS (SELECT version_id, p0 parent_id, 0 ordinal FROM v WHERE p0 IS NOT NULL UNION ALL SELECT version_id, p1, 1 FROM v WHERE p1 IS NOT NULL),
tips AS (SELECT branch, max_by(version_id, seq) version_id FROM v GROUP BY branch)"""
_ANC = _V + """,
anc AS (SELECT branch start, version_id FROM tips UNION SELECT a.start, e.parent_id FROM anc a JOIN e ON e.version_id = a.version_id)"""
_DIST = _V + """,
r AS (SELECT branch start, version_id, 0 dist FROM tips UNION SELECT r.start, e.parent_id, r.dist + 1 FROM r JOIN e ON e.version_id = r.version_id WHERE r.dist < 3),
near AS (SELECT start, version_id, min(dist) dist FROM r GROUP BY ALL)"""
_REFS = _V + """,
refs AS (SELECT 'branch-' || branch AS name, 'branch' kind, version_id target FROM tips UNION ALL SELECT 'tag-' || version_id, 'tag', version_id FROM v WHERE version_id % 5 = 0)"""
_HOLD = "hold AS (SELECT DISTINCT l_orderkey version_id, sha256(CAST(l_partkey AS VARCHAR)) hash FROM lineitem)"
_SESS = """s AS (SELECT event_id session_id, user_id remote, CASE WHEN event_id % 2 = 0 THEN 'push' ELSE 'pull' END direction,
  CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END status, CAST(floor(epoch(ts)) AS BIGINT) started_at FROM events)"""


def _query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def _a(spark, d):
    return i.hashed(i.version(spark, d, "a"))


def _b(spark, d):
    return i.hashed(i.version(spark, d, "b"))


# --- digests and chunks ---
@_query("file_digest", f"WITH {_FILES} SELECT path, sha256(content) hash, 'chunks/' || substring(sha256(content), 1, 2) || '/' || substring(sha256(content), 3, 2) || '/' || sha256(content) object_key, to_base64(unhex(md5(content))) content_md5 FROM f")
def file_digest(spark, d):
    h = dg.digest(F.col("content"))
    return i.files(spark, d).select("path", h.alias("hash"), dg.object_key(h).alias("object_key"), dg.content_md5(F.col("content")).alias("content_md5"))


@_query("version_ids", f"""WITH {_V}, x AS (SELECT version_id, [sha256(CAST(p AS VARCHAR)) FOR p IN list_filter([p0, p1], lambda q: q IS NOT NULL)] ps, sha256('r' || version_id) root, seq * 86400 AS ts FROM v)
SELECT version_id, sha256(unhex(hex(encode(array_to_string(ps, ''))) || root || array_to_string(list_reverse(regexp_extract_all(lpad(lower(hex(CAST(ts AS BIGINT))), 16, '0'), '..')), ''))) id FROM x""")
def version_ids(spark, d):
    v = i.versions(spark, d)
    parents = F.transform(F.filter(F.array("p0", "p1"), lambda p: p.isNotNull()), lambda p: dg.digest(p.cast("string")))
    return v.select("version_id", dg.version_id(parents, dg.digest(F.concat(F.lit("r"), F.col("version_id").cast("string"))), F.col("seq") * 86400).alias("id"))


@_query("wire_ids", "SELECT event_id, CASE WHEN regexp_matches(k, '^[0-9a-fA-F]{64}$') THEN lower(k) ELSE sha256(k) END wire_id, CASE WHEN regexp_matches(k, '^[0-9a-fA-F]{64}$') THEN lower(k) END parsed, regexp_matches(z, '^0*$') is_empty FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(sha256(event_type)) ELSE event_type END k, CASE WHEN event_id % 3 = 0 THEN '000' ELSE CAST(event_id AS VARCHAR) END z FROM events)")
def wire_ids(spark, d):
    e = i.table(spark, d, "events")
    k = F.when(F.col("event_id") % 2 == 0, F.upper(dg.digest(F.col("event_type")))).otherwise(F.col("event_type"))
    z = F.when(F.col("event_id") % 3 == 0, "000").otherwise(F.col("event_id").cast("string"))
    return e.select("event_id", dg.wire_id(k).alias("wire_id"), dg.parse_hash(k).alias("parsed"), dg.is_empty_id(z).alias("is_empty"))


@_query("fixed_chunks", f"WITH {_FILES}, {_chunks('f', 'c')} SELECT path, ord, off, len, hash FROM c")
def fixed_chunks(spark, d):
    return chunking.fixed_chunks(i.files(spark, d)).drop("data")


@_query("chunk_dedup_stats", f"""WITH {_FILES}, {_chunks('f', 'c')}, n AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path, ord) = 1 is_new FROM c)
SELECT count(*) total_chunks, count(*) FILTER (is_new) new_chunks, count(*) FILTER (NOT is_new) dedup_chunks, CAST(sum(len) AS BIGINT) total_bytes, CAST(coalesce(sum(len) FILTER (NOT is_new), 0) AS BIGINT) dedup_bytes FROM n""")
def chunk_dedup_stats(spark, d):
    return chunking.dedup_stats(chunking.fixed_chunks(i.files(spark, d)), None, ["path", "ord"])


@_query("upload_totals_by_language", f"""WITH {_AB}, {_chunks('va', 'ca')}, {_chunks('vb', 'cb')},
n AS (SELECT split_part(path, '/', 1) lang, len, row_number() OVER (PARTITION BY hash ORDER BY path, ord) = 1 AND hash NOT IN (SELECT hash FROM ca) is_new FROM cb)
SELECT lang, count(*) total_chunks, count(*) FILTER (is_new) new_chunks, count(*) FILTER (NOT is_new) dedup_chunks, CAST(sum(len) AS BIGINT) total_bytes, CAST(coalesce(sum(len) FILTER (NOT is_new), 0) AS BIGINT) dedup_bytes FROM n GROUP BY lang""")
def upload_totals_by_language(spark, d):
    store = chunking.fixed_chunks(i.version(spark, d, "a"))
    up = chunking.fixed_chunks(i.version(spark, d, "b")).withColumn("lang", F.split("path", "/")[0])
    return chunking.dedup_stats(up, store, ["path", "ord"], ["lang"])


@_query("new_chunks_anti", f"WITH {_AB}, {_chunks('va', 'ca')}, {_chunks('vb', 'cb')} SELECT DISTINCT hash, len FROM cb WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.hash = cb.hash)")
def new_chunks_anti(spark, d):
    return chunking.new_chunks(chunking.fixed_chunks(i.version(spark, d, "b")), chunking.fixed_chunks(i.version(spark, d, "a"))).select("hash", "len")


@_query("existing_chunks_semi", f"WITH {_AB}, {_chunks('va', 'ca')}, {_chunks('vb', 'cb')} SELECT DISTINCT hash FROM cb WHERE EXISTS (SELECT 1 FROM ca WHERE ca.hash = cb.hash)")
def existing_chunks_semi(spark, d):
    return chunking.existing_chunks(chunking.fixed_chunks(i.version(spark, d, "b")), chunking.fixed_chunks(i.version(spark, d, "a")))


@_query("object_info", f"WITH {_AB}, {_chunks('va', 'ca')}, {_chunks('vb', 'cb')} SELECT DISTINCT cb.hash, ca.hash IS NOT NULL found, coalesce(CAST(ca.len AS BIGINT), 0) size FROM cb LEFT JOIN (SELECT DISTINCT hash, len FROM ca) ca ON ca.hash = cb.hash")
def object_info(spark, d):
    return chunking.object_info(chunking.fixed_chunks(i.version(spark, d, "b")), chunking.fixed_chunks(i.version(spark, d, "a")))


@_query("reassemble_check", f"WITH {_FILES}, {_chunks('f', 'c')} SELECT path, sha256(string_agg(data, '' ORDER BY ord)) hash, CAST(0 AS INTEGER) missing FROM c GROUP BY path")
def reassemble_check(spark, d):
    c = chunking.fixed_chunks(i.files(spark, d))
    return chunking.reassembled(c.drop("data"), c, ["path"]).select("path", dg.digest(F.col("content")).alias("hash"), "missing")


@_query("shard_objects", f"WITH {_FILES}, {_chunks('f', 'c')} SELECT CAST(concat('0x', substring(hash, 1, 2)) AS INTEGER) % 7 shard, 'chunk' obj_type, count(DISTINCT hash) n FROM c GROUP BY 1")
def shard_objects(spark, d):
    c = chunking.fixed_chunks(i.files(spark, d))
    return sync.sharded(c.select("hash").distinct().withColumn("obj_type", F.lit("chunk")), 7)


# --- trees ---
def _levels(source: str, by: str, n: int = 4, fan: int = 4) -> str:
    out, last = "", source
    for k in range(1, n + 1):
        out += f""", l{k} AS (SELECT {by}, ord // {fan} ord, CASE WHEN count(*) = 1 THEN max(hash) ELSE sha256(unhex(string_agg(hash, '' ORDER BY ord))) END hash FROM {last} GROUP BY {by}, ord // {fan})"""
        last = f"l{k}"
    return out


@_query("merkle_root", f"WITH {_FILES}, {_chunks('f', 'c')}{_levels('c', 'path')} SELECT l4.path, l4.hash root, CAST(sum(c.len) AS BIGINT) size, CAST(count(*) AS INTEGER) chunk_count FROM l4 JOIN c ON c.path = l4.path GROUP BY l4.path, l4.hash")
def merkle_root(spark, d):
    return trees.merkle_roots(chunking.fixed_chunks(i.files(spark, d)), ["path"], 4)


@_query("rehydrate_leaves", f"WITH {_FILES}, {_chunks('f', 'c')} SELECT path, string_agg(hash, ',' ORDER BY ord) leaves FROM c GROUP BY path")
def rehydrate_leaves(spark, d):
    c = chunking.fixed_chunks(i.files(spark, d)).drop("data")
    levels = trees.merkle_levels(c, ["path"], 4)
    roots = levels[-1].select("path", F.col("h").alias("root"))
    return trees.rehydrated(roots, trees.tree_nodes(c, ["path"], 4), len(levels) - 1, ["path"]).select("path", F.array_join("leaves", ",").alias("leaves"))


_TREE = _FILES + """,
t3 AS (SELECT path, sha256(content) h, CAST(strlen(content) AS BIGINT) size FROM f),
t2 AS (SELECT regexp_replace(path, '/[^/]*$', '') path, sha256(unhex(string_agg(hex(encode(regexp_extract(path, '[^/]*$'))) || h, '' ORDER BY regexp_extract(path, '[^/]*$')))) h, count(*) n FROM t3 GROUP BY 1),
t1 AS (SELECT regexp_replace(path, '/[^/]*$', '') path, sha256(unhex(string_agg(hex(encode(regexp_extract(path, '[^/]*$'))) || h, '' ORDER BY regexp_extract(path, '[^/]*$')))) h, count(*) n FROM t2 GROUP BY 1),
t0 AS (SELECT '' path, sha256(unhex(string_agg(hex(encode(path)) || h, '' ORDER BY path))) h, count(*) n FROM t1),
idx AS (SELECT path, h node_hash, false is_directory, size, 0 n_children FROM t3 UNION ALL SELECT path, h, true, 0, n FROM (SELECT * FROM t2 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t0 WHERE h IS NOT NULL))"""


def _index(spark, d):
    return trees.directory_tree(i.hashed(i.files(spark, d)))


@_query("path_index", f"WITH {_TREE} SELECT path, node_hash, is_directory, CAST(size AS BIGINT) size, CAST(n_children AS INTEGER) n_children FROM idx")
def path_index(spark, d):
    return _index(spark, d)


@_query("dir_hashes", f"WITH {_TREE} SELECT path, node_hash FROM idx WHERE is_directory")
def dir_hashes(spark, d):
    return _index(spark, d).where("is_directory").select("path", "node_hash")


@_query("list_directory", f"WITH {_TREE} SELECT substring(path, 4) AS name, path, node_hash, is_directory, CAST(size AS BIGINT) size FROM idx WHERE starts_with(path, 'en/') AND instr(substring(path, 4), '/') = 0")
def list_directory(spark, d):
    return trees.list_directory(_index(spark, d), "en")


@_query("node_metadata", f"WITH {_TREE}, k AS (SELECT CASE WHEN instr(path, '/') = 0 THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END path, string_agg(regexp_extract(path, '[^/]*$'), ',' ORDER BY regexp_extract(path, '[^/]*$')) children FROM idx WHERE path <> '' GROUP BY 1) SELECT idx.path, CASE WHEN is_directory THEN 'directory' ELSE 'file' END kind, CAST(size AS BIGINT) size, children FROM idx LEFT JOIN k ON k.path = idx.path")
def node_metadata(spark, d):
    return trees.node_metadata(_index(spark, d))


@_query("resolve_path", f"WITH {_TREE}, q AS (SELECT '/' || lang || '//' || source || CASE WHEN doc_id % 2 = 0 THEN '/' || doc_id ELSE '/none' END path, lang || '/' || source || CASE WHEN doc_id % 2 = 0 THEN '/' || doc_id ELSE '/none' END p FROM documents) SELECT DISTINCT q.path, node_hash, is_directory FROM q LEFT JOIN idx ON idx.path = q.p")
def resolve_path(spark, d):
    docs = i.table(spark, d, "documents")
    leaf = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/"), F.col("doc_id").cast("string"))).otherwise("/none")
    asked = docs.select(F.concat(F.lit("/"), F.col("lang"), F.lit("//"), F.col("source"), leaf).alias("path")).distinct()
    return trees.resolve_paths(_index(spark, d), asked)


# --- differences ---
@_query("version_diff", f"WITH {_DIFF} SELECT path, kind, old_hash, new_hash FROM d")
def version_diff(spark, d):
    return diffs.version_diff(_a(spark, d), _b(spark, d))


@_query("diff_summary", f"WITH {_DIFF} SELECT kind, count(*) n FROM d GROUP BY kind")
def diff_summary(spark, d):
    return diffs.diff_summary(diffs.version_diff(_a(spark, d), _b(spark, d)))


@_query("diff_chunk_stats", f"""WITH {_DIFF}, {_chunks('va', 'ca')}, {_chunks('vb', 'cb')},
m AS (SELECT path FROM d WHERE kind = 'modified'),
mo AS (SELECT DISTINCT path, hash FROM ca WHERE path IN (SELECT path FROM m)), mn AS (SELECT DISTINCT path, hash FROM cb WHERE path IN (SELECT path FROM m)),
j AS (SELECT count(*) FILTER (mo.hash IS NULL) a, count(*) FILTER (mn.hash IS NULL) r, count(*) FILTER (mo.hash IS NOT NULL AND mn.hash IS NOT NULL) u FROM mo FULL JOIN mn ON mo.path = mn.path AND mo.hash = mn.hash)
SELECT a + (SELECT count(*) FROM cb WHERE path IN (SELECT path FROM d WHERE kind = 'added')) added_chunks, r + (SELECT count(*) FROM ca WHERE path IN (SELECT path FROM d WHERE kind = 'removed')) removed_chunks,
  u + (SELECT count(*) FROM cb WHERE path NOT IN (SELECT path FROM d)) unchanged_chunks FROM j""")
def diff_chunk_stats(spark, d):
    a, b = i.version(spark, d, "a"), i.version(spark, d, "b")
    return diffs.chunk_stats(i.hashed(a), i.hashed(b), chunking.fixed_chunks(a), chunking.fixed_chunks(b))


@_query("status_untracked_modified_deleted", f"WITH {_AB} SELECT coalesce(a.path, b.path) path, CASE WHEN a.path IS NULL THEN 'untracked' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END change, b.size local_size, a.size head_size FROM va a FULL JOIN vb b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash")
def status_untracked_modified_deleted(spark, d):
    return diffs.working_tree_status(_a(spark, d), _b(spark, d))


# of the local files, a third are in the cache, a third lie there under another time and a wrong hash, and a third are not there
@_query("status_with_cache", f"WITH {_AB} SELECT coalesce(a.path, b.path) path, CASE WHEN a.path IS NULL THEN 'untracked' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END change, b.size local_size, a.size head_size FROM va a FULL JOIN vb b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash")
def status_with_cache(spark, d):
    b = i.version(spark, d, "b").withColumn("mtime", F.crc32("path"))
    third = F.col("mtime") % 3
    cache = i.hashed(b).withColumn("mtime", F.crc32("path")).where(third < 2)
    cache = cache.withColumn("hash", F.when(third == 1, dg.digest(F.col("path"))).otherwise(F.col("hash"))).withColumn("mtime", F.col("mtime") + (third == 1).cast("long"))
    local = b.select("path", F.lit(None).cast("string").alias("hash"), F.octet_length("content").cast("long").alias("size"), "mtime", "content")
    return diffs.working_tree_status(_a(spark, d), local, cache)


for _force in (False, True):

    def checkout(spark, d, force=_force):
        return diffs.checkout_plan(_a(spark, d), _b(spark, d), force)

    _query(f"checkout_plan_{'force' if _force else 'safe'}", f"""WITH {_AB}, x AS (SELECT coalesce(a.path, b.path) path, CASE WHEN b.path IS NULL THEN 'write' WHEN a.path IS NULL THEN {"'delete'" if _force else 'NULL'} WHEN a.hash = b.hash THEN 'skip' ELSE '{'overwrite' if _force else 'conflict'}' END "action" FROM va a FULL JOIN vb b ON a.path = b.path)
SELECT path, "action" FROM x WHERE "action" IS NOT NULL""")(checkout)


@_query("partial_commit_tree", f"WITH {_AB}, st AS (SELECT path FROM f WHERE doc_id % 3 = 0) SELECT path, hash, size FROM va WHERE path NOT IN (SELECT path FROM st) UNION ALL SELECT path, hash, size FROM vb WHERE path IN (SELECT path FROM st)")
def partial_commit_tree(spark, d):
    staged = i.files(spark, d).where("doc_id % 3 = 0").select("path")
    return diffs.partial_commit(_a(spark, d), staged, _b(spark, d))


# --- history ---
@_query("history_first_parent", f"WITH RECURSIVE {_V}, r AS (SELECT branch, version_id, 0 depth FROM tips UNION ALL SELECT r.branch, e.parent_id, r.depth + 1 FROM r JOIN e ON e.version_id = r.version_id AND e.ordinal = 0 WHERE r.depth < 4) SELECT branch, version_id, depth FROM r")
def history_first_parent(spark, d):
    v = i.versions(spark, d)
    return history.first_parent_history(i.edges(v), i.tips(v), 5)


@_query("history_page", f"WITH RECURSIVE {_V}, r AS (SELECT branch, version_id, 0 depth FROM tips UNION ALL SELECT r.branch, e.parent_id, r.depth + 1 FROM r JOIN e ON e.version_id = r.version_id AND e.ordinal = 0 WHERE r.depth < 5) SELECT branch, version_id, depth, max(depth) OVER (PARTITION BY branch) >= 5 has_more FROM r QUALIFY depth >= 2 AND depth < 5")
def history_page(spark, d):
    v = i.versions(spark, d)
    return history.history_page(history.first_parent_history(i.edges(v), i.tips(v), 6), 3, 2)


def _starts(v):
    return i.tips(v).select(F.col("branch").alias("start"), "version_id")


@_query("ancestors", f"WITH RECURSIVE {_ANC} SELECT start, version_id FROM anc")
def ancestors(spark, d):
    v = i.versions(spark, d)
    return history.ancestors(i.edges(v), _starts(v)).select("start", "version_id")


@_query("fast_forward", f"""WITH RECURSIVE {_ANC}, u AS (SELECT tips.branch AS ref, CASE WHEN branch % 4 = 0 THEN NULL WHEN branch % 4 = 1 THEN version_id WHEN branch % 4 = 2 THEN (SELECT min(version_id) FROM v WHERE v.branch = tips.branch) ELSE -1 END old FROM tips)
SELECT ref, old IS NULL OR EXISTS (SELECT 1 FROM anc WHERE anc.start = u.ref AND anc.version_id = u.old) allowed FROM u""")
def fast_forward(spark, d):
    v = i.versions(spark, d)
    first = v.groupBy("branch").agg(F.min("version_id").alias("first"))
    k = F.col("branch") % 4
    updates = i.tips(v).join(first, "branch").select(F.col("branch").alias("ref"), F.when(k == 1, F.col("version_id")).when(k == 2, F.col("first")).when(k == 3, F.lit(-1)).cast("long").alias("old"), F.col("version_id").alias("new"))
    return history.is_fast_forward(i.edges(v), updates)


@_query("ahead_behind", f"""WITH RECURSIVE {_V}, p AS (SELECT branch AS ref, max_by(version_id, seq) loc, CASE WHEN branch % 2 = 0 THEN max_by(p1, seq) ELSE min_by(version_id, seq) END rem FROM v GROUP BY branch),
m AS (SELECT ref, loc v FROM p UNION SELECT m.ref, e.parent_id FROM m JOIN e ON e.version_id = m.v),
t AS (SELECT ref, rem v FROM p WHERE rem IS NOT NULL UNION SELECT t.ref, e.parent_id FROM t JOIN e ON e.version_id = t.v)
SELECT coalesce(m.ref, t.ref) AS ref, count(*) FILTER (t.v IS NULL) ahead, count(*) FILTER (m.v IS NULL) behind FROM m FULL JOIN t ON m.ref = t.ref AND m.v = t.v GROUP BY 1""")
def ahead_behind(spark, d):
    v = i.versions(spark, d)
    pairs = v.groupBy(F.col("branch").alias("ref")).agg(F.max_by("version_id", "seq").alias("local"), F.max_by("p1", "seq").alias("_p"), F.min_by("version_id", "seq").alias("_f"))
    pairs = pairs.select("ref", "local", F.when(F.col("ref") % 2 == 0, F.col("_p")).otherwise(F.col("_f")).alias("remote"))
    return history.ahead_behind(i.edges(v), pairs)


@_query("shallow_versions", f"WITH RECURSIVE {_DIST} SELECT start, version_id, dist FROM near WHERE dist < 3")
def shallow_versions(spark, d):
    v = i.versions(spark, d)
    return history.shallow(i.edges(v), _starts(v), 3)[0].select("start", "version_id", "dist")


@_query("shallow_boundary", f"WITH RECURSIVE {_DIST}, got AS (SELECT DISTINCT version_id FROM near WHERE dist < 3) SELECT DISTINCT parent_id version_id FROM e WHERE version_id IN (SELECT version_id FROM got) AND parent_id NOT IN (SELECT version_id FROM got)")
def shallow_boundary(spark, d):
    v = i.versions(spark, d)
    e = i.edges(v)
    return history.shallow_boundary(history.shallow(e, _starts(v), 3)[0].select("version_id").distinct(), e)


@_query("resolve_ref", f"WITH {_REFS}, q AS (SELECT CAST(version_id AS VARCHAR) asked FROM v UNION SELECT name FROM refs UNION SELECT 'none') SELECT asked, coalesce(CAST(v.version_id AS VARCHAR), CAST(refs.target AS VARCHAR)) version_id FROM q LEFT JOIN v ON CAST(v.version_id AS VARCHAR) = asked LEFT JOIN refs ON refs.name = asked")
def resolve_ref(spark, d):
    v = i.versions(spark, d).select(F.col("version_id").cast("string").alias("version_id"))
    r = i.refs(spark, d).withColumn("target", F.col("target").cast("string"))
    asked = v.select(F.col("version_id").alias("asked")).union(r.select("name")).union(spark.createDataFrame([("none",)], "asked string")).distinct()
    return history.resolve_refs(asked, v, r)


@_query("list_refs_by_kind", f"WITH {_REFS} SELECT * FROM refs WHERE kind = 'tag'")
def list_refs_by_kind(spark, d):
    return history.list_refs(i.refs(spark, d), "tag")


@_query("reachable_objects", f"WITH RECURSIVE {_ANC}, {_HOLD} SELECT start, 'version' obj_type, CAST(version_id AS VARCHAR) hash FROM anc UNION ALL SELECT DISTINCT start, 'chunk', hash FROM anc JOIN hold USING (version_id)")
def reachable_objects(spark, d):
    v = i.versions(spark, d)
    contents = i.holdings(spark, d).select(F.col("version_id").alias("root"), F.lit("chunk").alias("obj_type"), "hash")
    return history.reachable_objects(_starts(v), i.edges(v), v.select("version_id", F.col("version_id").alias("root")), contents)


# --- exchange ---
@_query("push_need_set", f"WITH {_AB}, {_chunks('va', 'ca')}, {_chunks('vb', 'cb')} SELECT DISTINCT 'chunk' obj_type, hash FROM cb WHERE hash NOT IN (SELECT hash FROM ca)")
def push_need_set(spark, d):
    o, h = (chunking.fixed_chunks(i.version(spark, d, s)).select(F.lit("chunk").alias("obj_type"), "hash") for s in "ba")
    return sync.need_set(o, h)


@_query("resume_filter", f"WITH {_AB}, {_chunks('va', 'ca')}, {_chunks('vb', 'cb')} SELECT DISTINCT 'chunk' obj_type, hash FROM cb WHERE hash NOT IN (SELECT hash FROM ca) AND CAST(concat('0x', substring(hash, 1, 2)) AS INTEGER) % 2 = 1")
def resume_filter(spark, d):
    need = push_need_set(spark, d)
    return sync.resume_filter(need, need.where(chunking.shard_of(F.col("hash"), 2) == 0))


@_query("ingest_counts", f"WITH {_AB}, {_chunks('va', 'ca')}, {_chunks('vb', 'cb')} SELECT count(*) received, count(DISTINCT hash) FILTER (hash NOT IN (SELECT hash FROM ca)) stored, count(*) - count(DISTINCT hash) FILTER (hash NOT IN (SELECT hash FROM ca)) duplicates FROM cb")
def ingest_counts(spark, d):
    r, h = (chunking.fixed_chunks(i.version(spark, d, s)).select(F.lit("chunk").alias("obj_type"), "hash") for s in "ba")
    return sync.ingest_counts(r, h)


@_query("finalize_refs", f"WITH {_V} SELECT branch AS ref, CASE WHEN branch % 5 = 0 THEN 'ok' WHEN branch % 5 = 1 THEN 'stale' WHEN branch % 5 = 2 THEN 'non-fast-forward' ELSE 'ok' END status FROM tips")
def finalize_refs(spark, d):
    t = i.tips(i.versions(spark, d))
    k = F.col("branch") % 5
    updates = t.select(F.col("branch").alias("ref"), F.when(k < 2, F.lit(-1).cast("long")).otherwise(F.col("version_id")).alias("expected"), F.lit(0).alias("new"), (k == 0).alias("force"), (k != 2).alias("fast_forward"))
    return sync.finalize(updates, t.select(F.col("branch").alias("name"), F.col("version_id").alias("target")))


@_query("sessions_recent", f"WITH {_SESS} SELECT * FROM s ORDER BY started_at DESC, session_id LIMIT 50")
def sessions_recent(spark, d):
    return sync.recent_sessions(i.sessions(spark, d), 50)


@_query("sessions_resumable", f"WITH {_SESS} SELECT remote, direction, max_by(session_id, (started_at, session_id)) session_id FROM s WHERE status = 'running' AND {i.NOW} - started_at < 3000000 GROUP BY remote, direction")
def sessions_resumable(spark, d):
    return sync.resumable(i.sessions(spark, d), i.NOW, 3_000_000)


@_query("sessions_stale", f"WITH {_SESS} SELECT session_id, remote, direction, 'failed' status, started_at FROM s WHERE status = 'running' AND {i.AFTER} - started_at >= 86400")
def sessions_stale(spark, d):
    return sync.expired(i.sessions(spark, d), i.AFTER, 86_400)


# --- upkeep ---
@_query("refcounts", f"WITH {_HOLD} SELECT hash, count(*) refcount FROM hold GROUP BY hash")
def refcounts(spark, d):
    return upkeep.refcounts(i.holdings(spark, d))


_GC = _V + f""", {_HOLD}, lv AS (SELECT version_id FROM tips WHERE branch % 3 = 0 UNION SELECT e.parent_id FROM lv JOIN e ON e.version_id = lv.version_id),
live AS (SELECT DISTINCT hash FROM hold WHERE version_id IN (SELECT version_id FROM lv)),
g AS (SELECT DISTINCT sha256(CAST(p_partkey AS VARCHAR)) hash, {i.NOW} - p_size * 3600 queued_at FROM part),
sw AS (SELECT g.hash, CASE WHEN live.hash IS NOT NULL THEN 'revived' WHEN {i.NOW} - queued_at < 86400 THEN 'waiting' ELSE 'pending' END outcome FROM g LEFT JOIN live ON live.hash = g.hash)"""


def _live(spark, d):
    v = i.versions(spark, d)
    kept = i.tips(v).where("branch % 3 = 0").select(F.lit(0).alias("start"), "version_id")
    return upkeep.live_set(history.ancestors(i.edges(v), kept), i.holdings(spark, d))


def _swept(spark, d):
    garbage = i.table(spark, d, "part").select(dg.digest(F.col("p_partkey").cast("string")).alias("hash"), (F.lit(i.NOW) - F.col("p_size") * 3600).cast("long").alias("queued_at"))
    return upkeep.sweep(garbage, _live(spark, d), i.NOW)


@_query("gc_live_set", f"WITH RECURSIVE {_GC} SELECT hash FROM live")
def gc_live_set(spark, d):
    return _live(spark, d)


@_query("gc_sweep", f"WITH RECURSIVE {_GC} SELECT hash, outcome FROM sw")
def gc_sweep(spark, d):
    return _swept(spark, d)


@_query("gc_report", f"WITH RECURSIVE {_GC} SELECT count(*) examined, count(*) FILTER (outcome = 'revived') revived, count(*) FILTER (outcome = 'waiting') waiting, count(*) FILTER (outcome = 'pending') pending FROM sw")
def gc_report(spark, d):
    return upkeep.sweep_report(_swept(spark, d))


@_query("refcount_decrement", f"WITH {_HOLD}, c AS (SELECT hash, count(*) n FROM hold GROUP BY hash), dr AS (SELECT hash, count(*) k FROM hold WHERE version_id % 2 = 0 GROUP BY hash) SELECT c.hash, greatest(n - coalesce(k, 0), 0) refcount, n - coalesce(k, 0) <= 0 garbage FROM c LEFT JOIN dr ON dr.hash = c.hash")
def refcount_decrement(spark, d):
    h = i.holdings(spark, d)
    return upkeep.decremented(upkeep.refcounts(h), h.where("version_id % 2 = 0"))


@_query("gc_next_run", "WITH x AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) now, event_id % 24 h FROM events) SELECT event_id, CAST(CASE WHEN now - now % 86400 + h * 3600 > now THEN now - now % 86400 + h * 3600 ELSE now - now % 86400 + h * 3600 + 86400 END AS BIGINT) next_run FROM x")
def gc_next_run(spark, d):
    e = i.table(spark, d, "events")
    return e.select("event_id", upkeep.next_run(F.unix_timestamp(F.col("ts").cast("timestamp")), F.col("event_id") % 24).alias("next_run"))


_WS = f"""ws AS (SELECT c_custkey id, CAST(CASE WHEN c_custkey % 4 <> 0 THEN {i.NOW} - (c_custkey % 40) * 86400 END AS BIGINT) deleted_at,
  CASE c_custkey % 5 WHEN 0 THEN '{{"recycle_retention_days": 7}}' WHEN 1 THEN '{{"recycle_retention_days": 14}}' WHEN 2 THEN '{{"recycle_retention_days": "x"}}' WHEN 3 THEN '{{}}' END metadata FROM customer)"""


@_query("recycle_purge", f"WITH {_WS} SELECT * FROM ws WHERE deleted_at IS NOT NULL AND {i.NOW} - deleted_at >= coalesce(try_cast(json_extract_string(metadata, '$.recycle_retention_days') AS BIGINT), 30) * 86400")
def recycle_purge(spark, d):
    return upkeep.purgeable(i.workspaces(spark, d), i.NOW)


@_query("lifecycle_classes", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 120 >= 7 THEN 'expire' WHEN o_orderkey % 120 >= 90 THEN 'archive' WHEN o_orderkey % 120 >= 30 THEN 'infrequent' ELSE 'standard' END tier FROM orders")
def lifecycle_classes(spark, d):
    return i.table(spark, d, "orders").select("o_orderkey", upkeep.lifecycle_class(F.col("o_orderkey") % 120, F.col("o_orderkey") % 3 == 0).alias("tier"))


@_query("tenant_cascade", "SELECT 'nation' kind, n_name AS name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'supplier', s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey <> 1 UNION ALL SELECT 'customer', c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1")
def tenant_cascade(spark, d):
    region, nation, supplier, customer = (i.table(spark, d, t) for t in ("region", "nation", "supplier", "customer"))
    stay, gone = upkeep.cascade(region.where("r_regionkey = 1"), nation, "r_regionkey", "n_regionkey")
    s, _ = upkeep.cascade(gone, supplier, "n_nationkey", "s_nationkey")
    c, _ = upkeep.cascade(gone, customer, "n_nationkey", "c_nationkey")
    row = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"))
    return row(stay, "nation", "n_name").unionAll(row(s, "supplier", "s_name")).unionAll(row(c, "customer", "c_name"))


_ROLE = "CASE {} % 5 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' WHEN 2 THEN 'member' WHEN 3 THEN 'viewer' ELSE 'guest' END"


def _role(c):
    return F.element_at(F.array(*[F.lit(r) for r in ("owner", "admin", "member", "viewer", "guest")]), (c % 5 + 1).cast("int"))


@_query("rbac_allowed", f"SELECT c_custkey, r AS role, p AS permission, CASE r WHEN 'owner' THEN true WHEN 'admin' THEN p <> 'admin' WHEN 'member' THEN p IN ('read', 'write') WHEN 'viewer' THEN p = 'read' ELSE false END allowed FROM (SELECT c_custkey, {_ROLE.format('c_custkey')} r FROM customer), unnest(['read', 'write', 'delete', 'admin']) t(p)")
def rbac_allowed(spark, d):
    c = i.table(spark, d, "customer").select("c_custkey", _role(F.col("c_custkey")).alias("role"), F.explode(F.array(*[F.lit(p) for p in upkeep.PERMISSIONS])).alias("permission"))
    return upkeep.allowed(c).select("c_custkey", "role", "permission", "allowed")


@_query("effective_role", f"SELECT o_custkey, CASE max(CASE {_ROLE.format('o_orderkey')} WHEN 'owner' THEN 3 WHEN 'admin' THEN 2 WHEN 'member' THEN 1 ELSE 0 END) WHEN 3 THEN 'owner' WHEN 2 THEN 'admin' WHEN 1 THEN 'member' ELSE 'viewer' END role FROM orders GROUP BY o_custkey")
def effective_role(spark, d):
    return upkeep.effective_role(i.table(spark, d, "orders").select("o_custkey", _role(F.col("o_orderkey")).alias("role")), "o_custkey")


# --- content-defined cutting (no SQL), patterns, Bloom filters ---
@_query("cdc_chunks", None)
def cdc_chunks(spark, d):
    return chunking.cdc_chunks(i.files(spark, d), chunking.Policy(256, 1024, 4096)).drop("data")


@_query("ignore_filter", r"WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') path FROM pages) SELECT page_id, path, regexp_matches(path, '(^|/)[^/]*\.html(/|$)') OR regexp_matches(path, '(^|/)blog\.[^/]*(/|$)') OR regexp_matches(path, '(^|/)(node_modules|target|\.git)(/|$)') ignored FROM p")
def ignore_filter(spark, d):
    p = i.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    rules = ignore.Matcher.of({"": ["*.html", "blog.*", "node_modules", "target", ".git"]}, defaults=False)
    return p.withColumn("ignored", rules.matches(F.col("path")))


@_query("bloom_negotiate", f"""WITH {_V}, h AS (SELECT sha256(CAST(version_id AS VARCHAR)) hash, version_id % 2 = 0 have FROM v), n AS (SELECT greatest(1, count(*) FILTER (have)) n FROM h),
m AS (SELECT n, greatest(64, CAST(ceil(-n * ln(0.01) / pow(ln(2), 2)) AS BIGINT)) m FROM n), k AS (SELECT m, least(30, greatest(1, CAST(round(m / n * ln(2)) AS BIGINT))) k FROM m),
pr AS (SELECT hash, have, (CAST(concat('0x', substring(hash, 1, 15)) AS BIGINT) % m + i * (CAST(concat('0x', substring(hash, 17, 15)) AS BIGINT) % m)) % m b FROM h, k, unnest(range(k)) t(i)),
s AS (SELECT DISTINCT b FROM pr WHERE have)
SELECT hash, bool_and(s.b IS NOT NULL) held FROM pr LEFT JOIN s ON s.b = pr.b GROUP BY hash""")
def bloom_negotiate(spark, d):
    have = i.versions(spark, d).where("version_id % 2 = 0").select(dg.digest(F.col("version_id").cast("string")).alias("hash"))
    offered = i.versions(spark, d).select(dg.digest(F.col("version_id").cast("string")).alias("hash"))
    f = bloom.build(have, "hash", have.count())
    return f.probed(offered, "hash")


@_query("bloom_then_exact", f"WITH {_V} SELECT sha256(CAST(version_id AS VARCHAR)) hash FROM v WHERE version_id % 2 <> 0")
def bloom_then_exact(spark, d):
    offered = i.versions(spark, d).select("version_id", dg.digest(F.col("version_id").cast("string")).alias("hash"))
    return bloom.negotiated(offered, offered.where("version_id % 2 = 0")).select("hash")


# --- content-defined chunks: whatever the cuts, the chunks in order are the file ---
@_query("cdc_roundtrip", f"WITH {_FILES} SELECT path, sha256(content) hash, CAST(strlen(content) AS BIGINT) size, CAST(0 AS INTEGER) missing FROM f")
def cdc_roundtrip(spark, d):
    c = chunking.cdc_chunks(i.files(spark, d), chunking.Policy(256, 1024, 4096))
    return chunking.reassembled(c, c, ["path"]).select("path", dg.digest(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("size"), "missing")


@_query("cdc_sizes", f"WITH {_FILES} SELECT path, CAST(strlen(content) AS BIGINT) bytes, true in_bounds FROM f")
def cdc_sizes(spark, d):
    p = chunking.Policy(256, 1024, 4096)
    c = chunking.cdc_chunks(i.files(spark, d), p).groupBy("path").agg(F.sum("len").cast("long").alias("bytes"), F.max("len").alias("most"), F.count("*").alias("n"), F.count_if(F.col("len") < p.least).alias("short"))
    return c.select("path", "bytes", ((F.col("most") <= p.most) & (F.col("short") <= 1)).alias("in_bounds"))


@_query("ignore_defaults", r"""WITH p AS (SELECT page_id, ['.git/x', 'a/.svn/y', '.hg/z', 'b/.DS_Store', 'Thumbs.db', 'node_modules/m/i.js', 'c/target/o', 'n.tmp', 'd/e.swp', 'build/o', 'dist/o', 'src/git', 'keep.tmp', 'src/a.gen.ts', 'a.gen.ts'][page_id % 15 + 1] path FROM pages)
SELECT page_id, path, NOT path IN ('build/o', 'dist/o', 'src/git', 'keep.tmp', 'a.gen.ts') ignored FROM p""")
def ignore_defaults(spark, d):
    paths = [".git/x", "a/.svn/y", ".hg/z", "b/.DS_Store", "Thumbs.db", "node_modules/m/i.js", "c/target/o", "n.tmp", "d/e.swp", "build/o", "dist/o", "src/git", "keep.tmp", "src/a.gen.ts", "a.gen.ts"]
    p = i.table(spark, d, "pages").select("page_id", F.element_at(F.array(*[F.lit(x) for x in paths]), (F.col("page_id") % 15 + 1).cast("int")).alias("path"))
    return p.withColumn("ignored", ignore.Matcher.of({"": ["!keep.tmp"], "src": ["*.gen.ts"]}).matches(F.col("path")))


@_query("flat_objects", f"WITH {_FILES}, {_chunks('f', 'c')} SELECT path, sha256(unhex(string_agg(hash, '' ORDER BY ord))) object, count(*) n FROM c GROUP BY path")
def flat_objects(spark, d):
    return chunking.flat_objects(chunking.fixed_chunks(i.files(spark, d)), ["path"]).select("path", "object", F.size("children").cast("long").alias("n"))


# --- the node table ---
_NODES = _TREE + """,
kids AS (SELECT CASE WHEN instr(path, '/') = 0 THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END path, string_agg(regexp_extract(path, '[^/]*$') || '=' || node_hash, ',' ORDER BY regexp_extract(path, '[^/]*$')) children FROM idx WHERE path <> '' GROUP BY 1),
nodes AS (SELECT DISTINCT node_hash hash, CASE WHEN is_directory THEN 'directory' ELSE 'file' END kind, size, coalesce(children, '') children FROM idx LEFT JOIN kids ON kids.path = idx.path)"""


@_query("node_table", f"WITH {_NODES} SELECT hash, kind, CAST(size AS BIGINT) size, children FROM nodes")
def node_table(spark, d):
    nodes = trees.node_entries(_index(spark, d))
    return nodes.withColumn("children", F.array_join(F.transform("children", lambda c: F.concat(c["name"], F.lit("="), c["hash"])), ","))


@_query("rebuilt_path_index", f"WITH {_TREE} SELECT path, node_hash, is_directory, CAST(size AS BIGINT) size, CAST(n_children AS INTEGER) n_children, false missing FROM idx")
def rebuilt_path_index(spark, d):
    index = _index(spark, d)
    return trees.walked(index.where("path = ''").select(F.col("node_hash").alias("root")), trees.node_entries(index))


@_query("reachable_nodes_of_a_root", f"WITH {_TREE} SELECT DISTINCT node_hash, node_hash = (SELECT min(node_hash) FROM idx WHERE NOT is_directory) missing FROM idx")
def reachable_nodes_of_a_root(spark, d):
    index = _index(spark, d)
    gone = index.where("NOT is_directory").agg(F.min("node_hash").alias("hash"))
    nodes = trees.node_entries(index).join(gone, "hash", "left_anti")
    return trees.walked(index.where("path = ''").select(F.col("node_hash").alias("root")), nodes).select("node_hash", "missing").distinct()


@_query("upsert_path_entries", f"WITH {_TREE} SELECT path, CASE WHEN path LIKE 'en/%' AND NOT is_directory THEN sha256(path) ELSE node_hash END node_hash, is_directory, CAST(CASE WHEN path LIKE 'en/%' AND NOT is_directory THEN 1 ELSE size END AS BIGINT) size, CAST(n_children AS INTEGER) n_children FROM idx UNION ALL SELECT 'new', sha256('new'), false, 1, 0")
def upsert_path_entries(spark, d):
    index = _index(spark, d)
    paths = index.where("path LIKE 'en/%' AND NOT is_directory").select("path").unionAll(spark.createDataFrame([("new",)], "path string"))
    return trees.upserted(index, paths.select("path", dg.digest(F.col("path")).alias("node_hash"), F.lit(False).alias("is_directory"), F.lit(1).cast("long").alias("size"), F.lit(0).alias("n_children")))


# --- projections ---
@_query("version_dtos", f"WITH {_V} SELECT CAST(version_id AS VARCHAR) id, array_to_string(list_filter([CAST(p0 AS VARCHAR), CAST(p1 AS VARCHAR)], lambda q: q IS NOT NULL), ',') parents, CAST(seq * 86400 AS BIGINT) AS ts FROM v")
def version_dtos(spark, d):
    v = i.versions(spark, d)
    rows = v.select(F.col("version_id").cast("string").alias("version_id"), (F.col("seq") * 86400).cast("long").alias("ts"), F.lit("").alias("root"), F.lit("").alias("message"))
    return history.version_dtos(rows, i.edges(v)).select("id", F.array_join("parents", ",").alias("parents"), "ts")


@_query("ref_dtos", f"WITH {_REFS} SELECT name, lower(upper(kind)) kind, CAST(target AS VARCHAR) target FROM refs")
def ref_dtos(spark, d):
    return history.ref_dtos(i.refs(spark, d).withColumn("kind", F.upper("kind")))


@_query("parsed_parents", "SELECT doc_id, array_to_string(list_transform(list_filter(string_split(x, ','), lambda p: p <> ''), lambda p: trim(p)), '|') parents FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a, b' WHEN 2 THEN ',a,,' || source || ' ' ELSE source END x FROM documents)")
def parsed_parents(spark, d):
    docs = i.table(spark, d, "documents")
    k = F.col("doc_id") % 4
    x = F.when(k == 0, "").when(k == 1, "a, b").when(k == 2, F.concat(F.lit(",a,,"), F.col("source"), F.lit(" "))).otherwise(F.col("source"))
    return docs.select("doc_id", F.array_join(history.parsed_parents(x), "|").alias("parents"))


@_query("absolute_paths", f"WITH {_FILES} SELECT path, '/work/tree/' || path AS absolute FROM f")
def absolute_paths(spark, d):
    return i.files(spark, d).select("path", trees.absolute("/work/tree/", F.col("path")).alias("absolute"))


# --- inventories, quotas, sessions ---
@_query("inventory_by_type", f"WITH {_V}, {_HOLD}, o AS (SELECT 'version' obj_type, sha256(CAST(version_id AS VARCHAR)) hash FROM v UNION SELECT 'chunk', hash FROM hold) SELECT obj_type, count(*) n, min(hash) least, max(hash) greatest FROM o GROUP BY obj_type")
def inventory_by_type(spark, d):
    v = i.versions(spark, d).select(F.lit("version").alias("obj_type"), dg.digest(F.col("version_id").cast("string")).alias("hash"))
    return sync.inventory(v.unionAll(i.holdings(spark, d).select(F.lit("chunk").alias("obj_type"), "hash")))


@_query("pack_quota", "SELECT CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) bytes, count(*) FILTER (strlen(text) > 4096) too_large, count(*) FILTER (strlen(text) > 4096) > 0 OR sum(strlen(coalesce(text, ''))) > 1000000 refused FROM documents")
def pack_quota(spark, d):
    return sync.over_quota(i.table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("data")), 1_000_000, 4_096)


@_query("transfer_totals", f"WITH {_SESS} SELECT remote, direction, count(*) sessions, count(*) FILTER (status = 'completed') completed, count(*) FILTER (status = 'failed') failed FROM s GROUP BY remote, direction")
def transfer_totals(spark, d):
    return sync.transfer_totals(i.sessions(spark, d))


# --- collections, workspaces, members ---
@_query("gc_metrics", "SELECT event_type kind, count(*) runs, CAST(sum(event_id % 50) AS BIGINT) objects, CAST(sum(event_id % 50) * 65536 AS BIGINT) bytes, count(*) FILTER (value <= 1) upto_1s, count(*) FILTER (value > 1 AND value <= 10) upto_10s, count(*) FILTER (value > 10 AND value <= 60) upto_60s, count(*) FILTER (value > 60) longer FROM events GROUP BY event_type")
def gc_metrics(spark, d):
    return upkeep.gc_metrics(i.table(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("event_id") % 50).alias("deleted"), F.col("value").alias("seconds")))


@_query("garbage_drained", f"WITH RECURSIVE {_GC} SELECT hash, queued_at FROM g WHERE hash NOT IN (SELECT hash FROM sw WHERE outcome <> 'waiting')")
def garbage_drained(spark, d):
    garbage = i.table(spark, d, "part").select(dg.digest(F.col("p_partkey").cast("string")).alias("hash"), (F.lit(i.NOW) - F.col("p_size") * 3600).cast("long").alias("queued_at"))
    return upkeep.drained(garbage, _swept(spark, d).where("outcome <> 'waiting'"))


@_query("workspaces_deleted", f"WITH {_WS} SELECT * FROM ws WHERE deleted_at IS NOT NULL")
def workspaces_deleted(spark, d):
    return upkeep.listed(i.workspaces(spark, d), True)


@_query("recycle_soft_delete_restore", f"WITH {_WS} SELECT id, CAST(CASE WHEN id % 6 = 0 THEN NULL WHEN deleted_at IS NULL AND id % 8 = 0 THEN {i.NOW} ELSE deleted_at END AS BIGINT) deleted_at, CASE WHEN deleted_at IS NULL AND id % 8 = 0 THEN '{{\"recycle_retention_days\": 3}}' ELSE metadata END metadata FROM ws")
def recycle_soft_delete_restore(spark, d):
    gone = upkeep.soft_deleted(i.workspaces(spark, d), F.col("id") % 8 == 0, i.NOW, 3)
    return upkeep.restored(gone, F.col("id") % 6 == 0)


@_query("members_of_organisations", f"WITH m AS (SELECT o_custkey % 25 org, o_custkey AS user, max(CASE {_ROLE.format('o_orderkey')} WHEN 'owner' THEN 3 WHEN 'admin' THEN 2 WHEN 'member' THEN 1 ELSE 0 END) l FROM orders GROUP BY 1, 2) SELECT org, m.user, c_name email, CASE l WHEN 3 THEN 'owner' WHEN 2 THEN 'admin' WHEN 1 THEN 'member' ELSE 'viewer' END role FROM m JOIN customer ON c_custkey = m.user")
def members_of_organisations(spark, d):
    m = i.table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("org"), F.col("o_custkey").alias("user"), _role(F.col("o_orderkey")).alias("role"))
    return upkeep.members(m, i.table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("email")))


@_query("memberships_upserted", f"SELECT c_custkey AS user, c_nationkey org, CASE WHEN c_custkey % 3 = 0 THEN 'admin' ELSE {_ROLE.format('c_custkey')} END role FROM customer")
def memberships_upserted(spark, d):
    m = i.table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("org"), _role(F.col("c_custkey")).alias("role"))
    return upkeep.upserted(m, m.where("user % 3 = 0").withColumn("role", F.lit("admin")), ["user", "org"])
