import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from cairnspark.functions import digest as dg
from cairnspark.operators import bloom, chunking, diffs, history, ignore, sync, trees, upkeep


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_digests(spark):
    row = spark.range(1).select(
        dg.digest(F.lit("é")).alias("a"), dg.digest_children(F.array(F.lit(sha("x")), F.lit(sha("y")))).alias("b"),
        dg.version_id(F.array(F.lit(sha("p"))), F.lit(sha("r")), F.lit(258)).alias("c"),
        dg.digest_directory(F.array(F.struct(F.lit("b").alias("name"), F.lit(sha("1")).alias("hash")), F.struct(F.lit("a").alias("name"), F.lit(sha("2")).alias("hash")))).alias("d")).first()
    assert row.a == sha("é")
    assert row.b == sha(bytes.fromhex(sha("x") + sha("y")))
    assert row.c == sha(sha("p").encode() + bytes.fromhex(sha("r")) + (258).to_bytes(8, "little"))
    assert row.d == sha(b"a" + bytes.fromhex(sha("2")) + b"b" + bytes.fromhex(sha("1")))


def test_fixed_chunks_round_trip_and_empty(spark):
    f = files(spark, [("a", "é" * 5), ("b", ""), ("c", "xy")])
    c = chunking.fixed_chunks(f, 2)
    assert c.where("path = 'b'").select("ord", "len").collect() == [(0, 0)]
    got = {r.path: (r.content, r.missing) for r in chunking.reassembled(c, c, ["path"]).collect()}
    assert got == {"a": ("é" * 5, 0), "b": ("", 0), "c": ("xy", 0)}
    assert chunking.reassembled(c, c.where("len < 2"), ["path"]).where("path = 'c'").first().missing == 1


def test_content_defined_cuts():
    rnd = random.Random(7)
    p = chunking.Policy(256, 1024, 4096)
    data = rnd.randbytes(200_000)
    cuts = chunking.cut_points(data, p)
    sizes = [b - a for a, b in zip([0, *cuts], cuts)]
    assert cuts[-1] == len(data) and all(256 <= s <= 4096 for s in sizes[:-1]) and 512 < sum(sizes) / len(sizes) < 2048
    edited = data[:100_000] + b"!" * 128 + data[100_128:]
    own = lambda d, c: {d[a:b] for a, b in zip([0, *c], c)}
    assert len(own(data, cuts) & own(edited, chunking.cut_points(edited, p))) > len(cuts) * 0.9
    assert chunking.cut_points(b"", p) == [] and chunking.cut_points(b"x", p) == [1]
    same = chunking.cut_points(b"\xcd" * 65536, p)
    assert same[-1] == 65536 and max(b - a for a, b in zip([0, *same], same)) <= 4096


def test_cdc_chunks_cover_the_file(spark):
    f = files(spark, [("a", "".join(chr(97 + i * i % 23) for i in range(20_000))), ("b", ""), ("c", None)])
    rows = chunking.cdc_chunks(f, chunking.Policy(256, 1024, 4096)).orderBy("path", "ord").collect()
    a = [r for r in rows if r.path == "a"]
    assert b"".join(bytes(r.data) for r in a) == f.first().content.encode() and [r.off for r in a][1:] == [r.off + r.len for r in a][:-1]
    assert [(r.path, r.len) for r in rows if r.path != "a"] == [("b", 0), ("c", 0)]


def test_dedup_statistics(spark):
    c = chunking.fixed_chunks(files(spark, [("a", "xxyy"), ("b", "xxzz")]), 2)
    s = chunking.dedup_stats(c, None, ["path", "ord"]).first()
    assert (s.total_chunks, s.new_chunks, s.dedup_chunks, s.dedup_bytes) == (4, 3, 1, 2)
    s = chunking.dedup_stats(c, c.where("path = 'a'"), ["path", "ord"]).first()
    assert (s.new_chunks, s.dedup_chunks) == (1, 3)


def merkle(hashes, fan):
    while len(hashes) > 1:
        groups = [hashes[i : i + fan] for i in range(0, len(hashes), fan)]
        hashes = [g[0] if len(g) == 1 else sha(bytes.fromhex("".join(g))) for g in groups]
    return hashes[0]


@pytest.mark.parametrize("n", [1, 4, 5, 17, 64])
def test_merkle_roots_and_leaves(spark, n):
    hs = [sha(f"chunk-{i}") for i in range(n)]
    c = spark.createDataFrame([("f", i, 1, h) for i, h in enumerate(hs)], "path string, ord int, len int, hash string")
    r = trees.merkle_roots(c, ["path"], 4).first()
    assert (r.root, r.size, r.chunk_count) == (merkle(hs, 4), n, n)
    levels = trees.merkle_levels(c, ["path"], 4)
    assert trees.rehydrated(spark.createDataFrame([("f", r.root)], "path string, root string"), trees.tree_nodes(c, ["path"], 4), len(levels), ["path"]).first().leaves == hs


def test_directory_tree_of_mixed_depth(spark):
    f = spark.createDataFrame([("README.md", sha("1"), 1), ("src/main.rs", sha("2"), 2), ("src/util/helper.rs", sha("3"), 3)], "path string, hash string, size long")
    idx = {r.path: r for r in trees.directory_tree(f).collect()}
    assert set(idx) == {"", "README.md", "src", "src/main.rs", "src/util", "src/util/helper.rs"}
    d = lambda **e: sha(b"".join(n.replace("_", ".").encode() + bytes.fromhex(h) for n, h in sorted(e.items())))
    util = d(helper_rs=sha("3"))
    src = d(main_rs=sha("2"), util=util)
    assert idx["src"].node_hash == src and idx[""].node_hash == d(README_md=sha("1"), src=src) and idx["src"].n_children == 2
    names = lambda p: sorted(r.name for r in trees.list_directory(trees.directory_tree(f), p).collect())
    assert names("") == ["README.md", "src"] and names("src") == ["main.rs", "util"] and names("none") == []
    for bad in ("/bad", "a//b", "a/", "", None):
        with pytest.raises(ValueError):
            trees.directory_tree(f.unionAll(spark.createDataFrame([(bad, sha("4"), 4)], f.schema)))
    with pytest.raises(ValueError):
        trees.directory_tree(f.limit(0))


def test_diff_mirrors_and_is_empty_on_itself(spark):
    a = spark.createDataFrame([("keep", "1"), ("gone", "2"), ("mod", "3"), ("x", "9")], "path string, hash string")
    b = spark.createDataFrame([("keep", "1"), ("mod", "4"), ("new", "5"), ("x/inner", "9")], "path string, hash string")
    got = {(r.path, r.kind) for r in diffs.version_diff(a, b).collect()}
    assert got == {("gone", "removed"), ("mod", "modified"), ("new", "added"), ("x", "removed"), ("x/inner", "added")}
    flip = {"added": "removed", "removed": "added", "modified": "modified"}
    assert {(r.path, flip[r.kind]) for r in diffs.version_diff(b, a).collect()} == got
    assert diffs.version_diff(a, a).isEmpty()


def test_chunk_statistics(spark):
    t = "path string, ord int, hash string"
    oc = spark.createDataFrame([("f", i, h) for i, h in enumerate(["c1", "c2", "c3"])], t)
    nc = spark.createDataFrame([("f", i, h) for i, h in enumerate(["c1", "c2", "c4"])], t)
    o, n = (spark.createDataFrame([("f", h)], "path string, hash string") for h in ("r1", "r2"))
    assert tuple(diffs.chunk_stats(o, n, oc, nc).first()) == (1, 1, 2)
    assert tuple(diffs.chunk_stats(o, o, oc, oc).first()) == (0, 0, 0)


def test_checkout_and_partial_commit(spark):
    s = "path string, hash string, size long"
    head = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1)], s)
    local = spark.createDataFrame([("a", "1", 1), ("b", "x", 1), ("d", "4", 1)], s)
    act = lambda force: {r.path: r.action for r in diffs.checkout_plan(head, local, force).collect()}
    assert act(False) == {"a": "skip", "b": "conflict", "c": "write"} and act(True) == {"a": "skip", "b": "overwrite", "c": "write", "d": "delete"}
    staged = spark.createDataFrame([("b",), ("c",), ("d",)], "path string")
    assert {(r.path, r.hash) for r in diffs.partial_commit(head, staged, local).collect()} == {("a", "1"), ("b", "x"), ("d", "4")}


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "version_id string, parent_id string, ordinal int")


def test_version_graph(spark):
    e = graph(spark, [("b", "a", 0), ("c", "a", 0), ("d", "b", 0), ("d", "c", 1), ("e", "d", 0), ("z", "missing", 0)])
    start = lambda v: spark.createDataFrame([("s", v)], "start string, version_id string")
    assert {r.version_id: r.dist for r in history.ancestors(e, start("e")).collect()} == {"e": 0, "d": 1, "b": 2, "c": 2, "a": 3}
    cut = spark.createDataFrame([("s", "b")], "start string, version_id string")
    assert {r.version_id for r in history.ancestors(e, start("d"), cut=cut).collect()} == {"d", "c", "a"}
    inner, edge = history.shallow(e, start("e"), 2)
    assert {r.version_id for r in inner.collect()} == {"e", "d"} and {r.version_id for r in edge.collect()} == {"b", "c"}
    assert {r.version_id for r in history.shallow_boundary(inner, e).collect()} == {"b", "c"}
    tips = spark.createDataFrame([("m", "e")], "branch string, version_id string")
    assert [r.version_id for r in history.first_parent_history(e, tips, 10).orderBy("depth").collect()] == ["e", "d", "b", "a"]
    u = spark.createDataFrame([(1, "a", "e"), (2, "e", "a"), (3, "", "a"), (4, "000", "a"), (5, None, "a"), (6, "b", "b"), (7, "q", "e")], "ref int, old string, new string")
    assert {r.ref: r.allowed for r in history.is_fast_forward(e, u).collect()} == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False}
    p = spark.createDataFrame([("r", "b", "c")], "ref string, local string, remote string")
    assert tuple(history.ahead_behind(e, p).first()) == ("r", 1, 1)


def test_ignore_patterns(spark):
    m = ignore.Matcher.of({"": ["*.log", "build/", "!keep.log", "/top", "a/**/z", "docs/*.md"], "src": ["*.gen.ts"]})
    paths = {"x.log": True, "d/x.log": True, "keep.log": False, "build/o": True, "a/build/o": True, "build": False, "dist/o": False, ".git/x": True, "a/Thumbs.db": True, "top": True, "d/top": False, "a/z": True, "a/b/c/z": True, "docs/a.md": True, "docs/b/a.md": False,
             "src/a.gen.ts": True, "b.gen.ts": False, "node_modules/lodash/index.js": True, "src/main.rs": False}
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("i", m.matches(F.col("path")))
    assert {r.path: r.i for r in df.collect()} == paths == {p: m.ignores(p) for p in paths}


def test_bloom(spark):
    have = spark.range(500).select(dg.digest(F.col("id").cast("string")).alias("h"))
    f = bloom.build(have, "h", 500)
    assert have.where(~f.contains(F.col("h"))).isEmpty()
    others = spark.range(1000, 3000).select(dg.digest(F.col("id").cast("string")).alias("h"))
    assert others.where(f.contains(F.col("h"))).count() < 60
    assert bloom.Bloom.from_bytes(f.to_bytes()) == f
    for bad in (b"", f.to_bytes()[:-1], b"\x00" * 20):
        with pytest.raises(ValueError):
            bloom.Bloom.from_bytes(bad)


def test_packs(spark, tmp_path):
    o = spark.createDataFrame([("chunk", sha("a"), b"a"), ("chunk", sha("b"), b"b"), ("tree", sha("t"), b"{}")], "obj_type string, hash string, data binary")
    c = sync.write_pack(o, f"file://{tmp_path}/p")
    assert sync.read_pack(spark, f"file://{tmp_path}/p", c).count() == 3
    with pytest.raises(ValueError):
        sync.read_pack(spark, f"file://{tmp_path}/p", "0" * 64)
    sync.write_pack(spark.createDataFrame([("chunk", sha("a"), b"b")], o.schema), f"file://{tmp_path}/q")
    with pytest.raises(ValueError):
        sync.read_pack(spark, f"file://{tmp_path}/q")


def test_upkeep(spark):
    at = spark.createDataFrame([(3, 7200, 10800), (3, 14400, 97200), (3, 10800, 97200), (0, 90000, 172800), (23, 79200, 82800)], "h int, now long, want long")
    assert at.where(upkeep.next_run(F.col("now"), F.col("h")) != F.col("want")).isEmpty()
    w = spark.createDataFrame([(1, 0, '{"recycle_retention_days": 7}'), (2, 0, "bad"), (3, None, None), (4, 0, None)], "id int, deleted_at long, metadata string")
    assert {r.id for r in upkeep.purgeable(w, 8 * 86400).collect()} == {1} and {r.id for r in upkeep.purgeable(w, 30 * 86400).collect()} == {1, 2, 4}
    g = spark.createDataFrame([("a", 0), ("b", 0), ("c", 90_000)], "hash string, queued_at long")
    swept = upkeep.sweep(g, spark.createDataFrame([("a",)], "hash string"), 100_000)
    assert {r.hash: r.outcome for r in swept.collect()} == {"a": "revived", "b": "pending", "c": "waiting"} and tuple(upkeep.sweep_report(swept).first()) == (3, 1, 1, 1)
    with pytest.raises(ValueError):
        upkeep.lifecycle_class(F.lit(1), F.lit(False), 10, 90)


def version(spark, w, rows, ts, **more):
    return w.commit(spark.createDataFrame(rows, "path string, content binary"), f"at {ts}", ts, policy=chunking.Policy(64, 256, 1024), **more)["version_id"]


def noise(seed, n):
    return random.Random(seed).randbytes(n)


def test_warehouse(spark, tmp_path):
    from cairnspark.sources.warehouse import MissingChunk, RefError, Warehouse

    w = Warehouse(spark, f"file://{tmp_path}/w")
    body = noise(1, 9000)  # no text in any encoding
    one = version(spark, w, [("a.txt", b"hello"), ("d/b.bin", body), ("empty", b"")], 1)
    two = w.commit(spark.createDataFrame([("a.txt", b"hello"), ("d/b.bin", body[:4000] + b"inserted" + body[4000:]), ("empty", None)], "path string, content binary"), "second", 2, policy=chunking.Policy(64, 256, 1024))
    assert two["dedup_chunks"] > two["total_chunks"] / 2 and two["new_chunks"] >= 1
    assert {r.path: bytes(r.content) for r in w.files("main").collect()} == {"a.txt": b"hello", "d/b.bin": body[:4000] + b"inserted" + body[4000:], "empty": b""}
    assert {r.path: bytes(r.content) for r in w.files(one).collect()}["d/b.bin"] == body
    assert [r.path for r in diffs.version_diff(w.tree(one), w.tree("main")).collect()] == ["d/b.bin"]
    w.tag("v1", one)
    w.create_branch("dev", "HEAD")
    for bad in (lambda: w.put_ref("v1", two["version_id"]), lambda: w.tag("v1", "main"), lambda: w.create_branch("dev", one), lambda: w.put_ref("main", one, expected="something else"), lambda: version(spark, w, [("a", b"b")], 3, branch="v1"), lambda: w.resolve("none"), lambda: w.delete_ref("none"), lambda: w.put_ref("x", one, "note")):
        with pytest.raises(RefError):
            bad()
    for paths in ([("a//b", b"")], [("/a", b"")], [("", b"")], []):
        with pytest.raises(ValueError):
            version(spark, w, paths, 4)
    assert w.version("v1")["message"] == "at 1" and {r.version_id: r.dist for r in w.ancestors("main").collect()} == {two["version_id"]: 0, one: 1}
    # the index again from the node table alone
    was = sorted(tuple(r) for r in w.index("v1").collect())
    other = Warehouse(spark, f"file://{tmp_path}/again")
    for t in ("node_entries", "versions"):
        other.append(t, w.table(t))
    other.rebuild_index(one)
    assert sorted(tuple(r) for r in other.index(one).collect()) == was
    with pytest.raises(MissingChunk):
        other.files(one)


def test_refs_survive_torn_snapshots_and_races(spark, tmp_path):
    from cairnspark.sources.pointer import Conflict, Pointer

    p = Pointer(spark, f"file://{tmp_path}/p")
    assert p.latest("none") == (0, "none")
    p.swap(0, {"a": 1})
    with pytest.raises(Conflict):
        p.swap(0, {"a": 2})
    (tmp_path / "p" / "2").write_text("")  # what a writer without rename would leave
    assert p.latest(None) == (2, {"a": 1})
    p.swap(2, {"a": 3})
    assert p.latest(None) == (3, {"a": 3}) and not [x for x in (tmp_path / "p").iterdir() if x.name.startswith(".") and not x.name.endswith(".crc")]


def test_clone_copies_only_what_a_ref_reaches(spark, tmp_path):
    from cairnspark.sources import exchange
    from cairnspark.sources.warehouse import Warehouse

    w, other = Warehouse(spark, f"file://{tmp_path}/w"), Warehouse(spark, f"file://{tmp_path}/o")
    one = version(spark, w, [("a", noise(1, 3000))], 1)
    version(spark, w, [("secret", noise(2, 3000))], 2, branch="side")
    w.tag("v1", "main")
    w.clone_into(other, "v1")
    assert other.refs() == {"v1": {"kind": "tag", "target": one}} and [r.version_id for r in other.table("versions").collect()] == [one]
    assert other.table("chunks").count() < w.table("chunks").count() and other.verify().isEmpty() and other.files("v1").count() == 1
    have = {r.obj_type: r.n for r in exchange.sync.inventory(exchange.inventory(other, other.table("versions"))).collect()}
    assert have["version"] == 1 and have["node"] == 2 and have["chunk"] == other.table("chunks").count()


def test_push_pull_and_shallow_clone(spark, tmp_path):
    from cairnspark.sources import exchange
    from cairnspark.sources.warehouse import Warehouse

    here, there, third = (Warehouse(spark, f"file://{tmp_path}/{n}") for n in "htd")
    one, two = (version(spark, here, [("f", noise(0, 900) + bytes([k]))], k + 1) for k in range(2))
    assert exchange.push(here, there, ["main"], 10) == {"main": "ok"} and exchange.push(here, there, ["main"], 11) == {"main": "up-to-date"}
    s = there.control.sessions.rows().collect()
    assert [(r.status, r.direction, r.refs["main"]) for r in s] == [("completed", "push", two)] and s[0].objects > 3 and there.control.sent(s[0].session_id).isEmpty()
    assert [(r.ref, r.target) for r in here.control.tracked("origin").collect()] == [("main", two)]
    # a clone of depth 1, then the rest
    exchange.clone(there, third, depth=1)
    assert [r.version_id for r in third.table("versions").collect()] == [two] and [r.version_id for r in third.control.shallow.rows().collect()] == [one]
    exchange.unshallow(there, third)
    assert third.table("versions").count() == 2 and third.control.shallow.rows().isEmpty() and bytes(third.files(one).first().content)[-1] == 0
    # both sides go on: neither way is forward
    tip = version(spark, there, [("f", b"there")], 20)
    version(spark, here, [("f", b"here")], 21)
    assert exchange.pull(third, there, 31) == {"main": "fast-forward"} and bytes(third.files("HEAD").first().content) == b"there"
    assert exchange.push(here, there, ["main"], 22) == {"main": "non-fast-forward"} and exchange.pull(here, there, 23) == {"main": "diverged"}
    assert here.control.remote_refs.get(remote="origin", ref="main").target == tip and here.refs()["main"]["target"] != tip
    with pytest.raises(exchange.Refused):
        exchange.push(here, there, ["main"], 24, force=True, session_limit=1)
    assert there.refs()["main"]["target"] == tip and there.control.sessions.rows().where("status = 'failed'").count() == 1
    assert exchange.push(here, there, ["main"], 25, force=True) == {"main": "ok"} and there.refs()["main"] == here.refs()["main"]


def test_checkout_status_and_staged_commit(spark, tmp_path):
    from cairnspark.sources import checkout
    from cairnspark.sources.warehouse import Warehouse

    w, at = Warehouse(spark, f"file://{tmp_path}/w"), tmp_path / "tree"
    big = noise(4, 70_000)
    w.commit(spark.createDataFrame([("a", b"A"), ("d/b", big), ("d/c", b"C")], "path string, content binary"), "first", 1)
    assert checkout.checkout(w, "main", str(at)) == {"write": 3, "overwrite": 0, "skip": 0, "conflict": 0, "delete": 0}
    assert (at / "d/b").read_bytes() == big and checkout.status(w, "main", str(at)).isEmpty()
    (at / "a").write_bytes(b"changed")
    (at / "d/c").unlink()
    (at / "new").write_bytes(b"\xff\xfe")
    (at / "x.tmp").write_bytes(b"ignored")
    (at / "keep.log").write_text("")
    (at / "sub").mkdir()
    (at / "sub/.cairnignore").write_text("*.gen\n")
    (at / "sub/y.gen").write_text("")
    changes = {"a": "modified", "d/c": "deleted", "new": "untracked", "keep.log": "untracked"}
    for _ in range(2):  # the second time from the cache
        assert {r.path: r.change for r in checkout.status(w, "main", str(at), workspace="ws").collect()} == changes
    assert w.control.worktree.rows().count() == 4
    (at / "d/b").write_bytes(big[:-1] + b"!")
    os.utime(at / "d/b", (5, 5))  # another time: a miss
    assert {r.path: r.change for r in checkout.status(w, "main", str(at), workspace="ws").collect()} == changes | {"d/b": "modified"}
    assert checkout.checkout(w, "main", str(at)) == {"write": 1, "overwrite": 0, "skip": 0, "conflict": 2, "delete": 0}
    assert (at / "a").read_bytes() == b"changed"
    (at / "d/c").unlink()
    staged = spark.createDataFrame([("new",), ("d/c",)], "path string")
    checkout.commit_staged(w, str(at), staged, "staged", 2)
    assert {r.path: bytes(r.content) for r in w.files("main").collect()} == {"a": b"A", "d/b": big, "new": b"\xff\xfe"}
    assert checkout.checkout(w, "main", str(at), force=True) == {"write": 0, "overwrite": 2, "skip": 1, "conflict": 0, "delete": 1}
    assert sorted(str(p.relative_to(at)) for p in at.rglob("*") if p.is_file()) == ["a", "d/b", "new", "sub/.cairnignore", "sub/y.gen", "x.tmp"]
    with pytest.raises(ValueError):
        checkout.commit_staged(w, str(at), staged.limit(0), "nothing", 3)


def test_an_old_store_is_migrated(spark, tmp_path):
    """Chunks of text with lengths in characters become chunks of bytes, and a node table is made."""
    from cairnspark.sources.config import Config
    from cairnspark.sources.warehouse import Warehouse

    w = Warehouse(spark, f"file://{tmp_path}/old")
    text = "é" * 3000
    old = chunking.fixed_chunks(files(spark, [("a", "x"), ("d/b", text)]))
    roots = trees.merkle_roots(old, ["path"])
    index = trees.directory_tree(roots.select("path", F.col("root").alias("hash"), "size"))
    old.select("hash", "data", "len").write.parquet(f"{w.root}/chunks")
    old.join(roots.select("path", "root"), "path").select("root", "ord", "off", "len", "hash").write.parquet(f"{w.root}/file_chunks")
    index.withColumn("version_id", F.lit("v")).write.partitionBy("version_id").parquet(f"{w.root}/path_index")
    spark.createDataFrame([("v", index.where("path = ''").first().node_hash, "m", 1, {}, [])], "version_id string, root string, message string, ts long, metadata map<string,string>, parents array<string>").write.parquet(f"{w.root}/versions")
    w = Config(local=str(tmp_path / "old")).open(spark)
    assert w.layout()["version"] == 2 and Warehouse(spark, w.root).layout() == w.layout()
    assert {r.path: bytes(r.content).decode() for r in w.files("v").collect()} == {"a": "x", "d/b": text} and w.verify().isEmpty()
    assert sorted((r.ord, r.off, r.len) for r in w.table("file_chunks").where("off > 0 OR len > 10").collect()) == [(0, 0, 4096), (1, 4096, 1904)]
    again = trees.walked(w.table("versions").select("root"), w.table("node_entries")).where("NOT missing").select("path", "node_hash").collect()
    assert sorted(map(tuple, again)) == sorted((r.path, r.node_hash) for r in w.index("v").collect())


def test_config(tmp_path):
    from cairnspark.sources.config import Config

    (tmp_path / "c.toml").write_text('[store]\nlocal = "/x"\n')
    assert Config.from_file(str(tmp_path / "c.toml")) == Config("/x") and Config.from_env({"CAIRN_CLOUD": "s3a://b/p"}) == Config(None, "s3a://b/p")
    for bad in ({}, {"CAIRN_LOCAL": "/x", "CAIRN_CLOUD": "s3a://b"}, {"CAIRN_CLOUD": "b"}):
        with pytest.raises(ValueError):
            Config.from_env(bad)


def test_key_values(spark, tmp_path):
    from cairnspark.sources.records import KeyValues, NotFound

    kv = KeyValues(spark, f"file://{tmp_path}/kv")
    kv.put("a/1", {"x": "y" * 20_000})
    kv.put("a/2", 5)
    kv.put("a/2", [6])
    kv.put("b", None)
    assert kv.get("a/1")["x"] == "y" * 20_000 and [k for k, _ in kv.scan("a/")] == ["a/1", "a/2"] and kv.get("a/2") == [6] and kv.get("b") is None
    kv.delete("a/1")
    with pytest.raises(NotFound):
        kv.get("a/1")


def test_cancelling(spark):
    import threading

    from cairnspark.sources.cancel import Cancelled, CancelToken

    t = CancelToken(spark)
    with t.within():
        assert spark.range(3).count() == 3
    threading.Timer(2, t.cancel).start()
    with pytest.raises(Cancelled), t.within():
        spark.range(1 << 50).where("sqrt(id) < 0").count()
    with pytest.raises(Cancelled), t.within():
        pass


def test_reading_one_file_and_listings(spark, tmp_path):
    from cairnspark.sources.warehouse import MissingChunk, Warehouse

    w, body = Warehouse(spark, f"file://{tmp_path}/w"), noise(3, 6000)
    version(spark, w, [("d/b", body), ("a", b"A")], 1)
    parts = list(w.read_file("main", "d/b"))
    assert len(parts) > 3 and b"".join(parts) == body and [r.name for r in w.listing("main").collect()] == ["a", "d"] and [r.path for r in w.listing("main", "d").collect()] == ["d/b"]
    for error, call in ((FileNotFoundError, lambda: list(w.read_file("main", "d"))), (FileNotFoundError, lambda: w.listing("main", "x")), (NotADirectoryError, lambda: w.listing("main", "a"))):
        with pytest.raises(error):
            call()
    other = Warehouse(spark, f"file://{tmp_path}/o")
    for t in ("versions", "path_index", "file_chunks"):
        other.append(t, w.table(t))
    with pytest.raises(MissingChunk):
        list(other.read_file(w.resolve("main"), "a"))


def test_control_tables(spark, tmp_path):
    from cairnspark.sources.control import Control
    from cairnspark.sources.records import Exists, NotFound

    c = Control(spark, f"file://{tmp_path}/c")
    assert c.sessions.rows().isEmpty()
    # sessions
    a, b = c.begin("origin", "push", 100), c.begin("origin", "push", 200)
    c.note_sent(a, spark.createDataFrame([("h1",), ("h1",), ("h2",)], "hash string"))
    c.note_sent(a, spark.createDataFrame([("h2",), ("h3",)], "hash string"))
    assert sorted(r.hash for r in c.sent(a).collect()) == ["h1", "h2", "h3"]
    assert c.find_resumable("origin", "push", 210, 60) == b and c.find_resumable("origin", "push", 300, 60) is None and c.find_resumable("other", "push", 210, 60) is None
    assert c.expire(230, 100) == 1 and c.sessions.get(session_id=a).status == "failed" and c.sessions.get(session_id=b).status == "running"
    c.complete(b, 250, 3, 40)
    assert tuple(c.sessions.get(session_id=b)[x] for x in ("status", "objects", "bytes")) == ("completed", 3, 40)
    # remotes
    c.remotes.add([("origin", "u")])
    with pytest.raises(Exists):
        c.remotes.add([("origin", "v")])
    c.remote_refs.put([("origin", "b", "t1", 1), ("origin", "a", "t2", 1), ("else", "a", "t", 1)])
    c.remote_refs.put([("origin", "b", "t3", 2)])
    assert [(r.ref, r.target) for r in c.tracked("origin").collect()] == [("a", "t2"), ("b", "t3")]
    c.remove_remote("origin")
    with pytest.raises(NotFound):
        c.remotes.get(name="origin")
    assert c.remote_refs.rows().count() == 1
    # garbage and its lock
    c.garbage.put([("g1", 1), ("g2", 2)])
    assert c.drain(c.garbage, spark.createDataFrame([("g1",), ("zz",)], "hash string")) == 1 and c.garbage.rows().count() == 1
    ticks = iter(range(100))
    inner = []
    run = c.collect_once("full", 1000, 60, lambda: inner.append(c.collect_once("full", 1001, 60, lambda: 1, lambda: 0)) or 7, lambda: next(ticks))
    assert run["deleted"] == 7 and inner == [None]
    with pytest.raises(ZeroDivisionError):
        c.collect_once("full", 1002, 60, lambda: 1 // 0, lambda: 0)
    assert c.collect_once("full", 1003, 60, lambda: 2, lambda: 0)["deleted"] == 2
    assert [(r.runs, r.objects) for r in upkeep.gc_metrics(c.gc_runs.rows()).collect()] == [(2, 9)]
    # workspaces
    c.workspaces.add([("w1", "o1", "n", 1, None, None), ("w2", "o1", "m", 1, None, None)])
    c.soft_delete("w1", 1000, 7)
    with pytest.raises(NotFound):
        c.soft_delete("w1", 2000)
    assert c.purge(1000 + 6 * 86_400) == 0
    c.restore("w1")
    c.soft_delete("w2", 1000)
    assert c.purge(1000 + 30 * 86_400) == 1 and [r.id for r in upkeep.listed(c.workspaces.rows(), False).collect()] == ["w1"]
    # tenants
    c.tenants.add([("t1", "T")])
    c.orgs.add([("o1", "t1", "O"), ("o2", "t2", "P")])
    c.create_user("u1", "A@x.org")
    with pytest.raises(Exists):
        c.create_user("u2", "a@X.org")
    c.memberships.put([("o1", "u1", "member"), ("o2", "u1", "viewer")])
    c.memberships.put([("o1", "u1", "owner")])
    assert c.memberships.get(org="o1", user="u1").role == "owner"
    c.delete_tenant("t1")
    assert c.workspaces.rows().isEmpty() and [r.org for r in c.memberships.rows().collect()] == ["o2"] and [r.id for r in c.orgs.rows().collect()] == ["o2"]
    c.delete_user("u1")
    assert c.memberships.rows().isEmpty()


def test_status_when_the_cache_misses(spark):
    head = spark.createDataFrame([("hit", sha("1"), 1), ("miss", sha("2"), 1), ("changed", sha("3"), 1), ("gone", sha("4"), 1)], "path string, hash string, size long")
    local = spark.createDataFrame([("hit", None, 1, 5, b"1"), ("miss", None, 1, 5, b"2"), ("changed", None, 1, 6, b"x")], "path string, hash string, size long, mtime long, content binary")
    cache = spark.createDataFrame([("hit", 5, 1, sha("1")), ("miss", 4, 1, sha("z")), ("changed", 6, 1, "not a digest")], "path string, mtime long, size long, hash string")
    assert {r.path: r.change for r in diffs.working_tree_status(head, local, cache).collect()} == {"changed": "modified", "gone": "deleted"}
    with pytest.raises(Exception, match="neither a cached hash nor content"):
        diffs.working_tree_status(head, local.drop("content"), cache).collect()


def test_deep_history(spark):
    """A chain of 10,000 versions, within a task; and the same answers by rounds when a graph isn't to be broadcast."""
    e = graph(spark, [(f"v{k}", f"v{k - 1}", 0) for k in range(1, 10_000)])
    start = spark.createDataFrame([("s", "v9999"), ("t", "v5"), ("u", None)], "start string, version_id string")
    assert {r.start: (r.n, r.far) for r in history.ancestors(e, start).groupBy("start").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect()} == {"s": (10_000, 9_999), "t": (6, 5)}
    u = spark.createDataFrame([(1, "v0", "v9999"), (2, "v9999", "v0")], "ref int, old string, new string")
    assert {r.ref: r.allowed for r in history.is_fast_forward(e, u).collect()} == {1: True, 2: False}
    tip = spark.createDataFrame([("m", "v9999")], "branch string, version_id string")
    assert history.first_parent_history(e, tip, 20_000).count() == 10_000


def test_history_by_rounds(spark, monkeypatch):
    e = graph(spark, [("b", "a", 0), ("c", "a", 0), ("d", "b", 0), ("d", "c", 1), ("e", "d", 0)])
    s = spark.createDataFrame([(1, "e"), (2, "c"), (2, "b")], "start int, version_id string")
    cut = spark.createDataFrame([(1, "b")], "start int, version_id string")
    tip = spark.createDataFrame([("m", "e")], "branch string, version_id string")
    found = lambda: [sorted(tuple(r) for r in df.collect()) for df in (history.ancestors(e, s), history.ancestors(e, s, 1), history.ancestors(e, s, cut=cut), history.first_parent_history(e, tip, 3))]
    small = found()
    monkeypatch.setattr(history, "BROADCAST_EDGES", 1)
    assert found() == small


def test_ahead_behind_of_nothing(spark):
    e = graph(spark, [("b", "a", 0)])
    p = spark.createDataFrame([("r", "b", None), ("s", None, "b"), ("t", None, None), ("u", "b", "a")], "ref string, local string, remote string")
    assert {r.ref: (r.ahead, r.behind) for r in history.ahead_behind(e, p).collect()} == {"r": (2, 0), "s": (0, 2), "t": (0, 0), "u": (1, 0)}


def test_negotiation_above_the_limit_of_digests(spark, monkeypatch):
    offered = spark.range(400).select(F.col("id"), dg.digest(F.col("id").cast("string")).alias("hash"))
    have = offered.where("id % 3 = 0")
    want = sorted(r.id for r in offered.where("id % 3 <> 0").collect())
    assert bloom.have_filter(have, "hash") is None
    assert sorted(r.id for r in bloom.negotiated(offered, have).collect()) == want
    monkeypatch.setattr(bloom, "USE_FROM", 10)
    assert bloom.have_filter(have, "hash") is not None
    assert sorted(r.id for r in bloom.negotiated(offered, have).collect()) == want


def test_sources(spark, tmp_path):
    from cairnspark.sources.warehouse import read_tree, read_uploads

    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/a.txt").write_bytes(b"\xff\x00")
    (tmp_path / "t/sub/b.log").write_text("B")
    (tmp_path / "t/sub/__init__.py").write_text("")
    (tmp_path / "t/.hidden").write_text("h")
    (tmp_path / "t/link").symlink_to(tmp_path / "t/a.txt")
    assert {(r.path, bytes(r.content), r.size) for r in read_tree(spark, str(tmp_path / "t")).collect()} == {("a.txt", b"\xff\x00", 2), ("sub/b.log", b"B", 1), ("sub/__init__.py", b"", 0), (".hidden", b"h", 1)}
    assert sorted(r.path for r in read_tree(spark, f"file://{tmp_path}/t", ignore.Matcher.of({"": ["*.log"]})).collect()) == [".hidden", "a.txt", "sub/__init__.py"]
    up = spark.createDataFrame([([("p", "aP8="), ("q", "%%%")],)], "files array<struct<path:string,content_base64:string>>")
    assert {(r.path, r.content and bytes(r.content), r.valid) for r in read_uploads(up).collect()} == {("p", b"h\xff", True), ("q", None, False)}


def test_streaming_ingest(spark, tmp_path):
    from cairnspark.streaming.ingest import ingest

    src = tmp_path / "in"
    for k, rows in enumerate(([("a", "xx"), ("b", "xx"), ("c", "yy")], [("d", "yy"), ("e", "zz"), ("f", "zz"), ("g", "qq")])):
        files(spark, rows).coalesce(1).write.parquet(str(src / str(k)))
        stream = spark.readStream.schema("path string, content string").option("recursiveFileLookup", True).parquet(str(src))
        ingest(stream, f"file://{tmp_path}/store", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/store")
    assert sorted(bytes(r.data) for r in got.collect()) == [b"qq", b"xx", b"yy", b"zz"]


def test_session_totals(spark, tmp_path):
    from cairnspark.streaming.ingest import session_totals

    rows = [("r", "2024-01-01 00:00:00", 5), ("r", "2024-01-01 00:30:00", 7), ("r", "2024-01-01 03:00:00", 1), ("s", "2024-01-01 00:10:00", 2)]
    e = spark.createDataFrame(rows, "remote string, ts string, bytes long").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.remote, r.objects, r.bytes) for r in session_totals(e).collect()) == [("r", 1, 1), ("r", 2, 12), ("s", 1, 2)]
