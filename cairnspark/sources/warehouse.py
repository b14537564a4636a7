"""A versioned store on Parquet: object tables that only grow, and small refs behind one atomically replaced pointer.

Every table has an explicit schema; contents are bytes. Objects are written before the version, the version before its
path index, and the ref last; so a commit that dies half-way leaves nothing that a reader can see. Refs are a snapshot
each time, and compare-and-swap makes the next numbered snapshot, so of two writers one fails and sees it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions.digest import digest, version_id
from cairnspark.operators import chunking, history, trees
from cairnspark.sources import migrations
from cairnspark.sources.control import Control
from cairnspark.sources.pointer import Conflict, Pointer
from cairnspark.sources.shipping import ship

SCHEMAS = {
    "chunks": "hash string, data binary, len int",
    "tree_nodes": "hash string, kind string, children array<string>",
    "file_chunks": "root string, ord int, off bigint, len int, hash string",
    "node_entries": "hash string, kind string, size bigint, children array<struct<name:string,hash:string>>",
    "path_index": "path string, node_hash string, is_directory boolean, size bigint, n_children int, version_id string",
    "versions": "version_id string, root string, message string, ts bigint, metadata map<string,string>, parents array<string>",
}
MAIN = "main"


class RefError(ValueError):
    """A ref that doesn't exist, exists already, can't change, or has moved."""


class MissingChunk(ValueError):
    """A file whose chunks aren't all there."""


@dataclass
class Warehouse:
    spark: SparkSession
    root: str

    def __post_init__(self):
        self._layout = None

    @property
    def control(self) -> Control:
        return Control(self.spark, self.root)

    # --- tables ---
    def layout(self) -> dict:
        """The store's schema version, and the folders of tables that a migration has written anew. A store older than its folders is migrated when it is opened."""
        if self._layout is None:
            number, found = self._schema().latest(None)
            if found is None and self._exists(f"{self.root}/chunks"):
                found = migrations.run(self, 1)
            self._layout = found or {"version": migrations.CURRENT, "folders": {}}
            if found is None:
                self._schema().swap(number, self._layout)
        return self._layout

    def _schema(self) -> Pointer:
        return Pointer(self.spark, f"{self.root}/_schema")

    def _exists(self, path: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def folder(self, name: str) -> str:
        return f"{self.root}/{self.layout()['folders'].get(name, name)}"

    def table(self, name: str) -> DataFrame:
        if not self._exists(self.folder(name)):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.folder(name))

    def append(self, name: str, rows: DataFrame, *partition_by: str) -> None:
        w = rows.select(*self.table(name).columns).write.mode("append").option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(self.folder(name))

    # --- refs ---
    def _refs(self) -> Pointer:
        return Pointer(self.spark, f"{self.root}/refs")

    def refs(self) -> dict[str, dict]:
        return self._refs().latest({})[1]

    def _swap(self, number: int, refs: dict) -> None:
        try:
            self._refs().swap(number, refs)
        except Conflict as e:
            raise RefError("another writer has changed the refs") from e

    def put_ref(self, name: str, target: str, kind: str = "branch", expected: object = ...) -> None:
        """Creates or moves a ref. Tags never move. With `expected` (None: must not exist) it must be there now."""
        if kind not in ("branch", "tag"):
            raise RefError(f"no kind of ref {kind!r}")
        number, refs = self._refs().latest({})
        now = refs.get(name)
        if now and now["kind"] == "tag":
            raise RefError(f"tag {name!r} can't change")
        if expected is not ... and (now["target"] if now else None) != expected:
            raise RefError(f"{name!r} isn't at {expected!r}")
        self._swap(number, refs | {name: {"kind": kind, "target": target}})

    def create_branch(self, name: str, at: str) -> None:
        self.put_ref(name, self.resolve(at), expected=None)

    def tag(self, name: str, at: str) -> None:
        self.put_ref(name, self.resolve(at), "tag", expected=None)

    def delete_ref(self, name: str) -> None:
        number, refs = self._refs().latest({})
        if name not in refs:
            raise RefError(f"no ref {name!r}")
        self._swap(number, {k: v for k, v in refs.items() if k != name})

    def resolve(self, name: str = "HEAD") -> str:
        """A version id as it is, else a ref's target; HEAD is the branch main."""
        if not self.table("versions").where(F.col("version_id") == name).isEmpty():
            return name
        refs = self.refs()
        name = MAIN if name == "HEAD" else name
        if name not in refs:
            raise RefError(f"nothing is called {name!r}")
        return refs[name]["target"]

    # --- versions ---
    def version(self, name: str) -> dict:
        one = self.resolve(name)
        row = self.table("versions").where(F.col("version_id") == one).first()
        if row is None:
            raise RefError(f"version {one} isn't here")
        return row.asDict()

    def edges(self) -> DataFrame:
        return self.table("versions").select("version_id", F.posexplode("parents").alias("ordinal", "parent_id"))

    def ancestors(self, *names: str, depth: int | None = None) -> DataFrame:
        """version_id, dist of all that these names reach."""
        starts = self.spark.createDataFrame([(0, self.resolve(n)) for n in names], "start int, version_id string")
        return history.ancestors(self.edges(), starts, depth).select("version_id", "dist")

    def create_version(self, root: str, message: str, ts: int, parents: list[str], metadata: dict | None = None) -> str:
        """A version of a root, whether or not its nodes are here; the id of an equal one if there is one."""
        one = self.spark.range(1).select(version_id(F.array(*[F.lit(p) for p in parents]).cast("array<string>"), F.lit(root), F.lit(ts)).alias("id")).first()["id"]
        if self.table("versions").where(F.col("version_id") == one).isEmpty():
            meta = F.from_json(F.lit(json.dumps(metadata or {})), "map<string,string>")
            self.append("versions", self.spark.createDataFrame([(one, root, message, ts, parents)], "version_id string, root string, message string, ts bigint, parents array<string>").withColumn("metadata", meta))
        return one

    # --- commits ---
    def commit(self, files: DataFrame, message: str, ts: int, branch: str = MAIN, parents: list[str] | None = None, policy: chunking.Policy = chunking.Policy(), metadata: dict | None = None) -> dict:
        """Stores files (path, content as bytes or strings, of equal paths the last by seq) as a new version on a branch; returns its id, root and dedup figures."""
        refs = self.refs()
        if branch in refs and refs[branch]["kind"] == "tag":
            raise RefError(f"{branch!r} is a tag")
        tip = refs[branch]["target"] if branch in refs else None
        parents = ([tip] if tip else []) if parents is None else parents
        content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
        order = F.col("seq") if "seq" in files.columns else digest(content)
        last = files.select("path", content.alias("content"), order.alias("_o")).groupBy("path").agg(F.max_by("content", "_o").alias("content"))
        chunks = chunking.cdc_chunks(last, policy).persist()
        try:
            roots = trees.merkle_roots(chunks, ["path"])
            index = trees.directory_tree(roots.select("path", F.col("root").alias("hash"), "size")).persist()
            stats = chunking.dedup_stats(chunks, self.table("chunks"), ["path", "ord"]).first().asDict()
            root = index.where("path = ''").first()["node_hash"]
            self.append("chunks", chunking.new_chunks(chunks, self.table("chunks")))
            nodes = trees.tree_nodes(chunks, ["path"])
            self.append("tree_nodes", nodes.join(self.table("tree_nodes").select("hash"), "hash", "left_anti"))
            new_files = chunks.join(roots.select("path", "root"), "path").drop("path", "data").dropDuplicates(["root", "ord"])
            self.append("file_chunks", new_files.join(self.table("file_chunks").select("root").distinct(), "root", "left_anti"))
            self.append("node_entries", trees.node_entries(index).join(self.table("node_entries").select("hash", "kind"), ["hash", "kind"], "left_anti"))
            one = self.create_version(root, message, ts, parents, metadata)
            self.put_index(one, index)
            index.unpersist()
        finally:
            chunks.unpersist()
        self.put_ref(branch, one, expected=tip)
        return {"version_id": one, "root": root, **stats}

    def put_index(self, one: str, index: DataFrame) -> None:
        if self.table("path_index").where(F.col("version_id") == one).isEmpty():
            self.append("path_index", index.withColumn("version_id", F.lit(one)), "version_id")

    def rebuild_index(self, *versions: str) -> None:
        """Writes the path index of versions that have none, from their roots and the node table."""
        have = self.table("path_index").select("version_id").distinct()
        wanted = self.table("versions").where(F.col("version_id").isin(list(versions))) if versions else self.table("versions")
        roots = wanted.join(have, "version_id", "left_anti").select("version_id", "root")
        found = trees.walked(roots, self.table("node_entries"), ["version_id"]).where("NOT missing").drop("missing")
        self.append("path_index", found, "version_id")

    # --- reading ---
    def index(self, name: str) -> DataFrame:
        return self.table("path_index").where(F.col("version_id") == self.resolve(name)).drop("version_id")

    def tree(self, name: str) -> DataFrame:
        """path, hash, size of a version's files."""
        return self.index(name).where("NOT is_directory").select("path", F.col("node_hash").alias("hash"), "size")

    def files(self, name: str, paths: DataFrame | None = None) -> DataFrame:
        """path, content (bytes) of a version's files, or of those in `paths`. A chunk that isn't there: MissingChunk, before any row."""
        tree = self.tree(name) if paths is None else self.tree(name).join(paths.select("path"), "path", "left_semi")
        own = self.table("file_chunks").select("root", "ord", "hash")
        parts = tree.select("path", F.col("hash").alias("root")).join(own, "root", "left").select("path", "ord", "hash")
        lost = parts.join(self.table("chunks").select("hash"), "hash", "left_anti").select("path").first()
        if lost is not None:
            raise MissingChunk(f"{lost['path']!r} lacks a chunk")
        return chunking.reassembled(parts, self.table("chunks"), ["path"]).select("path", "content")

    def listing(self, name: str, directory: str = "") -> DataFrame:
        """name, path, node_hash, is_directory, size of what lies in a directory; NotADirectoryError or FileNotFoundError if it is none."""
        index = self.index(name)
        at = index.where(F.col("path") == directory).first()
        if at is None:
            raise FileNotFoundError(directory)
        if not at["is_directory"]:
            raise NotADirectoryError(directory)
        return trees.list_directory(index, directory).orderBy("name")

    def read_file(self, name: str, path: str):
        """The bytes of one file, a chunk at a time and in order: only a chunk is on the driver."""
        row = self.index(name).where(F.col("path") == path).first()
        if row is None or row["is_directory"]:
            raise FileNotFoundError(path)
        own = self.table("file_chunks").where(F.col("root") == row["node_hash"]).select("ord", "hash").dropDuplicates(["ord"])
        got = own.join(self.table("chunks").select("hash", "data").dropDuplicates(["hash"]), "hash", "left").orderBy("ord")
        for r in got.select("data").toLocalIterator():
            if r["data"] is None:
                raise MissingChunk(f"{path!r} lacks a chunk")
            yield bytes(r["data"])

    def verify(self) -> DataFrame:
        """Chunks whose data isn't what their digest says; empty if all is well."""
        return self.table("chunks").where(digest(F.col("data")) != F.col("hash")).select("hash")

    def clone_into(self, other: "Warehouse", name: str) -> None:
        """Copies a version, with all it needs and its ancestors, and then the ref with its kind."""
        from cairnspark.sources.exchange import clone

        clone(self, other, [name])


def read_tree(spark: SparkSession, folder: str, matcher=None) -> DataFrame:
    """path (relative), content (bytes), size, mtime (nanoseconds) of the files under a folder that aren't ignored, read by executors."""
    from cairnspark.sources.folders import content_reader, listed

    rows = [(path, size, mtime) for path, size, mtime in listed(folder) if matcher is None or not matcher.ignores(path)]
    ship(spark)
    files = spark.createDataFrame(rows, "path string, size long, mtime long")
    return files.mapInArrow(content_reader(folder), "path string, content binary, size long, mtime long")


def read_uploads(requests: DataFrame) -> DataFrame:
    """path, content (bytes), valid from rows with files array<struct<path, content_base64>>; invalid base64 is null content."""
    f = requests.select(F.explode("files").alias("f"))
    raw = F.expr("try_to_binary(f.content_base64, 'base64')")
    return f.select("f.path", raw.alias("content"), raw.isNotNull().alias("valid"))
