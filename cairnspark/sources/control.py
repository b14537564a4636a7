"""The small tables around a store: sessions with manifests, remotes and tracking refs, garbage, workspaces, organisations, members."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.operators import sync, upkeep
from cairnspark.sources.pointer import Conflict, Pointer
from cairnspark.sources.records import Records

TABLES = {
    "sessions": ("session_id string, remote string, direction string, status string, started_at long, ended_at long, objects long, bytes long, error string, refs map<string,string>", ("session_id",)),
    "remotes": ("name string, url string", ("name",)),
    "remote_refs": ("remote string, ref string, target string, at long", ("remote", "ref")),
    "shallow": ("version_id string", ("version_id",)),
    "garbage": ("hash string, queued_at long", ("hash",)),
    "pending": ("hash string, marked_at long", ("hash",)),
    "gc_runs": ("run_id string, kind string, at long, deleted long, seconds double", ("run_id",)),
    "workspaces": ("id string, org string, name string, created_at long, deleted_at long, metadata string", ("id",)),
    "tenants": ("id string, name string", ("id",)),
    "orgs": ("id string, tenant string, name string", ("id",)),
    "users": ("id string, email string", ("id",)),
    "memberships": ("org string, user string, role string", ("org", "user")),
    "worktree": ("workspace string, path string, mtime long, size long, hash string", ("workspace", "path")),
}
#: Tables whose rows grow with the objects or files of a store.
LARGE = ("garbage", "pending", "worktree")
#: Of the newest sessions, how many are looked at for one to resume and for stale ones.
RESUME_AMONG, EXPIRE_AMONG = 50, 200


@dataclass
class Control:
    """Opening it needs nothing: a table that was never written is empty, and has its schema."""

    spark: SparkSession
    root: str

    def __getattr__(self, name: str) -> Records:
        if name not in TABLES:
            raise AttributeError(name)
        return Records(self.spark, f"{self.root}/control/{name}", *TABLES[name], large=name in LARGE)

    def _manifest(self, session: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/control/manifests/{session}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    # --- sessions ---
    def begin(self, remote: str, direction: str, now: int, refs: dict[str, str] | None = None) -> str:
        one = uuid.uuid4().hex
        self.sessions.add([(one, remote, direction, "running", now, None, 0, 0, None, refs or {})])
        return one

    def complete(self, session: str, now: int, objects: int, size: int) -> None:
        self.sessions.update(F.col("session_id") == session, status=F.lit("completed"), ended_at=F.lit(now), objects=F.lit(objects), bytes=F.lit(size))
        path, fs = self._manifest(session)
        fs.delete(path, True)

    def fail(self, session: str, now: int, error: str) -> None:
        self.sessions.update(F.col("session_id") == session, status=F.lit("failed"), ended_at=F.lit(now), error=F.lit(error))

    def find_resumable(self, remote: str, direction: str, now: int, ttl: int) -> str | None:
        row = sync.resumable(sync.recent_sessions(self.sessions.rows(), RESUME_AMONG, remote).where(F.col("direction") == direction), now, ttl).first()
        return row["session_id"] if row else None

    def expire(self, now: int, ttl: int) -> int:
        """Marks running sessions of ttl or older as failed; returns how many."""
        old = [r["session_id"] for r in sync.expired(sync.recent_sessions(self.sessions.rows(), EXPIRE_AMONG), now, ttl).select("session_id").collect()]
        if old:
            self.sessions.update(F.col("session_id").isin(old), status=F.lit("failed"), ended_at=F.lit(now), error=F.lit("expired"))
        return len(old)

    def note_sent(self, session: str, hashes: DataFrame) -> None:
        """Appends digests to a session's manifest; `sent` has each once."""
        hashes.select("hash").write.mode("append").parquet(str(self._manifest(session)[0]))

    def sent(self, session: str) -> DataFrame:
        path, fs = self._manifest(session)
        return self.spark.read.schema("hash string").parquet(str(path)).distinct() if fs.exists(path) else self.spark.createDataFrame([], "hash string")

    # --- remotes ---
    def remove_remote(self, name: str) -> None:
        """Removes a remote and what is tracked of it."""
        self.remotes.get(name=name)
        self.remotes.delete(F.col("name") == name)
        self.remote_refs.delete(F.col("remote") == name)

    def tracked(self, remote: str) -> DataFrame:
        return self.remote_refs.rows().where(F.col("remote") == remote).orderBy("ref")

    # --- collections ---
    def collect_once(self, kind: str, now: int, ttl: int, work, clock) -> dict | None:
        """Runs work() -> number of deleted objects under a lock that ends after ttl, and notes the run; None if another holds the lock. The lock goes also when work fails."""
        lock, owner = Pointer(self.spark, f"{self.root}/control/gc_lock"), uuid.uuid4().hex
        number, held = lock.latest(None)
        if held and now - held["at"] < ttl:
            return None
        try:
            lock.swap(number, {"owner": owner, "at": now})
        except Conflict:
            return None
        began = clock()
        try:
            deleted = work()
            run = {"run_id": owner, "kind": kind, "at": now, "deleted": deleted, "seconds": float(clock() - began)}
            self.gc_runs.add([tuple(run.values())])
            return run
        finally:
            number, held = lock.latest(None)
            if held and held["owner"] == owner:  # not if it ended and another has it
                lock.swap(number, None)

    def drain(self, queue: Records, hashes: DataFrame) -> int:
        """Takes digests out of a queue; returns how many were there."""
        before = queue.rows()
        taken = before.join(hashes.select("hash").distinct(), "hash", "left_semi").count()
        if taken:
            queue.change(lambda old: upkeep.drained(old, hashes))
        return taken

    # --- workspaces, organisations ---
    def soft_delete(self, workspace: str, now: int, days: int | None = None) -> None:
        meta = F.col("metadata") if days is None else F.lit(json.dumps({"recycle_retention_days": days}))
        self.workspaces.update((F.col("id") == workspace) & F.col("deleted_at").isNull(), deleted_at=F.lit(now), metadata=meta)

    def restore(self, workspace: str) -> None:
        self.workspaces.update((F.col("id") == workspace) & F.col("deleted_at").isNotNull(), deleted_at=F.lit(None))

    def purge(self, now: int) -> int:
        """Removes deleted workspaces whose retention is over; returns how many."""
        over = upkeep.purgeable(self.workspaces.rows(), now).select("id")
        ids = [r["id"] for r in over.collect()]  # workspaces of one store
        if ids:
            self.workspaces.delete(F.col("id").isin(ids))
        return len(ids)

    def create_user(self, one: str, email: str) -> None:
        from cairnspark.sources.records import Exists

        if not self.users.rows().where(F.lower("email") == email.lower()).isEmpty():
            raise Exists(f"users: {email}")
        self.users.add([(one, email)])

    def delete_user(self, one: str) -> None:
        self.users.delete(F.col("id") == one)
        self.memberships.delete(F.col("user") == one)

    def delete_org(self, org: str) -> None:
        """Removes an organisation with its workspaces and memberships."""
        self.orgs.get(id=org)
        for table, column in ((self.workspaces, "org"), (self.memberships, "org"), (self.orgs, "id")):
            table.delete(F.col(column) == org)

    def delete_tenant(self, tenant: str) -> None:
        self.tenants.get(id=tenant)
        for r in self.orgs.rows().where(F.col("tenant") == tenant).select("id").collect():  # organisations of one tenant
            self.delete_org(r["id"])
        self.tenants.delete(F.col("id") == tenant)
