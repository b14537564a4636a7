"""Garbage collection, retention, tenancy and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRACE_SECONDS, RETENTION_DAYS, DAY = 24 * 3600, 30, 86_400
#: What an object is taken to hold in reports of collections.
OBJECT_ESTIMATE = 65_536
#: Roles, the highest last, and what each may do.
ROLES = {"viewer": ("read",), "member": ("read", "write"), "admin": ("read", "write", "delete"), "owner": ("read", "write", "delete", "admin")}
PERMISSIONS = ("read", "write", "delete", "admin")


def refcounts(holdings: DataFrame) -> DataFrame:
    """hash, refcount: how many distinct versions hold each object (version_id, hash); derived, so it can't drift."""
    return holdings.distinct().groupBy("hash").agg(F.count("*").alias("refcount"))


def live_set(reachable_versions: DataFrame, holdings: DataFrame) -> DataFrame:
    return holdings.join(reachable_versions.select("version_id").distinct(), "version_id", "left_semi").select("hash").distinct()


def sweep(garbage: DataFrame, live: DataFrame, now: int, grace: int = GRACE_SECONDS) -> DataFrame:
    """hash, outcome of queued garbage (hash, queued_at): revived (live again), waiting (within grace), or pending delete."""
    known = live.select("hash").distinct().withColumn("_l", F.lit(True))
    return garbage.join(known, "hash", "left").select("hash", F.when(F.col("_l").isNotNull(), "revived").when(F.lit(now) - F.col("queued_at") < grace, "waiting").otherwise("pending").alias("outcome"))


def sweep_report(swept: DataFrame) -> DataFrame:
    return swept.agg(F.count("*").alias("examined"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("revived", "waiting", "pending")])


def decremented(counts: DataFrame, drops: DataFrame) -> DataFrame:
    """hash, refcount, garbage after dropping references: a count of 0 or less, or one that was missing, is garbage."""
    d = drops.groupBy("hash").agg(F.count("*").alias("_d"))
    left = F.coalesce("refcount", F.lit(0)) - F.coalesce("_d", F.lit(0))
    return counts.join(d, "hash", "full_outer").select("hash", F.greatest(left, F.lit(0)).alias("refcount"), (left <= 0).alias("garbage"))


def next_run(now: Column, hour: int | Column) -> Column:
    """The next time strictly after now (seconds) at which it is `hour` o'clock UTC."""
    at = now - now % DAY + (hour if isinstance(hour, Column) else F.lit(hour)) * 3600
    return F.when(at > now, at).otherwise(at + DAY).cast("long")


def retention_seconds(metadata: Column) -> Column:
    """From JSON metadata; missing or malformed is RETENTION_DAYS."""
    return F.coalesce(F.get_json_object(metadata, "$.recycle_retention_days").try_cast("bigint"), F.lit(RETENTION_DAYS)) * DAY


def purgeable(workspaces: DataFrame, now: int) -> DataFrame:
    """Deleted workspaces whose retention is over."""
    return workspaces.where(F.col("deleted_at").isNotNull() & (F.lit(now) - F.col("deleted_at") >= retention_seconds(F.col("metadata"))))


def lifecycle_class(age_days: Column, deleted: Column, to_infrequent: int = 30, to_archive: int = 90, expire_deleted: int = 7) -> Column:
    """What object lifecycle rules do at an age; archiving must come after the infrequent tier, which needs 30 days."""
    if to_infrequent < 30 or to_archive <= to_infrequent:
        raise ValueError("tiers need at least 30 days, and archive after infrequent access")
    return F.when(deleted & (age_days >= expire_deleted), "expire").when(age_days >= to_archive, "archive").when(age_days >= to_infrequent, "infrequent").otherwise("standard")


def cascade(parents_removed: DataFrame, children: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """Children that stay and that go when parents (key) are removed."""
    gone = parents_removed.select(F.col(key).alias(parent_key)).distinct()
    return children.join(gone, parent_key, "left_anti"), children.join(gone, parent_key, "left_semi")


def role_level(role: Column) -> Column:
    out = F.lit(0)
    for level, name in enumerate(ROLES):
        out = F.when(F.lower(role) == name, F.lit(level)).otherwise(out)
    return out


def effective_role(memberships: DataFrame, by: str) -> DataFrame:
    """by, role: the highest of each; an unknown role counts as viewer."""
    names = F.array(*[F.lit(r) for r in ROLES])
    return memberships.groupBy(by).agg(F.max(role_level(F.col("role"))).alias("_l")).select(by, F.get(names, F.col("_l")).alias("role"))


def allowed(asked: DataFrame) -> DataFrame:
    """asked (role, permission) with allowed."""
    granted = asked.sparkSession.createDataFrame([(r, p) for r, ps in ROLES.items() for p in ps], "role string, permission string").withColumn("allowed", F.lit(True))
    return asked.join(F.broadcast(granted), ["role", "permission"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))  # 10 rows


def gc_metrics(runs: DataFrame) -> DataFrame:
    """kind, runs, objects, bytes (an estimate: OBJECT_ESTIMATE each), and how many runs took at most 1, 10, 60 seconds and longer. runs: kind, deleted, seconds."""
    s = F.col("seconds")
    return runs.groupBy("kind").agg(
        F.count("*").alias("runs"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("objects"), (F.coalesce(F.sum("deleted"), F.lit(0)) * OBJECT_ESTIMATE).alias("bytes"),
        F.count_if(s <= 1).alias("upto_1s"), F.count_if((s > 1) & (s <= 10)).alias("upto_10s"), F.count_if((s > 10) & (s <= 60)).alias("upto_60s"), F.count_if(s > 60).alias("longer"),
    )


def drained(queue: DataFrame, taken: DataFrame) -> DataFrame:
    """A queue (hash, ...) without the digests that were taken."""
    return queue.join(taken.select("hash"), "hash", "left_anti")


def listed(workspaces: DataFrame, deleted: bool) -> DataFrame:
    """Active workspaces by id, or deleted ones, the last deleted first."""
    rows = workspaces.where(F.col("deleted_at").isNotNull() if deleted else F.col("deleted_at").isNull())
    return rows.orderBy(F.desc("deleted_at"), "id") if deleted else rows.orderBy("id")


def soft_deleted(workspaces: DataFrame, chosen: Column, now: int, days: int | None = None) -> DataFrame:
    """Workspaces with those chosen marked as deleted now, with `days` of retention in their metadata; what is deleted already stays as it is."""
    hit = chosen & F.col("deleted_at").isNull()
    meta = F.col("metadata") if days is None else F.lit(f'{{"recycle_retention_days": {int(days)}}}')
    return workspaces.withColumn("metadata", F.when(hit, meta).otherwise(F.col("metadata"))).withColumn("deleted_at", F.when(hit, F.lit(now)).otherwise(F.col("deleted_at")).cast("long"))


def restored(workspaces: DataFrame, chosen: Column) -> DataFrame:
    """Workspaces with those chosen no longer deleted."""
    return workspaces.withColumn("deleted_at", F.when(~F.coalesce(chosen, F.lit(False)), F.col("deleted_at")))


def upserted(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `new` put in: a row of the same keys is replaced."""
    return rows.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*rows.columns))


def members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """org, user, email, role (the highest): who belongs to each organisation."""
    top = memberships.groupBy("org", "user").agg(F.max(role_level(F.col("role"))).alias("_l"))
    names = F.array(*[F.lit(r) for r in ROLES])
    return top.join(users, "user").select("org", "user", "email", F.get(names, F.col("_l")).alias("role"))
