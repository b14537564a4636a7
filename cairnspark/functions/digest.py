"""Content digests as Catalyst expressions: 64 lowercase hex characters; raw bytes only inside a concatenation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX64 = "^[0-9a-fA-F]{64}$"


def digest(c: Column) -> Column:
    """SHA-256 of a string's UTF-8 bytes or of binary."""
    return F.sha2(c, 256)


def digest_children(hashes: Column) -> Column:
    """Digest of the raw digests of an ordered array, one after another."""
    return F.sha2(F.unhex(F.array_join(hashes, "")), 256)


def digest_directory(entries: Column) -> Column:
    """Digest of an array of struct(name, hash): for sorted names, the name's bytes and the raw hash, without a delimiter."""
    return F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(F.lower(F.hex(F.encode(e["name"], "UTF-8"))), e["hash"])), "")), 256)


def version_id(parents: Column, root: Column, seconds: Column) -> Column:
    """Digest of the parents' hex strings, the raw root, and the seconds as 8 bytes, lowest first; message and metadata don't count."""
    big = F.lpad(F.lower(F.hex(seconds.cast("long"))), 16, "0")
    little = F.array_join(F.reverse(F.regexp_extract_all(big, F.lit("(..)"), F.lit(1))), "")
    return F.sha2(F.unhex(F.concat(F.hex(F.encode(F.array_join(parents, ""), "UTF-8")), root, little)), 256)


def parse_hash(c: Column) -> Column:
    """The digest in lower case, or null if it isn't 64 hex characters."""
    return F.when(c.rlike(HEX64), F.lower(c))


def wire_id(c: Column) -> Column:
    """A version id as a digest: itself if it is one, else the digest of its text."""
    return F.when(c.rlike(HEX64), F.lower(c)).otherwise(digest(c))


def object_key(h: Column) -> Column:
    """The key of a chunk in an object store."""
    return F.concat_ws("/", F.lit("chunks"), F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def content_md5(c: Column) -> Column:
    return F.base64(F.unhex(F.md5(c)))


def is_empty_id(c: Column) -> Column:
    return c.rlike("^0*$")
