"""Bloom filters over digests, built and probed by Catalyst expressions; for parity, as exact anti-joins are the default."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From how many digests on a filter is used, and how often it may be wrong.
USE_FROM, FALSE_POSITIVES = 10_000, 0.01


def optimal_bits(n: int, p: float = FALSE_POSITIVES) -> int:
    return max(64, ceil(-max(1, n) * log(p) / log(2) ** 2))


def optimal_probes(bits: int, n: int) -> int:
    return min(30, max(1, round(bits / max(1, n) * log(2))))


def _probes(h: Column, bits: int, k: int) -> Column:
    """Bit numbers by double hashing of the first 16 bytes of a digest (its two halves without their top bits)."""
    first, second = (F.conv(F.substring(h, at, 15), 16, 10).cast("long") for at in (1, 17))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.pmod(first, F.lit(bits)) + i * F.pmod(second, F.lit(bits)), F.lit(bits)))


@dataclass(frozen=True)
class Bloom:
    bits: int
    probes: int
    words: tuple[int, ...]

    def contains(self, h: Column) -> Column:
        """Whether every probed bit is set."""
        table = F.from_json(F.lit(str(list(self.words))), "array<bigint>")
        return F.forall(_probes(h, self.bits, self.probes), lambda b: F.call_function("bit_get", F.get(table, F.floor(b / 64).cast("int")), F.pmod(b, F.lit(64)).cast("int")) == 1)

    def probed(self, df: DataFrame, column: str, out: str = "held") -> DataFrame:
        """df with a boolean column: as `contains`, but the bits go to executors as a broadcast variable, for large filters."""
        bits = np.array(self.words, np.int64).view(np.uint64)
        held = df.sparkSession.sparkContext.broadcast(bits)

        @F.arrow_udf("boolean")
        def hit(probes: pa.Array) -> pa.Array:
            b = probes.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            one = (held.value[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)
            return pa.array(one.reshape(len(probes), -1).all(axis=1))

        return df.withColumn(out, hit(_probes(F.col(column), self.bits, self.probes)))

    def to_bytes(self) -> bytes:
        raw = b"".join((w & (1 << 64) - 1).to_bytes(8, "little") for w in self.words)
        return self.bits.to_bytes(4, "little") + bytes([self.probes]) + raw[: -(-self.bits // 8)]

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Bloom":
        bits, k = int.from_bytes(raw[:4], "little"), raw[4] if len(raw) > 4 else 0
        if len(raw) < 5 or bits < 64 or not 1 <= k <= 30 or len(raw) != 5 + -(-bits // 8):
            raise ValueError("not a Bloom filter")
        body = raw[5:] + bytes(-len(raw[5:]) % 8)
        return cls(bits, k, tuple(int.from_bytes(body[i : i + 8], "little", signed=True) for i in range(0, len(body), 8)))


def have_filter(have: DataFrame, column: str) -> "Bloom | None":
    """A filter over what a side has, if that is more than USE_FROM digests, which are counted; else None: the digests themselves are sent."""
    n = have.select(column).distinct().count()
    return build(have, column, n) if n > USE_FROM else None


def negotiated(offered: DataFrame, have: DataFrame, column: str = "hash") -> DataFrame:
    """What is offered and not had. A filter, where one is used, only spares the exact comparison of digests that it tells are new."""
    f = have_filter(have, column)
    if f is None:
        return offered.join(have.select(column).distinct(), column, "left_anti")
    asked = f.probed(offered, column, "_maybe")
    maybe = asked.where("_maybe").drop("_maybe").join(have.select(column).distinct(), column, "left_anti")
    return asked.where("NOT _maybe").drop("_maybe").unionByName(maybe)


def build(df: DataFrame, column: str, n: int, p: float = FALSE_POSITIVES) -> Bloom:
    """A filter over a column of digests; its size, not the rows, comes to the driver."""
    bits = optimal_bits(n, p)
    k = optimal_probes(bits, n)
    one = df.select(F.explode(_probes(F.col(column), bits, k)).alias("b"))
    rows = one.groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(b, 64) as int))")).alias("x")).collect()
    words = [0] * -(-bits // 64)
    for r in rows:
        words[r["w"]] = r["x"]
    return Bloom(bits, k, tuple(words))
