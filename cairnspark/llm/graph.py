"""Connected components of an edge table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp (the smallest node of its component) for every node that has an edge.

    Each round hooks every node to its smallest neighbour, follows that hook once more, and replaces edges by those
    between the labels; at least half of the nodes with edges go in each round. Rounds are written to the shared folder.
    """
    cur = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")
    rounds = []
    while not cur.isEmpty():
        both = cur.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(cur.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hook = both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp"))
        up = hook.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        labels = written(hook.join(up, "comp").select("node", F.col("up").alias("comp")), "labels")
        la = labels.select(F.col("node").alias("a"), F.col("comp").alias("la"))
        lb = labels.select(F.col("node").alias("b"), F.col("comp").alias("lb"))
        nxt = written(cur.join(la, "a").join(lb, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        forget(cur)
        rounds.append(labels)
        cur = nxt
    if not rounds:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out = rounds[0]
    for labels in rounds[1:]:
        out = out.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    done = written(out, "components")
    forget(cur, *rounds)
    return done
