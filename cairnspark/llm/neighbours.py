"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

1. The tree is fitted on a sample of at most SAMPLE vectors, chosen by a hash of the id: k-means with BRANCH centres,
   again within each, until a node holds LEAF_SAMPLE sample vectors or fewer.
2. Every vector is dealt to its leaf, and the index is written to the shared folder.
3. A query keeps a priority queue of tree nodes by distance to their centre; it opens the nearest, so leaves come out in
   order of promise. How many leaves a query visits is calibrated: for CALIBRATION of the queries the true neighbours
   among all vectors are found by brute force, and visits are widened until their recall is TARGET_RECALL or more.
   A query goes on to further leaves while those it has hold fewer than k candidates.
4. A query meets the vectors of its leaves in blocks: a leaf of many vectors (copies, a hot region) is several blocks,
   and each gives at most k candidates for each query. Distances are exact, in double precision, on original vectors.

Defined cases. Vectors null, empty, zero, of another length than most, or with null or non-finite components take no
part, as query or candidate. Null ids take no part. Ties: smaller id. Repeated rows of one id: candidates each, but never
of a query with that id; as queries, equal rows are answered once, different vectors each with ranks of their own. Fewer
candidates than k: all of them. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import forget, partitions, ship, written

SAMPLE, BRANCH, LEAF_SAMPLE, MOST_LEAVES = 20_000, 8, 64, 4096
CALIBRATION, TARGET_RECALL = 64, 0.97
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 256


@dataclass
class Tree:
    """Nodes in arrays: centre, children (empty: a leaf with a number)."""

    centres: list = field(default_factory=list)
    children: list = field(default_factory=list)
    leaf: list = field(default_factory=list)
    n_leaves: int = 0

    def add(self, centre) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centres) - 1

    def close(self) -> "Tree":
        self.matrix = np.array(self.centres)
        return self

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree, the nearest centre at each node."""
        out = np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            kids = self.children[node]
            if not kids:
                out[at] = self.leaf[node]
                continue
            c = self.matrix[kids]
            near = np.argmin((c**2).sum(axis=1) - 2 * x[at] @ c.T, axis=1)
            stack.extend((kid, at[near == i]) for i, kid in enumerate(kids))
        return out

    def best_bins(self, q: np.ndarray):
        """The leaves for a query, most promising first, each found when it is asked for."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield self.leaf[node]
                continue
            d = ((self.matrix[kids] - q) ** 2).sum(axis=1)
            for kid, x in zip(kids, d.tolist()):
                heapq.heappush(queue, (x, kid))

    def visited(self, q: np.ndarray, visits: int, sizes: dict[int, int], least: int) -> list[int]:
        """The first `visits` leaves that aren't empty, and as many more as it takes to hold `least` vectors, if there are so many."""
        out, held = [], 0
        for leaf in self.best_bins(q):
            if len(out) >= visits and held >= least:
                break
            if sizes.get(leaf):
                out.append(leaf)
                held += sizes[leaf]
        return out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), int)
    for _ in range(rounds):
        near = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
        new = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c, near


def fit(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF_SAMPLE, most_leaves: int = MOST_LEAVES) -> Tree:
    tree, rng = Tree(), np.random.default_rng(11)
    root = tree.add(x.mean(axis=0) if len(x) else np.zeros(1))
    # the largest node is split next, so a bound on leaves falls on the small ones
    queue = [(-len(x), root, np.arange(len(x)))]
    leaves = 1
    done = []
    while queue:
        n, node, at = heapq.heappop(queue)
        own = np.unique(x[at], axis=0) if len(at) else x[at]
        if -n <= leaf or len(own) < 2 or leaves + branch - 1 > most_leaves:
            done.append(node)
            continue
        c, near = _kmeans(x[at], min(branch, len(own)), rng)
        groups = [at[near == i] for i in range(len(c))]
        if sum(len(g) > 0 for g in groups) < 2:
            done.append(node)
            continue
        kids = [(tree.add(c[i]), g) for i, g in enumerate(groups) if len(g)]
        tree.children[node] = [k for k, _ in kids]
        leaves += len(kids) - 1
        for kid, g in kids:
            heapq.heappush(queue, (-len(g), kid, g))
    for i, node in enumerate(sorted(done)):
        tree.leaf[node] = i
    tree.n_leaves = len(done)
    return tree.close()


def _vectors(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, width)


def _nearest(q_ids, q, ids, x, k):
    """For each query the k nearest rows (query, id, squared distance), ties to smaller ids; its own id is left out."""
    for a in range(0, len(q), 32):
        d = np.concatenate([((x[None, i : i + 2048] - q[a : a + 32, None]) ** 2).sum(axis=2) for i in range(0, len(x), 2048)], axis=1) if len(x) else np.zeros((len(q[a : a + 32]), 0))
        for row, qid in zip(d, q_ids[a : a + 32]):
            own = np.flatnonzero(ids != qid)
            if len(own) > k:
                edge = np.partition(row[own], k - 1)[k - 1]
                own = own[row[own] <= edge]
            best = own[np.lexsort((ids[own], row[own]))[:k]]
            yield qid, ids[best], row[best]


def _found(of: list[int], answers) -> pa.RecordBatch:
    """of: which row of its id each query is."""
    answers = list(answers)
    n = [len(i) for _, i, _ in answers]
    cat = lambda at, t: np.concatenate([r[at] for r in answers]).astype(t) if answers else np.zeros(0, t)
    own = [np.repeat(np.array(x, np.int64), n) for x in ([q for q, _, _ in answers], of)]
    return pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.array(cat(1, np.int64)), pa.array(np.sqrt(cat(2, float)))], ["query_id", "row", "vec_id", "score"])


_FOUND = "query_id long, row long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id and vec (doubles) of the vectors that take part, and their length: that of most vectors (ties: the shorter)."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    v = v.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    top = v.groupBy(F.size("vec").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    width = top["w"] if top else 0
    return v.where(F.size("vec") == width), width


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", visits: int | None = None, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): each query's k nearest found."""
    spark = vectors.sparkSession
    ship(spark)
    good, width = usable(vectors, id_col, vector_col)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = good.count()
    part = min(1.0, SAMPLE / max(1, n))
    sample = good.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < max(1, int(part * (1 << 20)))).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    tree = fit(np.array([r["vec"] for r in sorted(sample, key=lambda r: r["id"])], float).reshape(-1, width))
    held = spark.sparkContext.broadcast(tree)  # at most 2 * MOST_LEAVES centres

    def deal(batches):
        for b in batches:
            leaf = held.value.assign(_vectors(b.column(1), width)) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.int32())], ["id", "vec", "leaf"])

    index = written(good.mapInArrow(deal, "id long, vec array<double>, leaf int"), "index")
    sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
    queries = index.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    if visits is None:
        visits = calibrated(index, queries, tree, width, k, target, partitions(spark))
    visits = max(visits, 1)

    def bins(batches):
        for b in batches:
            t, x = held.value, _vectors(b.column(1), width) if b.num_rows else np.zeros((0, width))
            # besides k candidates, the leaves may hold all rows of the query's own id
            lists = [t.visited(q, visits, sizes, k + own) for q, own in zip(x, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], ["id", "vec", "leaves"])

    # a leaf's vectors are dealt into blocks of at most about BLOCK_VECTORS, its queries into blocks as well
    table = spark.createDataFrame([(leaf, -(-c // BLOCK_VECTORS)) for leaf, c in sizes.items()], "leaf int, blocks int")
    own_rows = queries.groupBy("id").agg(F.count("*").alias("own"))
    asked = queries.select("id", "vec").distinct().join(own_rows, "id").select("id", "vec", "own").mapInArrow(bins, "id long, vec array<double>, leaves array<int>").select("id", "vec", F.explode("leaves").alias("leaf"))
    asked = asked.join(F.broadcast(table), "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "id", "vec", F.xxhash64("vec").alias("row"))
    stored = index.join(F.broadcast(table), "leaf").select("leaf", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "vec", F.lit(0).cast("long").alias("row"))

    def meet(batches):
        key, ids, x, q_ids, q, rows = None, [], [], [], [], []

        def answers():
            if ids and q_ids:
                return _found(rows, _nearest(np.array(q_ids, np.int64), np.array(q), np.concatenate(ids), np.concatenate(x), k))
            return None

        for b in batches:
            if not b.num_rows:
                continue
            leaf, block, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            own, vec, row = b.column(3).to_numpy(zero_copy_only=False), _vectors(b.column(4), width), b.column(5).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1])) + 1
            for a, e in zip(np.append(0, change), np.append(change, len(leaf))):
                if (leaf[a], block[a]) != key:
                    got = answers()
                    if got is not None:
                        yield got
                    key, ids, x, q_ids, q, rows = (leaf[a], block[a]), [], [], [], [], []
                is_q = asks[a:e].astype(bool)
                ids.append(own[a:e][~is_q])
                x.append(vec[a:e][~is_q])
                # vectors sort before queries, so queries can be answered as they come
                q_ids.extend(own[a:e][is_q].tolist())
                q.extend(vec[a:e][is_q])
                rows.extend(row[a:e][is_q].tolist())
                if len(q_ids) >= BLOCK_QUERIES:
                    got = answers()
                    if got is not None:
                        yield got
                    q_ids, q, rows = [], [], []
        got = answers()
        if got is not None:
            yield got

    met = stored.unionByName(asked).repartition(partitions(spark), "leaf", "block").sortWithinPartitions("leaf", "block", "asks").mapInArrow(meet, _FOUND)
    best = met.groupBy("query_id", "row").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))  # k for each block visited
    found = best.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    found = written(found, "nearest")  # k rows a query
    forget(index)
    return found


def calibrated(index: DataFrame, queries: DataFrame, tree: Tree, width: int, k: int, target: float, parts: int) -> int:
    """The least number of leaf visits at which CALIBRATION queries reach the target recall."""
    some = queries.select("id", "vec").orderBy(F.xxhash64("id", F.lit(3)), "id").limit(CALIBRATION).collect()
    if not some:
        return 1
    q_ids, q = np.array([r["id"] for r in some], np.int64), np.array([r["vec"] for r in some], float)

    def brute(batches):
        best: dict[int, tuple] = {}
        for b in batches:
            ids, x, leaf = b.column(0).to_numpy(), _vectors(b.column(1), width) if b.num_rows else np.zeros((0, width)), b.column(2).to_numpy()
            of = dict(zip(ids.tolist(), leaf.tolist()))
            for qid, i, d in _nearest(q_ids, q, ids, x, k):
                old = best.get(qid, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)))
                i, d, leaves = np.concatenate([old[0], i]), np.concatenate([old[1], d]), np.concatenate([old[2], np.array([of[y] for y in i.tolist()], np.int32)])
                o = np.lexsort((i, d))[:k]
                best[qid] = (i[o], d[o], leaves[o])
        rows = [(qid, int(a), float(c), int(e)) for qid, (i, d, leaves) in best.items() for a, c, e in zip(i, d, leaves)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int32())], ["query_id", "vec_id", "d", "leaf"])

    near = index.select("id", "vec", "leaf").mapInArrow(brute, "query_id long, vec_id long, d double, leaf int")
    true = near.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "vec_id", "leaf"))), 1, k).alias("best")).collect()  # CALIBRATION rows
    vec = dict(zip(q_ids.tolist(), q))
    ranks = []
    for r in true:
        place = {leaf: i for i, leaf in enumerate(tree.best_bins(vec[r["query_id"]]))}
        ranks.extend(place[x["leaf"]] for x in r["best"])
    ranks.sort()
    return ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)] + 1 if ranks else 1
