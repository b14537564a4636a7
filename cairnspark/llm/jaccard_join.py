"""N-gram Jaccard join of whole texts: a prefix-tree join over globally ordered shingle sets, and the groups it links.

Two texts link when 100 * |intersection| >= percent * |union| of their sets of k-word shingles (64-bit hashes).

1. One scan gives each text its set's size, 128-bit fingerprint and parity bitmap. Texts with equal sets form a class,
   which stands for its copies from here on. The scan also counts shingles in 2**CELL_BITS cells; a shingle's place in
   the global order is (its cell's count, its hash), so what many texts share comes last.
2. By the prefix bound, two linked sets share a shingle among the first n - ceil(t*n) + 1 of both, and the first they
   share is among the first n - needed(n, n) + 1 of the smaller. Prefix shingles that a class has in common with another
   of a fitting size are its list; those where such a pair may meet first are its meeting points.
3. Under each meeting point the lists that go on from it are stored in a trie (WINDOW shingles; later ones are counted).
   Each list walks the trie once, so that partial overlaps are shared by all sets below a node, and subtrees are pruned
   where the overlap so far, what may still come below, and what may come after can't reach the bound. Of the lists that
   remain, those go whose parity bitmaps differ in more bits than linked sets can differ in shingles.
4. Round one gathers near copies: under a meeting point, lists come in order of how few shingles of their own they have;
   one that meets a list in the trie proposes the best it meets and is not stored. So there are no more proposals than
   lists, however large a group. Whole sets of proposed pairs are compared, and true links join classes into components.
5. Round two finds every other link: each pair of classes of different components that the trie leaves is compared on
   whole sets. Only meeting points that two components share take part. The component of the first list under a meeting
   point is dealt out in blocks which all other lists visit, so its own pairs are never laid out; the other lists meet
   in pairs of blocks. So no cell holds more than two blocks.

So no link between different components is lost, while no group of near copies is expanded into its pairs.

Defined cases. Null or empty text: no shingles, links with nothing. Fewer than k words: the whole sequence is the one
shingle. Repeated rows: a row each, in one group. Null ids: kept; a group's id is the smallest id that isn't null.
Empty table: no rows. Extra columns aren't read. Whole texts count, however long. Different sets whose 64-bit class
numbers are equal get new numbers from their other 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .graph import components
from .runtime import forget, in_full, partitions, ship, written

CELL_BITS = 21
SLICES = 64
BLOCK = 1024
STAR = 2048
WINDOW = 32
BITMAP = 256
ROWS = 4096
PROPOSALS = 2
SALT_AT = 1 << 20
CLASS_BITS = 64
PART_BYTES = 48 << 20
BROADCAST_IDS = 1_000_000


def _sets(data, offsets, k):
    """For each row of a slice: sorted distinct shingle hashes, laid end to end, and their bounds."""
    h, row = textkit.lower_words(data, offsets)
    n_rows = len(offsets) - 1
    s, s_row = textkit.shingles(h, row, n_rows, k)
    order = np.lexsort((s, s_row))
    s, s_row = s[order], s_row[order]
    if len(s):
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (s_row[1:] != s_row[:-1])
        s, s_row = s[first], s_row[first]
    return s, np.searchsorted(s_row, np.arange(n_rows + 1))


def _class_ids(s: np.ndarray, bounds: np.ndarray, bits: int = 64, clashes: dict[tuple[int, int], int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each row's set, the first of `bits` bits; clashes: numbers of classes that need another."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textkit.mix(s ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(textkit.mix((run[bounds[1:]] - run[bounds[:-1]]) ^ textkit.mix(np.diff(bounds).astype(np.uint64) + np.uint64(salt))))
    cls, check = (out[0] >> np.uint64(64 - bits)).view(np.int64), out[1].view(np.int64)
    if clashes:
        for at in np.flatnonzero(np.isin(cls, np.array(list({c for c, _ in clashes}), np.int64))):
            cls[at] = clashes.get((int(cls[at]), int(check[at])), cls[at])
    return cls, check


def _bitmaps(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows x BITMAP / 8 bytes: the parity of each set's shingles in BITMAP cells. Bits in which two differ are shingles in which their sets differ, at least."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bit = (textkit.mix(s ^ np.uint64(0xA4093822299F31D0)) % np.uint64(BITMAP)).astype(np.int64)
    odd = np.bincount(row * BITMAP + bit, minlength=(len(bounds) - 1) * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, BITMAP), axis=1)


def _scan(k: int, bits: int):
    def run(batches):
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        names = ["id", "text_hash", "n", "cls", "check", "bitmap", "slice", "counts"]
        for b in batches:
            data, offsets = textkit.buffers(b.column(2))
            for i, j in textkit.slices(offsets, rows=ROWS):
                s, bounds = _sets(data, offsets[i : j + 1], k)
                cells += np.bincount((s >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS).astype(np.uint32)
                cls, check = _class_ids(s, bounds, bits)
                bitmap = textkit.binaries(_bitmaps(s, bounds).reshape(-1), np.arange(j - i + 1) * (BITMAP // 8))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(bounds), pa.int32()), pa.array(cls), pa.array(check), bitmap, pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names)
        parts = cells.reshape(SLICES, -1)
        none = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names)
        textkit.release()

    return run


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(c, np.uint32)
            total[s] = total[s] + x if s in total else x.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])


def needed(n: int, m: int, percent: int) -> int:
    """The least intersection of sets of n and m with 100 * i >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n, percent: int):
    return n - (-(-percent * n // 100)) + 1


def _only(docs: DataFrame, hashes: DataFrame, text_hash: str = "text_hash") -> DataFrame:
    """The rows of docs whose text's hash is among `hashes`: a broadcast up to BROADCAST_IDS of them, else a shuffle."""
    n = hashes.count()
    return docs.join(F.broadcast(hashes) if n <= BROADCAST_IDS else hashes, text_hash, "left_semi")


def _whole_sets(texts: DataFrame, wanted: DataFrame, classes: DataFrame, k: int, ids) -> DataFrame:
    """cls, tokens (sorted 64-bit hashes as bytes) of the classes in `wanted`, from the texts again."""
    hashes = written(classes.join(wanted, "cls", "left_semi").select(F.col("rep").alias("text_hash")).distinct(), "reps")

    def run(batches):
        seen = set()
        for b in batches:
            data, offsets = textkit.buffers(b.column(1))
            for i, j in textkit.slices(offsets):
                s, bounds = _sets(data, offsets[i : j + 1], k)
                cls, _ = ids(s, bounds)
                cut = textkit.binaries(s, bounds)
                new = []
                for at, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        new.append(at)
                yield pa.RecordBatch.from_arrays([pa.array(cls), cut], ["cls", "tokens"]).take(pa.array(new, pa.int32()))
        textkit.release()

    found = _only(texts.select("text_hash", "text"), hashes).select("text_hash", "text").mapInArrow(run, "cls long, tokens binary")
    out = written(found.groupBy("cls").agg(F.first("tokens").alias("tokens")), "sets")
    forget(hashes)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Each a's set meets its partners' sets in cells of at most about STAR of them."""

    def run(batches):
        key, x = None, None
        for b in batches:
            keep = []
            for at, (cell, ta) in enumerate(zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(3))):
                tokens = np.frombuffer(ta.as_buffer(), np.uint64)
                if cell != key:  # the first of a cell is a's own set
                    key, x = cell, tokens.copy()
                    continue
                small, large = (x, tokens) if len(x) <= len(tokens) else (tokens, x)
                if 100 * len(small) < percent * len(large):
                    continue
                spot = np.searchsorted(large, small)
                spot[spot == len(large)] = 0
                if int((large[spot] == small).sum()) >= needed(len(small), len(large), percent):
                    keep.append(at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], ["a", "b"]).take(pa.array(keep, pa.int32()))

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("cells"))
    own = sizes.join(sets.withColumnRenamed("cls", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(None).cast("long").alias("b"), "tokens")
    theirs = pairs.select("a", "b").join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("cells")).cast("int").alias("cell"), "b")
    theirs = theirs.join(sets.withColumnRenamed("cls", "b"), "b").select("a", "cell", "b", "tokens")
    return own.unionByName(theirs).repartition(partitions(pairs.sparkSession), "a", "cell").sortWithinPartitions("a", "cell", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long")


class Trie:
    """Ordered lists of shingles; a node holds the shingles that all lists below it go on with, and bounds for all of them."""

    __slots__ = ("edge", "children", "ends", "least_n", "most_rest", "most_after", "depth")

    def __init__(self, edge: tuple = (), n: int = 1 << 62, rest: int = 0, after: int = 0, depth: int = 0):
        self.edge, self.children, self.ends, self.least_n, self.most_rest, self.most_after, self.depth = edge, {}, [], n, rest, after, depth

    def add(self, m: "Member", rest: int) -> None:
        path, node = m.path, self
        node.note(m, rest, len(path))
        while path:
            child = node.children.get(path[0])
            if child is None:
                child = node.children[path[0]] = Trie(path, m.n, rest, m.after, 0)
                child.ends.append(m)
                return
            edge = child.edge
            k, most = 1, min(len(edge), len(path))
            while k < most and edge[k] == path[k]:
                k += 1
            if k < len(edge):  # part of the edge is shared: it becomes a node above
                above = Trie(edge[:k], child.least_n, child.most_rest, child.most_after, child.depth + len(edge) - k)
                child.edge = edge[k:]
                above.children[edge[k]] = child
                node.children[path[0]] = child = above
            path = path[k:]
            child.note(m, rest, len(path))
            node = child
        node.ends.append(m)

    def note(self, m: "Member", rest: int, left: int) -> None:
        self.least_n, self.most_rest, self.most_after, self.depth = min(self.least_n, m.n), max(self.most_rest, rest), max(self.most_after, m.after), max(self.depth, left)

    def walk(self, m: "Member", rest: int, percent: int):
        """(member, shared) for all lists below that may still link with this one; shared counts from 1, the group's own shingle."""
        own, size, n = set(m.path), len(m.path), m.n
        floor = -(-percent * n // 100)
        stack = [(self, 1)]
        while stack:
            node, shared = stack.pop()
            # what may still come: below this node, after the windows, and after the prefixes
            if shared + min(size, node.depth) + max(m.after, node.most_after) + max(rest, node.most_rest) < needed(n, max(node.least_n, floor), percent):
                continue
            for item in node.ends:
                yield item, shared
            for child in node.children.values():
                stack.append((child, shared + sum(map(own.__contains__, child.edge))))


@dataclass(slots=True)
class Member:
    """A list under a meeting point: its class, component, set's size, the shingles that follow (32 bits of each), how many follow after these, bitmap, side."""

    cls: int
    comp: int
    n: int
    path: tuple
    after: int
    bitmap: int
    side: int = 0


def _may_link(x: Member, y: Member, shared: int, percent: int) -> bool:
    n, m = x.n, y.n
    if 100 * min(n, m) < percent * max(n, m):
        return False
    least = needed(n, m, percent)
    if shared + max(x.after, y.after) + max(n - prefix_length(n, percent), m - prefix_length(m, percent)) < least:
        return False
    return (x.bitmap ^ y.bitmap).bit_count() <= n + m - 2 * least


def trie_pairs(members: list[Member], percent: int, cross: bool = False):
    """Candidate pairs of classes of different components under one meeting point; with cross=True, of different sides only."""
    trie, pairs = Trie(), []
    for m in sorted(members, key=lambda m: m.side) if cross else members:
        rest = m.n - prefix_length(m.n, percent)
        if not cross or m.side:
            for other, shared in trie.walk(m, rest, percent):
                if other.comp != m.comp and _may_link(m, other, shared, percent):
                    pairs.append((min(m.cls, other.cls), max(m.cls, other.cls)))
        if not cross or not m.side:
            trie.add(m, rest)
    return pairs


def trie_proposals(members: list[Member], percent: int):
    """(class in the trie, class) for each list that meets one in the trie: the best; lists that meet none are stored."""
    trie, pairs = Trie(), []
    for m in members:
        rest, best, most = m.n - prefix_length(m.n, percent), None, 0
        for other, shared in trie.walk(m, rest, percent):
            if shared > most and other.cls != m.cls and _may_link(m, other, shared, percent):
                best, most = other, shared
        if best:
            pairs.append((best.cls, m.cls))
        else:
            trie.add(m, rest)
    return pairs


def _with_windows(postings: DataFrame, classes: DataFrame, parts: int, percent: int) -> DataFrame:
    """Rows for all meeting points of each class: token, cls, comp, members, major, head (as the postings have them), n, dead (prefix shingles that nobody shares), after, window, bitmap."""

    most = WINDOW

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        col = lambda c: t.column(c).cast(pa.int64()).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        cls, token, n, comp, members, major, head = map(col, ("cls", "token", "n", "comp", "members", "major", "head"))
        bitmaps, is_class = t.column("bitmap").combine_chunks(), t.column("token").is_null().combine_chunks().to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))  # a class's own row comes first
        of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(cls))))
        ends = np.append(begins[1:], len(cls))
        at = np.flatnonzero(~is_class & col("meets").astype(bool))
        last = ends[of[at]]
        alive = last - begins[of[at]] - 1
        size = np.minimum(last - at - 1, most)
        bounds = np.concatenate([[0], np.cumsum(size)])
        code = token.astype(np.uint64).astype(np.uint32).view(np.int32)  # its low 32 bits
        inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size) + np.repeat(at + 1, size)
        for i in range(0, len(at), 20_000):
            j = min(len(at), i + 20_000)
            own = at[i:j]
            window = pa.ListArray.from_arrays(pa.array((bounds[i : j + 1] - bounds[i]).astype(np.int32)), pa.array(code[inside[bounds[i] : bounds[j]]]))
            bitmap = bitmaps.take(pa.array(begins[of[own]]))
            dead = prefix_length(n[own], percent) - alive[i:j]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[own]) for c in (token, cls, comp, members, major, head)], pa.array(n[own], pa.int32()), pa.array(dead, pa.int32()), pa.array((last[i:j] - own - 1 - size[i:j]), pa.int32()), window, bitmap], names)

    names = ["token", "cls", "comp", "members", "major", "head", "n", "dead", "after", "window", "bitmap"]
    own = classes.select("cls", *[F.lit(None).cast(t).alias(c) for c, t in (("token", "long"), ("cell", "long"), ("n", "int"), ("meets", "boolean"), ("comp", "long"), ("members", "long"), ("major", "long"), ("head", "long"))], "bitmap")
    rows = postings.select("cls", "token", "cell", "n", "meets", "comp", "members", "major", "head").withColumn("bitmap", F.lit(None).cast("binary"))
    dealt = own.unionByName(rows).repartition(parts, "cls").sortWithinPartitions("cls", F.asc_nulls_first("cell"), F.asc_nulls_first("token"))
    return dealt.mapInArrow(run, "token long, cls long, comp long, members long, major long, head long, n int, dead int, after int, window array<int>, bitmap binary")


def _met(cells: DataFrame, parts: int, percent: int, round_one: bool) -> DataFrame:
    """The candidate pairs (a, b) that the tries of all cells (token, lo, hi) leave."""

    def run(batches):
        key, group, pairs = None, [], set()

        def tried():
            if len(group) > 1:
                pairs.update(trie_proposals(group, percent) if round_one else trie_pairs(group, percent, key[1] != key[2]))

        def out():
            a, b = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            token, lo, hi, cls, comp, n, after, side = (b.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, 6, 9))
            path, bitmap = b.column(7), b.column(8).to_pylist()
            cut, codes = path.offsets.to_pylist(), path.values.to_pylist()
            for i in range(b.num_rows):
                if (token[i], lo[i], hi[i]) != key:
                    tried()
                    key, group = (token[i], lo[i], hi[i]), []
                    if len(pairs) > 200_000:
                        yield out()
                group.append(Member(cls[i], comp[i], n[i], tuple(codes[cut[i] : cut[i + 1]]), after[i], int.from_bytes(bitmap[i]), side[i]))
        tried()
        yield out()

    order = ["token", "lo", "hi", "dead", "n", "cls"]
    return cells.repartition(parts, "token", "lo", "hi").sortWithinPartitions(*order).select("token", "lo", "hi", "cls", "comp", "n", "after", "window", "bitmap", "side").mapInArrow(run, "a long, b long")


def _proposed(lists: DataFrame, parts: int, percent: int) -> DataFrame:
    """Round one: a cell for each block of a meeting point's lists; its head, the list with the least of its own, is in all."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    cells = lists.withColumn("lo", F.explode(F.when(F.col("cls") == F.col("head"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own)))).withColumn("hi", F.col("lo")).withColumn("side", F.lit(0))
    found = _met(cells, parts, percent, True).groupBy("a", "b").agg(F.count("*").alias("c"))
    # a class may meet another partner under each of its shingles: those with most
    best = found.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "a")), False), 1, PROPOSALS).alias("x"))  # a proposal for each task at most
    return best.select("b", F.explode("x.a").alias("a")).select("a", "b")


def _crossing(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """The postings under shingles that two components share, with their components. major: the component of the first list; members: how many of its lists there are; head: how many others."""
    postings = postings.drop("comp", "members", "major", "head").join(comps.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    shared = postings.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("comp", F.struct("n", "cls")).alias("major")).where("lo <> hi").select("token", "major")
    alive = postings.join(shared, "token")
    sizes = alive.groupBy("token").agg(F.count(F.when(F.col("comp") == F.col("major"), 1)).alias("members"), F.count(F.when(F.col("comp") != F.col("major"), 1)).alias("head"))
    return alive.join(sizes, "token")


def _remaining(lists: DataFrame, parts: int, percent: int) -> DataFrame:
    """Round two: each block of the major component's lists meets each block of the others (hi below 0); the others also meet in pairs of blocks."""
    majors, others = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("members", "head"))
    lists = lists.withColumn("is_major", F.col("comp") == F.col("major"))
    block = lambda blocks: F.pmod(F.xxhash64("cls"), blocks).cast("int")
    is_major = lists.where("is_major AND head > 0").withColumn("lo", block(majors)).withColumn("hi", F.explode(F.sequence(-others, F.lit(-1)))).withColumn("side", F.lit(0))
    visits = lists.where("NOT is_major AND members > 0").withColumn("lo", F.explode(F.sequence(F.lit(0), majors - 1))).withColumn("hi", -1 - block(others)).withColumn("side", F.lit(1))
    among = lists.where("NOT is_major AND head > 1").withColumn("own", block(others)).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    among = among.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("own", "other")
    return _met(is_major.unionByName(visits).unionByName(among), parts, percent, False).distinct()


def _postings(texts: DataFrame, k: int, percent: int, order, ids, parts: int) -> DataFrame:
    """token, cls, n, cell, meets, comp (cls), members, major, head: prefix shingles that classes of fitting sizes share."""

    def prefixes(batches):
        held, size = [], 0
        cell_counts = order.value

        def out():
            tokens, cls, n, place = (np.concatenate(x) for x in zip(*held))
            # one copy of a class's shingle in a task is enough
            at = np.lexsort((cls, tokens))
            at = at[np.append(True, (tokens[at][1:] != tokens[at][:-1]) | (cls[at][1:] != cls[at][:-1]))]
            tokens, cls, n, place = tokens[at], cls[at], n[at], place[at]
            # a shingle of very many texts is dealt to several buckets
            pieces = cell_counts[(tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) // np.uint64(SALT_AT) + np.uint64(1)
            salt = textkit.mix(cls.view(np.uint64)) % pieces
            bucket = (textkit.mix(tokens + salt) % np.uint64(4 * parts)).astype(np.int32)
            at = np.argsort(bucket, kind="stable")
            tokens, cls, n, place, bucket = tokens[at], cls[at], n[at], place[at], bucket[at]
            own, start = np.unique(bucket, return_index=True)
            bounds = np.append(start, len(bucket))
            return pa.RecordBatch.from_arrays([pa.array(own), *[textkit.binaries(x, bounds) for x in (tokens, cls, n, place)]], ["bucket", "tokens", "cls", "n", "place"])

        for b in batches:
            data, offsets = textkit.buffers(b.column(0))
            for i, j in textkit.slices(offsets, rows=ROWS):
                s, bounds = _sets(data, offsets[i : j + 1], k)
                cls, _ = ids(s, bounds)
                n = np.diff(bounds)
                row = np.repeat(np.arange(j - i), n)
                at = np.lexsort((s.view(np.int64), cell_counts[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)], row))
                place = np.arange(len(s)) - bounds[row]
                ok = place < prefix_length(n, percent)[row]
                short = place < (n - needed(n, n, percent) + 1)[row]
                sizes = np.where(short, n[row], -n[row])  # negative: only against smaller sets
                held.append((s[at][ok], cls[row[ok]], sizes[ok].astype(np.int32), np.minimum(place[ok], 255).astype(np.uint8)))
                size += int(ok.sum())
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()
            held.clear()
        textkit.release()

    def shared(batches):
        got = [(np.frombuffer(t, np.uint64), np.frombuffer(c, np.int64), np.frombuffer(n, np.int32), np.frombuffer(p, np.uint8)) for b in batches for t, c, n, p in zip(*(b.column(x).to_pylist() for x in (1, 2, 3, 4)))]
        if not got:
            return
        tokens, cls, n, place = (np.concatenate(x) for x in zip(*got))
        got.clear()
        short, n = n > 0, np.abs(n).astype(np.int64)
        at = np.lexsort((cls, n, tokens))
        at = at[np.append(True, (tokens[at][1:] != tokens[at][:-1]) | (cls[at][1:] != cls[at][:-1]))]
        tokens, cls, n, place, short = tokens[at], cls[at], n[at], place[at], short[at]
        # within a shingle by size: who has a partner of a fitting size, and where such a pair may meet first
        group = np.cumsum(np.append(True, tokens[1:] != tokens[:-1])) - 1
        key = (group << 32) + n
        least = np.searchsorted(key, (group << 32) + -(-percent * n // 100))
        most = np.searchsorted(key, (group << 32) + 100 * n // percent, "right")
        equal = np.searchsorted(key, key, "right")
        before = np.concatenate([[0], np.cumsum(short)])
        cell = order.value[(tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
        salted = cell >= SALT_AT  # others may be in other buckets
        many = (most - least > 1) | salted
        smaller = before[equal] - before[least] - short  # short lists of at most this size, besides itself
        larger = most - np.searchsorted(key, key) - 1
        meets = salted | (smaller > 0) | (short & (larger > 0))
        members = np.bincount(group, weights=meets).astype(np.int64)[group]
        # the head: of the lists that meet, the one with the fewest shingles before this one
        head = np.full(group[-1] + 1, -1, np.int64)
        at = np.lexsort((cls, n, place, group))[::-1]
        at = at[meets[at]]
        head[group[at]] = cls[at]  # the last that is put there is the first in order
        tokens, cls, n, cell, meets, members, head = (x[many] for x in (tokens.view(np.int64), cls, n.astype(np.int32), cell, meets, members, head[group]))
        for i in range(0, len(tokens), 100_000):
            own = [pa.array(x[i : i + 100_000]) for x in (tokens, cls, n, cell, meets, cls, members, cls, head)]
            yield pa.RecordBatch.from_arrays(own, ["token", "cls", "n", "cell", "meets", "comp", "members", "major", "head"])
        textkit.release()

    packed = texts.select("text").mapInArrow(prefixes, "bucket int, tokens binary, cls binary, n binary, place binary").repartition(parts, "bucket")
    return written(packed.mapInArrow(shared, "token long, cls long, n int, cell long, meets boolean, comp long, members long, major long, head long"), "postings")


def link_groups(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, text_hash, n_shingles, cls (equal for equal sets), comp (equal for linked rows; null without shingles), component_id (the smallest id linked, directly or not)."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, text_hash long, n int, cls long, check long, bitmap binary, slice int, counts binary"
    bits = CLASS_BITS
    scanned = written(texts.mapInArrow(_scan(k, bits), schema), "shingle-sets")
    cells = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), np.int64)
    for r in scanned.where("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_summed, "slice int, counts binary").collect():  # 2**CELL_BITS numbers in all
        cells[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    order = spark.sparkContext.broadcast(cells.reshape(-1))
    # prefixes are 20 bytes a shingle: as many parts as hold PART_BYTES each
    parts = max(partitions(spark), ceil(int(cells.sum()) * 20 * (100 - percent) / 100 / PART_BYTES))

    classes = scanned.where("slice IS NULL AND n > 0").groupBy("cls", "check", "n").agg(F.min("text_hash").alias("rep"), F.first("bitmap").alias("bitmap"), F.min("id").alias("least_id"))
    classes = written(classes, "classes")
    rows = scanned.where("slice IS NULL").select("id", "text_hash", "n", "cls", "check")
    # different sets of one number: about one in 2**64 pairs of classes
    clashes = {(r["cls"], r["check"]): r["new"] for r in classes.join(classes.groupBy("cls").agg(F.count("*").alias("c")).where("c > 1"), "cls").select("cls", "check", F.xxhash64("cls", "check").alias("new")).collect()}
    if clashes:
        again = F.broadcast(spark.createDataFrame([(*key, new) for key, new in clashes.items()], "cls long, check long, new long"))
        renamed = lambda t: t.join(again, ["cls", "check"], "left").withColumn("cls", F.coalesce("new", "cls")).drop("new")
        classes, rows = renamed(classes), renamed(rows)
    ids = lambda s, bounds: _class_ids(s, bounds, bits, clashes)

    postings = _postings(texts, k, percent, order, ids, parts)
    links = None
    # what round one links is one component when all pairs that are left are looked at
    for alive, found in ((lambda: postings, _proposed), (lambda: _crossing(postings, comps), _remaining)):
        candidates = written(found(_with_windows(alive(), classes, parts, percent), parts, percent), "candidates")
        if not candidates.isEmpty():
            sets = _whole_sets(texts, candidates.select(F.col("a").alias("cls")).union(candidates.select("b")).distinct(), classes, k, ids)
            true = written(_verified(candidates, sets, percent), "links")
            links = true if links is None else links.unionByName(true)
            forget(sets)
        forget(candidates)
        comps = components(links if links is not None else spark.createDataFrame([], "a long, b long"))
    forget(postings)
    # a group's id, by class, then for every row
    of_class = classes.select("cls", "least_id").join(comps.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = of_class.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of_class = written(of_class.join(least, "comp").select("cls", "comp", "component_id"), "groups")
    forget(classes)
    out = rows.join(of_class, "cls", "left")
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("n").cast("long").alias("n_shingles"), "cls", "comp", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_each(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each linked group: that of the smallest id (nulls last); rows without shingles all stay. Columns as they are."""
    names = docs.columns
    inside = [f"c{i}" for i in range(len(names))]
    own = docs.toDF(*inside)
    id_in, text_in = (inside[names.index(c)] for c in (id_col, text_col))
    linked = link_groups(own, k, percent, id_in, text_in)
    first = linked.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col(id_in).isNull().alias("no_id"), F.col(id_in).alias("id"), "text_hash")).alias("x"))
    keep = written(first.select(F.coalesce("x.id", F.lit(0)).alias("_id"), F.col("x.no_id").alias("_no_id"), F.col("x.text_hash").alias("_hash")), "kept")
    n = keep.count()
    again = linked.where("comp IS NOT NULL").groupBy(id_in, "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    # texts without a word have no shingle
    no_words = F.trim(F.translate(F.coalesce(F.col(text_in).cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
    keyed = own.select("*", F.coalesce(F.col(id_in).cast("long"), F.lit(0)).alias("_id"), F.col(id_in).isNull().alias("_no_id"), F.xxhash64(F.col(text_in).cast("string")).alias("_hash"), no_words.alias("_none"))
    on = ["_id", "_no_id", "_hash"]
    with_words = keyed.where(~F.col("_none")).join(F.broadcast(keep) if n <= BROADCAST_IDS else keep, on, "left_semi")
    if not again:  # repeated rows: the first of equal keys, in the order of all their columns
        with_words = with_words.withColumn("_nth", F.row_number().over(Window.partitionBy(*on).orderBy(*in_full(own)))).where("_nth = 1")
    return with_words.select(*inside).unionAll(keyed.where("_none").select(*inside)).toDF(*names)
