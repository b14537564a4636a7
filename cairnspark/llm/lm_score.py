"""Language-model scores from an n-gram trie in Elias-Fano levels.

Level 1 holds the words (64-bit hashes, an Elias-Fano sequence) with their counts. An entry of level k is a word after a
context, which is an entry of level k - 1. Entries stand in order of context and then word, so a context's successors are
one run: monotone pointers (an Elias-Fano sequence) say where each begins, and a query searches for its word between its
context's pointer and the next one. Word numbers take as few bytes as the vocabulary needs; probabilities are smoothed
and quantised to 16 bits of their logarithm. A level is cut into files of near equal numbers of entries, at places of
the (context, word) order that the counts of the level below tell, so a frequent context is spread over several files.
Workers memory-map the files from the shared folder and ask each for all sorted n-grams of CHUNK_BYTES of text at once.

Counts come from all training rows. Tasks add up what they see, sorted and packed, before anything is shuffled. With
min_count 1, as op7_lm_score has it, every n-gram of the training texts is an entry. A higher min_count (MIN_COUNT unless
given) leaves out rarer entries of levels over 1, and n-grams of which an (n-1)-gram is no entry: then counts don't
cover all of the training texts. Smoothing is interpolated absolute discounting:
p(w | c) = (count - DISCOUNT) / count(c) + rest(c) * p(w | shorter c), down to (count + 1) / (N + V + 1).

Defined cases. Null text: empty, which is one end token. Null id: trains as an id of empty text. No training rows: N and
V are 0, every token is unknown. Repeated rows train as often as they stand, and get a row each. Empty table: no rows.
Extra columns are not read. Very long texts are handled whole. More (context, word) numbers than fit 63 bits: ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import elias_fano, textkit
from .runtime import delete_path, fresh_path, one_to_a_task, partitions, ship

ORDER, MIN_COUNT, DISCOUNT = 3, 2, 0.75
END = np.uint64(0xE17A1465F0E1D2C3)
CHUNK_BYTES = 12 << 20
FILE_ENTRIES = 12_000_000
LEAST_FILES = 16
QUANTILES = 64
_FLUSH = 3_000_000
_open: dict[str, "Model"] = {}


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the tokens of rows: the words, then one end each."""
    h, row = textkit.lower_words(data, offsets)
    n_rows = len(offsets) - 1
    count = np.bincount(row, minlength=n_rows)
    ends = np.cumsum(count + 1) - 1
    out = np.full(len(h) + n_rows, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = h
    return out, np.repeat(np.arange(n_rows), count + 1)


def chunks(batches, column: int):
    """(hashes, first) of the tokens of rows, CHUNK_BYTES of text or a row at a time; first: whether a token begins its text."""
    held, size = [], 0
    for b in batches:
        data, offsets = textkit.buffers(b.column(column))
        for i, j in textkit.slices(offsets):
            h, row = tokens(data, offsets[i : j + 1])
            first = np.ones(len(row), bool)
            first[1:] = row[1:] != row[:-1]
            held.append((h, first))
            size += int(offsets[j] - offsets[i])
            if size >= CHUNK_BYTES:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _quantised(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16 bits of their log10, from -16 to 0."""
    return np.round((np.log10(np.maximum(p, 1e-16)) + 16) * (65535 / 16)).astype(np.uint16)


def _probability(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (q.astype(np.float64) * (16 / 65535) - 16)


def _least(numbers: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    return numbers.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if int(numbers.max(initial=0)) <= np.iinfo(t).max))


@dataclass
class Level:
    """One level in files: `bounds` has the least key of each file and the end, `begins` the number of its first entry and the end."""

    paths: list[str]
    bounds: np.ndarray
    begins: np.ndarray

    def __post_init__(self):
        self.files: dict[int, dict] = {}

    def __getstate__(self):
        return {"paths": self.paths, "bounds": self.bounds, "begins": self.begins}

    def __setstate__(self, s):
        self.__dict__.update(s)
        self.files = {}

    def file(self, i: int, part: str = "") -> dict:
        if (i, part) not in self.files:
            a = elias_fano.load(self.paths[i] + part)
            if "high" in a:
                a = dict(a, sequence=elias_fano.Sequence(a))
            self.files[i, part] = a
        return self.files[i, part]

    def spans(self, sorted_numbers: np.ndarray, edges: np.ndarray):
        """(file, from, to) for runs of ascending numbers that lie between a file's edges."""
        cut = np.searchsorted(sorted_numbers, edges[1:-1])
        cut = np.concatenate([[0], cut, [len(sorted_numbers)]])
        for i in np.flatnonzero(np.diff(cut)):
            if self.begins[i + 1] > self.begins[i]:
                yield int(i), int(cut[i]), int(cut[i + 1])

    def values(self, name: str, numbers: np.ndarray, part: str = "") -> np.ndarray:
        """An array's values at these ascending numbers of entries."""
        out = np.zeros(len(numbers))
        for i, a, b in self.spans(numbers, self.begins):
            out[a:b] = self.file(i, part)[name][numbers[a:b] - self.begins[i]]
        return out


@dataclass
class Model:
    name: str
    total: int
    vocabulary: int
    rows: int
    levels: list[Level]
    split: list[dict[int, float]] = field(default_factory=list)  # for levels over 1: what smoothing leaves of contexts at the cuts between files

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of ascending hashes, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        level = self.levels[0]
        for i, a, b in level.spans(hashes, level.bounds):
            got = level.file(i)["sequence"].find(hashes[a:b])
            out[a:b] = np.where(got >= 0, got + level.begins[i], -1)
        return out

    def find(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending keys: numbers of the entries, or -1, and what smoothing leaves to the shorter context."""
        own, v = self.levels[level], self.vocabulary + 1
        out, rest = np.full(len(keys), -1, np.int64), np.ones(len(keys))
        for i, a, b in own.spans(keys, own.bounds):
            f = own.file(i)
            context = keys[a:b] // v
            word = (keys[a:b] - context * v).astype(np.uint64)
            at = context - int(f["first"][0])
            inside = np.flatnonzero((at >= 0) & (at < len(f["used"])))  # others have no successors here
            at = at[inside]
            lo = f["sequence"].get(at)
            hi = f["sequence"].get(at + 1)
            width = int(f["width"][0])
            got = elias_fano.search(lo, hi, word[inside], lambda p: elias_fano.unpacked(f["words"], width, p))
            out[a:b][inside] = np.where(got >= 0, got + own.begins[i], -1)
            rest[a:b][inside] = 1 - f["used"][at] / 65535
        for c, left in self.split[level - 1].items():
            a, b = np.searchsorted(keys, [c * v, (c + 1) * v])
            rest[a:b] = left
        return out, rest

    def context_counts(self, level: int, numbers: np.ndarray) -> np.ndarray:
        """How often each context was followed by a token; ascending numbers."""
        if level == 0:
            out = np.full(len(numbers), self.rows, np.float64)
            word = numbers < self.vocabulary
            out[word] = self.levels[0].values("count", numbers[word])
            return out
        return self.levels[level].values("count", numbers, ".count")

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        own, back = np.unique(hashes, return_inverse=True)
        return self.words(own)[back]

    def shifted(self, entry: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
        """Each token's context: the entry that the token before it ended; `begin` where a text begins."""
        out = np.full(len(entry), -1, np.int64)
        out[1:] = entry[:-1]
        out[first] = begin
        return out

    def looked_up(self, level: int, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry, rest = np.full(len(ids), -1, np.int64), np.ones(len(ids))
        at = np.flatnonzero(context >= 0)
        # a word that training never saw has the number V, which no entry has
        own, back = np.unique(context[at] * (self.vocabulary + 1) + np.where(ids[at] >= 0, ids[at], self.vocabulary), return_inverse=True)
        found, left = self.find(level, own)
        entry[at], rest[at] = found[back], left[back]
        return entry, rest

    def keys(self, order: int, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Keys of the n-grams of `order` whose two (n-1)-grams are entries."""
        entry, begin = ids, self.vocabulary
        for level in range(1, order - 1):
            entry, _ = self.looked_up(level, self.shifted(entry, first, begin), ids)
            begin = -1
        context = self.shifted(entry, first, begin)
        at = np.flatnonzero((context >= 0) & (entry >= 0))
        return (context[at] * (self.vocabulary + 1) + ids[at]).astype(np.uint64)

    def score(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the base probability and of the model's, for each token."""
        own, back = np.unique(ids, return_inverse=True)
        count = np.zeros(len(own))
        if self.levels:
            count[own >= 0] = self.levels[0].values("count", own[own >= 0])
        base = ((count + 1) / (self.total + self.vocabulary + 1))[back]
        p, entry, begin = base, ids, self.vocabulary
        for level in range(1, len(self.levels)):
            entry, rest = self.looked_up(level, self.shifted(entry, first, begin), ids)
            begin = -1
            p = rest * p
            hit = np.flatnonzero(entry >= 0)
            numbers, again = np.unique(entry[hit], return_inverse=True)
            p[hit] += _probability(self.levels[level].values("p", numbers))[again]
        return np.log10(base), np.log10(np.minimum(p, 1.0))


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, byte by byte: all lowest bytes, then the next, as far as any isn't 0."""
    out = [len(keys).to_bytes(8, "little")]
    for x in (np.diff(keys, prepend=np.uint64(0)), counts.astype(np.uint64)):
        planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
        used = next((k for k in range(8, 0, -1) if planes[k - 1].any()), 0)
        out += [bytes([used]), np.ascontiguousarray(planes[:used]).tobytes()]
    return b"".join(out)


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, at, out = int.from_bytes(b[:8], "little"), 8, []
    for _ in range(2):
        planes = np.zeros((8, n), np.uint8)
        planes[: b[at]] = np.frombuffer(b, np.uint8, b[at] * n, at + 1).reshape(b[at], n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"))
        at += 1 + b[at] * n
    return np.cumsum(out[0], dtype=np.uint64), out[1].astype(np.int64)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _counter(keys_of, bounds: np.ndarray, labels: list[int]):
    """A scan that adds up, within a task, the keys that keys_of(hashes, first) finds, and deals them by `bounds` to the files' labels."""

    def run(batches):
        held, size = [], 0

        def out():
            keys, counts = _added(*(np.concatenate(x) for x in zip(*held)))
            cut = np.concatenate([[0], np.searchsorted(keys, bounds[1:-1]), [len(keys)]])
            own = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array([labels[i] for i in own], pa.int32()), pa.array([_pack(keys[cut[i] : cut[i + 1]], counts[cut[i] : cut[i + 1]]) for i in own], pa.binary())], ["file", "packed"])

        for h, first in chunks(batches, 0):
            own, n = np.unique(keys_of(h, first), return_counts=True)
            held.append((own, n))
            size += len(own)
            if size > _FLUSH:
                yield out()
                held, size = [], 0
        if size:
            yield out()
        textkit.release()

    return run


def _by_file(batches, labels: list[int]):
    number = {x: i for i, x in enumerate(labels)}
    got: dict[int, list] = {}
    for b in batches:
        for f, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got.setdefault(number[f], []).append(packed)
    for f in sorted(got):
        parts = [_unpack(p) for p in got.pop(f)]
        yield f, *_added(*(np.concatenate(x) for x in zip(*parts)))
    textkit.release()


def _quantiles(weights: np.ndarray, begin: int, v: int) -> list[int]:
    """QUANTILES keys that cut these contexts (from number `begin`) into parts of equal weight, the words of a context being spread evenly."""
    total = np.cumsum(weights.astype(np.float64))
    want = np.arange(QUANTILES) * (total[-1] / QUANTILES)
    c = np.minimum(np.searchsorted(total, want, side="right"), len(weights) - 1)
    part = (want - (total[c] - weights[c])) / np.maximum(weights[c], 1)
    return ((begin + c) * v + np.minimum((part * v).astype(np.int64), v - 1)).tolist()


def _cuts(made: list, files: int, end: int) -> np.ndarray:
    """Least keys of `files` files and the end, from the quantiles of the files below."""
    keys = np.concatenate([np.array(r["quantiles"], np.int64) for r in made if r["n"]])
    weight = np.concatenate([np.full(len(r["quantiles"]), r["weight"] / QUANTILES) for r in made if r["n"]])
    order = np.argsort(keys, kind="stable")
    keys, before = keys[order], np.cumsum(weight[order]) - weight[order]
    inner = keys[np.searchsorted(before, np.arange(1, files) * (weight.sum() / files))] if len(keys) else []
    return np.concatenate([[0], np.minimum(inner, end), [end]]).astype(np.uint64)


_MADE = "file int, n long, weight double, quantiles array<long>, total long, rows long, edges array<struct<context:long,used:double>>"


def _made(file: int, n: int, weights: np.ndarray, begin_contexts: list[int], total: int = 0, rows: int = 0, edges: list = ()):
    struct = pa.struct([("context", pa.int64()), ("used", pa.float64())])
    return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([n], pa.int64()), pa.array([float(weights.sum())]), pa.array([begin_contexts], pa.list_(pa.int64())), pa.array([int(total)], pa.int64()), pa.array([int(rows)], pa.int64()), pa.array([[{"context": int(c), "used": float(u)} for c, u in edges]], pa.list_(struct))], ["file", "n", "weight", "quantiles", "total", "rows", "edges"])


def train(texts: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT, text_col: str = "text") -> Model:
    """The model of all rows of `texts`; its files are in the shared folder, until `forgotten`."""
    spark = texts.sparkSession
    ship(spark)
    root = fresh_path(spark, "ngrams")
    text = texts.select(F.col(text_col).cast("string").alias("text"))
    files = max(1, min(partitions(spark), LEAST_FILES))
    labels = one_to_a_task(spark, files)
    bounds = (np.arange(files + 1, dtype=object) * (1 << 64) // files)
    bounds[-1] -= 1
    bounds = bounds.astype(np.uint64)

    def words(batches):
        for f, keys, counts in _by_file(batches, labels):
            elias_fano.save(f"{root}/1/{f}", elias_fano.build(keys) | {"count": _least(counts)})
            # numbers within the file: the driver knows how many words stand before it
            yield _made(f, len(keys), counts, _quantiles(counts, 0, 1 << 20), counts.sum(), counts[keys == END].sum())

    counted = text.mapInArrow(_counter(lambda h, first: h, bounds, labels), "file int, packed binary").repartition(files, "file")
    made = sorted(counted.mapInArrow(words, _MADE).collect(), key=lambda r: r["file"])  # a row a file
    sizes = {r["file"]: r["n"] for r in made}
    begins = np.concatenate([[0], np.cumsum([sizes.get(f, 0) for f in range(files)])]).astype(np.int64)
    rows, total, vocabulary = sum(r["rows"] for r in made), sum(r["total"] for r in made), int(begins[-1])
    model = Model(root, total, vocabulary, rows, [Level([f"{root}/1/{f}" for f in range(files)], bounds, begins)] if made else [])
    if not made:
        return model
    v = vocabulary + 1
    # what a level's entries follow: words with their counts, and the begin of a text
    below = []
    for r in made:
        q = np.array(r["quantiles"], np.int64)
        c, part = q >> 20, q & ((1 << 20) - 1)
        below.append({"n": r["n"], "weight": r["weight"], "quantiles": (begins[r["file"]] + c) * v + part * v // (1 << 20)})
    below.append({"n": 1, "weight": float(rows), "quantiles": (vocabulary * v + np.arange(QUANTILES) * v // QUANTILES)})
    contexts = v
    for n in range(2, order + 1):
        if contexts * v >= 1 << 63:
            raise ValueError(f"{contexts} contexts and {vocabulary} words don't fit 63 bits")
        files = max(1, min(partitions(spark), LEAST_FILES), -(-total // FILE_ENTRIES))
        cuts = _cuts(below, files, contexts * v)
        model, below = _next_level(text, model, n, min_count, discount, files, cuts, root, n == order)
        contexts = int(model.levels[-1].begins[-1])
        if not contexts:
            break
    for n in range(2, order):
        for path in model.levels[n - 1].paths if len(model.levels) >= n else ():
            delete_path(spark, path + ".count")  # only training needs the counts of longer contexts
    return model


def _next_level(text: DataFrame, model: Model, n: int, min_count: int, discount: float, files: int, cuts: np.ndarray, root: str, last: bool) -> tuple[Model, list]:
    held = text.sparkSession.sparkContext.broadcast(model)  # names and sizes of files only
    v = model.vocabulary + 1
    width, labels = max(1, (v.bit_length() + 7) // 8), one_to_a_task(text.sparkSession, files)

    def keys_of(h, first):
        m = opened(held.value)
        return m.keys(n, m.ids(h), first)

    def build(batches):
        m = opened(held.value)
        for f, keys, counts in _by_file(batches, labels):
            keep = counts >= min_count
            keys, counts = keys[keep].astype(np.int64), counts[keep]
            if not len(keys):
                continue
            context = keys // v
            begins = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            own = context[begins]
            of = np.repeat(np.arange(len(own)), np.diff(np.append(begins, len(keys))))
            p = (counts - discount) / np.maximum(m.context_counts(n - 2, own), 1)[of]
            used = np.bincount(of, weights=p)
            c0, c1 = int(own[0]), int(own[-1])
            pointers = np.searchsorted(context, np.arange(c0, c1 + 2)).astype(np.uint64)
            all_used = np.zeros(c1 - c0 + 1, np.uint16)
            all_used[own - c0] = np.minimum(np.round(used * 65535), 65535).astype(np.uint16)
            path = f"{root}/{n}/{f}"
            elias_fano.save(path, elias_fano.build(pointers) | {"first": np.array([c0], np.int64), "width": np.array([width], np.int64), "words": elias_fano.packed(keys - context * v, width), "p": _quantised(p), "used": all_used})
            if not last:
                elias_fano.save(path + ".count", {"count": _least(counts)})
            quantiles = [] if last else _quantiles(counts, 0, 1 << 20)
            yield _made(f, len(keys), counts, quantiles, edges=[(c0, used[0]), (c1, used[-1])] if c0 < c1 else [(c0, used[0])])

    counted = text.mapInArrow(_counter(keys_of, cuts, labels), "file int, packed binary").repartition(files, "file")
    made = sorted(counted.mapInArrow(build, _MADE).collect(), key=lambda r: r["file"])  # a row a file
    sizes = {r["file"]: r["n"] for r in made}
    begins = np.concatenate([[0], np.cumsum([sizes.get(f, 0) for f in range(files)])]).astype(np.int64)
    # contexts that lie at a cut: their run may go on in the next file
    used, at_cuts = {}, {int(c) // v for c in cuts[1:-1]}
    for r in made:
        for e in r["edges"]:
            used.setdefault(e["context"], []).append(e["used"])
    split = {c: max(0.0, 1 - sum(u)) for c, u in used.items() if len(u) > 1 or c in at_cuts}
    below = []
    for r in made if not last else ():
        q = np.array(r["quantiles"], np.int64)
        below.append({"n": r["n"], "weight": r["weight"], "quantiles": (begins[r["file"]] + (q >> 20)) * v + (q & ((1 << 20) - 1)) * v // (1 << 20)})
    level = Level([f"{root}/{n}/{f}" for f in range(files)], cuts.astype(np.int64), begins)
    return Model(f"{root}:{n}", model.total, model.vocabulary, model.rows, [*model.levels, level], [*model.split, split]), below


def forgotten(spark, model: Model) -> None:
    """Deletes the model's files; no score that is still to be computed may need them."""
    delete_path(spark, model.name.removesuffix(f":{len(model.levels)}"))


def opened(model: Model) -> Model:
    """The model with its files as this process has them open."""
    if model.name not in _open:
        _open.clear()
        _open[model.name] = model
    return _open[model.name]


def score(docs: DataFrame, model: Model, id_cols: dict[str, Column], text_col: str = "text") -> DataFrame:
    """One row for each row: id_cols, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # names and sizes of files only
    narrow = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(id_cols.values())], F.col(text_col).cast("string").alias("text"))
    narrow_width = len(id_cols)
    schema = "".join(f"k{i} {f.dataType.simpleString()}, " for i, f in enumerate(narrow.schema.fields[:-1]))

    kinds = to_arrow_schema(narrow.schema)

    def run(batches):
        m, ahead = opened(held.value), []

        def noted():
            for b in batches:
                ahead.extend(zip(*(c.to_pylist() for c in b.columns[:-1])) if narrow_width else [()] * b.num_rows)
                yield b

        for h, first in chunks(noted(), narrow_width):
            ids = m.ids(h) if m.levels else np.full(len(h), -1, np.int64)
            base, own = m.score(ids, first)
            starts = np.flatnonzero(first)
            keys = [pa.array([k[i] for k in ahead[: len(starts)]], kinds.field(i).type) for i in range(narrow_width)]
            del ahead[: len(starts)]
            cols = [np.add.reduceat(x, starts) for x in (np.ones(len(ids), np.int64), (ids >= 0).astype(np.int64), base, own)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(cols[0]), pa.array(cols[1]), pa.array(np.full(len(starts), m.total, np.int64)), pa.array(cols[2]), pa.array(cols[3])], [*kinds.names[:-1], "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        textkit.release()

    return narrow.mapInArrow(run, schema + "n_tokens long, n_known long, train_tokens long, base_score double, score double").toDF(*id_cols, "n_tokens", "n_known", "train_tokens", "base_score", "score")

