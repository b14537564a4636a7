"""Quality classifier from weak labels.

1. Heuristic labellers look at a whole text and vote good (1), bad (0) or abstain. They overlap, err, and know no truth.
2. Expectation-maximisation estimates each labeller's accuracy on good and on bad texts, and the share of good texts,
   from how often each pattern of votes occurs. Patterns are counted over all rows; there are at most 3**labellers of
   them, however many rows, and each has a posterior.
3. Posterior labels train a linear scorer (logistic loss, soft labels) on hashed features of texts: words, and coarse
   levels of the statistics. It is fitted on the driver on a sample of at most FIT_ROWS rows, half from each side of the
   posterior, of texts of any length: executors send a text's hashed features, at most WIDTH of them.
4. The scorer scores all rows in one map-only scan. A row is kept if its score is at least `keep_from`.

Defined cases. Null, empty or blank text: no statistics, every labeller that needs words votes bad, score 0, not kept.
Repeated rows: a row each. Empty table: no rows. A fit with rows of one side only gives the posterior's side to all.
Extra columns are not read. Very long texts are handled whole, in slices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .runtime import forget, ship, written

WIDTH = 1 << 14
FIT_ROWS = 8_000
STATISTICS = ("n_words", "mean_word", "symbol_words", "lone_symbols", "distinct", "top_share", "letters", "caps", "digits", "sentence_ends", "repeat_next")
ABSTAIN, BAD, GOOD = -1, 0, 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x STATISTICS, and hashes and rows of the words."""
    n_rows = len(offsets) - 1
    base = offsets[0]
    part = data[base : offsets[-1]]
    low = textkit.LOWER[part]
    starts, ends, row = textkit.words(low, offsets - base)
    h = textkit.span_hashes(low, starts, ends)
    letter = (textkit.LETTERS[low] != 0x20) & ~textkit.WHITE[low]
    run = np.concatenate([[0], np.cumsum(letter)])
    symbols = np.concatenate([[0], np.cumsum(~letter & ~textkit.WHITE[low])])
    in_word, odd = run[ends] - run[starts], symbols[ends] - symbols[starts]
    n = np.bincount(row, minlength=n_rows).astype(float)
    each = np.maximum(n, 1)
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def share(mask):
        return np.bincount(row, weights=mask, minlength=n_rows) / each

    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.ones(len(hs), bool)
    if len(hs):
        new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(hs)))
    top = np.zeros(n_rows)
    np.maximum.at(top, rs[at], runs)
    distinct = np.bincount(rs[at], minlength=n_rows)
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])

    def per_byte(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[offsets[1:] - base] - c[offsets[:-1] - base]) / size

    x = np.stack([
        n, np.bincount(row, weights=ends - starts, minlength=n_rows) / each, share((odd >= 2) & (in_word > 0)), share(in_word == 0), distinct / each, top / each,
        per_byte(letter), per_byte((part >= 65) & (part <= 90)), per_byte((part >= 48) & (part <= 57)), share(np.isin(low[ends - 1], [0x2E, 0x21, 0x3F]) if len(ends) else np.zeros(0)), share(again),
    ], axis=1)
    return x, h, row


def _vote(n, bad, good):
    out = np.full(n, ABSTAIN, np.int8)
    out[good] = GOOD
    out[bad] = BAD
    return out


def labellers(x: np.ndarray) -> np.ndarray:
    """Rows x labellers: votes."""
    c = dict(zip(STATISTICS, x.T))
    n, long = len(x), c["n_words"] >= 20
    return np.stack([
        _vote(n, c["n_words"] < 1, c["n_words"] >= 30),
        _vote(n, c["symbol_words"] > 0.25, c["symbol_words"] < 0.02),
        _vote(n, c["lone_symbols"] > 0.12, c["lone_symbols"] < 0.02),
        _vote(n, long & (c["distinct"] < 0.25), long & (c["distinct"] > 0.4)),
        _vote(n, long & (c["top_share"] > 0.3), long & (c["top_share"] < 0.15)),
        _vote(n, c["letters"] < 0.6, c["letters"] > 0.72),
        _vote(n, (c["caps"] > 0.4) | (c["digits"] > 0.25), (c["caps"] < 0.1) & (c["digits"] < 0.05)),
        _vote(n, c["repeat_next"] > 0.15, long & (c["repeat_next"] < 0.03)),
    ], axis=1)


N_LABELLERS = 8


def pattern_of(votes: np.ndarray) -> np.ndarray:
    return ((votes + 1).astype(np.int64) * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def votes_of(patterns: np.ndarray, k: int = N_LABELLERS) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(k)) % 3 - 1


@dataclass
class LabelModel:
    """share: of good texts. rates[c, l, v]: how often labeller l, where it votes, votes v - 1 on texts of class c; an abstention says nothing (1)."""

    share: float
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        if not len(votes):
            return np.zeros(0)
        log = [np.log(p) + np.log(self.rates[c][np.arange(votes.shape[1]), votes + 1]).sum(axis=1) for c, p in ((0, 1 - self.share), (1, self.share))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller, where it votes: the share of its votes that are right."""
        right = self.share * self.rates[1, :, 2] + (1 - self.share) * self.rates[0, :, 1]
        wrong = self.share * self.rates[1, :, 1] + (1 - self.share) * self.rates[0, :, 2]
        return right / np.maximum(right + wrong, 1e-12)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, k: int = N_LABELLERS) -> LabelModel:
    """Expectation-maximisation over counted vote patterns, begun at a vote that any labeller's alarm outweighs."""
    votes = votes_of(patterns, k)
    bad, good = (votes == BAD).sum(axis=1), (votes == GOOD).sum(axis=1)
    p = np.where(bad > 0, 0.2 / bad.clip(1), np.where(good > 0, 0.95, 0.6))
    w = counts.astype(float)
    model = None
    for _ in range(rounds):
        share = float(np.clip((w * p).sum() / max(w.sum(), 1), 1e-3, 1 - 1e-3))
        rates = np.zeros((2, k, 3))
        for c, q in ((0, 1 - p), (1, p)):
            for v in (1, 2):
                rates[c, :, v] = ((w * q)[:, None] * (votes == v - 1)).sum(axis=0) + 0.5
            rates[c] /= rates[c].sum(axis=1, keepdims=True)
            rates[c, :, 0] = 1.0
        model = LabelModel(share, rates)
        new = model.posterior(votes)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return model


def features(x: np.ndarray, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse (row, column, value): log counts of hashed words, of length 1 a row, and a column for each level of each statistic."""
    n_rows = len(x)
    col = (h & np.uint64(WIDTH // 2 - 1)).astype(np.int64)
    key, count = np.unique(row * WIDTH + col, return_counts=True)
    r, c, v = key // WIDTH, key % WIDTH, np.log1p(count)
    norm = np.sqrt(np.bincount(r, weights=v * v, minlength=n_rows))
    v = v / np.maximum(norm[r], 1e-9)
    edges = {"n_words": (1, 5, 20, 100, 1000), "mean_word": (2, 4, 6, 8, 12)}
    levels = np.stack([np.digitize(x[:, i], edges.get(s, (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9))) for i, s in enumerate(STATISTICS)], axis=1)
    own = WIDTH // 2 + np.arange(len(STATISTICS)) * 16 + levels
    return np.concatenate([r, np.repeat(np.arange(n_rows), len(STATISTICS))]), np.concatenate([c, own.ravel()]), np.concatenate([v, np.full(own.size, 0.5)])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 60, step: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with one step size a column (from past gradients), for soft labels. rows: columns, values, label."""
    w, bias = np.zeros(WIDTH), 0.0
    if not rows:
        return w, bias
    y = np.array([p for _, _, p in rows])
    r = np.repeat(np.arange(len(rows)), [len(c) for c, _, _ in rows])
    c, v = np.concatenate([c for c, _, _ in rows]).astype(np.int64), np.concatenate([v for _, v, _ in rows]).astype(float)
    past, past_b = np.full(WIDTH, 1e-6), 1e-6
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(np.bincount(r, weights=w[c] * v, minlength=len(y)) + bias))) - y
        gw, gb = np.bincount(c, weights=g[r] * v, minlength=WIDTH) / len(y) + 1e-5 * w, g.mean()
        past, past_b = past + gw**2, past_b + gb**2
        w, bias = w - step * gw / np.sqrt(past) * 0.2, bias - step * gb / np.sqrt(past_b) * 0.2
    return w, bias


def _texts(docs: DataFrame, id_cols: list[Column], text_col: str) -> DataFrame:
    return docs.select(*[c.alias(f"k{i}") for i, c in enumerate(id_cols)], F.col(text_col).cast("string").alias("text"))


def vote_patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """text_hash, text_size and vote pattern of every row."""
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")

    def run(batches):
        for b in batches:
            data, offsets = textkit.buffers(b.column(2))
            got = [pattern_of(labellers(statistics(data, offsets[i : j + 1])[0])) for i, j in textkit.slices(offsets)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(got) if got else np.zeros(0, np.int64), pa.int64())], ["text_hash", "text_size", "pattern"])

    return docs.select(F.xxhash64(text).alias("text_hash"), F.coalesce(F.octet_length(text), F.lit(0)).alias("text_size"), text.alias("text")).mapInArrow(run, "text_hash long, text_size int, pattern long")


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model | None:
    """Label model from the votes on all rows, and the scorer from a bounded sample of posterior labels."""
    seen = written(vote_patterns(docs, text_col), "votes")
    counted = seen.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # at most 3**labellers rows
    if not counted:
        return None
    patterns, n = (np.array([r[i] for r in counted]) for i in range(2))
    labels = fit_labels(patterns, n)
    p = labels.posterior(votes_of(patterns))
    spark = docs.sparkSession
    rate = [min(1.0, fit_rows / 2 / max(1, int(n[side].sum()))) for side in (p < 0.5, p >= 0.5)]
    table = spark.createDataFrame([(int(a), float(b), int(1_000_000 * rate[int(b >= 0.5)])) for a, b in zip(patterns, p)], "pattern long, p double, most long")
    chosen = seen.join(F.broadcast(table), "pattern").where(F.pmod(F.col("text_hash"), F.lit(1_000_000)) < F.col("most")).select("text_hash", "text_size", "p").dropDuplicates(["text_hash", "text_size"]).orderBy(F.xxhash64("text_hash"), "text_size").limit(2 * fit_rows)
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.xxhash64(text).alias("text_hash"), F.coalesce(F.octet_length(text), F.lit(0)).alias("text_size"), text.alias("text"))
    found = keyed.join(F.broadcast(chosen), ["text_hash", "text_size"]).dropDuplicates(["text_hash", "text_size"]).select("text_hash", "p", "text")

    def run(batches):
        for b in batches:
            data, offsets = textkit.buffers(b.column(2))
            columns, values = [], []
            for i, j in textkit.slices(offsets):
                r, c, v = features(*statistics(data, offsets[i : j + 1]))
                order = np.argsort(r, kind="stable")
                for own in np.split(order, np.searchsorted(r[order], np.arange(1, j - i))):
                    columns.append(c[own].astype(np.int32).tobytes())
                    values.append(v[own].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(columns, pa.binary()), pa.array(values, pa.binary())], ["text_hash", "p", "columns", "values"])

    rows = found.mapInArrow(run, "text_hash long, p double, columns binary, values binary").orderBy("text_hash").collect()  # at most 2 * fit_rows, of WIDTH features at most
    forget(seen)
    rows = [(np.frombuffer(r["columns"], np.int32), np.frombuffer(r["values"], np.float32), r["p"]) for r in rows]
    return Model(labels, *fit_scorer(rows))


def score(docs: DataFrame, model: Model | None, id_cols: dict[str, Column], text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """One row for each row: id_cols, n_good, n_bad (votes), weak_label (posterior), score (0 to 1), keep."""
    ship(docs.sparkSession)
    narrow = _texts(docs, list(id_cols.values()), text_col)
    schema = "".join(f"k{i} {f.dataType.simpleString()}, " for i, f in enumerate(narrow.schema.fields[:-1]))

    def run(batches):
        for b in batches:
            data, offsets = textkit.buffers(b.column(b.num_columns - 1))
            n = len(offsets) - 1
            good, bad, weak, out = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
            for i, j in textkit.slices(offsets):
                x, h, row = statistics(data, offsets[i : j + 1])
                votes = labellers(x)
                good[i:j], bad[i:j] = (votes == GOOD).sum(axis=1), (votes == BAD).sum(axis=1)
                if model is not None:
                    weak[i:j] = model.labels.posterior(votes)
                    r, c, v = features(x, h, row)
                    s = 1 / (1 + np.exp(-(np.bincount(r, weights=model.weights[c] * v, minlength=j - i) + model.bias)))
                    out[i:j] = np.where(x[:, 0] > 0, s, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(good), pa.array(bad), pa.array(weak), pa.array(out), pa.array(out >= keep_from)], [*b.schema.names[:-1], "n_good", "n_bad", "weak_label", "score", "keep"])

    return narrow.mapInArrow(run, schema + "n_good int, n_bad int, weak_label double, score double, keep boolean").toDF(*id_cols, "n_good", "n_bad", "weak_label", "score", "keep")
