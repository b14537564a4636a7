"""Language identification by hierarchical discrimination.

The family of a text's language is predicted first; then one-versus-one linear support vector machines separate the
languages within that family. Features are hashed n-grams of bytes of the whole text. The machines (L2 loss) are trained
by dual coordinate descent on the driver, on a sample bounded by PER_LANG texts a language, of any length: executors
send the counts of a whole text's n-grams (WIDTH numbers) and a few short pieces of it, never the text. Everything else
runs over whole texts in one map-only scan.

Defined cases. Text null or without a letter: `und`, score 0. Null labels don't train. No labels at all, or an empty
table: every text is `und`. Repeated rows: a row each. Ties between languages: the first in text order. A language of no
known family is a family of its own. Extra columns are not read. Very long texts are handled whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .runtime import forget, ship, written

WIDTH, SIZES = 4096, (1, 2, 3)
PER_LANG = 300
PIECES, PIECES_EACH = (3, 8, 24), 8
UNDETERMINED = "und"
#: Families of common languages.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl"),
    "uralic": ("fi", "hu", "et"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "ne"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss; y is +1 or -1."""
    k = x @ x.T + 1.0
    d = 0.5 / c
    a, f = np.zeros(len(y)), np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            step = max(a[i] - (y[i] * f[i] - 1 + d * a[i]) / (k[i, i] + d), 0.0) - a[i]
            if step:
                a[i] += step
                f += (step * y[i]) * k[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return (a * y) @ x, float((a * y).sum())


@dataclass
class OneVersusOne:
    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    w: np.ndarray | None = None
    b: np.ndarray | None = None

    def fit(self, x: np.ndarray, labels: np.ndarray) -> "OneVersusOne":
        self.pairs = list(combinations(range(len(self.names)), 2))
        fits = []
        for i, j in self.pairs:
            of = (labels == self.names[i]) | (labels == self.names[j])
            fits.append(svm(x[of], np.where(labels[of] == self.names[i], 1.0, -1.0)))
        if fits:
            self.w, self.b = np.array([w for w, _ in fits], np.float32).T, np.array([b for _, b in fits], np.float32)
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of the class that wins most duels (then the largest sum of margins), and a score in 0..1."""
        n = len(x)
        if not self.pairs:
            return np.zeros(n, int), np.ones(n)
        m = x @ self.w + self.b
        p = 1.0 / (1.0 + np.exp(-4.0 * m.astype(float)))
        votes, soft = np.zeros((n, len(self.names))), np.zeros((n, len(self.names)))
        for at, (i, j) in enumerate(self.pairs):
            votes[:, i] += m[:, at] >= 0
            votes[:, j] += m[:, at] < 0
            soft[:, i] += p[:, at]
            soft[:, j] += 1 - p[:, at]
        soft /= len(self.names) - 1
        best = np.argmax(votes + soft / (1 + len(self.names)), axis=1)
        return best, soft[np.arange(n), best]


@dataclass
class Model:
    families: OneVersusOne
    within: dict[str, OneVersusOne]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = textkit.byte_ngrams(data, offsets, SIZES, WIDTH)
        family, score = self.families.predict(x)
        out = np.empty(len(x), object)
        for k in np.unique(family):
            at = np.flatnonzero(family == k)
            inner = self.within[self.families.names[k]]
            best, inner_score = inner.predict(x[at])
            out[at] = np.array(inner.names, object)[best]
            score[at] *= inner_score
        return out, np.clip(score, 0.0, 1.0)


@dataclass
class Sample:
    """Of each text of a labelled sample: a hash, its language, n-gram counts of the whole text, and for each size in PIECES some pieces."""

    keys: list[int]
    langs: list[str]
    counts: np.ndarray
    pieces: list[list[list[str]]]


def fit(sample: Sample) -> Model | None:
    if not sample.langs:
        return None
    x = textkit.unit_logs(sample.counts)
    labels = np.array(sample.langs, object)
    family = np.array([_FAMILY_OF.get(v, v) for v in sample.langs], object)
    names = sorted(set(family))
    top = OneVersusOne(names).fit(x, family)
    return Model(top, {f: OneVersusOne(sorted(set(labels[family == f]))).fit(x[family == f], labels[family == f]) for f in names})


@dataclass
class Typical:
    """How like a language a text must be: the mean over its n-grams of log(how much more frequent than at random).

    A floor is half of what nearly every piece of the language's labelled texts reaches in a profile made without its
    text, for pieces of PIECES bytes; a text has the floor of the longest piece that is no longer than it. A text fits if
    it reaches the floor of any language. Floors are each language's own, so their number doesn't shift them. A language
    of one text has no second one to measure a floor on: it takes the highest of the others, or what its own text reaches
    if that is less. If no language has a second text, there are no floors.
    """

    profiles: dict[str, np.ndarray]
    floors: dict[str, np.ndarray]

    def fits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        counts = textkit.byte_ngram_counts(data, offsets, SIZES, WIDTH)
        size = np.maximum(np.searchsorted(PIECES, np.diff(offsets), side="right") - 1, 0)
        out = np.zeros(len(counts), bool)
        for v, profile in self.profiles.items():
            out |= _likeness(counts, profile) >= self.floors[v][size]
        return out


def _likeness(counts: np.ndarray, profile: np.ndarray) -> np.ndarray:
    return counts @ profile / np.maximum(counts.sum(axis=1), 1)


def _counted(texts: list[str]):
    data, offsets = textkit.buffers(pa.array(texts, pa.large_string()))
    for i, j in textkit.slices(offsets, 1 << 20, rows=512):
        yield textkit.byte_ngram_counts(data, offsets[i : j + 1], SIZES, WIDTH)


def _profile(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=0, dtype=float)
    p = total + max(0.05 * total.sum() / WIDTH, 1e-9)
    return np.log(p / p.sum() * WIDTH).astype(np.float32)


def typical(sample: Sample) -> Typical:
    """Profiles and floors of a labelled sample. A language's floor lets a hundredth of its texts have lower pieces, as labels can be wrong."""
    profiles, floors = {}, {}
    for v in sorted(set(sample.langs)):
        own = [i for i, k in enumerate(sample.langs) if k == v]
        profiles[v], floors[v] = _profile(sample.counts[own]), np.full(len(PIECES), -np.inf)
        folds = [own[0::2], own[1::2]]
        for k in range(len(PIECES)) if len(own) > 1 else ():
            least = []  # of each text, its least typical piece
            for made, held in (folds, folds[::-1]):
                profile = _profile(sample.counts[made])
                cut = [(i, piece) for i, at in enumerate(held) for piece in sample.pieces[at][k]]
                low = np.full(len(held), np.inf)
                if cut:
                    np.minimum.at(low, [i for i, _ in cut], np.concatenate([_likeness(c, profile) for c in _counted([piece for _, piece in cut])]))
                least.append(low[np.isfinite(low)])
            least = np.sort(np.concatenate(least))
            if len(least):
                floors[v][k] = min(least[len(least) // 100], least[len(least) // 100] / 2)
        floors[v] = np.minimum.accumulate(floors[v][::-1])[::-1]
    highest = np.max(list(floors.values()), axis=0) if floors else None
    for v in floors:
        own = _likeness(sample.counts[[k == v for k in sample.langs]], profiles[v]).min()
        floors[v] = np.where(np.isfinite(floors[v]), floors[v], np.minimum(highest, own))
    return Typical(profiles, floors)


def _pieces(text: str) -> list[list[str]]:
    """For each size in PIECES, the pieces with a letter that begin at PIECES_EACH places spread evenly over the text."""
    raw, out = text.encode(), []
    for size in PIECES:
        cut = [raw[at : at + size].decode(errors="ignore") for at in sorted({int(a) for a in np.linspace(0, max(0, len(raw) - size), PIECES_EACH)})]
        out.append([piece for piece in cut if any(map(str.isalpha, piece))])
    return out


def training_sample(docs: DataFrame, text_col: str, lang_col: str, per_lang: int = PER_LANG) -> Sample:
    """About per_lang distinct texts of each language, at most as many, chosen by a hash of the text."""
    ship(docs.sparkSession)
    d = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    d = d.withColumn("size", F.octet_length("text")).withColumn("key", F.xxhash64("text"))
    # copies of a text count once; only keys are shuffled
    keys = written(d.select("lang", "size", "key").distinct().withColumn("h", F.pmod("key", F.lit(1_000_000))), "sample")
    counts = keys.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    if not counts:
        forget(keys)
        return Sample([], [], np.zeros((0, WIDTH), np.float32), [])
    wanted = F.lit(False)
    for r in counts:
        wanted = wanted | ((F.col("lang") == r["lang"]) & (F.col("h") < min(1_000_000, -(-1_300_000 * per_lang // r["n"]))))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "key", "size"))
    chosen = keys.where(wanted).withColumn("nth", nth).where(F.col("nth") <= per_lang).drop("nth")
    found = d.join(F.broadcast(chosen), ["lang", "size", "key"]).groupBy("lang", "h", "key", "size").agg(F.min("text").alias("text"))

    def features(batches):
        for b in batches:
            data, offsets = textkit.buffers(b.column(3))
            rows = [c.tobytes() for i, j in textkit.slices(offsets, rows=512) for c in textkit.byte_ngram_counts(data, offsets[i : j + 1], SIZES, WIDTH)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rows, pa.binary()), pa.array([_pieces(t) for t in b.column(3).to_pylist()], pa.list_(pa.list_(pa.string())))], ["lang", "h", "key", "counts", "pieces"])

    rows = found.select("lang", "h", "key", "text").mapInArrow(features, "lang string, h long, key long, counts binary, pieces array<array<string>>").collect()  # at most per_lang a language
    forget(keys)
    rows = sorted(rows, key=lambda r: (r["lang"], r["h"], r["key"]))
    return Sample([r["key"] for r in rows], [r["lang"] for r in rows], np.array([np.frombuffer(r["counts"], np.float32) for r in rows]), [r["pieces"] for r in rows])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model | None:
    return fit(training_sample(docs, text_col, lang_col, per_lang))


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = _ASCII_LETTER[65:91] = True


def _judged(col: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of an Arrow column."""
    data, offsets = textkit.buffers(col)
    n = len(offsets) - 1
    langs, scores = np.full(n, UNDETERMINED, object), np.zeros(n)
    if model is not None:
        for i, j in textkit.slices(offsets, 1 << 20, rows=256):
            langs[i:j], scores[i:j] = model.predict(data, offsets[i : j + 1])
            part = _ASCII_LETTER[data[offsets[i] : offsets[j]]]
            seen = np.concatenate([[0], np.cumsum(part)])
            for k in np.flatnonzero(np.diff(seen[offsets[i : j + 1] - offsets[i]]) == 0) + i:
                if not any(map(str.isalpha, col[int(k)].as_py() or "")):
                    langs[k], scores[k] = UNDETERMINED, 0.0
    return langs, scores


def predict(docs: DataFrame, model: Model | None, id_cols: dict[str, Column], text_col: str = "text") -> DataFrame:
    """One row for each row: the columns of id_cols, lang_pred and score."""
    ship(docs.sparkSession)
    narrow = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(id_cols.values())], F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(narrow.schema.fields[:-1]))

    def run(batches):
        for b in batches:
            langs, scores = _judged(b.column(b.num_columns - 1), model)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])
        textkit.release()

    out = narrow.mapInArrow(run, f"{schema + ', ' if schema else ''}lang_pred string, score double")
    return out.toDF(*id_cols, "lang_pred", "score")


def held_out(doc_id: Column, fold: int = 2, of: int = 4) -> Column:
    """Whether crc32 of the id's text falls in the fold that is kept out of training; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % of == fold


def keep_known(docs: DataFrame, model: Model | None, least: float = 0.0, text_col: str = "text", like: Typical | None = None, into: str | None = None) -> DataFrame:
    """`docs` without the rows whose language is undetermined, has a score under `least` or, with `like`, whose text is like no language of the sample. The column `into`, if one is named, gets the language of the text; all others are as they are. Only texts go to Python."""
    ship(docs.sparkSession)
    names = docs.columns
    inside = [f"c{i}" for i in range(len(names))]

    @F.arrow_udf("string")
    def known(col: pa.Array) -> pa.Array:
        langs, scores = _judged(col, model)
        keep = (langs != UNDETERMINED) & (scores >= least)
        if like is not None:
            data, offsets = textkit.buffers(col)
            for i, j in textkit.slices(offsets, 1 << 20, rows=256):
                keep[i:j] &= like.fits(data, offsets[i : j + 1])
        return pa.array(langs, pa.string(), mask=~keep)

    # called nondeterministic, or the planner runs it once for the filter and once for the column
    own = docs.toDF(*inside).withColumn("known", known.asNondeterministic()(F.col(inside[names.index(text_col)]).cast("string"))).where("known IS NOT NULL")
    return own.select(*[(F.col("known").cast(f.dataType) if f.name == into else F.col(c)).alias(f.name) for c, f in zip(inside, docs.schema.fields)])
