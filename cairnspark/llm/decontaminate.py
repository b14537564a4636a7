"""Benchmark decontamination: passages of benchmark items in training texts, found by hashed n-gram windows and verified.

A window is n consecutive words of an item; an item of fewer words, but not none, is one window. Steps:

1. The distinct windows of all items, each with its hash and the ids of its items: the hash set, whose size the
   benchmark bounds. It is broadcast while it has at most BROADCAST_WINDOWS rows, which is counted; beyond that the
   same join shuffles.
2. One scan of the texts. Each word lays out a row, which holds its position and refers to its text's words. While the
   set is broadcast, it meets it inside one code-generated stage: first by the hash of the HEAD words that begin there
   (of fewer, if the shortest window has fewer), then, where this head begins some window, by the hash of the whole
   window. Beyond that all whole windows shuffle. A sentinel for each text meets a sentinel in either set, so that texts
   without hits stay. Lambdas (`transform`, `filter`, `zip_with`) are left out on purpose: Spark interprets them.
3. What is left is verified: the window's own words are held against the words in the set.
4. Verified hits are gathered by text row. The words that hits cover can be marked, cut out, or their texts dropped.

All of it is DataFrame expressions: no Python, pandas, Arrow or RDD code runs on the executors. Texts themselves are
not shuffled to find hits; rows are, with a few numbers each.

Defined cases. Null text, or one without words: no words, not contaminated. Null item text: no window. Items with equal
texts count each. Empty benchmark: nothing is hit. Repeated text rows, also with the same id: a row each. Null ids are
kept. Extra columns pass through `remove`, also names that steps use inside; `find` does not read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
BROADCAST_WINDOWS = 2_000_000
BROADCAST_TEXTS = 1_000_000
HEAD = 4
_SENTINEL = 0x5EED
#: What separates words, in a lower-cased text and in one as it is.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """The lower-cased words of a text, in order; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, _GAP), "")


def _hash(at: Column, n: Column) -> Column:
    """The hash of the n of `words` from position `at`, which counts from 0; a sentinel where `at` is less."""
    return F.when(at < 0, F.lit(_SENTINEL).cast("long")).otherwise(F.xxhash64(F.slice("words", F.greatest(at, F.lit(0)) + 1, n)))


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct windows of all items: len, gram (their words with a blank between), items (sorted ids as strings)."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    w = w.withColumn("len", F.least(F.size("words"), F.lit(window)))
    w = w.select("item", "len", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"))
    w = w.select("item", "len", F.array_join(F.expr("slice(words, at, len)"), " ").alias("gram"))
    return w.groupBy("len", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, text_hash, text_size, n_words, n_hit, n_items, item_ids (sorted strings), hit_at (positions of hit words from 0)."""
    grams = item_windows(items, window, item_id_col, item_text_col)
    sized = {r["len"]: r["n"] for r in grams.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    lengths = sorted(sized)
    head = F.lit(min([HEAD, *lengths]))
    keyed = grams.withColumn("words", F.split("gram", " ")).select(_hash(F.lit(0), F.col("len")).alias("h"), _hash(F.lit(0), head).alias("head"), "len", "gram", "items")
    sentinel = F.lit(_SENTINEL).cast("long")
    hash_set = keyed.unionByName(docs.sparkSession.range(1).select(sentinel.alias("h"), sentinel.alias("head"), F.lit(0).alias("len")), allowMissingColumns=True)

    text = F.col(text_col).cast("string")
    scan = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("text_size"), words(text).alias("words")).withColumn("_row", F.monotonically_increasing_id())
    narrow = ["_row", "_id", "text_hash", "text_size", "words"]
    last = F.greatest(F.size("words") - lengths[0], F.lit(-1)) if lengths else F.lit(-1)  # where the last of the shortest windows begins
    rows = scan.select(*narrow, F.explode(F.sequence(F.lit(-1), last)).alias("_at"))
    small = sum(sized.values()) <= BROADCAST_WINDOWS
    if small:
        rows = rows.withColumn("head", _hash(F.col("_at"), head)).join(F.broadcast(hash_set.select("head").distinct()), "head", "left_semi").drop("head")
    if len(lengths) <= 1:  # the common case
        rows = rows.withColumn("_len", F.lit(max(lengths, default=0)))
    else:
        rows = rows.withColumn("_len", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(F.when(F.col("_at") < 0, F.col("_len") == lengths[0]).otherwise(F.col("_at") + F.col("_len") <= F.size("words")))
    rows = rows.withColumn("h", _hash(F.col("_at"), F.col("_len"))).withColumn("n_words", F.size("words").cast("long"))
    own_gram = F.array_join(F.slice("words", F.greatest("_at", F.lit(0)) + 1, F.col("_len")), " ")
    if not small:  # a shuffled window takes its own words along, not its text's
        rows = rows.withColumn("_gram", F.when(F.col("_at") >= 0, own_gram)).drop("words")
    hash_set = hash_set.drop("head")
    met = rows.join(F.broadcast(hash_set) if small else hash_set, "h")
    true_hit = (F.col("_at") >= 0) & (F.col("len") == F.col("_len")) & ((own_gram if small else F.col("_gram")) == F.col("gram"))
    checked = met.select("_row", "_id", "text_hash", "text_size", "n_words", F.when(true_hit, F.sequence(F.col("_at"), F.col("_at") + F.col("_len") - 1)).alias("span"), F.when(true_hit, F.col("items")).alias("items"))
    # hits of a row are a few a word at most; the words they cover and their items come out as sets
    per_row = checked.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in ("_id", "text_hash", "text_size", "n_words")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("span")))).alias("hit_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    return per_row.select(F.col("_id").alias(id_col), "text_hash", "text_size", "n_words", F.size("hit_at").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "hit_at")


def cut_spans(text: Column, hit_at: Column) -> Column:
    """The text without the words at these positions and what stands between a word before and each of them."""
    word = _GAP_CASED.replace("[", "[^", 1)
    pieces = F.regexp_extract_all(text, F.lit(f"({_GAP_CASED}*{word}+)"), F.lit(1))
    kept = F.filter(pieces, lambda p, i: ~F.array_contains(hit_at, i))
    return F.when(F.size(hit_at) == 0, text).otherwise(F.concat(F.array_join(kept, ""), F.regexp_extract(text, f"({_GAP_CASED}*)$", 1)))


def remove(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """`docs` without contaminated rows, or with spans=True with the hit words cut out of their texts; the columns stay as they are.

    The contaminated texts (hash and size) are written to the shared folder and joined with the texts, so a clean text is
    never moved while there are at most BROADCAST_TEXTS of them, which is counted; beyond that the join shuffles.
    """
    from .runtime import written

    names = docs.columns
    inside = [f"c{i}" for i in range(len(names))]
    own = docs.toDF(*inside)
    text = inside[names.index(text_col)]
    found = find(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), items, window, "id", "text")
    hit = written(found.where("n_hit > 0").groupBy("text_hash", "text_size").agg(F.first("hit_at").alias("hit_at")), "contaminated")
    if hit.count() <= BROADCAST_TEXTS:
        hit = F.broadcast(hit)
    keyed = own.withColumn("text_hash", F.xxhash64(text)).withColumn("text_size", F.octet_length(text))
    if spans:
        out = keyed.join(hit, ["text_hash", "text_size"], "left").withColumn(text, cut_spans(F.col(text), F.coalesce("hit_at", F.array().cast("array<int>"))))
    else:
        out = keyed.join(hit, ["text_hash", "text_size"], "left_anti")
    return out.select(*inside).toDF(*names)
