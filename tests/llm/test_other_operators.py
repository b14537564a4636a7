"""Mixing, sharding, neighbours, URL filters and the pipeline."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import graph, mixing, neighbours, queries, sharding, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture
def odd(spark):
    rows = [(1, "a", "s"), (1, "a", "s"), (None, None, None), (2, "", ""), (None, None, None), (3, "x" * 100_000, "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("position", F.lit(7)).withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1))


def test_pfair_windows_and_places():
    rnd = random.Random(1)
    for _ in range(100):
        n, b = rnd.randint(1, 12), rnd.choice([1, 4, 16])
        rows = [rnd.randint(0, 300) for _ in range(n)]
        p = mixing.Plan.of(rows, [rnd.random() + 0.01 for _ in range(n)], b, rnd.choice([100, 1000]))
        total = sum(p.shares)
        at = sorted((int(x), i, j) for i, r in enumerate(rows) for j, x in enumerate(p.slots(i, np.arange(-(-r // b)))))
        assert len({x for x, _, _ in at}) == len(at)
        before = 0
        for x, i, j in at:
            assert j * total // p.shares[i] <= x < -(-(j + 1) * total // p.shares[i])
            assert p.rows_before(np.array([x]))[0] == before
            before += min(b, rows[i] - j * b)


def test_pfair_deviation_is_under_a_block():
    shares = mixing.quantised([0.5, 0.3, 0.15, 0.05], 997)
    order = sorted((int(x), i) for i, p in enumerate(mixing.period(shares)) for x in p)
    seen = Counter()
    for t, (_, i) in enumerate(order, 1):
        seen[i] += 1
        assert all(abs(seen[j] - t * s / 997) < 1 for j, s in enumerate(shares))


@pytest.mark.parametrize("weights", [[0.5] + [0.5 / 19] * 19, [0.0001, 0.4999, 0.5], [100.0] + [float(w) ** 0.5 for w in range(2, 21)], [0.5, 0.25, 0.25]])
def test_pfair_keeps_to_the_target_weights_over_many_slots(weights):
    n = 60_000
    w = np.array(weights) / sum(weights)
    p = mixing.Plan.of([int(n * x) * 16 + 16 for x in w], weights)
    at = [p.slots(i, np.arange(int(n * x))) for i, x in enumerate(w)]
    assert len(np.unique(np.concatenate(at))) == sum(map(len, at))
    for t in (*range(0, 3_000, 7), *range(3_000, n - 20, 501)):
        seen = np.array([np.searchsorted(a, t) for a in at])
        assert np.abs(seen - t * w).max() < 1 + 1e-9  # t * w is rounded


def test_mixing_weights_of_nothing():
    p = mixing.Plan.of([40, 33, 5, 0], [0.0, 0.7, 0.0, 0.3], 16)
    assert p.slots(0, np.arange(3)).min() > p.slots(1, np.arange(3)).max() and p.slots(2, np.arange(1))[0] > p.slots(0, np.arange(3)).max()
    assert p.rows_before(p.slots(2, np.arange(1)))[0] == 73
    for bad in (-1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            mixing.Plan.of([1, 1], [1.0, bad])


def brute_schedule(rows, weights, block):
    """Slot of every block by trying all sources at every slot, with fractions; the places of a source that has run out stay empty."""
    total = sum(map(Fraction, map(str, weights)))
    w = [Fraction(str(x)) / total for x in weights]
    need, done, out, t = [-(-n // block) for n in rows], [0] * len(rows), {}, 0
    while any(d < n for d, n in zip(done, need)):
        ready = [(math.ceil((done[i] + 1) / w[i]), i) for i in range(len(rows)) if math.floor(done[i] / w[i]) <= t]
        if ready:
            _, i = min(ready)
            out[i, done[i]] = t
            done[i] += 1
        t += 1
    return out


def test_mixing_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 31 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    weights = {"": 0.125, "hot": 3.0, "s0": 0.7, "s1": 1.0, "s2": 0.3}
    rows = mixing.placed(d, weights, block_rows=4).collect()
    names = sorted({r.source for r in rows})
    n = [sum(r.source == s for r in rows) for s in names]
    slots = brute_schedule(n, [weights.get(s, 0.125) for s in names], 4)
    for i, s in enumerate(names):
        assert sorted(r.seq for r in rows if r.source == s) == list(range(n[i]))
    want = {k: p for p, k in enumerate(sorted(((r.source, r.seq) for r in rows), key=lambda k: (slots[names.index(k[0]), k[1] // 4], k[1])))}
    assert all(r.slot == slots[names.index(r.source), r.seq // 4] and r.position == want[r.source, r.seq] for r in rows)


def test_mixing_within_sources_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 31 == 1, F.lit(None)).otherwise("s"))
    d = d.withColumn("kind", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 5 < 3, "a").when(F.col("source") == "hot", "b").otherwise("c"))
    plain = {r.position: r.source for r in mixing.placed(d, block_rows=4).collect()}
    kinds = {r.doc_id: r.kind or "" for r in d.collect()}
    rows = sorted(mixing.placed(d, block_rows=4, within_col="kind").collect(), key=lambda r: r.position)
    assert {r.position: r.source for r in rows} == plain and len(rows) == len(kinds)
    for s in set(plain.values()):
        own = [kinds[r.doc_id] for r in rows if r.source == s]
        assert [r.seq for r in rows if r.source == s] == list(range(len(own)))
        names = sorted(set(own))
        n = [own.count(k) for k in names]
        slots = brute_schedule(n, n, 4)
        assert own == [names[i] for (i, j), _ in sorted(slots.items(), key=lambda x: x[1]) for _ in range(min(4, n[i] - 4 * j))]
    order = [r.doc_id for r in mixing.mixed(d, block_rows=4, within_col="kind").collect()]
    assert order == [r.doc_id for r in rows]


def test_mixing(spark, odd):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.placed(d, block_rows=4).collect()
    assert sorted(r.position for r in rows) == list(range(d.count()))
    at = {r.doc_id: r.position for r in rows}
    order = [at[r.doc_id] for r in mixing.mixed(d, block_rows=4).collect()]
    assert order == sorted(order)
    m = mixing.mixed(odd)
    assert m.columns == odd.columns and Counter(m.select("doc_id", "text").collect()) == Counter(odd.select("doc_id", "text").collect())
    assert mixing.mixed(odd.limit(0)).isEmpty()


def brute_cost(supply, capacity):
    return sum(max(0, s - c) for s, c in zip(supply, [*capacity, *[0] * len(supply)]))


def test_min_cost_flow():
    rnd = random.Random(3)
    for _ in range(50):
        n, m = rnd.randint(1, 6), rnd.randint(1, 6)
        supply = [rnd.randint(0, 100) for _ in range(n)]
        room = sharding.even(sum(supply), m)
        cost = [[0 if i == j else 1 for j in range(m)] for i in range(n)]
        flow = sharding.min_cost_flow(supply, room, cost)
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow)] == room
        assert sum(f * c for fr, cr in zip(flow, cost) for f, c in zip(fr, cr)) == brute_cost(supply, room)


def test_sweep_moves_least_where_cost_grows_with_distance():
    rnd = random.Random(8)
    for _ in range(50):
        n, m = rnd.randint(1, 7), rnd.randint(1, 5)
        supply = [rnd.randint(0, 60) for _ in range(n)]
        room = sharding.even(sum(supply), m)
        cost = [[abs(j - i * m / n) for j in range(m)] for i in range(n)]
        best = sharding.min_cost_flow(supply, room, cost)
        swept = sharding.sweep_flow(supply, room)
        assert [sum(k for _, k in own) for own in swept] == supply
        assert sum(k * cost[i][j] for i, own in enumerate(swept) for j, k in own) == pytest.approx(sum(f * c for fr, cr in zip(best, cost) for f, c in zip(fr, cr)))


def test_bytes_moved_are_those_of_the_flow(spark):
    """Rows carry out the flow of all bytes, but for at most half a row at each cut."""
    d = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet").where("octet_length(text) < 60000")
    rows = sharding.place(d, queries.old_layout(), 8, old_shards=6).collect()
    old, new, moved = Counter(), Counter(), 0
    for r in rows:
        old[r.old_shard] += r["size"]
        new[r.shard] += r["size"]
        moved += r["size"] * (r.shard != r.old_shard)
    total, largest = sum(old.values()), max(r["size"] for r in rows)
    least = brute_cost([old[i] for i in range(6)], sharding.even(total, 8))
    assert largest <= total / (8 * sharding.GIANTS) and abs(moved - least) <= 8 * largest and max(abs(n - total / 8) for n in new.values()) <= largest


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_sharding(spark, law):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.place(d, queries.old_layout(), 8, law, old_shards=6).collect()
    slots, sizes, n = defaultdict(list), Counter(), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        n[r.shard] += 1
    assert len(rows) == d.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows":
        assert max(n.values()) - min(n.values()) <= 1
    else:
        assert max(sizes.values()) < 1.05 * min(sizes.values())


def test_sharding_edges(spark, odd, tmp_path):
    out = sharding.resharded(odd, F.lit(0))
    assert out.columns == [*odd.columns, "shard_", "slot_"] and Counter(out.select("doc_id", "text").collect()) == Counter(odd.select("doc_id", "text").collect())
    assert sharding.resharded(odd.limit(0), F.lit(0)).isEmpty()
    even = spark.range(8).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    assert sharding.rewrite_affected(even, F.col("doc_id"), str(tmp_path / "none"), 8, "rows") == []
    moved = sharding.rewrite_affected(even, F.least("doc_id", F.lit(6)), str(tmp_path / "some"), 8, "rows")
    assert set(moved) == {6, 7} and spark.read.parquet(str(tmp_path / "some")).count() == 2


def test_rewriting_a_layout_that_shrinks(spark, tmp_path):
    d = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    moved = sharding.rewrite_affected(d, (F.col("doc_id") % 16).cast("int"), str(tmp_path / "less"), 8, "rows")
    assert moved == list(range(8))
    out = spark.read.parquet(str(tmp_path / "less"))
    assert sorted(r.doc_id for r in out.collect()) == list(range(64))
    assert {r["count"] for r in out.groupBy("shard").count().collect()} == {8}


def test_neighbours(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in queries.QUERIES["op6_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        best = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:10]
        hit, total = hit + len({v for v, _ in got[ids[i]]} & set(best)), total + len(best)
        at = dict(zip(ids.tolist(), d))
        assert len(got[ids[i]]) == 10 and all(s == pytest.approx(at[v], rel=1e-12) for v, s in got[ids[i]])
    assert hit / total >= 0.9


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [2.0, 0.0]), (7, [2.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0]), (200, [3.0, None])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("x"))
    got = sorted(tuple(r) for r in neighbours.search(d, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 6, 1.0), (0, 3, 7, 1.0), (100, 1, 0, 0.0), (100, 2, 6, 1.0), (100, 3, 7, 1.0)]
    assert neighbours.search(d.limit(0), F.col("vec_id") % 100 == 0).isEmpty()


def test_neighbours_in_a_hot_leaf(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 16)
    d = spark.range(300).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 200, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.col("id") * 1.0, F.lit(0.5))).alias("embedding"))
    got = neighbours.search(d, F.col("vec_id") % 100 == 0).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(10)) and {r.score for r in got} == {0.0}


def test_neighbours_of_outliers_are_complete(spark):
    """Far vectors lie alone in their leaves; their queries go on until they have k candidates."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(1500, 4)), rng.normal(size=(30, 4)) * 40 + 300 * np.arange(30)[:, None]])
    ids = np.concatenate([np.arange(1500) * 7 + 1, 100_000 + 100 * np.arange(30)])
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    n = neighbours.search(d, F.col("vec_id") % 100 == 0, visits=1).groupBy("query_id").count().collect()
    assert {r["count"] for r in n} == {10} and len(n) == int((ids % 100 == 0).sum())


def test_neighbours_of_one_id_with_two_vectors(spark):
    d = spark.createDataFrame([(0, [0.0, 1.0]), (0, [10.0, 1.0]), (0, [10.0, 1.0]), (1, [0.0, 2.0]), (2, [10.0, 3.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.search(d, F.col("vec_id") % 100 == 0, k=1).collect())
    assert got == [(0, 1, 1, 1.0), (0, 1, 2, 2.0)]


def test_url_filter(spark):
    rows = [(1, "https://WWW.Example.org/es/1?x=/de/"), (2, "https://example.org/en/15"), (3, "http://notexample.org/en/15"), (4, "http://a.com/de/x"), (5, "http://a.com/DE/x"), (6, None), (7, "no scheme"), (8, "http://example.org"), (9, "http://x.spam-farm.net/q"), (9, "http://x.spam-farm.net/q"), (10, "http://org/"), (11, "http://a.com#/fr/"), (12, "ftp://b.example.org/" + "y" * 50_000)]
    p = spark.createDataFrame(rows, "page_id long, url string").withColumn("rules", F.lit(1)).withColumn("t", F.lit(""))
    got = sorted((r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in url_filter.judge_urls(p, url_filter.HOST_RULES + url_filter.PATTERN_RULES).collect())
    assert got == [
        (1, "www.example.org", 5, "example.org/es/", "block"), (2, "example.org", 6, "example.org/en/1", "block"), (3, "notexample.org", 6, "org/", "allow"), (4, "a.com", 5, "com/de/", "block"), (5, "a.com", 5, None, "allow"),
        (6, "", 0, None, "allow"), (7, "", 0, None, "allow"), (8, "example.org", 0, None, "allow"), (9, "x.spam-farm.net", 2, None, "block"), (9, "x.spam-farm.net", 2, None, "block"), (10, "org", 1, "org/", "allow"), (11, "a.com", 0, None, "allow"), (12, "b.example.org", 50_001, "org/", "allow")]
    assert url_filter.judge_urls(p.limit(0), url_filter.HOST_RULES).isEmpty() and url_filter.judge_urls(p, []).count() == len(rows)


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    up = {x: x for p in pairs for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1]}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from cairnspark.llm import decontaminate, jaccard_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == (names if k < 4 else [*names, "shard", "slot"])
        ids = {r.doc_id for r in docs.collect()}
        if "Jaccard" in name:
            assert ids == {r.component_id for r in jaccard_join.link_groups(before).collect()}
        elif "benchmark" in name:
            assert ids == {r.doc_id for r in decontaminate.find(before, bench).where("n_hit = 0").collect()}
        else:
            assert ids == {r.doc_id for r in before.collect()}
    sizes = [r[1] for r in docs.groupBy("shard").agg(F.sum(F.octet_length("text") + 1)).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def test_pipeline_mixes_by_the_judged_language(spark, tmp_path):
    """Labels are taken from a fifth of the rows and wrong in some: the language stage sets them right, and the mix spreads its languages."""
    import corpus_pipeline
    from cairnspark.llm import language_id

    truth = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang", "source")
    d = truth.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 97 == 1, "de").otherwise(F.col("lang"))).withColumn("c0", F.lit(7))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    right = {r.doc_id: r.lang for r in truth.collect()}
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.known_language(spark, d, str(tmp_path))
    assert first.schema == d.schema
    assert first._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    judged = {r.doc_id: r.lang for r in first.collect()}
    want = {r.doc_id: r.lang_pred for r in language_id.predict(d, language_id.train(d), {"doc_id": F.col("doc_id")}).collect()}
    assert judged == {i: want[i] for i in judged} and sum(judged[i] != right[i] for i in judged) <= 0.01 * len(right) and len(judged) > 0.99 * len(right)
    # each language stands evenly in the mix of each source, also where labels were missing
    mix = corpus_pipeline.in_mix_order(spark, first, str(tmp_path)).collect()
    assert Counter(map(tuple, mix)) == Counter(map(tuple, first.collect()))
    for source in {r.source for r in mix}:
        own = [r.lang for r in mix if r.source == source]
        for lang in set(own):
            seen = np.cumsum([v == lang for v in own])
            assert np.abs(seen - np.arange(1, len(own) + 1) * seen[-1] / len(own)).max() < 2 * mixing.BLOCK_ROWS
    # the same rows with other languages are laid out otherwise
    other = first.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    assert [r.doc_id for r in corpus_pipeline.in_mix_order(spark, other, str(tmp_path)).collect()] != [r.doc_id for r in mix]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.lang == judged[r.doc_id] and r.c0 == 7 for r in out)


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages over odd rows: nulls, texts without words or letters, repeated and near rows, benchmark passages, clashing names."""
    import corpus_pipeline
    from test_text_operators import brute_groups, brute_hits

    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passage = next(t for _, t in bench if len((t or "").split()) >= 12)
    top = max(r[0] for r in base)
    first, second = base[0], base[1]
    more = [(None, None, None), ("", "en", "s"), (" \n\t", "en", None), ("12 34 !!", "en", "s"), (first[1], first[2], None), (first[1] + " x", first[2], "s"), (second[1] + " " + passage, second[2], "s"), (passage, "en", None)]
    rows = base + [(top + 1 + k, *r) for k, r in enumerate(more)] + [base[5], base[5], (None, base[6][1] + " tail", base[6][2], "s")]
    d = spark.createDataFrame([(*r, 7, "q") for r in rows], "doc_id long, text string, lang string, source string, position int, shard string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # what must stay
    kept = [(i, t) for i, t, _, _ in rows if any(map(str.isalpha, t or ""))]
    group = {}
    for at, (i, n, c) in zip(sorted(range(len(kept)), key=lambda k: str((kept[k][0],))), sorted(brute_groups(kept), key=lambda r: str((r[0],)))):
        group[at] = (i, c)
    firsts = sorted({c for i, c in group.values()})
    assert all(i is not None for i in firsts)
    texts = dict(reversed([(i, t) for i, t in kept if i is not None]))
    want = sorted(i for i, _, n_hit, _ in brute_hits([(i, texts[i]) for i in firsts], bench) if not n_hit)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "position", "shard", "shard_", "slot"]
    got = out.collect()
    assert sorted(r.doc_id for r in got) == want and all(r.text == texts[r.doc_id] and r.position == 7 and r["shard"] == "q" for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard_].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    empty = tmp_path / "none"
    d.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).isEmpty()
