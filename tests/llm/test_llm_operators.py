"""Training-data operators against brute force, with dirty input: nulls, ties, copies, empty and very long texts, empty tables, clashing names."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, cooccur, leaks, overlap, packing, pairs, queries, subjects, topn
from tidemark.session import Stage


def groups_of(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# problem 3


def test_top_n(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *range(300)]), rng.choice([None, 0, 1, 5, 5, 9, -3])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "user int, thing int, pts int").selectExpr("*", "1 as g", "2 as i", "3 as s", "4 as cell", "5 as rank")
    for heavy in (2, 100_000):
        got = defaultdict(list)
        for r in topn.top_n(df, "user", "thing", "pts", 7, most_heavy=heavy).orderBy("rank").collect():
            got[r.user].append((r.thing, r.pts))
        for u in {x for x, _, _ in rows}:
            mine = [(i, s) for x, i, s in rows if x == u]
            mine.sort(key=lambda x: (x[1] is None, -(x[1] or 0), x[0] is None, x[0] or 0))
            assert got[u] == mine[:7]
    assert topn.top_n(df.limit(0), "user", "thing", "pts", 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "user", "thing", "pts", 0)


def test_score_cells_never_fall(spark):
    xs = sorted([-1e300, -5.0, -1.0, -1e-9, 0.0, 1e-9, 0.5, 1.0, 2.0, 1e9, 1e300, float("inf")])
    cells = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(topn.score_cell(F.col("x"))).collect()]
    assert cells == sorted(cells)


# problems 5 and 6


@pytest.mark.parametrize("algorithm", [components.min_label_components, components.star_components])
def test_components(spark, algorithm):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, 1001 + k) for k in range(200)] + [(2000 + k, 2001 + k) for k in range(120)] + [(5, 5), (5000, 5000)]
    rng.shuffle(edges)
    nodes = {x for e in edges for x in e}
    df = spark.createDataFrame([*edges, *edges[:40], (None, 3), (4, None)], "u bigint, v bigint").withColumn("m", F.lit(1))
    got = {r.node: r.component for r in algorithm(df).collect()}
    assert got == groups_of(edges, nodes)
    assert algorithm(df.limit(0)).count() == 0
    named = algorithm(spark.createDataFrame([("b", "c"), ("c", "a")], "x string, y string"), "x", "y")
    assert {tuple(r) for r in named.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def question_rows(seed, n=250):
    rng = random.Random(seed)
    texts = [f"Text  {k}" for k in range(120)] + [" text 1 ", "TEXT\n2", "", None]
    return [(k, rng.choice(texts[:90] if k % 3 else texts), rng.choice(texts), rng.choice([0, 0, 0, 1, None]), rng.choice(["train", " Test", "validation", None, ""])) for k in range(n)]


def clean(t):
    return None if t is None else re.sub(r"\s+", " ", t.lower()).strip(" ")


def test_match_groups(spark):
    rows = [r for r in question_rows(3) if r[3] == 1]
    df = spark.createDataFrame(rows, "id int, q1 string, q2 string, y int, split string").selectExpr("*", "1 as r", "2 as u", "3 as node", "4 as component")
    edges = [(a if a is not None else b, b if b is not None else a) for a, b in ((clean(r[1]), clean(r[2])) for r in rows) if a is not None or b is not None]
    g = groups_of(edges, {x for e in edges for x in e})
    by = defaultdict(list)
    for r in rows:
        t = clean(r[1]) if r[1] is not None else clean(r[2])
        by[g[t] if t is not None else ("alone", r[0])].append(r[0])
    want = {i: (min(ids), len(ids)) for ids in by.values() for i in ids}
    got = {r.id: (r.group_id, r.n_records) for r in pairs.match_groups(df.unionByName(df.limit(9)), "id", "q1", "q2").collect()}
    assert got == want
    assert pairs.match_groups(df.limit(0), "id", "q1", "q2").count() == 0


def test_split_leaks(spark):
    rows = question_rows(4)
    df = spark.createDataFrame(rows, "id int, q1 string, q2 string, y int, split string")
    edges = [(clean(a), clean(b)) for _, a, b, y, _ in rows if y == 1 and a is not None and b is not None]
    texts = {clean(t) for r in rows for t in r[1:3] if t is not None}
    g = groups_of(edges, texts)
    at = defaultdict(set)
    name = lambda s: (s or "").strip().lower() or None
    for _, a, b, _, s in rows:
        for t in (a, b):
            if t is not None and name(s):
                at[g[clean(t)]].add(name(s))
    want = {r[0] for r in rows if name(r[4]) and any(t is not None and len(at[g[clean(t)]]) > 1 for t in r[1:3])}
    got = [r.id for r in pairs.split_leaks(df, "id", "q1", "q2", F.col("y") == 1, "split").collect()]
    assert set(got) == want and len(got) == len(want)


def test_assigned_splits_keep_entities_together(spark):
    rng = random.Random(5)
    rows = [(k, f"a{rng.randrange(4000)}", rng.choice([None, f"s{rng.randrange(4000)}"])) for k in range(3000)] + [(9000 + k, "hub", None) for k in range(500)] + [(9999, None, None)]
    df = spark.createDataFrame(rows, "id bigint, author string, source string").withColumn("component", F.lit(0)).withColumn("split", F.lit("x"))
    got = {r.id: r.split for r in components.assign_splits(df, "id", ["author", "source"]).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in (1, 2):
        seen = defaultdict(set)
        for r in rows:
            if r[c]:
                seen[r[c]].add(got[r[0]])
        assert all(len(s) == 1 for s in seen.values())
    share = Counter(s for i, s in got.items() if i < 9000)
    assert abs(share["train"] / 3000 - 0.8) < 0.1
    assert components.assign_splits(df.limit(0), "id", ["author"]).count() == 0
    with pytest.raises(ValueError):
        components.split_of(F.col("x"), (("a", 0.5),))


# problem 4


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slip(rng, t, n):
    for _ in range(n):
        k, c = rng.randrange(len(t) + 1), rng.choice("abcöx1 -")
        t = rng.choice([t[:k] + c + t[k:], t[:k] + t[k + 1 :], t[:k] + c + t[k + 1 :]])
    return t


@pytest.mark.parametrize("hot", [0, 40, 2048])
def test_near_texts_lose_no_pair(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT", hot)
    monkeypatch.setattr(overlap, "SLICE", 200)
    rng = random.Random(6)
    base = ["".join(rng.choice("aaabcd") for _ in range(rng.choice([0, 1, 3, 8, 10, 11, 12, 13, 14, 20, 40]))) for _ in range(120)] + ["aaaaaaaaaaaaaaaaaaaaaaaa"]
    texts = sorted({slip(rng, rng.choice(base), rng.randrange(4)) for _ in range(500)} | set(base))
    rows = [(k, t, rng.random() < 0.6, rng.random() < 0.6) for k, t in enumerate(texts)] + [(10_000, "z" * 30_000, True, False), (10_001, "z" * 30_001, False, True)]
    got = {tuple(r) for r in overlap.near_text_pairs(spark.createDataFrame(rows, "id bigint, t string, in_train boolean, in_eval boolean")).collect()}
    want = {(a[0], b[0]) for a in rows[:-2] if a[2] for b in rows[:-2] if b[3] and abs(len(a[1]) - len(b[1])) <= 2 and edit_distance(a[1], b[1]) <= 2}
    assert got == want | {(10_000, 10_001)}


def test_split_overlaps(spark):
    rng = random.Random(7)
    base = ["How do I clean the printer?", "Can I paint a door lock", "ok", "Waß ist — das", "x" * 15]
    rows = [(k, slip(rng, rng.choice(base), rng.randrange(3)), slip(rng, rng.choice(base), rng.randrange(3)), rng.choice(["train", "Train ", "test", "validation", None])) for k in range(160)]
    rows += [(900, None, "a", "train"), (901, "a", None, "test"), (902, "", "", "train"), (903, "!", "?", "test")]
    df = spark.createDataFrame(rows, "id int, q1 string, q2 string, split string").selectExpr("*", "1 as r", "2 as a", "3 as s")
    bare = lambda t: "".join(c for c in t.lower() if c.isalnum())
    near = lambda a, b: edit_distance(bare(a), bare(b)) <= 2
    split = lambda r: (r[3] or "").strip().lower()
    full = [r for r in rows if r[1] is not None and r[2] is not None]
    want = {
        (t[0], e[0], split(e))
        for t in full if split(t) == "train" for e in full if split(e) in ("test", "validation")
        if (near(t[1], e[1]) and near(t[2], e[2])) or (near(t[1], e[2]) and near(t[2], e[1]))
    }
    got = overlap.split_overlaps(df, "id", "q1", "q2", "split").record_pairs().collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) > 20
    hits = overlap.split_overlaps(df, "id", "q1", "q2", "split").hit_records().collect()
    assert {(r.record, r.split) for r in hits} == {(e, s) for _, e, s in want} and len(hits) == len({e for _, e, _ in want})
    assert overlap.split_overlaps(df.limit(0), "id", "q1", "q2", "split").record_pairs().count() == 0


# problem 7


@pytest.mark.parametrize("tile", [1500, 8])
def test_co_occurrence_counts(spark, monkeypatch, tile):
    monkeypatch.setattr(cooccur, "TILE", tile)
    rng = random.Random(8)
    rows = [(u, rng.choice([None, 1, 2]), rng.choice([None, *([0] * 5), *range(40)])) for u in range(60) for _ in range(12)] + [(999, 1, i) for i in range(150)]
    df = spark.createDataFrame([*rows, *rows[:50]], "user int, day int, item int").selectExpr("*", "1 as n", "2 as a", "3 as tile", "4 as b0")
    baskets = defaultdict(set)
    for u, d, i in rows:
        if d is not None and i is not None:
            baskets[u, d].add(i)
    one, two = Counter(i for b in baskets.values() for i in b), Counter(p for b in baskets.values() for p in itertools.combinations(sorted(b), 2))
    got = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, r.n_baskets) for r in cooccur.co_occurrence(df, ["user", "day"], "item", 5, Fraction(1, 50)).collect()}
    least = max(5, math.ceil(len(baskets) / 50))
    assert got == {(a, b): (one[a], one[b], n, len(baskets)) for (a, b), n in two.items() if n >= least} and got
    assert cooccur.co_occurrence(df.limit(0), ["user", "day"], "item").count() == 0


def test_null_model_honours_degrees():
    deg, deg_n, size, size_n = np.array([3.0, 40.0, 200.0]), np.array([50.0, 10.0, 2.0]), np.array([1.0, 2.0, 9.0]), np.array([300.0, 125.0, 44.4444])
    size_n[2] = (deg @ deg_n - size[:2] @ size_n[:2]) / size[2]
    x, y = cooccur.fit_null(deg, deg_n, size, size_n)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ size_n, deg, rtol=1e-6) and np.allclose(deg_n @ p, size, rtol=1e-6)


def test_poisson_binomial_tail():
    q, m = np.array([[0.02, 0.3, 0.7]]), np.array([200.0, 30.0, 5.0])
    pmf = np.array([1.0])
    for p, k in zip(q[0], m, strict=True):
        for _ in range(int(k)):
            pmf = np.convolve(pmf, [1 - p, p])
    for n in (5, 12, 17, 20, 30, 60):
        assert cooccur.poisson_binomial_log_tail(np.array([n]), q, m)[0] == pytest.approx(math.log(pmf[n:].sum()), rel=0.02, abs=0.03)


def test_planted_pairs_are_significant_and_others_not(spark):
    rng = np.random.default_rng(9)
    rows = []
    for b in range(1500):
        items = set(np.flatnonzero(rng.random(40) < 0.08).tolist())
        if rng.random() < 0.05:
            items |= {100, 101}
        rows += [(b, int(i)) for i in items]
    got = cooccur.co_occurrence(spark.createDataFrame(rows, "b int, i int"), ["b"], "i", 3).collect()
    found = {(r.item_a, r.item_b) for r in got if r.significant}
    assert (100, 101) in found and len(found) <= 3


def test_rare_pairs_come_out(spark, tmp_path):
    """Pairs below p7_found's share of the baskets: here 6 and 1 of 2,006."""
    rows = [(u, 1 + u % 3) for u in range(2000)] + [(u, i) for u in range(2000, 2006) for i in (101, 102)] + [(2000, 7)]
    spark.createDataFrame(rows, "user_id bigint, item_id bigint").selectExpr("*", "timestamp_ntz '2024-01-05 10:00:00' as timestamp").write.parquet(f"{tmp_path}/interactions.parquet")
    for name in ("p7_all_pairs", "p7_surprise"):
        got = {(r.item_a, r.item_b): r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert {k: (r.n_a, r.n_b, r.n_ab, r.n_baskets) for k, r in got.items()} == {(101, 102): (6, 6, 6, 2006), (7, 101): (1, 6, 1, 2006), (7, 102): (1, 6, 1, 2006)}
    assert got[101, 102].significant


# problem 8


def test_word_punct_tokens(spark):
    texts = ["a b", "foo_1, bar!!\tx", "", None, "  \n ", "é—é a", "x" * 200_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(packing.word_punct_tokens("t")).collect()]
    assert got == [len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\v\f\r]+", t or "")) for t in texts]


def test_choice_comes_closest():
    rng = random.Random(10)
    for _ in range(200):
        left = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(0, 60)
        slack = rng.choice([0, 0, 3])
        uses = packing._choose(sorted(left, reverse=True), left, room, slack)
        best = max(s for c in itertools.product(*(range(n + 1) for n in left.values())) if (s := sum(a * b for a, b in zip(c, left, strict=True))) <= room)
        got = sum(s * u for s, u in uses.items())
        assert got <= room and (got == best or slack and got >= room - slack) and all(u <= left[s] for s, u in uses.items())


def test_pack(spark):
    rng = random.Random(11)
    rows = [(k, rng.choice([None, 0, 3, 3, 3, 7, 50, 99, 100, 101, 250, rng.randrange(1, 300)])) for k in range(1500)]
    df = spark.createDataFrame([*rows, *rows[:20]], "id int, n int").selectExpr("id", "n", "1 as size", "2 as piece", "3 as chunk").repartition(5)
    out = packing.pack(df, "id", "n", 100).collect()
    fill, tokens = Counter(), Counter()
    for r in out:
        assert 0 <= r.tokens <= 100 and r.first_token == 100 * r.piece
        tokens[r.id] += r.tokens
        if r.container_id is None:
            assert r.tokens == 0
        else:
            fill[r.container_id] += r.tokens
    copies = Counter(i for i, _ in [*rows, *rows[:20]])
    assert all(tokens[i] == copies[i] * (n or 0) for i, n in rows)
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    whole = [r for r in out if r.piece == 0 and r.tokens]
    assert all(r.tokens == min(n or 0, 100) for r in whole for i, n in rows if i == r.id)
    report = packing.fill_report(packing.pack(df, "id", "n", 100), 100).first()
    assert report.n_containers == len(fill) and report.unused_share < 0.05
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "id", "n", 0)


def test_pack_faults_and_large_capacity(spark):
    rng = random.Random(21)
    capacity = 5 * packing.MOST_LENGTHS - 3
    df = spark.createDataFrame([(k, rng.choice([0, 1, capacity, capacity + 1, 3 * capacity, rng.randrange(1, 20_000)])) for k in range(400)], "id int, n int")
    packed = Stage(packing.pack(df, "id", "n", capacity)).df
    faults = lambda p: packing.packing_faults(p, df, "id", "n", capacity).first()
    good = faults(packed)
    assert good.n_over == good.n_wrong == 0 and good.is_tight and good.n_items == df.where("n > 0").count()
    assert faults(packed.withColumn("container_id", packed.container_id % 7)).n_over == 7
    assert faults(packed.where("piece = 0")).n_wrong == df.where(f"n > {capacity}").count()
    assert not faults(packed.withColumn("container_id", packed.container_id * 2 + packed.id % 2)).is_tight


# problem 9


def words_of(t):
    return re.findall("[a-z0-9]+", re.sub(r"\\[A-Za-z]+", "", t).lower())


def test_words_equal_the_regular_expression():
    rng = random.Random(12)
    texts = ["".join(rng.choice(["a", "B", "9", " ", "\\", "\\foo", "é", "\n", "-", "{", "K", "İ", "\\\\x", "\0"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    h, of = leaks.Words()(bytes([255]).join(t.encode() for t in texts))
    want = [(k, w) for k, t in enumerate(texts) for w in words_of(t)]
    assert of.tolist() == [k for k, _ in want]
    by = {}
    for x, (_, w) in zip(h.tolist(), want, strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    long = "ab \\cd ef-" * 400_000
    got = leaks._long_words(leaks.Words(), long.encode())
    assert len(got) == len(words_of(long)) and len(set(got.tolist())) == 2


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(3000))
    items = [[word() for _ in range(rng.choice([5, 13, 30, 60]))] for _ in range(25)]
    docs = []
    for _ in range(120):
        d = [word() for _ in range(rng.randrange(0, 400))]
        for _ in range(rng.randrange(3)):
            it = rng.choice(items)
            a, n, at = rng.randrange(len(it)), rng.randrange(1, 40), rng.randrange(len(d) + 1)
            d[at:at] = it[a : a + n]
        docs.append(d)
    return items, docs


@pytest.mark.parametrize("bits", [27, 12])
def test_leaks_are_all_found(spark, monkeypatch, bits):
    items, docs = corpus(13)
    texts = [(k, ", ".join(w.upper() if k % 2 else w for w in d)) for k, d in enumerate(docs)] + [(900, None), (901, ""), (None, " ".join(items[1]))]
    texts += [(902, "filler " * 400_000 + " ".join(items[3]) + " filler" * 10)] if len(items[3]) >= 13 else []
    df = spark.createDataFrame(texts, "id bigint, t string").selectExpr("id", "t", "1 as pos", "2 as key")
    held = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(99, None)], "id bigint, t string")
    grams = lambda d: {tuple(d[i : i + 13]) for i in range(len(d) - 12)}
    want = {(k, j) for k, t in texts if t and k is not None for j, i in enumerate(items) if grams(words_of(t)) & grams(i)}
    # several passes over the corpus, filters of bounded size
    monkeypatch.setattr(leaks, "MOST_BITS", bits)
    found = leaks.leaked_windows(df, "id", "t", held, "id", "t").where("edits = 0").collect()
    assert {(r.id, r.held_id) for r in found if r.n_words == 13} == want and len(want) > 10
    short = {(k, j) for k, t in texts if t and k is not None for j, i in enumerate(items) if 5 <= len(i) < 13 and f" {' '.join(i)} " in f" {' '.join(words_of(t))} "}
    assert {(r.id, r.held_id) for r in found if r.n_words < 13} == short and short
    assert leaks.leaked_windows(df.limit(0), "id", "t", held, "id", "t").count() == 0
    assert leaks.leaked_windows(df, "id", "t", held.limit(0), "id", "t").count() == 0


def test_windows_with_an_edit_are_found_at_the_recall(spark):
    rng = random.Random(14)
    rows, items = [], []
    for k in range(400):
        it = [f"q{rng.randrange(10**6)}" for _ in range(13)]
        d = it.copy()
        at, kind = rng.randrange(13), rng.randrange(3)
        d[at : at + (kind != 1)] = [] if kind == 2 else ["new"]
        items.append((k, " ".join(it)))
        rows.append((k, " ".join(["x1", "x2", *d, "y1", "y2", "y3"])))
    got = leaks.leaked_windows(spark.createDataFrame(rows, "d bigint, t string"), "d", "t", spark.createDataFrame(items, "i bigint, t string"), "i", "t", edits=1, recall=0.95).collect()
    assert all(r.d == r.i for r in got) and len({r.d for r in got}) >= 0.9 * 400


def test_word_edits():
    rng = random.Random(15)
    a = np.array([[rng.randrange(3) for _ in range(6)] for _ in range(50)], np.uint64)
    b = np.array([[rng.randrange(3) for _ in range(6)] for _ in range(50)], np.uint64)
    want = [min(edit_distance(x.tolist(), y.tolist()[:n]) for n in range(7)) for x, y in zip(a, b, strict=True)]
    assert leaks.word_edits(a, b).tolist() == want


def test_filters(spark):
    keys = np.random.default_rng(0).integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2)
    index = spark.createDataFrame([(int(k),) for k in keys[:1000].view(np.int64)], "key bigint").repartition(5)
    cells = leaks._filters(index, leaks._bits(1000))
    assert len(cells[0]) == len(cells[1]) == 1 << 16 >> 3
    assert leaks._passes(cells, keys[:1000]).all() and leaks._passes(cells, keys[1000:]).mean() < 0.001
    assert leaks._bits(10**12) == leaks.MOST_BITS and leaks._bits(0) == 16
    assert pa.array(["a"]).cast(pa.large_binary())[0].as_buffer().to_pybytes() == b"a"


def test_a_recall_out_of_reach_is_an_error():
    assert leaks.walks_for(13, 2, 0.8).tables >= leaks.walks_for(13, 1, 0.8).tables
    with pytest.raises(ValueError, match="less recall"):
        leaks.walks_for(13, 5, 0.99)


def test_two_texts_of_one_held_out_id_both_leak(spark):
    old, new = (" ".join(f"{k}{i}" for i in range(20)) for k in ("old", "new"))
    corpus = spark.createDataFrame([(1, f"so {old} it"), (2, f"so {new} it")], "doc_id bigint, text string")
    held = spark.createDataFrame([(7, old), (7, new), (7, new)], "item_id bigint, held string")
    got = leaks.leaked_windows(corpus, "doc_id", "text", held, "item_id", "held").where("edits = 0").collect()
    assert sorted((r.doc_id, r.held_pos) for r in got) == [(d, p) for d in (1, 2) for p in range(8)]


# problem 10

TERMS = {"sky": ["telescope", "galaxy", "nebula", "orbit", "comet"], "soil": ["basalt", "sediment", "magma", "fault", "quartz"], "law": ["statute", "appeal", "contract", "verdict", "witness"]}


def article(rng, secs):
    out = [r"\documentclass{article}", r"\newcommand{\xq}{" + TERMS[secs[0]][0] + "}", r"\begin{document}", r"\title{x}"]
    other = rng.choice([s for s in TERMS if s not in secs])
    for k, s in enumerate(secs):
        out.append(rf"\section{{Part {k}}}")
        out += [f"The {rng.choice(TERMS[s])} depends on the {rng.choice(TERMS[s])}s in case {rng.randrange(9)}, as the model shows." for _ in range(5)]
        out.append(f"% the {other} {TERMS[other][0]} {TERMS[other][1]} {TERMS[other][2]}")
        out.append(r"\iffalse " + " ".join(TERMS[other]) * 3 + r" \fi")
    return "\n".join([*out, r"\begin{thebibliography}{9} " + " ".join(TERMS[other]) + r"\end{thebibliography}", r"\end{document}"])


def test_sections_of():
    t = "\\newcommand{\\ab}{red fox}\r\n\\begin{document}\r\n\\section{One \\ab{}}\r\nHe saw 5\\% of \\ab. % gone\r\n\\iffalse lost \\section{No} \\fi\r\n\\section*{Two}\r\nend \\end{document} \\section{After}"
    got = subjects.sections_of(t)
    assert [h.split() for h, _ in got] == [["One", "red", "fox", "{}"], ["Two"]]
    assert "gone" not in got[0][1] and "lost" not in got[0][1] and "red fox" in got[0][1] and "end" in got[1][1]
    assert subjects.sections_of("% withdrawn\n") == [] and subjects.sections_of("") == []
    assert subjects.sections_of("\\section{A} text \\iffalse cut off")[0][1].strip() == "text"
    assert subjects.section_words("Stars star \\cite{abc} glass")["star"] == 2


def test_subjects(spark):
    rng = random.Random(16)
    docs, truth = [], {}
    for k in range(150):
        a, b = rng.sample(sorted(TERMS), 2)
        secs = [a] * 8 if k % 4 else [a] * 5 + [b] * 3
        docs.append((k, article(rng, secs)))
        truth[k] = set(secs)
    docs += [(500, None), (501, ""), (502, "% withdrawn"), (None, docs[0][1])]
    labels = [(k, s.upper() if k % 2 else f" {s} ") for k in range(60) for s in truth[k]]
    wrong = [k for k in range(60) if len(truth[k]) == 1][:4]
    labels = [(k, s) for k, s in labels if k not in wrong] + [(k, next(s for s in TERMS if s not in truth[k])) for k in wrong]
    labels += [*labels[:10], (3, "unknown"), (None, "sky"), (4, None)]
    df = spark.createDataFrame(docs, "id bigint, t string").selectExpr("id", "t", "1 as sec", "2 as c0")
    lab = spark.createDataFrame(labels, "id bigint, s string")
    sec = subjects.section_subjects(df, "id", "t", lab, "id", "s", sorted(TERMS))
    got = defaultdict(set)
    for r in subjects.document_subjects(sec, "id").collect():
        got[r.id].add(r.subject)
    assert set(got) == set(truth)
    assert sum(got[k] == truth[k] for k in truth) >= 146
    none = subjects.section_subjects(df, "id", "t", lab.limit(0), "id", "s", sorted(TERMS))
    assert none.where("subject is not null").count() == 0 and none.count() > 0
    assert subjects.section_subjects(df.limit(0), "id", "t", lab, "id", "s", ["a"]).count() == 0
    with pytest.raises(ValueError):
        subjects.section_subjects(df, "id", "t", lab, "id", "s", [])


def test_subjects_links_are_all_that_are_verified(spark):
    rng = random.Random(5)
    one = lambda words: "\\section{x} " + " ".join(words)
    # 40 documents a subject and eight of two subjects with a word of their own
    docs = [(k, one(rng.choices(TERMS[s], k=4))) for k, s in enumerate(sorted(TERMS) * 40)]
    labels = [(k, s) for k, s in enumerate(sorted(TERMS) * 40)]
    docs += [(k, one(["zircon"])) for k in range(200, 208)]
    labels += [(k, s) for k in range(200, 208) for s in ("sky", "soil")]
    docs += [(k, one(rng.choices(sum(TERMS.values(), []), k=6))) for k in range(300, 330)] + [(330, one(["zircon"]))]
    df, lab = spark.createDataFrame(docs, "id bigint, t string"), spark.createDataFrame(labels, "id bigint, s string")
    words = {i: subjects.section_words(t.split("} ")[1]) for i, t in docs}
    n = Counter(i for i, _ in labels)
    rows = [(list(words[i]), s, 1 / n[i]) for i, s in labels]
    info = {r.w: r.info for r in subjects.word_information(spark.createDataFrame(rows, "words array<string>, k string, v double"), 3.0, 0.35).collect()}
    unit = {}
    for i, c in words.items():
        x = {w: math.sqrt(f) * info[w] for w, f in c.items() if w in info}
        unit[i] = {w: v / math.sqrt(sum(y * y for y in x.values())) for w, v in x.items()}
    got = {r.id: r for r in subjects.section_subjects(df, "id", "t", lab, "id", "s", sorted(TERMS), rounds=1).collect()}
    for i in range(300, 331):
        heard = Counter()
        for j, s in labels:
            cosine = sum(v * unit[j].get(w, 0) for w, v in unit[i].items())
            heard[s] += cosine / n[j] if cosine >= 0.05 else 0
        assert heard[got[i].subject] == pytest.approx(max(heard.values()))
        assert got[i].share == pytest.approx(max(heard.values()) / sum(heard.values()))
    # in one block or in many, the same
    whole, blocks = ({r.id: (r.subject, round(r.share, 9)) for r in subjects.section_subjects(df, "id", "t", lab, "id", "s", sorted(TERMS), rounds=2, block=b).collect()} for b in (1 << 22, 300))
    assert whole == blocks and len(whole) == len(docs)


def test_subjects_links_of_settled_documents_are_made_once(spark, monkeypatch):
    rng = random.Random(9)
    codes = sorted(TERMS)
    text = lambda *subs: "".join(f"\\section{{x}} {' '.join(rng.choices(TERMS[s], k=4) + rng.choices(sum(TERMS.values(), []), k=2))}\n" for s in subs)
    # 60 documents of one label, six of two, six of a wrong one, the rest without
    docs = [(k, text(codes[k % 3], codes[k % 3])) for k in range(66)] + [(k, text(codes[k % 3], codes[(k + 1) % 3])) for k in range(66, 100)]
    labels = {k: {k % 3} for k in range(60)} | {k: {(k + 1) % 3} for k in range(60, 66)} | {k: {k % 3, (k + 1) % 3} for k in range(66, 72)}
    df, lab = spark.createDataFrame(docs, "id bigint, t string"), spark.createDataFrame([(i, codes[k]) for i in labels for k in labels[i]], "id bigint, s string")
    words = [(i, j, subjects.section_words(h + "\n" + b)) for i, t in docs for j, (h, b) in enumerate(subjects.sections_of(t))]
    rows = [(list(c), codes[k], 1 / len(labels[i])) for i, _, c in words if i in labels for k in labels[i]]
    info = {r.w: r.info for r in subjects.word_information(spark.createDataFrame(rows, "words array<string>, k string, v double"), 3.0, 0.35).collect()}
    x = np.array([[math.sqrt(c.get(w, 0)) * info[w] for w in sorted(info)] for _, _, c in words])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    of = np.array([i for i, _, _ in words])
    anchors = np.isin(of, list(labels))
    cosine = x @ x[anchors].T
    cosine[(of[:, None] == of[anchors]) | (cosine < 0.05)] = 0
    held = lambda m: np.array([[(k in m.get(i, ())) / max(1, len(m.get(i, ()))) for k in range(3)] for i in of[anchors]])
    # all links, in every round
    state = held(labels)
    told = (cosine @ state)[anchors]
    best = [told[(of[anchors] == i) & told.any(1)].argmax(1).tolist() for i in range(len(docs))]
    trusted = {i: {k for k in ks if 0 < best[i].count(k) >= 0.1 * len(best[i])} for i, ks in labels.items()}
    mask = np.array([[not trusted.get(i) or k in trusted[i] for k in range(3)] for i in of])
    for _ in range(2):
        heard = cosine @ state * mask
        sharp = (heard / np.maximum(heard.sum(1, keepdims=True), 1e-300)) ** 3
        said = cosine.T @ (sharp / np.maximum(sharp.sum(1, keepdims=True), 1e-300)) * mask[anchors]
        state = np.where(said.sum(1, keepdims=True) > 0, said / np.maximum(said.sum(1, keepdims=True), 1e-300), held(trusted))
    heard = cosine @ state * mask
    sizes, real = [], subjects._pass
    monkeypatch.setattr(subjects, "_pass", lambda block, *a: sizes.append(len(block.docs)) or real(block, *a))
    got = {(r.id, r.sec): r for r in subjects.section_subjects(df, "id", "t", lab, "id", "s", codes).collect()}
    assert len(got) == len(words)
    for (i, j, _), h in zip(words, heard, strict=True):
        if h.any():
            assert got[i, j].share == pytest.approx(h.max() / h.sum()) and h[codes.index(got[i, j].subject)] == pytest.approx(h.max())
        else:
            assert got[i, j].subject is None
    settled = sum(i in labels and len(labels[i]) == 1 and trusted[i] == labels[i] for i in of.tolist())
    assert 0 < settled < anchors.sum()
    assert sizes == [anchors.sum(), settled] + [anchors.sum() - settled] * 3
