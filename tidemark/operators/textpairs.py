"""Features of text pairs that don't depend on the order of the two texts, target encoding, and splits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.order import running_totals
from tidemark.session import Stage, require_columns

#: Terms of the two vocabularies; terms of any vocabulary, which is broadcast.
MOST_WORDS, MOST_CHARS, MOST_TERMS = 50_000, 60_000, 1_000_000
#: The names of the features, in their order.
LEXICAL = [
    "token_jaccard", "content_jaccard", "idf_weighted_overlap", "shared_token_count", "min_token_count", "max_token_count", "token_count_ratio", "abs_char_length_diff",
    "min_char_length", "common_prefix_words", "same_leading_word", "same_final_content_word", "digit_overlap", "unique_to_shorter",
]
FEATURES = ["tfidf_word_cosine", "tfidf_char_cosine", *LEXICAL]
ENCODED = ["question_target_enc_min", "question_target_enc_max", "question_seen_count_min", "question_seen_count_max"]


def _texts(pairs: DataFrame) -> DataFrame:
    """Each different text once: h, t, and how often it occurs on either side."""
    both = pairs.select(F.col("question1").alias("t")).unionAll(pairs.select(F.col("question2").alias("t"))).where("t is not null")
    return both.groupBy("t").agg(F.count("*").alias("mult")).withColumn("h", F.unhex(F.md5("t")))


def fit_idf(pairs: DataFrame, grams: Callable[[Column], Column], min_df: int, most: int) -> DataFrame:
    """term, df, idf = ln((1 + n) / (1 + df)) + 1, for the ``most`` most frequent terms (ties: alphabetically) in ``min_df`` or more texts."""
    if not 0 < most <= MOST_TERMS:
        raise ValueError(f"a vocabulary has between 1 and {MOST_TERMS} terms")
    t = _texts(pairs)
    n = t.agg(F.coalesce(F.sum("mult"), F.lit(0)).alias("n_texts"))
    counted = t.select("h", "mult", F.explode(grams(F.col("t"))).alias("term")).groupBy("term", "h", "mult").agg(F.count("*").alias("tf"))
    df = counted.groupBy("term").agg(F.sum("mult").alias("df"), F.sum(F.col("tf") * F.col("mult")).alias("total")).where(F.col("df") >= min_df)
    top = df.orderBy(F.desc("total"), "term").limit(most)
    return top.join(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n_texts")) / (1 + F.col("df"))) + 1).alias("idf"))


def sparse_dots(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Dot products of two columns of sparse vectors (lists of structs k, w, sorted by k), all rows at once. A null list is empty."""
    rows, keys, values = [], [], []
    for x in (a, b):
        size = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
        flat = x.flatten()
        rows.append(np.repeat(np.arange(len(x)), size))
        keys.append(rows[-1] * (1 << 32) + flat.field("k").to_numpy(zero_copy_only=False))
        values.append(flat.field("w").to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(keys[0], keys[1]), max(len(keys[0]) - 1, 0))
    hit = np.flatnonzero(keys[0][at] == keys[1]) if len(keys[0]) else np.zeros(0, np.int64)
    return np.bincount(rows[1][hit], values[0][at[hit]] * values[1][hit], len(a))


def tfidf_cosine(pairs: DataFrame, idf: DataFrame, grams: Callable[[Column], Column]) -> DataFrame:
    """pair_id, cosine of the two texts' vectors of (1 + ln tf) * idf; 0 if one is empty.

    Vectors are made once per different text, as one row of term numbers and weights; pairs are joined with the two vectors,
    not with their entries. The vocabulary is bounded by the fit, so it is numbered and broadcast.
    """
    idf = Stage(idf.select("term", "idf", F.row_number().over(Window.orderBy("term")).alias("k"))).df
    tf = _texts(pairs).select("h", F.explode(grams(F.col("t"))).alias("term")).groupBy("h", "term").agg(F.count("*").alias("tf"))
    v = tf.join(F.broadcast(idf), "term").select("h", "k", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    v = Stage(v.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))).df

    @F.arrow_udf("double")
    def dot(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(sparse_dots(a, b))

    side = lambda k: v.select(F.col("h").alias(f"h{k}"), F.col("x").alias(f"x{k}"), F.col("norm").alias(f"norm{k}"))
    both = pairs.select("pair_id", F.unhex(F.md5("question1")).alias("h1"), F.unhex(F.md5("question2")).alias("h2")).join(side(1), "h1", "left").join(side(2), "h2", "left")
    return both.select("pair_id", F.coalesce(dot("x1", "x2") / (F.col("norm1") * F.col("norm2")), F.lit(0.0)).alias("cosine"))


def lexical_features(pairs: DataFrame, idf: DataFrame) -> DataFrame:
    """pair_id and the 14 features of LEXICAL. A token without an idf counts with the highest."""
    require_columns(pairs, "pair_id", "question1", "question2")
    # one branch more than needed stays off: arrays are made once per row by the projections below
    a = pairs.select("pair_id", F.col("question1").alias("t1"), F.col("question2").alias("t2"), T.tokens(F.col("question1")).alias("k1"), T.tokens(F.col("question2")).alias("k2"))
    a = a.withColumns({"s1": F.array_distinct("k1"), "s2": F.array_distinct("k2"), "c1": T.content(F.col("k1")), "c2": T.content(F.col("k2"))})
    highest = idf.agg(F.max("idf").alias("top"))
    words = a.select("pair_id", F.explode(F.array_union("s1", "s2")).alias("term"), F.array_intersect("s1", "s2").alias("both"))
    got = words.join(F.broadcast(idf.select("term", "idf")), "term", "left").join(F.broadcast(highest)).withColumn("w", F.coalesce("idf", "top"))
    weights = got.groupBy("pair_id").agg(F.sum(F.when(F.array_contains("both", F.col("term")), F.col("w")).otherwise(0.0)).alias("shared"), F.sum("w").alias("union"))
    digits = lambda c: F.filter(F.col(c), lambda x: F.regexp_like(x, F.lit("^[0-9]+$")))
    n1, n2, l1, l2 = F.size("k1"), F.size("k2"), F.length("t1"), F.length("t2")
    first = F.size("c1") <= F.size("c2")
    short, rest = F.when(first, F.col("c1")).otherwise(F.col("c2")), F.when(first, F.col("c2")).otherwise(F.col("c1"))
    last1, last2 = F.array_max("c1"), F.array_max("c2")
    d = lambda c: c.cast("double")
    f = {
        "token_jaccard": T.jaccard(F.col("s1"), F.col("s2")), "content_jaccard": T.jaccard(F.col("c1"), F.col("c2")),
        "idf_weighted_overlap": F.when(F.col("union") > 0, F.col("shared") / F.col("union")).otherwise(0.0),
        "shared_token_count": d(F.size(F.array_intersect("s1", "s2"))), "min_token_count": d(F.least(n1, n2)), "max_token_count": d(F.greatest(n1, n2)),
        "token_count_ratio": F.least(n1, n2) / F.greatest(n1, n2, F.lit(1)), "abs_char_length_diff": d(F.abs(l1 - l2)), "min_char_length": d(F.least(l1, l2)),
        "common_prefix_words": d(T.common_prefix(F.col("k1"), F.col("k2"))),
        "same_leading_word": d(F.coalesce(F.try_element_at("k1", F.lit(1)) == F.try_element_at("k2", F.lit(1)), F.lit(False))),
        "same_final_content_word": d(F.coalesce(last1 == last2, F.lit(False))),
        "digit_overlap": T.jaccard(digits("s1"), digits("s2")), "unique_to_shorter": F.size(F.array_except(short, rest)) / F.greatest(F.size(short), F.lit(1)),
    }
    return a.join(weights, "pair_id", "left").select("pair_id", *(f[n].alias(n) for n in LEXICAL))


class PairFeaturizer:
    """Fits vocabularies on one set of pairs and gives the 16 features of any other."""

    def __init__(self, most_words: int = MOST_WORDS, most_chars: int = MOST_CHARS):
        self.most_words, self.most_chars = most_words, most_chars
        self.word_idf: DataFrame | None = None
        self.char_idf: DataFrame | None = None

    def fit(self, pairs: DataFrame) -> PairFeaturizer:
        self.word_idf = Stage(fit_idf(pairs, T.word_grams, 2, self.most_words)).df
        self.char_idf = Stage(fit_idf(pairs, T.char_grams, 3, self.most_chars)).df
        return self

    def transform(self, pairs: DataFrame) -> DataFrame:
        if self.word_idf is None:
            raise RuntimeError("transform before fit")
        words = tfidf_cosine(pairs, self.word_idf, T.word_grams).withColumnRenamed("cosine", FEATURES[0])
        chars = tfidf_cosine(pairs, self.char_idf, T.char_grams).withColumnRenamed("cosine", FEATURES[1])
        return words.join(chars, "pair_id").join(lexical_features(pairs, self.word_idf), "pair_id").select("pair_id", *FEATURES)


class TargetEncoder:
    """Mean label of each question text, drawn towards the overall mean by ``smoothing`` rows; a text counts once per side."""

    def __init__(self, smoothing: float = 5.0):
        self.smoothing = smoothing
        self.stats: DataFrame | None = None
        self.prior: float = 0.0

    def fit(self, pairs: DataFrame, label: str = "is_duplicate") -> TargetEncoder:
        sides = [pairs.select(F.md5(q).alias("h"), F.col(label).cast("double").alias("y")) for q in ("question1", "question2")]
        self.prior = float(pairs.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)
        g = sides[0].unionAll(sides[1]).where("h is not null and y is not null").groupBy("h").agg(F.sum("y").alias("s"), F.count("*").alias("seen"))
        self.stats = Stage(g.select("h", ((F.col("s") + self.smoothing * self.prior) / (F.col("seen") + self.smoothing)).alias("enc"), "seen")).df
        return self

    def transform(self, pairs: DataFrame) -> DataFrame:
        if self.stats is None:
            raise RuntimeError("transform before fit")
        p = pairs.select("pair_id", F.md5("question1").alias("h1"), F.md5("question2").alias("h2"))
        for k in ("1", "2"):
            p = p.join(self.stats.select(F.col("h").alias(f"h{k}"), F.col("enc").alias(f"e{k}"), F.col("seen").alias(f"n{k}")), f"h{k}", "left")
        e1, e2 = (F.coalesce(f"e{k}", F.lit(self.prior)) for k in "12")
        n1, n2 = (F.coalesce(f"n{k}", F.lit(0)) for k in "12")
        return p.select("pair_id", F.least(e1, e2).alias(ENCODED[0]), F.greatest(e1, e2).alias(ENCODED[1]), F.least(n1, n2).alias(ENCODED[2]), F.greatest(n1, n2).alias(ENCODED[3]))

    def unseen_share(self, pairs: DataFrame) -> DataFrame:
        """Share of question places whose text the fit hasn't seen. One row."""
        if self.stats is None:
            raise RuntimeError("unseen_share before fit")
        q = pairs.select(F.explode(F.array(F.md5("question1"), F.md5("question2"))).alias("h"))
        return q.join(self.stats.select("h", "seen"), "h", "left").agg(F.avg(F.col("seen").isNull().cast("double")).alias("unseen_share"))


def random_pair_split(pairs: DataFrame, test_size: float = 0.25, seed: int = 0, key: Column | None = None) -> DataFrame:
    """Adds part: test where the key (by default a hash of pair_id, from 0 to 999999) lies below ``test_size``, else train."""
    at = key if key is not None else F.pmod(F.xxhash64("pair_id", F.lit(seed)), F.lit(1_000_000))
    return pairs.withColumn("part", F.when(at < int(test_size * 1_000_000), "test").otherwise("train"))


def cluster_disjoint_split(pairs: DataFrame, test_size: float = 0.25, seed: int = 0, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds part: test if both clusters are among the drawn ones, train if neither is, null (dropped) otherwise.

    Drawn: the round(C * test_size), at least 1, of the C clusters with the smallest key (by default a hash).
    """
    require_columns(pairs, "cluster1", "cluster2")
    key = key or (lambda c: F.xxhash64(c, F.lit(seed)))
    c = pairs.select(F.explode(F.array("cluster1", "cluster2")).alias("c")).where("c is not null").distinct()
    n = c.count()
    drawn = running_totals(c.withColumn("k", key(F.col("c"))), [F.asc("k"), F.asc("c")], {"place": F.lit(1).cast("bigint")})
    drawn = Stage(drawn.where(F.col("place") <= max(1, round(n * test_size))).select("c")).df
    for k in ("1", "2"):
        pairs = pairs.join(drawn.select(F.col("c").alias(f"cluster{k}"), F.lit(1).alias(f"__in{k}")), f"cluster{k}", "left")
    i1, i2 = F.coalesce("__in1", F.lit(0)), F.coalesce("__in2", F.lit(0))
    known = F.col("cluster1").isNotNull() & F.col("cluster2").isNotNull()
    return pairs.withColumn("part", F.when(known & (i1 + i2 == 2), "test").when(known & (i1 + i2 == 0), "train")).drop("__in1", "__in2")


def rebalance(pairs: DataFrame, rate: float, key: Column) -> DataFrame:
    """Keeps all negatives and as many positives (smallest key first, then pair_id) as give ``rate``, at least one, never more than there are."""
    counts = {r.y: r.n for r in pairs.groupBy((F.col("is_duplicate") == 1).alias("y")).agg(F.count("*").alias("n")).collect()}
    pos, neg = counts.get(True, 0), counts.get(False, 0)
    keep = min(pos, max(1, round(neg * rate / (1 - rate)))) if rate < 1 else pos
    if keep == pos:
        return pairs
    good = running_totals(pairs.where("is_duplicate = 1").withColumn("__k", key), [F.asc("__k"), F.asc("pair_id")], {"__place": F.lit(1).cast("bigint")})
    return good.where(F.col("__place") <= keep).drop("__k", "__place").unionByName(pairs.where("is_duplicate <> 1"))


def split_report(split: DataFrame) -> DataFrame:
    """part (dropped for null), n, share and duplicate rate."""
    whole = split.agg(F.count("*").alias("all"))
    g = split.groupBy(F.coalesce("part", F.lit("dropped")).alias("part")).agg(F.count("*").alias("n"), F.avg("is_duplicate").alias("duplicate_rate"))
    return g.join(F.broadcast(whole)).select("part", "n", (F.col("n") / F.col("all")).alias("share"), "duplicate_rate")


def question_overlap(split: DataFrame) -> DataFrame:
    """Question texts that stand in train and in test."""
    side = lambda p: split.where(F.col("part") == p).select(F.explode(F.array("question1", "question2")).alias("question"))
    return side("train").intersect(side("test"))


def assert_no_question_overlap(split: DataFrame) -> None:
    if found := question_overlap(split).orderBy("question").limit(3).collect():
        raise AssertionError(f"questions in train and test: {[r.question for r in found]}")


def slot_neighbours(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """For each different (a, b, c) the values that, put in place of one of the three, give another existing triple.

    Output: a, b, c, other_a, other_b, other_c (sorted arrays), n_neighbours. No pairs of rows are made.
    """
    t = df.select(a, b, c).dropna().distinct()
    out = t
    for x, rest in ((a, (b, c)), (b, (a, c)), (c, (a, b))):
        out = out.join(t.groupBy(*rest).agg(F.collect_set(x).alias(f"other_{x}")), list(rest))
    own = {x: F.array_sort(F.array_except(f"other_{x}", F.array(x))).alias(f"other_{x}") for x in (a, b, c)}
    out = out.select(a, b, c, *own.values())
    return out.withColumn("n_neighbours", sum((F.size(f"other_{x}") for x in (b, c)), F.size(f"other_{a}")))


def component_summary(edges: DataFrame, u: str, v: str) -> DataFrame:
    """n_components, n_nodes and share of the largest, of the undirected graph. One row.

    Labels sink to the smallest neighbour's and then to their label's label, written to the shared folder each round, until
    nothing changes. Nodes go by a digest of 16 bytes, however long their names are.
    """
    name = lambda c: F.unhex(F.md5(F.col(c).cast("string")))
    e = edges.select(name(u).alias("u"), name(v).alias("v")).dropna().distinct()
    e = Stage(e.unionAll(e.select("v", "u")).distinct()).df
    state = Stage(e.select(F.col("u").alias("n")).distinct().withColumn("l", F.col("n")))
    while True:
        near = e.join(state.df.select(F.col("n").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        sunk = state.df.join(near.withColumnRenamed("u", "n"), "n", "left").select("n", "l", F.least("l", "m").alias("m"))
        mid = Stage(sunk)
        up = mid.df.select(F.col("n").alias("m"), F.col("m").alias("mm"))
        after = Stage(mid.df.join(up, "m", "left").select("n", F.least("m", "mm").alias("l"), F.col("l").alias("old")))
        changed = not after.df.where("l <> old").isEmpty()
        for x in (state, mid):
            x.drop()
        state = after
        if not changed:
            break
    g = state.df.groupBy("l").agg(F.count("*").alias("c"))
    return g.agg(F.count("*").alias("n_components"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_nodes"), (F.max("c") / F.sum("c")).alias("largest_share"))
