"""Queries over question pairs: tokens, features, target encoding, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import metrics, textpairs
from tidemark.plans.demand_queries import _rounded
from tidemark.plans.txn_queries import _RANK, RANK_SELECT, R
from tidemark.session import Stage, read_table
from tidemark.sources.tables import PAIRS_SQL, pairs

KINDS = ("hard_negative", "random_negative")


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    k1 = T.tokens(F.col("question1"))
    return pairs(spark, d).select("pair_id", F.size(k1).alias("n_tokens"), F.size(T.content(k1)).alias("n_content"), F.length("question1").alias("n_chars"))


def _idf(spark: SparkSession, d: str) -> DataFrame:
    return textpairs.fit_idf(pairs(spark, d), T.word_grams, 2, textpairs.MOST_WORDS)


def idf_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_idf(spark, d))


def tfidf_word_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(textpairs.tfidf_cosine(pairs(spark, d), _idf(spark, d), T.word_grams))


def tfidf_char_cosine(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return _rounded(textpairs.tfidf_cosine(p, textpairs.fit_idf(p, T.char_grams, 3, textpairs.MOST_CHARS), T.char_grams))


def pair_lexical_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(textpairs.lexical_features(pairs(spark, d), Stage(_idf(spark, d)).df))


def pair_features(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return _rounded(textpairs.PairFeaturizer().fit(p.where("split = 'train'")).transform(p))


def _encoder(spark: SparkSession, d: str) -> textpairs.TargetEncoder:
    return textpairs.TargetEncoder().fit(pairs(spark, d).where("split = 'train'"))


def target_encoding(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_encoder(spark, d).transform(pairs(spark, d)))


def unseen_share(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_encoder(spark, d).unseen_share(pairs(spark, d).where("split = 'test'")))


def split_by_pair(spark: SparkSession, d: str) -> DataFrame:
    return textpairs.random_pair_split(pairs(spark, d), 0.25, key=F.pmod(F.col("pair_id") * 7919, F.lit(1000)) * 1000)


def split_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    return textpairs.cluster_disjoint_split(pairs(spark, d), 0.25, key=lambda c: F.pmod(c * 7919, F.lit(10007)))


def random_pair_split(spark: SparkSession, d: str) -> DataFrame:
    return split_by_pair(spark, d).select("pair_id", "part")


def random_pair_split_hashed(spark: SparkSession, d: str) -> DataFrame:
    return textpairs.random_pair_split(pairs(spark, d), 0.25, seed=29).select("pair_id", "part")


def hashed_split_check(spark: SparkSession, d: str) -> DataFrame:
    """The split by hash: all pairs once, the test part near its share (5 standard errors), the same for any order of the rows."""
    one, two = (textpairs.random_pair_split(p, 0.25, seed=29).select("pair_id", "part") for p in (pairs(spark, d), pairs(spark, d).repartition(7)))
    t = one.join(two.withColumnRenamed("part", "again"), "pair_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("part") == "test").alias("n"), F.count_if(F.col("part") != F.col("again")).alias("n_moved"))
    near = F.abs(F.col("n") - 0.25 * F.col("n_pairs")) <= 5 * F.sqrt(F.col("n_pairs") * 0.1875)
    return t.select("n_pairs", "n_moved", near.alias("share_is_near"))


def cluster_disjoint_split(spark: SparkSession, d: str) -> DataFrame:
    return split_by_cluster(spark, d).select("pair_id", "part")


def split_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(textpairs.split_report(split_by_cluster(spark, d)))


def rebalanced_split(spark: SparkSession, d: str) -> DataFrame:
    return textpairs.rebalance(split_by_pair(spark, d).where("part = 'test'"), 0.2, F.pmod(F.col("pair_id") * 7919, F.lit(10007))).select("pair_id", "is_duplicate")


def question_overlap(spark: SparkSession, d: str) -> DataFrame:
    return textpairs.question_overlap(split_by_pair(spark, d))


def hard_negative_neighbours(spark: SparkSession, d: str) -> DataFrame:
    t = textpairs.slot_neighbours(read_table(spark, d, "part"), "p_brand", "p_type", "p_size")
    return t.select("p_brand", "p_type", "p_size", F.size("other_p_brand").alias("n_brand"), F.size("other_p_type").alias("n_type"), F.size("other_p_size").alias("n_size"), "n_neighbours")


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(textpairs.component_summary(pairs(spark, d).where("is_duplicate = 1"), "question1", "question2"))


def duplicates_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and share of duplicates by the number of tokens of the first question."""
    p = pairs(spark, d).groupBy(F.size(T.tokens(F.col("question1"))).alias("n_tokens"))
    return _rounded(p.agg(F.count("*").alias("n"), F.avg("is_duplicate").alias("duplicate_rate")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    score = T.jaccard(F.array_distinct(T.tokens(F.col("question1"))), F.array_distinct(T.tokens(F.col("question2"))))
    return pairs(spark, d).select("pair_id", F.col("is_duplicate").alias("y"), score.alias("score"), "pair_kind")


def metrics_by_pair_kind(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.by_negative_kind(_scored(spark, d), "y", "score", "pair_kind", KINDS))


QUERIES = {
    f.__name__: f
    for f in (
        token_stats, idf_table, tfidf_word_cosine, tfidf_char_cosine, pair_lexical_features, pair_features, target_encoding, unseen_share, random_pair_split,
        random_pair_split_hashed, hashed_split_check, cluster_disjoint_split, split_report, rebalanced_split, question_overlap, hard_negative_neighbours, connected_components, duplicates_by_tokens, metrics_by_pair_kind,
    )
}

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_Q = f"WITH {PAIRS_SQL}"
_BOTH = _Q + ", both_q AS (SELECT question1 AS t FROM pairs UNION ALL SELECT question2 FROM pairs), tx AS (SELECT t, count(*) AS mult FROM both_q GROUP BY 1)"


def _vectors(grams: str, min_df: int, most: int) -> str:
    return (
        _BOTH
        + f""", tf AS (SELECT t, mult, term, count(*) AS tf FROM ({grams}) GROUP BY 1, 2, 3),
idf AS (SELECT term, df, ln((1 + (SELECT sum(mult) FROM tx)) / (1 + df)) + 1 AS idf FROM (SELECT term, CAST(sum(mult) AS BIGINT) AS df, sum(tf * mult) AS total FROM tf GROUP BY 1
  HAVING sum(mult) >= {min_df} ORDER BY total DESC, term LIMIT {most})),
v0 AS (SELECT t, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)), v AS (SELECT t, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM v0),
cos AS (SELECT pair_id, sum(a.w * b.w) AS c FROM pairs JOIN v a ON a.t = question1 JOIN v b ON b.t = question2 AND b.term = a.term GROUP BY 1)"""
    )


def _fitted(name: str, grams: str, min_df: int, most: int) -> str:
    """idf_{name} from the train pairs, and cos_{name} of all pairs with it."""
    return f"""tf_{name} AS (SELECT t, mult, tmult, term, count(*) AS tf FROM ({grams}) GROUP BY 1, 2, 3, 4),
idf_{name} AS (SELECT term, df, ln((1 + (SELECT sum(tmult) FROM tx)) / (1 + df)) + 1 AS idf FROM (SELECT term, CAST(sum(tmult) AS BIGINT) AS df, sum(tf * tmult) AS total FROM tf_{name}
  WHERE tmult > 0 GROUP BY 1 HAVING sum(tmult) >= {min_df} ORDER BY total DESC, term LIMIT {most})),
v0_{name} AS (SELECT t, term, (1 + ln(tf)) * idf AS w FROM tf_{name} JOIN idf_{name} USING (term)), v_{name} AS (SELECT t, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM v0_{name}),
cos_{name} AS (SELECT pair_id, sum(a.w * b.w) AS c_{name} FROM pairs JOIN v_{name} a ON a.t = question1 JOIN v_{name} b ON b.t = question2 AND b.term = a.term GROUP BY 1)"""


_WORDS = r"""SELECT t, mult, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS term FROM (SELECT t, mult, regexp_extract_all(lower(t), '[\p{L}\p{N}_]{2,}') AS w FROM tx)"""
_CHARS = r"""SELECT t, mult, substr(w, CAST(i AS BIGINT), n) AS term FROM (SELECT t, mult, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM (SELECT t, mult, ' ' || x || ' ' AS w, unnest([3, 4, 5]) AS n
  FROM (SELECT t, mult, unnest(list_filter(regexp_split_to_array(lower(t), '\s+'), lambda z: z <> '')) AS x FROM tx)))"""
_COS = f" SELECT pair_id, {R.format('coalesce(c, 0)')} AS cosine FROM pairs LEFT JOIN cos USING (pair_id)"
_JAC = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct({0} || {1})) END"
_LEX_BODY = (
    f""", k AS (SELECT pair_id, question1 AS t1, question2 AS t2, {_TOK.format("question1")} AS k1, {_TOK.format("question2")} AS k2 FROM pairs),
s AS (SELECT *, list_distinct(k1) AS s1, list_distinct(k2) AS s2, list_filter(list_distinct(k1), lambda z: NOT list_contains({_STOP}, z)) AS c1,
  list_filter(list_distinct(k2), lambda z: NOT list_contains({_STOP}, z)) AS c2 FROM k),
u AS (SELECT pair_id, unnest(list_distinct(s1 || s2)) AS term, list_intersect(s1, s2) AS b FROM s),
o AS (SELECT pair_id, sum(CASE WHEN list_contains(b, term) THEN w ELSE 0.0 END) AS shared, sum(w) AS uni FROM
  (SELECT pair_id, term, b, coalesce(idf, (SELECT max(idf) FROM idf)) AS w FROM u LEFT JOIN idf USING (term)) GROUP BY 1),
x AS (SELECT *, list_filter(s1, lambda z: regexp_full_match(z, '[0-9]+')) AS d1, list_filter(s2, lambda z: regexp_full_match(z, '[0-9]+')) AS d2,
  CASE WHEN len(c1) <= len(c2) THEN c1 ELSE c2 END AS sh, CASE WHEN len(c1) <= len(c2) THEN c2 ELSE c1 END AS lo,
  [k1[i] = k2[i] for i in range(1, least(len(k1), len(k2)) + 1)] AS eq FROM s LEFT JOIN o USING (pair_id))
"""
)
_LEX = _vectors(_WORDS, 2, textpairs.MOST_WORDS) + _LEX_BODY + "SELECT pair_id, "
_TRAIN_TEXTS = (
    _Q
    + """, both_q AS (SELECT question1 AS t, split FROM pairs UNION ALL SELECT question2, split FROM pairs),
tx AS (SELECT t, count(*) AS mult, count(*) FILTER (WHERE split = 'train') AS tmult FROM both_q GROUP BY 1), """
)
_WITH_TRAIN = (
    _TRAIN_TEXTS + _fitted("word", _WORDS.replace("t, mult", "t, mult, tmult"), 2, textpairs.MOST_WORDS) + ", " + _fitted("char", _CHARS.replace("t, mult", "t, mult, tmult"), 3, textpairs.MOST_CHARS)
    + ", idf AS (SELECT * FROM idf_word)" + _LEX_BODY
)
_LEX_COLS = {
    "token_jaccard": _JAC.format("s1", "s2"), "content_jaccard": _JAC.format("c1", "c2"), "idf_weighted_overlap": "CASE WHEN uni > 0 THEN shared / uni ELSE 0.0 END",
    "shared_token_count": "CAST(len(list_intersect(s1, s2)) AS DOUBLE)", "min_token_count": "CAST(least(len(k1), len(k2)) AS DOUBLE)", "max_token_count": "CAST(greatest(len(k1), len(k2)) AS DOUBLE)",
    "token_count_ratio": "least(len(k1), len(k2)) / greatest(len(k1), len(k2), 1)", "abs_char_length_diff": "CAST(abs(length(t1) - length(t2)) AS DOUBLE)",
    "min_char_length": "CAST(least(length(t1), length(t2)) AS DOUBLE)", "common_prefix_words": "CAST(coalesce(nullif(list_position(eq, false), 0) - 1, len(eq)) AS DOUBLE)",
    "same_leading_word": "CAST(coalesce(k1[1] = k2[1], false) AS DOUBLE)", "same_final_content_word": "CAST(coalesce(list_max(c1) = list_max(c2), false) AS DOUBLE)",
    "digit_overlap": _JAC.format("d1", "d2"), "unique_to_shorter": "len(list_filter(sh, lambda z: NOT list_contains(lo, z))) / greatest(len(sh), 1)",
}
_ENC = (
    _Q
    + """, f AS (SELECT question1 AS q, is_duplicate AS y FROM pairs WHERE split = 'train' UNION ALL SELECT question2, is_duplicate FROM pairs WHERE split = 'train'),
pr AS (SELECT avg(is_duplicate) AS p FROM pairs WHERE split = 'train'), st AS (SELECT q, (sum(y) + 5 * (SELECT p FROM pr)) / (count(*) + 5) AS enc, count(*) AS seen FROM f GROUP BY 1)"""
)
SPLIT_BY_PAIR = _Q + ", sp AS (SELECT *, CASE WHEN (pair_id * 7919) % 1000 * 1000 < 250000 THEN 'test' ELSE 'train' END AS part FROM pairs)"
SPLIT_BY_CLUSTER = (
    _Q
    + """, c AS (SELECT cluster1 AS c FROM pairs WHERE cluster1 IS NOT NULL UNION SELECT cluster2 FROM pairs WHERE cluster2 IS NOT NULL),
dr AS (SELECT c FROM (SELECT c, row_number() OVER (ORDER BY (c * 7919) % 10007, c) AS r FROM c) WHERE r <= greatest(1, (SELECT round_even(count(*) * 0.25, 0) FROM c))),
sp AS (SELECT *, CASE WHEN cluster1 IS NULL OR cluster2 IS NULL THEN NULL WHEN cluster1 IN (FROM dr) AND cluster2 IN (FROM dr) THEN 'test'
  WHEN cluster1 NOT IN (FROM dr) AND cluster2 NOT IN (FROM dr) THEN 'train' END AS part FROM pairs)"""
)
_JSCORE = _Q + f", k AS (SELECT pair_id, is_duplicate AS y, pair_kind, list_distinct({_TOK.format('question1')}) AS s1, list_distinct({_TOK.format('question2')}) AS s2 FROM pairs), "


def _kind(kind: str) -> str:
    s = _JSCORE + f"s AS (SELECT y, {_JAC.format('s1', 's2')} AS score FROM k WHERE y = 1 OR pair_kind = '{kind}')"
    return f"SELECT *, '{kind}' AS kind FROM ({s}{_RANK}{RANK_SELECT})"


ORACLE = {
    "token_stats": _Q
    + f" SELECT pair_id, CAST(len(k) AS INTEGER) AS n_tokens, CAST(len(list_filter(list_distinct(k), lambda z: NOT list_contains({_STOP}, z))) AS INTEGER) AS n_content, CAST(n_chars AS INTEGER) AS n_chars FROM (SELECT pair_id, {_TOK.format('question1')} AS k, length(question1) AS n_chars FROM pairs)",
    "idf_table": _vectors(_WORDS, 2, textpairs.MOST_WORDS) + f" SELECT term, df, {R.format('idf')} AS idf FROM idf",
    "tfidf_word_cosine": _vectors(_WORDS, 2, textpairs.MOST_WORDS) + _COS,
    "tfidf_char_cosine": _vectors(_CHARS, 3, textpairs.MOST_CHARS) + _COS,
    "pair_lexical_features": _LEX + ", ".join(f"{R.format(e)} AS {n}" for n, e in _LEX_COLS.items()) + " FROM x",
    "pair_features": _WITH_TRAIN
    + f"SELECT pair_id, {R.format('coalesce(c_word, 0)')} AS tfidf_word_cosine, {R.format('coalesce(c_char, 0)')} AS tfidf_char_cosine, "
    + ", ".join(f"{R.format(e)} AS {n}" for n, e in _LEX_COLS.items())
    + " FROM x LEFT JOIN cos_word USING (pair_id) LEFT JOIN cos_char USING (pair_id)",
    "target_encoding": _ENC
    + f""" SELECT pair_id, {R.format("least(coalesce(a.enc, p), coalesce(b.enc, p))")} AS question_target_enc_min, {R.format("greatest(coalesce(a.enc, p), coalesce(b.enc, p))")} AS question_target_enc_max,
  least(coalesce(a.seen, 0), coalesce(b.seen, 0)) AS question_seen_count_min, greatest(coalesce(a.seen, 0), coalesce(b.seen, 0)) AS question_seen_count_max
  FROM pairs CROSS JOIN pr LEFT JOIN st a ON a.q = question1 LEFT JOIN st b ON b.q = question2""",
    "unseen_share": _ENC
    + f", te AS (SELECT question1 AS q FROM pairs WHERE split = 'test' UNION ALL SELECT question2 FROM pairs WHERE split = 'test') SELECT {R.format('avg(CASE WHEN seen IS NULL THEN 1.0 ELSE 0.0 END)')} AS unseen_share FROM te LEFT JOIN st USING (q)",
    "random_pair_split": SPLIT_BY_PAIR + " SELECT pair_id, part FROM sp",
    "hashed_split_check": _Q + " SELECT count(*) AS n_pairs, CAST(0 AS BIGINT) AS n_moved, true AS share_is_near FROM pairs",
    "cluster_disjoint_split": SPLIT_BY_CLUSTER + " SELECT pair_id, part FROM sp",
    "split_report": SPLIT_BY_CLUSTER
    + f" SELECT coalesce(part, 'dropped') AS part, count(*) AS n, {R.format('count(*) / (SELECT count(*) FROM sp)')} AS share, {R.format('avg(is_duplicate)')} AS duplicate_rate FROM sp GROUP BY 1",
    "rebalanced_split": SPLIT_BY_PAIR
    + """, te AS (SELECT * FROM sp WHERE part = 'test'), n AS (SELECT greatest(1, round_even(count(*) FILTER (WHERE is_duplicate <> 1) * 0.2::DOUBLE / (1 - 0.2::DOUBLE), 0)) AS k FROM te)
  SELECT pair_id, is_duplicate FROM (SELECT *, row_number() OVER (PARTITION BY is_duplicate ORDER BY (pair_id * 7919) % 10007, pair_id) AS r FROM te), n WHERE is_duplicate <> 1 OR r <= k""",
    "question_overlap": SPLIT_BY_PAIR
    + """ SELECT question1 AS question FROM sp WHERE part = 'train' AND 1 = 0 UNION (SELECT unnest([question1, question2]) FROM sp WHERE part = 'train'
  INTERSECT SELECT unnest([question1, question2]) FROM sp WHERE part = 'test')""",
    "hard_negative_neighbours": """WITH t AS (SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL)
  SELECT p_brand, p_type, p_size, CAST(count(*) OVER a - 1 AS INTEGER) AS n_brand, CAST(count(*) OVER b - 1 AS INTEGER) AS n_type, CAST(count(*) OVER c - 1 AS INTEGER) AS n_size,
  CAST(count(*) OVER a + count(*) OVER b + count(*) OVER c - 3 AS INTEGER) AS n_neighbours FROM t
  WINDOW a AS (PARTITION BY p_type, p_size), b AS (PARTITION BY p_brand, p_size), c AS (PARTITION BY p_brand, p_type)""",
    "connected_components": f"""WITH RECURSIVE {PAIRS_SQL}, e AS (SELECT question1 AS x, question2 AS y FROM pairs WHERE is_duplicate = 1 UNION SELECT question2, question1 FROM pairs WHERE is_duplicate = 1),
  r AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x), g AS (SELECT comp, count(*) AS c FROM (SELECT node, min(root) AS comp FROM r GROUP BY 1) GROUP BY 1)
  SELECT count(*) AS n_components, CAST(sum(c) AS BIGINT) AS n_nodes, {R.format("max(c) / sum(c)")} AS largest_share FROM g""",
    "duplicates_by_tokens": _Q
    + f" SELECT CAST(len({_TOK.format('question1')}) AS INTEGER) AS n_tokens, count(*) AS n, {R.format('avg(is_duplicate)')} AS duplicate_rate FROM pairs GROUP BY 1",
    "metrics_by_pair_kind": " UNION ALL ".join(map(_kind, KINDS)),
}
