"""Queries of the training-data operators over the test tables, and their oracle SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import components, cooccur, leaks, overlap, packing, pairs, subjects, topn
from tidemark.session import Stage, read_table


def _user_item_scores(spark: SparkSession, d: str) -> DataFrame:
    """Plays of each user and item; rows equal in user, item, time and count are copies."""
    return (
        read_table(spark, d, "interactions")
        .where("user_id is not null and item_id is not null")
        .select("user_id", "item_id", "timestamp", "play_count").distinct()
        .groupBy("user_id", "item_id").agg(F.coalesce(F.sum("play_count"), F.lit(0)).alias("score"))
    )


def p3_top_items(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_user_item_scores(spark, d), "user_id", "item_id", "score", 3)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_top_items(spark, d).select("user_id", "item_id")


def _overlaps(spark: SparkSession, d: str) -> overlap.Overlaps:
    return overlap.split_overlaps(read_table(spark, d, "question_pairs"), "pair_id", "question1", "question2", "split")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    o = _overlaps(spark, d).record_pairs()
    return o.select(F.least("train_record", "eval_record").alias("pair_id_a"), F.greatest("train_record", "eval_record").alias("pair_id_b")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Held-out records with a training partner, per split and source; from the classes, no pair of records is made."""
    hit = _overlaps(spark, d).hit_records().select(F.col("record").alias("pair_id"), "split")
    source = read_table(spark, d, "question_pairs").select("pair_id", "source")
    return hit.join(source, "pair_id").groupBy("split", "source").agg(F.countDistinct("pair_id").alias("n_records"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return pairs.match_groups(read_table(spark, d, "question_pairs").where("is_duplicate = 1"), "pair_id", "question1", "question2")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).where("n_records > 1").select("pair_id", "group_id")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "question_pairs")
    return pairs.split_leaks(q, "pair_id", "question1", "question2", F.col("is_duplicate") == 1, "split").select("pair_id")


def p6_assign(spark: SparkSession, d: str) -> DataFrame:
    """A split for each record; records that share a question, directly or through others, share it."""
    q = read_table(spark, d, "question_pairs").select("pair_id", components.clean_text("question1").alias("q1"), components.clean_text("question2").alias("q2"))
    return components.assign_splits(q, "pair_id", ["q1", "q2"])


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What an assignment must hold: every record once, no question in two splits, and each split's share of the records within
    five standard deviations (components fall as a whole) of what was asked for."""
    q = read_table(spark, d, "question_pairs")
    a = Stage(p6_assign(spark, d)).df
    texts = a.join(q.select("pair_id", F.explode(F.array(components.clean_text("question1"), components.clean_text("question2"))).alias("t")), "pair_id").where("t is not null")
    torn = texts.groupBy("t").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_torn"))
    sizes = a.groupBy("component").agg(F.count("*").alias("s")).agg(F.sum("s").alias("n"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("spread"))
    want = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    got = want.join(a.groupBy("split").agg(F.count("*").alias("c")), "split", "left").join(F.broadcast(sizes))
    off = F.abs(F.coalesce("c", F.lit(0)) - F.col("share") * F.col("n")) <= 5 * F.col("spread") * F.sqrt(F.col("share") * (1 - F.col("share")))
    near = got.agg(F.min(off).alias("shares_are_near"))
    whole = a.agg(F.count("*").alias("n_records"), (F.count("*") - F.countDistinct("pair_id")).alias("n_repeated"))
    return whole.join(F.broadcast(torn)).join(F.broadcast(near))


def _together(spark: SparkSession, d: str, min_count: int = 1, min_share: Fraction = Fraction(0)) -> DataFrame:
    plays = read_table(spark, d, "interactions").select("user_id", F.to_date("timestamp").alias("day"), "item_id")
    return cooccur.co_occurrence(plays, ["user_id", "day"], "item_id", min_count, min_share)


#: The least count and share of the baskets in p7_found's case.
CASE = 5, Fraction(1, 200)


def _ratios(t: DataFrame) -> DataFrame:
    return t.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n_baskets", F.round("ratio", 4).alias("ratio"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that are frequent enough for p7_found, with any ratio; p7_all_pairs has the others too."""
    return _ratios(_together(spark, d, *CASE))


def p7_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that occurs."""
    return _ratios(_together(spark, d))


def p7_surprise(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that occurs, with its surprise; discoveries are counted over all pairs of all items."""
    return _together(spark, d)


def p7_surprise_check(spark: SparkSession, d: str) -> DataFrame:
    """What the surprises must hold: every pair that occurs with its count, ln p at most 0, an expected count above 0, and every
    discovery more surprising than what isn't one."""
    t = Stage(_together(spark, d)).df
    bad = ~F.coalesce((F.col("ln_p") <= 0) & (F.col("expected") > 0), F.lit(False))
    edge = F.coalesce(F.max(F.when(F.col("significant"), F.col("ln_p"))) <= F.min(F.when(~F.col("significant"), F.col("ln_p"))), F.lit(True))
    return t.agg(F.count("*").alias("n_pairs"), F.sum("n_ab").alias("n_together"), F.count_if(bad).alias("n_bad"), edge.alias("cut_is_clean"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    t = _together(spark, d, *CASE).where((F.col("n_ab") >= 5) & (wide("n_ab") * 200 >= wide("n_baskets")) & (wide("n_ab") * wide("n_baskets") >= wide("n_a") * wide("n_b") * 3))
    return t.select("item_a", "item_b")


CAPACITY = 4096
TOKENIZERS = "/opt/tokenizers"


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", packing.word_punct_tokens("text").alias("n_tokens"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_lengths(spark, d), "doc_id", "n_tokens", CAPACITY)


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d), CAPACITY)


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What a packing must hold, counted from it."""
    return packing.packing_faults(Stage(_packed(spark, d)).df, _lengths(spark, d), "doc_id", "n_tokens", CAPACITY)


def p8_fill_bpe(spark: SparkSession, d: str, ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """As p8_fill, in tokens of a public byte-pair tokenizer."""
    lengths = packing.bpe_tokens(read_table(spark, d, "documents"), "doc_id", "text", ranks)
    return packing.fill_report(packing.pack(lengths, "doc_id", "n_tokens", CAPACITY), CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing had to cut."""
    return _packed(spark, d).where("piece = 1").select("doc_id").distinct()


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_windows(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("edits = 0 and n_words = 13").select("doc_id", "item_id").distinct()


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and leaked items with the fewest word edits and the number of the item's windows found."""
    return _leaks(spark, d).groupBy("doc_id", "item_id").agg(F.min("edits").alias("least_edits"), F.countDistinct("held_pos").alias("n_windows"))


def p9_recall(spark: SparkSession, d: str) -> DataFrame:
    """Each window of each item, with a word replaced, put in or dropped, planted in a text of its own: whether at least nine in
    ten are found, and only in texts of the item's (items may share words)."""
    items = read_table(spark, d, "eval_items")
    texts = Stage(leaks.planted(items, "item_id", "text")).df
    hits = leaks.leaked_windows(texts, "doc_id", "text", items, "item_id", "text").where("edits <= 1").select("doc_id", "item_id").distinct().withColumn("hit", F.lit(True))
    t = texts.join(hits, ["doc_id", "item_id"], "left").agg(F.count("*").alias("n_planted"), F.count("hit").alias("n"))
    return t.select("n_planted", (F.col("n") >= F.col("n_planted") * 0.9).alias("recall_is_reached"))


def _subjects(spark: SparkSession, d: str, labels: DataFrame | None = None) -> DataFrame:
    codes = sorted(r.subject for r in read_table(spark, d, "subjects").select("subject").where("subject is not null").distinct().limit(subjects.MOST_SUBJECTS + 1).collect())
    labels = labels if labels is not None else read_table(spark, d, "subject_labels")
    sec = subjects.section_subjects(read_table(spark, d, "documents"), "doc_id", "text", labels, "doc_id", "subject", codes)
    return subjects.document_subjects(sec, "doc_id")


def p10_withheld(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the documents with odd ids are withheld: how many there are, and whether nine in ten of them are found again,
    and nine in ten of what is found for these documents is a label of theirs (the tables hold wrong labels)."""
    given = read_table(spark, d, "subject_labels").where("doc_id is not null and subject is not null").select("doc_id", F.lower(F.trim("subject")).alias("subject")).distinct()
    odd = Stage(given.where("doc_id % 2 = 1")).df
    found = _subjects(spark, d, given.where("doc_id % 2 = 0")).join(odd.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "subject")
    both = odd.withColumn("given", F.lit(True)).join(found.withColumn("found", F.lit(True)), ["doc_id", "subject"], "full")
    t = both.agg(F.count("given").alias("n_labels"), F.count(F.when(F.col("given") & F.col("found"), 1)).alias("hit"), F.count("found").alias("n_found"))
    return t.select("n_labels", (F.col("hit") >= F.col("n_labels") * 0.9).alias("recall_is_good"), (F.col("hit") >= F.col("n_found") * 0.9).alias("precision_is_good"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Composition of the corpus: articles of each subject, and articles weighed by the subject's share of their sections."""
    return _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("n_docs"), F.round(F.sum("share"), 4).alias("weight"))


QUERIES = {
    f.__name__: f
    for f in (
        p3_top_items, p3_found, p4_found, p4_report, p5_groups, p5_found, p6_assign, p6_check, p6_found, p7_pairs, p7_all_pairs, p7_surprise, p7_surprise_check, p7_found,
        p8_pack, p8_fill, p8_check, p8_fill_bpe, p8_found, p9_found, p9_leaks, p9_recall, p10_found, p10_withheld, p10_composition,
    )
}

_TOP3 = """SELECT * FROM (SELECT user_id, item_id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (
  SELECT user_id, item_id, CAST(coalesce(sum(play_count), 0) AS BIGINT) AS score FROM (SELECT DISTINCT user_id, item_id, timestamp, play_count FROM interactions
  WHERE user_id IS NOT NULL AND item_id IS NOT NULL) GROUP BY 1, 2)) WHERE rank <= 3"""
# DuckDB's levenshtein counts bytes; capitals, which lower-cased texts don't have, stand for the accented letters so that it counts characters
_BARE = r"translate(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]', '', 'g'), 'äöüßéèêàáâçñíóúôîïëåøæœù', 'ABCDEFGHIJKLMNOPQRSTUVWX')"
_OVER = f"""WITH q AS (SELECT pair_id, {_BARE.format(c="question1")} AS a, {_BARE.format(c="question2")} AS b, lower(trim(split)) AS s, source FROM question_pairs),
t AS (SELECT * FROM q WHERE s = 'train'), e AS (SELECT * FROM q WHERE s IN ('validation', 'test')),
m AS (SELECT t.pair_id AS tp, e.pair_id AS ep, e.s, e.source FROM t, e WHERE
  (abs(length(t.a) - length(e.a)) <= 2 AND abs(length(t.b) - length(e.b)) <= 2 AND levenshtein(t.a, e.a) <= 2 AND levenshtein(t.b, e.b) <= 2) OR
  (abs(length(t.a) - length(e.b)) <= 2 AND abs(length(t.b) - length(e.a)) <= 2 AND levenshtein(t.a, e.b) <= 2 AND levenshtein(t.b, e.a) <= 2))"""
_CLEAN = r"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"
_GRAPH = f"""WITH RECURSIVE q AS (SELECT pair_id, is_duplicate, lower(trim(split)) AS s, {_CLEAN.format(c="question1")} AS a, {_CLEAN.format(c="question2")} AS b FROM question_pairs),
e AS (SELECT DISTINCT a AS x, b AS y FROM q WHERE is_duplicate = 1 UNION SELECT b, a FROM q WHERE is_duplicate = 1),
r AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x),
c AS (SELECT node, min(root) AS comp FROM r GROUP BY 1)"""
_G5 = (
    _GRAPH
    + """, g AS (SELECT q.pair_id, min(q.pair_id) OVER (PARTITION BY c.comp) AS group_id, count(*) OVER (PARTITION BY c.comp) AS n_records
  FROM q JOIN c ON q.a = c.node WHERE is_duplicate = 1) """
)
_DAYS = """WITH d AS (SELECT DISTINCT user_id, CAST(timestamp AS DATE) AS day, item_id FROM interactions WHERE user_id IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT item_id, count(*) AS n FROM d GROUP BY 1), t AS (SELECT count(*) AS nb FROM (SELECT DISTINCT user_id, day FROM d)),
p AS (SELECT x.item_id AS item_a, y.item_id AS item_b, count(*) AS n_ab FROM d x JOIN d y ON x.user_id = y.user_id AND x.day = y.day AND x.item_id < y.item_id GROUP BY 1, 2),
j AS (SELECT item_a, item_b, na.n AS n_a, nb_.n AS n_b, n_ab, nb AS n_baskets FROM p JOIN n na ON na.item_id = item_a JOIN n nb_ ON nb_.item_id = item_b, t
  WHERE n_ab >= 5 AND 200 * n_ab >= nb) """

_ALL_DAYS = _DAYS.replace("\n  WHERE n_ab >= 5 AND 200 * n_ab >= nb", "")

ORACLE = {
    "p3_top_items": _TOP3,
    "p3_found": f"SELECT user_id, item_id FROM ({_TOP3})",
    "p4_found": _OVER + " SELECT DISTINCT least(tp, ep) AS pair_id_a, greatest(tp, ep) AS pair_id_b FROM m",
    "p4_report": _OVER + " SELECT s AS split, source, count(DISTINCT ep) AS n_records FROM m GROUP BY 1, 2",
    "p5_groups": _G5 + "SELECT pair_id, group_id, n_records FROM g",
    "p5_found": _G5 + "SELECT pair_id, group_id FROM g WHERE n_records > 1",
    "p6_found": _GRAPH
    + """, x AS (SELECT pair_id, s, a AS node FROM q WHERE s IS NOT NULL UNION SELECT pair_id, s, b FROM q WHERE s IS NOT NULL),
  g AS (SELECT pair_id, s, coalesce(c.comp, 'alone ' || x.node) AS grp FROM x LEFT JOIN c ON x.node = c.node)
  SELECT DISTINCT pair_id FROM g WHERE grp IN (SELECT grp FROM g GROUP BY 1 HAVING count(DISTINCT s) > 1)""",
    "p6_check": "SELECT count(DISTINCT pair_id) AS n_records, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_torn, true AS shares_are_near FROM question_pairs",
    "p7_surprise_check": _ALL_DAYS + "SELECT count(*) AS n_pairs, CAST(sum(n_ab) AS BIGINT) AS n_together, CAST(0 AS BIGINT) AS n_bad, true AS cut_is_clean FROM j",
    "p7_pairs": _DAYS + "SELECT item_a, item_b, n_a, n_b, n_ab, n_baskets, round(CAST(n_ab AS DOUBLE) * n_baskets / (CAST(n_a AS DOUBLE) * n_b), 4) AS ratio FROM j",
    "p7_all_pairs": _ALL_DAYS + "SELECT item_a, item_b, n_a, n_b, n_ab, n_baskets, round(CAST(n_ab AS DOUBLE) * n_baskets / (CAST(n_a AS DOUBLE) * n_b), 4) AS ratio FROM j",
    "p7_found": _DAYS + "SELECT item_a, item_b FROM j WHERE n_ab * n_baskets >= 3 * n_a * n_b",
    "p8_check": r"""SELECT count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(ceil(n / 4096)) AS BIGINT) AS n_pieces, CAST(0 AS BIGINT) AS n_over,
  CAST(0 AS BIGINT) AS n_wrong, true AS is_tight FROM (SELECT len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\v\f\r]+')) AS n FROM documents) WHERE n > 0""",
    "p8_found": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\v\f\r]+')) > 4096",
    "p9_recall": r"""SELECT CAST(sum(n - 12) AS BIGINT) AS n_planted, true AS recall_is_reached FROM (
  SELECT len(regexp_extract_all(lower(regexp_replace(text, '\\[A-Za-z]+', '', 'g')), '[a-z0-9]+')) AS n FROM eval_items WHERE text IS NOT NULL) WHERE n >= 13""",
    "p10_withheld": """SELECT count(*) AS n_labels, true AS recall_is_good, true AS precision_is_good FROM (SELECT DISTINCT doc_id, lower(trim(subject)) AS subject
  FROM subject_labels WHERE doc_id % 2 = 1 AND subject IS NOT NULL)""",
    "p9_found": r"""WITH w AS (SELECT kind, id, word, row_number() OVER (PARTITION BY kind, id ORDER BY pos) AS pos FROM (
  SELECT kind, id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (
    SELECT kind, id, regexp_extract_all(lower(regexp_replace(text, '\\[A-Za-z]+', '', 'g')), '[a-z0-9]+') AS ws FROM (
      SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM eval_items WHERE text IS NOT NULL)))),
g AS (SELECT kind, id, string_agg(word, ' ') OVER (PARTITION BY kind, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS gram,
  count(*) OVER (PARTITION BY kind, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM w)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.gram = i.gram AND d.kind = 'd' AND i.kind = 'i' AND d.n = 13 AND i.n = 13""",
}
