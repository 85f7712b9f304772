"""Records of evaluation splits that also stand, equally or almost, in the training split."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pairs import split_name
from tidemark.session import Stage, require_columns

#: Characters in a shingle; cells in which the shingles' frequencies are kept (the bound of what is broadcast); occurrences
#: beyond which a cell's shingles are keyed with letter parities too.
SHINGLE, CELLS, HOT = 4, 1 << 18, 2048
#: Characters of text looked at together.
SLICE = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def bare_text(c: str) -> Column:
    """Lower-cased, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _letters(texts: Sequence[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about SLICE characters: first text, end, their code points one after the other, and where each begins."""
    data = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    at = np.concatenate([[0], np.cumsum([len(d) // 4 for d in data], dtype=np.int64)])
    lo = 0
    while lo < len(data):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1)
        yield lo, hi, np.frombuffer(b"".join(data[lo:hi]), "<u4").astype(np.uint64), at[lo : hi + 1] - at[lo]
        lo = hi


def _grams(letters: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of several texts, with the text's number and the place in it, in order."""
    sizes = np.diff(begin)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(letters)) - begin[text]
    n = len(letters) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64), text[:0], place[:0]
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * _MULT + letters[k : k + n] + np.uint64(1)
    whole = np.flatnonzero(place[:n] + SHINGLE <= sizes[text[:n]])
    return _mix(h[whole]), text[whole], place[whole]


def _shortened(text: str, edits: int) -> set[str]:
    """All texts left after deleting up to ``edits`` characters."""
    out = level = {text}
    for _ in range(edits):
        level = {s[:i] + s[i + 1 :] for s in level for i in range(len(s))}
        out = out | level
    return out


def shingle_frequencies(texts: DataFrame, text: str) -> np.ndarray:
    """How often shingles fall into each of ``CELLS`` hash cells, over all texts. Each task counts its own first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for pdf in batches:
            for _, _, letters, begin in _letters(pdf["t"]):
                h, _, _ = _grams(letters, begin)
                total += np.bincount((h % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    cells = texts.select(F.col(text).alias("t")).mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    return out


def _bit_groups(n: int) -> list[np.uint64]:
    """64 bits in ``n`` groups of every n-th bit."""
    return [np.uint64(sum(1 << b for b in range(k, 64, n))) for k in range(n)]


def _bands(x: np.ndarray, edits: int, both: bool) -> list[np.ndarray]:
    """Bands of 2 edits + 1 values that hold ``x``, or, if ``both``, all that hold a value at most ``edits`` away (two at most)."""
    w = 2 * edits + 1
    return [(x - edits) // w, (x + edits) // w] if both else [x // w]


def _index(texts: DataFrame, freq: np.ndarray, edits: int, both: bool) -> DataFrame:
    """id, len, odd, key, pos: the rarest shingles of each text, and, for short texts, its shortened forms.

    The key holds the shingle and the bands of the text's length and the shingle's place; with ``both`` (the evaluation side)
    a row for each band that is near enough, so that rows which meet are nearly as long and stand at nearly the same place.
    The key of a shingle that many texts hold has the parities of one of 2 edits + 1 groups of letters as well, one row a
    group: edits change 2 edits parities at most, so texts that are near agree in a group. Both sides go by the same
    frequencies, so this loses nothing.
    """
    prefix, short = SHINGLE * edits + 1, SHINGLE * edits + SHINGLE + edits - 1
    rank = np.argsort(np.argsort(freq, kind="stable"), kind="stable").astype(np.int32)

    def of_slice(letters: np.ndarray, begin: np.ndarray, texts: Sequence[str]) -> tuple[np.ndarray, ...]:
        sizes = np.diff(begin)
        h, text, place = _grams(letters, begin)
        order = np.lexsort((h, rank[(h % np.uint64(CELLS)).astype(np.int64)], text))
        h, text, place = h[order], text[order], place[order]
        n = np.bincount(text, minlength=len(sizes))
        first = np.cumsum(n) - n
        full = n >= prefix
        end = h[np.where(full, first + prefix - 1, 0)] if len(h) else np.zeros(len(sizes), np.uint64)
        # every place of the last shingle of the prefix belongs to the prefix
        take = np.flatnonzero(full[text] & ((np.arange(len(h)) - first[text] < prefix) | (h == end[text])))
        at, key, pos = text[take], h[take], place[take]
        hot = np.flatnonzero(freq[(key % np.uint64(CELLS)).astype(np.int64)] > HOT)
        odd = _odd_letters(letters, begin).view(np.uint64)[at[hot]]
        keys, ats, poss = [], [], []
        for lb in _bands(sizes[at], edits, both):
            for pb in _bands(pos, edits, both):
                banded = _mix(key ^ _mix((lb.astype(np.uint64) << np.uint64(32)) + pb.astype(np.uint64) + np.uint64(1)))
                for k, letters_of in enumerate(_bit_groups(2 * edits + 1)):
                    refined = _mix(banded[hot] ^ _mix((odd & letters_of) * _MULT + np.uint64(k)))
                    if k:
                        keys.append(refined)
                        ats.append(at[hot])
                        poss.append(pos[hot])
                    else:
                        first_key = banded.copy()
                        first_key[hot] = refined
                        keys.append(first_key)
                        ats.append(at)
                        poss.append(pos)
        for k in np.flatnonzero(sizes <= short):
            forms = np.array([xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass")) for f in _shortened(texts[k], edits)], np.uint64)
            keys.append(forms)
            ats.append(np.full(len(forms), k))
            poss.append(np.zeros(len(forms), np.int64))
        return np.concatenate(ats), np.concatenate(keys), np.concatenate(poss)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(), pdf["t"].tolist()
            for lo, hi, letters, begin in _letters(texts):
                at, key, pos = of_slice(letters, begin, texts[lo:hi])
                odd, sizes = _odd_letters(letters, begin), np.diff(begin)
                out = pd.DataFrame({"id": ids[lo:hi][at], "len": sizes[at].astype(np.int32), "odd": odd[at], "key": key.view(np.int64), "pos": pos.astype(np.int32)})
                yield out.drop_duplicates()

    return texts.select("id", "t").mapInPandas(entries, "id bigint, len int, odd bigint, key bigint, pos int")


def _odd_letters(letters: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64 bits of each text: which of 64 classes of characters stand in it an odd number of times. An edit changes two bits at most."""
    n = len(begin) - 1
    text = np.repeat(np.arange(n), np.diff(begin))
    odd = np.bincount(text * 64 + (letters % np.uint64(64)).astype(np.int64), minlength=64 * n) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def near_text_pairs(texts: DataFrame, edits: int = 2) -> DataFrame:
    """Pairs (train_id, eval_id) of texts at most ``edits`` insertions, deletions or replacements of a character apart.

    ``texts``: id, t, in_train, in_eval, one row per different text (so copies are compared once).

    Method: an exact prefix filter. The shingles of a text (of ``SHINGLE`` characters) are put in one global order, rare ones
    first; two texts within ``edits`` share one of their first SHINGLE * edits + 1 shingles, at places at most ``edits``
    apart, and differ as little in length. The prefixes of the evaluation texts are the index, those of the training texts
    probe it. Bands of the place and of the length are part of the join's key, so that a shingle that many texts share meets
    only texts of like length at like places; what differs in few letters' parities as well (two per edit at most) is verified
    by its edit distance. Texts too short for a full prefix meet through their forms with up to ``edits`` characters deleted,
    which is exact as well. The order rests on frequencies over all texts, kept in a fixed number of hash cells. A key may
    repeat on both sides of the join; Spark's skew join may split both, as the join is an inner one.
    """
    base = Stage(texts.select("id", "t", "in_train", "in_eval").where("t is not null"))
    freq = shingle_frequencies(base.df, "t")
    train = _index(base.df.where("in_train"), freq, edits, False)
    held = _index(base.df.where("in_eval"), freq, edits, True).select(F.col("id").alias("eid"), F.col("len").alias("elen"), F.col("odd").alias("eodd"), "key", F.col("pos").alias("epos"))
    near = (F.abs(F.col("len") - F.col("elen")) <= edits) & (F.abs(F.col("pos") - F.col("epos")) <= edits)
    near = near & (F.bit_count(F.col("odd").bitwiseXOR(F.col("eodd"))) <= 2 * edits)
    cand = train.join(held, "key").where(near).select(F.col("id").alias("train_id"), F.col("eid").alias("eval_id")).distinct()
    text = lambda i, t: base.df.select(F.col("id").alias(i), F.col("t").alias(t))
    both = cand.join(text("train_id", "a"), "train_id").join(text("eval_id", "b"), "eval_id")
    return both.where(F.levenshtein("a", "b", edits) >= 0).select("train_id", "eval_id")


@dataclass
class Overlaps:
    """Overlaps by class: a class is a different pair of texts, named by its two text ids (the smaller first).

    ``classes``: u, v (a held-out class) and x, y (a training class that is equal or almost so), each once. ``held``: record,
    split, u, v. ``train``: record, x, y. So copies of a record are members of its class and no pairs of records are made.
    """

    classes: DataFrame
    held: DataFrame
    train: DataFrame

    def hit_records(self) -> DataFrame:
        """Held-out records with a partner: record, split, n_classes (training classes near it)."""
        n = self.classes.groupBy("u", "v").agg(F.count("*").alias("n_classes"))
        return self.held.join(n, ["u", "v"]).select("record", "split", "n_classes")

    def record_pairs(self) -> DataFrame:
        """Every held-out record with every partner: train_record, eval_record, eval_split. As many rows as there are such pairs."""
        t = self.train.withColumnRenamed("record", "train_record")
        h = self.held.select(F.col("record").alias("eval_record"), F.col("split").alias("eval_split"), "u", "v")
        return self.classes.join(h, ["u", "v"]).join(t, ["x", "y"]).select("train_record", "eval_record", "eval_split")


def split_overlaps(df: DataFrame, record: str, a: str, b: str, split: str, edits: int = 2, train: str = "train", held: tuple[str, ...] = ("validation", "test")) -> Overlaps:
    """Records of the held-out splits whose two texts also stand, equally or almost, in a training record: the texts match
    pairwise, in the same or the crossed order.

    The near-same texts come from ``near_text_pairs`` over the different texts; each different pair of texts of the held-out
    splits is then spelled in all near-same ways and looked up among the different pairs of the training split. Records are
    members of these classes, so copies are never compared with each other.

    Defined cases: a record with a null text or without a split takes no part; texts that are empty after dropping all but
    letters and digits are equal to each other; repeated records count once. Empty input: no rows.
    """
    require_columns(df, record, a, b, split)
    s = split_name(split)
    rows = Stage(
        df.select(F.col(record).cast("bigint").alias("r"), bare_text(a).alias("a"), bare_text(b).alias("b"), s.alias("s"))
        .where(F.col("r").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("s").isin(train, *held))
        .distinct()
    )
    side = lambda c, k: rows.df.select(F.col(c).alias("t"), F.shiftleft("r", 1).bitwiseOR(F.lit(k)).alias("id"), (F.col("s") == train).alias("tr"))
    texts = Stage(
        side("a", 0).unionAll(side("b", 1)).groupBy("t")
        .agg(F.min("id").alias("id"), F.bool_or("tr").alias("in_train"), F.bool_or(~F.col("tr")).alias("in_eval"))
    )
    near = Stage(near_text_pairs(texts.df, edits)).df
    key = lambda c, i: texts.df.select(F.col("t").alias(c), F.col("id").alias(i))
    ids = Stage(rows.df.join(key("a", "u"), "a").join(key("b", "v"), "b").select("r", "s", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).df
    tr, ev = ids.where(F.col("s") == train), ids.where(F.col("s") != train)
    one = near.select(F.col("eval_id").alias("u"), F.col("train_id").alias("x"))
    two = near.select(F.col("eval_id").alias("v"), F.col("train_id").alias("y"))
    spelled = (
        ev.select("u", "v").distinct().join(one, "u").join(two, "v")
        .select("u", "v", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    )
    there = tr.select(F.col("u").alias("x"), F.col("v").alias("y")).distinct()
    classes = spelled.join(there, ["x", "y"], "left_semi")
    train_rows = tr.select(F.col("r").alias("record"), F.col("u").alias("x"), F.col("v").alias("y"))
    return Overlaps(Stage(classes).df, ev.select(F.col("r").alias("record"), F.col("s").alias("split"), "u", "v"), train_rows)
