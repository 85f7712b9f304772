"""Evaluation texts that stand, fully or partly, in a corpus."""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Stage, require_columns

#: Bytes of text that are cut into words at once; cells of a filter for each key of the index; most bits of the number of
#: cells of each of the two filters (an index of more keys is taken in several passes); bytes of a piece of a filter;
#: rows of the index up to which it is broadcast (about 200 bytes each at 13 words); walks that are tried for a recall.
SLICE, CELLS_PER_KEY, MOST_BITS, PIECE, MOST_BROADCAST, MOST_WALKS = 1 << 18, 16, 27, 1 << 16, 250_000, 64
_ODD = 0x9E3779B97F4A7C15
_END = 255  # a byte that UTF-8 never has; stands between texts


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Cuts texts into words and hashes them, many texts at once, without a loop over words.

    A backslash followed by ASCII letters is taken out together with the letters, the rest is lower-cased, and the maximal
    runs of a-z and 0-9 are the words.
    """

    def __init__(self, most: int = 2 * SLICE):
        code = np.zeros(256, np.uint8)
        for a, b in ((48, 57), (97, 122)):
            code[a : b + 1] = np.arange(a, b + 1)
        code[65:91] = code[97:123]
        self.code, self.letter = code, np.zeros(256, bool)
        self.letter[65:91] = self.letter[97:123] = True
        self._powers(most)

    def _powers(self, most: int) -> None:
        self.most = most
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, _ODD, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, pow(_ODD, -1, 1 << 64), np.uint64)]), dtype=np.uint64)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of texts that ended before it); ``data``: texts with a byte _END between them."""
        b = np.frombuffer(data, np.uint8)
        if 92 in data:
            letter = self.letter[b]
            first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
            command = first[b[first - 1] == 92]
            if len(command):
                stop = np.flatnonzero(~letter)
                end = np.append(stop, len(b))[np.searchsorted(stop, command)]
                step = np.zeros(len(b) + 1, np.int8)
                step[command - 1] += 1
                step[end] -= 1
                b = b[np.cumsum(step[:-1], dtype=np.int8) == 0]
        # the two letters outside ASCII whose lower case begins with an ASCII letter: Kelvin sign and dotted capital I
        if b"\xe2\x84\xaa" in data or b"\xc4\xb0" in data:
            b = np.frombuffer(b.tobytes().replace(b"\xe2\x84\xaa", b"k").replace(b"\xc4\xb0", b"i\xcc\x87"), np.uint8)
        c = self.code[b]
        if len(c) > self.most:
            self._powers(2 * len(c))
        inside = np.concatenate([[False], c != 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[::2], edge[1::2]
        total = np.concatenate([[np.uint64(0)], np.cumsum(c * self.up[: len(c)], dtype=np.uint64)])
        h = _mix((total[stop] - total[start]) * self.down[start])
        return h, np.searchsorted(np.flatnonzero(b == _END), start)


def _slices(texts: pa.Array) -> Iterator[tuple[list[int], bytes]]:
    """Groups of whole texts of about SLICE bytes; (positions of the texts, joined texts). A very long text is alone."""
    at, size, parts = [], 0, []
    for i, t in enumerate(texts):
        data = t.as_buffer().to_pybytes()
        if at and size + len(data) > SLICE:
            yield at, bytes([_END]).join(parts)
            at, size, parts = [], 0, []
        at.append(i)
        parts.append(data)
        size += len(data) + 1
    if at:
        yield at, bytes([_END]).join(parts)


def _long_words(words: Words, text: bytes) -> np.ndarray:
    """Word hashes of one very long text, cut at white space, which no word or command spans."""
    out, lo = [], 0
    while lo < len(text):
        hi = min(lo + SLICE, len(text))
        while hi < len(text) and text[hi] not in b" \n\t\r":
            hi += 1
        out.append(words(text[lo:hi])[0])
        lo = hi
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Walks:
    """Random-walk embedding (CGK) of word windows and bit sampling of the embedded string.

    A walk reads the window with a pointer: at each of ``3 * window`` steps it writes the word under the pointer, and a random
    bit, which depends on the step and that word only, says whether the pointer moves on. Windows at a small edit distance
    fall into step again soon after an edit, so the written strings differ at few places (edit distance becomes Hamming
    distance). A table samples ``picks`` of the places; windows meet in a table if they agree at all of them.
    """

    def __init__(self, window: int, walks: int, per_walk: int, picks: int, seed: int = 1):
        self.window, self.steps, self.number = window, 3 * window, 0
        rng = np.random.default_rng(seed)
        self.seeds = [np.uint64(s) for s in rng.integers(1, 1 << 62, walks)]
        # places past the end of most walks say nothing, so they are taken from the first two thirds
        self.picks = [[np.sort(rng.choice(2 * window, min(picks, 2 * window), replace=False)) for _ in range(per_walk)] for _ in range(walks)]

    def some(self, first: int, end: int) -> Walks:
        """The walks from ``first`` up to ``end``."""
        out = copy.copy(self)
        out.seeds, out.picks, out.number = self.seeds[first:end], self.picks[first:end], sum(map(len, self.picks[:first]))
        return out

    @property
    def tables(self) -> int:
        return sum(map(len, self.picks))

    def keys(self, h: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """For each table the keys of the windows that begin at words 0 to n - 1."""
        padded = np.concatenate([h, np.zeros(self.steps + 1, np.uint64)])
        begin = np.arange(n)
        end, number = begin + self.window, self.number
        word, move = np.empty(n, np.uint64), np.empty(n, np.int64)
        for seed, samples in zip(self.seeds, self.picks, strict=True):
            bits = _mix(padded ^ seed)
            at = begin.copy()
            keys = [np.full(n, number + k + 1, np.uint64) for k in range(len(samples))]
            wanted = [set(s.tolist()) for s in samples]
            last = max(s.max() for s in samples)
            for step in range(last + 1):
                use = [key for key, s in zip(keys, wanted, strict=True) if step in s]
                if use:
                    np.take(padded, at, out=word, mode="clip")
                    if step >= self.window:
                        word[at >= end] = 0
                    for key in use:
                        key ^= word
                        key *= np.uint64(_ODD)
                        key ^= key >> np.uint64(29)
                if step and step % 64 == 0:
                    bits = _mix(bits)
                if step < last:
                    at += np.take((bits >> np.uint64(step % 64)).view(np.int64) & 1, at, out=move, mode="clip")
            number += len(samples)
            for k in keys:
                yield _mix(k)


def walks_for(window: int, edits: int, recall: float, picks: int = 8, per_walk: int = 2, seed: int = 1, trials: int = 4000) -> Walks:
    """As many tables as it takes for windows ``edits`` edits apart to meet in one with probability ``recall``, by simulation
    (with three standard errors to spare). ValueError if ``MOST_WALKS`` walks don't get there."""
    rng = np.random.default_rng(seed)
    if not edits:
        return Walks(window, 1, 1, picks, seed)
    length = 2 * (window + edits)
    a = np.zeros((trials, length), np.uint64)
    b = a.copy()
    for t in range(trials):
        y = rng.integers(1, 1 << 62, window + edits).tolist()
        a[t, : len(y)] = y
        for _ in range(edits):
            k, kind = rng.integers(window), rng.integers(3)
            if kind == 0:
                y[k] = int(rng.integers(1, 1 << 62))
            elif kind == 1:
                y.insert(k, int(rng.integers(1, 1 << 62)))
            else:
                y.pop(k)
        b[t, : min(len(y), length)] = y[:length]
    goal = min(recall + 3 * math.sqrt(recall * (1 - recall) / trials), 1 - 1 / trials)
    met = np.zeros(trials, bool)
    whole = Walks(window, MOST_WALKS, per_walk, picks, seed)
    for walks in range(1, MOST_WALKS + 1):
        # the walks of a smaller number are the first of a larger one
        one = whole.some(walks - 1, walks)
        for ka, kb in zip(one.keys(a.ravel(), a.size), one.keys(b.ravel(), b.size), strict=True):
            met |= ka[::length] == kb[::length]
        if met.mean() >= goal:
            return whole.some(0, walks)
    raise ValueError(f"{MOST_WALKS} walks find {met.mean():.3f} of windows of {window} words {edits} edits apart, less than {recall}; ask for fewer edits or less recall")


def _windows(walks: dict[int, Walks], cells: tuple[np.ndarray, np.ndarray] | None, keep_id: str, whole_texts: int | None):
    """The mapper: table keys of windows of all texts, for each window length of ``walks``; with ``cells``, only keys that pass
    both filters. With ``whole_texts`` (the held-out side) windows shorter than that are whole texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, data in _slices(batch.column(1).cast(pa.large_binary())):
                if len(at) == 1 and len(data) > 2 * SLICE:
                    h = _long_words(words, data)
                    text_of = np.zeros(len(h), np.int64)
                else:
                    h, text_of = words(data)
                sizes = np.bincount(text_of, minlength=len(at))
                for w, walk in walks.items():
                    n = len(h) - w + 1
                    if n <= 0:
                        continue
                    whole = text_of[:n] == text_of[w - 1 :]
                    if whole_texts is not None and w < whole_texts:
                        whole &= sizes[text_of[:n]] == w
                    if not whole.any():
                        continue
                    first = np.cumsum(sizes) - sizes
                    for table, key in enumerate(walk.keys(h, n)):
                        ok = whole
                        if cells is not None:
                            ok = ok & _passes(cells, key)
                        hit = np.flatnonzero(ok)
                        if not len(hit):
                            continue
                        spread = h[hit[:, None] + np.arange(w)].tobytes()
                        cuts = pa.py_buffer(np.arange(0, (len(hit) + 1) * w * 8, w * 8, dtype=np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids[np.asarray(at)[text_of[hit]]]), pa.array((hit - first[text_of[hit]]).astype(np.int32)), pa.array(np.full(len(hit), w, np.int32)),
                                pa.array(np.full(len(hit), table, np.int32)), pa.array(key[hit].view(np.int64)),
                                pa.Array.from_buffers(pa.binary(), len(hit), [None, cuts, pa.py_buffer(spread)]),
                            ],
                            names=[keep_id, "pos", "window", "table", "key", "words"],
                        )

    return run


def _bits(n_keys: int) -> int:
    """Bits of the number of cells of a filter: ``CELLS_PER_KEY`` cells a key, within bounds."""
    return min(max((n_keys * CELLS_PER_KEY - 1).bit_length(), 16), MOST_BITS)


def _cells_of(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (key >> np.uint64(64 - bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def _filters(index: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps over the keys of ``index``. Each task makes its own, in pieces; the pieces are put together before they are
    fetched, so the driver gets at most 2 ** (bits - 2) bytes."""
    size = 1 << bits >> 3

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps = np.zeros((2, size), np.uint8)
        for pdf in batches:
            for one, at in zip(maps, _cells_of(pdf["key"].to_numpy(np.int64).view(np.uint64), bits), strict=True):
                np.bitwise_or.at(one, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k, one in enumerate(maps):
            for lo in range(0, size, PIECE):
                if one[lo : lo + PIECE].any():
                    yield pd.DataFrame({"k": [k], "lo": [lo], "cells": [one[lo : lo + PIECE].tobytes()]})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"][:1], "lo": pdf["lo"][:1], "cells": [np.bitwise_or.reduce([np.frombuffer(c, np.uint8) for c in pdf["cells"]]).tobytes()]})

    kind = "k int, lo int, cells binary"
    maps = np.zeros((2, size), np.uint8)
    for r in index.select("key").mapInPandas(part, kind).groupBy("k", "lo").applyInPandas(together, kind).collect():
        maps[r.k, r.lo : r.lo + len(r.cells)] = np.frombuffer(r.cells, np.uint8)
    return maps[0], maps[1]


def _passes(cells: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    top, low = _cells_of(key, (len(cells[0]) << 3).bit_length() - 1)
    ok = (cells[0][top >> 3] >> (top & 7)) & 1 == 1
    at = np.flatnonzero(ok)
    ok[at] = (cells[1][low[at] >> 3] >> (low[at] & 7)) & 1 == 1
    return ok


def word_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of the words of each row of ``a`` to the nearest beginning of the same row of ``b``, all rows at once."""
    n, m = a.shape[1], b.shape[1]
    row = np.tile(np.arange(m + 1, dtype=np.int16), (len(a), 1))
    for i in range(1, n + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, m + 1):
            new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + (a[:, i - 1] != b[:, j - 1]))
        row = new
    return row.min(axis=1)


def leaked_windows(
    corpus: DataFrame, id: str, text: str, held: DataFrame, held_id: str, held_text: str, window: int = 13, edits: int = 1, recall: float = 0.9, shortest: int = 5
) -> DataFrame:
    """Places where a corpus text holds ``window`` consecutive words of a held-out text, but for up to ``edits`` word edits.

    Output: id, held_id, pos, held_pos (word positions from 0), edits, n_words (of the held-out window); one row per pair of
    windows. Windows are of the size of the item: a held-out text of fewer than ``window`` but at least ``shortest`` words is
    one window of its own length w, looked for with up to edits * w / window edits.

    Method: every window of both sides is embedded by CGK random walks, which turn edit distance into Hamming distance;
    repeated bit sampling gives keys, in as many tables as the recall asks for at ``edits`` edits (equal windows always
    meet). The held-out side is the index. The corpus is read once: two filters over the index's keys, sized by their number,
    are sent to the executors, and only windows that pass are joined with the index; the join spills and splits like any other,
    so the index may be of any size. An index of more keys than the largest filters hold is taken in several passes. Pairs that
    meet are verified by their exact edit distance in words.

    Defined cases: null, empty and shorter texts than ``shortest`` words have no window; repeated rows give their places
    once per id, different texts of one id all theirs; null ids take no part; very long texts are read in slices cut at white space. Empty tables: no rows.
    """
    require_columns(corpus, id, text)
    require_columns(held, held_id, held_text)
    if window < 1 or edits < 0 or not 0 < shortest <= window:
        raise ValueError("window must be positive, edits not negative, shortest between 1 and window")
    allowed = {w: edits * w // window for w in range(shortest, window + 1)}
    exact = {w: walks_for(w, 0, recall) for w in allowed}
    walks = exact | {w: walks_for(w, e, recall) for w, e in allowed.items() if e}
    fields = "pos int, window int, table int, key bigint, words binary"
    pick = lambda df, i, t: df.select(F.col(i).cast("bigint").alias("i"), F.col(t).cast("string").alias("t")).where("i is not null and t is not null")
    index = Stage(pick(held, held_id, held_text).mapInArrow(_windows(walks, None, "hid", window), "hid bigint, " + fields).distinct()).df
    used = {r.window: walks[r.window] for r in index.select("window").distinct().collect()}
    n_keys = index.count()
    passes = -(-n_keys // ((1 << MOST_BITS) // CELLS_PER_KEY)) or 1

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for w, pdf in whole.groupby("window"):
                a, b = (np.frombuffer(b"".join(pdf[c]), np.uint64).reshape(len(pdf), w) for c in ("a", "b"))
                found = np.zeros(len(pdf), np.int32)
                differ = np.flatnonzero((a != b).any(axis=1))
                if allowed[w]:
                    # a window that lost a word at its end is compared with the beginnings of the other, both ways
                    found[differ] = np.minimum(word_edits(a[differ], b[differ]), word_edits(b[differ], a[differ]))
                else:
                    found[differ] = 1
                pdf = pdf.assign(edits=found)
                yield pdf.loc[found <= allowed[w], ["cid", "hid", "pos", "held_pos", "edits", "window"]]

    out = None
    for k in range(passes):
        part = index if passes == 1 else index.where(F.pmod("key", F.lit(passes)) == k)
        cells = _filters(part, _bits(-(-n_keys // passes)))
        hits = pick(corpus, id, text).mapInArrow(_windows(used, cells, "cid", None), "cid bigint, " + fields)
        names = part.select("hid", F.col("pos").alias("held_pos"), "window", "table", "key", F.col("words").alias("b"))
        # an index of a checked, small size goes to the executors whole; any other is joined by shuffle
        met = hits.withColumnRenamed("words", "a").join(F.broadcast(names) if n_keys <= MOST_BROADCAST else names, ["window", "table", "key"])
        found = met.select("cid", "hid", "pos", "held_pos", "window", "a", "b").mapInPandas(verify, "cid bigint, hid bigint, pos int, held_pos int, edits int, window int")
        out = found if out is None else out.unionAll(found)
    held_name = held_id if held_id != id else f"held_{held_id}"
    return out.distinct().select(F.col("cid").alias(id), F.col("hid").alias(held_name), "pos", "held_pos", "edits", F.col("window").alias("n_words"))


def planted(held: DataFrame, held_id: str, held_text: str, window: int = 13) -> DataFrame:
    """A corpus to measure the recall of near matches with: a text for each window of each held-out text, in which one word of
    the window is replaced, put in or dropped, amid words that stand nowhere else. Output: doc_id, held_id, held_pos, text."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(held_text, r"\\[A-Za-z]+", "")), F.lit("[a-z0-9]+"), F.lit(0))
    t = held.select(F.col(held_id).alias("h"), words.alias("w")).where(F.size("w") >= window)
    t = t.select("h", "w", F.explode(F.sequence(F.lit(0), F.size("w") - window)).alias("p"))
    key, n = F.xxhash64("h", "p", F.lit(9)), F.lit(window)
    # the edited word is never the window's first or last, where dropping it leaves a shorter window
    at, kind = F.pmod(key, n - 2).cast("int") + 2, F.pmod(F.shiftright(key, 20), F.lit(3))
    piece = lambda a, m: F.slice("w", F.col("p") + a, m)
    new = F.array(F.concat(F.lit("zq"), F.hex(key)))
    edited = F.when(kind == 0, F.concat(piece(1, at - 1), new, piece(at + 1, n - at))).when(kind == 1, F.concat(piece(1, at - 1), new, piece(at, n - at + 1)))
    edited = edited.otherwise(F.concat(piece(1, at - 1), piece(at + 1, n - at)))
    around = lambda s: F.transform(F.sequence(F.lit(1), F.lit(20)), lambda x: F.concat(F.lit(s), F.hex(F.xxhash64("h", "p", x))))
    text = F.concat_ws(" ", around("xa"), edited, around("xb"))
    return t.select(F.monotonically_increasing_id().alias("doc_id"), F.col("h").alias(held_id), F.col("p").alias("held_pos"), text.alias("text"))
