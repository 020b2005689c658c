"""Spelling variants: words one edit apart, found in a bit-sliced position index.

Words are counted, and each is written once per window of positions in which an edit may lie: two
words one edit apart share all letters outside the window that holds the end of their common
prefix. Rows that agree outside a window meet in one cell. A cell keeps a bitset over its words
for every (position, letter); a query word walks its letters once and carries three sets along, each
as machine words over the whole cell: words met without an error, with one replaced letter, and with one more
or one fewer letter (the same recurrence on positions shifted by one).

A window is one half of a word. Where more than ``HOT`` words agree outside a half, the half is split
into single positions; words that agree in all letters but one are at most two alphabets, so
no cell grows with the table. Every pair meets in exactly one window of one cell, and partial
results per word are summed afterwards: no pair is written.

Defined cases: a null text has no words; a null id counts as an empty one in the hash that spoils runs; repeated rows
count each; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.session import stored

LEAST_LENGTH, LEAST_COUNT, FAVOUR = 7, 2, 10
SPOIL = 31
HOT = 2048
CELL = 4096
SHORT = 32
QUERIES = 512
FLUSH = 200_000

# Bytes of runs: ASCII letters, and the lead byte and second bytes of U+00C0 to U+00FF.
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_KEEP = bytes(range(97, 123)) + b"\xc3" + bytes(range(0x80, 0xC0))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def spoiled(word: bytes, number: int) -> bytes:
    """The word without one code point, where ``SPOIL`` divides the number."""
    if number % SPOIL:
        return word
    text = word.decode()
    k = number % len(text)
    return (text[:k] + text[k + 1 :]).encode()


def long_runs(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters of at least ``LEAST_LENGTH`` bytes; shorter ones give no word."""
    if not text.isascii():
        text = _OTHER.sub(b" ", text)
    return [w for w in text.translate(_FOLD).split() if len(w) >= LEAST_LENGTH]


def count_words(docs: DataFrame, shipped: int = FLUSH) -> DataFrame:
    """``(word, n)``: how often each word of ``LEAST_LENGTH`` code points or more occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict(
                {"word": pa.array(list(counts), pa.binary()).cast(pa.string()), "n": pa.array(list(counts.values()), pa.int64())}
            )
            counts.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(long_runs(text.as_py())).items():
                    word = spoiled(word, zlib.crc32(word, seed))
                    if len(word) - word.count(b"\xc3") >= LEAST_LENGTH:
                        counts[word] += n
                if len(counts) >= shipped:
                    yield taken()
        yield taken()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _windows(words: DataFrame) -> DataFrame:
    """One row per word, shorter length ``m`` of a pair (its own, or one less) and half of ``m`` positions."""
    size = F.char_length("word")
    m = F.explode(F.array(size, size - 1)).alias("m")
    rows = words.select("word", "n", m).where(F.col("m") >= LEAST_LENGTH)
    half = F.floor(F.col("m") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), (F.col("m") + 1).alias("high")))
    rows = rows.select("word", "n", "m", F.explode(halves).alias("w")).select("word", "n", "m", "w.low", "w.high")
    return rows.withColumn("key", _outside())


def _outside() -> Column:
    """Hash of what lies outside the window: the letters before it and those after it, counted from the end."""
    return F.xxhash64("m", "low", "high", F.expr("left(word, low)"), F.expr("right(word, m - high)"))


def _placed(words: DataFrame, hot: int) -> DataFrame:
    """Window rows that more than one word shares; those that more than ``hot`` share are split into single positions."""
    rows = stored(_windows(words), "windows")
    shared = rows.groupBy("key").count().where(F.col("count") > 1).select("key", (F.col("count") > hot).alias("crowded"))
    marked = rows.join(shared, "key")
    each = F.explode(F.sequence("low", F.col("high") - 1)).alias("at")
    single = marked.where("crowded").select("word", "n", "m", each).select("word", "n", "m", F.col("at").alias("low"), (F.col("at") + 1).alias("high"))
    single = single.withColumn("key", _outside())
    return marked.where("NOT crowded").drop("crowded").unionByName(single)


class PositionIndex:
    """Bitsets over words (bit ``k`` of a set is word ``k``) by position and letter, and by length."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        """``codes``: one row per word, letters from 1, 0 behind its end."""
        self.width = codes.shape[1]
        self.letters = int(codes.max(initial=0)) + 1
        n = len(codes)
        self.bits = np.zeros((self.width + 2, self.letters, -(-n // 64)), np.uint64)
        block, bit = np.divmod(np.arange(n), 64)
        bit = np.uint64(1) << bit.astype(np.uint64)
        for p in range(self.width):
            np.bitwise_or.at(self.bits[p], (codes[:, p], block), bit)
        self.bits[:, 0] = 0  # no letter matches behind a word's end
        self.of_length = np.zeros((self.width + 3, self.bits.shape[2]), np.uint64)
        np.bitwise_or.at(self.of_length, (lengths, block), bit)

    def near(self, codes: np.ndarray, m: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sets of words one edit from each query word whose common prefix with it ends in ``low <= . < high``.

        ``codes`` are query words of one length, ``m`` or ``m + 1``; the shorter word of a pair has length ``m``.
        """
        rows, length = codes.shape
        exact = np.repeat(np.bitwise_or.reduce(self.of_length, axis=0)[None], rows, axis=0)
        one = np.zeros_like(exact)
        longer, shorter = exact.copy(), np.zeros_like(exact)  # the word met has a letter more, or one fewer
        began = np.where((low == 0)[:, None], exact, np.uint64(0))
        ended = np.zeros_like(exact)
        for i in range(length):
            letter = codes[:, i]
            here = self.bits[i][letter]
            one = (one & here) | (exact & ~here)
            before = self.bits[i - 1][letter] if i else np.uint64(0)
            shorter = (shorter & before) | exact
            exact = exact & here
            longer = (longer & self.bits[i + 1][letter]) | exact
            began = np.where((low == i + 1)[:, None], exact, began)
            ended = np.where((high == i + 1)[:, None], exact, ended)
        if length == m:
            found = (one & self.of_length[m]) | (longer & self.of_length[m + 1])
        else:
            found = shorter & self.of_length[m]
        return found & began & ~ended


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Dense letter codes from 1 of every word, padded with 0, and the lengths."""
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    _, dense = np.unique(points, return_inverse=True)
    out = np.zeros((len(words), int(lengths.max())), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = dense + 1
    return out, lengths


def cell_neighbours(table: pa.Table) -> pa.Table:
    """Per row of a cell that has near words in it: their number, and the best of them."""
    words = table["word"].to_pylist()
    n, m, low, high = (table[c].to_numpy() for c in ("n", "m", "low", "high"))
    distinct = sorted(set(words))
    place = {w: k for k, w in enumerate(distinct)}
    own = np.array([place[w] for w in words])
    codes, lengths = _codes(distinct)
    index = PositionIndex(codes, lengths)
    total = np.zeros(len(distinct), np.int64)
    total[own] = n
    # Words by falling count, then in order: the first word of a set is its best.
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((np.arange(len(distinct)), -total))] = np.arange(len(distinct))
    by_rank = np.argsort(rank)
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(distinct))
    length = lengths[own]
    order = np.lexsort((m, length))
    cuts = np.flatnonzero(np.diff(length[order]) | np.diff(m[order])) + 1
    for group in np.split(order, cuts):
        for at in range(0, len(group), QUERIES):
            some = group[at : at + QUERIES]
            size = int(length[some[0]])
            sets = index.near(codes[own[some], :size], int(m[some[0]]), low[some], high[some])
            bits = np.unpackbits(sets.view(np.uint8), axis=1, bitorder="little", count=len(distinct))
            query, found = np.nonzero(bits)
            np.add.at(count, some[query], 1)
            np.minimum.at(best, some[query], rank[found])
    hit = np.flatnonzero(count)
    winner = by_rank[best[hit]]
    return pa.table(
        {
            "word": pa.array([words[k] for k in hit], pa.string()),
            "n_near": pa.array(count[hit], pa.int64()),
            "best_n": pa.array(total[winner], pa.int64()),
            "best": pa.array([distinct[k] for k in winner], pa.string()),
        }
    )


def neighbours(words: DataFrame, hot: int = HOT, cell: int = CELL) -> DataFrame:
    """``(word, n_near, best_n, best)`` of words that have others one edit apart."""
    # Long words get cells of their own, with fewer words: a cell's bitsets grow with its longest word.
    span = F.greatest(F.ceil(F.log2(F.col("m") / SHORT)), F.lit(0)).cast("int")
    rows = stored(_placed(words, hot).withColumn("span", span), "placed")
    sizes = dict(rows.groupBy("span").count().collect())  # one row per doubling of the length
    cells = F.lit([max(1, (sizes.get(k, 0) << k) // cell) for k in range(max(sizes, default=0) + 1)])
    dealt = rows.withColumn("cell", F.pmod(F.col("key"), F.get(cells, F.col("span")).cast("bigint")))
    near = dealt.groupBy("span", "cell").applyInArrow(cell_neighbours, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("k"), "best"))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select(
        "word", "n_near", (-F.col("first.k")).alias("best_n"), F.col("first.best").alias("best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words with a form: forms are followed by doubling, as counts grow tenfold a step."""
    current = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(current.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        current = step.select("word", "root")
        if step.where("moved").isEmpty():
            return current


def spelling_variants(docs: DataFrame, hot: int = HOT, cell: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (``doc_id``, ``text``)."""
    words = stored(count_words(docs), "words")
    near = neighbours(words, hot, cell)
    favoured = F.col("best_n") >= FAVOUR * F.col("n")
    known = stored(
        words.join(near, "word", "left").select(
            "word",
            F.when(favoured, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(favoured, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(known.where(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
