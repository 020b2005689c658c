"""Packing of tokenised documents into fixed-length sequences by column generation.

Documents are cut into full sequences and one remainder each. The remainders' lengths, in
units of ``UNIT`` tokens, form a cutting-stock problem over a bounded histogram: a linear
program over patterns of lengths, whose columns a knapsack dynamic program prices, is solved on the
driver; its solution is rounded down, and the lengths left over are packed best fit first. Patterns
then meet the pieces, ranked inside each length, and offsets are running sums inside a sequence.

Only the histogram and the patterns reach the driver; both are bounded by the number of
lengths. Ranks are taken in cells of about ``CELL`` pieces, so a length that a third of all
pieces share is spread. Defined cases: a null or empty text is the closing id alone.
Repeated rows are packed once each; a null id stays null. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.byte_words import LOWER_VALUES, HashIndex, Slice, Words, slices, span_hashes, words
from tallywright.session import stored

CAPACITY = 2048
UNIT = 4
CELL = 4096
END_ID = 1
CACHE_ENTRIES = 600_000
SLICE_BYTES = 1 << 21
MARK, LETTER = np.zeros(256, bool), np.zeros(256, bool)
MARK[list(b".,!?;:|")] = True
LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
#: Letters before this one have one form only and fold one to one.
LATIN_END = "\u0250"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _letters_of_bytes() -> dict[int, str]:
    """The letter by which byte-level tokenizers write each byte: itself if it is visible, else one after U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class ChunkTokenizer:
    """Token ids of whole texts, from the ids of their chunks between ASCII white space.

    The tokenizer drops white space, folds case and no token spans white space, so a text's ids are
    those of its chunks in order, whatever their ASCII case; a letter and a mark after it are never in one
    token either. Chunks are known by the 64-bit hash of their bytes. The ids of those met before lie
    in one array and are gathered for a whole slice of texts; new ones are encoded once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = _letters_of_bytes()
        self.as_letters = "".join(letters[b] for b in range(256))
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.uint64)
        # Two indexes, so that learning a slice's chunks does not rebuild a long one.
        self.old, self.recent = HashIndex(none), HashIndex(none)
        self.old_place, self.recent_place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's texts, each with the closing id, and the bounds of each text's ids."""
        found = words(part)
        start, end, bounds = self._apart(part.data, found)
        hashes = span_hashes(part.data, start, end, LOWER_VALUES)
        place = self._places(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            if len(self.start) and len(self.start) + len(new) > CACHE_ENTRIES:
                self._forget()
                new, at = np.unique(hashes, return_index=True)
            raw = part.data.tobytes()
            self._learn(new, [raw[a:b].lower() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            place = self._places(hashes)
        length = self.length[place]
        before = np.r_[0, np.cumsum(length)]
        picked = self.ids[np.repeat(self.start[place] - before[:-1], length) + np.arange(before[-1])]
        counts = np.diff(before[bounds])
        out = np.full(len(picked) + len(counts), END_ID, np.uint32)
        out[np.arange(len(picked)) + np.repeat(np.arange(len(counts)), counts)] = picked
        return self._with_special(part, out, np.r_[0, np.cumsum(counts + 1)])

    @staticmethod
    def _apart(data: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks with the mark after a last letter as a chunk of its own, and their bounds."""
        last = found.end - 1
        marked = (found.end - found.start > 1) & MARK[data[last]]
        marked &= LETTER[data[np.maximum(last - 1, 0)]]
        first = np.arange(len(marked)) + np.r_[0, np.cumsum(marked)[:-1]].astype(np.int64)[: len(marked)]
        size = len(marked) + int(marked.sum())
        start, end = np.empty(size, np.int64), np.empty(size, np.int64)
        start[first], end[first] = found.start, found.end - marked
        after = first[marked] + 1
        start[after], end[after] = last[marked], found.end[marked]
        return start, end, found.bounds + np.r_[0, np.cumsum(marked)][found.bounds]

    def _with_special(self, part: Slice, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that may hold a special token are encoded whole."""
        if not ((part.data[:-1] == 60) & (part.data[1:] == 124)).any():
            return ids, bounds
        each = []
        for k, (a, b) in enumerate(zip(part.offsets[:-1], part.offsets[1:], strict=True)):
            text = part.data[a:b].tobytes()
            own = ids[bounds[k] : bounds[k + 1]]
            if b"<|" in text:
                own = np.array([*self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, END_ID], np.uint32)
            each.append(own)
        return np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        out = self.old.find(hashes)
        hit = out >= 0
        out[hit] = self.old_place[out[hit]]
        left = np.flatnonzero(~hit)
        there = self.recent.find(hashes[left])
        out[left[there >= 0]] = self.recent_place[there[there >= 0]]
        return out

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        """``keys`` are distinct, ascending and not known."""
        ids = self._encoded(chunks)
        length = np.array([len(x) for x in ids], np.int64)
        first = len(self.start)
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(length) - length]
        self.length = np.r_[self.length, length]
        self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))]
        merged = np.r_[self.recent.keys, keys]
        place = np.r_[self.recent_place, np.arange(first, first + len(keys))]
        if len(merged) > max(1 << 16, len(self.old.keys) // 4):
            merged, place = np.r_[self.old.keys, merged], np.r_[self.old_place, place]
            order = np.argsort(merged, kind="stable")
            self.old, self.old_place = HashIndex(merged[order]), place[order]
            self.recent, self.recent_place = HashIndex(np.zeros(0, np.uint64)), np.zeros(0, np.int64)
        else:
            order = np.argsort(merged, kind="stable")
            self.recent, self.recent_place = HashIndex(merged[order]), place[order]

    def _encoded(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of chunks; those of Latin letters alone are one word, and go to the model at once."""
        model, letters = self.tokenizer.model, self.as_letters
        out: list[list[int]] = [[]] * len(chunks)
        others = []
        for k, c in enumerate(chunks):
            if c.isalpha():
                out[k] = [t.id for t in model.tokenize(c.decode())]
            elif not c.isascii() and (word := c.decode("utf-8", "replace").lower()).isalpha() and max(word) < LATIN_END:
                out[k] = [t.id for t in model.tokenize("".join([letters[b] for b in word.encode()]))]
            else:
                others.append(k)
        found = self.tokenizer.encode_batch_fast([chunks[k].decode("utf-8", "replace") for k in others], add_special_tokens=False)
        for k, encoding in zip(others, found, strict=True):
            out[k] = encoding.ids
        return out


@cache
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process, so that later tasks know the chunks of earlier ones."""
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Full pieces and the remainder of every row of ``docs`` (``doc_id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokenizer(tokenizer_path)
        for batch in batches:
            for part in slices(batch["text"], SLICE_BYTES):
                ids, bounds = tokenizer.encode(part)
                data = memoryview(ids.astype("<u4").tobytes())
                sizes = np.diff(bounds)
                cuts = -(-sizes // capacity)
                of = np.repeat(np.arange(len(sizes)), cuts)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
                length = np.minimum(sizes[of] - start, capacity)
                first = 4 * (bounds[of] + start)
                sums = [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                columns = {"start": start, "length": length, "ids_crc32": sums, "doc_tokens": sizes[of]}
                values = {name: pa.array(c, pa.int64()) for name, c in columns.items()}
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array(of + part.first)), **values})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, PIECES)


class Pattern(NamedTuple):
    """``count`` sequences that hold these lengths (in units)."""

    lengths: tuple[int, ...]
    count: int


def _best_column(prices: np.ndarray, lengths: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of lengths within ``room`` of the highest price."""
    by_length = np.full(room + 1, -np.inf)
    by_length[lengths] = prices
    best = np.zeros(room + 1)
    pick = np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        values = by_length[1 : c + 1] + best[c - 1 :: -1]
        k = int(values.argmax())
        if values[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = values[k], k + 1
        else:
            best[c] = best[c - 1]
    column = np.zeros(room + 1)
    c = room
    while c > 0:
        if pick[c]:
            column[pick[c]] += 1
            c -= pick[c]
        else:
            c -= 1
    return best[room], column[lengths]


def best_fit(pieces: list[int], room: int) -> list[list[int]]:
    """Pieces, longest first, each into the fullest sequence that has room."""
    spaces: list[list[list[int]]] = [[] for _ in range(room + 1)]
    for length in sorted(pieces, reverse=True):
        space = next((s for s in range(length, room + 1) if spaces[s]), None)
        sequence = spaces[space].pop() if space is not None else []
        space = room if space is None else space
        spaces[space - length].append([*sequence, length])
    return sorted(s for some in spaces for s in some)


def _first_columns(lengths: np.ndarray, need: np.ndarray, room: int, most: int = 5000) -> np.ndarray:
    """Patterns of a best-fit packing of the histogram, scaled down to about ``most`` pieces."""
    some = np.ceil(need * min(1.0, most / need.sum())).astype(np.int64)
    packed = {tuple(s) for s in best_fit(np.repeat(lengths, some).tolist(), room)}
    columns = np.zeros((len(packed), room + 1))
    for row, sequence in zip(columns, sorted(packed), strict=True):
        np.add.at(row, list(sequence), 1)
    return columns[:, lengths]


def generate_columns(demand: np.ndarray, room: int, tolerance: float = 1e-4, most: int = 60_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solve the linear program by column generation: lengths, columns and their amounts.

    ``demand[l]`` pieces have length ``l``. A column comes from those met so far while one of them
    pays, else from the knapsack. Ends when the knapsack finds none that pays, or when its best price
    proves the amount of sequences to be within ``tolerance`` of the optimum (prices over the best price are a
    solution of the dual program).
    """
    lengths = np.flatnonzero(demand[: room + 1])
    need = demand[lengths].astype(float)
    basis = np.diag((room // lengths).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    amounts = inverse @ need
    pool = _first_columns(lengths, need, room)
    for step in range(most):
        prices = inverse.sum(axis=0)
        values = pool @ prices
        column = pool[values.argmax()]
        if values.max() <= 1 + 1e-7:
            value, column = _best_column(prices, lengths, room)
            if value <= 1 + 1e-7 or amounts.sum() <= need @ prices / value * (1 + tolerance):
                break
            pool = np.concatenate([pool, column[None]])
        direction = inverse @ column
        positive = direction > 1e-9
        ratios = np.full(len(need), np.inf)
        ratios[positive] = np.maximum(amounts[positive], 0) / direction[positive]
        out = int(ratios.argmin())
        basis[:, out] = column
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
        amounts = inverse @ need
    return lengths, basis, np.maximum(amounts, 0)


def plan_patterns(demand: np.ndarray, room: int) -> list[Pattern]:
    """Whole patterns that hold every piece exactly once."""
    if not demand.any():
        return []
    lengths, columns, amounts = generate_columns(demand, room)
    left = demand[lengths].astype(np.int64)
    out = []
    for k in np.argsort(-amounts):
        column = np.rint(columns[:, k]).astype(np.int64)
        used = column > 0
        count = int(min(np.floor(amounts[k] + 1e-6), (left[used] // column[used]).min()))
        if count > 0:
            left -= count * column
            out.append(Pattern(tuple(np.repeat(lengths, column)[::-1].tolist()), count))
    # What rounding left.
    out += [Pattern(tuple(s), 1) for s in best_fit(np.repeat(lengths, left).tolist(), room)]
    return out


class Slots(NamedTuple):
    """Where the pieces of one length go, by rank: runs of slots of one pattern."""

    first_rank: np.ndarray
    per_sequence: np.ndarray
    first_sequence: np.ndarray
    first_slot: np.ndarray


def slots_by_length(patterns: list[Pattern], room: int) -> tuple[list[Slots], int]:
    runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(room + 1)]
    ranks, sequence = [0] * (room + 1), 0
    for pattern in patterns:
        for length in sorted(set(pattern.lengths)):
            times, slot = pattern.lengths.count(length), pattern.lengths.index(length)
            runs[length].append((ranks[length], times, sequence, slot))
            ranks[length] += times * pattern.count
        sequence += pattern.count
    return [Slots(*np.array(r or [(0, 1, 0, 0)], np.int64).T) for r in runs], sequence


def _ranked(rows: DataFrame, sizes: np.ndarray) -> DataFrame:
    """Rank from 0 inside each length, by cells of bounded size."""
    cells = F.lit([max(1, -(-int(n) // CELL)) for n in sizes])
    # By a row's place in the stored table, so that rows that repeat exactly are dealt as well.
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.get(cells, F.col("units")).cast("bigint"))
    rows = stored(rows.withColumn("salt", salt), "pieces")
    own = Window.partitionBy("units", "salt").orderBy("doc_id", "start", "ids_crc32")
    counts = rows.groupBy("units", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("units").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("units", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = rows.withColumn("place", F.row_number().over(own) - 1)
    return ranked.join(offsets, ["units", "salt"]).withColumn("rank", F.col("first") + F.col("place"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    room = capacity // unit
    cut = stored(pieces(docs, tokenizer_path, capacity).withColumn("units", F.ceil(F.col("length") / unit).cast("int")), "cut")
    sizes = np.zeros(room + 1, np.int64)
    for row in cut.groupBy("units").count().collect():  # at most one row per length
        sizes[row[0]] = row[1]
    demand = sizes.copy()
    demand[room] = 0
    patterns = plan_patterns(demand, room)
    if sizes[room]:
        patterns.append(Pattern((room,), int(sizes[room])))
    slots, _ = slots_by_length(patterns, room)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, rank = batch["units"].to_numpy(), batch["rank"].to_numpy()
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for length in np.unique(units):
                mine, s = units == length, slots[length]
                k = np.searchsorted(s.first_rank, rank[mine], "right") - 1
                nth, place = np.divmod(rank[mine] - s.first_rank[k], s.per_sequence[k])
                sequence[mine], slot[mine] = s.first_sequence[k] + nth, s.first_slot[k] + place
            out = batch.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.append_column("sequence_id", pa.array(sequence)).append_column("slot", pa.array(slot))

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = _ranked(cut, sizes).select(*columns, "units", "rank").mapInArrow(run, f"{PIECES}, sequence_id bigint, slot bigint")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return placed.select(*columns, "sequence_id", offset)
