"""Quality rules: counted rules, then a hashed n-gram logistic regression.

The regression sees hashed words, hashed pairs of words (a word met twice in a row counts as
one pair of its own kind) and hashed character 5-grams, each as a share of its text. It is
fitted on a bounded sample of labelled rows, calibrated on rows left out of the fit, and
applied in Arrow batches; a text is kept when it passes the counted rules and its calibrated
probability reaches a fixed threshold.

Defined cases: a null text counts as an empty one, which fails the rules. Without labelled
rows of both classes every probability is 0.5 and the counted rules alone decide. A null id
stays null. Repeated rows are scored alike, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import byte_words as bw
from tallywright.llm.labelled import fit_calibration, labelled_sample, sigmoid

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5
BITS = 18
GRAM = 5
SAMPLE_PER_CLASS = 1200
SAMPLE_MAX_BYTES = 1 << 15

SCORES = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, probability double"
)


class Rules(NamedTuple):
    """Weights by bucket, and the calibration of their sum."""

    weights: np.ndarray
    scale: float
    shift: float


def repeats_by_text(keys: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys of texts: whether a key occurs again in its text, and whether it did before."""
    own = keys ^ bw.mix(text_of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    same = ordered[1:] == ordered[:-1]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, before


def duplicate_lines(part: bw.Slice) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, per text."""
    data, offsets = part.data, part.offsets
    n = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.r_[offsets[:-1], breaks + 1])
    start = start[start < len(data)]
    end = np.minimum(np.r_[start[1:], len(data)], len(data))
    end = np.where(data[end - 1] == 10, end - 1, end)
    solid = np.r_[0, np.cumsum(~bw.SPACE[data])]
    with_word = solid[end] > solid[start]
    start, end = start[with_word], end[with_word]
    hashes = bw.span_hashes(data, start, end, bw.RAW_VALUES)
    text_of = np.searchsorted(offsets, start, "right") - 1
    _, before = repeats_by_text(hashes, text_of)
    return np.bincount(text_of[before], minlength=n)


def repeated_words(found: bw.Words) -> np.ndarray:
    """Words inside 3-word windows that their text holds twice or more, per text."""
    n = len(found.bounds) - 1
    windows, bounds = bw.window_hashes(found, 3)
    counts = np.diff(bounds)
    text_of = np.repeat(np.arange(n), counts)
    again, _ = repeats_by_text(windows, text_of)
    first = (np.repeat(found.bounds[:-1] - bounds[:-1], counts) + np.arange(len(windows)))[again]
    covered = np.zeros(len(found.hashes), bool)
    for k in range(3):
        covered[first + k] = True
    return np.bincount(found.text_of()[covered], minlength=n)


def features(part: bw.Slice, found: bw.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets in order of the texts, and their bounds per text, for each kind of n-gram."""
    shift = np.uint64(64 - BITS)
    one = (bw.mix(found.hashes + np.uint64(11)) >> shift).astype(np.int64)
    pairs, pair_bounds = bw.window_hashes(found, 2)
    if len(pairs):
        first = np.repeat(found.bounds[:-1] - pair_bounds[:-1], np.diff(pair_bounds)) + np.arange(len(pairs))
        pairs = np.where(found.hashes[first] == found.hashes[first + 1], np.uint64(1), pairs)
    two = (bw.mix(pairs + np.uint64(13)) >> shift).astype(np.int64)
    n = len(part.data) - GRAM + 1
    if n > 0:
        wide = part.data.astype(np.uint64)
        grams = np.zeros(n, np.uint64)
        for k in range(GRAM):
            grams = (grams << np.uint64(8)) | wide[k : n + k]
        grams = (grams * np.uint64(bw.STEP) >> shift).astype(np.int64)
    else:
        grams = np.zeros(0, np.int64)
    # A gram belongs to the text it begins in; those that reach into the next are left out.
    begin = np.minimum(part.offsets[:-1], max(n, 0))
    stop = np.clip(part.offsets[1:] - GRAM + 1, begin, max(n, 0))
    return [(one, found.bounds), (two, pair_bounds), (grams, np.stack([begin, stop]))]


def _mean(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    begin, stop = bounds if bounds.ndim == 2 else (bounds[:-1], bounds[1:])
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return (total[stop] - total[begin]) / np.maximum(stop - begin, 1)


def margins(weights: np.ndarray, kinds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return sum(_mean(weights[k][buckets], bounds) for k, (buckets, bounds) in enumerate(kinds))


def fit(texts: pa.Array, y: np.ndarray, rounds: int = 30, rate: float = 1.0) -> Rules:
    """Weights by Adagrad on two thirds of the sample, calibration on the rest."""
    weights = np.zeros((3, 1 << BITS))
    if len(y) == 0 or y.min() == y.max():
        return Rules(weights.astype(np.float32), 0.0, 0.0)
    parts = []
    for part in bw.slices(texts, 1 << 16):
        parts.append((features(part, bw.words(part)), part.first, part.last))
    fitted = np.arange(len(y)) % 3 != 2
    share = np.where(y == 1, 0.5 / max(1, (y[fitted] == 1).sum()), 0.5 / max(1, (y[fitted] == 0).sum())) * fitted
    squares = np.full_like(weights, 1e-10)
    for _ in range(rounds):
        gradient = np.zeros_like(weights)
        for kinds, first, last in parts:
            error = (sigmoid(margins(weights, kinds)) - y[first:last]) * share[first:last]
            for k, (buckets, bounds) in enumerate(kinds):
                begin, stop = bounds if bounds.ndim == 2 else (bounds[:-1], bounds[1:])
                steps = np.zeros(len(buckets) + 1)
                each = error / np.maximum(stop - begin, 1)
                np.add.at(steps, begin, each)
                np.add.at(steps, stop, -each)
                gradient[k] += np.bincount(buckets, np.cumsum(steps[:-1]), 1 << BITS)
        squares += gradient**2
        weights -= rate * gradient / np.sqrt(squares)
    weights = weights.astype(np.float32)
    values = np.concatenate([margins(weights, kinds) for kinds, _, _ in parts])
    scale, shift = fit_calibration(values[~fitted][:, None], y[~fitted])
    return Rules(weights, float(scale), float(shift))


def judge(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """Counts and verdicts of one Arrow batch of binary texts."""
    out: dict[str, list[np.ndarray]] = {}
    for part in bw.slices(texts):
        found = bw.words(part)
        n_words = found.counts
        points = np.r_[0, np.cumsum(((part.data & 0xC0) != 0x80) & ~bw.SPACE[part.data])]
        symbols = np.r_[0, np.cumsum(SYMBOLS[part.data])]
        repeat = repeated_words(found)
        failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
        probability = sigmoid(rules.scale * margins(rules.weights, features(part, found)) + rules.shift)
        row = {
            "n_words": n_words,
            "word_chars": np.diff(points[part.offsets]),
            "n_symbols": np.diff(symbols[part.offsets]),
            "n_dup_lines": duplicate_lines(part),
            "n_repeat_words": repeat,
            "base_failed": failed,
            "kept": ~failed & (probability >= KEEP_FROM),
            "probability": probability,
        }
        for name, values in row.items():
            out.setdefault(name, []).append(values)
    return {name: np.concatenate(values) for name, values in out.items()}


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Rules:
    """Fit on at most ``per_class`` labelled texts of either quality, each at most 32 KiB."""
    return fit(*labelled_sample(docs, labels, "quality", per_class, SAMPLE_MAX_BYTES))


def quality_rules(docs: DataFrame, rules: Rules) -> DataFrame:
    """One row of counts, probability and verdict per row of ``docs`` (``doc_id``, ``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], **judge(batch["text"], shared.value)})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCORES)


def without_failed(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judge(batch["text"].cast(pa.binary()), shared.value)["kept"]))

    return docs.mapInArrow(run, docs.schema)
