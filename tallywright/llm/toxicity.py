"""Toxicity from two Kneser-Ney models of expressions, one of toxic and one of ordinary texts.

Expressions are single words and pairs of neighbouring words, A-Z folded. In each class an
expression's discounted count backs off to counts that both classes share (in how many of
them it occurs), so that a rare expression is about as likely in either and says little. A
text's evidence is the difference of its two log-likelihoods over its distinct expressions,
divided by their number; ratios inside ``NOISE_FLOOR`` nats count as equal, as a class's mix of
languages alone shifts every common word by that order. A logistic curve, fitted on labelled rows that gave
no counts, maps the evidence to a probability.

The models come from a bounded sample of labelled rows (``SAMPLE_PER_CLASS`` texts of each
class, each at most ``SAMPLE_MAX_BYTES`` long), so their size is bounded; every whole text is
scored. Defined cases: null and empty texts have no evidence and get the score of evidence 0.
Without labelled rows of both classes every score is 0. A null id stays null; repeated rows
are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import byte_words as bw
from tallywright.llm.labelled import fit_calibration, id_remainder, labelled_sample, sigmoid

SKETCHES = 4
NOISE_FLOOR = 3.0
SAMPLE_PER_CLASS = 2000
SAMPLE_MAX_BYTES = 1 << 15
REJECT_FROM = 0.5
CALIBRATION_SHARE = 4  # every fourth sampled text gives no counts
SCORES = "doc_id bigint, held_out boolean, score double, predicted int"


class Models(NamedTuple):
    """``expressions`` ascending, with the log ratio of their two probabilities; the curve."""

    expressions: np.ndarray
    ratios: np.ndarray
    curve: np.ndarray


def expressions(part: bw.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct words and pairs of each text, and the text of each.

    An expression counts once per text, so a text that repeats itself is no stronger evidence.
    """
    found = bw.words(part, lower=True)
    pairs, bounds = bw.window_hashes(found, 2)
    keys = np.r_[found.hashes, pairs]
    text_of = np.r_[found.text_of(), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))]
    _, kept = np.unique(keys ^ bw.mix(text_of.astype(np.uint64) + np.uint64(1)), return_index=True)
    return keys[kept], text_of[kept]


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Kneser-Ney discounts of counts 1, 2 and more, from how often each count occurs."""
    n = np.bincount(np.minimum(counts, 4), minlength=5).astype(float)
    if n[1] == 0 or n[2] == 0:
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n[1] / (n[1] + 2 * n[2])
    more = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 2.0]
    return np.clip(np.array([0.0, *more]), 0.0, [0, 1, 2, 3])


def distinct_texts(texts: pa.Array) -> np.ndarray:
    """Places of texts of which no earlier one is a copy or a near copy.

    Copies would make chance expressions look typical of their class. Texts count as copies when
    one of four minima of hashed 4-word windows agrees.
    """
    salts = bw.randoms(SKETCHES, 21)
    met: set[tuple[int, int]] = set()
    out = []
    for part in bw.slices(texts, 1 << 16):
        found = bw.words(part, lower=True)
        windows, bounds = bw.window_hashes(found, 4)
        for i in range(len(bounds) - 1):
            own = windows[bounds[i] : bounds[i + 1]]
            if len(own) == 0:
                own = bw.mix(found.hashes[found.bounds[i] : found.bounds[i + 1]])
            if len(own) == 0:
                continue
            sketch = {(k, int(bw.mix(own ^ salt).min())) for k, salt in enumerate(salts)}
            if not sketch & met:
                out.append(part.first + i)
            met |= sketch
    return np.array(out, np.int64)


def count_models(texts: pa.Array, y: np.ndarray) -> Models:
    """Both classes' probabilities of every expression of the sample, as their log ratio."""
    counted = [(keys, y[part.first + text_of]) for part in bw.slices(texts, 1 << 16) for keys, text_of in [expressions(part)]]
    key, label = (np.concatenate(x) for x in zip(*counted, strict=True))
    known, place = np.unique(key, return_inverse=True)
    counts = [np.bincount(place[label == value], minlength=len(known)) for value in (0, 1)]
    shared = sum((count > 0).astype(float) for count in counts)
    shared /= max(shared.sum(), 1)
    logs = []
    for count in counts:
        total = max(count.sum(), 1)
        cut = _discounts(count)[np.minimum(count, 3)]
        logs.append(np.log((count - cut) / total + cut.sum() / total * shared + 1e-300))
    return Models(known, (logs[1] - logs[0]).astype(np.float32), np.zeros(2))


class Scorer:
    def __init__(self, models: Models) -> None:
        self.ratios = np.r_[models.ratios, np.float32(0)]  # the last: expressions not in the sample
        self.index = bw.HashIndex(models.expressions)

    def evidence(self, part: bw.Slice) -> np.ndarray:
        """Toxic minus ordinary log-likelihood per distinct expression; 0 without words."""
        keys, text_of = expressions(part)
        ratio = self.ratios[self.index.find(keys)]
        ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - NOISE_FLOOR, 0)
        n = len(part.offsets) - 1
        return np.bincount(text_of, ratio, n) / np.maximum(np.bincount(text_of, minlength=n), 1)


def curve_input(evidence: np.ndarray) -> np.ndarray:
    """Evidence on a scale that tells one strong expression among hundreds from none."""
    return np.arcsinh(1000.0 * evidence)


def fit(texts: pa.Array, y: np.ndarray) -> Models:
    """Counts from three quarters of the sample, the curve from the rest."""
    nothing = Models(np.zeros(0, np.uint64), np.zeros(0, np.float32), np.array([0.0, -40.0]))
    if len(y) == 0 or y.min() == y.max():
        return nothing
    own = distinct_texts(texts)
    texts, y = texts.take(pa.array(own)), y[own]
    aside = np.arange(len(y)) % CALIBRATION_SHARE == 0
    if len(np.unique(y[~aside])) < 2 or len(np.unique(y[aside])) < 2:
        return nothing
    counted = count_models(texts.filter(pa.array(~aside)), y[~aside])
    scorer = Scorer(counted)
    values = np.concatenate([scorer.evidence(part) for part in bw.slices(texts.filter(pa.array(aside)))])
    return counted._replace(curve=fit_calibration(curve_input(values)[:, None], y[aside]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Models:
    """Models of at most ``per_class`` labelled texts of each class."""
    return fit(*labelled_sample(docs, labels, "toxic", per_class, SAMPLE_MAX_BYTES))


def scores(scorer: Scorer, curve: np.ndarray, texts: pa.Array) -> np.ndarray:
    evidence = np.concatenate([scorer.evidence(part) for part in bw.slices(texts)])
    return sigmoid(curve[0] * curve_input(evidence) + curve[-1])


def without_toxic(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``text`` is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            if batch.num_rows:
                texts = batch["text"].cast(pa.binary())
                yield batch.filter(pa.array(scores(scorer, shared.value.curve, texts) < REJECT_FROM))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, models: Models, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Score and verdict per row of ``docs`` (``doc_id``, ``text``); ``held_out`` by the id's crc32."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        scorer = Scorer(models)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            score = scores(scorer, models.curve, batch["text"])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= REJECT_FROM).astype(np.int32)}
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (id_remainder(F.col("doc_id"), modulus) == remainder).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, SCORES)
