"""Quality from a convolutional network over bytes, trained and run in numpy.

Every text is cut into overlapping chunks that cover it whole. A symbol is a byte with a flag
that says whether the four bytes up to it occurred a short distance before, so that filters
can see repetition as well as characters. Filters of ``WIDTH`` symbols slide over each chunk;
their largest response in a chunk is rectified, and the mean and maximum over the chunks enter one
logistic unit.

The network is trained on a bounded sample of labelled rows (``SAMPLE_PER_CLASS`` texts of
each class, each at most ``SAMPLE_MAX_BYTES`` long) and scores every whole text. Defined
cases: null and empty texts are one chunk of padding. Without labelled rows of both classes
every score is 0.5. A null id stays null; repeated rows are scored alike.
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

CHUNK = 256
WIDTH = 6
STRIDE = CHUNK - WIDTH + 1  # neighbouring chunks share WIDTH - 1 symbols: no window is lost
FILTERS = 12
DIMENSIONS = 8
SYMBOLS = 513  # a byte, a repeated byte, padding
PAD = 512
LAGS = range(4, 25)
SAMPLE_PER_CLASS = 800
SAMPLE_MAX_BYTES = 1 << 13
PREDICT_FROM = 0.7
SCORES = "doc_id bigint, held_out boolean, score double, predicted int"


class Network(NamedTuple):
    taps: np.ndarray  # WIDTH x SYMBOLS x FILTERS: responses of each place of the filters
    bias: np.ndarray
    mean_weights: np.ndarray
    max_weights: np.ndarray
    constant: float
    curve: np.ndarray


def symbols(part: bw.Slice) -> np.ndarray:
    """Symbols of a slice's bytes. A repetition never reaches back into another text."""
    data = part.data
    n = len(data)
    out = data.astype(np.int16)
    if n < 8:
        return out
    grams = np.zeros(n, np.uint32)
    wide = data.astype(np.uint32)
    grams[3:] = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    place = np.minimum(np.arange(n) - np.repeat(part.offsets[:-1], np.diff(part.offsets)), 127).astype(np.int8)
    repeated = np.zeros(n, bool)
    for lag in LAGS:
        if lag + 3 < n:
            repeated[lag:] |= (grams[lag:] == grams[:-lag]) & (place[lag:] >= lag + 3)
    return out + 256 * repeated


def chunks(part: bw.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the texts as rows of symbols, padded at the end, and the chunk bounds per text."""
    stream = np.r_[symbols(part), np.full(CHUNK, PAD, np.int16)]
    length = np.diff(part.offsets)
    n_chunks = np.maximum(-(-np.maximum(length - WIDTH + 1, 1) // STRIDE), 1)
    bounds = np.r_[0, np.cumsum(n_chunks)]
    nth = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n_chunks)
    start = np.repeat(part.offsets[:-1], n_chunks) + nth * STRIDE
    room = np.repeat(part.offsets[1:], n_chunks) - start
    windows = np.lib.stride_tricks.sliding_window_view(stream, CHUNK)[start]
    short = np.flatnonzero(room < CHUNK)
    windows = windows.copy()
    windows[short] = np.where(np.arange(CHUNK) < room[short, None], windows[short], PAD)
    return windows, bounds


def responses(windows: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Filter responses: chunk x place x filter."""
    out = taps[0][windows[:, :STRIDE]]
    for k in range(1, WIDTH):
        out += taps[k][windows[:, k : STRIDE + k]]
    return out


def _pooled(peaks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = np.add.reduceat(peaks, bounds[:-1], axis=0) / np.diff(bounds)[:, None]
    return mean, np.maximum.reduceat(peaks, bounds[:-1], axis=0)


def margins(network: Network, part: bw.Slice) -> np.ndarray:
    windows, bounds = chunks(part)
    peaks = np.empty((len(windows), FILTERS), np.float32)
    for at in range(0, len(windows), 64):  # a block of responses stays in the cache
        peaks[at : at + 64] = responses(windows[at : at + 64], network.taps).max(axis=1)
    peaks = np.maximum(peaks + network.bias, 0)
    mean, largest = _pooled(peaks, bounds)
    return mean @ network.mean_weights + largest @ network.max_weights + network.constant


class _Adam:
    def __init__(self, shapes: list[tuple[int, ...]], rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m = [np.zeros(s, np.float32) for s in shapes]
        self.v = [np.zeros(s, np.float32) for s in shapes]

    def step(self, params: list[np.ndarray], gradients: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(params, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def fit(texts: pa.Array, y: np.ndarray, steps: int = 300, batch: int = 32, rate: float = 0.02, seed: int = 5) -> Network:
    """Train by Adam on four fifths of the sample; calibrate on the rest."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.3, (SYMBOLS, DIMENSIONS)).astype(np.float32)
    filters = rng.normal(0, 0.3, (WIDTH, DIMENSIONS, FILTERS)).astype(np.float32)
    bias = np.zeros(FILTERS, np.float32)
    top = rng.normal(0, 0.1, (2, FILTERS)).astype(np.float32)
    constant = np.zeros(1, np.float32)
    params = [embed, filters, bias, top, constant]

    def network(curve: np.ndarray) -> Network:
        taps = np.einsum("sd,kdf->ksf", embed, filters)
        return Network(taps, bias, top[0], top[1], float(constant[0]), curve)

    if len(y) == 0 or y.min() == y.max():
        return network(np.zeros(2))
    aside = np.arange(len(y)) % 5 == 0
    chunked, at = [], 0
    for part in bw.slices(texts, 1 << 16):
        windows, bounds = chunks(part)
        chunked += [windows[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        at = part.last
    assert at == len(y)
    train = np.flatnonzero(~aside)
    weight = np.where(y == 1, 0.5 / (y[train] == 1).mean(), 0.5 / max((y[train] == 0).mean(), 1e-9)) if 0 < y[train].mean() < 1 else np.ones(len(y))
    adam = _Adam([p.shape for p in params], rate)
    while adam.t < steps:
        order = rng.permutation(train)
        for first in range(0, len(order), batch):
            ids = order[first : first + batch]
            windows = np.concatenate([chunked[i] for i in ids])
            counts = np.array([len(chunked[i]) for i in ids])
            bounds = np.r_[0, np.cumsum(counts)]
            taps = np.einsum("sd,kdf->ksf", embed, filters)
            response = responses(windows, taps)
            place = response.argmax(axis=1)
            rows, cols = np.arange(len(windows))[:, None], np.arange(FILTERS)[None, :]
            peaks = np.maximum(response[rows, place, cols] + bias, 0)
            mean, largest = _pooled(peaks, bounds)
            error = (sigmoid(mean @ top[0] + largest @ top[1] + constant[0]) - y[ids]) * weight[ids] / len(ids)
            by_chunk = np.repeat(np.arange(len(ids)), counts)
            to_peaks = (error / counts)[by_chunk, None] * top[0] + (peaks == largest[by_chunk]) * error[by_chunk, None] * top[1]
            to_peaks = (to_peaks * (peaks > 0)).astype(np.float32)
            to_taps = np.zeros_like(taps)
            for k in range(WIDTH):
                np.add.at(to_taps[k], (windows[rows, place + k], np.broadcast_to(cols, place.shape)), to_peaks)
            gradients = [
                np.einsum("ksf,kdf->sd", to_taps, filters),
                np.einsum("sd,ksf->kdf", embed, to_taps),
                to_peaks.sum(axis=0),
                np.stack([error @ mean, error @ largest]).astype(np.float32),
                np.array([error.sum()], np.float32),
            ]
            adam.step(params, gradients)
    raw = network(np.array([1.0, 0.0]))
    values = np.concatenate([margins(raw, part) for part in bw.slices(texts)])
    return raw._replace(curve=fit_calibration(values[aside][:, None], y[aside]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Network:
    """Train on at most ``per_class`` labelled texts of either quality, each at most 8 KiB."""
    return fit(*labelled_sample(docs, labels, "quality", per_class, SAMPLE_MAX_BYTES))


def byte_quality(docs: DataFrame, network: Network, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Score and prediction per row of ``docs`` (``doc_id``, ``text``); ``held_out`` by the id's crc32."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            if batch.num_rows:
                margin = np.concatenate([margins(network, part) for part in bw.slices(batch["text"], 1 << 16)])
                score = sigmoid(network.curve[0] * margin + network.curve[-1])
                predicted = (score >= PREDICT_FROM).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": predicted})

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (id_remainder(F.col("doc_id"), modulus) == remainder).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, SCORES)
