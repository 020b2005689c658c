"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

Every token belongs to a class: each of the most frequent words is one, all others share the
class of their shape (last character, length, letters beyond ASCII). The model predicts the
class of a token from the classes of the two before it, ``(c1[u] + c2[v]) . r[w] + b[w]``; a
token outside the frequent words then has its share of its class by corpus counts. Both steps
are normalised: the first by matrix products over all classes for every context met.

Counts cover every training text. So does training: each task runs one pass of
noise-contrastive steps in numpy over its texts' class triples, from a common start, and the
parameters are averaged by weight in Spark. Noise follows the counted class frequencies.

Words are known by a 64-bit hash. Counts of words frequent enough to fit ``FREQUENT`` entries
are held by every task; the others are joined, pre-aggregated per text. Defined cases: a null
or empty text is the end token alone. Without training texts all counts are 0, the base score
is 0 per token, and the model is its start. A null id stays null and counts as the empty id
for the split; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import byte_words as bw
from tallywright.llm.labelled import id_remainder, sigmoid
from tallywright.session import stored

WORD_CLASSES = 480
SHAPES = 24
END, START = WORD_CLASSES + SHAPES, WORD_CLASSES + SHAPES + 1
CLASSES = START  # START is a context only and never predicted
DIMENSIONS = 16
NOISE = 64
BATCH = 4096
RATE = 0.15
FREQUENT = 1 << 17
END_HASH = np.uint64(0x454E44)
LOG10 = float(np.log(10.0))

COUNTS = "word bigint, shape int, n bigint"
PARTIAL = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
    "rare array<bigint>, rare_n array<bigint>"
)

_LAST = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((b".?;:", b",", b"!|", b"#*$%&", b"0123456789"), 1):
    _LAST[list(_bytes)] = _kind


def shapes_of(part: bw.Slice, found: bw.Words) -> np.ndarray:
    """Shape of each word: kind of its last byte, length over 6 bytes, bytes beyond ASCII."""
    wide = np.r_[0, np.cumsum(part.data >= 128)]
    beyond = wide[found.end] > wide[found.start]
    return _LAST[part.data[found.end - 1]] * 4 + (found.end - found.start > 6) * 2 + beyond


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, shape, n)`` of all tokens of ``texts`` (a binary column ``text``), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bw.slices(batch["text"], 1 << 22):
                found = bw.words(part, lower=True)
                hashes, first, n = np.unique(found.hashes, return_index=True, return_counts=True)
                shape = shapes_of(part, found)[first]
                yield pa.RecordBatch.from_pydict(
                    {
                        "word": np.r_[hashes, END_HASH].view(np.int64),
                        "shape": np.r_[shape, -1].astype(np.int32),
                        "n": np.r_[n, part.last - part.first].astype(np.int64),
                    }
                )

    return texts.mapInArrow(run, COUNTS).groupBy("word", "shape").agg(F.sum("n").alias("n"))


class Counts(NamedTuple):
    """What every task holds of the counts."""

    total: int
    kinds: int
    frequent: np.ndarray  # hashes, ascending
    frequent_n: np.ndarray
    frequent_class: np.ndarray  # of the frequent words: their own class or their shape's
    class_n: np.ndarray  # tokens by class
    shape_base: np.ndarray  # by shape: tokens plus kinds plus one, outside the word classes


def gather(counts: DataFrame, frequent: int = FREQUENT) -> Counts:
    """Totals, and the words frequent enough, from the table of counts.

    The threshold is read off a histogram of counts, so that at most ``frequent`` words pass it.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    cells = counts.groupBy("shape", level.alias("level")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("tokens")).collect()
    total, kinds = sum(c.tokens for c in cells), sum(c.kinds for c in cells)
    by_level: dict[int, int] = {}
    for c in cells:
        by_level[c.level] = by_level.get(c.level, 0) + c.kinds
    least, room = None, frequent
    for step in sorted(by_level, reverse=True):
        room -= by_level[step]
        if room < 0:
            break
        least = step
    # At most ``frequent`` rows reach the driver.
    picked = counts.where(level >= least).toArrow() if least is not None else pa.table({"word": pa.array([], pa.int64()), "shape": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
    word = picked["word"].to_numpy().view(np.uint64)
    shape, n = picked["shape"].to_numpy().astype(np.int64), picked["n"].to_numpy()
    order = np.argsort(word)
    word, shape, n = word[order], shape[order], n[order]
    cls = np.where(shape < 0, END, WORD_CLASSES + shape)
    common = np.lexsort((word, -n))
    common = common[shape[common] >= 0][:WORD_CLASSES]
    cls[common] = np.arange(len(common))
    class_n, shape_base = np.zeros(CLASSES), np.ones(SHAPES)
    for c in cells:
        if c.shape >= 0:
            shape_base[c.shape] += c.tokens + c.kinds
            class_n[WORD_CLASSES + c.shape] += c.tokens
        else:
            class_n[END] += c.tokens
    np.add.at(shape_base, shape[common], -(n[common] + 1.0))
    np.add.at(class_n, WORD_CLASSES + shape[common], -n[common].astype(float))
    class_n[: len(common)] = n[common]
    return Counts(int(total), int(kinds), word, n, cls, class_n, shape_base)


class Parameters(NamedTuple):
    first: np.ndarray
    second: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def start_parameters(class_n: np.ndarray, seed: int = 3) -> Parameters:
    rng = np.random.default_rng(seed)

    def vectors(n: int) -> np.ndarray:
        return rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32)

    share = (class_n + 0.5) / (class_n + 0.5).sum()
    return Parameters(vectors(START + 1), vectors(START + 1), vectors(CLASSES), np.log(share).astype(np.float32))


def class_stream(part: bw.Slice, found: bw.Words, index: bw.HashIndex, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens, ends included, and of the two before each; places of the words.

    ``at`` gives the token place of every word; ends stand after their text's last word.
    """
    place = index.find(found.hashes)
    cls = WORD_CLASSES + shapes_of(part, found)
    if len(counts.frequent):
        cls = np.where(place >= 0, counts.frequent_class[place], cls)
    n = len(found.bounds) - 1
    at = np.arange(len(place)) + found.text_of()
    tokens = np.full(len(place) + n, END)
    tokens[at] = cls
    begins = found.bounds[:-1] + np.arange(n)
    before = np.r_[START, tokens[:-1]] if len(tokens) else tokens
    before[begins] = START
    earlier = np.r_[START, before[:-1]] if len(tokens) else tokens
    earlier[begins] = START
    return tokens, earlier, before, place


class Trainer:
    """One pass of noise-contrastive steps, with Adagrad rates."""

    def __init__(self, start: Parameters, class_n: np.ndarray, seed: int) -> None:
        self.p = Parameters(*(x.copy() for x in start))
        self.squares = Parameters(*(np.full_like(x, 1e-4) for x in start))
        share = (class_n + 0.5) / (class_n + 0.5).sum()
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.cumulative = np.cumsum(share)
        self.rng = np.random.default_rng(seed)
        self.weight = 0.0

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, weight: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), CLASSES - 1)
        share = (weight / weight.sum()).astype(np.float32)
        context = p.first[u] + p.second[v]
        true = np.einsum("ij,ij->i", context, p.out[w]) + p.bias[w] - self.log_noise[w]
        false = context @ p.out[noise].T + (p.bias - self.log_noise)[noise]
        to_true = (sigmoid(true) - 1).astype(np.float32) * share
        to_false = sigmoid(false).astype(np.float32) * share[:, None]
        to_context = to_true[:, None] * p.out[w] + to_false @ p.out[noise]
        gradient = Parameters(*(np.zeros_like(x) for x in p))
        np.add.at(gradient.first, u, to_context)
        np.add.at(gradient.second, v, to_context)
        np.add.at(gradient.out, w, to_true[:, None] * context)
        np.add.at(gradient.out, noise, to_false.T @ context)
        np.add.at(gradient.bias, w, to_true)
        np.add.at(gradient.bias, noise, to_false.sum(axis=0))
        for x, g, s in zip(p, gradient, self.squares, strict=True):
            s += g * g
            x -= RATE * g / np.sqrt(s)

    def learn(self, tokens: np.ndarray, earlier: np.ndarray, before: np.ndarray) -> None:
        """Steps over the distinct triples of a slice, weighted by how often each occurs."""
        width = START + 1
        triples, n = np.unique((earlier * width + before) * width + tokens, return_counts=True)
        order = self.rng.permutation(len(triples))
        triples, n = triples[order], n[order]
        for at in range(0, len(triples), BATCH):
            some = triples[at : at + BATCH]
            self.step(some // (width * width), some // width % width, some % width, n[at : at + BATCH])
        self.weight += float(n.sum())


def _flat(p: Parameters) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p])


def _unflat(values: np.ndarray, like: Parameters) -> Parameters:
    out, at = [], 0
    for x in like:
        out.append(values[at : at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    return Parameters(*out)


def train(texts: DataFrame, counts: Counts) -> Parameters:
    """Parameters averaged over tasks, each of which passes once over its texts."""
    start = start_parameters(counts.class_n)
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        index, trainer = bw.HashIndex(counts.frequent), None
        for batch in batches:
            for part in bw.slices(batch["text"], 1 << 21):
                found = bw.words(part, lower=True)
                tokens, earlier, before, _ = class_stream(part, found, index, counts)
                trainer = trainer or Trainer(start, counts.class_n, len(tokens))
                trainer.learn(tokens, earlier, before)
        if trainer:
            yield pa.RecordBatch.from_pydict({"weight": [trainer.weight], "p": [_flat(trainer.p)]})

    local = texts.mapInArrow(run, "weight double, p array<float>")
    cells = local.select("weight", F.posexplode("p").alias("i", "x"))
    mean = (F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("x")
    table = cells.groupBy("i").agg(mean).toArrow().sort_by("i")  # as many rows as parameters
    return _unflat(table["x"].to_numpy(), start) if table.num_rows else start


class Model:
    """Normalised class log-probabilities; the normaliser of a context is computed once."""

    def __init__(self, counts: Counts, parameters: Parameters) -> None:
        self.counts, self.p = counts, parameters
        self.index = bw.HashIndex(counts.frequent)
        self.normaliser = np.full((START + 1) * (START + 1), np.nan, np.float32)

    def class_scores(self, tokens: np.ndarray, earlier: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token's class after the two classes before it."""
        p, width = self.p, START + 1
        keys = earlier * width + before
        new = np.unique(keys[np.isnan(self.normaliser[keys])])
        for at in range(0, len(new), BATCH):
            some = new[at : at + BATCH]
            logits = (p.first[some // width] + p.second[some % width]) @ p.out.T + p.bias
            top = logits.max(axis=1, keepdims=True)
            self.normaliser[some] = np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0]
        context = p.first[earlier] + p.second[before]
        return np.einsum("ij,ij->i", context, p.out[tokens]) + p.bias[tokens] - self.normaliser[keys]

    def score(self, part: bw.Slice) -> dict[str, object]:
        counts, n = self.counts, len(part.offsets) - 1
        found = bw.words(part, lower=True)
        tokens, earlier, before, place = class_stream(part, found, self.index, counts)
        text_of = found.text_of()
        end_n = counts.class_n[END]
        log_base = np.log10(counts.total + counts.kinds + 1.0)
        held = place >= 0
        seen = np.where(held, counts.frequent_n[place], 0).astype(float) if len(counts.frequent) else np.zeros(len(place))
        known = np.where(held, np.log10(seen + 1), 0.0)
        cls = tokens[np.arange(len(place)) + text_of]
        in_shape = (cls >= WORD_CLASSES) & (cls < END)
        share = np.zeros(len(place))
        share[in_shape] = known[in_shape] - np.log10(counts.shape_base[cls[in_shape] - WORD_CLASSES])
        token_text = np.repeat(np.arange(n), found.counts + 1)
        model = np.bincount(token_text, self.class_scores(tokens, earlier, before), n) / LOG10
        # Words too rare to be held: once per text, with how often.
        own = found.hashes[~held] ^ bw.mix(text_of[~held].astype(np.uint64) + np.uint64(1))
        _, first, times = np.unique(own, return_index=True, return_counts=True)
        rare_text = text_of[~held][first]
        order = np.argsort(rare_text, kind="stable")
        bounds = np.r_[0, np.cumsum(np.bincount(rare_text, minlength=n))].astype(np.int32)
        return {
            "n_tokens": found.counts + 1,
            "n_known": np.bincount(text_of[held], minlength=n) + int(end_n > 0),
            "base_score": np.bincount(text_of, known, n) + np.log10(end_n + 1) - (found.counts + 1) * log_base,
            "score": model + np.bincount(text_of, share, n),
            "rare": pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.hashes[~held][first][order].view(np.int64))),
            "rare_n": pa.ListArray.from_arrays(pa.array(bounds), pa.array(times[order].astype(np.int64))),
        }


def partial_scores(docs: DataFrame, counts: Counts, parameters: Parameters, held_out: Column) -> DataFrame:
    """Scores but for the counts of rare words, which come along as lists."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            for part in bw.slices(batch["text"]):
                keys = batch.slice(part.first, part.last - part.first)
                yield pa.RecordBatch.from_pydict({"doc_id": keys["doc_id"], "held_out": keys["held_out"], **model.score(part)})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, PARTIAL)


def score_texts(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Base and model log10 probabilities of every row of ``docs`` (``doc_id``, ``text``).

    Rows whose id's crc32 leaves ``remainder`` teach nothing and are marked ``held_out``.
    """
    held_out = id_remainder(F.col("doc_id"), modulus) == remainder
    taught = docs.where(~held_out).select(F.col("text").cast("binary").alias("text"))
    table = stored(word_counts(taught), "word_counts")
    counts = gather(table)
    parameters = train(taught, counts)
    rows = partial_scores(docs, counts, parameters, held_out)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "partial_scores")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
    rare = rare.select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times"))
    met = rare.join(table.select("word", "n"), "word")
    more = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    out = rows.join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(counts.total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + extra).alias("base_score"),
        (F.col("score") + extra).alias("score"),
    )
