"""Mixing to target weights by soft domain membership, with DataFrame functions only.

A bounded sample of a table of labelled documents teaches a classifier: all words, and their last letters, are hashed
into ``BUCKETS`` each, and every bucket has a log ratio per domain; a text's mean log ratio, counted as at most
``EFFECTIVE`` words, and the prior give posteriors. Nonnegative rates per document
are then fitted by projected-gradient least squares: the misses are the expected tokens of each domain,
``sum(rate * tokens * posterior)``, less the targets, and all rates start at 1, go down the gradient of the misses' squares and are cut
at 0. The squares are weighted by the inverse of the domains' token products at first, which makes a step exact
where no rate is cut; plain squares decide where no rates meet the targets. A step is one aggregate over the stored posteriors; it tries several lengths at once and takes the best. A
rate is a fold of the steps' vectors over the row's posteriors, so nothing per document is collected.

Targets that no rates meet give the nearest rates, and the remaining miss is a column and a warning.

Defined cases: null and empty texts have one token (their end) and the prior as posterior. A domain that is
targeted but never labelled gets no posterior, and its target is shared out among the others.
Null labels are ignored; of contradicting labels the smallest counts. Without any label all documents have
rate 1 and no posteriors. Null ids and repeated rows are documents like any other; an empty table gives no row.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.text import once
from tallywright.session import stored

SAMPLE = 4000  # labelled documents that teach the classifier
BUCKETS = 1 << 11
ENDING = 3  # last letters that are a feature of their own
EFFECTIVE = 30.0  # words of evidence a text carries at most
SMOOTH = 0.05  # share of the domains' mean added to each: bounds a log ratio
STEPS = 40
LENGTHS = (0.5, 1.0, 2.0, 4.0, 8.0)
FOLDED = 8  # steps between two stored tables of rates
TOLERANCE = 1e-4
STALLED = 1e-6
LONGEST = 1e4


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _taught(docs: DataFrame, labelled: DataFrame, key: str, text: str, domain: str, sample: int) -> DataFrame:
    known = labelled.where(F.col(key).isNotNull() & F.col(domain).isNotNull())
    known = known.groupBy(F.col(key).alias("k")).agg(F.min(F.col(domain).cast("string")).alias("domain"))
    known = known.orderBy(F.xxhash64(F.lit(5), "k"), "k").limit(sample)  # bounded by the parameter
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(known), "k")
    return stored(found.select("domain", words(F.col("text")).alias("words")), "taught")


class Domains(NamedTuple):
    """What the classifier knows: names, log priors, and a log ratio per bucket for each domain."""

    names: list[str]
    priors: list[float]
    ratios: list[list[float]]


def features(found: Column) -> Column:
    """Buckets of every word and, after them, of its last letters."""

    def bucket(c: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), c), F.lit(BUCKETS)).cast("int")

    own = F.transform(found, lambda w: bucket(w, 6))
    return F.concat(own, F.transform(found, lambda w: bucket(F.right(w, F.lit(ENDING)), 7) + BUCKETS))


def classifier(docs: DataFrame, labelled: DataFrame, key: str, text: str, domain: str, sample: int = SAMPLE) -> Domains:
    """Log ratios of the domains' shares of each bucket to their mean; a text's buckets count once each."""
    taught = _taught(docs, labelled, key, text, domain, sample)
    rows = taught.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy("domain").collect()
    names, sizes = [r[0] for r in rows], [r[1] for r in rows]
    if not names:
        return Domains([], [], [])
    met = taught.select("domain", F.explode(F.array_distinct(features(F.col("words")))).alias("bucket"))
    shares = np.zeros((len(names), 2 * BUCKETS))
    place = {d: k for k, d in enumerate(names)}
    for d, bucket, n in met.groupBy("domain", "bucket").count().collect():  # at most two per bucket and domain
        shares[place[d], bucket] = n / sizes[place[d]]
    mean = shares.mean(axis=0)
    safe = np.where(mean > 0, mean, 1.0)
    ratios = np.where(mean > 0, np.log((shares + SMOOTH * safe) / (safe * (1 + SMOOTH))), 0.0)
    return Domains(names, [math.log(n / sum(sizes)) for n in sizes], ratios.tolist())


def _table(row: Sequence[float]) -> Column:
    """A constant array, which the optimizer folds into one value: of bounded size, two entries a bucket."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in row)), ",").cast("array<double>")


def _sum_of(buckets: Column, table: Column) -> Column:
    return F.aggregate(buckets, F.lit(0.0), lambda total, i: total + F.get(table, i))


def membership(text: Column, known: Domains) -> Column:
    """Struct of the text's ``tokens`` (words and one end) and its posteriors ``p``."""

    def scored(found: Column) -> Column:
        return F.struct(F.size(found).alias("all"), features(found).alias("f"))

    def posteriors(s: Column) -> Column:
        # Without a word the prior stands; else the mean over words and endings, as of so many words.
        weight = F.least(s["all"].cast("double"), F.lit(EFFECTIVE)) / F.greatest(2 * s["all"], F.lit(1))
        scores = []
        for row, prior in zip(known.ratios, known.priors, strict=True):
            scores.append(F.lit(prior) + weight * _sum_of(s["f"], _table(row)))
        return F.struct((s["all"].cast("bigint") + 1).alias("tokens"), once(F.array(*scores), softmax).alias("p"))

    return once(once(words(text), scored), posteriors)


def softmax(scores: Column) -> Column:
    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
        return F.transform(powers, lambda v: v / total)

    return once(F.transform(scores, lambda v: F.exp(v - F.array_max(scores))), shares)


def stepped(at: Column, step: Sequence[float]) -> Column:
    """A rate after a step of the domains: less their mean by the row's posteriors, cut at 0."""
    terms = [F.get("p", F.lit(k)) * F.lit(float(x)) for k, x in enumerate(step)]
    return F.greatest(at - reduce(lambda a, b: a + b, terms, F.lit(0.0)), F.lit(0.0))


def rate(steps: Sequence[Sequence[float]]) -> Column:
    """The rate after all steps; the fold runs over a list, so the plan does not grow with it."""
    if not len(steps):
        return F.lit(1.0)
    n = len(steps[0])

    def fold(r: Column, d: Column) -> Column:
        return F.greatest(r - reduce(lambda a, b: a + b, [F.get("p", F.lit(k)) * F.get(d, F.lit(k)) for k in range(n)]), F.lit(0.0))

    return F.aggregate(F.array(*[F.lit([float(x) for x in d]) for d in steps]), F.lit(1.0), fold)


class Fit(NamedTuple):
    """Steps from rate 1, and what each domain's tokens miss of its target after them."""

    steps: list[list[float]]
    misses: list[float]


def fit_rates(rows: DataFrame, targets: Sequence[float], steps: int = STEPS) -> Fit:
    """Projected-gradient least squares of the rates of ``rows`` (``tokens``, ``p``) against the domains' targets.

    Ends when the targets are met, or when a step no longer lowers the squares: the domains' tokens are then
    the nearest to targets that no rates meet.
    """
    n, wanted = len(targets), np.array(targets, float)
    scale = max(float(wanted.sum()), 1.0)
    pairs = [(j, k) for j in range(n) for k in range(j + 1)]
    held = rows.select("tokens", "p", F.lit(1.0).alias("r"))

    def summed(columns: list[Column]) -> np.ndarray:
        return np.array([x or 0.0 for x in held.agg(*[F.sum(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()])

    p, tokens = F.col("p"), F.col("tokens")
    got = summed([tokens * p[k] for k in range(n)] + [tokens * p[j] * p[k] for j, k in pairs])
    misses, product = got[:n] - wanted, np.zeros((n, n))
    for (j, k), x in zip(pairs, got[n:], strict=True):
        product[j, k] = product[k, j] = x
    small = np.eye(n) * (1e-9 * scale / n)
    spread = np.linalg.eigvalsh(product + small)
    # First by the inverse of the products, then, where that ends short of the targets, by the plain squares.
    plain = np.geomspace(1.0, min(max(spread[-1] / spread[0], 2.0), LONGEST), len(LENGTHS))
    rounds = [(np.linalg.inv(product + small), LENGTHS), (np.eye(n) / spread[-1], plain)]
    taken: list[list[float]] = []
    waiting: list[np.ndarray] = []
    for weights, lengths in rounds:
        until = len(taken) + steps
        while np.abs(misses).sum() > TOLERANCE * scale and len(taken) < until:
            down = weights @ misses
            if len(waiting) == FOLDED:
                held = stored(held.select("tokens", "p", reduce(stepped, waiting, F.col("r")).alias("r")), "rates")
                waiting = []
            at = reduce(stepped, waiting, F.col("r"))
            tried = [tokens * p[k] * stepped(at, length * down) for length in lengths for k in range(n)]
            ends = summed(tried).reshape(len(lengths), n) - wanted
            squares = np.einsum("lk,kj,lj->l", ends, weights, ends)
            best = int(squares.argmin())
            if squares[best] > (1 - STALLED) * (misses @ weights @ misses):
                break
            step = lengths[best] * down
            taken.append([float(x) for x in step])
            waiting.append(step)
            misses = ends[best]
    return Fit(taken, [float(m) for m in misses])


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    domain: str = "domain",
    temper: float = 0.5,
) -> tuple[DataFrame, list[str]]:
    """Rates of all rows of ``docs``: ``record`` (its columns), ``tokens``, ``p``, ``rate`` and the fit's ``miss``.

    ``labelled`` holds ``key`` and ``domain``. ``weights`` are the targets by domain, normalised over
    the domains that have labels; without them the expected shares raised to ``temper``. The targets'
    total is the tokens of ``docs``. Also gives the domains in the order of ``p``.
    """
    known = classifier(docs, labelled, key, text, domain)
    domains, n = known.names, len(known.names)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    if n == 0:
        tokens = (F.size(words(F.col(f"record.{text}"))).cast("bigint") + 1).alias("tokens")
        none = F.array().cast("array<double>").alias("p")
        return rows.select("record", tokens, none, F.lit(1.0).alias("rate"), F.lit(0.0).alias("miss")), domains
    found = rows.select("record", membership(F.col(f"record.{text}"), known).alias("m"))
    rows = stored(found.select("record", "m.tokens", "m.p"), "posteriors")
    have = rows.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col("p")[k]) for k in range(n)]).first()
    total = float(have[0] or 0)
    if weights is None:
        wanted = [((have[1 + k] or 0.0) / max(total, 1.0)) ** temper for k in range(n)]
    else:
        wanted = [max(0.0, float(weights.get(d, 0.0))) for d in domains]
    if sum(wanted) == 0:
        wanted = [1.0] * n
    fit = fit_rates(rows, [total * w / sum(wanted) for w in wanted])
    miss = sum(map(abs, fit.misses)) / max(total, 1.0)
    if miss > TOLERANCE:
        shares = ", ".join(f"{d} {m / total:+.2%}" for d, m in zip(domains, fit.misses, strict=True))
        warnings.warn(f"no rates meet the targets; of all tokens the nearest miss: {shares}", stacklevel=2)
    return rows.withColumn("rate", rate(fit.steps)).withColumn("miss", F.lit(miss)), domains


def _chance(key: str, text: str, seed: int) -> Column:
    """A number from 0 to 1 by id, text and the row's place: rows that share an id or have none differ."""
    place = [F.col(f"record.{key}"), F.col(f"record.{text}"), F.monotonically_increasing_id()]
    return F.pmod(F.xxhash64(F.lit(seed), *place), F.lit(1 << 30)) / float(1 << 30)


def draw(mixed: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 77) -> DataFrame:
    """Documents drawn at their rates, relative to the highest one: a seeded hash decides.

    Each row stays with probability ``rate / max(rate)``, so expected domain shares are the targets' and
    no document is repeated; the total shrinks by the highest rate. ``draw_copies`` keeps it.
    """
    top = mixed.agg(F.max("rate")).first()[0] or 1.0
    return mixed.where(_chance(key, text, seed) < F.col("rate") / F.lit(float(top))).select("record.*")


def draw_copies(mixed: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 77) -> DataFrame:
    """Documents drawn at their rates: whole copies, and one more with the rest as its probability.

    Expected domain tokens are the targets', in total too: a rate over 1 repeats a document.
    """
    whole = F.floor("rate")
    copies = (whole + (_chance(key, text, seed) < F.col("rate") - whole).cast("bigint")).cast("int")
    drawn = mixed.select("record", copies.alias("copies"))
    return drawn.select("record", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("record.*")
