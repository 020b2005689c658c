"""Bounded samples of labelled texts, and calibration, for the trained operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    max_bytes: int,
    key: str = "doc_id",
    text: str = "text",
) -> tuple[pa.Array, np.ndarray]:
    """At most ``per_class`` texts of each label, those of least hashed id, to the driver.

    Texts over ``max_bytes`` are left out, so the sample holds ``2 * per_class * max_bytes`` bytes
    at most. Ids and labels that are null are ignored; of contradicting labels the larger counts.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("sample_id"))
    rows = rows.agg(F.max(F.col(label).cast("int")).alias("sample_label"))
    order = F.xxhash64(F.lit(7), "sample_id")
    picked = None
    for value in (0, 1):
        some = rows.where(F.col("sample_label") == value).orderBy(order, "sample_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(key).alias("sample_id"), F.col(text).cast("binary").alias("sample_text"))
    texts = texts.where(F.octet_length("sample_text") <= max_bytes)
    # At most 2 * per_class ids are broadcast.
    found = texts.join(F.broadcast(picked), "sample_id").select("sample_id", "sample_label", "sample_text")
    table = found.toArrow().sort_by([("sample_id", "ascending"), ("sample_text", "ascending")])
    return (
        table["sample_text"].combine_chunks() if table.num_rows else pa.array([], pa.binary()),
        table["sample_label"].to_numpy(zero_copy_only=False).astype(np.int64),
    )


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def fit_calibration(features: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic coefficients, the constant last, by Newton steps on smoothed targets."""
    x = np.c_[features, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    if len(y) == 0:
        return w
    positive, negative = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    for _ in range(50):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - target) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        # Separable scores would send the steps to infinity.
        step *= min(1.0, 10.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
