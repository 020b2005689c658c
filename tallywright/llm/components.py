"""Connected components of an edge table, by alternating stars.

Each round rewires every node to the least neighbour it knows, first from its larger
neighbours and then from its smaller ones; minima are pre-aggregated and joined back, so a
hub with very many neighbours is a skewed join side and never one task's group. A round's
edges are written to the shared folder; the rounds end when an edge table repeats itself,
after a number of rounds that grows with the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.session import stored


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _rewired(pairs: DataFrame, larger: bool) -> DataFrame:
    """From pairs (u, v): v joined to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    both = pairs.join(least, "u")
    if larger:
        return both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its least node."""
    current = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    current = stored(current.where("u > v").distinct(), "edges")
    seen = _fingerprint(current)
    while seen[0]:
        turned = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _rewired(turned, True).distinct()
        current = stored(_rewired(large, False).where("u > v").distinct(), "edges")
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger, least) to the least id of each component of the links (a, b) of one task."""
    ids, place = np.unique(np.r_[a, b], return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]
