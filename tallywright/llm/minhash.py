"""Near-duplicate texts by b-bit MinHash, confirmed on their full shingle sets.

Texts with equal sets are one class and are handled once. A class's set gives ``HASHES``
minima: bands of ``ROWS`` of them name the buckets in which candidates meet, and the low
``BITS`` bits of each are packed into a signature whose equal fields, corrected for chance,
estimate the similarity. Candidates that the estimate does not rule out are compared on their
full sets, and confirmed links are closed to components.

No bucket is expanded into all its pairs. Its members are first compared with its pivot, the member
that meets most others in all its buckets and so is likely the original of its copies. Buckets of one
pivot form a group; what is left are a group's documents outside its largest component, which
are compared with all of the group, in blocks, inside tasks that return a spanning forest of the links.

At a similarity of 0.8 a pair shares no bucket with probability 3e-6. Defined cases: texts
without words, and null texts, have empty sets, link with nothing and are kept. Rows that share an id are one
document. Rows with a null id link with nothing; their component is null and they are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import byte_words as bw
from tallywright.llm.components import components, forest
from tallywright.session import stored

BITS = 4
ROWS = 5
BANDS = 32
HASHES = ROWS * BANDS
FIELDS_PER_LONG = 64 // BITS
SLACK = 5.0  # standard errors by which an estimate may fall short
ROW_BLOCK, COLUMN_BLOCK = 256, 1024
SHINGLE_BLOCK = 4096
SIGNATURES = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, packed array<bigint>"


def shingles(found: bw.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, repeats included, and their bounds.

    A text with fewer words than a shingle has one: the whole sequence.
    """
    windows, bounds = bw.window_hashes(found, size)
    short = np.flatnonzero((found.counts > 0) & (found.counts < size))
    if len(short) == 0:
        return windows, bounds
    whole = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        inside = found.counts[short] > k
        whole[inside] = bw.mix(whole[inside] * np.uint64(bw.STEP) + found.hashes[found.bounds[short[inside]] + k])
    whole = bw.mix(whole ^ found.counts[short].astype(np.uint64) * np.uint64(bw.STEP))
    counts = np.diff(bounds)
    windows = np.insert(windows, bounds[short], whole)
    counts[short] = 1
    return windows, np.r_[0, np.cumsum(counts)]


def distinct_shingles(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and the text of each."""
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    _, kept = np.unique(keys ^ bw.mix(text_of.astype(np.uint64) + np.uint64(1)), return_index=True)
    return keys[kept], text_of[kept]


def _wrapping_sums(values: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, text_of, values)
    return out


def sketch(part: bw.Slice, size: int) -> dict[str, np.ndarray]:
    """Set size, set fingerprint, band keys and packed low bits of every text of a slice."""
    n = len(part.offsets) - 1
    keys, bounds = shingles(bw.words(part, lower=True), size)
    own, text_of = distinct_shingles(keys, bounds)
    filled = np.flatnonzero(np.diff(bounds))
    minima = np.zeros((HASHES, len(filled)), np.uint64)
    factors, shifts = bw.randoms(HASHES, 31) | np.uint64(1), bw.randoms(HASHES, 32)
    for k in range(HASHES if len(filled) else 0):
        minima[k] = np.minimum.reduceat(keys * factors[k] + shifts[k], bounds[:-1][filled])
    bands = np.zeros((n, BANDS), np.uint64)
    packed = np.zeros((n, HASHES // FIELDS_PER_LONG), np.uint64)
    for band in range(BANDS):
        key = np.full(len(filled), band + 1, np.uint64)
        for row in range(ROWS):
            key = bw.mix(key * np.uint64(bw.STEP) + minima[band * ROWS + row])
        bands[filled, band] = key
    low = minima & np.uint64((1 << BITS) - 1)
    for k in range(HASHES):
        packed[filled, k // FIELDS_PER_LONG] |= low[k] << np.uint64(BITS * (k % FIELDS_PER_LONG))
    return {
        "n_shingles": np.bincount(text_of, minlength=n),
        "set_a": _wrapping_sums(bw.mix(own), text_of, n),
        "set_b": _wrapping_sums(bw.mix(own ^ np.uint64(bw.STEP)), text_of, n),
        "bands": bands,
        "packed": packed,
    }


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.ravel().view(np.int64)))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """One signature row per row of ``docs`` (``doc_id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bw.slices(batch["text"]):
                row = sketch(part, size)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"].slice(part.first, part.last - part.first),
                        "n_shingles": row["n_shingles"].astype(np.int64),
                        "set_a": row["set_a"].view(np.int64),
                        "set_b": row["set_b"].view(np.int64),
                        "bands": _lists(row["bands"]),
                        "packed": _lists(row["packed"]),
                    }
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SIGNATURES)


def estimated_similarity(left: Column, right: Column) -> Column:
    """Similarity from the share of equal fields, corrected for fields equal by chance."""
    ones = sum(1 << (BITS * k) for k in range(FIELDS_PER_LONG))
    ones = F.lit(ones)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(ones))

    unequal = F.aggregate(F.zip_with(left, right, differing), F.lit(0), lambda s, v: s + v)
    chance = 2.0**-BITS
    return ((1 - unequal / float(HASHES)) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    share = percent / 100 + (1 - percent / 100) * 2.0**-BITS
    return percent / 100 - SLACK * (share * (1 - share) / HASHES) ** 0.5 / (1 - 2.0**-BITS)


def _promising(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes and signatures do not rule them out."""

    def side(name: str) -> DataFrame:
        return reps.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("packed").alias(f"s_{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(sizes & (estimated_similarity(F.col("s_a"), F.col("s_b")) >= least_estimate(percent))).select("a", "b")


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for part in bw.slices(texts):
        keys, text_of = distinct_shingles(*shingles(bw.words(part, lower=True), size))
        yield keys, text_of + part.first


def similar(left: pa.Array, right: pa.Array, size: int, percent: int) -> np.ndarray:
    """Which texts of two columns are similar, row by row, on their full sets."""
    n = len(left)
    keys, rows, sizes = [], [], []
    for texts in (left, right):
        parts = list(_sets(texts, size))
        keys.append(np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64))
        rows.append(np.concatenate([r for _, r in parts]) if parts else np.zeros(0, np.int64))
        sizes.append(np.bincount(rows[-1], minlength=n))
    row = np.concatenate(rows)
    own = np.concatenate(keys) ^ bw.mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    common = np.bincount(row[order][1:][same], minlength=n)
    union = sizes[0] + sizes[1] - common
    return (union > 0) & (100 * common >= percent * union)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b), on the full sets of ``texts`` (``doc_id``, binary ``text``)."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Pieces of some rows keep the sets of very long texts few.
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                linked = similar(piece["text_a"], piece["text_b"], size, percent)
                yield piece.select(["a", "b"]).filter(pa.array(linked))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint").distinct()


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of every left with every right signature."""
    ones = np.uint64(sum(1 << (BITS * k) for k in range(FIELDS_PER_LONG)))
    unequal = np.zeros((len(left), len(right)), np.int64)
    for k in range(left.shape[1]):
        z = left[:, k, None] ^ right[None, :, k]
        z |= z >> np.uint64(1)
        z |= z >> np.uint64(2)
        unequal += np.bitwise_count(z & ones)
    return ((1 - unequal / HASHES) - 2.0**-BITS) / (1 - 2.0**-BITS)


def common_shingles(left: pa.Array, right: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many shingles every left text shares with every right one, and all set sizes.

    A product of incidence matrices over the shingles that both sides hold, some at a time.
    """
    sides = []
    for texts in (left, right):
        parts = list(_sets(texts, size))
        sides.append([np.concatenate([p[k] for p in parts]) for k in range(2)])
    sizes = [np.bincount(rows, minlength=len(texts)) for (_, rows), texts in zip(sides, (left, right), strict=True)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    common = np.zeros((len(left), len(right)), np.float32)
    for keys in sides:
        keys[0:2] = [k[np.isin(keys[0], both)] for k in keys]
    for at in range(0, len(both), SHINGLE_BLOCK):
        some = both[at : at + SHINGLE_BLOCK]
        held = []
        for (keys, rows), n in zip(sides, (len(left), len(right)), strict=True):
            inside = (keys >= some[0]) & (keys <= some[-1])
            matrix = np.zeros((n, len(some)), np.float32)
            matrix[rows[inside], np.searchsorted(some, keys[inside])] = 1
            held.append(matrix)
        common += held[0] @ held[1].T
    return np.rint(common).astype(np.int64), *sizes


def compare_blocks(left: pa.Table, right: pa.Table, size: int, percent: int) -> pa.Table:
    """A spanning forest of the links between the documents of two blocks of a group."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if left.num_rows == 0 or right.num_rows == 0:
        return none
    a, b = left["doc_id"].to_numpy(), right["other_id"].to_numpy()
    packed = [np.array(t.to_pylist(), np.int64).view(np.uint64) for t in (left["packed"], right["other_packed"])]
    apart = left["component"].to_numpy()[:, None] != right["other_component"].to_numpy()[None, :]
    likely = apart & (estimates(*packed) >= least_estimate(percent))
    rows, columns = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
    if len(rows) == 0:
        return none
    texts = [t.combine_chunks().take(pa.array(k)) for t, k in ((left["text"], rows), (right["other_text"], columns))]
    common, n_a, n_b = common_shingles(*texts, size)
    union = n_a[:, None] + n_b[None, :] - common
    i, j = np.nonzero(likely[np.ix_(rows, columns)] & (100 * common >= percent * union))
    low, high = forest(a[rows[i]], b[columns[j]]) if len(i) else (a[:0], b[:0])
    return pa.table({"a": low, "b": high})


def _rest_links(groups: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of the documents outside their group's largest component.

    ``groups`` holds ``pivot``, ``doc_id`` and ``component`` of groups with several components.
    """
    parts = groups.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("n"))
    chief = F.max(F.struct("n", "component")).alias("chief")
    whole = parts.groupBy("pivot").agg(chief, F.sum("n").alias("all"))
    whole = whole.select("pivot", F.col("chief.component").alias("main"), (F.col("all") - F.col("chief.n")).alias("rest"), "all")
    sides = groups.join(whole, "pivot").withColumn("row_blocks", F.ceil(F.col("rest") / ROW_BLOCK))
    sides = sides.withColumn("column_blocks", F.ceil(F.col("all") / COLUMN_BLOCK))

    def spot(blocks: str) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.col(blocks).cast("bigint"))

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks).cast("bigint") - 1))

    known = reps.select("doc_id", "packed").dropDuplicates(["doc_id"]).join(texts, "doc_id")
    rest = sides.where("component <> main").select("pivot", "doc_id", "component", spot("row_blocks").alias("row_block"), every("column_blocks").alias("column_block"))
    others = sides.select("pivot", "doc_id", "component", spot("column_blocks").alias("column_block"), every("row_blocks").alias("row_block"))
    by = ["pivot", "row_block", "column_block"]
    left = rest.join(known, "doc_id").select(*by, "doc_id", "component", "packed", "text").groupBy(*by)
    # Names of its own: both sides stem from one table.
    right = others.join(known, "doc_id").select(
        *[F.col(c).alias(f"other_{c}") for c in by],
        F.col("doc_id").alias("other_id"),
        *[F.col(c).alias(f"other_{c}") for c in ("component", "packed", "text")],
    )
    right = right.groupBy(*[f"other_{c}" for c in by])

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        return compare_blocks(one, other, size, percent)

    return left.cogroup(right).applyInArrow(run, "a bigint, b bigint")


def _pivots(members: DataFrame) -> DataFrame:
    """``(pivot, doc_id)``: the groups of documents that meet the pivot of a bucket in that bucket."""
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(members.join(buckets, "bucket"), "buckets")
    popularity = members.groupBy("doc_id").agg(F.sum("n").alias("popularity"))
    known = stored(members.join(popularity, "doc_id"), "members")
    chief = F.max(F.struct("popularity", (-F.col("doc_id")).alias("lowest"))).alias("chief")
    chiefs = known.groupBy("bucket").agg(chief).select("bucket", (-F.col("chief.lowest")).alias("pivot"))
    return known.join(chiefs, "bucket").where("doc_id <> pivot").select("pivot", "doc_id").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, spread: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Classes of near-duplicate rows of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id, n_shingles, component_id, kept`` per row; ``component_id`` is the least id
    reachable over links of at least ``percent`` hundredths of similarity.
    """
    rows = stored(signatures(spread(docs.select("doc_id", "text")), size), "signatures")
    filled = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same_set = ["set_a", "set_b", "n_shingles"]
    classes = filled.groupBy(*same_set).agg(F.min("doc_id").alias("rep"))
    chosen = classes.select(F.col("rep").alias("doc_id"), *same_set)
    reps = stored(filled.join(chosen, ["doc_id", *same_set], "left_semi").dropDuplicates(["doc_id", *same_set]), "classes")
    groups = stored(_pivots(reps.select("doc_id", F.explode("bands").alias("bucket")).distinct()), "groups")
    wanted = groups.select(F.explode(F.array("pivot", "doc_id")).alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # The same plan at every size: texts meet the ids in a shuffle even where those would fit a broadcast.
    texts = stored(texts.join(wanted.hint("merge"), "doc_id", "left_semi"), "candidate_texts")
    pairs = groups.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    links = stored(confirmed(_promising(pairs, reps, percent).distinct(), texts, size, percent), "links")
    found = stored(components(links), "components")
    labels = found.select(F.col("node").alias("doc_id"), "component")
    labelled = groups.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    spans = labelled.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    unsettled = stored(labelled.join(spans.where("low < high").select("pivot"), "pivot", "left_semi"), "unsettled")
    more = stored(_rest_links(unsettled, reps, texts, size, percent), "more_links")
    found = stored(components(links.unionByName(more)), "components")
    by_set = classes.join(found, F.col("rep") == F.col("node"), "left").select(*same_set, F.coalesce("component", "rep").alias("of_set"))
    keyed = rows.select("doc_id", *same_set).join(by_set, same_set, "left")
    own = F.col("doc_id")
    alone = (F.col("n_shingles") == 0) | own.isNull()
    component = F.when(alone, own).otherwise(F.least("of_set", own))
    return keyed.select(own, "n_shingles", component.alias("component_id"), (own.isNull() | (own == component)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, spread: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each class is kept.

    Of rows that share a kept id and their text one stays; rows of one id with different texts are documents of
    their own, known by a hash of both, and rows with a null id all stay.
    """
    key = F.xxhash64(F.col("text").cast("binary"))
    several = docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_shared")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    several = stored(several.where("low <> high").select("_shared"), "shared_ids")
    own = F.col("doc_id").cast("bigint")
    named = docs
    if not several.isEmpty():
        named = docs.join(several, F.col("doc_id") == F.col("_shared"), "left")
        own = F.when(F.col("_shared").isNull(), own).otherwise(F.xxhash64("doc_id", F.col("text").cast("binary")))
    named = named.withColumn("_own", own)
    found = near_duplicates(named.select(F.col("_own").alias("doc_id"), "text"), size, percent, spread)
    stay = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_stay")).distinct()
    kept = named.join(stay, F.col("_own") == F.col("_stay"), "left_semi").dropDuplicates(["_own"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
