"""Near-duplicate vectors by range search in robust-pruned graphs of overlapping shards.

Vectors are clustered around centroids fitted on a bounded sample, and each belongs to the shards of
its ``COPIES`` nearest centroids, so shards overlap. Over each shard, in blocks of ``BLOCK`` vectors at most, a robust-pruned graph is
built; a node's adjacency lists from all its shards are united, and a block's graph holds the united lists of its nodes.
Every vector is then a query in the shards of its nearest centroids (``PROBES`` at first) and of every other centroid whose angle
allows a link to a vector within ``CORE`` of it: a greedy search from the block's medoid, which expands all nodes in range.
Pairs found near the threshold are verified in double precision.

Recall is audited twice. In each block the queries whose id ``AUDIT`` divides are compared with the whole block;
where the search caught too few of their links, it is repeated with a wider beam, and in the end the block is
compared whole. Then a bounded sample of vectors is compared with all vectors; while fewer than ``LEAST_RECALL`` of its links
are counted, the probes are doubled.

Equal vectors are one node with a weight, and each block reports only counts and a spanning forest of its links,
so a large group of copies or near copies is not expanded into pairs. A pair that meets in
several shards is counted in one of them, and for both its ends even if only one of them visits the other's shards.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
kept. Vectors of different length never link. A null id is no component's least id: its component is
null, and it is kept. Repeated rows are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.components import components, forest
from tallywright.session import stored

THRESHOLD = 0.9
BLOCK = 4096
CHUNK = 16384
COPIES = 2
PROBES = 4
CORE = 0.97  # the shards of links to vectors at least this near their centroid are all visited
AUDIT = 50
AUDITED = 256  # vectors compared with all others
LEAST_RECALL = 0.95
LEAST_CAUGHT = 0.99
WIDER = 3  # times that a block's beam is doubled
QUERIES = 512
MAX_CELLS = 4096
SAMPLE_PER_CELL = 256
MAX_SAMPLE = 1 << 16
DEGREE = 24
CANDIDATES = 64
LONG_RANGE = 8
KEPT_BACK = 2
ALPHA = 1.2
BEAM = 24
SLACK = 1e-4  # for single precision; links are verified afterwards

MEMBERS = "node bigint, vector array<double>, weight bigint, cells array<int>"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def normal(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# Shards


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 9) -> np.ndarray:
    """Unit centroids of a sample of vectors by spherical k-means."""
    x = normal(sample).astype(np.float32)
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds if len(centroids) > 1 else 0):
        own = np.concatenate([(x[at : at + 8192] @ centroids.T).argmax(axis=1) for at in range(0, len(x), 8192)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    return centroids.astype(np.float32)


def reach_cosine(threshold: float) -> float:
    """The least cosine to a centroid at which a link may end at a vector within ``CORE`` of that centroid."""
    return float(np.cos(min(np.pi, np.arccos(min(1.0, threshold)) + np.arccos(CORE))))


def assigned(nodes: DataFrame, centroids: np.ndarray, least: float, probes: int = PROBES) -> DataFrame:
    """``nodes`` (``node, vector, weight``) with the cells to visit, nearest first.

    These are the ``probes`` nearest and all others from a cosine of ``least``, however many.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)  # at most MAX_CELLS vectors
    width = min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = normal(rows_of(part["vector"])).astype(np.float32) @ centroids.T
                counts = np.maximum(width, (near >= least - SLACK).sum(axis=1))
                order = np.argsort(-near, axis=1, kind="stable")[:, : counts.max(initial=width)].astype(np.int32)
                cells = order[np.arange(order.shape[1]) < counts[:, None]]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(cells))
                yield part.append_column("cells", lists)

    return nodes.select("node", "vector", "weight").mapInArrow(run, MEMBERS)


class Layout(NamedTuple):
    """Blocks and query chunks of every cell."""

    blocks: list[int]
    chunks: list[int]


def _layout(rows: DataFrame, cells: int) -> Layout:
    def sizes(lists: Column) -> list[int]:
        found = rows.select(F.explode(lists).alias("cell")).groupBy("cell").count().collect()  # at most MAX_CELLS rows
        out = [0] * cells
        for row in found:
            out[row[0]] = row[1]
        return out

    return Layout([max(1, -(-n // BLOCK)) for n in sizes(F.slice("cells", 1, COPIES))], [max(1, -(-n // CHUNK)) for n in sizes(F.col("cells"))])


def _pick(numbers: list[int], at: Column) -> Column:
    return F.get(F.lit(numbers), at)


def _members(rows: DataFrame, layout: Layout) -> DataFrame:
    """One row per node and shard: its ``cell`` and ``block``."""
    out = rows.select("*", F.explode(F.slice("cells", 1, COPIES)).alias("cell"))
    return out.withColumn("block", F.pmod(F.xxhash64("node", "cell"), _pick(layout.blocks, F.col("cell")).cast("bigint")).cast("int"))


# Graphs


def prune(similar: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of every node's candidates (nearest first, -1 for none) to ``degree`` or fewer.

    ``similar`` holds all cosines of the shard. Distances are squared: ``2 - 2 cos``.
    """
    n = len(candidates)
    alive = candidates >= 0
    to_node = 2 - 2 * np.take_along_axis(similar, np.maximum(candidates, 0), axis=1)
    out = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        place = alive.argmax(axis=1)
        pick = candidates[rows, place]
        out[some, k] = pick[some]
        between = 2 - 2 * similar[np.maximum(pick, 0)[:, None], np.maximum(candidates, 0)]
        alive &= ~((alpha * between <= to_node) & some[:, None])
        alive[rows, place] = False
    return out


def reach(lists: np.ndarray, start: int) -> np.ndarray:
    seen = np.zeros(len(lists), bool)
    seen[start] = True
    front = np.array([start])
    while len(front):
        ends = np.unique(lists[front])
        front = ends[(ends >= 0)]
        front = front[~seen[front]]
        seen[front] = True
    return seen


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def build(vectors: np.ndarray, seed: int) -> list[np.ndarray]:
    """Adjacency lists of a shard, by place: pruned nearest and long-range candidates.

    Nodes that the medoid cannot reach get an edge from the nearest node that it can.
    """
    x = normal(vectors).astype(np.float32)
    n = len(x)
    similar = x @ x.T
    np.fill_diagonal(similar, -2)
    near = min(CANDIDATES, n - 1)
    if near <= 0:
        return [np.zeros(0, np.int64)] * n
    candidates = np.argpartition(-similar, near - 1, axis=1)[:, :near]
    rng = np.random.default_rng(seed)
    hubs = rng.choice(n, min(n, 256), replace=False)
    far = min(LONG_RANGE, len(hubs))
    some = hubs[np.argpartition(-similar[:, hubs], far - 1, axis=1)[:, :far]]
    some = np.where(some == np.arange(n)[:, None], -1, some)
    candidates = np.concatenate([candidates, some], axis=1)
    order = np.argsort(-np.where(candidates >= 0, np.take_along_axis(similar, np.maximum(candidates, 0), axis=1), -3), axis=1, kind="stable")
    lists = prune(similar, np.take_along_axis(candidates, order, axis=1))
    # Edges both ways, then pruned again.
    tail = np.repeat(np.arange(n), DEGREE)
    head = lists.ravel()
    tail, head = tail[head >= 0], head[head >= 0]
    pairs = np.unique(np.r_[tail * n + head, head * n + tail])
    tail, head = pairs // n, pairs % n
    closeness = np.lexsort((-similar[tail, head], tail))
    tail, head = tail[closeness], head[closeness]
    counts = np.bincount(tail, minlength=n)
    place = np.arange(len(tail)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
    both = np.full((n, min(int(counts.max()), 4 * DEGREE)), -1, np.int64)
    fits = place < both.shape[1]
    both[tail[fits], place[fits]] = head[fits]
    first = lists[:, :KEPT_BACK]
    lists = prune(similar, both)
    # A node stays reachable from its nearest neighbours, whatever shades it there.
    tail, head = first.ravel(), np.repeat(np.arange(n), first.shape[1])
    tail, head = tail[tail >= 0], head[tail >= 0]
    fresh = ~(lists[tail] == head[:, None]).any(axis=1)
    tail, head = tail[fresh], head[fresh]
    order = np.argsort(tail, kind="stable")
    tail, head = tail[order], head[order]
    counts = np.bincount(tail, minlength=n)
    back = np.full((n, int(counts.max())), -1, np.int64)
    back[tail, np.arange(len(tail)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)] = head
    lists = np.concatenate([lists, back], axis=1)
    extra: list[tuple[int, int]] = []
    start = medoid(x)
    seen = reach(lists, start)
    while not seen.all():
        out, inside = np.flatnonzero(~seen), np.flatnonzero(seen)
        between = similar[np.ix_(out, inside)]
        best = between.max(axis=1).argmax()
        node = int(out[best])
        extra.append((int(inside[between[best].argmax()]), node))
        seen |= reach(lists, node)
    result = [row[row >= 0] for row in lists]
    for a, b in extra:
        result[a], result[b] = np.r_[result[a], b], np.r_[result[b], a]
    return result


# Search


class Lists(NamedTuple):
    """Adjacency lists by place, one after another."""

    offsets: np.ndarray
    ends: np.ndarray

    def neighbours(self, q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of each ``q`` and the neighbours of its ``node``."""
        counts = self.offsets[node + 1] - self.offsets[node]
        before = np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
        place = np.repeat(self.offsets[node], counts) + np.arange(len(before)) - before
        return np.repeat(q, counts), self.ends[place]


def range_search(x: np.ndarray, lists: Lists, queries: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with a cosine from ``threshold``, as far as the graph leads.

    A beam search from the medoid, two nodes of each query's beam at a time, then an expansion of all nodes in range.
    """
    n, b = len(x), len(queries)
    rows = np.arange(b)
    seen = np.zeros((b, n), bool)
    start = medoid(x)
    ids = np.full((b, beam), -1, np.int64)
    value = np.full((b, beam), -3, np.float32)
    ids[:, 0], value[:, 0] = start, queries @ x[start]
    seen[:, start] = True
    done = np.ones((b, beam), bool)
    done[:, 0] = False
    pairs_q, pairs_n = [], []

    def in_range(q: np.ndarray, node: np.ndarray, v: np.ndarray) -> None:
        hit = v >= threshold
        pairs_q.append(q[hit])
        pairs_n.append(node[hit])

    in_range(rows, ids[:, 0], value[:, 0])
    expanded_q, expanded_n = [], []
    active = rows
    while len(active):
        open_value = np.where(done[active], -np.inf, value[active])
        place = np.argpartition(-open_value, 1, axis=1)[:, :2]
        fresh = np.take_along_axis(open_value, place, axis=1) > -np.inf
        q, k = np.repeat(active, 2)[fresh.ravel()], place.ravel()[fresh.ravel()]
        done[q, k] = True
        node = ids[q, k]
        expanded_q.append(q)
        expanded_n.append(node)
        eq, en = lists.neighbours(q, node)
        ok = ~seen[eq, en]
        key = np.unique(eq[ok] * n + en[ok])
        eq, en = key // n, key % n
        seen[eq, en] = True
        v = np.einsum("ij,ij->i", queries[eq], x[en])
        in_range(eq, en, v)
        # The best of the old beam and the new nodes.
        counts = np.bincount(eq, minlength=b)[active]
        width = int(counts.max()) if len(counts) else 0
        slot = np.full((len(active), width), -1, np.int64)
        score = np.full((len(active), width), -3, np.float32)
        back = np.full(b, -1)
        back[active] = np.arange(len(active))
        first = np.r_[0, np.cumsum(np.bincount(eq, minlength=b))]
        column = np.arange(len(eq)) - first[eq]
        slot[back[eq], column], score[back[eq], column] = en, v
        all_ids = np.concatenate([ids[active], slot], axis=1)
        all_value = np.concatenate([value[active], score], axis=1)
        all_done = np.concatenate([done[active], slot < 0], axis=1)
        best = np.argpartition(-all_value, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, axis=1)
        value[active] = np.take_along_axis(all_value, best, axis=1)
        done[active] = np.take_along_axis(all_done, best, axis=1)
        active = active[(~done[active]).any(axis=1)]
    found = np.concatenate(pairs_q) * n + np.concatenate(pairs_n)
    was = np.unique(np.concatenate(expanded_q) * n + np.concatenate(expanded_n))
    front = np.setdiff1d(found, was)
    while len(front):
        q, node = front // n, front % n
        eq, en = lists.neighbours(q, node)
        ok = ~seen[eq, en]
        key = np.unique(eq[ok] * n + en[ok])
        eq, en = key // n, key % n
        seen[eq, en] = True
        hit = np.einsum("ij,ij->i", queries[eq], x[en]) >= threshold
        front = key[hit]
        found = np.r_[found, front]
    return found // n, found % n


def visited(cells: pa.Array, total: int) -> np.ndarray:
    """Which cells each row's list names, as a matrix."""
    if isinstance(cells, pa.ChunkedArray):
        cells = cells.combine_chunks()
    out = np.zeros((len(cells), total), bool)
    out[np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy())), cells.flatten().to_numpy()] = True
    return out


def first_cells(cells: pa.Array, width: int) -> np.ndarray:
    """The first cells of each row's list, which is never shorter."""
    if isinstance(cells, pa.ChunkedArray):
        cells = cells.combine_chunks()
    return cells.flatten().to_numpy()[cells.offsets.to_numpy()[:-1, None] - cells.offsets[0].as_py() + np.arange(width)]


def spanning(hit: np.ndarray, asked: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the least id of each component of a matrix of links, without its list of pairs."""
    top = np.iinfo(np.int64).max
    low = nodes
    while True:
        best = np.minimum(asked, np.where(hit, low, top).min(axis=1))
        new = np.minimum(low, np.where(hit, best[:, None], top).min(axis=0))
        if (new == low).all():
            break
        low = new
    ids, least = np.r_[asked, nodes], np.r_[best, low]
    return ids[ids != least], least[ids != least]


def block_lists(members: pa.Table, seed: int) -> pa.Table:
    """``(node, ends)``: the pruned adjacency lists of a block's graph, by node id."""
    order = np.argsort(members["node"].to_numpy())  # the same graph whatever the order of the rows
    nodes = members["node"].to_numpy()[order]
    lists = build(rows_of(members["vector"])[order], seed)
    offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
    ends = nodes[np.concatenate(lists).astype(np.int64)]
    return pa.table({"node": nodes, "ends": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ends, pa.int64()))})


def local_lists(nodes: np.ndarray, ends: pa.Array) -> Lists:
    """The united lists of a block's nodes by place, as far as they stay in the block."""
    if isinstance(ends, pa.ChunkedArray):
        ends = ends.combine_chunks()
    tail = np.repeat(np.arange(len(nodes)), np.diff(ends.offsets.to_numpy()))
    head = ends.flatten().to_numpy()
    order = np.argsort(nodes)
    place = np.minimum(np.searchsorted(nodes[order], head), len(nodes) - 1)
    inside = nodes[order][place] == head
    tail, head = tail[inside], order[place[inside]]
    return Lists(np.r_[0, np.cumsum(np.bincount(tail, minlength=len(nodes)))], head)


def search_block(members: pa.Table, queries: pa.Table, cell: int, cells: int, threshold: float) -> pa.Table:
    """Counts and a spanning forest of the links of a block's queries to its nodes, from the block's graph."""
    nodes = members["node"].to_numpy()
    exact = normal(rows_of(members["vector"]))
    graph = local_lists(nodes, members["ends"])
    weight = members["weight"].to_numpy().astype(np.float64)
    width = min(COPIES, cells)
    home = first_cells(members["cells"], width)[:, 0]
    back = visited(members["cells"], cells)
    x = exact.astype(np.float32)
    asked = queries["asked_node"].to_numpy()
    wanted = normal(rows_of(queries["asked_vector"]))
    probes = visited(queries["asked_cells"], cells)
    shards = first_cells(queries["asked_cells"], width)
    asked_weight = queries["asked_weight"].to_numpy().astype(np.float64)
    links, mirrored = np.zeros(len(asked)), np.zeros(len(nodes))
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def verified(at: int, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        """A matrix of the pairs (q, k), of queries from ``at``, that are links in double precision."""
        hit = np.zeros((min(QUERIES, len(asked) - at), len(nodes)), bool)
        for some in range(0, len(q), 1 << 18):
            part = slice(some, some + (1 << 18))
            hit[q[part], k[part]] = np.einsum("ij,ij->i", wanted[at + q[part]], exact[k[part]]) >= threshold
        return hit & (asked[at : at + QUERIES, None] != nodes)

    def compared(at: int, rows: np.ndarray) -> np.ndarray:
        q, k = np.nonzero(wanted[at + rows].astype(np.float32) @ x.T >= threshold - SLACK)
        return verified(at, rows[q], k)

    beam, audited, caught = BEAM, 0, 0
    for at in range(0, len(asked), QUERIES):
        some = wanted[at : at + QUERIES].astype(np.float32)
        checked = np.flatnonzero(asked[at : at + QUERIES] % AUDIT == 0)
        true = compared(at, checked)[checked] if len(checked) else np.zeros((0, len(nodes)), bool)
        for attempt in range(WIDER + 2):
            if attempt > WIDER:
                hit = compared(at, np.arange(len(some)))  # the audit's last resort
                break
            hit = verified(at, *range_search(x, graph, some, threshold - SLACK, beam))
            if attempt == 0:
                audited, caught = audited + int(true.sum()), caught + int((true & hit[checked]).sum())
            if (true & hit[checked]).sum() >= LEAST_CAUGHT * true.sum():
                break
            beam = 2 * beam
        hit[checked] |= true
        rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(rows):
            continue
        hit, q = hit[np.ix_(rows, columns)], rows + at
        edges.append(spanning(hit, asked[q], nodes[columns]))
        # In a node's second shard only if the query does not visit its first.
        mine = hit & ((home[columns] == cell) | ~probes[np.ix_(q, home[columns])])
        links[q] += mine @ weight[columns]
        # For the other end too, unless it meets this one as a query itself.
        met = np.zeros((len(columns), len(q)), bool)
        for k in range(width):
            met |= back[np.ix_(columns, shards[q, k])]
        mirrored[columns] += asked_weight[q] @ (mine & ~met.T)
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(edges) > 1:
        a, b = forest(a, b)
    ends, counts = np.r_[asked, nodes], np.r_[links, mirrored].astype(np.int64)
    ends, counts = ends[counts > 0], counts[counts > 0]
    # The last row tells the audit: links of the audited queries, and those of them that the first search caught.
    return pa.table(
        {
            "a": np.r_[a, ends, audited],
            "b": np.r_[b, np.zeros_like(ends), caught],
            "n": np.r_[np.zeros(len(a), np.int64), counts, -1],
        }
    )


def links_of(nodes: DataFrame, threshold: float, probes: int = PROBES) -> DataFrame:
    """``(a, b, n)``: edges of components where ``n`` is 0, ``n`` links of node ``a`` where it is more; one vector length.

    Rows with ``n`` -1 hold a block's audited links and those that the search caught at once.
    """
    total = nodes.count()
    cells = max(1, min(MAX_CELLS, -(-total // BLOCK) * 2))
    share = min(1.0, min(MAX_SAMPLE, SAMPLE_PER_CELL * cells) / max(total, 1))
    chosen = F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = nodes.where(chosen).orderBy("node").limit(2 * MAX_SAMPLE).select("vector").toArrow()
    if sample.num_rows == 0:
        sample = nodes.orderBy("node").limit(1).select("vector").toArrow()
    centroids = fit_centroids(rows_of(sample["vector"]), cells)
    rows = stored(assigned(nodes, centroids, reach_cosine(threshold), probes), "assigned")
    layout = _layout(rows, len(centroids))
    members = _members(rows, layout)

    def build_block(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        return block_lists(block, key[0].as_py())

    lists = members.select("cell", "block", "node", "vector").groupBy("cell", "block").applyInArrow(build_block, "node bigint, ends array<bigint>")
    # A node is in a fixed number of shards, so its united list is bounded.
    united = stored(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("ends"))).alias("ends")), "lists")
    held = members.join(united, "node").select("*", F.explode(F.sequence(F.lit(0), _pick(layout.chunks, F.col("cell")) - 1)).alias("chunk"))
    asked = rows.select("*", F.explode("cells").alias("cell"))
    chunk = F.pmod(F.xxhash64("cell", "node"), _pick(layout.chunks, F.col("cell")).cast("bigint")).cast("int")
    asked = asked.withColumn("chunk", chunk).select("*", F.explode(F.sequence(F.lit(0), _pick(layout.blocks, F.col("cell")) - 1)).alias("block"))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({name: pa.array([], pa.int64()) for name in "abn"})
        return search_block(left, right, key[0].as_py(), len(centroids), threshold)

    by = ["cell", "block", "chunk"]
    left = held.select(*by, "node", "vector", "weight", "cells", "ends").groupBy(*by)
    # Names of its own: both sides stem from one table.
    right = asked.select(*[F.col(c).alias(f"asked_{c}") for c in [*by, "node", "vector", "weight", "cells"]]).groupBy(*[f"asked_{c}" for c in by])
    return left.cogroup(right).applyInArrow(run, "a bigint, b bigint, n bigint")


def sampled_recall(nodes: DataFrame, found: DataFrame, threshold: float, sample: int = AUDITED) -> float:
    """Share of the links of ``sample`` nodes, those of least hashed id, that ``found`` counts: one pass over all nodes."""
    picked = nodes.orderBy(F.xxhash64(F.lit(5), "node"), "node").limit(sample).select("node", "vector").toArrow()
    if picked.num_rows == 0:
        return 1.0
    ids, wanted = picked["node"].to_numpy(), normal(rows_of(picked["vector"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(ids), np.int64)
        for batch in batches:
            near = wanted @ normal(rows_of(batch["vector"])).T >= threshold
            near &= ids[:, None] != batch["node"].to_numpy()
            n += near @ batch["weight"].to_numpy()
        yield pa.RecordBatch.from_pydict({"node": ids, "true": n})

    true = nodes.select("node", "vector", "weight").mapInArrow(run, "node bigint, true bigint").groupBy("node").agg(F.sum("true").alias("true"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    both = true.join(counts, "node", "left").agg(F.sum(F.least("true", F.coalesce("n", F.lit(0)))), F.sum("true")).first()
    return both[0] / both[1] if both[1] else 1.0


def audited_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """``links_of`` with as many probes as the sample's recall asks for."""
    probes = PROBES
    while True:
        found = stored(links_of(nodes, threshold, probes), "found")
        if sampled_recall(nodes, found, threshold) >= LEAST_RECALL or probes >= MAX_CELLS:
            return found
        probes = 2 * probes


def near_duplicate_vectors(rows: DataFrame, threshold: float = THRESHOLD, spread: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Links and components of all rows of ``rows`` (``vec_id``, ``embedding``).

    Returns ``vec_id, n_links, component_id, kept`` per row.
    """
    base = spread(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")))
    fit = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    same = ["h1", "h2", "width"]
    key = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), F.reverse("vector")).alias("h2"), F.size("vector").alias("width")]
    good = base.where(fit).select("vec_id", "vector", *key)
    nodes = good.groupBy(*same).agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    nodes = stored(nodes, "nodes")
    found = None
    for (width,) in nodes.select("width").distinct().collect():
        some = audited_links(nodes.where(F.col("width") == width), threshold)
        found = some if found is None else found.unionByName(some)
    out = base.select("vec_id", F.when(fit, key[0]).alias("h1"), F.when(fit, key[1]).alias("h2"), F.when(fit, key[2]).alias("width"))
    if found is None:
        return out.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "found")
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    labels = components(found.where("n = 0"))
    classes = nodes.select(*same, "node", "weight").join(counts, "node", "left").join(labels, "node", "left")
    classes = classes.select(
        *same,
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("class_links"),
        F.coalesce("component", "node").alias("class_component"),
    )
    joined = out.join(classes, same, "left")
    component = F.coalesce("class_component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("class_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def audit_recall(rows: DataFrame, result: DataFrame, threshold: float = THRESHOLD, sample: int = 200) -> float:
    """Share of the links of ``sample`` vectors, those of least hashed id, that ``result`` counts.

    Brute force: every vector is compared with the bounded sample.
    """
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<float>").alias("vector"))
    picked = good.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(sample).toArrow()
    ids, wanted = picked["vec_id"].to_numpy(), [np.array(v, np.float64) for v in picked["vector"].to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, vectors = batch["vec_id"].to_numpy(), batch["vector"].to_pylist()
            n = np.zeros(len(ids), np.int64)
            for width in {len(v) for v in vectors}:
                mine = np.array([len(v) == width for v in vectors])
                asked = np.array([len(w) == width for w in wanted])
                if mine.any() and asked.any():
                    x = normal(np.array([v for v in vectors if len(v) == width]))
                    w = normal(np.array([v for v in wanted if len(v) == width]))
                    near = (w @ x.T >= threshold) & (ids[asked][:, None] != own[mine][None, :])
                    n[asked] += near.sum(axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "n": n})

    true = good.mapInArrow(run, "vec_id bigint, n bigint").groupBy("vec_id").agg(F.sum("n").alias("n"))
    both = true.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return (both[0] or 0) / both[1] if both[1] else 1.0
