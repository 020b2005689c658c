"""Prefix tree of conversations, from double-array tries of prefix shards.

Conversations that are equal are first reduced to one path. A path is known at every turn by a rolling hash of the
turns so far. Subtrees of at most ``SHARD`` turns are dealt to cells; a cell packs its paths into a
double array (BASE and CHECK over dense turn ids), walks it with all paths at once, and sums its
subtrees. Nodes above those subtrees are shared between cells: they are counted by their hash, and take the
cells' sums along one path each, as running sums from the path's end, so that every subtree and every
node is added exactly once to each of its ancestors.

A path with very many turns is never one row: only the part of it inside a small subtree is. The list
of members that end at a node is hashed as a stream of runs of ids.

Defined cases: turns are ordered by number, nulls first, then role and text; equal rows are as many turns; a null role or text is
empty. Rows with a null ``conv_id`` have no number to be a member by and are left out. A conversation without turns
belongs to the root alone. An empty table gives no node. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.session import stored

SHARD = 16384
CELL = 4 * SHARD
BLOCK = 256
FAMILY, HEADS = 20, 4
IDS_PER_RUN = 1024
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()
KEY = ["p1", "p2"]
NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string"
)
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, a, b, words)``: every turn's position from 1, two hashes and its words.

    Equal rows are counted first. Positions are sums over ranges of the order and inside a range, so no
    conversation is sorted by one task.
    """
    empty = F.lit("")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = stored(rows.repartitionByRange(F.col("conv_id"), *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("conv_id", "range").agg(F.sum("copies").alias("size"))
    first = F.coalesce(F.sum("size").over(_before("range", "conv_id")), F.lit(0))
    inside = Window.partitionBy("conv_id", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("place", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = placed.join(sizes.select("conv_id", "range", first.alias("first")), ["conv_id", "range"])
    start = F.col("first") + F.col("place")
    return placed.select(
        "conv_id",
        F.explode(F.sequence(start + 1, start + F.col("copies"))).alias("pos"),
        F.xxhash64(F.lit(1), "role", "text").alias("a"),
        F.xxhash64(F.lit(2), "text", "role").alias("b"),
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"),
    )


def _before(order: str, *keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns, and ``(conv_id, len)`` of every conversation.

    The first turns of a conversation, up to three as its number decides, are those of the first
    conversation of its family of twenty.
    """
    rows = stored(numbered_turns(turns), "numbered")
    sizes = rows.groupBy("conv_id").agg(F.max("pos").alias("n"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("head")
    convs = sizes.select("conv_id", "n", head, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("source"))
    lengths = sizes.select(F.col("conv_id").alias("source"), F.least("n", F.lit(HEADS)).alias("source_n"))
    convs = convs.join(lengths, "source", "left").withColumn("given", F.least("head", F.coalesce("source_n", F.lit(0))))
    convs = stored(convs, "convs")
    heads = rows.where(F.col("pos") < HEADS).withColumnRenamed("conv_id", "source")
    given = heads.join(convs.select("conv_id", "source", "given"), "source").where("pos <= given").select("conv_id", "pos", "a", "b", "words")
    own = rows.where(F.col("pos") > (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS))
    # Only conversations whose source is too short have their own turns moved up.
    moved = convs.where("given < head").select("conv_id", (F.col("head") - F.col("given")).alias("up"))
    own = own.join(moved, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("pos"), "a", "b", "words")
    length = (F.col("given") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("len")
    return given.unionByName(own), convs.select("conv_id", length)


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "pos", "a", "b")


def prefixes(rows: DataFrame) -> DataFrame:
    """Turns with the hash ``p1, p2`` of all turns up to them, by running sums over blocks."""
    rows = stored(rows.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)), "rebuilt")
    hashed = rows.withColumn("x", _turn_hash(3)).withColumn("y", _turn_hash(4))
    totals = hashed.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier, zero = _before("block", "conv_id"), F.lit(0).cast("bigint")
    before = [F.coalesce(F.bit_xor(c).over(earlier), zero).alias(f"before_{c}") for c in "xy"]
    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.select("*", F.bit_xor("x").over(running).alias("in_x"), F.bit_xor("y").over(running).alias("in_y"))
    both = inside.join(totals.select("conv_id", "block", *before), ["conv_id", "block"])
    p1, p2 = [F.col(f"before_{c}").bitwiseXOR(F.col(f"in_{c}")) for c in "xy"]
    return both.select("conv_id", "pos", "a", "b", "words", p1.alias("p1"), p2.alias("p2"))


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths from their runs of ids, which come in order: members, the least one, and the hash of the list."""
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("len", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    key, least, n, digest = None, None, 0, hashlib.sha256()
    for batch in batches:
        out = []
        columns = [batch[c].to_pylist() for c in ("p1", "p2", "len", "least", "n", "ids")]
        for *now, first, size, ids in zip(*columns, strict=True):
            if now != key:
                if key is not None:
                    out.append((*key, least, n, digest.hexdigest()))
                key, least, n, digest = now, first, 0, hashlib.sha256()
            elif n:
                digest.update(b",")
            n += size
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, schema, strict=True)], schema=schema)
    if key is not None:
        last = (*key, least, n, digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(last, schema, strict=True)], schema=schema)


def distinct_paths(convs: DataFrame, marked: DataFrame) -> DataFrame:
    """``(p1, p2, len, conv_id, n, ends)`` of every distinct rebuilt conversation; ``conv_id`` is its smallest member."""
    last = marked.select("conv_id", F.col("pos").alias("len"), *KEY)
    zero = F.lit(0).cast("bigint")
    whole = convs.join(last, ["conv_id", "len"], "left").select("conv_id", "len", *[F.coalesce(k, zero).alias(k) for k in KEY])
    run = F.shiftright("conv_id", IDS_PER_RUN.bit_length() - 1).alias("run")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    runs = whole.groupBy(*KEY, "len", run).agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), ids)
    runs = runs.repartition(*KEY, "len").sortWithinPartitions(*KEY, "len", "run")
    return runs.select(*KEY, "len", "least", "n", "ids").mapInArrow(_hashed_ends, "p1 bigint, p2 bigint, len bigint, conv_id bigint, n bigint, ends string")


class DoubleArray:
    """A trie of sequences of dense codes: the child of ``s`` by code ``c`` is ``BASE[s] + c``, and its CHECK is ``s``."""

    TRIES = 16

    def __init__(self, codes: np.ndarray, offsets: np.ndarray) -> None:
        """``codes[offsets[i]:offsets[i + 1]]`` is sequence ``i``."""
        self.base = np.zeros(len(codes) + 2, np.int64)
        self.check = np.full(len(codes) + 2, -1, np.int64)
        self.check[0] = 0
        self.top, self.low = 1, 1
        lengths = np.diff(offsets)
        state = np.zeros(len(lengths), np.int64)
        for t in range(int(lengths.max(initial=0))):
            here = np.flatnonzero(lengths > t)
            code = codes[offsets[here] + t]
            order = np.lexsort((code, state[here]))
            parent, code_of = state[here][order], code[order]
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(parent) != 0) | (np.diff(code_of) != 0)
            self._place(parent[new], code_of[new])
            state[here] = self.base[state[here]] + code

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, np.int64)]

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Give every (parent, code), sorted, a free slot: parents of several children first, then single ones into the holes."""
        heads, sizes = np.unique(parents, return_counts=True)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        for k in np.flatnonzero(sizes > 1)[np.argsort(-sizes[sizes > 1], kind="stable")]:
            some = codes[starts[k] : starts[k] + sizes[k]]
            steps = some - some[0]
            self._room(self.top + int(steps[-1]) + 1)
            holes = np.flatnonzero(self.check[self.low : self.top] < 0)[: self.TRIES] + self.low
            fits = (h for h in holes if h + steps[-1] < len(self.check) and (self.check[h + steps] < 0).all())
            slots = next(fits, self.top) + steps
            self.check[slots] = heads[k]
            self.base[heads[k]] = slots[0] - some[0]
            self.top = max(self.top, int(slots[-1]) + 1)
        single = np.flatnonzero(sizes == 1)
        if not len(single):
            return
        holes = np.zeros(0, np.int64)
        if len(single) > self.TRIES:
            holes = np.flatnonzero(self.check[self.low : self.top] < 0)[: len(single)] + self.low
            self.low = int(holes[-1]) + 1 if len(holes) else self.top
        beyond = len(single) - len(holes)
        self._room(self.top + beyond)
        slots = np.r_[holes, np.arange(self.top, self.top + beyond)]
        self.top += beyond
        self.check[slots] = heads[single]
        self.base[heads[single]] = slots - codes[starts[single]]

    def walk(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The slot of every element of the sequences; -1 from where a sequence leaves the trie."""
        lengths = np.diff(offsets)
        state, out = np.zeros(len(lengths), np.int64), np.full(len(codes), -1, np.int64)
        for t in range(int(lengths.max(initial=0))):
            here = np.flatnonzero((lengths > t) & (state >= 0))
            slot = self.base[state[here]] + codes[offsets[here] + t]
            known = (slot > 0) & (slot < len(self.check))
            known[known] = self.check[slot[known]] == state[here][known]
            state[here] = out[offsets[here] + t] = np.where(known, slot, -1)
        return out


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct pairs."""
    order = np.lexsort((b, a))
    new = np.zeros(len(a), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def cell_nodes(table: pa.Table) -> pa.Table:
    """All nodes of a cell's shards, with their sums; a shard's first node carries the hash of its parent."""
    turns = table["turns"].combine_chunks()
    offsets = turns.offsets.to_numpy().astype(np.int64)
    a, b, words = (turns.values.field(c).to_numpy()[offsets[0] : offsets[-1]] for c in ("a", "b", "words"))
    offsets = offsets - offsets[0]
    conv, depth, n, s1, s2 = (table[c].to_numpy() for c in ("conv_id", "first", "n", "p1", "p2"))
    lengths = np.diff(offsets)
    codes = _dense(a, b)
    shard = _dense(s1, s2)
    codes[offsets[:-1]] = codes.max() + 1 + shard  # a shard's first turn stands for all that came before, too
    trie = DoubleArray(codes, offsets)
    slot = trie.walk(codes, offsets)
    sequence = np.repeat(np.arange(len(conv)), lengths)
    level = np.arange(len(codes)) - offsets[sequence]
    size = len(trie.check)
    members, least = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    np.add.at(members, slot, n[sequence])
    np.minimum.at(least, slot, conv[sequence])
    at = np.full(size, -1, np.int64)
    at[slot] = np.arange(len(slot))  # a turn that stands for the node
    nodes = np.flatnonzero(at >= 0)
    parent = trie.check
    children = np.bincount(parent[nodes], minlength=size)
    leaves, saved = (children == 0).astype(np.int64), np.zeros(size, np.int64)
    leaves[at < 0] = 0
    saved[nodes] = (members[nodes] - 1) * words[at[nodes]]
    level_of = level[at[nodes]]
    by_level = nodes[np.argsort(level_of, kind="stable")]
    cuts = np.searchsorted(np.sort(level_of), np.arange(1, level_of.max() + 1))
    for some in np.split(by_level, cuts)[:0:-1]:  # deepest first; first nodes have no parent here
        np.add.at(leaves, parent[some], leaves[some])
        np.add.at(saved, parent[some], saved[some])
    top = level_of == 0
    ends = np.full(size, -1, np.int64)
    ends[slot[offsets[1:] - 1]] = np.arange(len(conv))
    of = sequence[at[nodes]]
    listed = pa.concat_arrays([table["ends"].combine_chunks().cast(pa.string()), pa.array([NO_ENDS])])
    out = {
        "conv_id": least[nodes],
        "depth": depth[of] + level_of,
        "parent_conv_id": pa.array(least[parent[nodes]], mask=top),
        "n_convs": members[nodes],
        "n_children": children[nodes],
        "n_leaves": leaves[nodes],
        "saved_tokens": saved[nodes],
        "ends_sha256": listed.take(pa.array(np.where(ends[nodes] < 0, len(conv), ends[nodes]))),
        "q1": pa.array(table["q1"].to_numpy()[of], mask=~top),
        "q2": pa.array(table["q2"].to_numpy()[of], mask=~top),
    }
    return pa.table(out)


def _split_depths(own: DataFrame, shard: int) -> DataFrame:
    """``(conv_id, split)``: paths whose first small subtree begins below their first turn, and at which turn.

    Sizes are taken at turns 1, 2, 4, ...; a subtree is small when its paths have at most ``shard`` turns from there on.
    """
    levels = own.where(F.col("pos").bitwiseAND(F.col("pos") - 1) == 0).select("conv_id", "pos", *KEY, "len")
    large = levels.groupBy("pos", *KEY).agg(F.sum(F.col("len") - F.col("pos") + 1).alias("size")).where(F.col("size") > shard)
    return levels.join(large, ["pos", *KEY], "left_semi").groupBy("conv_id").agg((F.max("pos") * 2).alias("split"))


def _suffix_sums(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sums from each row's depth to the end of its path, over blocks and inside a block."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    later = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in columns])
    totals = totals.select("conv_id", "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in columns])
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("conv_id", "block", "depth", *KEY, *[F.sum(c).over(inside).alias(c) for c in columns])
    both = sums.join(totals, ["conv_id", "block"])
    return both.select("depth", *KEY, *[(F.col(c) + F.col(f"later_{c}")).alias(c) for c in columns])


def prefix_tree(turns: DataFrame, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """One row per node of the rebuilt conversations' prefix tree: ``NODE``."""
    rows, convs = rebuilt(turns)
    marked = stored(prefixes(rows), "prefixes")
    paths = stored(distinct_paths(convs, marked), "paths")
    own = stored(marked.join(paths.select("conv_id", "len", "n"), "conv_id"), "own")
    split = stored(_split_depths(own, shard), "splits")
    cut = F.coalesce("split", F.lit(1).cast("bigint"))
    own = own.join(split, "conv_id", "left").withColumn("split", cut)
    q1, q2 = F.col("p1").bitwiseXOR(_turn_hash(3)), F.col("p2").bitwiseXOR(_turn_hash(4))

    # Small subtrees, dealt to cells.
    at = F.col("pos") == F.col("split")
    tails = own.where("pos >= split").withColumns({"q1": q1, "q2": q2}).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("turns"),
        F.first("split").alias("first"),
        *[F.max(F.when(at, F.col(c))).alias(c) for c in ("p1", "p2", "q1", "q2")],
    )
    tails = stored(tails.join(paths.select("conv_id", "n", "ends"), "conv_id"), "tails")
    size = tails.agg(F.sum(F.size("turns"))).first()[0] or 0
    dealt = tails.withColumn("cell", F.pmod(F.xxhash64(*KEY), F.lit(max(1, -(-size // cell)))))
    below = stored(dealt.groupBy("cell").applyInArrow(cell_nodes, f"{NODE}, q1 bigint, q2 bigint"), "below")

    # Nodes above them, shared by cells.
    zero = F.lit(0).cast("bigint")
    root = paths.select("conv_id", "n", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("q1"), zero.alias("q2"), zero.alias("words"))
    upper = own.where("pos < split").select("conv_id", "n", F.col("pos").alias("depth"), *KEY, q1.alias("q1"), q2.alias("q2"), "words").unionByName(root)
    upper = stored(upper, "upper")
    nodes = upper.groupBy("depth", *KEY).agg(
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("q1", "q2", "words")]
    )
    nodes = stored(nodes, "upper_nodes")
    first = nodes.where("depth = 0").first()
    if first is None:
        return below.select(*COLUMNS)
    tops = below.where("q1 IS NOT NULL")
    above = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = tops.select(*above).unionByName(nodes.where("depth > 0").select(*above)).groupBy("depth", *KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, ["depth", *KEY], "left").withColumn("n_children", F.coalesce("n_children", zero)), "upper_nodes")

    # Each subtree and each shared node adds to one path; its ancestors are what comes before on that path.
    given = tops.select("conv_id", (F.col("depth") - 1).alias("depth"), "n_leaves", "saved_tokens")
    leaf, saved = (F.col("n_children") == 0).cast("bigint"), (F.col("n_convs") - 1) * F.col("words")
    given = given.unionByName(nodes.select("conv_id", "depth", leaf.alias("n_leaves"), saved.alias("saved_tokens")))
    sums = ["n_leaves", "saved_tokens"]
    given = given.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in sums])
    carried = upper.join(given, ["conv_id", "depth"], "left").select("conv_id", "depth", *KEY, *[F.coalesce(c, zero).alias(c) for c in sums])
    totals = _suffix_sums(carried, sums).groupBy("depth", *KEY).agg(*[F.sum(c).alias(c) for c in sums])
    ends = paths.select(F.col("len").alias("depth"), *KEY, F.col("ends").alias("ends_sha256"))
    shared = nodes.join(totals, ["depth", *KEY]).join(ends, ["depth", *KEY], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))

    # Parents of shared nodes and of the subtrees' first nodes; all but the root's children by their hash.
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("up"))

    def with_parent(some: DataFrame) -> DataFrame:
        deep = some.where("depth > 1").drop("parent_conv_id").join(parents.where("depth > 1"), ["depth", "q1", "q2"], "left")
        deep = deep.withColumnRenamed("up", "parent_conv_id").select(*COLUMNS)
        near = F.when(F.col("depth") == 1, F.lit(first.conv_id).cast("bigint"))
        return deep.unionByName(some.where("depth <= 1").withColumn("parent_conv_id", near).select(*COLUMNS))

    inner = below.where("q1 IS NULL").select(*COLUMNS)
    return inner.unionByName(with_parent(tops)).unionByName(with_parent(shared))


SQL = """
WITH crc AS (
  SELECT conv_id, 4294967295 - list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, (i + 1)::INT, 1))::BIGINT)),
    lambda c, o: list_reduce(list_prepend(xor(c, o), range(8)), lambda s, i: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), both_parts AS (
  SELECT c.conv_id, 0 AS part, p.pos, role, text FROM crc c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 20 AND p.pos <= c.crc % 4
  UNION ALL
  SELECT c.conv_id, 1, p.pos, role, text FROM crc c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.crc % 4
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS pos, role, text FROM both_parts
), keyed AS (
  SELECT conv_id, pos, string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
      OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS key,
    length(regexp_replace(regexp_replace(text, '[^ \\t\\n\\x0B\\f\\r]+', 'w', 'g'), '[^w]+', '', 'g')) AS words
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM crc
), spans AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY pos) AS up, pos = max(pos) OVER (PARTITION BY conv_id) AS is_end FROM keyed
), nodes AS (
  SELECT pos AS depth, key, any_value(up) AS up, any_value(words) AS words, count(*) AS n_convs, min(conv_id) AS conv_id,
    sha256(coalesce(string_agg(CASE WHEN is_end THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM spans GROUP BY pos, key
), children AS (
  SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), whole AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, key)
), sums AS (
  SELECT s.pos AS depth, s.key, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved_tokens
  FROM spans s JOIN whole w ON w.conv_id = s.conv_id AND w.depth >= s.pos GROUP BY ALL
)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN sums s USING (depth, key) LEFT JOIN whole p ON p.depth = w.depth - 1 AND p.key = w.up
"""
