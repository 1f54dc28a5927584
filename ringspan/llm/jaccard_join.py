"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Texts with the same words collapse to a node (first 128 bits of the SHA-256 of the words); copies are counted, not
   paired. 2. A node's signature is its label in each of 24 prefix tries, six 16-bit values deep. Two nodes meet in a
   trie if they share the matched prefix there. 3. The matched prefix is shortened from the full six values cell by cell:
   a cell is what shares the prefix of the shortest depth, 4 at a similarity of 0.8. Cells of few nodes are matched at
   that depth. Cells of many keep the full depth as long as every member still meets a partner at the threshold with the
   target recall over its 24 tries; otherwise theirs is shortened to 5, at which any node has it (:func:`depths`). 4. A
   pair belongs to the first trie where it meets and is looked at there alone. Within a cell, in blocks, signatures are
   compared; nodes with a partner of their own there whose estimate is 0.6 or more (six standard deviations below 0.8)
   go on to the exact check. 5. The shingle sets of those nodes are sent to these cells, in blocks, and each pair that
   met is verified exactly; a node's links are counted, and a star of verified links a block leaves the task.
   6. Components of the verified links are the classes.

Nothing closes transitively before verification, so a chain of loosely similar texts costs what its pairs in a cell
cost. Rows that move are linear in the documents but for cells over 1,024 nodes, whose members are sent to each pair of
blocks; pairs are never emitted. No partner or candidate is capped.

Edge cases: a text of 1 to 4 words has one shingle, all its words; a text without words (also null) links to nothing and
is its own class. Repeated ids and rows each get a row. A null id is the class of a group only if all its ids are null.
Extra columns are ignored by :func:`join` and kept by :func:`keep_one`. An empty table gives an empty table. A threshold
so low that no depth reaches the target recall raises an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import SHINGLE, SPACES, discard, small_batches, table, tidy, words_of, written

THRESHOLD, TARGET_RECALL = 0.8, 0.9999
TREES, DEPTH = 24, 6
ESTIMATE_SLACK = 0.2
#: Nodes above which a cell is matched at a longer prefix.
HOT_CELL = 256
BLOCK_NODES, BLOCK_BYTES = 1024, 32 << 20
SMALL_SIDE = 200_000
VALUES = TREES * DEPTH

_draw = np.random.Generator(np.random.PCG64(20240611))
_XOR = _draw.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_MUL = _draw.integers(0, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_PLACE = _draw.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def match_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold is met with the target recall, if it is the same in all tries."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= target:
            return d
    raise ValueError(f"{trees} tries do not reach a recall of {target} at a similarity of {threshold}")


def depths(threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> tuple[int, int, int, int]:
    """(least, middle, full, most): cells of few nodes are matched at ``least``; cells of many at ``full``, if none of
    their members has more than ``most`` such cells, else at ``middle``, where every node reaches the target."""
    middle = match_depth(threshold, target, trees, depth)
    least, full = max(1, middle - 1), min(depth, middle + 1)
    miss = lambda d: math.log(1 - threshold**d) if threshold < 1 else -math.inf
    if full == middle or threshold >= 1:
        return least, middle, full, trees
    return least, middle, full, int((math.log(1 - target) - trees * miss(least)) / (miss(full) - miss(least)))


def _finish(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def shingles(words: np.ndarray) -> np.ndarray:
    """Shingle hashes, in order, of one text's word hashes (uint64)."""
    n = len(words)
    if n < SHINGLE:
        return _finish(np.array([np.add.reduce(words * _PLACE[:n]) + np.uint64(n)], np.uint64)) if n else np.empty(0, np.uint64)
    out = words[: n - SHINGLE + 1] * _PLACE[0]
    for k in range(1, SHINGLE):
        out += words[k : n - SHINGLE + 1 + k] * _PLACE[k]
    return _finish(out)


def _word_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values, dtype=np.int64).view(np.uint64), offsets


def signature(parts: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row a text (no text is empty)."""
    flat, starts = np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts[:-1]])
    out, work = np.empty((len(parts), VALUES), np.uint32), np.empty_like(flat)
    for k in range(VALUES):
        np.bitwise_xor(flat, _XOR[k], out=work)
        np.multiply(work, _MUL[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out


def _signatures(batches):
    for batch in batches:
        flat, offsets = _word_lists(batch.column("h"))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 200_000)) - 1)
            end = min(end, batch.num_rows, at + 1000)
            values = signature([shingles(flat[offsets[i] : offsets[i + 1]]) for i in range(at, end)])
            rows, part = [v.tobytes() for v in values.astype(np.uint16)], batch.slice(at, end - at)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(rows, pa.binary())], names=["doc_id", "node", "signature"])
            at = end


def node_of(words: str) -> Column:
    return F.when(F.size(words) > 0, F.unhex(F.substr(F.sha2(F.array_join(words, " "), 256), F.lit(1), F.lit(32))))


def nodes_of(docs: DataFrame) -> DataFrame:
    """doc_id, node, h (word hashes); null node for a text without words."""
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("_w"))
    return one.select("doc_id", node_of("_w").alias("node"), F.transform("_w", lambda w: F.xxhash64(w)).alias("h"))


def _runs(batches, keys: int):
    """Lists of rows that share their first ``keys`` columns, of sorted batches."""
    held, now = [], None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != now:
                if held:
                    yield held
                held, now = [], row[:keys]
            held.append(row)
    if held:
        yield held


class Union:
    """Union-find over 0..n-1 whose roots are the least members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)

    def star(self) -> list[tuple[int, int]]:
        return [(r, i) for i in range(len(self.up)) if (r := self.root(i)) != i]


def _sides(run: list[tuple], at: int) -> tuple[list[int], list[int]]:
    """Rows of the two blocks of a run; both are the same within one block."""
    first, second = run[0][at], run[0][at + 1]
    if first == second:
        return (every := list(range(len(run)))), every
    return [i for i, r in enumerate(run) if r[at + 2] == first], [i for i, r in enumerate(run) if r[at + 2] == second]


class Block:
    """Rows of one cell, in one block or a pair of them: (cell, block, block, own block, trie, node, signature, cuts, ...).
    ``partners`` gives, for each row, the rows after it that it meets here first and whose estimate is high enough."""

    def __init__(self, run: list[tuple], least: float, depth: int):
        self.rows = sorted({r[5]: r for r in run}.values(), key=lambda r: r[5])
        self.left, right = _sides(self.rows, 1)
        self.same, self.right, self.tree, self.least = run[0][1] == run[0][2], np.array(right, int), run[0][4], least * VALUES
        self.values = np.frombuffer(b"".join(r[6] for r in self.rows), np.uint16).reshape(-1, VALUES)
        # what must agree for two nodes to meet, a trie a column; those of one cell are cut at one depth
        cuts = np.array([r[7] or [depth] * TREES for r in self.rows])
        tries = self.values.reshape(-1, TREES, DEPTH).astype(np.uint64)
        self.cells = np.zeros(cuts.shape, np.uint64)
        for k in range(DEPTH):
            self.cells = np.where(k < cuts, _finish(self.cells * _MUL[k] + tries[:, :, k] + np.uint64(1)), self.cells)

    def partners(self, i: int, among: np.ndarray | None = None) -> np.ndarray:
        js = self.right if among is None else among
        if self.same:
            js = js[js > i]
        if self.tree and len(js):
            js = js[~(self.cells[js, : self.tree] == self.cells[i, : self.tree]).any(1)]
        return js[(self.values[js] == self.values[i]).sum(1) >= self.least] if len(js) else js


def _compare(least: float, depth: int):
    """Of runs as in :class:`Block`: the nodes that have a likely partner of this cell's own."""

    def run(batches):
        out = []
        for run in _runs(batches, 3):
            if len(run) < 2:
                continue
            block = Block(run, least, depth)
            marked = np.zeros(len(block.rows), bool)
            for i in block.left:
                # a node that is marked already looks for unmarked ones only
                found = block.partners(i, block.right[~marked[block.right]] if marked[i] else None)
                marked[found] = True
                marked[i] |= len(found) > 0
            out += [(run[0][0], run[0][4], block.rows[i][5]) for i in np.flatnonzero(marked)]
            if len(out) > 20_000:
                yield _members(out)
                out = []
        if out:
            yield _members(out)

    return run


def _members(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["cell", "tree", "node"])


def _sets(batches):
    for batch in batches:
        flat, offsets = _word_lists(batch.column("h"))
        sets = [np.unique(shingles(flat[offsets[i] : offsets[i + 1]])).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(map(len, sets)), pa.int64()), pa.array(sets, pa.binary())], names=["node", "bytes", "shingles"])


#: Partners above which a node is held against all sets of a block at once.
MANY = 8


class Postings:
    """Who of some sets holds each member."""

    def __init__(self, sets: list[np.ndarray]):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.n = flat[order], owner[order], len(sets)

    def shared(self, members: np.ndarray) -> np.ndarray:
        """How many members each set shares with this one."""
        a, n = np.searchsorted(self.flat, members, "left"), np.searchsorted(self.flat, members, "right")
        n -= a
        a, n = a[n > 0], n[n > 0]
        if not len(a):
            return np.zeros(self.n, np.int64)
        places = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[places], minlength=self.n)


def _verify(threshold: float, depth: int):
    """Of runs as in :class:`Block`, with copies and shingles: links of each node, and a star of each linked group."""

    def run(batches):
        names, kinds = ["a", "b", "links"], [pa.binary(), pa.binary(), pa.int64()]
        for run in _runs(batches, 3):
            if len(run) < 2:
                continue
            block = Block(run, threshold - ESTIMATE_SLACK, depth)
            rows, right = block.rows, block.right
            sets, copies = [np.frombuffer(r[9], np.uint64) for r in rows], np.array([r[8] for r in rows])
            sizes, union, links, postings = np.array([len(s) for s in sets]), Union(len(rows)), np.zeros(len(rows), np.int64), None
            for i in block.left:
                js = block.partners(i)
                if len(js) > MANY:
                    postings = postings or Postings([sets[j] for j in right])
                    shared = postings.shared(sets[i])[np.searchsorted(right, js)]
                else:
                    shared = np.array([len(np.intersect1d(sets[i], sets[j], True)) for j in js], np.int64)
                # shared / union >= threshold, in whole numbers of ten-thousandths
                like = js[shared * 10_000 >= round(threshold * 10_000) * (sizes[i] + sizes[js] - shared)]
                links[i] += copies[like].sum()
                links[like] += copies[i]
                for j in like:
                    if union.up[j] != union.up[i]:
                        union.join(i, int(j))
            out = [(r[5], None, int(n)) for r, n in zip(rows, links, strict=True) if n] + [(rows[a][5], rows[b][5], 0) for a, b in union.star()]
            for k in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 20_000], strict=True), kinds, strict=True)], names=names)

    return run


def in_blocks(rows: DataFrame, keys: str, blocks: Column) -> DataFrame:
    """Sends each row to every pair of blocks that holds its own: adds _i, _j (i <= j) and _own. A group of one block
    stays one row a member."""
    own = F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")
    dealt = rows.withColumn("_n", blocks.cast("int")).withColumn("_own", own)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(F.least(k, F.col("_own")).alias("_i"), F.greatest(k, F.col("_own")).alias("_j"))))
    return dealt.withColumn("_b", pair).select("*", "_b._i", "_b._j").drop("_b", "_n").repartition(keys, "_i", "_j").sortWithinPartitions(keys, "_i", "_j")


def cell(tree: Column, signature: Column, depth: Column) -> Column:
    """Hash of a trie's number and the prefix of a node's label there."""
    return F.xxhash64(tree, F.substring(signature, tree * (2 * DEPTH) + 1, depth * 2))


def counted(placed: DataFrame) -> DataFrame:
    """Cells of two nodes or more, with how many."""
    return placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")


def few_or_shuffled(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= SMALL_SIDE else side


def met_in(nodes: DataFrame, threshold: float, target: float) -> DataFrame:
    """nodes: node, signature. One row a node and trie in which it meets others: cell, _c (nodes of the cell), tree, node,
    signature, cuts (the matched depth in each trie, null where it is the least in all)."""
    least, middle, full, most = depths(threshold, target)
    label = nodes.select("node", "signature")
    placed = label.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), cell(t, F.col("signature"), F.lit(least)).alias("cell")))).alias("_p"), "node").select("_p.*", "node")
    cells = written(counted(placed), "cells")
    met = written(placed.join(few_or_shuffled(cells), "cell"), "met")
    rest = met.filter(F.col("_c") <= HOT_CELL).select("cell", "_c", "tree", "node")
    hot = met.filter(F.col("_c") > HOT_CELL)
    if hot.isEmpty() or middle == least:
        return met.select("cell", "_c", "tree", "node").join(label, "node").withColumn("cuts", F.lit(None).cast("array<int>"))
    # matched longer: as long as all members bear
    many = hot.groupBy("node").agg(F.count(F.lit(1)).alias("_hot"))
    lengths = written(hot.join(many, "node").groupBy("cell").agg(F.when(F.max("_hot") > most, middle).otherwise(full).alias("_depth")), "lengths")
    cut = written(hot.select("cell", "tree", "node").join(few_or_shuffled(lengths), "cell").join(label, "node").select("node", "tree", "_depth", cell(F.col("tree"), F.col("signature"), F.col("_depth")).alias("cell")), "cut")
    chosen = F.map_from_entries(F.collect_list(F.struct("tree", "_depth")))
    cuts = cut.groupBy("node").agg(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.try_element_at(chosen, t), F.lit(least))).alias("cuts"))
    again = cut.join(few_or_shuffled(counted(cut)), "cell").select("cell", "_c", "tree", "node")
    return rest.union(again).join(label.join(cuts, "node", "left"), "node").select("cell", "_c", "tree", "node", "signature", "cuts")


def likely(nodes: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """nodes: node, signature. (cell, tree, node of every node that has a likely partner in a cell of its own; cuts of
    the nodes whose matched depth isn't the least everywhere)."""
    met = written(met_in(nodes, threshold, target), "met")
    blocked = in_blocks(met, "cell", F.ceil(F.col("_c") / BLOCK_NODES)).select("cell", "_i", "_j", "_own", "tree", "node", "signature", "cuts")
    found = blocked.mapInArrow(tidy(_compare(threshold - ESTIMATE_SLACK, depths(threshold, target)[0])), "cell bigint, tree int, node binary").distinct()
    return written(found, "likely"), met.filter("cuts IS NOT NULL").select("node", "cuts").dropDuplicates(["node"])


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: doc_id, node; classed: node, label, class_id, n_links; texts without words: doc_id)."""
    small_batches(docs.sparkSession)
    least = depths(threshold, target)[0]
    signed = written(nodes_of(docs).filter("node IS NOT NULL").mapInArrow(tidy(_signatures), "doc_id bigint, node binary, signature binary"), "signatures")
    # one row a node; equal nodes have equal signatures
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("signature").alias("signature")), "nodes")
    members, cuts = likely(nodes.select("node", "signature"), threshold, target)
    chosen = nodes.join(members.select("node").distinct(), "node").select(F.col("node").alias("_node"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few_or_shuffled(chosen), F.col("doc_id").eqNullSafe(F.col("rep")))
    hashed = texts.select("_node", words_of(F.col("text")).alias("_w")).select("_node", node_of("_w").alias("node"), F.transform("_w", lambda w: F.xxhash64(w)).alias("h"))
    # a repeated id may stand for other texts as well
    sets = written(hashed.filter(F.col("node") == F.col("_node")).select("node", "h").mapInArrow(tidy(_sets), "node binary, bytes bigint, shingles binary").dropDuplicates(["node"]), "shingles")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("_blocks")
    sizes = members.join(sets.select("node", "bytes"), "node").groupBy("cell").agg(blocks)
    # the nodes' own data first, a row a node; then what is hot, the cells
    data = written(sets.join(nodes.select("node", "copies", "signature"), "node").join(cuts, "node", "left"), "sets")
    sent = in_blocks(members.join(few_or_shuffled(sizes), "cell").join(data, "node"), "cell", F.col("_blocks"))
    met = sent.select("cell", "_i", "_j", "_own", "tree", "node", "signature", "cuts", "copies", "shingles")
    verified = written(met.mapInArrow(tidy(_verify(threshold, least)), "a binary, b binary, links bigint"), "verified")
    links = verified.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(verified.filter("b IS NOT NULL").select("a", "b"), "classes")
    named = classes.join(nodes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("class_id"))
    found = classes.join(named, "label").join(links, "node").select("node", "label", "class_id", "links")
    class_id = F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("class_id"))
    summed = nodes.select("node", "rep", "copies").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"), class_id.alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classed = written(summed, "classed")
    discard(nodes, members, sets, data, verified)
    blank = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACES)) == ""
    return signed.select("doc_id", "node"), classed, docs.filter(blank).select(F.col("doc_id").cast("long").alias("doc_id"))


def join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), n_links (other documents at the threshold or
    above, copies included)."""
    members, classed, wordless = near_pairs(docs, threshold, target)
    alone = wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return members.join(classed, "node").select("doc_id", "class_id", F.col("n_links").cast("bigint").alias("n_links")).union(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """Documents less all but one of each class, all columns as they came. The one is a document with the class's
    least id; texts without words stay."""
    members, classed, _ = near_pairs(docs, threshold, target)
    # nothing but the join in this job, so that a node of many copies can be split
    told = written(members.join(classed.select("node", "label", "class_id"), "node"), "told")
    away = told.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    names = docs.columns
    words = words_of(docs["text"])
    node = F.when(F.size(words) > 0, F.unhex(F.substr(F.sha2(F.array_join(words, " "), 256), F.lit(1), F.lit(32))))
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), docs["doc_id"].cast("long").alias("_doc"), node.alias("_n"))
    few = away.count() <= SMALL_SIDE
    left = packed.join(F.broadcast(away) if few else away, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_node")), "left_anti")
    # several rows of a class with its least id (repeated rows): one stays. Rare, so it is looked for first.
    least = told.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", F.col("doc_id").alias("_id"), F.col("node").alias("_node")).count()
    again = written(least.groupBy("label").agg(F.sum("count").alias("n"), F.collect_set("_node").alias("_nodes")).filter("n > 1").select("label", F.explode("_nodes").alias("_node")), "again")
    if n := again.count():
        match = F.col("_n") == F.col("_node")
        first = F.row_number().over(Window.partitionBy("label").orderBy("_n", F.xxhash64("_row")))
        twice = left.join(F.broadcast(again) if n <= SMALL_SIDE else again, match)
        left = left.join(F.broadcast(again) if n <= SMALL_SIDE else again, match, "left_anti").select("_row").union(twice.withColumn("_first", first).filter("_first = 1").select("_row"))
    return left.select(*[F.col("_row")[c].alias(c) for c in names])


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: Ids are unique in the tables.
ORACLE = {"op8_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM k JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 10 * k >= 8 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS seen FROM (SELECT DISTINCT x FROM e) UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen),
c AS (SELECT doc_id, min(seen) AS class_id FROM r GROUP BY doc_id),
d AS (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x)
SELECT w.doc_id, coalesce(c.class_id, w.doc_id) AS class_id, coalesce(d.n_links, 0)::BIGINT AS n_links FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id"""}
