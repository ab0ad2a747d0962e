"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1.  Each document gets a MinHash signature of its 5-word shingle set and a 128-bit hash of the set. Documents with equal
    sets form one node; partial aggregation folds copies before anything is sent, so later steps see different sets only.
2.  The forest: TREES trees order the nodes by their signature, each starting at another place. Nodes whose first two values
    agree are a region of that tree; regions of one node are dropped by a count on narrow rows. The rest is
    range-partitioned and sorted by (region, rest of the signature), so the nodes with the longest common prefixes are
    neighbours. A region of more than SLICE nodes is split at the shortest common prefixes of neighbours, again and again,
    until its groups fit a slice: the depth is as large as each part of a region needs.
3.  In each slice a node's smallest and most similar candidate is verified on the full sets; that contracts groups of copies
    to few components with a number of pairs in proportion to the nodes. Pairs that agree on too few values to be similar
    are not candidates.
4.  Every region that still has different components is then settled. One that fits a cell (SLICE nodes, and as many
    bytes of shingles) is compared whole. In larger ones depth cannot tell what is similar, because the nodes share most of
    their text; their nodes are joined exactly, by prefixes: of two sets with similarity t, the larger has one of the
    smaller's rarest (1 - 2t/(1+t)) share of shingles among its own rarest (1 - t) share, so nodes that share such a rare
    shingle are a cell. What many nodes have in common is rare in none of them and makes no cell.
5.  Where candidates of a cell lie in different components, the sets of the nodes concerned come together once per cell, all
    their intersections are counted, and only links that join components leave. A cell that is too large is dealt to
    blocks, and each two blocks meet. No pair of nodes becomes a row and nothing is capped.

At similarity 0.75, twenty trees of depth two miss a pair with probability (1 - 0.75**2)**20 < 1e-7; neither the size of a
region nor the number of partitions changes that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.llm.shared import cut, join_counted, mix, release, shingles, span_hashes, text_blocks, uncut, without_ids, word_spans

WIDTH, PER_CENT = 5, 75
TREES, DEPTH = 20, 2
VALUES = TREES * DEPTH
#: Values that a candidate pair must share. At similarity 0.75 the number is binomial(40, 0.75); under 16 has p < 1e-6.
AGREE = 16
#: Nodes of a cell or slice at most. A node counts as one for each UNIT shingles, so a cell's sets are bounded too.
SLICE, UNIT = 2048, 512
#: Rows that a task gathers before it sends them on; a cell or slice adds some thousands at most.
SENT = 1 << 16
#: The first round over rare shingles takes one in SIFT of them: it joins most of what is similar at a fraction of the work.
SIFT = 16
#: Bits of the table that tells which documents' sets are wanted: so many a node, and at most 2^27 (16 MB).
NODE_BITS, MOST_BITS = 64, 1 << 27

_MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _block_sets(batches: Iterator[pa.RecordBatch], text: int, width: int):
    """Per block: the block, sorted distinct shingle hashes of all documents one after another, and their numbers."""
    for block in text_blocks(batches, text):
        starts, ends, per = word_spans(block)
        grams, counts = shingles(span_hashes(block.buf, starts, ends, True), per, width)
        at, sets = np.cumsum(counts) - counts, []
        for a, n in zip(at.tolist(), counts.tolist(), strict=True):
            part = np.sort(grams[a : a + n])
            sets.append(part[np.concatenate(([True], part[1:] != part[:-1]))] if n > 1 else part)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        yield block, np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes


def set_hashes(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, which do not depend on order."""
    at = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.zeros((2, len(sizes)), np.uint64)
    if len(at):
        for k, salt in enumerate((0x51ED270B35C9A1D3, 0x7C3D1F8A6E5B4921)):
            out[k, sizes > 0] = np.add.reduceat(mix(flat ^ np.uint64(salt)), at)
    return out[0].view(np.int64), out[1].view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, s1, s2 and sig (VALUES big-endian 32-bit minima, null for an empty set); one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, flat, sizes in _block_sets(batches, 1, width):
            some = np.flatnonzero(sizes)
            at = (np.cumsum(sizes) - sizes)[some]
            sig = np.zeros((len(sizes), VALUES), ">u4")
            for p in range(VALUES if len(some) else 0):
                sig[some, p] = np.minimum.reduceat(flat * _MULTIPLIERS[p], at) >> np.uint64(32)
            s1, s2 = set_hashes(flat, sizes)
            raw = [s.tobytes() if n else None for s, n in zip(sig, sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(sizes), pa.array(s1), pa.array(s2), pa.array(raw, pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, s1 bigint, s2 bigint, sig binary")


def _regions(nodes: DataFrame) -> DataFrame:
    """key, ord, node, t and the region's weight n, for each tree in which the node shares its region. ord: the rest of the
    signature, in the tree's order. nodes: node, sig, n_shingles."""
    wide = 4 * DEPTH
    trees = F.explode(F.array(*[F.lit(t) for t in range(TREES)])).alias("t")
    weight = F.ceil((F.col("n_shingles") + 1) / UNIT).alias("w")
    narrow = nodes.select("node", "sig", weight, trees).select("node", F.xxhash64("t", F.expr(f"substring(sig, {wide} * t + 1, {wide})")).alias("key"), "t", "w")
    crowded = cut(narrow.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("n")).filter("k > 1"), "crowded")
    kept = join_counted(narrow.drop("w"), crowded, ["key"], "k").drop("k")
    order = F.expr(f"concat(substring(sig, {wide} * t + 1), substring(sig, 1, {wide} * t))")
    return kept.join(nodes.select("node", "sig"), "node").select("key", order.alias("ord"), "node", "t", "n")


def _agreements(sig: np.ndarray, a: int, b: int, base: int = 0) -> np.ndarray:
    """Numbers of equal values between rows a..b and all rows from base."""
    out = np.zeros((b - a, len(sig) - base), np.uint8)
    for p in range(sig.shape[1]):
        out += sig[a:b, p, None] == sig[None, base:, p]
    return out


def _propose(nodes: np.ndarray, labels: np.ndarray, sig: np.ndarray) -> list[np.ndarray]:
    """For each node of one slice its least and its most similar candidate, as arrays (a, b, agreements) with a > b."""
    out = []
    for at in range(0, len(nodes), 128):
        to = min(at + 128, len(nodes))
        near = _agreements(sig, at, to)
        near[(near < AGREE) | (labels[at:to, None] == labels[None, :])] = 0
        rows = np.flatnonzero(near.any(1))
        best = near[rows].argmax(1)
        least = np.where(near[rows] > 0, nodes[None, :], np.iinfo(np.int64).max).argmin(1)
        i, j = np.concatenate((rows, rows)), np.concatenate((best, least))
        if len(i):
            a, b = nodes[at + i], nodes[j]
            out.append(np.stack((np.maximum(a, b), np.minimum(a, b), near[i, j].astype(np.int64))))
    return out


def _concerned(labels: np.ndarray, sig: np.ndarray, tree: int, first: int) -> np.ndarray:
    """Nodes of one cell with a candidate in another component that no earlier tree has in one region with them.

    The earlier tree compares that pair itself, because regions are compared whole. The first rows are one block and meet
    the others; if they are all, they meet each other.
    """
    hit = np.zeros(len(labels), bool)
    base = first if first < len(labels) else 0
    for at in range(0, first, 128):
        to = min(at + 128, first)
        near = (_agreements(sig, at, to, base) >= AGREE) & (labels[at:to, None] != labels[None, base:])
        for t in range(tree):
            if not near.any():
                break
            same = np.ones_like(near)
            for k in range(DEPTH * t, DEPTH * (t + 1)):
                same &= sig[at:to, k, None] == sig[None, base:, k]
            near &= ~same
        hit[at:to] |= near.any(1)
        hit[base:] |= near.any(0)
    return np.flatnonzero(hit)


def _signatures_of(ords: pa.Array, tree: np.ndarray) -> np.ndarray:
    """Signatures in one order again, from each tree's order."""
    raw = np.frombuffer(b"".join(ords.to_pylist()), ">u4").astype(np.uint32).reshape(len(ords), VALUES)
    return raw[np.arange(len(raw))[:, None], (np.arange(VALUES)[None, :] - DEPTH * tree[:, None]) % VALUES]


def _celled(rows: DataFrame, size: int) -> DataFrame:
    """rows (key, ord, node, label, t, n) with cell and side, once for each cell of the group that the node is in.

    A group of weight n up to `size` is one cell. The nodes of a larger one are dealt to blocks by hash, and each two blocks
    are a cell, as is each block alone; side tells its two blocks apart.
    """
    blocks = F.when(F.col("n") <= size, 1).otherwise(F.ceil(F.col("n") * 2 / size)).cast("int")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node", "key"), blocks).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return met.select(cell.alias("cell"), (F.col("block") > F.col("other")).cast("int").alias("side"), "ord", "node", "label", "t")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(nodes, labels, signatures, tree, rows of the first side) of each cell, from rows sorted by (cell, side)."""
    rest: tuple[np.ndarray, ...] | None = None

    def one(rows: tuple[np.ndarray, ...], a: int, b: int):
        return rows[2][a:b], rows[3][a:b], rows[4][a:b], int(rows[5][a]), int((rows[1][a:b] == 0).sum())

    for batch in batches:
        tree = np.asarray(batch.column(5)).astype(np.int64)
        rows = (*(np.asarray(batch.column(k)) for k in (0, 1, 3, 4)), _signatures_of(batch.column(2), tree), tree)
        if rest is not None:
            rows = tuple(np.concatenate(x) for x in zip(rest, rows, strict=True))
        edges = np.flatnonzero(np.diff(rows[0], prepend=rows[0][:1])).tolist()
        for a, b in zip([0, *edges], edges, strict=False):
            if b - a > 1:
                yield one(rows, a, b)
        rest = tuple(c[edges[-1] if edges else 0 :] for c in rows)
    if rest is not None and len(rest[0]) > 1:
        yield one(rest, 0, len(rest[0]))
    release()


def prefix_slices(sig: np.ndarray, size: int, depth: int = DEPTH) -> list[tuple[int, int]]:
    """Slices of at most `size` rows of sorted signatures (columns in the tree's order, equal in the first `depth`).

    Rows are parted where neighbours' common prefix is shortest; neighbouring parts that fit together stay together.
    Rows with equal signatures that are too many are cut anywhere.
    """
    n = len(sig)
    if n <= size:
        return [(0, n)]
    if depth == sig.shape[1]:
        return [(a, min(n, a + size)) for a in range(0, n, size)]
    edges = np.flatnonzero(sig[1:, depth] != sig[:-1, depth]) + 1
    out: list[tuple[int, int]] = []
    begin = 0
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
        if b - begin <= size:
            continue
        if a > begin:
            out.append((begin, a))
        if b - a > size:
            out += [(a + x, a + y) for x, y in prefix_slices(sig[a:b], size, depth + 1)]
            begin = b
        else:
            begin = a
    if begin < n:
        out.append((begin, n))
    return out


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, labels, signatures) of each slice, from sorted rows (key, ord, node, label, t).

    At most some four slices of one region are held at a time; a region that goes on is cut there.
    """
    rest: tuple[np.ndarray, ...] | None = None

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        tree = np.asarray(batch.column(4)).astype(np.int64)
        return np.asarray(batch.column(0)), np.asarray(batch.column(2)), np.asarray(batch.column(3)), _signatures_of(batch.column(1), tree), tree

    def region(rows: tuple[np.ndarray, ...], a: int, b: int):
        if b - a < 2:
            return
        tree = int(rows[4][a])
        for x, y in prefix_slices(np.roll(rows[3][a:b], -DEPTH * tree, axis=1), size) if b - a > size else [(0, b - a)]:
            if y - x > 1:
                yield rows[1][a + x : a + y], rows[2][a + x : a + y], rows[3][a + x : a + y]

    for batch in batches:
        rows = columns(batch)
        if rest is not None:
            rows = tuple(np.concatenate(x) for x in zip(rest, rows, strict=True))
        edges = [0, *(np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield from region(rows, a, b)
        if len(rows[0]) - edges[-1] > 4 * size:
            yield from region(rows, edges[-1], len(rows[0]))
            rest = None
        else:
            rest = tuple(c[edges[-1] :] for c in rows)
    if rest is not None:
        yield from region(rest, 0, len(rest[0]))
    release()


def _candidates(sorted_rows: DataFrame, size: int) -> DataFrame:
    """a, b, agree from rows (key, ord, node, label, t) that are sorted within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held = 0

        def out():
            a, b, n = np.concatenate(found, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "agree"])

        for node, label, sig in _slices(batches, size):
            before = len(found)
            if len(node) == 2:
                n = int((sig[0] == sig[1]).sum())
                if n >= AGREE and label[0] != label[1]:
                    found.append(np.array([[max(node)], [min(node)], [n]], np.int64))
            else:
                found += _propose(node, label, sig)
            held += sum(x.shape[1] for x in found[before:])
            if held > SENT:
                yield out()
                found, held = [], 0
        if found:
            yield out()

    return sorted_rows.select("key", "ord", "node", "label", "t").mapInArrow(run, "a bigint, b bigint, agree bigint")


def _open_rows(cells: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]], number: int) -> Iterator[pa.RecordBatch]:
    """slice (numbers after `number`), node, label of the cells' concerned nodes; a batch has SENT rows and a cell at most."""
    ids, nodes, labels, held = [], [], [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, nodes, labels)], ["slice", "node", "label"])

    for node, label, sig, tree, first in cells:
        hit = _concerned(label, sig, tree, first)
        if len(hit):
            number += 1
            held += len(hit)
            ids.append(np.full(len(hit), number, np.int64))
            nodes.append(node[hit])
            labels.append(label[hit])
        if held > SENT:
            yield out()
            ids, nodes, labels, held = [], [], [], 0
    if ids:
        yield out()


def _unsettled(rows: DataFrame, size: int) -> DataFrame:
    """slice, node, label: the nodes of each cell that have a candidate in another component; a slice is one cell's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return _open_rows(_cells(batches), TaskContext.get().partitionId() << 40)

    cells = _celled(rows, size).repartition("cell").sortWithinPartitions("cell", "side")
    return cells.select("cell", "side", "ord", "node", "label", "t").mapInArrow(run, "slice bigint, node bigint, label bigint")


def _settle(members: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) between components from rows (slice, node, label, grams): a spanning set of each slice's links."""

    def links(nodes: list[int], labels: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        total = len(sets)
        sizes = np.fromiter(map(len, sets), np.int64, total)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(total), sizes)
        order = np.argsort(flat, kind="stable")
        posting, new = owner[order], np.diff(flat[order], prepend=~flat[order[:1]]) != 0
        start = np.flatnonzero(new)
        times = np.diff(np.append(start, len(flat)))
        group = np.empty(len(flat), np.int64)
        group[order] = np.cumsum(new) - 1
        # shingles of many sets are counted by matrix products, the others by their postings
        shared = np.zeros((total, total), np.float32)
        common = np.flatnonzero(times * 16 > total)
        for at in range(0, len(common), 512):
            some = common[at : at + 512]
            many = times[some]
            ends = np.cumsum(many)
            held = np.zeros((total, len(some)), np.float32)
            held[posting[np.repeat(start[some] - (ends - many), many) + np.arange(int(ends[-1]))], np.repeat(np.arange(len(some)), many)] = 1
            shared += held @ held.T
        rare = (times > 1) & (times * 16 <= total)
        of_rare = rare[group]
        rare_groups, bounds = group[of_rare], np.searchsorted(owner[of_rare], np.arange(total + 1)).tolist()
        names = np.array(labels)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        made = []
        for i in range(total):
            both, own = shared[i].astype(np.int64), rare_groups[bounds[i] : bounds[i + 1]]
            if len(own):
                many = times[own]
                ends = np.cumsum(many)
                both += np.bincount(posting[np.repeat(start[own] - (ends - many), many) + np.arange(int(ends[-1]))], minlength=total)
            for j in np.flatnonzero((100 * both >= per_cent * (sizes[i] + sizes - both))[:i] & (names[:i] != names[i])).tolist():
                x, y = root(labels[i]), root(labels[j])
                if x != y:
                    up[x] = y
                    made.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            found = []
            for s, node, label, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if len(rows) > 1:
                        found += links(*zip(*rows, strict=True))
                    now, rows = s, []
                rows.append((node, label, np.frombuffer(grams, np.uint64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        if len(rows) > 1 and (found := links(*zip(*rows, strict=True))):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        rows = []
        release()

    return members.select("slice", "node", "label", "grams").repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "a bigint, b bigint")


def _marks(wanted: DataFrame) -> np.ndarray:
    """A table of bits, a power of two of them, in which the bit of each wanted node's hash is set."""
    most = 64
    while most < MOST_BITS and most < NODE_BITS * wanted.count():
        most *= 2
    at = wanted.select(F.col("node").alias("v")).select(F.expr(f"xxhash64(v) & {most - 1}").alias("p"))
    # one row per word of the table that is not 0
    words = at.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.expr("cast(p & 63 as int)"))).alias("v")).toArrow()
    table = np.zeros(most // 64, np.int64)
    table[np.asarray(words["w"])] = np.asarray(words["v"])
    return table.view(np.uint64)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """node and its full set (sorted distinct 64-bit hashes) for the wanted nodes, and for some others whose bits meet theirs.

    Documents stay where they are read: a table of bits tells each task which of them to look at, so no text is exchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_marks(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value

        def marked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = np.asarray(batch.column(2)).view(np.uint64) & np.uint64(64 * len(marks) - 1)
                yield batch.filter(pa.array((marks[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1))

        for block, flat, sizes in _block_sets(marked(), 1, width):
            ends = np.cumsum(sizes)
            raw = [flat[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(raw, pa.binary())], ["node", "grams"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).cast("string").alias("t")).filter("node is not null")
    return texts.withColumn("h", F.xxhash64("node")).mapInArrow(run, "node bigint, grams binary").filter("length(grams) > 0")


def _verify(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """pairs with linked: 100 * intersection >= per_cent * union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((p, q))
                both.sort(kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                verdict.append(100 * n >= per_cent * (len(p) + len(q) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdict, pa.bool_())], ["a", "b", "linked"])
        release()

    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(run, "a bigint, b bigint, linked boolean")


def _rare(sets: DataFrame, per_cent: int) -> DataFrame:
    """gram, node, small: each node's rarest shingles (by how many of the nodes have them), those that others have too.

    Of two sets with the similarity, the larger has one of the smaller's shingles marked `small` in its rows. sets: node,
    grams (packed, distinct).
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = np.frombuffer(raw.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), node, np.int64)), pa.array(grams)], ["node", "gram"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, grams, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams, times = np.array(grams, np.int64), np.array(times, np.int64)
                grams, times = (x[np.lexsort((grams, times))] for x in (grams, times))
                n = len(grams)
                probe = n - -(-per_cent * n // 100) + 1
                index = n - -(-2 * per_cent * n // (100 + per_cent)) + 1
                some = np.flatnonzero(times[:probe] > 1)
                yield pa.RecordBatch.from_arrays([pa.array(grams[some]), pa.array(np.full(len(some), node, np.int64)), pa.array(some < index)], ["gram", "node", "small"])

    rows = cut(sets.select("node", "grams").mapInArrow(explode, "node bigint, gram bigint"), "grams")
    times = cut(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("times")), "times")
    known = join_counted(rows, times, ["gram"], "times")
    listed = known.groupBy("node").agg(F.collect_list(F.struct("gram", "times")).alias("x")).select("node", F.col("x.gram").alias("gram"), F.col("x.times").alias("times"))
    rare = cut(listed.mapInArrow(pick, "gram bigint, node bigint, small boolean"), "rare")
    uncut(rows, times)
    return rare


def _crowd_links(docs: DataFrame, crowd: DataFrame, signed: DataFrame, labels: DataFrame | None, found: list[DataFrame], id_col: str, text_col: str, width: int, per_cent: int, size: int) -> list[DataFrame]:
    """Links between the nodes of crowd (node), by the shingles that are rare among them. signed: node, sig, n_shingles."""
    sets = cut(_sets(docs, crowd, id_col, text_col, width).join(crowd, "node", "left_semi"), "sets")
    rare = _rare(sets, per_cent)
    many = crowd.count() > SIFT * size
    about = cut(crowd.join(signed, "node"), "about")
    made: list[DataFrame] = []
    for sift in (SIFT, 1) if many else (1,):
        if made and made[-1].limit(1).count():
            labels = components(_union([*found, *made]))
        now = about.select("node", F.ceil((F.col("n_shingles") + 1) / UNIT).alias("w"))
        now = now.withColumn("label", F.col("node")) if labels is None else now.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rows = rare.filter(F.pmod("gram", F.lit(sift)) == 0).join(now, "node")
        mixed = cut(rows.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("w").alias("n"), F.count(F.lit(1)).alias("k"), F.max("small").alias("any")).filter("lo < hi and any").select("gram", "n", "k"), "mixed")
        met = join_counted(rows, mixed, ["gram"], "k").join(about.select("node", "sig"), "node")
        cells = met.select(F.col("gram").alias("key"), F.col("sig").alias("ord"), "node", "label", F.lit(0).alias("t"), "n")
        open_ = cut(_unsettled(cells, size), "open")
        made.append(cut(_settle(open_.join(sets, "node"), per_cent), "links"))
        uncut(open_)
    uncut(sets, rare, about)
    return made


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the least node that can be reached.

    Labels move to the least label among neighbours and then jump to their label's label, so long chains halve each
    round; the rounds end when no label moves. Each is written to the shared folder; only counts reach the driver.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")

    def moved(now: DataFrame) -> DataFrame:
        near = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        least = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        jump = now.select(F.col("node").alias("l"), F.col("label").alias("far"))
        return least.join(jump, "l", "left").select("node", "old", F.least("l", F.coalesce("far", "l")).alias("label"))

    while True:
        new = cut(moved(moved(labels).select("node", "label")), "labels")  # two steps a round; none has moved if the second moves none
        labels = new.select("node", "label")
        if not new.filter("label != old").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, per_cent: int = PER_CENT, size: int = SLICE) -> DataFrame:
    """doc_id, n_shingles, component_id (least reachable id, itself included), kept; one row per input row.

    Null, empty or wordless text: no shingles, linked with nothing. Null ids: component_id null, kept, linked with nothing.
    Rows that share an id are one document with the links of all its texts; repeated rows and equal texts are one node. Ids
    are numbers that fit a bigint. A long text is a block of its own, and its set one value. An empty table gives no rows.
    Only the id and the text are read, so other names cannot clash. size: nodes that are compared whole.
    """
    signed = cut(signatures(docs, id_col, text_col, width), "signatures")
    known = signed.filter("doc_id is not null and n_shingles > 0")
    classes = cut(known.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").cast("bigint").alias("node"), F.first("sig").alias("sig")), "classes")
    regions = cut(_regions(classes.select("node", "sig", "n_shingles")), "regions")

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange("key", "ord", "node").sortWithinPartitions("key", "ord", "node")

    labels, found = None, []
    pairs = cut(_candidates(ordered(regions.withColumn("label", F.col("node"))), size).groupBy("a", "b").agg(F.max("agree").alias("agree")).filter("a != b"), "pairs")
    if regions.limit(1).count():
        sets = cut(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), id_col, text_col, width), "sets")
        ends = pairs.select(F.col("a").alias("v"), F.col("b").alias("w"), "agree").union(pairs.select(F.col("b").alias("v"), F.col("a").alias("w"), "agree"))
        one = ends.groupBy("v").agg(F.min("w").alias("w1"), F.max_by("w", F.struct("agree", "w")).alias("w2"))
        chosen = one.select("v", F.explode(F.array("w1", "w2")).alias("w")).select(F.greatest("v", "w").alias("a"), F.least("v", "w").alias("b")).distinct()
        found.append(cut(_verify(chosen, sets, per_cent).filter("linked").select("a", "b"), "links"))
        labels = components(found[0])
        rows = regions.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = cut(rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("k")).filter("lo < hi").select("key", "k"), "mixed")
        still = join_counted(rows, mixed, ["key"], "k").drop("k")
        open_ = cut(_unsettled(still.filter(F.col("n") <= size), size), "open")
        # a node that had no candidate in its slices has its set not there yet
        late = cut(open_.select("node").distinct().join(sets.select("node"), "node", "left_anti"), "late")
        if late.limit(1).count():
            sets = sets.unionByName(cut(_sets(docs, late, id_col, text_col, width).join(late, "node", "left_semi"), "sets"))
        more = cut(_settle(open_.join(sets, "node"), per_cent), "links")
        crowd = cut(still.filter(F.col("n") > size).select("node").distinct(), "crowd")
        uncut(sets, open_, pairs, regions)
        if more.limit(1).count():
            found.append(more)
            labels = components(_union(found))
        if crowd.limit(1).count():
            late = _union(_crowd_links(docs, crowd, classes.select("node", "sig", "n_shingles"), labels, found, id_col, text_col, width, per_cent, size))
            if late.limit(1).count():
                labels = components(_union([*found, late]))
    keyed = classes.select("s1", "s2", "n_shingles", "node")
    if labels is not None:
        keyed = keyed.join(labels, "node", "left")
    keyed = keyed.select("s1", "s2", "n_shingles", F.coalesce("label", "node").alias("component") if labels is not None else F.col("node").alias("component"))
    out = signed.drop("sig").join(keyed, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id").cast("bigint")).otherwise(F.col("component"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are near-duplicates of one with a smaller id, with all columns, whatever their names.

    Rows with a null id and texts without words stay. Rows that share an id are one document: they stay or go together.
    An empty table gives no rows.
    """
    return without_ids(docs, near_duplicates(docs, id_col=id_col, text_col=text_col).filter("not kept").select("doc_id"), id_col)
