"""N-gram Jaccard self-join: shingle sets, a count-vector R-tree, exact verification.

A document's set holds the 64-bit hashes of its distinct ``SHINGLE``-word shingles. Two documents link when
9 * overlap >= 4 * (size + size), which is a Jaccard similarity of 0.8. Equal sets are one node.

Count vectors: shingles fall into hash groups, and a node is the point of its group counts. The overlap of two points
is at most the sum of their coordinate minima; the overlap of two R-tree boxes at most the sum of the minima of their
upper corners. Boxes use ``GROUPS`` coordinates; a point has as many groups (a power of two) as leave about
``PER_GROUP`` shingles in each, because counts of large groups are alike in all long documents, and two points compare
at the coarser of their resolutions. Pairs whose bound misses the requirement are pruned, the rest verified on the sets. One R-tree over a whole corpus would visit nearly every leaf (unrelated documents of one length have nearly
equal counts), so trees are built inside blocks that no link can leave:

* Prefix rule: with one global order of shingles, linked sets share one that is among the first
  size - ceil(8/9 size) + 1 of the smaller set (its index prefix, since the overlap is at least 4/9 of both sizes) and
  among the first size - ceil(0.8 size) + 1 of the larger one. Frequent shingles (at least 1 in ``RARE`` nodes of some
  batch and of the corpus, hence a bounded list) come last in the order, the commonest at the end; the rest go by hash.
* A rare prefix shingle is hashed to a bucket task, which names the least node of its block that has it in the index
  prefix the leader of the others; a frequent one gets its leader from a grouped minimum. Rows (leader, node) are
  distinct, so a pair that shares many shingles meets once per leader. Two nodes that have the shingles of a leader
  only past their index prefixes are not compared there, and a block of such nodes alone is none.
* Blocks above ``CHUNK`` nodes are cut into chunks that each contain the leader. Nodes that a chunk does not connect
  to the leader visit the rest of the block, in groups of about ``CHUNK`` hosts and ``CHUNK`` guests; the others are
  connected already, so no pair can be lost.
* Only nodes with a surviving pair ship their sets; a block verifies pairs that are not yet connected and returns a
  spanning forest. Components follow from the forests.

Defined cases: null and empty texts have an empty set and link with nothing; 1 to 4 words are one shingle; rows are
judged one by one, also with equal ids; a null id is ignored by the minimum unless its whole component has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.llm.common import DOC_COLUMNS, arrow_pass, documents, partitions, register
from tabula.llm.components import components
from tabula.llm.runs import bounds, by_runs, numpy_of
from tabula.session import materialize

SHINGLE = 5
GROUPS = 64
PER_GROUP = 6
RARE = 2048
CHUNK = 1024
LEAF, FAN = 32, 8
BUCKET_TOKENS = 400_000
COUNTED_SETS, COUNTED_SHINGLES = 10_000, 6_000_000  # sets whose shingles a task counts together
PIECE = 1 << 18  # bytes of text that are hashed together
NO_ID = -(1 << 63)
HOST, GUEST, INDEX, PROBE = range(4)  # roles in a group: a guest meets hosts, an index node meets all, probes only those

U = np.uint64
_P, _Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix64((np.arange(256, dtype=np.uint64) + U(1)) * _P)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_INVERSE = U(pow(int(_P), -1, 1 << 64))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z is lowered."""
    out: list[np.ndarray] = []
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) < PIECE):
            size += len(texts[end]) + 1
            end += 1
        out += _shingle_piece([t.lower() for t in texts[start:end]])
        start = end
    return out


def sets_of(column: pa.Array, rows: int = 512) -> list[np.ndarray]:
    """Sets of an Arrow column, a slice of it in Python at a time."""
    return [s for i in range(0, len(column), rows) for s in shingle_sets(utf8(column.slice(i, rows)))]


def repeated(sets: list[np.ndarray], least: int, parts: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least ``least`` of the sorted sets, and in how many; one range of hashes after another."""
    cut = [np.searchsorted(s, np.arange(1, parts, dtype=np.uint64) * U((1 << 64) // parts)) for s in sets]
    tokens, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in range(parts):
        t, n = np.unique(np.concatenate([s[(c[k - 1] if k else 0): (c[k] if k < parts - 1 else len(s))] for s, c in zip(sets, cut)]), return_counts=True)
        tokens.append(t[n >= least])
        times.append(n[n >= least])
    return np.concatenate(tokens), np.concatenate(times)


def _shingle_piece(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_BLANK[data]
    step = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    first, after = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # polynomial prefix sums modulo 2**64, moved back to the word's start
    total = np.concatenate([[U(0)], np.cumsum(_BYTE[data] * _powers(_P, len(data)))])
    word = mix64((total[after] - total[first]) * _powers(_INVERSE, len(data) + 1)[first] + (after - first).astype(np.uint64))
    upto = np.searchsorted(first, ends_at)
    q = [U(pow(int(_Q), j, 1 << 64)) for j in range(SHINGLE)]
    many = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        many += word[j: j + len(many)] * q[j]
    many = mix64(many)
    sets, a = [], 0
    for b in upto:
        n = int(b - a)
        if n >= SHINGLE:
            sets.append(np.unique(many[a: b - SHINGLE + 1]))
        elif n:
            sets.append(mix64(np.array([sum(int(word[a + j]) * int(q[j]) for j in range(n)) + n & (1 << 64) - 1], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        a = b
    return sets


def node_id(s: np.ndarray) -> int:
    """A 64-bit hash of the set; equal sets are one node."""
    return int(mix64(np.array([np.sum(mix64(s ^ _P)) + U(len(s))], np.uint64)).view(np.int64)[0])


def count_vector(s: np.ndarray) -> np.ndarray:
    """Group counts by the leading bits of the hashes, one byte each (coarser groups are sums of adjacent ones)."""
    bits = max(int(GROUPS).bit_length() - 1, int(len(s) // PER_GROUP).bit_length())
    return np.minimum(np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# --- count-vector R-tree -----------------------------------------------------------------------------------------

def _coarse(points: list[np.ndarray], groups: int) -> np.ndarray:
    return np.array([p.reshape(groups, -1).sum(axis=1, dtype=np.int32) for p in points], np.int32).reshape(len(points), groups)


def survivors(points: list[np.ndarray], size: np.ndarray, guest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose overlap bound allows a link. With ``guest`` (roles), only pairs whose roles meet."""
    x, y = _tree_pairs(_coarse(points, GROUPS), size, guest) if len(size) > 1 else (np.zeros(0, np.int64),) * 2
    groups = np.array([len(p) for p in points], np.int64)
    level = np.minimum(groups[x], groups[y])
    ok = np.ones(len(x), bool)
    for g in np.unique(level[level > GROUPS]):
        at = np.flatnonzero(level == g)
        members, place = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
        fine = _coarse([points[i] for i in members], int(g))
        p, q = place[: len(at)], place[len(at):]
        block = max(1, (1 << 21) // int(g))
        for i in range(0, len(at), block):
            bound = np.minimum(fine[p[i: i + block]], fine[q[i: i + block]]).sum(axis=1, dtype=np.int64)
            ok[at[i: i + block]] = 9 * bound >= 4 * (size[x[at[i: i + block]]] + size[y[at[i: i + block]]])
    return x[ok], y[ok]


def _tree_pairs(vec: np.ndarray, size: np.ndarray, guest: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Descend the tree against itself, dropping pairs of boxes, then of points, by bound and size."""
    order = _pack(vec, size)
    v, s = vec[order], size[order]
    levels = [(v, s, s)]  # upper corner, least size, greatest size
    width = LEAF
    while len(levels[-1][1]) > 1:
        upper, low, high = levels[-1]
        at = np.arange(0, len(low), width)
        levels.append((np.maximum.reduceat(upper, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
        width = FAN
    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 2, -1, -1):
        upper, low, high = levels[depth]
        width = LEAF if depth == 0 else FAN
        kept = []
        for lo in range(0, len(a), 4096):
            pa_, pb = a[lo: lo + 4096], b[lo: lo + 4096]
            grid = np.arange(width)
            x = np.repeat(pa_[:, None] * width + grid[None, :], width, axis=1).ravel()
            y = np.tile(pb[:, None] * width + grid[None, :], (1, width)).ravel()
            ok = (x < len(low)) & (y < len(low)) & ((x < y) if depth == 0 else (x <= y))
            x, y = x[ok], y[ok]
            ok = (5 * high[x] >= 4 * low[y]) & (5 * high[y] >= 4 * low[x])
            x, y = x[ok], y[ok]
            if depth == 0 and guest is not None:
                ok = (guest[order[x]] != guest[order[y]]) | (guest[order[x]] == INDEX)
                x, y = x[ok], y[ok]
            for i in range(0, len(x), 1 << 15):
                p, q = x[i: i + (1 << 15)], y[i: i + (1 << 15)]
                ok = 9 * np.minimum(upper[p], upper[q]).sum(axis=1, dtype=np.int64) >= 4 * (low[p] + low[q])
                kept.append((p[ok], q[ok]))
        a = np.concatenate([k[0] for k in kept]) if kept else np.zeros(0, np.int64)
        b = np.concatenate([k[1] for k in kept]) if kept else np.zeros(0, np.int64)
    return order[a], order[b]


def _pack(vec: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sort-tile order: slabs by set size, each slab by its widest coordinate, tiles of that by the next widest."""
    order = np.argsort(size, kind="stable")
    if len(order) <= LEAF:
        return order
    out = []
    for slab in np.array_split(order, max(1, round((len(order) / LEAF) ** 0.5))):
        wide = np.argsort(-vec[slab].var(axis=0), kind="stable")
        slab = slab[np.argsort(vec[slab, wide[0]], kind="stable")]
        for tile in np.array_split(slab, max(1, round((len(slab) / LEAF) ** 0.5))):
            out.append(tile[np.argsort(vec[tile, wide[1]], kind="stable")])
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return 9 * int(np.count_nonzero(large[at] == small)) >= 4 * (len(a) + len(b))


def spanning(sets: list[np.ndarray], start: int, guest: np.ndarray | None = None, joined: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Verified links that connect the members (a forest) and each member's root. Pairs with ``start`` go first;
    ``joined`` members count as connected to it from the beginning."""
    n = len(sets)
    up = np.arange(n)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    if joined is not None:
        up[joined] = start
        up[start] = start
    size = np.array([len(s) for s in sets], np.int64)
    x, y = survivors([count_vector(s) for s in sets], size, guest)
    first = np.argsort((x != start) & (y != start), kind="stable")
    links = []
    for i, j in zip(x[first].tolist(), y[first].tolist()):
        p, q = root(i), root(j)
        if p != q and linked(sets[i], sets[j]):
            up[max(p, q)] = min(p, q)
            links.append((i, j))
    return links, np.array([root(i) for i in range(n)])


# --- Spark stages ------------------------------------------------------------------------------------------------

NODES = "kind int, doc_id long, n_shingles long, node long, vec binary, times long"


def node_table(docs: DataFrame) -> DataFrame:
    """kind 0: (doc_id, n_shingles, node, count vector) of every row; kind 1: (node = shingle, times) of shingles
    that are frequent among some sets of a task. One scan of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in NODES.split(", ")]
        held: dict[int, np.ndarray] = {}  # distinct sets whose shingles are counted together
        size = 0

        def often() -> pa.RecordBatch:
            tokens, times = repeated(list(held.values()), max(2, len(held) // RARE))
            k = len(tokens)
            return pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                                               pa.array(tokens.view(np.int64)), pa.nulls(k, pa.binary()), pa.array(times, pa.int64())], names)

        for b in batches:
            sets = sets_of(b.column("text"))
            ids = [node_id(s) if len(s) else None for s in sets]
            vec = [count_vector(s).tobytes() if len(s) else None for s in sets]
            n = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array(ids, pa.int64()), pa.array(vec, pa.binary()), pa.nulls(n, pa.int64())], names)
            for i, s in zip(ids, sets):
                if i is not None and i not in held:
                    held[i] = s
                    size += len(s)
            if len(held) >= COUNTED_SETS or size >= COUNTED_SHINGLES:
                yield often()
                held, size = {}, 0
        if held:
            yield often()

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, NODES)


PREFIX = "bucket long, token binary, node binary, class binary, least binary"


def prefix_table(docs: DataFrame, frequent: np.ndarray, rank: np.ndarray, buckets: int | None) -> DataFrame:
    """The rare prefix shingles of a batch that fall into one bucket, packed; without ``buckets`` the frequent ones
    instead, a row each. ``rank`` orders the frequent shingles. A node is emitted once per task. ``class`` has the
    node's size class, and in the last bit whether the shingle is in its index prefix; ``least`` has 32 bits of the
    node's first rare shingle."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, rank))  # at most RARE * mean set size shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, (often, turn), seen = [x.split()[0] for x in PREFIX.split(", ")], shared.value, set()
        for b in batches:
            token, node, cls, low = [], [], [], []
            for s in sets_of(b.column("text")):
                if not len(s) or (i := node_id(s)) in seen:
                    continue
                seen.add(i)
                at = np.searchsorted(often, s)
                is_hot = often[np.minimum(at, len(often) - 1)] == s if len(often) else np.zeros(len(s), bool)
                rare = s[~is_hot]
                p, index = len(s) - -(-4 * len(s) // 5) + 1, len(s) - -(-8 * len(s) // 9) + 1
                token.append(rare[:p] if buckets else s[is_hot][np.argsort(turn[at[is_hot]])][: max(0, p - len(rare))])
                k = len(token[-1])
                node.append(np.full(k, i, np.int64))
                place = np.arange(k) + (0 if buckets else len(rare))
                cls.append((2 * int(np.log(len(s)) / np.log(1.05)) + (place < index)).astype(np.uint16))
                low.append(np.full(k, (int(rare[0]) if len(rare) else 0) & 0xFFFFFFFF, np.uint32))
            if not sum(map(len, token)):
                continue
            cols = [np.concatenate(x) for x in (token, node, cls, low)]
            where = (cols[0] % U(buckets)).astype(np.int64) if buckets else np.full(len(cols[0]), -1)
            order = np.argsort(where, kind="stable")
            where, cols = where[order], [c[order] for c in cols]
            cut = bounds(where)
            rows = [(int(where[i]), *[c[i:j].tobytes() for c in cols]) for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int64()] + [pa.binary()] * 4)], names)

    text = docs.select(F.col("text").cast("string").alias("text"))
    return arrow_pass(text, run, PREFIX) if buckets else arrow_pass(text, lambda batches: _unpack_hot(run(batches)), "token long, node long, index int")


def _joined(column) -> bytes:
    return b"".join(column.to_pylist())


def block_leaders(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(leader, node, index) of the blocks in one or more buckets. Sizes further apart than a link allows split a
    block. Without an index node a block has no pair to compare. A block whose nodes have one and the same first rare shingle is left to the block of that shingle: it has them all."""
    t = np.frombuffer(_joined(table.column("token")), np.uint64)
    nd = np.frombuffer(_joined(table.column("node")), np.int64)
    c = np.frombuffer(_joined(table.column("class")), np.uint16).astype(np.int64)
    m = np.frombuffer(_joined(table.column("least")), np.uint32)
    order = np.lexsort((nd, c, t))
    t, nd, c, m = t[order], nd[order], c[order], m[order]
    c, index = c >> 1, c & 1
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (c[1:] - c[:-1] > 5)  # 1.05 ** 5 > 1.25
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(t)))
    leader = np.repeat(np.minimum.reduceat(np.where(index == 1, nd, np.iinfo(np.int64).max), at), length) if len(t) else nd
    indexed = np.repeat(np.maximum.reduceat(index, at) == 1, length) if len(t) else nd == nd
    alike = np.repeat(np.minimum.reduceat(m, at) == np.maximum.reduceat(m, at), length) if len(t) else nd == nd
    pair = indexed & (leader != nd) & ~(alike & ((t & U(0xFFFFFFFF)).astype(np.uint32) != m))
    found = np.unique(np.stack([leader[pair], nd[pair], index[pair]]), axis=1)
    last = np.ones(found.shape[1], bool)  # the index row of a node that has both
    last[:-1] = (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])
    yield pa.RecordBatch.from_arrays([pa.array(x[last]) for x in (found[0], found[1], found[2].astype(np.int32))], ["leader", "node", "index"])


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The bytes of a binary column without copies."""
    out = []
    for c in column.chunks:
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset: c.offset + len(c) + 1]
        data = np.frombuffer(c.buffers()[2] or b"", np.uint8)
        out += [data[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
    return out


def _unpack_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t, nd = np.frombuffer(_joined(b.column("token")), np.int64), np.frombuffer(_joined(b.column("node")), np.int64)
        index = (np.frombuffer(_joined(b.column("class")), np.uint16) & 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(nd), pa.array(index)], ["token", "node", "index"])


def _groups(table: pa.Table) -> Iterator[tuple[int, int]]:
    cut = bounds(numpy_of(table.column("leader")), numpy_of(table.column("chunk")))
    yield from zip(cut[:-1].tolist(), cut[1:].tolist())


def prune(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Members of (leader, chunk) groups that keep a partner under the overlap bound."""
    node, size = numpy_of(table.column("node")), numpy_of(table.column("n"))
    guest = numpy_of(table.column("guest"))
    vec = [np.frombuffer(v, np.uint8) for v in table.column("vec").to_pylist()]
    kept = []
    for a, b in _groups(table):
        x, y = survivors(vec[a:b], size[a:b], guest[a:b])
        apart = node[a + x] != node[a + y]  # a node can be guest and host of a group
        x, y = x[apart], y[apart]
        kept.append(a + np.union1d(x, y))
    at = np.concatenate(kept).astype(np.int64) if kept else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(numpy_of(table.column(c))[at]) for c in ("leader", "chunk", "guest", "joined")] + [pa.array(node[at])],
                                     ["leader", "chunk", "guest", "joined", "node"])


def verify(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edges that connect what each group's verified links connect."""
    leader, node = numpy_of(table.column("leader")), numpy_of(table.column("node"))
    guest, joined = numpy_of(table.column("guest")), numpy_of(table.column("joined"))
    raw = _views(table.column("set"))
    edges = []
    for a, b in _groups(table):
        sets = [x.view(np.uint64) for x in raw[a:b]]
        start = int(np.argmax(node[a:b] == leader[a])) if (node[a:b] == leader[a]).any() else 0
        if guest[a] in (HOST, GUEST):
            members = np.flatnonzero(joined[a:b] == 1)
            start = int(members[0]) if len(members) else 0
            links, _ = spanning(sets, start, guest[a:b], members if len(members) else None)
        else:
            _, roots = spanning(sets, start, guest[a:b])
            links = [(i, int(r)) for i, r in enumerate(roots) if i != r]  # a star says the same as the forest
        edges += [(int(node[a + i]), int(node[a + j])) for i, j in links]
    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def _with_sets(members: DataFrame, rep: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the shingle set to (leader, chunk, guest, joined, node) rows: the texts of their representatives only."""
    wanted = members.join(rep, "node").select("leader", "chunk", "guest", "joined", "node", "key")
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.col("text").cast("string").alias("text"))
    names = ["leader", "chunk", "guest", "joined", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # ids may repeat, with other texts or the same; equal ids meet in one task
        for b in batches:
            sets = sets_of(b.column("text"))
            own = np.array([node_id(s) if len(s) else 0 for s in sets], np.int64)
            right = np.flatnonzero(own == b.column("node").to_numpy(zero_copy_only=False)).tolist()
            place = list(zip(*[b.column(c).to_pylist() for c in names]))
            right = [i for i in right if place[i] not in seen and not seen.add(place[i])]
            t = b.select(names).take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[t.column(c) for c in names], pa.array([sets[i].tobytes() for i in right], pa.binary())], [*names, "set"])

    schema = "leader long, chunk long, guest int, joined int, node long, set binary"
    return arrow_pass(text.join(wanted, "key").select(*names, "text"), run, schema)


def visits(marked: DataFrame) -> DataFrame:
    """Groups of the second round, from (leader, guest, joined, node) of the large blocks: hosts of one chunk and
    guests of one slice, about ``CHUNK`` of each. Unconnected nodes visit the index nodes; unconnected index nodes
    also the connected others (those not connected come to them). Of a pair, one is an index node."""
    def meet(turn: int, hosts: str, guests: str) -> DataFrame:
        parts = lambda which: (F.floor(F.count(F.when(F.expr(which), 1)) / CHUNK) + 1).cast("long")
        both = (marked.groupBy("leader").agg(parts(hosts).alias("chunks"), parts(guests).alias("slices"), F.max(F.expr(hosts)).alias("h"), F.max(F.expr(guests)).alias("g"))
                .where("h AND g").select("leader", "chunks", "slices"))
        up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        key = (2 * (F.col("c") * F.col("slices") + F.col("s")) + turn).alias("chunk")
        host = (marked.where(hosts).join(both, "leader").withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("s", up_to("slices"))
                .select("leader", key, F.lit(HOST).alias("guest"), "joined", "node"))
        guest = (marked.where(guests).join(both, "leader").withColumn("s", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices"))).withColumn("c", up_to("chunks"))
                 .select("leader", key, F.lit(GUEST).alias("guest"), F.lit(0).alias("joined"), "node"))
        return host.union(guest)

    return meet(0, f"guest = {INDEX}", "joined = 0").union(meet(1, f"guest = {PROBE} AND joined = 1", f"guest = {INDEX} AND joined = 0"))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n_shingles, node), (edges a, b between nodes)."""
    spark = docs.sparkSession
    tasks = partitions(spark)
    found = materialize(node_table(docs), "nodes")
    rows = found.where("kind = 0").select("doc_id", "n_shingles", "node", "vec")
    per = (rows.where("node IS NOT NULL").withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))).groupBy("node")
           .agg(F.first("vec").alias("vec"), F.first("n_shingles").alias("n"), F.min("key").alias("key")))
    per = materialize(per, "points")
    total = per.agg(F.count("*").alias("nodes"), F.sum("n").alias("n")).head()
    often = found.where("kind = 1").groupBy("node").agg(F.sum("times").alias("t")).where(F.col("t") >= max(4, total.nodes // RARE))
    listed = np.array([(r.node, r.t) for r in often.toLocalIterator()], np.int64).reshape(-1, 2)
    frequent, times = listed[:, 0].copy().view(np.uint64), listed[:, 1]
    by = np.argsort(frequent)
    frequent, times = frequent[by], times[by]
    rank = np.argsort(np.lexsort((frequent, times))).astype(np.int32)
    wide = max(tasks, int((total.n or 0) * 0.2 / BUCKET_TOKENS) + 1)
    buckets = 4 * wide  # several a task, so that tasks are even
    members = by_runs(prefix_table(docs, frequent, rank, buckets), ["bucket"], wide, block_leaders, "leader long, node long, index int")
    if len(frequent):
        hot = materialize(prefix_table(docs, frequent, rank, None), "frequent")
        lead = F.broadcast(hot.where("index = 1").groupBy("token").agg(F.min("node").alias("leader")))  # a row per frequent shingle
        members = members.union(hot.join(lead, "token").where("leader != node").select("leader", "node", "index"))
    members = materialize(members.groupBy("leader", "node").agg(F.max("index").alias("index")), "members")
    chunks = members.groupBy("leader").agg((F.floor(F.count("*") / CHUNK) + 1).cast("long").alias("chunks"))
    role = F.when(F.col("index") == 1, INDEX).otherwise(PROBE)
    placed = members.join(chunks, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), role.alias("guest"), F.lit(0).alias("joined"), "node")
    heads = chunks.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(INDEX).alias("guest"), F.lit(0).alias("joined"), F.col("leader").alias("node"))
    point = per.select("node", "n", "vec")
    rep = per.select("node", "key")
    schema = "leader long, chunk long, guest int, joined int, node long"
    keys = ["leader", "chunk"]

    def verified(candidates: DataFrame) -> DataFrame:
        pruned = by_runs(candidates.join(point, "node"), keys, tasks, prune, schema, ["node"])
        return materialize(by_runs(_with_sets(pruned, rep, docs), keys, tasks, verify, "a long, b long", ["node"]), "links")

    edges = verified(placed.union(heads))
    if chunks.where("chunks > 1").limit(1).count():
        large = materialize(placed.join(chunks.where("chunks > 1"), "leader", "left_semi"), "large")
        root = components(edges)
        of = lambda node, out: root.select(F.col("node").alias(node), F.col("root").alias(out))
        marked = (large.join(of("node", "r"), "node", "left").join(of("leader", "lr"), "leader", "left")
                  .withColumn("joined", (F.coalesce("r", "node") == F.coalesce("lr", "leader")).cast("int"))
                  .select("leader", "guest", "joined", "node"))
        edges = root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(visits(materialize(marked, "marked"))))
    return rows.select("doc_id", "n_shingles", "node"), edges


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, component_id) of every row."""
    rows, edges = links(docs)
    label = components(edges)
    named = rows.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return (named.join(least, "root", "left")
            .select("doc_id", "n_shingles", "node", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies: the least id of each component stays, rows without shingles all stay. Rows
    that share an id share its fate."""
    found = materialize(classes(docs), "classes")
    stay = found.where("n_shingles = 0 OR doc_id = component_id OR component_id IS NULL").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k")).distinct()
    return docs.select(*DOC_COLUMNS).join(stay, F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col("k"), "left_semi")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
s AS (SELECT DISTINCT doc_id, md5(s) AS s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE t(doc_id, via) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.doc_id, e.b FROM t JOIN e ON t.via = e.a) SELECT doc_id, min(via) AS component_id FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@register("op4_ngram_jaccard", ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
