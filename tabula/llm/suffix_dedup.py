"""Suffix-array deduplication: bytes covered by a ``LENGTH``-byte string that also starts earlier are removed.

Sorting all suffixes of a corpus would ship every byte a hundred times, so the suffixes are sampled so that no
repeat is missed. A window of ``LENGTH`` bytes is owned by an anchor: the leftmost least hash of its ``GRAM``-byte
substrings. Equal windows have their anchor at the same place, so only anchors with equal grams can own equal
windows, and about one position in forty is an anchor.

1. One scan finds the anchors. An anchor whose whole context (its windows' bytes) equals that of an earlier anchor is
   covered; that is decided inside an Arrow batch first, so copies are collapsed before the shuffle, and then in the
   bucket of the gram's hash. What remains to compare are first occurrences of different contexts of one gram, that
   is, mostly the edges of repeated passages.
2. Their contexts are cut from the texts and meet by gram. Deep-shallow sorting puts the suffixes that start at the
   anchors in order: all groups are split by one 8-byte symbol after another (multikey quicksort, level by level)
   to a shallow depth; groups that are still tied go into a blind trie each, whose traversal yields their order and
   common prefixes. A window that starts t bytes before its anchor repeats where the suffixes share LENGTH - t bytes
   and the t bytes before agree; the first of each class stays, in order of (document, position).
3. The covered intervals are joined to the texts.

Contexts and the bytes before an anchor are compared by 64-bit hashes among anchors of one gram. Texts are shuffled
once (both joins read the same exchange).

Defined cases: null text is empty; texts under ``LENGTH`` bytes keep all; rows of one id are ordered by text, equal
rows are an original and its copies; a null id comes first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabula.llm.common import arrow_pass, DOC_COLUMNS, documents, partitions, register
from tabula.llm.ngram_join import _BYTE, _INVERSE, _P, _Q, U, _powers, mix64, utf8
from tabula.llm.runs import bounds, by_runs, numpy_of
from tabula.session import materialize

LENGTH = 100
GRAM = 24
WINDOW = LENGTH - GRAM + 1  # grams in a window
SYMBOL = 8  # bytes that the multikey step compares at once
SHALLOW = 56  # depth at which blind tries take over
BUCKET_ANCHORS = 400_000
PIECE = 1 << 20
NO_ID = -(1 << 63)


# --- anchors -----------------------------------------------------------------------------------------------------

def leftmost_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of every ``width`` consecutive values, by doubling."""
    at = np.arange(len(v), dtype=np.int32)
    span = 1
    while span < width:
        step = min(span, width - span)
        if len(v) <= step:
            return at[:0]
        right = v[step:] < v[:-step]
        v, at = np.where(right, v[step:], v[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    return at


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all windows of all texts: (text index, anchor position, bytes before it, windows - 1, gram hash, context hash)."""
    found, start = [], 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) < PIECE):
            size += len(texts[end])
            end += 1
        found.append(_anchor_piece(texts[start:end], start))
        start = end
    kinds = (np.int64, np.int64, np.uint8, np.uint8, np.uint64, np.uint64)
    return tuple(np.concatenate([f[i] for f in found]).astype(k) if found else np.zeros(0, k) for i, k in enumerate(kinds))


def _anchor_piece(texts: list[bytes], shift: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    total = np.concatenate([[U(0)], np.cumsum(_BYTE[data] * _powers(_P, len(data)))])
    back = _powers(_INVERSE, len(data) + 1)
    gram = mix64((total[GRAM:] - total[:-GRAM]) * back[: len(total) - GRAM])
    least = leftmost_minima((gram >> U(32)).astype(np.uint32), WINDOW)
    flag = np.zeros(len(data) + 1, np.int8)  # window starts that stay inside their text
    long = lengths >= LENGTH
    flag[starts[long]] += 1
    flag[(starts + lengths - LENGTH + 1)[long]] -= 1
    p = np.flatnonzero(np.cumsum(flag[:-1], dtype=np.int8))
    a = least[p].astype(np.int64)
    cut = bounds(a)
    low, high = p[cut[:-1]], p[cut[1:] - 1]
    a = a[cut[:-1]]
    before, more = a - low, high - low
    context = mix64((total[high + LENGTH] - total[low]) * back[low] + (before * 256 + more).astype(np.uint64) * _Q)
    text = np.searchsorted(starts, a, side="right") - 1
    # texts of length 0 share a start with the next text; the last one at that start is the one with bytes
    return text + shift, a - starts[text], before, more, gram[a], context


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal significance together: the zero bytes of small numbers then compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


FIELDS = (("key", np.int64), ("rn", np.int32), ("pos", np.int32), ("before", np.uint8), ("more", np.uint8), ("gram", np.uint64), ("context", np.uint64))
ANCHORS = "bucket long, kind int, " + ", ".join(f"{n} binary" for n, _ in FIELDS)


def _pack_rows(where: np.ndarray, kind: int, cols: list[np.ndarray]) -> list[tuple]:
    order = np.argsort(where, kind="stable")
    where, cols = where[order], [c[order] for c in cols]
    cut = bounds(where)
    return [(int(where[i]), kind, *[planes(c[i:j]) for c in cols]) for i, j in zip(cut[:-1], cut[1:])]


def anchor_table(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors per batch and bucket. kind 0: to compare; kind 1: covered by an earlier equal context of the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "kind", *[n for n, _ in FIELDS]]
        for b in batches:
            key, rn = numpy_of(b.column("key")), numpy_of(b.column("rn"))
            order = np.lexsort((rn, key))
            texts = utf8(b.column("text"))
            text, pos, before, more, gram, context = anchors([texts[i] for i in order])
            if not len(text):
                continue
            same = mix64(gram + context * _Q)
            by = np.argsort(same, kind="stable")
            first = np.ones(len(by), bool)
            first[by[1:]] = same[by[1:]] != same[by[:-1]]
            cols = [key[order][text], rn[order][text].astype(np.int32), pos.astype(np.int32), before, more, gram, context]
            where = (gram % U(buckets)).astype(np.int64)
            rows = _pack_rows(where[first], 0, [c[first] for c in cols])
            if not first.all():
                rows += _pack_rows(where[~first], 1, [c[~first] for c in cols[:5]] + [np.zeros(np.count_nonzero(~first), np.uint8)] * 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int32()] + [pa.binary()] * len(FIELDS))], names)

    return arrow_pass(docs.select("key", "rn", "text"), run, ANCHORS)


PARTS = "kind int, key long, rn int, a binary, b binary, gram binary"


def _per_text(kind: int, key, rn, *cols) -> list[tuple]:
    """One packed row per text."""
    order = np.lexsort((rn, key))
    key, rn, cols = key[order], rn[order], [c[order] for c in cols]
    cut = bounds(key, rn)
    return [(kind, int(key[i]), int(rn[i]), *[c[i:j].tobytes() for c in cols]) for i, j in zip(cut[:-1], cut[1:])]


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], [x.split()[0] for x in PARTS.split(", ")])


def compare_contexts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """kind 1: covered intervals (start, end) per text; kind 0: anchors (position, before/more, gram) whose contexts
    must be compared byte by byte, because their gram has several."""
    got = {n: [[], []] for n, _ in FIELDS}
    kinds = table.column("kind").to_pylist()
    for n, t in FIELDS:
        for k, raw in zip(kinds, table.column(n).to_pylist()):
            got[n][k].append(unplanes(raw, t) if k == 0 or n not in ("gram", "context") else np.zeros(0, t))
    col = lambda n, k: np.concatenate([np.zeros(0, dict(FIELDS)[n]), *got[n][k]])
    rows = []
    key, rn, pos, before, more = (col(n, 1) for n in ("key", "rn", "pos", "before", "more"))
    low = pos - before
    out = [(key, rn, low, low + more + np.int32(LENGTH))]
    key, rn, pos, before, more, gram, context = (col(n, 0) for n, _ in FIELDS)
    order = np.lexsort((pos, rn, key, context, gram))
    key, rn, pos, before, more, gram, context = (c[order] for c in (key, rn, pos, before, more, gram, context))
    new_gram, new = np.ones(len(gram), bool), np.ones(len(gram), bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new[1:] = new_gram[1:] | (context[1:] != context[:-1])
    low = pos - before
    out.append((key[~new], rn[~new], low[~new], (low + more + np.int32(LENGTH))[~new]))
    key_, rn_, a, b = (np.concatenate(c) for c in zip(*out))
    rows += _per_text(1, key_, rn_, a.astype(np.int32), b.astype(np.int32), np.zeros(len(a), np.uint8))
    group = np.cumsum(new_gram) - 1
    several = np.bincount(group[new], minlength=group[-1] + 1 if len(group) else 0) > 1
    ask = new & several[group] if len(group) else new
    shape = before[ask].astype(np.int32) * 256 + more[ask]
    rows += _per_text(0, key[ask], rn[ask], pos[ask].astype(np.int32), shape, gram[ask])
    yield _part_batch(rows)


CONTEXTS = "bucket long, key binary, rn binary, pos binary, before binary, more binary, gram binary, bytes binary"


def cut_contexts(buckets: int):
    """From (key, rn, text, requests) to packed contexts per batch and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CONTEXTS.split(", ")]
        for b in batches:
            cols, pieces = [[] for _ in range(6)], []
            for key, rn, text, ask in zip(*[b.column(c).to_pylist() for c in ("key", "rn")], utf8(b.column("text")), b.column("parts").to_pylist()):
                for part in ask:
                    pos, shape, gram = (np.frombuffer(part[c], k) for c, k in (("a", np.int32), ("b", np.int32), ("gram", np.uint64)))
                    before, more = shape >> 8, shape & 255
                    for c, v in zip(cols, (np.full(len(pos), key), np.full(len(pos), rn, np.int32), pos, before.astype(np.uint8), more.astype(np.uint8), gram)):
                        c.append(v)
                    pieces += [text[p: q] for p, q in zip((pos - before).tolist(), (pos - before + more + LENGTH).tolist())]
            if not pieces:
                continue
            flat = [np.concatenate(c) for c in cols]
            where = (flat[5] % U(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            where, flat = where[order], [c[order] for c in flat]
            cut = bounds(where)
            rows = [(int(where[i]), *[planes(c[i:j]) for c in flat], b"".join([pieces[x] for x in order[i:j].tolist()])) for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] + [pa.binary()] * 7)], names)

    return run


# --- deep-shallow suffix sorting ---------------------------------------------------------------------------------

class BlindTrie:
    """Patricia trie over strings of one length: inner nodes keep the depth at which their strings first differ."""

    __slots__ = ("root", "strings")

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None
        for i in range(len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:  # a leaf is [None, ids]; an inner node [depth, {symbol: child}]
        s = self.strings[i]
        if self.root is None:
            self.root = [None, [i]]
            return
        node = self.root
        while node[0] is not None:  # blind descent: only branching symbols are looked at
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        if other == s:
            node[1].append(i)
            return
        low, high = 0, len(s)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if s[:mid] == other[:mid] else (low, mid)
        shared = low
        holder, at, node = None, None, self.root
        while node[0] is not None and node[0] <= shared:
            if node[0] == shared:
                node[1][s[shared]] = [None, [i]]
                return
            holder, at = node, s[node[0]]
            node = node[1][at]
        fork = [shared, {other[shared]: node, s[shared]: [None, [i]]}]
        if holder is None:
            self.root = fork
        else:
            holder[1][at] = fork

    def ordered(self) -> tuple[list[int], list[int]]:
        """Indices in order, and each one's common prefix with the one before (0 for the first)."""
        order, shared, stack = [], [], [(self.root, 0)]
        while stack:
            node, with_previous = stack.pop()
            if node[0] is None:
                order += node[1]
                shared += [with_previous] + [len(self.strings[node[1][0]])] * (len(node[1]) - 1)
            else:
                children = [node[1][c] for c in sorted(node[1])]
                stack += [(c, node[0]) for c in reversed(children[1:])] + [(children[0], with_previous)]
        return order, shared


def deep_shallow(group: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (rows of bytes) inside their groups, and the common prefix of each with the one before it
    (-1 at the start of a group)."""
    n, length = suffix.shape
    order = np.argsort(group, kind="stable")
    tied = group[order].astype(np.int64)  # label of the run of rows that are equal so far
    shared = np.full(n, length, np.int64)
    start = np.ones(n, bool)
    start[1:] = tied[1:] != tied[:-1]
    shared[start] = -1
    depth = 0
    while depth < min(SHALLOW, length):
        run = np.cumsum(start) - 1
        open_ = np.flatnonzero((np.bincount(run) > 1)[run]) if n else np.zeros(0, np.int64)
        if not len(open_):
            break
        width = min(SYMBOL, length - depth)
        chunk = np.zeros((len(open_), 8), np.uint8)
        chunk[:, :width] = suffix[order[open_], depth: depth + width]
        symbol = chunk.view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((symbol, run[open_]))
        order[open_] = order[open_][by]
        symbol, runs = symbol[by], run[open_]  # runs stay in place, their rows move inside
        differ = np.zeros(len(open_), bool)
        differ[1:] = (runs[1:] == runs[:-1]) & (symbol[1:] != symbol[:-1])
        at = np.flatnonzero(differ)
        x = symbol[at] ^ symbol[at - 1]
        lead = np.zeros(len(at), np.int64)
        for i in range(7, 0, -1):
            lead[x < (U(1) << U(8 * i))] = 8 - i
        shared[open_[at]] = depth + lead
        start[open_[at]] = True
        depth += SYMBOL
    cut = np.append(np.flatnonzero(start), n)
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if j - i > 1 and depth < length:
            members = order[i:j]
            by, lcp = BlindTrie([r.tobytes() for r in suffix[members]]).ordered()
            order[i:j] = members[by]
            shared[i + 1: j] = lcp[1:]
    return order, shared


def repeated_windows(key, rn, pos, before, more, gram, context: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(member, window start) of the windows that an earlier member of the same gram also owns. Members come in
    (key, rn, pos) order."""
    n = len(key)
    suffix, prefix = np.zeros((n, LENGTH), np.uint8), np.zeros((n, WINDOW), np.uint8)
    for i, (c, t) in enumerate(zip(context, before.tolist())):
        tail = np.frombuffer(c, np.uint8, offset=t)
        suffix[i, : len(tail)] = tail
        prefix[i, :t] = np.frombuffer(c, np.uint8, t)[::-1]
    order, shared = deep_shallow(gram, suffix)
    behind = np.zeros(n, np.uint64)  # hash of the t bytes before the anchor
    top, bottom = before.astype(np.int64), before.astype(np.int64) - more
    who, where = [], []
    for t in range(WINDOW):
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(shared < LENGTH - t)
        own = np.flatnonzero((bottom <= t) & (t <= top))
        if len(own):
            cls = mix64(behind[own] + rank[own].astype(np.uint64) * _Q)
            _, first = np.unique(cls, return_index=True)
            again = np.ones(len(own), bool)
            again[first] = False
            who.append(own[again])
            where.append(pos[own[again]] - t)
        if t < WINDOW - 1:
            behind = mix64(behind * _P + prefix[:, t].astype(np.uint64) + U(1))
    return np.concatenate(who), np.concatenate(where)


def sort_contexts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Covered intervals (kind 1) of the anchors that were compared byte by byte, bucket by bucket."""
    bucket = numpy_of(table.column("bucket"))
    cols = {c: table.column(c).to_pylist() for c in ("key", "rn", "pos", "before", "more", "gram", "bytes")}
    kinds = dict(FIELDS)
    rows = []
    cut = bounds(bucket)
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        key, rn, pos, before, more, gram = (np.concatenate([unplanes(x, kinds[c]) for x in cols[c][i:j]]) for c in ("key", "rn", "pos", "before", "more", "gram"))
        size = more.astype(np.int64) + LENGTH
        end = np.cumsum(size)
        data = b"".join(cols["bytes"][i:j])
        order = np.lexsort((pos, rn, key))
        context = [data[a:b] for a, b in zip((end - size)[order].tolist(), end[order].tolist())]
        key, rn, pos, before, more, gram = (c[order] for c in (key, rn, pos, before, more, gram))
        who, at = repeated_windows(key, rn, pos, before, more, gram, context)
        by = np.lexsort((at, who))
        who, at = who[by], at[by]
        if len(who):
            new = np.ones(len(who), bool)
            new[1:] = (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)
            s = np.flatnonzero(new)
            e = np.append(s[1:], len(who)) - 1
            rows += _per_text(1, key[who[s]], rn[who[s]], at[s].astype(np.int32), (at[e] + LENGTH).astype(np.int32), np.zeros(len(s), np.uint8))
    yield _part_batch(rows)


# --- the operator ------------------------------------------------------------------------------------------------

def cover(length: int, parts: list[dict]) -> np.ndarray:
    """Mask of the removed bytes of a text."""
    edge = np.zeros(length + 1, np.int32)
    for p in parts:
        np.add.at(edge, np.frombuffer(p["a"], np.int32), 1)
        np.add.at(edge, np.frombuffer(p["b"], np.int32), -1)
    return np.cumsum(edge[:-1]) > 0


RESULT = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def strip(text: bytes, parts: list[dict] | None) -> tuple[bytes, int, int]:
    """(what stays, bytes removed, maximal removed runs)."""
    if not parts:
        return text, 0, 0
    gone = cover(len(text), parts)
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, parts in zip(utf8(b.column("text")), b.column("parts").to_pylist()):
            kept, gone, spans = strip(text, parts)
            rows.append((len(text), gone, spans, hashlib.sha256(kept).hexdigest()))
        cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([b.column("key"), *cols], [x.split()[0] for x in RESULT.split(", ")])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left = [strip(t, parts)[:2] for t, parts in zip(utf8(b.column("text")), b.column("parts").to_pylist())]
        stay = [i for i, (kept, gone) in enumerate(left) if not gone or kept.split()]
        texts = [left[i][0].decode("utf-8", "ignore") for i in stay]
        t = b.take(pa.array(stay, pa.int64()))
        yield pa.RecordBatch.from_arrays([t.column("key"), pa.array(texts, pa.string()), t.column("lang"), t.column("source"), pa.array([len(x) for x in texts], pa.int64())], DOC_COLUMNS)


def keyed(docs: DataFrame, extra: list[str]) -> tuple[DataFrame, int]:
    """(key, rn, text, extra) with a distinct (key, rn) for every row, and the bytes of all texts. rn is 0 where ids are distinct."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    seen = d.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).agg(F.max("n").alias("n"), F.sum("size").alias("size")).head()
    if (seen.n or 0) > 1:
        number = F.row_number().over(W.partitionBy("key").orderBy("text", *extra)) - 1
        d = materialize(d.select("key", number.cast("int").alias("rn"), "text", *extra), "keyed")
    else:
        d = d.select("key", F.lit(0).cast("int").alias("rn"), "text", *extra)
    return d, int(seen.size or 0)


def with_repeats(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """(key, rn, text, extra, parts): every row with the intervals of its text that repeat earlier bytes."""
    d, size = keyed(docs, list(extra))
    tasks = max(partitions(docs.sparkSession), size * 2 // (WINDOW + 1) // BUCKET_ANCHORS + 1)
    buckets = 4 * tasks  # several a task, so that tasks are even
    first = materialize(by_runs(anchor_table(d, buckets), ["bucket"], tasks, compare_contexts, PARTS), "parts")
    packed = lambda x: x.groupBy("key", "rn").agg(F.collect_list(F.struct("a", "b", "gram")).alias("parts"))
    # both joins take the same columns of d, so its exchange is written once
    contexts = arrow_pass(d.join(packed(first.where("kind = 0")), ["key", "rn"]).select(*d.columns, "parts"), cut_contexts(buckets), CONTEXTS)
    second = by_runs(contexts, ["bucket"], tasks, sort_contexts, PARTS)
    return d.join(packed(first.where("kind = 1").union(second)), ["key", "rn"], "left").select(*d.columns, "parts")


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    out = arrow_pass(with_repeats(docs), _digests, RESULT)
    return out.select(F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated bytes cut out of their texts (and the rest of a character that a cut divides). A
    text that loses bytes and keeps no word is dropped; ``n_chars`` is counted anew."""
    out = arrow_pass(with_repeats(docs, ["lang", "source"]), _documents, "doc_id long, text string, lang string, source string, n_chars long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).select(*DOC_COLUMNS)


ORACLE = rf"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
q AS (SELECT doc_id, k, substr(x, 2000 * k + 1, {2000 + 2 * LENGTH}) AS y, length(x) // 2 AS n FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2000 + 1)) AS k FROM d)),
r AS (SELECT doc_id, 1000 * k + i AS p, substr(y, 2 * i + 1, 2) AS h, CASE WHEN 1000 * k + i + {LENGTH} <= n THEN md5(substr(y, 2 * i + 1, {2 * LENGTH})) END AS s
      FROM (SELECT *, unnest(range(0, least(1000, n - 1000 * k))) AS i FROM q)),
w AS (SELECT doc_id, p, h, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM r),
c AS (SELECT doc_id, p, h, sum(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) > 0 AS gone FROM w),
o AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM c),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, sha256(unhex(coalesce(string_agg(h, '' ORDER BY p) FILTER (NOT gone), ''))) AS kept_sha256 FROM o GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


@register("op5_suffix_dedup", ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once strings that start earlier are removed."""
    return removed(documents(spark, sf_dir))
