"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, and how often over a corpus.

Both tokenizers read the same bytes (a space and the text). Where tokens of both end, the bytes are cut into groups, and
every token of A is linked with every token of B of its group. A pair of ids counts the documents that hold it linked.

Counting takes two passes. Documents are dealt to blocks by a hash of the row. The first pass lists each block's
distinct pairs with their document counts, per shard (a hash of A's id, so that a shard knows all partners of its ids).
Per shard the distinct pairs of all blocks are united in two levels and get a minimal perfect hash; the counts of the
blocks become dense vectors indexed by it and are summed in two levels too; the best count of every id of A is marked.
Each block's pairs are then looked up by hash, verified against the key stored at that place, and sent back to the
block. The second pass aligns the documents again and adds up what their links have.

Tables that travel belong to one shard or one block: their size follows the pairs in one, not the corpus. Texts are cut
into units (see :mod:`tabula.llm.units`) that both tokenizers treat alone; a worker remembers the alignment of the units
it met, so only new ones are encoded.

The minimal perfect hash has levels of bits: a pair whose place in a level is no other's sets it and is done; the others
go to the next level. The number of bits set before a pair's place is its index.

The vocabularies are files of public tokenizers; their paths are parameters, and the driver sends their bytes (bounded
by the files) to the executors. A is byte-level BPE without normalizer, B a piece vocabulary with byte pieces in which no
piece holds a space behind another character; other files are refused.

Defined cases: null and empty texts, and texts that either tokenizer changes, have no tokens; repeated rows count as
documents of their own; rows with null ids are handled like others; a long text is aligned ``SLICE`` units at a time; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.llm.bpe_chunks import shared_vocabulary
from tabula.llm.common import documents, partitions, register
from tabula.llm.units import MARK, ByteLevelBpe, Memory, splits_at_spaces, standing_alone, units
from tabula.session import materialize

SLICE = 20_000        # units of a text that are aligned at once
UNITS = 300_000       # units whose alignment a worker remembers
RUN = 1 << 15         # characters of new units that are encoded as one text
PENDING = 2_000_000   # pairs of a block that wait to be counted
BLOCKS = 2            # blocks a shuffle partition
GAMMA = 2             # bits of a level for each pair that reaches it


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- alignment of one text ---------------------------------------------------------------------------------------

class Aligner:
    """Two tokenizers and the alignments of the units met so far."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece

        self.a = ByteLevelBpe(a)
        self.a_width = self.a.width
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        if not splits_at_spaces(pieces):
            raise ValueError("B must have no piece with a space behind another character")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.b_width = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_digits, self.b_digits = decimal(len(self.a_width)), decimal(len(self.b_width))
        self.memory = Memory(UNITS, np.int64)  # per unit: a key per link
        self.facts, self.shown = np.zeros((0, 5), np.int64), []  # per unit: tokens of A, of B, groups, links, whether the bytes agree | groups in text

    def _learn(self, run: list[str]) -> None:
        """Align units that can stand behind each other, as one text; ``run`` has their leading spaces."""
        data = [u.encode() for u in run]
        text = "".join(run)
        a = np.array(self.a.ids(text), np.int64)
        b = self.b.encode(text[1:], num_threads=1) if MARK not in text else []  # B puts the first space in front itself
        if b"".join([self.b_bytes[i] for i in b]) != b"".join(data):
            if len(run) > 1:  # some unit is changed by B: find it
                for u in run:
                    self._learn([u])
            else:
                self._keep(np.zeros((1, 5), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), [b""])
            return
        b = np.array(b, np.int64)
        ends = np.cumsum(np.array([len(d) for d in data], np.int64))
        ends_a, ends_b = np.cumsum(self.a_width[a]), np.cumsum(self.b_width[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # ends of the groups; units end at cuts
        to_a, to_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        # links of a group: every token of A as often as the group has tokens of B
        times = np.repeat(n_b, n_a)
        left = np.repeat(a, times)
        first = np.cumsum(times) - times
        right = np.arange(len(left)) - np.repeat(first, times) + np.repeat(np.repeat(to_b - n_b, n_a), times)
        keys = left << 32 | b[right]
        # groups in text: tokens of A, then of B, with what follows each
        place_a = np.arange(len(a)) + np.repeat(to_b - n_b, n_a)
        place_b = np.arange(len(b)) + np.repeat(to_a, n_b)
        signs = np.full((len(a) + len(b), self.a_digits.shape[1] + 1), 0, np.uint8)
        signs[place_a, :-1], signs[place_a, -1] = self.a_digits[a], ord(",")
        signs[place_b, : self.b_digits.shape[1]], signs[place_b, -1] = self.b_digits[b], ord(",")
        signs[place_a[to_a - 1], -1], signs[place_b[to_b - 1], -1] = ord("|"), ord(";")
        used = signs != 0
        written, lengths = signs[used].tobytes(), np.cumsum(used.sum(axis=1))
        # per unit
        group = np.searchsorted(cuts, ends) + 1
        per = lambda upto: np.diff(upto[group - 1], prepend=0)
        links = per(np.cumsum(n_a * n_b))
        facts = np.stack([per(to_a), per(to_b), np.diff(group, prepend=0), links, np.ones(len(run), np.int64)], axis=1)
        stops = lengths[to_a[group - 1] + to_b[group - 1] - 1].tolist()
        self._keep(facts, links, keys, [written[x:y] for x, y in zip([0, *stops], stops)])

    def _keep(self, facts: np.ndarray, links: np.ndarray, keys: np.ndarray, shown: list[bytes]) -> None:
        n = len(self.shown)
        if n + len(facts) > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros((n + 2 * len(facts) + 1024, 5), np.int64)])
        self.facts[n: n + len(facts)] = facts
        self.memory.learn(links, keys)
        self.shown += shown

    def _learn_fresh(self) -> None:
        index = self.memory.index
        fresh, index.fresh, run, size = index.fresh, [], [], 0
        for u in fresh:
            alone = not standing_alone(u)
            if run and (alone or size > RUN):
                self._learn(run)
                run, size = [], 0
            run.append(" " + u)
            size += len(u)
            if alone:
                self._learn(run)
                run, size = [], 0
        if run:
            self._learn(run)

    def _numbered(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray]]:
        keep = self.memory.thin()
        if keep is not None:
            self.facts, self.shown = self.facts[keep], [self.shown[k] for k in keep.tolist()]
        look = self.memory.index.__getitem__
        numbers = [np.fromiter(map(look, parts), np.int64, len(parts)) for _, parts in held]
        self._learn_fresh()
        self.memory.touch(np.concatenate([np.zeros(0, np.int64), *numbers]))
        yield from zip((i for i, _ in held), numbers)

    def slices(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, numbers of some of its units) in order; new units are aligned, many texts' at a time."""
        held, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = units(" " + text)
            parts[0] = parts[0][1:]  # the first unit starts with the space in front
            for at in range(0, len(parts), SLICE):
                held.append((i, parts[at: at + SLICE]))
                size += len(held[-1][1])
                if size >= SLICE:
                    yield from self._numbered(held)
                    held, size = [], 0
        yield from self._numbered(held)

    def linked(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The distinct pairs of each document that has any; a document that a tokenizer changes has none."""
        for _, some in groupby(self.slices(texts), itemgetter(0)):
            found, sound = np.zeros(0, np.int64), True
            for _, rows in some:
                rows = np.unique(rows)
                sound = sound and bool(self.facts[rows, 4].all())
                if sound:
                    keys = np.unique(self.memory.tables[0].take(rows))
                    found = keys if not len(found) else np.union1d(found, keys)
            if sound:
                yield found


def decimal(n: int) -> np.ndarray:
    """A row of digits for each number below n, filled up with zero bytes."""
    return np.array([str(i) for i in range(n)], "S").view(np.uint8).reshape(n, -1)


@lru_cache(maxsize=1)
def aligner(a: bytes, b: bytes) -> Aligner:
    """One per worker process."""
    return Aligner(a, b)


# --- minimal perfect hash ----------------------------------------------------------------------------------------

def spread(keys: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of the keys for every level."""
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Index 0 .. n - 1 for n distinct keys, from levels of bits."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = np.array([int(x.sum()) for x in levels], np.int64)
        self.before = np.cumsum(counts) - counts
        self.ranks = [np.cumsum(x, dtype=np.int64) - x for x in levels]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys)
        while len(left):
            size = GAMMA * len(left)
            at = (spread(left, len(levels)) % np.uint64(size)).astype(np.int64)
            single = np.bincount(at, minlength=size) == 1
            levels.append(single)
            left = left[~single[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The key's index; -1 for some of the keys that are not in the set (the others get a number that is not theirs)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (spread(keys[left], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[i] + self.ranks[i][at[hit]]
            left = left[~hit]
        return out

    def pack(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        levels, at = [], 8 * (n + 1)
        for size in np.frombuffer(data, "<i8", n, 8).tolist():
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        return cls(levels)


# --- counting ----------------------------------------------------------------------------------------------------

def longs(data) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), "<i8")


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return row.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")


def block_pairs(docs: DataFrame, a, b, shards: int) -> DataFrame:
    """First pass: a row per block and shard with the block's distinct pairs and the documents that hold each."""
    schema = "block int, shard int, keys binary, counts binary"

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        work = aligner(a.value, b.value)
        keys, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for found in work.linked(rows.column("text").to_pylist()):
            waiting.append(found)
            size += len(found)
            if size >= PENDING:
                keys, counts = add_up([(keys, counts), *[(w, None) for w in waiting]])
                waiting, size = [], 0
        keys, counts = add_up([(keys, counts), *[(w, None) for w in waiting]])
        shard = (spread(keys >> 32, 0) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        keys, counts, shard = keys[order], counts[order], shard[order]
        cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).tolist()
        spans = list(zip(cuts, cuts[1:]))
        return pa.table([pa.array([key[0].as_py()] * len(spans), pa.int32()), pa.array([int(shard[x]) for x, _ in spans], pa.int32()),
                         pa.array([keys[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([counts[x:y].tobytes() for x, y in spans], pa.binary())], ["block", "shard", "keys", "counts"])

    return docs.groupBy("block").applyInArrow(one, schema)


def add_up(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts (None: one each)."""
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.concatenate([np.ones(len(k), np.int64) if c is None else c for k, c in parts])
    return keys, np.bincount(back, counts, len(keys)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)


def united(pairs: DataFrame, keys: list[str], hashed: bool) -> DataFrame:
    """The distinct pairs of each group; ``hashed``: with their minimal perfect hash, in its order."""
    schema = "shard int, " + ("hash binary, " if hashed else "") + "keys binary"

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        all_keys = np.zeros(0, np.int64)
        for x in rows.column("keys"):
            all_keys = np.union1d(all_keys, longs(x))
        columns = [pa.array([key[0].as_py()], pa.int32())]
        if hashed:
            h = PerfectHash.of(all_keys)
            placed = np.empty_like(all_keys)
            placed[h.index(all_keys)] = all_keys
            columns.append(pa.array([h.pack()], pa.binary()))
            all_keys = placed
        return pa.table([*columns, pa.array([all_keys.tobytes()], pa.binary())], [c.split()[0] for c in schema.split(", ")])

    return pairs.groupBy(*keys).applyInArrow(one, schema)


def over(table: DataFrame, slices: int) -> DataFrame:
    """A copy of each shard's table for each slice of the blocks."""
    return table.withColumn("slice", F.explode(F.array([F.lit(i) for i in range(slices)])))


def block_vectors(pairs: DataFrame, hashes: DataFrame, slices: int) -> DataFrame:
    """Per shard and slice: the counts of its blocks in one dense vector indexed by the hash."""
    def one(key: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        h, n = PerfectHash.unpack(table.column("hash")[0].as_py()), len(table.column("keys")[0].as_buffer()) // 8
        total = np.zeros(n, np.int64)
        for k, c in zip(rows.column("keys"), rows.column("counts")):
            total[h.index(longs(k))] += longs(c)  # the keys of a block are distinct
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["shard", "counts"])

    return pairs.groupBy("shard", "slice").cogroup(over(hashes, slices).groupBy("shard", "slice")).applyInArrow(one, "shard int, counts binary")


def summed(vectors: DataFrame, hashes: DataFrame) -> DataFrame:
    """Per shard: hash, keys, corpus-wide counts, and whether a count is the highest of its id of A."""
    def one(key: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        keys = longs(table.column("keys")[0])
        total = np.zeros(len(keys), np.int64)
        for c in rows.column("counts"):
            total += longs(c)
        ids, back = np.unique(keys >> 32, return_inverse=True)
        most = np.zeros(len(ids), np.int64)
        np.maximum.at(most, back, total)
        return pa.table([table.column("shard"), table.column("hash"), table.column("keys"), pa.array([total.tobytes()], pa.binary()),
                         pa.array([np.packbits(total == most[back]).tobytes()], pa.binary())], ["shard", "hash", "keys", "counts", "best"])

    return vectors.groupBy("shard").cogroup(hashes.groupBy("shard")).applyInArrow(one, "shard int, hash binary, keys binary, counts binary, best binary")


def looked_up(pairs: DataFrame, totals: DataFrame, slices: int) -> DataFrame:
    """Per block and shard: its keys with corpus-wide counts and marks, found by hash and verified."""
    names = ["block", "keys", "counts", "best"]

    def one(key: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        h, known, counts = PerfectHash.unpack(table.column("hash")[0].as_py()), longs(table.column("keys")[0]), longs(table.column("counts")[0])
        best = np.unpackbits(np.frombuffer(table.column("best")[0].as_buffer(), np.uint8), count=len(known)).astype(bool)
        out = []
        for block, k in zip(rows.column("block").to_pylist(), rows.column("keys")):
            keys = longs(k)
            at = h.index(keys)
            if not (at >= 0).all() or not (known[at] == keys).all():
                raise ValueError("a pair of the second pass was not counted in the first")
            out.append((block, keys.tobytes(), counts[at].tobytes(), best[at].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names)

    return pairs.groupBy("shard", "slice").cogroup(over(totals, slices).groupBy("shard", "slice")).applyInArrow(one, "block int, keys binary, counts binary, best binary")


# --- second pass -------------------------------------------------------------------------------------------------

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class BlockCounts:
    """The counts of one block's pairs, and what each unit met in the block adds."""

    def __init__(self, table: pa.Table):
        keys = np.concatenate([np.zeros(0, np.int64), *[longs(x) for x in table.column("keys")]])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.counts = np.concatenate([np.zeros(0, np.int64), *[longs(x) for x in table.column("counts")]])[order]
        self.best = np.concatenate([np.zeros(0, bool), *[np.frombuffer(x.as_buffer(), bool) for x in table.column("best")]])[order]
        self.generation, self.known = -1, np.zeros((0, 2), np.int64)

    def sums(self, work: Aligner, rows: np.ndarray) -> np.ndarray:
        """(links that are best, summed counts) of the units ``rows``, added up."""
        if self.generation != work.memory.generation:  # units have other numbers
            self.generation, self.known = work.memory.generation, np.zeros((0, 2), np.int64)
        n = len(work.shown)
        if n > len(self.known):
            self.known = np.concatenate([self.known, np.full((2 * n - len(self.known), 2), -1, np.int64)])
        distinct = np.unique(rows)
        new = distinct[self.known[distinct, 0] < 0]
        if len(new):
            links = work.memory.tables[0]
            at = np.searchsorted(self.keys, links.take(new))
            unit = np.repeat(np.arange(len(new)), links.lengths(new))
            self.known[new, 0] = np.bincount(unit, self.best[at], len(new))
            self.known[new, 1] = np.bincount(unit, self.counts[at], len(new))  # exact below 2^53
        return self.known[rows].sum(axis=0)


def document_sums(docs: DataFrame, counts: DataFrame, a, b) -> DataFrame:
    """Second pass: every document of a block against the counts of the block's pairs."""
    def one(key: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        work, known, out = aligner(a.value, b.value), BlockCounts(table), [NOTHING] * rows.num_rows
        for i, some in groupby(work.slices(rows.column("text").to_pylist()), itemgetter(0)):
            out[i] = measure(work, known, (r for _, r in some))
        names, kinds = [c.split()[0] for c in RESULT.split(", ")], [pa.int64()] * 6 + [pa.string()]
        return pa.table([rows.column("doc_id"), *[pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)]], names)

    return docs.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(one, RESULT)


NOTHING = (0, 0, 0, 0, 0, 0, "")


def measure(work: Aligner, known: BlockCounts, slices: Iterator[np.ndarray]) -> tuple:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest of the groups of one text."""
    total, sums, digest, sound = np.zeros(5, np.int64), np.zeros(2, np.int64), None, True
    for rows in slices:
        facts = work.facts[rows]
        sound = sound and bool(facts[:, 4].all())
        if not sound:
            continue
        total += facts.sum(axis=0)
        sums += known.sums(work, rows)
        shown = work.shown
        groups = b"".join([shown[r] for r in rows.tolist()])  # every group ends in ";", and the last one's goes
        if digest is None:
            digest = hashlib.sha256()
        else:
            digest.update(b";")
        digest.update(groups[:-1])
    return (*total[:4].tolist(), *sums.tolist(), digest.hexdigest()) if sound else NOTHING


def pair_counts(docs: DataFrame, a, b, blocks: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of each block, and per shard the corpus-wide counts indexed by a minimal perfect hash."""
    slices = max(2, -(-blocks // shards))
    pairs = materialize(block_pairs(docs, a, b, shards).withColumn("slice", F.col("block") % slices), "pairs")
    hashes = materialize(united(united(pairs, ["shard", "slice"], False), ["shard"], True), "hashes")
    return pairs, materialize(summed(block_vectors(pairs, hashes, slices), hashes), "totals")


def align(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """A row per document: its tokens, groups and links, and the sums of their corpus-wide counts."""
    spark = docs.sparkSession
    a, b = (shared_vocabulary(spark, p) for p in vocabularies or vocabulary_paths())
    shards = partitions(spark)
    blocks = BLOCKS * shards
    rows = in_blocks(docs, blocks)
    pairs, totals = pair_counts(rows, a, b, blocks, shards)
    return document_sums(rows, looked_up(pairs, totals, max(2, -(-blocks // shards))), a, b)


def counted_pairs(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """The linked id pairs of a corpus: a_id, b_id, documents that hold them linked, whether it is the best of a_id."""
    spark = docs.sparkSession
    a, b = (shared_vocabulary(spark, p) for p in vocabularies or vocabulary_paths())
    shards = partitions(spark)
    _, totals = pair_counts(in_blocks(docs, BLOCKS * shards), a, b, BLOCKS * shards, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for k, c, m in zip(t.column("keys"), t.column("counts"), t.column("best")):
                keys = longs(k)
                best = np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=len(keys)).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(longs(c)), pa.array(best)], ["a_id", "b_id", "documents", "best"])

    return totals.mapInArrow(run, "a_id int, b_id int, documents long, best boolean")


@register("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment, counted over the corpus."""
    return align(documents(spark, sf_dir))
