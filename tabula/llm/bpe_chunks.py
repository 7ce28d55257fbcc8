"""Byte-pair encoding and decoding with chunks that documents share.

Texts are cut where a rolling hash over the last ``WINDOW`` bytes says so, hence equal passages are cut alike wherever
they stand. Chunks are known by a 64-bit hash; one that occurs at two places of the corpus is encoded once, by the text
that owns its first occurrence (the least hash of a place), and its tokens go to every text that holds it. What lies
between shared chunks is encoded where it stands.

A chunk alone is not split like the same bytes inside a text, but encodings that both start a unit (see
:mod:`tabula.llm.units`) at one place agree from there on. Joins are repaired by that: from the last unit of the left
piece, the text is encoded anew across the join until it starts a unit where the next piece starts one too; where none
does, the stretch is doubled, up to the end of the text.

Added tokens (special strings) cut a text first, as the tokenizer does; the parts between them are texts of their own.
Tokens of shared chunks are decoded and compared with the chunk's bytes before use, so equal hashes of different chunks
cannot change a result (the chunk is then encoded on the spot).

Equal texts are coded once: texts go to the shuffle once each, and results are joined back by digest.

The vocabulary is a file of a public tokenizer; its path is a parameter, and the driver sends its bytes (bounded by the
file) to the executors. It must be byte-level BPE without normalizer, and added tokens must be matched literally; any
other file is refused.

Defined cases: null text is empty and has no tokens; rows are independent, so repeated rows and null ids give a row each;
a long text is coded ``RUN`` bytes at a time; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.llm.common import documents, register
from tabula.llm.units import ByteLevelBpe, starts_unit
from tabula.session import materialize

WINDOW = 32        # bytes of the rolling hash, a power of two
SHORTEST = 128     # bytes of a chunk, at least
LONGEST = 8192     # bytes of a chunk, at most
CUT_BITS = 9       # a cut every 2^9 bytes on average beyond the shortest
RUN = 1 << 15      # bytes of a stretch without shared chunks that are encoded in one call
BLOCK = 1 << 20    # bytes whose rolling hashes are held at once
AHEAD = 48         # bytes past a join that are encoded first
SEEN = 1_000_000   # digests of texts that a task remembers
BATCH = 128        # texts handled at once


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Coder(ByteLevelBpe):
    """The tokenizer of one file, over bytes."""

    def __init__(self, spec: bytes):
        super().__init__(spec)
        self.splits = re.compile(b"|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.kind = np.dtype("<u2" if len(self.bytes_of) <= 1 << 16 else "<u4")
        self.decimal = np.array([f"{i}," for i in range(len(self.bytes_of))], "S").view(np.uint8).reshape(len(self.bytes_of), -1)

    def encode(self, data: bytes) -> Piece:
        """Tokens of a stretch of text as if it stood alone."""
        return Piece(self, data, np.array(self.ids(data.decode()), self.kind))

    def segments(self, data: bytes) -> list[tuple[int, int, int | None]]:
        """(start, end, id of the added token behind it or None) of the parts between added tokens."""
        out, start = [], 0
        for m in self.splits.finditer(data) if self.splits else ():
            out.append((start, m.start(), self.added[m[0]]))
            start = m.end()
        return [*out, (start, len(data), None)]

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        digits = self.decimal[ids]
        return digits[digits != 0].tobytes()[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def coder(spec: bytes) -> Coder:
    """One per worker process and file."""
    return Coder(spec)


class Piece:
    """Tokens of a stretch of text that was encoded alone."""

    def __init__(self, own: Coder, data: bytes, ids: np.ndarray):
        self.data, self.ids = data, ids
        self.ends = np.cumsum(own.width[ids])

    def settled(self, k: int) -> int:
        """The last token behind token k that starts a unit; k if there is none."""
        at, floor = len(self.data), int(self.ends[k - 1]) if k else 0
        while True:
            at = self.data.rfind(b" ", floor + 1, at)
            if at < 0:
                return k
            if starts_unit(self.data, at):
                return int(np.searchsorted(self.ends, at)) + 1

    def at(self, offset: int) -> int | None:
        """The token that starts a unit at this byte, None if there is none."""
        return int(np.searchsorted(self.ends, offset)) + 1 if starts_unit(self.data, offset) else None


def mixed(n: int) -> np.ndarray:
    """n spread 32-bit numbers (a multiplicative rule)."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


BYTE_HASH = mixed(256)
FACTOR = 0x2C1B3C6D  # odd


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last ``WINDOW`` bytes at every place, by doubling."""
    h, step, factor = BYTE_HASH[data], 1, FACTOR
    while step < WINDOW:
        wide = h.copy()
        wide[step:] += h[:-step] * np.uint32(factor)
        h, step, factor = wide, 2 * step, factor * factor & 0xFFFFFFFF
    return h


def candidates(data: bytes) -> Iterator[int]:
    """Places behind which the rolling hash allows a cut."""
    for start in range(0, len(data), BLOCK):
        lead = min(start, WINDOW - 1)
        h = rolling(np.frombuffer(data, np.uint8, min(BLOCK, len(data) - start) + lead, start - lead))[lead:]
        yield from (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + start + 1).tolist()


def whole(data: bytes, at: int) -> int:
    """``at``, moved on to the start of a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of one segment."""
    ends, last = [], 0
    for c in [*candidates(data), len(data)]:
        if c - last < SHORTEST and c < len(data):
            continue
        while c - last > LONGEST:
            last = whole(data, last + LONGEST)
            ends.append(last)
        c = whole(data, c)
        if c > last:
            ends.append(c)
            last = c
    return ends


def layout(own: Coder, data: bytes) -> list[tuple[int, int, int | None, list[int]]]:
    """Segments of a text with the ends of their chunks (places in the text)."""
    return [(a, b, token, [a + e for e in chunk_ends(data[a:b])]) for a, b, token in own.segments(data)]


def chunks_of(segments: list[tuple[int, int, int | None, list[int]]]) -> Iterator[tuple[int, int]]:
    for a, _, _, ends in segments:
        for e in ends:
            yield a, e
            a = e


def chunk_hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def stretches(data: bytes, ends: list[int], start: int, first: int, shared: dict[int, Piece]) -> Iterator[tuple[int, int, Piece | None]]:
    """Pieces of a segment: shared chunks, and runs of the others of about ``RUN`` bytes. ``first``: number of its first chunk."""
    run = at = start
    for i, e in enumerate(ends):
        piece = shared.get(first + i)
        if piece is not None:
            if at > run:
                yield run, at, None
            yield at, e, piece
            run = e
        elif e - run >= RUN:
            yield run, e, None
            run = e
        at = e
    if at > run:
        yield run, at, None


class Pieces:
    """The pieces of a segment, encoded when they are read and forgotten behind the reader."""

    def __init__(self, own: Coder, data: bytes, parts: list[tuple[int, int, Piece | None]]):
        self.own, self.data, self.parts, self.made = own, data, parts, {}

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, i: int) -> Piece:
        known = self.parts[i][2]
        if known is not None:
            return known
        if i not in self.made:
            a, b, _ = self.parts[i]
            self.made[i] = self.own.encode(self.data[a:b])
        return self.made[i]

    def forget(self, i: int) -> None:
        """Pieces before i are done."""
        for j in [j for j in self.made if j < i]:
            del self.made[j]


def joined(own: Coder, data: bytes, pieces: Pieces) -> Iterator[np.ndarray]:
    """The tokens of contiguous pieces, repaired at their joins."""
    i, k = 0, 0  # tokens up to token k of piece i are out, and it starts a unit of the whole
    while i < len(pieces):
        pieces.forget(i)
        (start, end, _), piece = pieces.parts[i], pieces[i]
        if i + 1 == len(pieces):
            yield piece.ids[k:]
            return
        j = piece.settled(k)
        yield piece.ids[k:j]
        at = start + (int(piece.ends[j - 1]) if j else 0)
        reach, stop = end - at + AHEAD, pieces.parts[-1][1]
        while True:
            to = whole(data, min(at + reach, stop))
            again = own.encode(data[at:to])
            met = _meeting(again, at, end, pieces, i + 1)
            if met is not None:
                n, i, k = met
                yield again.ids[:n]
                break
            if to == stop:
                yield again.ids
                return
            reach *= 2


def _meeting(again: Piece, at: int, end: int, pieces: Pieces, i: int) -> tuple[int, int, int] | None:
    """The first unit behind ``end`` that the new encoding and a piece both start a token at: (tokens up to it, piece, its token)."""
    x = end - at - 1
    while (x := again.data.find(b" ", x + 1)) >= 0:
        n = again.at(x)
        if n is None:
            continue
        while i < len(pieces) and pieces.parts[i][1] <= at + x:
            i += 1
        k = pieces[i].at(at + x - pieces.parts[i][0]) if i < len(pieces) else None
        if k is not None:
            return n, i, k
    return None


def code(own: Coder, data: bytes, shared: dict[int, bytes]) -> Iterator[np.ndarray]:
    """Token ids of a text in order, an array at a time; ``shared``: packed tokens by chunk number."""
    segments, number = layout(own, data), 0
    known = {}
    for i, (a, b) in enumerate(chunks_of(segments)) if shared else ():
        if i in shared:
            ids = np.frombuffer(shared[i], own.kind)
            if own.decode(ids) == data[a:b]:
                known[i] = Piece(own, data[a:b], ids)
    for start, _, token, ends in segments:
        parts = list(stretches(data, ends, start, number, known))
        number += len(ends)
        yield from joined(own, data, Pieces(own, data, parts))
        if token is not None:
            yield np.array([token], own.kind)


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the text's 128-bit digest ``text_key``."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), "text")


def shared_vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def chunk_places(texts: DataFrame, spec) -> DataFrame:
    """text_key, seq, chunk: the chunk hashes of every text, a row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = coder(spec.value), set()
        for b in batches:
            keys, lists = [], []
            for key, text in zip(b.column("text_key").to_pylist(), b.column("text")):
                if key in seen:  # a copy inside the task
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                data = text.as_buffer().to_pybytes()
                keys.append(key)
                lists.append([chunk_hash(data[x:y]) for x, y in chunks_of(layout(own, data))])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["text_key", "chunks"])

    found = texts.select("text_key", "text").mapInArrow(run, "text_key binary, chunks array<long>")
    return found.select("text_key", F.posexplode("chunks").alias("seq", "chunk")).dropDuplicates(["text_key", "seq"])


def shared_places(places: DataFrame) -> DataFrame:
    """Places of the chunks that occur at two places or more; ``owner``: the one place that encodes the chunk."""
    place = F.xxhash64("text_key", "seq")
    several = places.groupBy("chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") < F.col("last")).select(F.col("chunk").alias("c"), "first")
    return places.join(several, F.col("chunk") == F.col("c")).select("text_key", "seq", "chunk", (place == F.col("first")).alias("owner"))


def encode_owned(texts: DataFrame, spec) -> DataFrame:
    """``texts`` with ``owned`` array<struct<seq, chunk>>: chunk, tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(spec.value)
        for b in batches:
            for owned, text in zip(b.column("owned"), b.column("text")):
                data = text.as_buffer().to_pybytes()
                places = list(chunks_of(layout(own, data)))
                mine = owned.as_py()
                for at in range(0, len(mine), BATCH):
                    some = mine[at: at + BATCH]
                    pieces = [own.encode(data[slice(*places[o["seq"]])]) for o in some]
                    yield pa.RecordBatch.from_arrays([pa.array([o["chunk"] for o in some], pa.int64()), pa.array([p.ids.tobytes() for p in pieces], pa.binary())], ["c", "tokens"])

    return texts.select("text", "owned").mapInArrow(run, "c long, tokens binary")


DIGESTS = "text_key binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "text_key binary, ids array<int>, decoded string"


def code_texts(texts: DataFrame, spec, digests: bool) -> DataFrame:
    """``texts`` with ``parts`` array<struct<seq, tokens>> (or null): the ids and the decoded text, or only their digests."""
    names = [c.split()[0] for c in (DIGESTS if digests else TOKENS).split(", ")]

    def digest(own: Coder, arrays: Iterator[np.ndarray]) -> tuple[int, str, str]:
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for a in arrays:
            if len(a):
                ids.update((b"," if n else b"") + own.listed(a))
                decoded.update(own.decode(a))
                n += len(a)
        return n, ids.hexdigest(), decoded.hexdigest()

    def tokens(own: Coder, arrays: Iterator[np.ndarray]) -> tuple[np.ndarray, str]:
        ids = np.concatenate([np.zeros(0, own.kind), *arrays])
        return ids.astype(np.int32), own.decode(ids).decode(errors="replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(spec.value)
        kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                c = b.slice(at, BATCH)
                rows = []
                for parts, text in zip(c.column("parts"), c.column("text")):
                    shared = {p["seq"]: p["tokens"] for p in parts.as_py() or ()}
                    rows.append((digest if digests else tokens)(own, code(own, text.as_buffer().to_pybytes(), shared)))
                yield pa.RecordBatch.from_arrays([c.column("text_key"), *[pa.array(x, k) for x, k in zip(zip(*rows), kinds)]], names)

    return texts.select("text_key", "text", "parts").mapInArrow(run, DIGESTS if digests else TOKENS)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, digests: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id and ids, decoded (or n_tokens and the digests of both)."""
    spec = shared_vocabulary(docs.sparkSession, vocabulary or vocabulary_path())
    keyed = with_key(docs)
    places = materialize(chunk_places(keyed, spec), "chunks")
    shared = materialize(shared_places(places), "shared-chunks")
    # the joins would add this filter to one of the two reads of the texts; stated, both share one exchange
    texts = keyed.where(F.col("text_key").isNotNull()).select("text_key", "text").dropDuplicates(["text_key"])
    owned = shared.where("owner").groupBy("text_key").agg(F.collect_list(F.struct("seq", "chunk")).alias("owned"))
    tokens = encode_owned(texts.join(owned, "text_key"), spec)
    parts = (shared.join(tokens, F.col("chunk") == F.col("c")).groupBy("text_key").agg(F.collect_list(F.struct("seq", "tokens")).alias("parts")))
    coded = code_texts(texts.join(parts, "text_key", "left"), spec, digests)
    return keyed.select("doc_id", "text_key").join(coded, "text_key").drop("text_key")


@register("op13_bpe_chunks")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them."""
    return encode_documents(documents(spark, sf_dir), digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
