"""Token counts that follow edits.

Byte-pair encoding works inside pre-tokens, so a text's count is the sum over its pre-tokens. A document keeps a
segment tree over blocks of pre-tokens; a node holds the code points and tokens below it. An edit descends to the
pre-token it touches, steps ``CONTEXT`` pre-tokens back (the pattern looks at most that far ahead), splits the new text
from there until a boundary coincides with an old one behind the edit, encodes only what lies between, and updates the
sums on the paths of the blocks it changed. The rest of the text is not read again.

The vocabulary is a file of a public tokenizer; its path is a parameter, and the driver sends its bytes (bounded by the
file) to the executors.

Defined cases: null text is empty; an edit starts at most at the text's end and removes at most what is there; a null
edit list or replacement is empty; edits apply in order, each to the result of the one before.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.llm.common import documents, register

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTEXT = 3
BLOCK = 32
CACHE = 400_000  # pre-tokens whose counts a worker remembers


class Counter(dict):
    """Tokens of a pre-token, remembered for up to ``CACHE`` of them."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < CACHE:
            self[piece] = n
        return n

    def whole(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


class TokenTree:
    """Segment tree over blocks of pre-tokens of one text."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        pieces = counter.split.findall(text)
        self._build([len(p) for p in pieces], [counter[p] for p in pieces])

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.blocks = [(lengths[i: i + BLOCK], counts[i: i + BLOCK]) for i in range(0, len(lengths), BLOCK)] or [([], [])]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (l, c) in enumerate(self.blocks):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(l), sum(c)
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def pieces(self) -> int:
        return sum(len(l) for l, _ in self.blocks)

    def _find(self, at: int) -> tuple[int, int, int]:
        """(block, index in it, start) of the pre-token that holds code point ``at``; the last one at the end."""
        node, base = 1, 0
        while node < self.size:
            node *= 2
            if at >= base + self.chars[node] and self.chars[node + 1]:
                base += self.chars[node]
                node += 1
        block = node - self.size
        for i, n in enumerate(self.blocks[block][0]):
            if at < base + n:
                return block, i, base
            base += n
        lengths = self.blocks[block][0]
        return (block, len(lengths) - 1, base - lengths[-1]) if lengths else (block, 0, base)

    def _back(self, block: int, i: int, start: int) -> tuple[int, int, int]:
        """One pre-token earlier."""
        while i == 0:
            block -= 1
            if block < 0:
                return 0, 0, 0
            i = len(self.blocks[block][0])
        return block, i - 1, start - self.blocks[block][0][i - 1]

    def edit(self, start: int, length: int, replacement: str) -> None:
        start = min(max(start, 0), len(self.text))
        end = min(start + max(length, 0), len(self.text))
        block, i, at = self._find(start)
        for _ in range(CONTEXT):
            if at > 0:
                block, i, at = self._back(block, i, at)
        text = self.text[:start] + replacement + self.text[end:]
        shift = len(text) - len(self.text)
        old_block, old_i, old_at = block, i, at  # the boundary behind the pre-tokens that are given up
        lengths, counts, new_at = [], [], at
        for m in self.counter.split.finditer(text, at):
            while old_at < end or old_at + shift < new_at:  # next old boundary at or behind this one
                while old_block < len(self.blocks) and old_i >= len(self.blocks[old_block][0]):
                    old_block, old_i = old_block + 1, 0
                if old_block == len(self.blocks):
                    break
                old_at += self.blocks[old_block][0][old_i]
                old_i += 1
            if old_at >= end and old_at + shift == new_at and new_at >= start + len(replacement):
                break
            lengths.append(m.end() - m.start())
            counts.append(self.counter[m[0]])
            new_at = m.end()
        else:  # no old boundary was met again: everything behind is replaced
            old_block, old_i = len(self.blocks), 0
        self.encoded += len(lengths)
        self.text = text
        self._replace(block, i, old_block, old_i, lengths, counts)

    def _replace(self, block: int, i: int, to_block: int, to_i: int, lengths: list[int], counts: list[int]) -> None:
        l, c = self.blocks[block]
        if to_block == block:
            new = (l[:i] + lengths + l[to_i:], c[:i] + counts + c[to_i:])
            changed = [block]
        else:
            new = (l[:i] + lengths, c[:i] + counts)
            changed = list(range(block, min(to_block + 1, len(self.blocks))))
            for b in changed[1:]:
                x, y = self.blocks[b]
                self.blocks[b] = (x[to_i:], y[to_i:]) if b == to_block else ([], [])
        self.blocks[block] = new
        if len(new[0]) > 8 * BLOCK:  # a long insertion: cut the blocks anew
            self._build([n for x, _ in self.blocks for n in x], [n for _, y in self.blocks for n in y])
            return
        for b in changed:
            node = self.size + b
            self.chars[node], self.tokens[node] = sum(self.blocks[b][0]), sum(self.blocks[b][1])
            while node > 1:
                node //= 2
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]


SCHEMA = "doc_id long, n_tokens long, n_pieces long, edited_chars long, edited_tokens long, encoded_pieces long"


def count_with_edits(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows``: doc_id, text, edits array<struct<start, length, replacement>>. Counts before and after the edits and
    how many pre-tokens were encoded for them."""
    with open(vocabulary, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            out = []
            for text, edits in zip(b.column("text").to_pylist(), b.column("edits").to_pylist()):
                tree = TokenTree(text or "", counter)
                before, pieces = tree.total, tree.pieces
                for e in edits or ():
                    tree.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                out.append((before, pieces, len(tree.text), tree.total, tree.encoded))
            cols = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], [x.split()[0] for x in SCHEMA.split(", ")])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "edits").mapInArrow(run, SCHEMA)


def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every text, made from the text: the middle 32 code points become the first 32, 16 go at a quarter,
    and a phrase enters at a third of the result."""
    n = F.char_length("text")
    edit = lambda start, length, new: F.struct(F.floor(start).cast("int").alias("start"), F.lit(length).alias("length"), new.alias("replacement"))
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return text.select("doc_id", "text", F.array(edit(n / 2, 32, F.substring("text", 1, 32)), edit(n / 4, 16, F.lit("")), edit(n / 3, 0, F.lit(" edited passage's end, "))).alias("edits"))


@register("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its edits."""
    return count_with_edits(sample_edits(documents(spark, sf_dir)))
