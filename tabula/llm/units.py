"""Units of text that tokenizers treat alone, and a bounded memory of their tokens.

A unit starts at a space that follows a character other than white space and is followed by something. A byte-level
pattern splits there whatever stands around (nothing it matches has a space behind another character, and white space
looks ahead only from white space); a piece vocabulary does where no piece holds a space mark behind another character,
which :func:`splits_at_spaces` checks. So the tokens of a text are those of its units, one after another.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

CUT = re.compile(r" (?<=\S )(?=[\s\S])")
MARK = "▁"


def units(text: str) -> list[str]:
    """The units of a text; all but the first lack the space they start with."""
    return CUT.split(text)


def starts_unit(data: bytes, at: int) -> bool:
    """Whether a unit of the UTF-8 text starts at this byte: decided by the characters on both sides."""
    if not 0 < at < len(data) - 1 or data[at] != 0x20:
        return False
    start = at - 1
    while start > 0 and data[start] & 0xC0 == 0x80:
        start -= 1
    return not data[start:at].decode().isspace()


def splits_at_spaces(pieces: Iterable[str]) -> bool:
    return not any(MARK in p.lstrip(MARK) for p in pieces)


class Index(dict):
    """Numbers for units in order of appearance; ``fresh``: those without tokens so far."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, unit):
        self[unit] = n = len(self)
        self.fresh.append(unit)
        return n


class Growing:
    """One growing buffer."""

    def __init__(self, kind):
        self.data, self.used = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(2 * need - self.used, self.data.dtype)])
        self.data[self.used: need] = values
        self.used = need


class Ragged:
    """Growing list of arrays in one buffer."""

    def __init__(self, kind):
        self.values, self.ends = Growing(kind), Growing(np.int64)
        self.ends.extend(np.zeros(1, np.int64))

    def extend(self, lengths: np.ndarray, flat: np.ndarray) -> None:
        self.ends.extend(self.values.used + np.cumsum(lengths))
        self.values.extend(flat)

    @property
    def flat(self) -> np.ndarray:
        return self.values.data

    @property
    def offsets(self) -> np.ndarray:
        return self.ends.data

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.offsets[rows + 1] - self.offsets[rows]

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Places of the values of these rows in the buffer, one row after another."""
        lengths = self.lengths(rows)
        ends = np.cumsum(lengths)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[rows] - (ends - lengths), lengths)

    def take(self, rows: np.ndarray) -> np.ndarray:
        return self.flat[self.places(rows)]

    def only(self, rows: np.ndarray) -> Ragged:
        """A list of these rows."""
        out = Ragged(self.flat.dtype)
        out.extend(self.lengths(rows), self.take(rows))
        return out


class Memory:
    """Units and their tokens, at most ``limit`` of them; the least used half goes when it is full."""

    def __init__(self, limit: int, *kinds):
        self.generation = 0  # grows when units get other numbers
        self.limit, self.index, self.hits = limit, Index(), Growing(np.int32)
        self.tables = [Ragged(k) for k in kinds]

    def thin(self) -> np.ndarray | None:
        """Make room where it is needed. Call it between look-ups: units get other numbers. The old numbers of those that
        stay, None if all do."""
        n = len(self.index)
        if n <= self.limit:
            return None
        self.generation += 1
        hits = self.hits.data[:n]
        keep = np.sort(np.argsort(-hits, kind="stable")[: n // 2])
        keep = keep[hits[keep] > 1]
        names, self.index = list(self.index), Index()
        for i, k in enumerate(keep.tolist()):
            self.index[names[k]] = i
        self.tables = [t.only(keep) for t in self.tables]
        self.hits = Growing(np.int32)
        self.hits.extend(hits[keep] // 2)
        return keep

    def learn(self, lengths: np.ndarray, *flat: np.ndarray) -> None:
        """Values of the next fresh units."""
        for t, f in zip(self.tables, flat):
            t.extend(lengths, f)
        self.hits.extend(np.zeros(len(lengths), np.int32))

    def touch(self, numbers: np.ndarray) -> None:
        n = len(self.index)
        self.hits.data[:n] += np.bincount(numbers, minlength=n).astype(np.int32)


def standing_alone(text: str) -> bool:
    """Whether a unit, with its leading space, can be followed by another one without a change."""
    return not text[-1:].isspace()


class ByteLevelBpe:
    """The byte-level BPE of a tokenizer file, without its added tokens (their strings are plain text).

    Characters below ``PLAIN`` are classed alike by every version of the pattern's engine; texts of them go to the fast
    encoder of the same merges, where the file's ids are in the order of its merges. Others go to the file's own library.
    """

    PLAIN = "\u0250"

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import tiktoken
        from tokenizers import Tokenizer

        told = json.loads(spec)
        before, model = told["pre_tokenizer"] or {}, told["model"]
        if (told["normalizer"] is not None or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or model["type"] != "BPE"
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"])):
            raise ValueError("only byte-level BPE without normalizer, with literal added tokens, is supported")
        self.inner = Tokenizer.from_str(json.dumps(told | {"truncation": None, "padding": None, "post_processor": None}))
        self.inner.encode_special_tokens = True
        alphabet, words = byte_alphabet(), model["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in told["added_tokens"]}
        self.bytes_of = [b""] * (max([*words.values(), *self.added.values()]) + 1)
        plain = {}
        for word, i in words.items():
            if all(c in alphabet for c in word):
                self.bytes_of[i] = bytes([alphabet[c] for c in word])
                plain[self.bytes_of[i]] = i
            else:
                self.bytes_of[i] = word.encode()
        for content, i in self.added.items():
            self.bytes_of[i] = content
        self.width = np.array([len(b) for b in self.bytes_of], np.int64)
        merged = [words["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        ordered = all(x < y for x, y in zip(merged, merged[1:])) and not model.get("dropout") and not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={}) if ordered and merged else None

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and (text.isascii() or max(text) < self.PLAIN):
            return self.fast.encode_ordinary(text)
        return self.inner.encode(text, add_special_tokens=False).ids


#: Fixed value: the published pre-token pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
