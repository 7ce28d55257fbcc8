"""Operators 11 to 13 against brute force, and their defined edge cases."""

import hashlib
import json
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabula.llm import bpe_chunks, filter_audit, token_alignment, units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, block int, mask int, part string"
PIECES = ["a", "b", "e", "'", "'re", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "ß", " ", "1", "23", "!", "<|endoftext|>", "<|endof", "日本", "😀", "word ", "the ", " is", " ", "x" * 30, "\x00", "▁"]


def text_of(rnd, n):
    return "".join(rnd.choice(PIECES) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 7, 9, "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    shared = " ".join(f"w{rnd.randrange(900)}" for _ in range(700))
    out = [(1, None, None), (2, "", "a"), (3, " ", "a"), (3, " ", "a"), (None, "null id here", ""), (4, shared, "b"), (5, shared, "b"), (6, "start " + shared[40:] + " end", "b"),
           (7, shared[:2000] + "<|endoftext|>" + shared[2000:], None), (8, "don't  stop\n\n now ", "a"), (9, "a▁b", "a"), (10, "x" * 20_000, "b"), (11, "A" * 30 + " #", "b")]
    return out + [(20 + i, text_of(rnd, rnd.randrange(200)), rnd.choice(["a", "b", "c"])) for i in range(60)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_chunks.vocabulary_path())


# --- 13 ----------------------------------------------------------------------------------------------------------

def test_joins_are_repaired(library, monkeypatch):
    for name, value in (("SHORTEST", 4), ("CUT_BITS", 3), ("LONGEST", 40), ("RUN", 64), ("AHEAD", 8)):
        monkeypatch.setattr(bpe_chunks, name, value)
    with open(bpe_chunks.vocabulary_path(), "rb") as f:
        own = bpe_chunks.coder(f.read())
    rnd = random.Random(1)
    for i in range(400):
        text = text_of(rnd, rnd.randrange(400))
        data = text.encode()
        chunks = list(bpe_chunks.chunks_of(bpe_chunks.layout(own, data)))
        assert b"".join(data[a:b] for a, b in chunks) + b"<|endoftext|>" * data.count(b"<|endoftext|>") and all(a < b for a, b in chunks)
        shared = {k: own.encode(data[a:b]).ids.tobytes() for k, (a, b) in enumerate(chunks) if rnd.random() < 0.5}
        if shared and i % 5 == 0:  # tokens of another chunk under the same hash
            shared[next(iter(shared))] = own.encode(b"wrong").ids.tobytes()
        got = [int(x) for a in bpe_chunks.code(own, data, shared) for x in a]
        assert got == library.encode(text, add_special_tokens=False).ids


def test_plain_characters_are_split_alike(library):
    with open(bpe_chunks.vocabulary_path(), "rb") as f:
        own = units.ByteLevelBpe(f.read())
    assert own.fast is not None
    plain = [chr(c) for c in range(ord(own.PLAIN))]
    for text in ("".join(plain), " ".join(plain), "".join(f"a{c}b{c}{c} " for c in plain), "".join(f"1{c}'s " for c in plain)):
        assert own.fast.encode_ordinary(text) == own.inner.encode(text, add_special_tokens=False).ids


def test_encoding_equals_the_library(spark, rows, library):
    docs = docs_of(spark, rows)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, list(r.ids), r.decoded) for r in bpe_chunks.encode_documents(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted(want, key=key)
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.encode_documents(docs, digests=True).collect()}
    assert digests == {(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, x, d in want}
    assert bpe_chunks.encode_documents(docs.limit(0)).collect() == []


def test_chunks_are_shared(spark, rows):
    docs = bpe_chunks.with_key(docs_of(spark, rows))
    spec = bpe_chunks.shared_vocabulary(spark, bpe_chunks.vocabulary_path())
    places = bpe_chunks.shared_places(bpe_chunks.chunk_places(docs, spec)).collect()
    assert len(places) > 4 and Counter(p.chunk for p in places if p.owner) == Counter({p.chunk: 1 for p in places})


def test_other_tokenizers_are_refused():
    with open(bpe_chunks.vocabulary_path(), "rb") as f:
        told = json.load(f)
    with pytest.raises(ValueError):
        units.ByteLevelBpe(json.dumps(told | {"normalizer": {"type": "NFC"}}).encode())


# --- 11 ----------------------------------------------------------------------------------------------------------

def naive_alignment(rows):
    import sentencepiece

    path_a, path_b = token_alignment.vocabulary_paths()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    alphabet = units.byte_alphabet()
    bytes_a = {i: bytes(alphabet[c] for c in w) if all(c in alphabet for c in w) else w.encode() for w, i in a.get_vocab().items()}
    bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in (b.id_to_piece(i) for i in range(len(b)))]
    found, count = [], Counter()
    for i, t, _ in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        data = (" " + (t or "")).encode()
        if not t or b"".join(bytes_a[k] for k in x) != data or b"".join(bytes_b[k] for k in y) != data:
            found.append((i, 0, 0, 0, [], ""))
            continue
        ends_x, ends_y = np.cumsum([len(bytes_a[k]) for k in x]).tolist(), np.cumsum([len(bytes_b[k]) for k in y]).tolist()
        groups, m, n = [], 0, 0
        for e in sorted(set(ends_x) & set(ends_y)):
            p, q = ends_x.index(e) + 1, ends_y.index(e) + 1
            groups.append((x[m:p], y[n:q]))
            m, n = p, q
        links = [(u, v) for g in groups for u in g[0] for v in g[1]]
        count.update(set(links))
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        found.append((i, len(x), len(y), len(groups), links, hashlib.sha256(shown.encode()).hexdigest()))
    most = Counter()
    for (u, _), c in count.items():
        most[u] = max(most[u], c)
    return count, [(i, n, m, g, len(ls), sum(count[x] == most[x[0]] for x in ls), sum(count[x] for x in ls), d) for i, n, m, g, ls, d in found]


def test_alignment_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(token_alignment, "SLICE", 50)
    count, want = naive_alignment(rows)
    docs = docs_of(spark, rows)
    key = lambda r: (r[0] is None, *[x or 0 for x in r[:1]], *r[1:])
    assert sorted([tuple(r) for r in token_alignment.align(docs).collect()], key=key) == sorted(want, key=key)
    pairs = {(r.a_id, r.b_id): r.documents for r in token_alignment.counted_pairs(docs).collect()}
    assert pairs == dict(count)
    assert token_alignment.align(docs.limit(0)).collect() == []


def test_memory_of_units_is_bounded(monkeypatch):
    monkeypatch.setattr(token_alignment, "UNITS", 40)
    monkeypatch.setattr(token_alignment, "SLICE", 30)
    work = token_alignment.Aligner(*[open(p, "rb").read() for p in token_alignment.vocabulary_paths()])
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(300)}" for _ in range(60)) for _ in range(30)]
    fresh = token_alignment.Aligner(*[open(p, "rb").read() for p in token_alignment.vocabulary_paths()])
    for t, keys in zip(texts, work.linked(texts)):
        assert keys.tolist() == next(fresh.linked([t])).tolist()
    assert work.memory.generation > 3 and len(work.memory.index) <= 40 + 60


def test_perfect_hash_is_minimal():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rnd.integers(0, 1 << 47, n))
        h = token_alignment.PerfectHash.unpack(token_alignment.PerfectHash.of(keys).pack())
        assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
        assert (h.index(rnd.integers(0, 1 << 47, 50)) < max(1, len(keys))).all()


# --- 12 ----------------------------------------------------------------------------------------------------------

def naive_audit(rows, labels):
    fails, good, toxic = [], {}, {}
    for i, q, t in labels:
        good[i], toxic[i] = good.get(i, 0) or q == 1, toxic.get(i, 0) or t == 1
    for i, t, s in rows:
        text = t or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in text).split(" ") if w]
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
             "D": any(c in "#$%&*|" for c in text), "E": i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in rows)}
        fails.append((s or "", {k for k, v in f.items() if v}, good.get(i, 0) if i is not None else 0, toxic.get(i, 0) if i is not None else 0))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in permutations("ABCDE"):
            alive = [f for f in fails if f[0] == part]
            everyone = list(alive)
            for step, c in enumerate(order, 1):
                gone = [f for f in alive if c in f[1]]
                alive = [f for f in alive if c not in f[1]]
                out[part, "".join(order), step] = (len(alive), len(gone), sum(c in f[1] for f in everyone) - len(gone), sum(f[1] == {c} for f in everyone),
                                                   sum(bool(f[2]) for f in gone), sum(bool(f[3]) for f in gone))
                shapley[part, c] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE", 64)
    monkeypatch.setattr(filter_audit, "HELD", 2)
    labels = [(4, 1, 0), (5, 0, 1), (5, 1, 0), (11, 1, 1), (None, 1, 1), (20, None, 1), (21, 1, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bits = filter_audit.with_copies(filter_audit.measured(docs_of(spark, rows)), 4)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in filter_audit.audit(filter_audit.with_flags(bits, table)).collect()}
    assert got == naive_audit(rows, labels)
    none = filter_audit.with_copies(filter_audit.measured(docs_of(spark, rows).limit(0)), 4)
    assert filter_audit.audit(filter_audit.with_flags(none, table)).collect() == []


def test_wide_fields_do_not_carry():
    big = filter_audit.wide_integers("AB")
    total = big[3, 3] * ((1 << 63) + 5) + big[0, 0] * 7
    fields = np.frombuffer(total.to_bytes(6 * 2 * 2 * 8, "little"), "<u8").reshape(6, 2, 2)
    assert fields[1].tolist() == [[(1 << 63) + 5, 0]] * 2 and fields[0].tolist() == [[7, 7]] * 2
