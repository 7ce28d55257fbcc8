"""The pipeline's stages against brute force on a small corpus with planted copies, junk and repeated passages."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from tabula.llm import mixing, packing, quality
from tabula.session import materialize

from tests.llm.test_operators import docs_of, naive_components, naive_targets, near_copies, prose

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rnd = random.Random(12)
    texts = [prose(rnd, rnd.randrange(60, 200), 4000) for _ in range(160)] + near_copies(rnd, 30, 100, 5)
    passage = prose(rnd, 45, 4000)
    texts += [f"{prose(rnd, 90, 4000)} {passage} é {prose(rnd, 40, 4000)}" for _ in range(25)]
    texts += [texts[7]] * 10 + ["too short"] * 3 + [None] + [" ".join(f"### {w} $$$" for w in prose(rnd, 80, 4000).split()) for _ in range(8)]
    rnd.shuffle(texts)
    return [(3 * i, t, "en", ["a", "b", "b", None][i % 4]) for i, t in enumerate(texts)]


def test_stages_match_brute_force(spark):
    rows = corpus()
    docs, seen = docs_of(spark, rows), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, "unused"), "test")
        seen.append([r.asDict() for r in docs.collect()])
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == DOC_COLUMNS
    kept, alone, cut, mixed, packed = seen

    text = {r[0]: r[1] for r in rows}
    good = {i for i, t in text.items() if t and len(t.split()) >= 50 and "###" not in t}
    assert {r["doc_id"] for r in kept} == good and all(r["text"] == text[r["doc_id"]] for r in kept)

    left = sorted((i, text[i]) for i in good)
    assert sorted(r["doc_id"] for r in alone) == sorted({c for _, _, c in naive_components(left)})

    strings, expect = set(), {}
    for r in sorted(alone, key=lambda r: r["doc_id"]):
        b = r["text"].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in strings:
                gone[p:p + 100] = b"\1" * 100
            strings.add(b[p:p + 100])
        t = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if not any(gone) or t.split():
            expect[r["doc_id"]] = t
    assert {r["doc_id"]: r["text"] for r in cut} == expect and any(len(expect[r["doc_id"]]) < len(r["text"]) for r in alone if r["doc_id"] in expect)
    assert all(r["n_chars"] == len(r["text"]) for r in cut)

    sizes = Counter()
    for r in cut:
        sizes[r["source"]] += len(r["text"].split())
    target = naive_targets(sizes)
    times = Counter(r["doc_id"] for r in mixed)
    for r in cut:
        rate = target[r["source"]] / sizes[r["source"]]
        assert int(rate) <= times[r["doc_id"]] <= int(rate) + 1

    total = Counter()
    for r in packed:
        total[r["doc_id"]] += r["n_tokens"]
        assert r["n_tokens"] <= r["padded"] <= packing.MAX_LEN
    assert total == Counter({i: n * len(expect[i].split()) for i, n in times.items()})
    assert mixing.MAX_REPEAT >= max(times.values()) and quality.MIN_WORDS == 50 and np.all([r["batch"] >= 0 for r in packed])


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.count() == 0
