"""Operators against brute force on small tables, and the defined edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabula.llm import components, fingerprint, language_id, mixing, ngram_join, packing, quality, suffix_dedup, token_counts, toxicity, url_filter
from tabula.llm.common import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["key", "node", "kept", "size", "bucket", "n_words", "words", "copies", "term"]
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    d = spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], SCHEMA)
    return d.select("*", *[F.lit("x").alias(c) for c in EXTRA])


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    rnd = random.Random(3)
    long = prose(rnd, 30_000, 9000)
    tie = prose(rnd, 80)
    return docs_of(spark, [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one two", None, "a"), (5, "one two", "en", "b"),
        (6, tie, "en", "b"), (6, tie, "en", "b"), (7, tie, "de", "a"), (8, long, "en", "a"), (9, long[:-40], "en", "a"),
        (None, tie + " end", "en", "c"), (10, "ÄÖ ü　é " * 40, "de", "c"), (11, "12345 !!! ???", "en", "c"), (-5, prose(rnd, 120), "en", "a")])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# --- 1 quality ---------------------------------------------------------------------------------------------------

def naive_measure(text):
    words = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
    marks = set()
    for i in range(len(words) - 2):
        for j in range(len(words) - 2):
            if i != j and words[i:i + 3] == words[j:j + 3]:
                marks |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.strip(" \t")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marks), len(lines))


def test_measures_match_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        text = "".join(rnd.choice(["a ", "b ", "c\n", "é#", "a b c ", "\t", "$ "]) for _ in range(rnd.randrange(40)))
        assert quality.measure(text) == naive_measure(text)
    assert quality.measure(None) == quality.measure("") == (0,) * 6


def test_quality_keeps_prose_and_rejects_symbols(spark):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, 90, 3000), "en", f"s{i % 2}") for i in range(400)] + [(1000 + i, " ".join(f"### {w} %%%" for w in prose(rnd, 90, 3000).split()), "en", "s1") for i in range(20)]
    got = dict(rows_of(quality.judge(docs_of(spark, rows)), "doc_id", "kept"))
    assert all(got[i] for i in range(400)) and not any(got[1000 + i] for i in range(20))
    kept = quality.accepted(docs_of(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400)) and kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_sketch_bucket_error(spark):
    d = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b"))
    assert all(r.b <= r.id and (r.id - r.b) * 32 <= max(r.id, 0) for r in d.collect())


def test_quality_edges(spark, edge, none):
    got = rows_of(quality.judge(edge), "doc_id", "n_words", "base_failed", "kept")
    assert len(got) == 14 and (1, 0, True, False) in got and (2, 0, True, False) in got and not quality.judge(none).count()


# --- 2 fingerprints ----------------------------------------------------------------------------------------------

def jaccard(a, b):
    a, b = Counter(a.encode().split()), Counter(b.encode().split())
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def test_fingerprints_estimate_the_weighted_jaccard(spark):
    rnd = random.Random(2)
    texts = [prose(rnd, rnd.randrange(1, 200), 60) for _ in range(150)]
    texts[10] = texts[20]
    got = {r.doc_id: r for r in fingerprint.edited_pairs(docs_of(spark, [(3 * i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    err, err2 = [], []
    for i, t in enumerate(texts):
        after = texts[i - 1]  # descending ids, then the largest
        n = len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        r = got[3 * i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        err.append(r.near_edited - jaccard(t, edited))
        err2.append(r.near_next - jaccard(t, after))
    assert abs(np.mean(err)) < 0.03 and abs(np.mean(err2)) < 0.03 and max(np.std(err), np.std(err2)) < 0.12
    assert got[30].fingerprint == got[60].fingerprint and len({r.fingerprint for r in got.values()}) >= 148


def test_fingerprint_edges(spark, edge, none):
    got = fingerprint.edited_pairs(edge).collect()
    assert len(got) == 14 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint == by[3][0].fingerprint and by[1][0].n_chars == 0
    assert by[4][0].fingerprint == by[5][0].fingerprint and by[6][0].near_next in (0.0, 1.0) or by[6][1].near_next == 1.0
    assert not fingerprint.edited_pairs(none).count()
    one = fingerprint.edited_pairs(docs_of(spark, [(7, "abc def ghi", "en", "a")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()


# --- 3 url filters -----------------------------------------------------------------------------------------------

def test_url_rules_match_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "http://example.org/en/17", "http://badexample.org/es/", "https://a.com/fr/x", "https://a.com/de/x",
            "https://a.com/DE/x", "http://com/de/", "http://spam-farm.net/x", "http://x.spam-farm.net", "http://x.net?u=http://y.org/", "http://a.org", "http://q.net/viagra/b?c", "http://q.net/notviagra/b",
            "http://x.casino.com/fr/1", "ftp://x.casino.net#f", "://", "http://org/", "http://org.net/es/"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    import re
    for r in url_filter.judge(pages).collect():
        url = urls[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match("[^/?#]*", rest)[0].translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
        path = re.match("[^?#]*", rest[len(host):])[0]
        assert (r.host, r.path) == (host, path)
        fits = [(len(x.name), x.name, x.verdict) for x in url_filter.HOST_RULES if (host == x.name.split("/")[0] or host.endswith("." + x.name.split("/")[0])) and path.startswith("/" + x.name.split("/", 1)[1])]
        globs = [x for x in url_filter.PATTERN_RULES if host and re.search(x.regex, url.lower())]
        expect = max(fits)[1:] if fits else (None, globs[0].verdict if globs else "allow")
        assert (r.rule, r.verdict) == expect, url


def test_rule_tokens_are_whole_tokens_of_every_match():
    assert url_filter.glob_rule("*://spam-farm.*", "block", 0).tokens == ("spam", "farm")
    assert url_filter.glob_rule("*ad*/x1/*", "block", 0).tokens == ("x1",)
    assert url_filter.host_rule("example.org", "/en/1", "block").tokens == ("example", "org", "en")


def test_url_edges(spark):
    assert not url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count()
    any_rule = (url_filter.glob_rule("*z*", "block", 0),)  # no literal token: tried on every url
    assert not any_rule[0].tokens
    pages = spark.createDataFrame([(1, "http://a.b/z"), (1, "http://a.b/z"), (None, "http://a.b/y")], "page_id long, url string")
    assert sorted(rows_of(url_filter.judge(pages, (), any_rule), "verdict")) == [("allow",), ("block",), ("block",)]


# --- 4 n-gram join -----------------------------------------------------------------------------------------------

def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def naive_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(root(i), []).append(d)
    return sorted((d, len(sets[i]), min(low[root(i)])) for i, (d, _) in enumerate(rows))


def near_copies(rnd, n, base_words, edits):
    base = prose(rnd, base_words, 5000).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk,rare", [(1024, 2048), (12, 16)])
def test_components_match_brute_force(spark, monkeypatch, chunk, rare):
    """Also with blocks that are cut into many chunks and with shingles that count as frequent early."""
    rnd = random.Random(8)
    texts = near_copies(rnd, 70, 120, 6) + near_copies(rnd, 40, 60, 4) + [prose(rnd, rnd.randrange(0, 300), 5000) for _ in range(80)]
    passage = prose(rnd, 40, 5000)
    texts += [f"{passage} {prose(rnd, 60, 5000)}" for _ in range(60)] + [texts[3]] * 25 + ["one two", "ONE  two", "", None]
    rnd.shuffle(texts)
    rows = [(2 * i, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "RARE", rare)
    d = docs_of(spark, [(i, t, "en", "a") for i, t in rows])
    assert sorted(rows_of(ngram_join.classes(d), "doc_id", "n_shingles", "component_id")) == naive_components(rows)
    kept = [r.doc_id for r in ngram_join.keep_one(d).collect()]
    assert sorted(kept) == sorted({c for _, _, c in naive_components(rows)})


def pages(rnd, n, own):
    """Pages of one template of 430 words, each with ``own`` words of its own."""
    template = prose(rnd, 430, 9000)
    return [f"{template} " + " ".join(f"o{rnd.randrange(10 ** 9)}" for _ in range(own(rnd))) for _ in range(n)]


def test_template_pages_below_the_threshold_do_not_meet(spark, monkeypatch):
    """86% of the shingles are shared by all pages, which is a likeness of 0.75: no link, and no pairs to compare."""
    met, by_runs = [], ngram_join.by_runs

    def counted(df, keys, tasks, fn, *more):
        if fn is ngram_join.prune:
            met.append(df.count())
        return by_runs(df, keys, tasks, fn, *more)

    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    monkeypatch.setattr(ngram_join, "RARE", 16)
    monkeypatch.setattr(ngram_join, "by_runs", counted)
    rows = list(enumerate(pages(random.Random(21), 240, lambda r: 70)))
    got = rows_of(ngram_join.classes(docs_of(spark, [(i, t, "en", "a") for i, t in rows])), "doc_id", "component_id")
    assert sorted(got) == [(i, i) for i, _ in rows]
    assert sum(met) < len(rows)


def test_template_pages_around_the_threshold_match_brute_force(spark, monkeypatch):
    """Some pages link, some do not, some only to shorter ones; guests and hosts are both cut into slices."""
    rnd = random.Random(22)
    texts = pages(rnd, 90, lambda r: r.randrange(110)) + pages(rnd, 60, lambda r: r.choice([0, 40, 60, 95]))
    texts += [t + f" z{i}" for i, t in enumerate(texts[::7])]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    monkeypatch.setattr(ngram_join, "RARE", 16)
    got = rows_of(ngram_join.classes(docs_of(spark, [(i, t, "en", "a") for i, t in rows])), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == naive_components(rows)


def test_tree_keeps_every_pair_the_bound_allows():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2 ** 63, rng.integers(1, 900), dtype=np.uint64)) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: int(0.95 * len(s))], rng.integers(0, 2 ** 63, 3, dtype=np.uint64)])) for s in sets]
    size = np.array([len(s) for s in sets])
    x, y = ngram_join.survivors([ngram_join.count_vector(s) for s in sets], size)
    found = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if ngram_join.linked(sets[i], sets[j])}
    assert true and true <= found and len(found) < 2000


def test_components_of_a_chain(spark):
    rnd = random.Random(4)
    ids = rnd.sample(range(10 ** 6), 200)
    e = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(5, 5)], "a long, b long")
    got = dict(rows_of(components.components(e), "node", "root"))
    assert got == {i: min(ids) for i in ids if i != min(ids)}


def test_ngram_edges(edge, none):
    got = rows_of(ngram_join.classes(edge), "doc_id", "n_shingles", "component_id")
    assert len(got) == 14 and (1, 0, 1) in got and got.count((6, 76, 6)) == 2 and (7, 76, 6) in got and (5, 1, 4) in got
    assert [g[2] for g in got if g[0] is None] == [6] and [g[2] for g in got if g[0] == 9] == [8]
    assert not ngram_join.classes(none).count() and not ngram_join.keep_one(none).count()


# --- 5 suffix dedup ----------------------------------------------------------------------------------------------

def naive_removed(rows):
    """(id, bytes, removed, spans, digest) with every window looked up."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(b[p:p + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_removed_bytes_match_brute_force(spark):
    rnd = random.Random(9)
    passages = ["".join(rnd.choice("ab ") for _ in range(rnd.choice([90, 99, 100, 101, 130, 260]))) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = [rnd.choice([rnd.choice(passages), "".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(150))), "a" * rnd.randrange(260), "xyz" * 50]) for _ in range(rnd.randrange(1, 6))]
        cut = rnd.choice(passages)
        texts.append("".join(parts) + cut[rnd.randrange(20):])
    rows = list(enumerate(texts + texts[:5] + [None, "", "short"]))
    d = docs_of(spark, [(i, t, "en", "a") for i, t in rows])
    assert sorted(rows_of(suffix_dedup.removed(d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == naive_removed(rows)


def test_deep_shallow_sort_orders_groups():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (400, 100)).astype(np.uint8)
    rows[:200, :70] = rows[0, :70]  # long common prefixes go to the tries
    rows[200:220] = rows[5]
    group = rng.integers(0, 5, 400)
    order, shared = suffix_dedup.deep_shallow(group, rows)
    strings = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert strings == sorted(strings)
    for (ga, a), (gb, b), lcp in zip(strings, strings[1:], shared[1:].tolist()):
        assert lcp == (-1 if ga != gb else next((k for k in range(100) if a[k] != b[k]), 100))


def test_anchor_scheme_covers_every_window():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abc") for _ in range(n)).encode() for n in (0, 99, 100, 101, 700, 5)] + [b"z" * 400]
    text, pos, before, more, _, _ = suffix_dedup.anchors(texts)
    owned = sorted((t, p - b + k) for t, p, b, m in zip(text.tolist(), pos.tolist(), before.tolist(), more.tolist()) for k in range(m + 1))
    assert owned == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 99)]


def test_suffix_edges(edge, none):
    got = rows_of(suffix_dedup.removed(edge), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert len(got) == 14 and (1, 0, 0, 0) in got and (2, 0, 0, 0) in got
    six = sorted(g for g in got if g[0] == 6)
    assert [g[2] for g in six] == [six[0][1], six[0][1]]  # the null id comes first and has their text
    assert [g[2] for g in got if g[0] is None] == [0] and [g[2:] for g in got if g[0] == 9][0][1] == 1
    kept = suffix_dedup.strip_repeats(edge)
    assert sorted(x for r in kept.collect() if (x := r.doc_id) is not None) == [-5, 1, 2, 3, 4, 5, 8, 10, 11] and not suffix_dedup.strip_repeats(none).count()


# --- 6 mixing ----------------------------------------------------------------------------------------------------

def naive_targets(sizes):
    """Reshare the excess by weight until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, capped = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in order if s not in capped]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_} if total else {}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        for s in over:
            capped[s] = 3.0 * sizes[s]
            left -= capped[s]


def test_targets_and_copies(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, rnd.randrange(0, 40)), "en", rnd.choice(["b", "b", "b", "b", "b", "a", "Z", "é", "c", None])) for i in range(900)]
    rows += [(1000 + i, "x " * 50, "en", "big") for i in range(300)]
    got = mixing.mix_counts(mixing.with_sizes(docs_of(spark, rows))).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    expect, by = naive_targets(sizes), {}
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - expect[s]) < 1e-6 * max(1, expect[s])
        assert r.taken in (int(r.target / r.source_size) * r.size, (int(r.target / r.source_size) + 1) * r.size) and r.taken <= 3 * r.size
        by[s] = by.get(s, 0) + r.taken
    assert all(abs(by[s] - expect[s]) < 0.2 * expect[s] for s in expect) and sum(expect.values()) == pytest.approx(sum(sizes.values()))
    emitted = Counter(r.doc_id for r in mixing.mix(docs_of(spark, rows)).collect())
    assert emitted == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mixing_edges(edge, none, spark):
    got = mixing.mix_counts(mixing.with_sizes(edge)).collect()
    assert len(got) == 14 and all(r.taken == 0 for r in got if r.size == 0)
    assert not mixing.mix(none).count()
    assert rows_of(mixing.mix_counts(mixing.with_sizes(docs_of(spark, [(1, "", "en", "a")]))), "target", "taken") == [(0.0, 0)]


# --- 7 and 9 classifiers -----------------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    d = documents(spark, "/root/testdata/sf0.01")
    got = language_id.predict(d, language_id.train(*language_id.training_sample(d))).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and np.mean([r.lang_pred == r.lang for r in held]) > 0.96
    assert np.mean([r.lang_pred == r.lang for r in held if r.accepted]) >= np.mean([r.lang_pred == r.lang for r in held])


def test_rare_languages_are_not_lost(spark, monkeypatch):
    """A few texts of one language among many of others are all drawn, learned and found again."""
    rnd = random.Random(31)
    words = {la: ["".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 8))) for _ in range(60)] for la, letters in (("aa", "abcdefg"), ("bb", "hijklmn"), ("cc", "opqrstu"))}
    langs = ["aa"] * 900 + ["bb"] * 900 + ["cc"] * 12
    rows = [(i, " ".join(rnd.choice(words[la]) for _ in range(30)), la, "a") for i, la in enumerate(langs)]
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 60)
    d = docs_of(spark, rows)
    pool = d.where(language_id.fold_of(F.col("doc_id")) != language_id.HELD_OUT)
    texts, labels, cost = language_id.training_sample(d)
    drawn = Counter(labels)
    assert drawn["cc"] == pool.where("lang = 'cc'").count() and 0 < max(drawn["aa"], drawn["bb"]) < 200
    for la in ("aa", "bb", "cc"):
        assert abs(sum(c for c, x in zip(cost, labels) if x == la) / pool.where(F.col("lang") == la).count() - 1) < 0.4
    got = language_id.predict(d, language_id.train(texts, labels, cost)).where("lang_pred = 'cc'").count()
    assert got == 12


def test_language_edges(spark, edge, none):
    model = language_id.train([b"the cat and the dog"] * 8 + ["der hund und die katze".encode()] * 8, ["en"] * 8 + ["de"] * 8)
    got = language_id.predict(edge, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 14 and all(by[i].lang_pred == "und" and by[i].score == 0.0 for i in (1, 2, 3, 11)) and by[None].held_out is False
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in got)
    assert language_id.train([], []) is None and not language_id.predict(none, model).count()
    assert {r.lang_pred for r in language_id.predict(edge, None).collect()} == {"und"}
    assert language_id.train([b"a"] * 3, ["en"] * 3).classes == ["en"]


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    texts, y, cost = toxicity.training_sample(d, labels)
    model = toxicity.train(toxicity.gram_sets(texts), y, cost)
    got = toxicity.predict(d, model).where("held_out").join(labels, "doc_id").collect()
    toxic = np.array([r.toxic for r in got])
    rank = np.argsort(np.argsort([r.score for r in got]))
    auc = (rank[toxic == 1].mean() - (toxic.sum() - 1) / 2) / (len(toxic) - toxic.sum())
    assert len(got) > 500 and auc > 0.97


def test_toxicity_edges(spark, edge, none):
    texts = [b"you idiot person", b"what an idiot", b"idiot again here", b"good day to all", b"nice weather now", b"we like trees"] * 4
    y = np.array([1, 1, 1, 0, 0, 0] * 4)
    model = toxicity.train(toxicity.gram_sets(texts), y, np.ones(len(y)))
    d = docs_of(spark, [(1, "such an idiot", "en", "a"), (2, "trees and weather", "en", "a"), (3, None, "en", "a"), (4, "", "en", "a")])
    by = {r.doc_id: r for r in toxicity.predict(d, model).collect()}
    assert by[1].score > by[2].score and by[3].score == by[4].score
    assert toxicity.predict(edge, model).count() == 14 and not toxicity.predict(none, model).count()
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    texts, y, cost = toxicity.training_sample(edge, no_labels)
    assert {r.predicted for r in toxicity.predict(edge, toxicity.train(toxicity.gram_sets(texts), y, cost)).collect()} == {0}


# --- 8 packing ---------------------------------------------------------------------------------------------------

def test_boundaries_are_optimal():
    from itertools import combinations
    rng = np.random.default_rng(2)
    for _ in range(20):
        x = np.sort(rng.choice(np.arange(1, 60), 9, replace=False))
        c = rng.integers(1, 20, 9)
        cost = lambda b: sum(int(n) * (min(v for v in b if v >= l) - int(l)) for l, n in zip(x, c))  # noqa: E731, B023
        got = packing.optimal_boundaries(x, c, 3)
        assert len(got) <= 3 and got[-1] == x[-1]
        assert cost(got) == min(cost([*b, x[-1]]) for b in combinations(x[:-1], 2))
    assert packing.optimal_boundaries(np.array([5, 3]), np.array([1, 1]), 4) == [3, 5]


def test_packing_covers_every_token(spark, edge, none):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randrange(0, 900)), "en", "a") for i in range(200)] + [(500, prose(rnd, 5000), "en", "a"), (501, None, "en", "a")]
    got = packing.pack(docs_of(spark, rows)).collect()
    total = Counter()
    for r in got:
        assert 0 < r.n_tokens <= r.padded <= packing.MAX_LEN and r.first_token == r.segment * packing.MAX_LEN
        total[r.doc_id] += r.n_tokens
    assert total == Counter({i: n for i, t, _, _ in rows if (n := len((t or "").split()))})
    load = Counter((r.bucket, r.padded, r.batch) for r in got)
    for (bucket, padded, batch), n in load.items():
        full = max(1, packing.TOKEN_BUDGET // padded)
        assert n == full if (bucket, padded, batch + 1) in load else n <= full
    assert packing.pack(edge).count() >= 10 and not packing.pack(none).count()


# --- 10 token counts ---------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def counter():
    with open(token_counts.VOCABULARY, "rb") as f:
        return token_counts.Counter(f.read())


def test_counts_follow_edits(counter):
    rnd = random.Random(7)
    bits = ["'", " ", "l", "s", "\n", "  ", "word", "12", "!", "é", "ve", "\t", "'ll", "　", "a b c d e " * 60]
    for text in [prose(rnd, 300), "", " ", "don't we'll", "a" * 300, "  \n\n  x", "é" * 90, "The end. " * 200]:
        tree = token_counts.TokenTree(text, counter)
        for _ in range(40):
            at, gone = rnd.randint(0, len(text) + 2), rnd.choice([0, 0, 1, 2, 5, 40])
            new = "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 2, 5])))
            at = min(at, len(text))
            text = text[:at] + new + text[at + gone:]
            tree.edit(at, gone, new)
            assert tree.text == text and tree.total == counter.whole(text) and tree.chars[1] == len(text)


def test_small_edit_encodes_little(counter):
    text = prose(random.Random(1), 5000)
    tree = token_counts.TokenTree(text, counter)
    tree.edit(9000, 3, "new")
    assert tree.encoded < 12 and tree.total == counter.whole(tree.text)


def test_token_query_matches_full_encoding(spark, counter):
    d = token_counts.sample_edits(documents(spark, SF))
    got = {r.doc_id: r for r in token_counts.count_with_edits(d).collect()}
    for r in d.collect():
        text = r.text
        assert got[r.doc_id].n_tokens == counter.whole(text)
        for e in r.edits:
            text = text[: e.start] + e.replacement + text[e.start + e.length:]
        assert (got[r.doc_id].edited_tokens, got[r.doc_id].edited_chars) == (counter.whole(text), len(text))


def test_token_edges(spark, edge, none):
    got = token_counts.count_with_edits(token_counts.sample_edits(edge)).collect()
    assert len(got) == 14 and all(r.n_tokens == 0 for r in got if r.doc_id in (1, 2))
    assert not token_counts.count_with_edits(token_counts.sample_edits(none)).count()
    null_edits = edge.select("doc_id", "text", F.lit(None).cast("array<struct<start:int,length:int,replacement:string>>").alias("edits"))
    assert all(r.n_tokens == r.edited_tokens and r.encoded_pieces == 0 for r in token_counts.count_with_edits(null_edits).collect())
