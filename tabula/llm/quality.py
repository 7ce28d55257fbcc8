"""Quality rules whose thresholds come from the data.

Every document gets five measures in one scan (``base_stats``). Four rates of the documents that pass the
base rule are sketched per (language, source): a log-linear histogram with 32 sub-buckets per power of two,
so a quantile is off by at most 1/32 of its value. Sketches merge by adding counts; a group with too few
documents uses the merged sketch of its language, then of the whole corpus. A rate is accepted within
``FENCE`` spreads of the quartiles, a spread being the interquartile range but at least ``SLACK`` (a sketch
of equal values would reject every other value). The verdict comes from joining documents to thresholds.

Defined cases: null or empty text has zero words and fails the base rule; null language or source is a
group of its own; duplicate rows are judged one by one; where no document passes the base rule there are
no thresholds and none is needed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabula.llm.common import arrow_pass, BLANKS, DOC_COLUMNS, documents, register, small
from tabula.session import materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_GROUP = 100  # documents a sketch needs before its own quartiles are used
FENCE = 3
#: measure -> smallest spread (per mille; mean word length in hundredths of a code point)
SLACK = {"symbols": 50, "word_length": 50, "dup_lines": 100, "repeats": 75}
LOWER = ("word_length",)  # measures that also have a lower fence

STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(words, their code points, symbols, duplicate lines, words in repeated 3-word windows, lines with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, reach = Counter(windows), 0  # reach: end of the words already counted
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated, len(lines))


def base_stats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per document with the measures (and its text and n_chars); one scan, no shuffle."""
    schema = STATS + ", text string, n_chars long" * keep_text
    carried = ["text", "n_chars"] * keep_text
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(t.as_py()) for t in b.column("text")]
            cols = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *cols, *[b.column(c) for c in carried]], names)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"),
                         *[F.col("n_chars").cast("long")] * keep_text)
    return arrow_pass(narrow, run, schema)


def bucket(v: Column) -> Column:
    """Lower edge of the sketch bucket of a non-negative integer: exact below 64, then six leading bits."""
    drop = F.greatest(F.length(F.bin(v)) - 6, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def rates(s: DataFrame) -> DataFrame:
    per = lambda x, of, by: F.floor(F.col(x) * by / F.greatest(F.col(of), F.lit(1))).cast("long")
    return s.select("*", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
                    F.struct(per("n_symbols", "word_chars", 1000).alias("symbols"), per("word_chars", "n_words", 100).alias("word_length"),
                             per("n_dup_lines", "n_lines", 1000).alias("dup_lines"), per("n_repeat_words", "n_words", 1000).alias("repeats")).alias("rate"))


def sketch(rated: DataFrame) -> DataFrame:
    """(lang, source, measure, edge, n): the mergeable sketches of all groups, at most some hundred rows a group."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(f"rate.{m}")).alias("edge")) for m in SLACK])
    return (rated.where(~F.col("base_failed")).select("lang", "source", F.inline(cells))
            .groupBy("lang", "source", "measure", "edge").agg(F.count("*").alias("n")))


def fences(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and measure: documents, lower and upper fence from the merged sketch."""
    merged = cells.groupBy(*keys, "measure", "edge").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "measure")
    ranked = merged.select("*", F.sum("n").over(by.orderBy("edge").rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(by).alias("size"))
    quarter = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("size") * k, F.col("edge")))
    slack = F.element_at(F.create_map(*[x for m, v in SLACK.items() for x in (F.lit(m), F.lit(v))]), F.col("measure"))
    spread = F.greatest(F.col("q3") - F.col("q1"), slack)
    return (ranked.groupBy(*keys, "measure").agg(F.max("size").alias("size"), quarter(1).alias("q1"), quarter(3).alias("q3"))
            .select(*keys, "measure", "size", (F.col("q1") - FENCE * spread).alias("low"), (F.col("q3") + FENCE * spread).alias("high")))


def thresholds(cells: DataFrame) -> DataFrame:
    """(lang, source) -> fences of every measure, from the narrowest sketch with ``MIN_GROUP`` documents."""
    own, of_lang = fences(cells, ["lang", "source"]), fences(cells, ["lang"])
    whole = fences(cells.withColumn("lang", F.lit("")), ["lang"]).drop("lang")
    wide = lambda d, p: d.select(*[c for c in d.columns if c not in ("size", "low", "high")], F.struct("size", "low", "high").alias(p))
    lang = wide(of_lang, "b").select(F.col("lang").alias("l"), F.col("measure").alias("m"), "b")
    total = wide(whole, "c").select(F.col("measure").alias("m2"), "c")
    best = F.when(F.col("a.size") >= MIN_GROUP, F.col("a")).when(F.col("b.size") >= MIN_GROUP, F.col("b")).otherwise(F.col("c"))
    joined = (wide(own, "a").join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m")), "left")
              .join(total, F.col("measure") == F.col("m2"), "left").select("lang", "source", "measure", best.alias("t")))
    pick = lambda m, end: F.max(F.when(F.col("measure") == m, F.col(f"t.{end}"))).alias(f"{m}_{end}")
    return joined.groupBy("lang", "source").agg(*[pick(m, e) for m in SLACK for e in ("low", "high")])


def verdict(rated: DataFrame, limits: DataFrame) -> DataFrame:
    """Joins the rated documents to their group's fences (a row per language and source) and adds ``kept``."""
    limits = limits.withColumnsRenamed({"lang": "l", "source": "s"})
    ok = F.lit(True)
    for m in SLACK:
        ok = ok & F.coalesce(F.col(f"rate.{m}") <= F.col(f"{m}_high"), F.lit(True))
        if m in LOWER:
            ok = ok & F.coalesce(F.col(f"rate.{m}") >= F.col(f"{m}_low"), F.lit(True))
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ok)


def judge(docs: DataFrame) -> DataFrame:
    """Per document: the measures, ``base_failed`` and ``kept``. Statistics go to a shared scratch table, since both
    the sketches and the final join read them."""
    rated = rates(materialize(base_stats(docs), "quality"))
    return verdict(rated, thresholds(sketch(rated))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that pass. Texts are scanned twice (sketches, then the filter) rather than shuffled: the fences are
    written out and counted, and broadcast while they are few."""
    limits = materialize(thresholds(sketch(rates(base_stats(docs)))), "fences")
    return verdict(rates(base_stats(docs, keep_text=True)), small(limits)).where("kept").select(*DOC_COLUMNS)


ORACLE = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM tri, (VALUES (0), (1), (2)) t(k) WHERE c > 1 GROUP BY doc_id),
s AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbols,
        100 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM s),
m AS (SELECT lang, source, measure, v FROM (SELECT lang, source, symbols, word_length, dup_lines, repeats FROM r WHERE NOT base_failed)
      UNPIVOT (v FOR measure IN (symbols, word_length, dup_lines, repeats))),
e AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS edge FROM m),
lv AS (SELECT 1 AS level, lang, source, measure, edge FROM e UNION ALL SELECT 2, lang, NULL, measure, edge FROM e UNION ALL SELECT 3, NULL, NULL, measure, edge FROM e),
c AS (SELECT level, lang, source, measure, edge, count(*) AS n FROM lv GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY edge) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS size FROM c),
q AS (SELECT level, lang, source, measure, max(size) AS size, min(edge) FILTER (upto * 4 >= size) AS q1, min(edge) FILTER (upto * 4 >= size * 3) AS q3 FROM u GROUP BY ALL),
f AS (SELECT *, greatest(q3 - q1, CASE measure WHEN 'symbols' THEN 50 WHEN 'word_length' THEN 50 WHEN 'dup_lines' THEN 100 ELSE 75 END) AS spread FROM q),
t AS (SELECT a.lang, a.source, a.measure, CASE WHEN a.size >= 100 THEN a.q1 - 3 * a.spread WHEN b.size >= 100 THEN b.q1 - 3 * b.spread ELSE g.q1 - 3 * g.spread END AS low,
        CASE WHEN a.size >= 100 THEN a.q3 + 3 * a.spread WHEN b.size >= 100 THEN b.q3 + 3 * b.spread ELSE g.q3 + 3 * g.spread END AS high
      FROM f a JOIN f b ON a.level = 1 AND b.level = 2 AND a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure JOIN f g ON g.level = 3 AND g.measure = a.measure),
bad AS (SELECT DISTINCT r.doc_id FROM r JOIN t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source
        WHERE CASE measure WHEN 'symbols' THEN symbols WHEN 'word_length' THEN word_length WHEN 'dup_lines' THEN dup_lines ELSE repeats END > high
           OR (measure = 'word_length' AND word_length < low))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM r
"""


@register("op1_quality_rules", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive quality verdict of every document."""
    return judge(documents(spark, sf_dir))
