"""Filter interaction audit: what every order of a set of filters keeps, removes and loses, from one pass over the texts.

A document fails a subset of the filters, its mask. The mask alone decides what happens to the document at every step of
every order, so each mask (with its label flags) is mapped to one wide integer whose 64-bit fields hold the outcomes of
all orders and steps: five filters have 120 orders and 600 steps. Tasks add these integers per part, their sums are added
in two levels, and the totals are unpacked. A field counts documents, so 64 bits cannot carry into the next field.

Texts are compared by a 128-bit digest. The least id of each digest is found by a grouped minimum (combined before the
shuffle) and joined back; copies of one text are split by the skew handling of the join.

Defined cases: null text is empty; null source is the part ''; a null id is no smaller id than any, and has none before
it; rows with one id and text are not copies of each other, because neither id is smaller; several label rows of one id
count as one that has every flag any of them has; no label means neither flag; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabula.llm.common import documents, register
from tabula.session import materialize

FILTERS = "ABCDE"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
GOOD, TOXIC = 1, 2  # label flags
MIN_WORDS = 200
MIN_DISTINCT = 50   # percent of the words
MAX_CAPITALS = 2    # percent of the code points
MARKS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PIECE = 1 << 20     # bytes of a long text that are split into words at once
HELD = 1000         # parts whose totals a task holds before it hands them on
SLICES = 32         # first-level sums of a part
BLANK = frozenset(b" \t\n\x0b\f\r")


def word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, at most about ``PIECE`` bytes at a time."""
    start = 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and data[end] not in BLANK:
            end += 1
        yield data[start:end].split()
        start = end


def failures(text: str | None) -> tuple[int, bytes]:
    """Bits of the failing filters A to D, and the text's digest."""
    text = text or ""
    data = text.encode()
    n, distinct = 0, set()
    for words in word_lists(data):
        n += len(words)
        distinct.update(words)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    marks = len(data) - len(data.translate(None, MARKS))
    mask = (n < MIN_WORDS) | (100 * len(distinct) < MIN_DISTINCT * n) << 1 | (100 * capitals > MAX_CAPITALS * len(text)) << 2 | (marks > 0) << 3
    return mask, hashlib.blake2b(data, digest_size=16).digest()


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of the text's own filters, digest."""
    schema = "doc_id long, part string, mask int, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [failures(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array([m for m, _ in found], pa.int32()),
                                                  pa.array([d for _, d in found], pa.binary())], ["doc_id", "part", "mask", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """Sets ``bit`` where the digest also belongs to a smaller id."""
    least = (rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
             .where(F.col("least") < F.col("most")).select(F.col("digest").alias("d"), "least"))
    return (rows.join(least, F.col("digest") == F.col("d"), "left")
            .withColumn("mask", F.when(F.col("doc_id") > F.col("least"), F.col("mask").bitwiseOR(F.lit(1 << bit))).otherwise(F.col("mask")))
            .drop("d", "least", "digest"))


def with_flags(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``flags``: GOOD for a row labelled quality 1, TOXIC for toxic 1."""
    on = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg((on("quality") * GOOD + on("toxic") * TOXIC).cast("int").alias("flags"))
    return rows.join(known, F.col("doc_id") == F.col("id"), "left").withColumn("flags", F.coalesce("flags", F.lit(0))).drop("id")


def outcome_fields(mask: int, flags: int, filters: str) -> np.ndarray:
    """One document's outcomes: a 0 or 1 for each outcome, order and step."""
    out = np.zeros((len(OUTCOMES), len(list(permutations(filters))), len(filters)), "<u8")
    for o, order in enumerate(permutations(range(len(filters)))):
        alive = True
        for s, f in enumerate(order):
            fails = bool(mask >> f & 1)
            removed = alive and fails
            alive = alive and not fails
            out[:, o, s] = alive, removed, fails and not removed, mask == 1 << f, removed and flags & GOOD, bool(removed and flags & TOXIC)
    return out


def wide_integers(filters: str) -> dict[tuple[int, int], int]:
    """(mask, flags) -> the integer whose 64-bit fields are the outcomes."""
    return {(m, g): int.from_bytes(outcome_fields(m, g, filters).tobytes(), "little") for m in range(1 << len(filters)) for g in range(4)}


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``rows``: part, mask, flags (a row per document). A row per part, order of the filters and step."""
    orders = ["".join(p) for p in permutations(filters)]
    shape = (len(OUTCOMES), len(orders), len(filters))
    width = 8 * shape[0] * shape[1] * shape[2]
    table = rows.sparkSession.sparkContext.broadcast(wide_integers(filters))  # 2^filters * 4 integers

    def batch_of(totals: dict, *more: pa.Array) -> pa.RecordBatch:
        keys = list(totals)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([v.to_bytes(width, "little") for v in totals.values()], pa.binary())], ["part", "slice", "total"])

    def add_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big, where, totals = table.value, TaskContext.get().partitionId() % SLICES, {}
        for b in batches:
            cells = pa.Table.from_batches([b]).group_by(["part", "mask", "flags"]).aggregate([([], "count_all")]).to_pylist()
            for c in cells:
                key = (c["part"], where)
                totals[key] = totals.get(key, 0) + c["count_all"] * big[c["mask"], c["flags"]]
                if len(totals) >= HELD:
                    yield batch_of(totals)
                    totals = {}
        if totals:
            yield batch_of(totals)

    def add_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by their key: one running sum."""
        key, total = None, 0
        for b in batches:
            for p, s, t in zip(b.column("part").to_pylist(), b.column("slice").to_pylist(), b.column("total")):
                if (p, s) != key:
                    if key is not None:
                        yield batch_of({key: total})
                    key, total = (p, s), 0
                total += int.from_bytes(t.as_buffer(), "little")
        if key is not None:
            yield batch_of({key: total})

    names = ["part", "filter_order", "step", *OUTCOMES, "shapley"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.array([[filters.index(c) for c in o] for o in orders])
        for b in batches:
            for p, t in zip(b.column("part").to_pylist(), b.column("total")):
                fields = np.frombuffer(t.as_buffer(), "<u8").reshape(shape).astype(np.int64)
                removed = fields[OUTCOMES.index("removed")]
                shapley = np.array([removed[index == f].sum() for f in range(len(filters))])[index]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * index.size, pa.string()), pa.array(np.repeat(orders, len(filters)), pa.string()), pa.array(np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(orders))),
                     *[pa.array(f.ravel()) for f in fields], pa.array(shapley.ravel())], names)

    sums = "part string, slice int, total binary"
    first = rows.select("part", "mask", "flags").mapInArrow(add_documents, sums)
    second = first.repartition("part", "slice").sortWithinPartitions("part", "slice").mapInArrow(add_totals, sums)
    third = second.withColumn("slice", F.lit(0)).repartition("part").sortWithinPartitions("part").mapInArrow(add_totals, sums)
    return third.mapInArrow(unpack, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*OUTCOMES, "shapley"]))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part, concat(
        CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
h AS (SELECT part, fails, coalesce(q, 0) AS q, coalesce(x, 0) AS x, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS c, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, c, n, q, x, contains(fails, c) AS hit, length(translate(fails, before, '')) < length(fails) AS gone, fails = c AS only_this FROM h, s),
g AS (SELECT part, filter_order, step, c, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN only_this THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN n * q ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN hit AND NOT gone THEN n * x ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY part, filter_order, step, c)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM g
"""


@register("op12_filter_audit", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over every order of them, per source. The measured rows (small) are written once: the copies and
    the audit both read them."""
    rows = materialize(measured(documents(spark, sf_dir)), "measured")
    return audit(with_flags(with_copies(rows, FILTERS.index("E")), spark.read.parquet(f"{sf_dir}/labels.parquet")))
