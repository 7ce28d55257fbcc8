"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

For sample k a term of weight w draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from hashes of (term, k), takes
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the sample is the term with the least a. Two weighted
term sets pick the same (term, t) with probability sum(min) / sum(max), their generalised Jaccard similarity.
The least ln a is itself a function of (term, t) alone, so a plain ``min`` per sample is the signature: it is
pre-aggregated in the map task, and no candidate rows are kept.

Neighbouring documents (``edited_pairs``) meet in buckets of consecutive ids cut at sketched quantiles; the first
document of a bucket is also a guest at the end of the bucket that precedes it in order. Texts are shuffled once;
term counting, sampling and the likeness of neighbours then run inside the buckets without another exchange.

Defined cases: null text is empty; an empty text has a fingerprint of its own (likeness 1 to another empty text,
0 to any other); rows with equal id are ordered by text; a null id counts as the smallest; a single document is
its own neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabula.llm.common import BLANK, documents, partitions, register

SAMPLES = 32
TASKS_PER_PARTITION = 4
BUCKETS_PER_TASK = 4
MAX_BUCKETS = 65_536  # cut points that one quantile sketch returns to the driver; beyond, buckets grow
NO_ID = -(1 << 63)


def sample_value(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of the term (a 64-bit hash) for sample ``k``; five uniforms from two hashes."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    part = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) / float(1 << bits)
    r = -F.log(part(one, 0, 21) * part(one, 21, 21))
    b = part(one, 42, 22)
    c = -F.log(part(two, 0, 32) * part(two, 32, 32))
    return F.log(c) - r * (F.floor(log_weight / r + b) - b + 1.0)


def fingerprints(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``terms``: keys, term (long hash, null for none), weight. Returns the keys and ``m0``..: the least ln a per sample."""
    with_log = terms.withColumn("lw", F.log(F.col("weight").cast("double")))
    return with_log.groupBy(*keys).agg(*[F.min(sample_value(F.col("term"), F.col("lw"), k)).alias(f"m{k}") for k in range(samples)])


def signature(values: list[Column]) -> Column:
    """32 bits per sample; a sample without a term (empty text) has a fixed value."""
    return F.array(*[F.xxhash64(v).bitwiseAND(F.lit(0xFFFFFFFF)) for v in values])


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / float(samples)


def words(text: Column) -> Column:
    return F.split(text, BLANK)


def bucketed(docs: DataFrame) -> DataFrame:
    """(bucket, guest, key, text): every document in its bucket of ids, bucket heads also as guests. ``key`` is the id
    (``NO_ID`` for null)."""
    spark = docs.sparkSession
    tasks = partitions(spark) * TASKS_PER_PARTITION
    n = min(MAX_BUCKETS, tasks * BUCKETS_PER_TASK)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    constant = lambda v, kind: F.split(F.lit(",".join(map(str, v))), ",").cast(f"array<{kind}>")  # noqa: E731  one literal, folded by the optimizer
    at = constant([i / n for i in range(1, n)] or [0.5], "double")
    cuts = sorted(set(d.agg(F.percentile_approx("key", at, 10 * n)).head()[0] or []))
    if cuts:
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
        bucket = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.try_element_at(constant(cuts, "bigint"), at + s) <= F.col("key")), at + s).otherwise(at))
    else:
        bucket = F.lit(0)
    d = d.withColumn("bucket", bucket)
    heads = {r.bucket: r.key for r in d.groupBy("bucket").agg(F.max("key").alias("key")).collect()}  # at most n rows
    filled = sorted(heads)
    host = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}
    head_of = constant([heads.get(b, NO_ID) for b in range(len(cuts) + 1)], "bigint")
    host_of = constant([host.get(b, -1) for b in range(len(cuts) + 1)], "int")
    home = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    visit = F.struct(F.element_at(host_of, F.col("bucket") + 1).alias("bucket"), F.lit(1).alias("guest"))
    places = F.when(F.col("key") == F.element_at(head_of, F.col("bucket") + 1), F.array(home, visit)).otherwise(F.array(home))
    return d.select("key", "text", F.inline(places)).repartition(tasks, "bucket")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Per document the texts' digests, both fingerprints and the two likenesses."""
    order = W.partitionBy("bucket").orderBy("guest", F.col("key").desc(), "text")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = (bucketed(docs).select("bucket", "guest", "key", "text", F.char_length("text").cast("long").alias("n_chars"),
                                  F.row_number().over(order).alias("rn"), F.lead("text", 1, "").over(order).alias("following")))
    edited = F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 3)))"), F.substring("following", F.lit(1), third))
    rows = rows.withColumn("edited", F.when(F.col("guest") == 0, edited).otherwise(F.lit("")))
    # one element per word of either text, and a marker that keeps a row for texts without words
    own, both = words(F.col("text")), F.concat(F.array(F.lit("")), words(F.col("text")), words(F.col("edited")))
    seen = (rows.select("bucket", "rn", F.size(own).alias("n_own"), both.alias("both"))  # split once a text, below the generator
            .select("bucket", "rn", "n_own", F.posexplode("both").alias("pos", "word"))
            .where("word != '' OR pos = 0")
            .select("bucket", "rn", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"),
                    ((F.col("pos") > 0) & (F.col("pos") <= F.col("n_own"))).cast("int").alias("a"), (F.col("pos") > F.col("n_own")).cast("int").alias("b")))
    counts = seen.groupBy("bucket", "rn", "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # side 0: weight in the text, 1: in the edited text, 2: the same weight in both, so it is sampled once
    entry = lambda w, side: F.struct(F.col(w).alias("weight"), F.lit(side).alias("side"))
    sides = F.when(F.col("a") == F.col("b"), F.array(entry("a", 2))).when(F.col("a") == 0, F.array(entry("b", 1))).when(F.col("b") == 0, F.array(entry("a", 0))).otherwise(F.array(entry("a", 0), entry("b", 1)))
    mins = fingerprints(counts.select("bucket", "rn", "term", F.inline(sides)), ["bucket", "rn", "side"])
    least = lambda k, side: F.min(F.when(F.col("side") != side, F.col(f"m{k}")))
    sigs = (mins.groupBy("bucket", "rn").agg(*[least(k, 1).alias(f"x{k}") for k in range(SAMPLES)], *[least(k, 0).alias(f"y{k}") for k in range(SAMPLES)])
            .select("bucket", "rn", signature([F.col(f"x{k}") for k in range(SAMPLES)]).alias("fp"), signature([F.col(f"y{k}") for k in range(SAMPLES)]).alias("efp")))
    after = F.lead("fp").over(W.partitionBy("bucket").orderBy("rn"))
    sigs = sigs.withColumn("after", after)
    meta = rows.where("guest = 0").select("bucket", "rn", F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return (meta.join(sigs, ["bucket", "rn"])
            .select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
                    likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("after")).alias("near_next")))


@register("op2_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return edited_pairs(documents(spark, sf_dir))
