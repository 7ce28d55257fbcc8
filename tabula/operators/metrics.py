"""Scoring and evaluation (E1-E6) over a long scored table ``(keys..., label, prediction, score)``.

All models are evaluated in one grouped pass keyed by ``(model, method, ...)``. ROC / AUC are exact:
rows are first collapsed to distinct scores (partial aggregation absorbs hot values), then a range
partition on (key, score) deals them to buckets of about ``ROWS_PER_BUCKET`` rows, as many as the data
need; running counts come from windows per (key, bucket) plus the counts of the buckets before, so no
key's whole score range is sorted in one task, however narrow that range is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabula.functions.expr import qcol
from tabula.session import materialize

ROWS_PER_BUCKET = 200_000  # distinct (key, score) rows of a bucket, about


# ---------------------------------------------------------------- E1

def batch_score(model, df: DataFrame, prob_col: str = "probability", out_score: str = "score") -> DataFrame:
    """Predicted class and positive-class probability from a fitted ``pyspark.ml`` model."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    return scored.withColumn(out_score, vector_to_array(F.col(prob_col))[1]) \
        .withColumn("prediction", F.col("prediction").cast("int"))


# ---------------------------------------------------------------- E2 / E5

def per_class(df: DataFrame, keys: Sequence[str] = (), label: str = "label", prediction: str = "prediction",
              count_col: str | None = None) -> DataFrame:
    """(keys..., class, tp, support, predicted, precision, recall, f1); empty denominators -> 0.

    ``count_col``: the input is already aggregated and this column holds each row's multiplicity.
    """
    keys = list(keys)
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    cm = df.groupBy(*keys, qcol(label).alias("__l"), qcol(prediction).alias("__p")).agg(n.alias("count")).persist()
    sup = cm.groupBy(*keys, F.col("__l").alias("class")).agg(
        F.sum("count").alias("support"), F.sum(F.when(F.col("__l") == F.col("__p"), F.col("count")).otherwise(0)).alias("tp"))
    prd = cm.groupBy(*keys, F.col("__p").alias("class")).agg(F.sum("count").alias("predicted"))
    pc = sup.join(prd, keys + ["class"], "full").fillna(0, ["support", "tp", "predicted"])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    pc = pc.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return pc.withColumn("f1", f1).select(*keys, "class", F.col("tp").cast("long").alias("tp"),
                                          F.col("support").cast("long").alias("support"),
                                          F.col("predicted").cast("long").alias("predicted"), "precision", "recall", "f1")


def weighted_prf(df: DataFrame, keys: Sequence[str] = (), label: str = "label", prediction: str = "prediction",
                 count_col: str | None = None) -> DataFrame:
    """Support-weighted precision / recall / F1 per key."""
    pc = per_class(df, keys, label, prediction, count_col)
    s = F.sum("support")
    return pc.groupBy(*keys).agg(
        (F.sum(F.col("support") * F.col("precision")) / s).alias("precision"),
        (F.sum(F.col("support") * F.col("recall")) / s).alias("recall"),
        (F.sum(F.col("support") * F.col("f1")) / s).alias("f1"),
    )


def classification_report(df: DataFrame, keys: Sequence[str] = (), label: str = "label",
                          prediction: str = "prediction", include_accuracy: bool = True) -> DataFrame:
    """Per-class rows plus accuracy, macro avg and weighted avg: (keys..., class, precision, recall, f1, support)."""
    keys = list(keys)
    pc = per_class(df, keys, label, prediction).persist()  # tiny (keys x classes), read four times
    rows = pc.select(*keys, F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    tot = F.sum("support")
    macro = pc.groupBy(*keys).agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support"))
    weighted = pc.groupBy(*keys).agg(F.lit("weighted avg").alias("class"),
                                     (F.sum(F.col("support") * F.col("precision")) / tot).alias("precision"),
                                     (F.sum(F.col("support") * F.col("recall")) / tot).alias("recall"),
                                     (F.sum(F.col("support") * F.col("f1")) / tot).alias("f1"), tot.alias("support"))
    out = rows.unionByName(macro).unionByName(weighted)
    if include_accuracy:
        acc = pc.groupBy(*keys).agg(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                                    F.lit(None).cast("double").alias("recall"), (F.sum("tp") / tot).alias("f1"),
                                    tot.alias("support"))
        out = out.unionByName(acc)
    return out.withColumn("support", F.col("support").cast("long"))


# ---------------------------------------------------------------- E3 / E4

def score_cumulative(df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score",
                     rows_per_bucket: int = ROWS_PER_BUCKET, count_col: str | None = None) -> DataFrame:
    """Per key and distinct score: pos, neg and the running counts tp / fp of rows with score >= s.

    Also P / N totals per key and the bucket id ``b``, which falls as scores rise. The distinct scores are written
    with their bucket to the shared folder: bounds are sampled once, and every reader sees the same buckets."""
    keys = list(keys)
    w = F.col(count_col).cast("long") if count_col else F.lit(1).cast("long")
    d = materialize(df.groupBy(*keys, qcol(score).cast("double").alias("s")).agg(
        F.sum(F.when(qcol(label) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(qcol(label) != 1, w).otherwise(0)).alias("neg")), "scores")
    buckets = -(-d.count() // rows_per_bucket)
    if buckets > 1:
        d = materialize(d.repartitionByRange(buckets, *keys, F.col("s").desc()).withColumn("b", F.spark_partition_id()),
                        "score-buckets")
    else:
        d = d.withColumn("b", F.lit(0))
    wb = Window.partitionBy(*keys, "b").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    bt = d.groupBy(*keys, "b").agg(F.sum("pos").alias("pb"), F.sum("neg").alias("nb"))
    wk = Window.partitionBy(*keys).orderBy("b")
    bt = (bt.withColumn("tp_off", F.coalesce(F.sum("pb").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("fp_off", F.coalesce(F.sum("nb").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("P", F.sum("pb").over(Window.partitionBy(*keys)))
            .withColumn("N", F.sum("nb").over(Window.partitionBy(*keys))))
    d = d.withColumn("tp_in", F.sum("pos").over(wb)).withColumn("fp_in", F.sum("neg").over(wb))
    at = [*keys, "b"]
    bt = bt.select(*[F.col(k).alias(f"__{k}") for k in at], "tp_off", "fp_off", "P", "N")
    j = d.join(bt, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in at])
    return j.select(*at, "s", "pos", "neg", (F.col("tp_in") + F.col("tp_off")).alias("tp"),
                    (F.col("fp_in") + F.col("fp_off")).alias("fp"), "P", "N")


def roc_auc(df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score",
            rows_per_bucket: int = ROWS_PER_BUCKET, count_col: str | None = None) -> DataFrame:
    """Exact ROC AUC per key (ties count ½); null when only one class is present."""
    keys = list(keys)
    c = score_cumulative(df, keys, label, score, rows_per_bucket, count_col)
    num = F.col("pos") * (F.col("N") - F.col("fp") + 0.5 * F.col("neg"))
    agg = c.groupBy(*keys).agg(F.sum(num).alias("num"), F.first("P").alias("P"), F.first("N").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("num") / (F.col("P") * F.col("N")))
    return agg.select(*keys, auc.alias("roc_auc"))


def roc_curve(df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score",
              drop_intermediate: bool = True, rows_per_bucket: int = ROWS_PER_BUCKET, count_col: str | None = None) -> DataFrame:
    """ROC points (keys..., threshold, fpr, tpr) from (0, 0); collinear interior points dropped.

    Neighbours for the collinearity test come from the same bucket window, or from the edge rows of
    the adjacent non-empty bucket (a small per-bucket table).
    """
    keys = list(keys)
    c = score_cumulative(df, keys, label, score, rows_per_bucket, count_col)
    if drop_intermediate:
        wb = Window.partitionBy(*keys, "b").orderBy(F.col("s").desc())
        c = (c.withColumn("ltp", F.lag("tp").over(wb)).withColumn("lfp", F.lag("fp").over(wb))
              .withColumn("ntp", F.lead("tp").over(wb)).withColumn("nfp", F.lead("fp").over(wb)))
        edge = c.groupBy(*keys, "b").agg(
            F.max_by(F.struct("tp", "fp"), "s").alias("first"), F.min_by(F.struct("tp", "fp"), "s").alias("last"))
        wk = Window.partitionBy(*keys).orderBy("b")
        at = [*keys, "b"]
        edge = edge.select(*[F.col(k).alias(f"__{k}") for k in at], F.lag("last").over(wk).alias("prev_last"), F.lead("first").over(wk).alias("next_first"))
        c = c.join(edge, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in at])
        ltp = F.coalesce(F.col("ltp"), F.col("prev_last.tp"))
        lfp = F.coalesce(F.col("lfp"), F.col("prev_last.fp"))
        ntp = F.coalesce(F.col("ntp"), F.col("next_first.tp"))
        nfp = F.coalesce(F.col("nfp"), F.col("next_first.fp"))
        keep = (ltp.isNull() | ntp.isNull() | ((ntp - 2 * F.col("tp") + ltp) != 0) | ((nfp - 2 * F.col("fp") + lfp) != 0))
        c = c.where(keep)
    pts = c.select(*keys, F.col("s").alias("threshold"),
                   F.when(F.col("N") > 0, F.col("fp") / F.col("N")).alias("fpr"),
                   F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("tpr"))
    origin = pts.select(*keys).distinct().select(*keys, F.lit(None).cast("double").alias("threshold"),
                                                 F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


# ---------------------------------------------------------------- E6

def evaluate_models(scored: DataFrame, keys: Sequence[str] = ("model", "method"), label: str = "label",
                    prediction: str = "prediction", score: str = "score") -> DataFrame:
    """Weighted precision / recall / F1 and exact AUC for every key in one pass over the scored table."""
    keys = list(keys)
    # one pass over the scored rows: everything else runs on (key, label, prediction, score) counts
    agg = scored.groupBy(*keys, qcol(label).alias(label), qcol(prediction).alias(prediction),
                         qcol(score).alias(score)).agg(F.count(F.lit(1)).alias("__n")).persist()
    prf = weighted_prf(agg, keys, label, prediction, count_col="__n")
    auc = roc_auc(agg, keys, label, score, count_col="__n")
    return prf.join(auc, keys, "left")
