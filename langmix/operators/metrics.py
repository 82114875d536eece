"""Token-, sentence- and span-level quality metrics.

Everything is derived from counts per (group, truth, prediction), which
partial aggregation leaves small: a model's metrics need one shuffle of a few
numbers per map task and group, and one more of a row per cell."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from langmix.functions.labels import IGNORE_INDEX

# --- Fixed values -----------------------------------------------------------
CLASSES = (0, 1, 2)
# -----------------------------------------------------------------------------


def _n(t: int, p: int) -> str:
    return f"n_{t}_{p}"


def confusion_counts(df: DataFrame, group: list[str], y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    """Wide confusion counts per group: ``n_<actual>_<predicted>``; rows
    with the ignore index are skipped."""
    valid = df.where(F.col(y_true) != IGNORE_INDEX)
    aggs = [F.sum(F.when((F.col(y_true) == t) & (F.col(y_pred) == p), 1).otherwise(0))
            .cast("long").alias(_n(t, p)) for t in CLASSES for p in CLASSES]
    return valid.groupBy(*group).agg(*aggs)


def confusion_long(wide: DataFrame, group: list[str]) -> DataFrame:
    """Long form ``(group, y_true, y_pred, n)`` with all nine cells."""
    cells = ", ".join(f"{t}, {p}, {_n(t, p)}" for t in CLASSES for p in CLASSES)
    return wide.select(*group, F.expr(f"stack({len(CLASSES) ** 2}, {cells}) as (y_true, y_pred, n)"))


def _div(a: Column, b: Column) -> Column:
    """Division with the zero-division rule: 0 when the denominator is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def cells(df: DataFrame, group: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Counts ``(group, t, p, n)`` of every pair that occurs, whatever the
    classes; rows with the ignore index are skipped, null truths kept."""
    valid = df.where(F.col(y_true).isNull() | (F.col(y_true) != IGNORE_INDEX))
    return valid.groupBy(*group, F.col(y_true).alias("t"), F.col(y_pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def prf(counts: DataFrame, group: list[str], average: str = "macro") -> DataFrame:
    """Accuracy and averaged precision/recall/F1 from :func:`cells`.

    ``n_tokens`` counts every token with a truth, in whatever class; a token
    predicted outside the truth's classes (or not at all) is wrong, not absent.
    Tokens without a truth can't be scored: ``n_null_truth`` counts them.
    ``macro``: unweighted mean over classes seen in truth or prediction.
    ``weighted``: mean weighted by true support. Per-class F1 is
    ``2 tp / (n_true + n_pred)``, 0 when undefined. No tokens -> NULL."""
    if average not in ("macro", "weighted"):
        raise ValueError(average)
    known = F.filter("c", lambda x: x["t"].isNotNull())
    per = counts.groupBy(*group).agg(
        F.collect_list(F.struct("t", "p", "n")).alias("c"),   # one element per pair of classes
        F.sum(F.when(F.col("t").isNotNull(), F.col("n")).otherwise(0)).alias("n_tokens"),
        F.sum(F.when(F.col("t").isNull(), F.col("n")).otherwise(0)).alias("n_null_truth"),
        F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("_correct"))
    per = per.withColumn("c", known)
    seen = F.array_sort(F.array_distinct(F.filter(
        F.flatten(F.transform("c", lambda x: F.array(x["t"], x["p"]))), lambda k: k.isNotNull())))

    def total(keep):
        return F.aggregate(F.filter("c", keep), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])

    per = per.withColumn("_k", F.transform(seen, lambda k: F.struct(
        total(lambda x: (x["t"] == k) & x["p"].eqNullSafe(k)).alias("tp"),
        total(lambda x: x["t"] == k).alias("nt"), total(lambda x: x["p"].eqNullSafe(k)).alias("np"))))
    weight = (lambda x: F.lit(1.0)) if average == "macro" else (lambda x: x["nt"].cast("double"))

    def mean(value):
        top = F.aggregate("_k", F.lit(0.0), lambda acc, x: acc + weight(x) * value(x))
        return top / F.aggregate("_k", F.lit(0.0), lambda acc, x: acc + weight(x))

    any_ = F.col("n_tokens") > 0
    return per.select(
        *group, "n_tokens", "n_null_truth", F.when(any_, F.col("_correct") / F.col("n_tokens")).alias("accuracy"),
        F.when(any_, mean(lambda x: _div(x["tp"], x["np"]))).alias("precision"),
        F.when(any_, mean(lambda x: _div(x["tp"], x["nt"]))).alias("recall"),
        F.when(any_, mean(lambda x: _div(2 * x["tp"], x["nt"] + x["np"]))).alias("f1"))


def sentence_prf(y_true, y_pred, ignore: int = IGNORE_INDEX) -> Column:
    """Accuracy and support-weighted precision, recall and F1 of one sentence,
    in the row: both label arrays are cut to the shorter one, pairs with the
    ignored truth are left out. Nulls without a pair."""
    t, p = (F.col(c) if isinstance(c, str) else c for c in (y_true, y_pred))
    n = F.least(F.size(t), F.size(p))
    pairs = F.filter(F.arrays_zip(F.slice(t, 1, n).alias("t"), F.slice(p, 1, n).alias("p")), lambda x: x["t"] != ignore)

    def count(keep):
        return F.size(F.filter(pairs, keep))

    total = F.size(pairs)
    seen = F.array_distinct(F.transform(pairs, lambda x: x["t"]))
    per = F.transform(seen, lambda k: F.struct(
        count(lambda x: (x["t"] == k) & (x["p"] == k)).alias("tp"), count(lambda x: x["t"] == k).alias("nt"),
        count(lambda x: x["p"] == k).alias("np")))

    def mean(value):
        return F.aggregate(per, F.lit(0.0), lambda acc, x: acc + x["nt"] * value(x)) / total

    out = F.struct((count(lambda x: x["t"] == x["p"]) / total).alias("accuracy"),
                   mean(lambda x: _div(x["tp"], x["np"])).alias("precision"),
                   mean(lambda x: _div(x["tp"], x["nt"])).alias("recall"),
                   mean(lambda x: _div(2 * x["tp"], x["nt"] + x["np"])).alias("f1"))
    return F.when(total > 0, out)


def spans(df: DataFrame, keys: list[str], pos: str, label: str) -> DataFrame:
    """Maximal runs of one non-O label inside a sentence, after dropping the
    ignore index; start/end are indexes in the kept sequence."""
    kept = df.where(F.col(label) != IGNORE_INDEX)
    w = Window.partitionBy(*keys).orderBy(pos)
    idx = kept.withColumn("_i", F.row_number().over(w))
    starts = idx.withColumn("_new", (~F.lag(label).over(w).eqNullSafe(F.col(label))).cast("int"))
    runs = starts.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (runs.where(F.col(label) != 0)
            .groupBy(*keys, "_run", F.col(label).alias("span_label"))
            .agg(F.min("_i").alias("start"), F.max("_i").alias("end"))
            .drop("_run"))


def runs(labels) -> Column:
    """Maximal runs of one non-O label in an array, in the row:
    ``array<struct<label, start, end>>`` (places from 1, both inclusive)."""
    x = F.col(labels) if isinstance(labels, str) else labels
    kind = "array<struct<label:int,start:int,end:int>>"
    begin = F.struct(F.array().cast(kind).alias("done"), F.lit(0).alias("label"), F.lit(0).alias("start"), F.lit(0).alias("at"))

    def close(acc):
        return F.when(acc["label"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(
            acc["label"].alias("label"), acc["start"].alias("start"), acc["at"].alias("end")))))

    def step(acc, y):
        y = F.coalesce(y.cast("int"), F.lit(0))   # no label is outside every span
        same = y == acc["label"]
        return F.struct(F.when(same, acc["done"]).otherwise(close(acc)).alias("done"), y.alias("label"),
                        F.when(same, acc["start"]).otherwise(acc["at"] + 1).alias("start"), (acc["at"] + 1).alias("at"))

    return F.aggregate(x, begin, step, close)


def span_prf(df: DataFrame, group: list[str], sentence: list[str], pos: str = "pos",
             y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Micro span precision/recall/F1 (exact sentence, start, end and label)
    plus token accuracy, per group. One exchange brings a sentence's tokens
    into one row, in which both sides' runs are folded and compared; counts
    per sentence are then added up."""
    valid = df.where(F.col(y_true) != IGNORE_INDEX)
    rows = valid.groupBy(*group, *sentence).agg(F.array_sort(F.collect_list(F.struct(
        F.col(pos).alias("pos"), F.col(y_true).cast("int").alias("t"), F.col(y_pred).cast("int").alias("p")))).alias("_r"))

    def side(k: str) -> Column:
        return runs(F.transform("_r", lambda x: x[k]))

    true, pred = side("t"), side("p")
    per = rows.select(*group, F.size("_r").alias("_n"), F.size(F.filter("_r", lambda x: x["t"] == x["p"])).alias("_same"),
                      true.alias("_t"), pred.alias("_p"))
    out = per.groupBy(*group).agg(
        F.sum(F.size("_t")).alias("n_true"), F.sum(F.size("_p")).alias("n_pred"),
        F.sum(F.size(F.array_intersect("_t", "_p"))).alias("tp"), F.sum("_n").alias("_n"), F.sum("_same").alias("_same"))
    return out.select(
        *group, F.col("n_true").cast("long"), F.col("n_pred").cast("long"), F.col("tp").cast("long"),
        _div(F.col("tp"), F.col("n_pred")).alias("precision"),
        _div(F.col("tp"), F.col("n_true")).alias("recall"),
        _div(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")).alias("f1"),
        (F.col("_same") / F.col("_n")).alias("accuracy"))


def model_comparison(macro: DataFrame, n_models: int, model: str = "model") -> DataFrame:
    """Macro F1 in percent per model and whether every expected model
    produced a result (the reference charts only then)."""
    everyone = Window.partitionBy(F.lit(1))  # one row per model: bounded
    return macro.select(model, (F.col("f1") * 100).alias("f1_pct"), "accuracy",
                        (F.count(F.lit(1)).over(everyone) == n_models).alias("all_present"))


def best_by(log: DataFrame, group: list[str], step: str = "step", metric: str = "f1") -> DataFrame:
    """Best checkpoint per group: highest metric, earliest step on ties."""
    best = log.groupBy(*group).agg(
        F.min(F.struct((-F.col(metric)).alias("neg"), F.col(step).alias("step"))).alias("_b"))
    return best.select(*group, F.col("_b.step").alias("best_step"), (-F.col("_b.neg")).alias("best_f1"))


def pair_sequences(df: DataFrame, keys: list[str], truth: str, pred: str, mode: str = "positional",
                   truth_tokens: str | None = None) -> DataFrame:
    """Sentence pairing: both label arrays cut to the shorter length, then
    one row per position (``y_true``, ``y_pred``).

    ``mode="positional"`` pairs as the reference does. Predictions come from
    the normalized text, in which punctuation/digit tokens vanish, so
    ``mode="aligned"`` first drops the truth labels whose own token
    (``truth_tokens``) normalizes to nothing."""
    if mode == "aligned":
        from langmix.functions.text import normalizes_to_text

        z = F.filter(F.arrays_zip(F.col(truth_tokens).alias("t"), F.col(truth).alias("y")),
                     lambda e: normalizes_to_text(e["t"]))
        df = df.withColumn(truth, F.transform(z, lambda e: e["y"]))
    elif mode != "positional":
        raise ValueError(mode)
    n = F.least(F.size(truth), F.size(pred))
    z = F.arrays_zip(F.slice(truth, 1, n).alias("y_true"), F.slice(pred, 1, n).alias("y_pred"))
    return df.select(*keys, F.posexplode(z).alias("pos", "_z")).select(
        *keys, "pos", F.col("_z.y_true").alias("y_true"), F.col("_z.y_pred").alias("y_pred"))


SIDE_BUCKETS = 64


def store_side(df: DataFrame, key: str, path: str, buckets: int = SIDE_BUCKETS) -> str:
    """Write one side of a pairing (predictions or truths) as a table in
    sorted buckets by ``key``, its files at ``path``; its name in the catalog."""
    name = f"side_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return name


def pair_stored(truths: str, preds: str, key: str, group: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Weighted metrics per group of two stored sides with equal buckets: a
    sentence's truth and predictions meet where they lie, without an exchange,
    and are counted in the row. Predictions of a sentence without a truth are
    counted in ``n_no_truth`` and measured nowhere."""
    spark = SparkSession.active()
    t, p = spark.table(truths).select(key, truth), spark.table(preds).select(key, group, pred)
    both = p.hint("merge").join(t, key, "left")
    missing = both.withColumn("_none", F.col(truth).isNull())
    pairs = pair_sequences(missing.withColumn(truth, F.coalesce(truth, F.array().cast(t.schema[truth].dataType))),
                           [group], truth, pred)
    found = prf(cells(pairs, [group]), [group], "weighted")
    counts = missing.groupBy(group).agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if("_none").alias("n_no_truth"))
    return counts.join(found, group, "left")
