"""Reproducible sampling and splitting by seeded hash.

``randomSplit``/``rand`` depend on partitioning and are avoided. A row's
hash ``md5(id ':' seed)`` fixes its place in a virtual shuffle; the k
smallest hashes are selected without a global sort: a histogram over the
first four hex digits (at most 65,536 rows -- a proven bound) finds the one
bucket that straddles k, and only that bucket is ranked."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX_DIGITS = 4


def seeded_hash(cols, seed) -> F.Column:
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def hash_select(df: DataFrame, id_cols: list[str], k: int, seed, flag: str = "selected",
                materialize_input: bool = False) -> DataFrame:
    """Add boolean ``flag``: the row is among the ``k`` smallest
    ``(hash, ids)``. Ties on the hash are broken by the ids.

    The input is read by the histogram job and by the two selection
    branches; pass ``materialize_input=True`` when it is an expensive plan
    (it is then checkpointed once instead of being recomputed)."""
    if materialize_input:
        from langmix.session import stored
        df = stored(df)
    h = seeded_hash(id_cols, seed)
    hashed = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, BUCKET_HEX_DIGITS))
    hist = sorted((r["_b"], r["count"]) for r in hashed.groupBy("_b").count().collect())
    cum = 0
    boundary, need = None, 0
    for b, c in hist:
        if cum + c >= k:
            boundary, need = b, k - cum
            break
        cum += c
    if k <= 0:
        return hashed.withColumn(flag, F.lit(False)).drop("_h", "_b")
    if boundary is None:  # k >= n: everything is selected
        return hashed.withColumn(flag, F.lit(True)).drop("_h", "_b")
    rest = hashed.where(F.col("_b") != boundary).withColumn(flag, F.col("_b") < boundary)
    # the boundary bucket is ranked with a distributed global rank, not a
    # one-bucket window: a bucket full of copies of one id stays spread out
    from langmix.operators.ordering import global_rank
    edge = (global_rank(hashed.where(F.col("_b") == boundary), ["_h", *id_cols], "_rn")
            .withColumn(flag, F.col("_rn") <= need).drop("_rn"))
    return rest.unionByName(edge).drop("_h", "_b")


def hash_split(df: DataFrame, id_cols: list[str], seed=42, test_fraction: float = 0.1,
               split_col: str = "split", materialize_input: bool = False) -> DataFrame:
    """Seeded train/test split: test = the ``ceil(fraction * n)`` rows with
    the smallest hashes (same sizes as the reference's split)."""
    if materialize_input:
        from langmix.session import stored
        df = stored(df)
    n = df.count()
    k = math.ceil(test_fraction * n)
    sel = hash_select(df, id_cols, k, seed, "_test")
    return (sel.withColumn(split_col, F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train")))
            .drop("_test"))


def seeded_take(df: DataFrame, id_cols: list[str], k: int, seed=42, rank_col: str = "pick") -> DataFrame:
    """Seeded shuffle then take k, with the pick order as a column.
    TakeOrderedAndProject keeps at most k rows per task."""
    top = (df.withColumn("_h", seeded_hash(id_cols, seed))
           .orderBy("_h", *id_cols).limit(k))
    return (top.withColumn(rank_col, F.row_number().over(Window.orderBy("_h", *id_cols)))
            .drop("_h"))


def prefix_take(df: DataFrame, order_cols: list[str], k: int) -> DataFrame:
    """First k rows in a stated order."""
    return df.orderBy(*order_cols).limit(k)
