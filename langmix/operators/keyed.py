"""Keyed-table operations: insert-or-ignore, existence test, newest-first
history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmix.operators.ordering import rank_in_groups


def insert_if_absent(base: DataFrame, incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """``INSERT OR IGNORE``: existing rows win; among incoming rows with the
    same key the first (smallest ``seq``) wins. First-per-key is a partial
    aggregation (``min_by``), so a hot key never lands whole in one task."""
    payload = [c for c in incoming.columns if c not in keys and c != seq]
    first = incoming.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), F.col(seq)).alias("_r"))
    first = first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in payload])
    new = first.join(base.select(*keys), keys, "left_anti")
    return (base.select(*keys, *payload).withColumn("origin", F.lit("base"))
            .unionByName(new.withColumn("origin", F.lit("incoming"))))


def rows_exist(df: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose composite key exists in ``keys_df`` (semi-join)."""
    return df.join(keys_df.select(*keys), keys, "left_semi")


def history(chats: DataFrame, user_col: str, id_col: str, user=None) -> DataFrame:
    """Newest-first history with the position (``recency``, 1 = newest).

    For one user (the request path) the key filter reaches the scan and the
    ordering runs on that user's rows. For all users the position comes from
    ``rank_in_groups``: a window while every user fits one task, else
    ``grouped_rank``, so a user holding a third of all rows is spread over
    many tasks instead of one window partition."""
    if user is not None:
        src = chats.where(F.col(user_col) == F.lit(user))
        w = Window.partitionBy(user_col).orderBy(F.col(id_col).desc())
        return src.withColumn("recency", F.row_number().over(w))
    return rank_in_groups(chats, [user_col], [F.col(id_col).desc()], "recency")
