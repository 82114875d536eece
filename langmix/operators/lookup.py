"""Look-ups by text: the key of every join and aggregation is a 128-bit digest
(:func:`langmix.functions.text.digest`), so texts neither are compared nor
travel as keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions.text import digest


def with_digest(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``hi`` and ``lo``, the digest of a text column."""
    return df.withColumn("_d", digest(text)).select(*df.columns, "_d.hi", "_d.lo")


def last_wins(rows: DataFrame, text: str, seq: str, payload: list[str]) -> DataFrame:
    """(hi, lo, ``seq``, payload) of the row with the largest ``seq`` of each
    text; null texts have none. Rows of a text are collapsed before the
    exchange, which carries the digest and the payload; a payload of numbers
    makes it a hash aggregation."""
    return last_of(with_digest(rows, text), seq, payload)


def last_of(keyed: DataFrame, seq: str, payload: list[str]) -> DataFrame:
    """:func:`last_wins` of rows that have their digest already."""
    return keyed.where(F.col("hi").isNotNull()).groupBy("hi", "lo").agg(F.max(seq).alias(seq), *[F.max_by(c, seq).alias(c) for c in payload])


def look_up(requests: DataFrame, text: str, truth: DataFrame, payload: list[str]) -> DataFrame:
    """``requests`` with the payload of the truth (hi, lo, payload) of their
    text, nulls where there is none. The text itself stays behind if no column
    of the result needs it."""
    asked = with_digest(requests, text)
    return asked.join(truth.select("hi", "lo", *payload), ["hi", "lo"], "left").select(*requests.columns, *payload)
