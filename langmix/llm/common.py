"""Helpers shared by the operators: table reading, landing intermediates in
the shared folder, column clashes, bounded literal tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def land(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: later uses prune
    columns, share the work and survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns an operator is about to add (case-insensitive, as Spark
    resolves names); an operator's own output always wins a clash."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small bounded table of plain values as one JSON literal (no RDD)."""
    doc = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(doc))


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids belong to fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(0))


MAX_CLASSES = 10_000   # classes of a sample whose counts may reach the driver and the plan


def bounded_sample(df: DataFrame, class_col: str, per_class: int, id_col: str, seed: int) -> DataFrame:
    """About ``per_class`` rows of every class, all if there are fewer: one
    aggregation counts the classes, a seeded hash of the id picks the rows.
    More than ``MAX_CLASSES`` classes are refused."""
    counts = {r["c"]: r["n"] for r in df.groupBy(F.col(class_col).alias("c")).agg(F.count(F.lit(1)).alias("n"))
              .limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"{class_col} has more than {MAX_CLASSES} values")
    if not counts:
        return df
    steps = 1 << 20
    keep = F.create_map(*[F.lit(x) for c, n in sorted(counts.items(), key=str) if c is not None
                          for x in (c, min(steps, per_class * steps // n + 1))]) \
        if any(c is not None for c in counts) else F.create_map(F.lit(""), F.lit(0))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(steps)) < keep[F.col(class_col)])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, seed: int,
                    id_col: str = "doc_id", text_col: str = "text", classes: bool = True) -> DataFrame:
    """(id, text, label) of about ``per_class`` labelled documents of each
    class (of all together without ``classes``). The labels are sampled first,
    one per id (the largest), so that what is broadcast to the documents has a
    fixed bound and no text moves."""
    given = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")) \
        .where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    given = land(given.withColumn("class", F.col("label").cast("string") if classes else F.lit("")), "labels")
    some = bounded_sample(given, "class", per_class, "id", seed).select("id", "label")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL") \
        .join(F.broadcast(some), "id").select("id", "text", "label")
