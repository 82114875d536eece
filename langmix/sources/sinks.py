"""Sinks: ordered text, JSONL, the split cache, append-only tables and
metric reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.sources.commit import drop_manifest, fingerprint, listing, read_manifest, write_manifest


def write_text(df: DataFrame, col: str, path: str, order_by: list[str] | None = None,
               mode: str = "overwrite") -> None:
    """One value per line. With ``order_by`` the output is range-partitioned
    and sorted, so part files concatenated by name are in order (no
    single-task ``coalesce(1)``)."""
    out = df.select(F.col(col).cast("string").alias("value"), *(order_by or []))
    if order_by:
        out = out.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    out.select("value").write.mode(mode).text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines, UTF-8, non-ASCII kept as is."""
    df.write.mode(mode).json(path)


def write_split_cache(df: DataFrame, path: str, split_col: str = "split") -> None:
    """Columnar cache partitioned by split; an existing cache is kept
    (mode ``ignore``), like the trainers' reuse-if-present."""
    df.write.mode("ignore").partitionBy(split_col).parquet(path)


def cached_split(spark: SparkSession, path: str, inputs: list[str], params: dict, build, split_col: str = "split"
                 ) -> tuple[str, str]:
    """A cache partitioned by split that is made once: (``"reused"`` or
    ``"built"``, folder of its rows). ``build()`` gives the rows.

    The manifest, committed after the rows, holds the digest of the parameters
    and of the inputs' listing (path, size, time of change) and the rows of
    each split. The cache is reused only if that digest is the same and all
    rows are there; a write that broke off has no manifest. Another build goes
    to a folder of its own, so a reader of the old one isn't disturbed."""
    print_ = fingerprint(params, [listing(spark, p) for p in inputs])
    manifest = f"{path}/_cache.json"
    known = read_manifest(spark, manifest)
    if known and known["fingerprint"] == print_ and _split_rows(spark, f"{path}/{known['folder']}", split_col) == known["rows"]:
        return "reused", f"{path}/{known['folder']}"
    folder = f"{print_[:16]}-{uuid.uuid4().hex[:8]}"
    build().write.mode("overwrite").partitionBy(split_col).parquet(f"{path}/{folder}")
    write_manifest(spark, manifest, {"fingerprint": print_, "folder": folder,
                                     "rows": _split_rows(spark, f"{path}/{folder}", split_col)})
    return "built", f"{path}/{folder}"


def forget(spark: SparkSession, path: str) -> None:
    """Drop a cache's manifest: what is there isn't used again."""
    drop_manifest(spark, f"{path}/_cache.json")


def _split_rows(spark: SparkSession, path: str, split_col: str) -> dict[str, int]:
    """Rows of each split, counted from the files' footers."""
    if not listing(spark, path):
        return {}
    rows = spark.read.parquet(path).groupBy(split_col).count().collect()
    return {str(r[split_col]): r["count"] for r in rows}


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
