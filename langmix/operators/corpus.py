"""Corpus build: sources -> strip -> union-distinct -> sort, line expansion,
label filter, per-source prefix limits and the capped sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmix.functions.text import digest, split_lines, strip_ws
from langmix.operators.ordering import global_rank
from langmix.operators.sampling import hash_select, seeded_hash
from langmix.session import stored

# --- Fixed values -----------------------------------------------------------
# Labels kept from the large labelled source (case-sensitive).
LABELS_TO_KEEP = ("malay", "eng", "ind", "manglish", "rojak")
# -----------------------------------------------------------------------------

ITEM_COLS = ["source", "source_rank", "pos", "text"]


def source_items(df: DataFrame, text_col: str, source: str, rank: int,
                 pos_col: str | None = None) -> DataFrame:
    """One source as ``(source, source_rank, pos, text)``; ``pos`` is the
    item's position in its source (carried from the data, never invented)."""
    pos = F.col(pos_col).cast("long") if pos_col else F.lit(None).cast("long")
    return df.select(F.lit(source).alias("source"), F.lit(rank).alias("source_rank"),
                     pos.alias("pos"), F.col(text_col).cast("string").alias("text"))


def keep_strings(items: DataFrame) -> DataFrame:
    """Only string items survive (readers turn non-strings into null)."""
    return items.where(F.col("text").isNotNull())


def label_filter(df: DataFrame, label_col: str, labels=LABELS_TO_KEEP) -> DataFrame:
    """Label membership filter (pushed into the scan for Parquet input)."""
    return df.where(F.col(label_col).isin(list(labels)))


def union_distinct(items: list[DataFrame]) -> DataFrame:
    """Union of sources, stripped, deduplicated. Keeps the rank of the first
    source that contributed each sentence. Partial aggregation collapses hot
    duplicates map-side, so a sentence repeated a billion times costs one row
    per map task in the shuffle."""
    u = items[0]
    for more in items[1:]:
        u = u.unionByName(more)
    return (keep_strings(u)
            .select(strip_ws("text").alias("sentence"), "source_rank")
            .groupBy("sentence").agg(F.min("source_rank").alias("first_source")))


def with_sentence_id(df: DataFrame, col: str = "sentence") -> DataFrame:
    return df.withColumn("sentence_id", F.sha2(F.col(col), 256))


def source_contribution(items: list[DataFrame]) -> DataFrame:
    """Per source, given in rank order: items processed, sentences it added
    first, and the cumulative unique count after it. Every source is read once
    and aggregated by digest: a sentence's row says how often each source has
    it, all sums are numbers, and no text moves."""
    parts, names = [], []
    for i, df in enumerate(items):
        parts.append(keep_strings(df).select(digest(strip_ws("text")).alias("d"), F.lit(i).alias("i")))
        names.append(df.select(F.lit(i).alias("i"), "source_rank", "source").limit(1))   # constants, no column is read
    u, listed = parts[0], names[0]
    for more, name in zip(parts[1:], names[1:]):
        u, listed = u.unionByName(more), listed.unionByName(name)
    each = u.groupBy("d.hi", "d.lo").agg(F.min("i").alias("first"), *[
        F.count_if(F.col("i") == k).alias(f"n{k}") for k in range(len(items))])
    sums = each.agg(F.array(*[F.struct(F.lit(k).alias("i"), F.sum(f"n{k}").alias("n_items"), F.count_if(F.col("first") == k).alias("n_new"))
                              for k in range(len(items))]).alias("s"))
    per = sums.select(F.inline("s")).where("n_items > 0").join(listed, "i").select("source_rank", "source", "n_items", "n_new")
    # one row per source: a window without partitioning is bounded here
    w = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("cum_unique", F.sum("n_new").over(w).cast("long"))


def sorted_unique(items: list[DataFrame]) -> DataFrame:
    """Unique sentences with their rank in code-point order (UTF-8 binary
    order equals code-point order)."""
    return global_rank(union_distinct(items).select("sentence"), ["sentence"], "rank")


def lines(df: DataFrame, text_col: str, keys: list[str], strip: bool = True) -> DataFrame:
    """A text with embedded line breaks becomes one row per line, as when the
    reference writes a sentence file and reads it back line by line."""
    t = strip_ws(text_col) if strip else F.col(text_col)
    return df.select(*keys, F.posexplode(split_lines(t)).alias("line_no", "line"))


def prefix_limit(items: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Per-source prefix limits counted on raw items (before the string
    filter and dedup): ``pos < limit[source]``. No window, no shuffle."""
    cond = F.lit(False)
    for source, limit in limits.items():
        cond = cond | ((F.col("source") == source) & (F.col("pos") < limit))
    return items.where(cond)


def capped_sample(sources: list[DataFrame], sample_size: int, seed: int) -> DataFrame:
    """The ``sample_size`` unique sentences with the smallest seeded hashes
    of all sources together: every sentence has the same chance, whatever
    its source or place."""
    # checkpointed once: counted by hash and selected from
    unique = stored(union_distinct(sources).select("sentence"))
    picked = hash_select(unique, ["sentence"], sample_size, seed, "keep")
    return (picked.where("keep")
            .select("sentence", seeded_hash(["sentence"], seed).alias("h")))


def fraction_sample(items: DataFrame, fraction: float, seed: int, key: str = "sentence") -> DataFrame:
    """A seeded-hash fraction of every source, decided row by row: no shuffle,
    grows with the input, and copies of a sentence share their fate."""
    top = F.lit(f"{int(fraction * (1 << 32)):08x}") if fraction < 1 else F.lit("g")
    return items.where(F.substring(seeded_hash([key], seed), 1, 8) < top)
