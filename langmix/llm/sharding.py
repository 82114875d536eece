"""Uniform sharding by a hypergeometric communication matrix.

Each input partition (source) permutes its rows locally. The number of rows
that source p sends to shard s is drawn exactly: rows of the matrix add up to
the source sizes, columns to the shard sizes, and every such matrix has the
probability it has under a uniform shuffle of all rows. A source deals its
permuted rows out by these counts, whole rows are exchanged, and each shard
permutes again and is written. Shard sizes differ by at most one row.

Rows never depend on their values for their shard, so hot keys, copies and
repeated rows cannot skew a shard. Null columns are ordinary values; repeated
rows are each placed; an empty table gives an empty result; columns of the
input called ``shard`` or ``slot`` are replaced."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmix.llm.common import land, literal_table, table, without

N_SHARDS = 40
SEED = 20240607
MAX_SOURCES = 4096     # bound of the matrix: at most MAX_SOURCES x n_shards numbers
BLOCK_ROWS = 1 << 16   # rows of a shard that one task numbers, about
MIN_BLOCKS = 8


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw of how many of ``draws`` balls are good, by inversion from
    the mode outwards (about one standard deviation of steps, any size)."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    log_p = (lg(good + 1) - lg(mode + 1) - lg(good - mode + 1)
             + lg(bad + 1) - lg(draws - mode + 1) - lg(bad - draws + mode + 1)
             + lg(draws + 1) + lg(good + bad - draws + 1) - lg(good + bad + 1))
    left = rng.random() - math.exp(log_p)
    up = down = mode
    p_up = p_down = math.exp(log_p)
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up + p_down < 1e-300:  # rounding left a remainder beyond both tails
            break
    return mode


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts with the given row and column sums, distributed as under a
    uniform shuffle: one multivariate hypergeometric draw per source."""
    rng, room, out = random.Random(seed), list(shards), []
    for rows in sources:
        rest, drawn = sum(room), []
        for s, cap in enumerate(room):
            n = hypergeometric(rng, cap, rest - cap, rows)
            drawn.append(n)
            rest -= cap
            rows -= n
            room[s] = cap - n
        out.append(drawn)
    return out


def shard_rows(df: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to n_shards - 1) and ``slot``
    (gapless from 0 within the shard, in shuffled order)."""
    spark = df.sparkSession
    df = without(df, "shard", "slot")
    cols = [F.col(f"`{c}`") for c in df.columns]
    scalar = [F.col(f"`{f.name}`") for f in df.schema.fields
              if f.dataType.typeName() not in ("map", "variant")]
    # local permutation: a seeded hash order inside each source; the id's low
    # 33 bits are then the row's place in it, the high bits the source
    local = (df.coalesce(MAX_SOURCES).withColumn("_hm_key", F.xxhash64(F.lit(seed), *scalar))
             .sortWithinPartitions("_hm_key").select(*cols, F.monotonically_increasing_id().alias("_hm_id")))
    local = land(local, "shard-local", "zstd")
    src, pos = F.shiftright("_hm_id", 33), F.col("_hm_id").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["src"], r["n"]) for r in local.groupBy(src.alias("src"))
                    .agg(F.count(F.lit(1)).alias("n")).collect())  # at most MAX_SOURCES rows
    total = sum(n for _, n in counts)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    ends = [{"_hm_src": p, "_hm_ends": [sum(row[:s + 1]) for s in range(n_shards)]}
            for (p, _), row in zip(counts, matrix)]
    sent = (local.withColumn("_hm_src", src)
            .join(F.broadcast(literal_table(spark, ends, "_hm_src: bigint, _hm_ends: array<bigint>")), "_hm_src")
            .select(*cols, "_hm_id",
                    F.size(F.filter("_hm_ends", lambda e: e <= pos)).alias("shard")))
    # second permutation: blocks of the shard in a fresh hash order. The whole rows are exchanged and sorted (both spill,
    # whatever the length of a row) and written in that order; a row's slot follows from its place in what was written
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(MIN_BLOCKS, -(-max(sizes) // block_rows), -(-2 * tasks // n_shards))
    sent = sent.withColumn("_hm_key", F.xxhash64(F.lit(seed + 1), "_hm_id")) \
        .withColumn("_hm_block", F.pmod(F.shiftright("_hm_key", 20), F.lit(blocks)))
    dealt = (sent.repartition("shard", "_hm_block").sortWithinPartitions("shard", "_hm_block", "_hm_key", "_hm_id")
             .select(*cols, "shard", "_hm_block", F.monotonically_increasing_id().alias("_hm_at")))
    dealt = land(dealt, "shards", "zstd")
    # a row per block: at most n_shards more than rows / block_rows, 2 x tasks or MIN_BLOCKS x n_shards
    per_block = dealt.groupBy("shard", "_hm_block").agg(F.min("_hm_at").alias("_hm_first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_hm_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("shard", "_hm_block", (F.coalesce(F.sum("n").over(before), F.lit(0))
                                                     - F.col("_hm_first")).alias("_hm_from"))
    return (dealt.join(F.broadcast(starts), ["shard", "_hm_block"])
            .select(*cols, F.col("shard").cast("int"), (F.col("_hm_from") + F.col("_hm_at")).alias("slot")))


def op4_hypergeometric_shards(spark, sf_dir):
    """All documents in 40 shards whose row counts differ by at most one. Size
    and checksum are those of the texts that arrived: whole documents are
    sharded, written and read again before they are digested."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return shard_rows(table(spark, sf_dir, "documents")) \
        .select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"),
                F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_hypergeometric_shards": op4_hypergeometric_shards}
SQL: dict[str, str] = {}
