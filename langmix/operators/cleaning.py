"""Row operators around the clean/normalize Column rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.functions.text import MIN_TOKENS, camel_discard, clean_tokens, rule_steps, split_squeezed, split_ws


def clean_lines(df: DataFrame, text_col: str, keys: list[str], min_tokens: int = MIN_TOKENS,
                out: str = "text") -> DataFrame:
    """clean_text + drop empty results.

    The rewrite is computed once in a projection, and the keep/drop decision
    is made by a generator (``explode`` of a 0/1-element array). A plain
    ``where(text != '')`` would be pushed below the projection by Catalyst,
    which copies the whole rewrite chain into the filter and runs it twice
    per row."""
    raw = F.col(text_col)
    step = df.select(*keys, raw.alias("_t"), raw.rlike(r"(?U)\d").alias("_dig"),
                     (raw.isNull() | camel_discard(raw)).alias("_drop"))
    # One projection per rule, each guarded by a cheap test on the current
    # text: the rule's regex runs only where it can match. Separate
    # projections keep Catalyst from inlining the previous step into both
    # branches of the guard.
    for guard, rewrite in rule_steps():
        t = F.col("_t")
        step = step.select(*keys, "_dig", "_drop", F.when(guard(t, F.col("_dig")), rewrite(t)).otherwise(t).alias("_t"))
    # the tokens are found and counted in one scan, and joined only where kept
    step = step.select(*keys, "_drop", clean_tokens("_t").alias("_t"))
    keep = (~F.col("_drop")) & (F.size("_t") >= min_tokens)
    return step.select(*keys, F.explode(F.when(keep, F.array(F.array_join("_t", " "))).otherwise(F.array()))
                       .alias(out))


def token_counts(df: DataFrame, text_col: str, group: list[str], squeezed: bool = False) -> DataFrame:
    """Per group: non-empty texts and tokens (tokens counted in-row, then a
    partial aggregation, so no token is ever shuffled)."""
    # the count is projected once; a row filter on it would be pushed below
    # the projection and split every text twice, so empty texts are skipped
    # inside the aggregates and empty groups after them
    tokens = split_squeezed(text_col) if squeezed else split_ws(text_col)
    n = df.select(*group, F.size(tokens).alias("_n"))
    nonempty = F.col("_n") > 0
    out = n.groupBy(*group).agg(
        F.count(F.when(nonempty, 1)).alias("n_lines"),
        F.sum(F.when(nonempty, F.col("_n"))).cast("long").alias("n_tokens"),
        F.max(F.when(nonempty, F.col("_n"))).cast("long").alias("max_tokens"))
    return out.where(F.col("n_lines") > 0)
