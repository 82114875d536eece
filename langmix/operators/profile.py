"""Profiles of tagged text: per-sentence code-switching, label distribution,
JSON key discovery and record preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
ARRAY_KEY = r'"([^"]+)":\s*\['  # a JSON key followed by an array
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentence_profile(tags) -> Column:
    """Counts per label, code-switched flag (both MS and EN present) and the
    number of switch points between consecutive non-O tokens. In-row."""
    t = _c(tags)
    n_ms, n_en = (F.size(t) - F.size(F.array_remove(t, F.lit(k))) for k in (1, 2))
    # each tagged token beside the one before it: a lambda that looks back into
    # the filtered array would filter it again for every element
    nz = F.filter(t, lambda x: x != 0)
    pairs = F.greatest(F.size(nz) - 1, F.lit(0))
    switches = F.size(F.filter(F.zip_with(F.slice(nz, 1, pairs), F.slice(nz, 2, pairs), lambda a, b: a != b),
                               lambda b: b))
    return F.struct((F.size(t) - n_ms - n_en).alias("n_o"), n_ms.alias("n_ms"), n_en.alias("n_en"),
                    ((n_ms > 0) & (n_en > 0)).alias("code_switched"), switches.alias("switch_points"))


def label_distribution(df: DataFrame, group: list[str], tags: str) -> DataFrame:
    """Token count and share per (group, label). Tokens are counted per row
    first (in-row filters), so only (group, label, count) partials shuffle."""
    def equals(k):
        return lambda x: x == k  # one-argument lambda: PySpark reads two as (x, index)

    per_row = df.select(*group, F.explode(F.array(*[
        F.struct(F.lit(k).alias("label_id"), F.size(F.filter(tags, equals(k))).alias("n"))
        for k in (0, 1, 2)])).alias("_c"))
    counts = (per_row.groupBy(*group, F.col("_c.label_id").alias("label_id"))
              .agg(F.sum("_c.n").cast("long").alias("n")))
    w = Window.partitionBy(*group)
    return counts.withColumn("share", F.when(F.sum("n").over(w) > 0, F.col("n") / F.sum("n").over(w)))


def json_array_keys(df: DataFrame, text_col: str) -> DataFrame:
    """Distinct keys followed by ``[`` anywhere in the texts. Each text is
    scanned whole, so no key is lost at a chunk border."""
    return (df.select(F.explode(F.regexp_extract_all(text_col, F.lit(ARRAY_KEY), 1)).alias("key"))
            .distinct())


def pretty_json(text) -> Column:
    """JSON text in lines, two spaces deeper for every level; strings and empty arrays and objects stay as they are.
    Compact JSON (as ``to_json`` writes it) is expected."""
    pieces = F.regexp_extract_all(_c(text), F.lit(r'("(?:[^"\\]|\\.)*"|\[\]|\{\}|[\[\]{}:,]|[^"\[\]{}:,]+)'), F.lit(1))
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("depth"))

    def line(depth):
        return F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))

    def step(acc, p):
        deeper, higher = acc["depth"] + 1, acc["depth"] - 1
        return (F.when(p.isin("{", "["), F.struct(F.concat(acc["text"], p, line(deeper)).alias("text"), deeper.alias("depth")))
                .when(p.isin("}", "]"), F.struct(F.concat(acc["text"], line(higher), p).alias("text"), higher.alias("depth")))
                .when(p == ",", F.struct(F.concat(acc["text"], p, line(acc["depth"])).alias("text"), acc["depth"].alias("depth")))
                .when(p == ":", F.struct(F.concat(acc["text"], F.lit(": ")).alias("text"), acc["depth"].alias("depth")))
                .otherwise(F.struct(F.concat(acc["text"], p).alias("text"), acc["depth"].alias("depth"))))

    return F.aggregate(pieces, state, step)["text"]


def preview(lines: DataFrame, n: int, line_no: str = "line_no", value: str = "value", pretty: bool = False) -> DataFrame:
    """First ``n`` lines of a JSONL file: the whole record as JSON (``pretty``:
    in indented lines), or the bad line's stripped content, with its 1-based
    line number. Any JSON value is a record; blank lines are bad."""
    first = lines.where(F.col(line_no) <= n)
    record = F.try_parse_json(value)
    shown = F.to_json(record)
    return first.select(
        line_no, record.isNull().alias("is_bad"), record.alias("record"),
        F.when(record.isNull(), F.trim(value)).otherwise(pretty_json(shown) if pretty else shown).alias("content"))
