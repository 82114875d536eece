"""Readers: numbered text lines, typed JSONL, the ground-truth lookup file,
whole-JSON arrays, split caches, optional sources and the non-empty guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from langmix.functions.arrays import bound
from langmix.functions.text import is_blank, normalize_text
from langmix.operators import lookup
from langmix.operators.ordering import global_rank
from langmix.session import materialize, stored
from langmix.sources.commit import fingerprint, listing, read_manifest, write_manifest

# --- Fixed values -----------------------------------------------------------
LABELLED_SCHEMA = "tokens array<string>, ner_tags array<int>"
MAX_SPLITS = 100_000   # input splits whose offsets are broadcast, some 200 bytes each
# -----------------------------------------------------------------------------


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional_source(spark: SparkSession, path: str, schema: str, read) -> DataFrame:
    """Missing input -> an empty DataFrame of the fixed schema (the skip is
    the caller's to log); otherwise ``read(path)``."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return read(path)


def require_nonempty(df: DataFrame, what: str) -> DataFrame:
    """Refuse empty input with a clear error (one-row probe, not a count)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty; produce it first")
    return df


_INDEX = "file string, n bigint, first bigint"


def line_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, first): the lines of every file and the number of its first
    one over all files, by path. Counted once and kept next to the data
    (``_lines``, which Spark's readers skip); counted again only when the
    listing of the files (names, sizes, times of change) is another."""
    kept, marker = f"{path.rstrip('/')}/_lines", f"{path.rstrip('/')}/_lines.json"
    now = fingerprint(listing(spark, path))
    known = read_manifest(spark, marker)
    if not known or known["fingerprint"] != now:
        counts = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        ranked = materialize(global_rank(counts, ["file"], "_r").withColumn("_p", F.floor((F.col("_r") - 1) / 1024)))
        before = ranked.groupBy("_p").agg(F.sum("n").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(
            Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a 1,024 files
        inside = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        first = F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + 1
        ranked.join(before, "_p").select("file", "n", first.alias("first")).write.mode("overwrite").parquet(kept)
        write_manifest(spark, marker, {"fingerprint": now})
    return spark.read.schema(_INDEX).parquet(kept)


def lines_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(file, global_line_no, value) of the lines ``first`` to ``last`` of all
    files together (1-based, files by path). Only the files in which they lie
    are read, as the index tells."""
    index = line_index(spark, path).where((F.col("first") <= last) & (F.col("first") + F.col("n") > first))
    wanted = index.select("file", (F.col("first") - 1).alias("_before")).limit(last - first + 1).collect()  # a file a line at most
    if not wanted:
        return spark.createDataFrame([], "file string, global_line_no bigint, value string")
    rows = read_lines(spark, [r["file"] for r in wanted])   # files by path, so the first one's offset is all that is missing
    return rows.select("file", (F.col("global_line_no") + min(r["_before"] for r in wanted)).alias("global_line_no"), "value") \
        .where(F.col("global_line_no").between(first, last))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with 1-based numbers: ``(file, line_no, file_rank,
    global_line_no, value)``. Line breaks are ``\\n``, ``\\r`` and ``\\r\\n``.

    Files may be split across tasks. Each input split is read in order into
    one task, so ``monotonically_increasing_id`` is consecutive inside a
    split; a split's offset is the line count of the earlier splits of its
    file. The per-split table has one row per split and is counted first: up to
    ``MAX_SPLITS`` it is broadcast, so that no line moves to get its number;
    beyond, that is left to the planner. Files are ordered by path."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"), "value")
    t = raw.withColumn("_mid", F.monotonically_increasing_id())
    blocks = stored(t.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")), "splits")
    few = blocks.count() <= MAX_SPLITS
    by_file = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(by_file), F.lit(0)))
    files = blocks.groupBy("file").agg(F.sum("_n").alias("_fn"))
    every = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.row_number().over(Window.orderBy("file")).alias("file_rank"),
                         F.coalesce(F.sum("_fn").over(every), F.lit(0)).alias("_foff"))
    meta = blocks.join(files, "file").select("file", "_block", "_off", "_first", "file_rank", "_foff")
    j = t.join(F.broadcast(meta) if few else meta, ["file", "_block"])
    line_no = F.col("_off") + F.col("_mid") - F.col("_first") + 1
    return j.select("file", line_no.alias("line_no"), F.col("file_rank").cast("long"),
                    (F.col("_foff") + line_no).alias("global_line_no"), "value")


def read_labelled_jsonl(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """Labelled sentences with a fixed schema (no inference). A line that
    isn't one is an error, or with ``on_bad='skip'`` left out."""
    if on_bad not in ("skip", "fail"):
        raise ValueError(on_bad)
    mode = {"fail": "FAILFAST", "skip": "DROPMALFORMED"}[on_bad]
    return spark.read.schema(LABELLED_SCHEMA).option("mode", mode).json(path)


def judged_lines(spark: SparkSession, path: str, schema: str = LABELLED_SCHEMA) -> DataFrame:
    """Numbered lines of a JSONL file, each parsed once: ``(file,
    global_line_no, value, is_blank, is_bad, record)``."""
    lines = read_lines(spark, path)
    parsed = F.from_json("value", f"{schema}, _corrupt_record string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    # behind a generator: a filter on the record would be pushed below the
    # projection and parse every line once more
    t = lines.select("file", "global_line_no", "value", is_blank("value").alias("is_blank"), F.explode(F.array(parsed)).alias("_p"))
    bad = F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull()
    for name in names:
        bad = bad | F.col(f"_p.{name}").isNull()
    return t.select("file", "global_line_no", "value", "is_blank", (~F.col("is_blank") & bad).alias("is_bad"),
                    F.struct(*[F.col(f"_p.{n}").alias(n) for n in names]).alias("record"))


def line_faults(judged: DataFrame) -> DataFrame:
    """Per file: lines, blank lines, malformed lines."""
    return judged.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"),
                                      F.count_if("is_blank").alias("n_blank"), F.count_if("is_bad").alias("n_bad"))


def load_lookup(spark: SparkSession, path: str, on_bad: str = "skip", with_key: bool = True) -> DataFrame:
    """Ground-truth lookup ``(key, ner_tags, seq)``, or without the text of the
    key ``(hi, lo, ner_tags, seq)`` for a join on its digest, which moves no
    text: blank lines skipped;
    ``on_bad='skip'`` drops malformed lines only (:func:`line_faults` counts
    them), ``'fail'`` refuses a file with any, ``'stop'`` keeps what stands
    before the first one; key = normalized space-joined tokens; the last
    line wins per key; a missing file gives an empty lookup."""
    schema = f"{'key string' if with_key else 'hi bigint, lo bigint'}, ner_tags array<int>, seq bigint"
    if on_bad not in ("skip", "fail", "stop"):
        raise ValueError(on_bad)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = judged_lines(spark, path).where("NOT is_blank")
    if on_bad != "skip":
        first_bad = lines.where("is_bad").agg(F.min("global_line_no")).first()[0]  # one scalar
        if first_bad is not None and on_bad == "fail":
            raise ValueError(f"line {first_bad} of {path} is malformed")
        if first_bad is not None:
            lines = lines.where(F.col("global_line_no") < F.lit(first_bad))
    good = lines.where("NOT is_bad").select(F.col("record").alias("r"), F.col("global_line_no").alias("seq"))
    # behind a generator as well, or the test for a null key normalizes twice
    key = bound(lambda text: normalize_text(text), text=F.array_join("r.tokens", " "))   # joined once, read in several places
    keyed = good.select(F.explode(F.array(key)).alias("key"),
                        F.col("r.ner_tags").alias("ner_tags"), "seq")
    found = lookup.last_wins(keyed, "key", "seq", ["ner_tags", *(["key"] if with_key else [])])
    return found.select(*(["key"] if with_key else ["hi", "lo"]), "ner_tags", "seq")


def _parsed_json(docs: DataFrame, value_col: str, schema: str, keys: list[str], on_bad: str) -> DataFrame:
    """``keys`` and the parsed document ``_j``. A value that isn't JSON is an
    error, or with ``on_bad='skip'`` has no items (:func:`json_faults` counts)."""
    if on_bad not in ("skip", "fail"):
        raise ValueError(on_bad)
    mode = {"fail": "FAILFAST", "skip": "PERMISSIVE"}[on_bad]
    return docs.select(*keys, F.from_json(F.col(value_col), schema, {"mode": mode}).alias("_j"))


def json_faults(docs: DataFrame, value_col: str) -> DataFrame:
    """One row: documents, and those that aren't JSON."""
    bad = F.col(value_col).isNotNull() & F.try_parse_json(value_col).isNull()
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(bad).alias("n_bad"))


def _is_string(item: str) -> F.Column:
    return F.schema_of_variant(item) == "STRING"


def json_array_items(docs: DataFrame, value_col: str, key: str, keys: list[str] | None = None,
                     extra_schema: str = "", on_bad: str = "fail", max_items: int | None = None) -> DataFrame:
    """Whole-JSON scan of one named array per document: missing key -> no
    items; each item keeps its position and whether it is a string
    (``variant`` typing, so a number is not silently turned into text);
    ``max_items`` keeps the first positions only."""
    keys = keys or []
    schema = f"{key} array<variant>" + (f", {extra_schema}" if extra_schema else "")
    parsed = _parsed_json(docs, value_col, schema, keys, on_bad)
    extra = [f.strip().split(" ")[0] for f in extra_schema.split(",")] if extra_schema else []
    array = F.col(f"_j.{key}") if max_items is None else F.slice(f"_j.{key}", 1, max_items)
    items = parsed.select(*keys, *[F.col(f"_j.{e}").alias(e) for e in extra], F.posexplode(array).alias("pos", "_v"))
    return items.select(*keys, *extra, F.col("pos").cast("long").alias("pos"), _is_string("_v").alias("is_string"),
                        F.when(_is_string("_v"), F.variant_get("_v", "$", "string")).alias("text"))


def json_pairs(docs: DataFrame, value_col: str, text_key: str, label_key: str, keys: list[str] | None = None,
               on_bad: str = "fail", max_items: int | None = None) -> DataFrame:
    """Two parallel arrays of each document, paired by position up to the
    shorter one, in one parse: ``(keys, pos, is_string, text, label)``."""
    keys = keys or []
    parsed = _parsed_json(docs, value_col, f"{text_key} array<variant>, {label_key} array<string>", keys, on_bad)
    x, y = F.col(f"_j.{text_key}"), F.col(f"_j.{label_key}")
    n = F.least(F.size(x), F.size(y)) if max_items is None else F.least(F.size(x), F.size(y), F.lit(max_items))
    both = F.arrays_zip(F.slice(x, 1, n).alias("x"), F.slice(y, 1, n).alias("y"))
    pairs = parsed.where(x.isNotNull() & y.isNotNull()).select(*keys, F.posexplode(both).alias("pos", "_z")) \
        .select(*keys, "pos", F.col("_z.x").alias("_v"), F.col("_z.y").alias("label"))
    return pairs.select(*keys, F.col("pos").cast("long").alias("pos"), _is_string("_v").alias("is_string"),
                        F.when(_is_string("_v"), F.variant_get("_v", "$", "string")).alias("text"), "label")


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)``: each file is one JSON document, as ``json.load``
    reads it, bounded by what one row may hold."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a ``partitionBy('split')`` cache (partition pruning)."""
    return spark.read.parquet(path).where(F.col("split") == split)
