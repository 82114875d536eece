"""Tables that are written again and again: an append-only one with gapless
ids, and a keyed one into which rows are merged.

Both keep their state in manifests (:mod:`langmix.sources.commit`): rows are
written first, then the manifest that names them, so what a failed or repeated
write leaves behind is never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.operators.ordering import global_rank
from langmix.session import materialize
from langmix.sources.commit import fingerprint, manifests, read_manifest, write_manifest

BUCKETS = 64
FILTER_BITS = (16, 26)   # log2 of the bits of a keyed table's filter: about 8 a key, 1 M words at most
BUCKET_LIMIT = 4096      # bucket numbers that a manifest may list


# --- append-only, explicit ids ----------------------------------------------------

def append_numbered(df: DataFrame, path: str, batch: str, order_by: list[str], id_col: str = "id") -> int:
    """Append the rows as the named batch and return how many the table has
    since. Ids go on where the last batch ended, in ``order_by`` order within
    the batch: offsets per task, no window over all rows. A batch that is
    there already is left as it is, so a retry changes nothing; one that a
    failed write left without a manifest is written anew. One writer at a
    time: of two that claim the same turn the second gets an error."""
    spark = df.sparkSession
    known = manifests(spark, f"{path}/_batches")
    done = sum(m["rows"] for m in known)
    if any(m["batch"] == batch for m in known):
        return done
    folder = f"rows/{fingerprint(batch)[:24]}"
    rows = global_rank(df, order_by, "_rank").withColumn(id_col, F.col("_rank") + done).drop("_rank")
    rows.write.mode("overwrite").parquet(f"{path}/{folder}")
    n = spark.read.parquet(f"{path}/{folder}").count()   # from the files' footers
    write_manifest(spark, f"{path}/_batches/{len(known):09d}.json",
                   {"batch": batch, "folder": folder, "first": done + 1, "rows": n}, create=True)
    return done + n


def read_numbered(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """All rows of the committed batches; ``since`` leaves out whole batches
    whose ids end before it, then rows."""
    every = manifests(spark, f"{path}/_batches")
    if not every:
        raise FileNotFoundError(f"{path} has no committed batch")
    known = [m for m in every if m["rows"] and m["first"] + m["rows"] > since] or every[:1]
    df = spark.read.parquet(*[f"{path}/{m['folder']}" for m in known])
    return df.where(F.col("id") >= since) if since else df


# --- keyed, insert or ignore ------------------------------------------------------

def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _place(keys: list[str], bits: int):
    return F.xxhash64(F.lit(1), *keys).bitwiseAND((1 << bits) - 1)


def _filter_of(df: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """The filter's words: one bit of a second hash for each key."""
    at = _place(keys, bits)
    return df.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(63).cast("int").alias("bit")) \
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


class KeyedTable:
    """Rows with one row per key, in buckets by key hash. The manifest lists
    the folder of each bucket's current rows and of the filter of all keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    @property
    def state(self) -> dict | None:
        return read_manifest(self.spark, f"{self.path}/_state.json")

    def _write(self, rows: DataFrame, bits: DataFrame, state: dict, version: int) -> dict:
        """Write the rows' buckets and the filter, then the manifest."""
        folder = f"v{version}"
        rows.withColumn("bucket", _bucket(self.keys, state["buckets"])).repartition("bucket") \
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}/rows")
        bits.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{folder}/filter")   # 1 M words at most
        now = self.spark.read.parquet(f"{self.path}/{folder}/rows").select("bucket").distinct() \
            .limit(BUCKET_LIMIT + 1).collect() if not rows.isEmpty() else []
        state = {**state, "version": version, "filter": f"{folder}/filter", "schema": rows.schema.json(),
                 "folders": {**state["folders"], **{str(r["bucket"]): f"{folder}/rows/bucket={r['bucket']}" for r in now}}}
        write_manifest(self.spark, f"{self.path}/_state.json", state)
        return state

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> None:
        """A new table of rows that have one row per key."""
        if buckets > BUCKET_LIMIT:
            raise ValueError(f"at most {BUCKET_LIMIT} buckets")
        rows = materialize(rows)
        bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * rows.count()).bit_length()))
        self._write(rows, _filter_of(rows, self.keys, bits), {"buckets": buckets, "bits": bits, "folders": {}}, 0)

    def _read(self, folders: list[str], schema) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        from pyspark.sql.types import StructType
        import json

        state = self.state
        return self._read(sorted(state["folders"].values()), StructType.fromJson(json.loads(state["schema"])))

    def merge(self, incoming: DataFrame, seq: str) -> list[int]:
        """Insert the rows whose key isn't there; among rows of one key the
        first (smallest ``seq``) counts. Keys that the filter doesn't know are
        new without a look at the table; the others are compared with the keys
        of their own buckets only. Buckets that get a row are written anew,
        all others keep their files. Returns the buckets written."""
        from pyspark.sql.types import StructType
        import json

        state = self.state
        schema = StructType.fromJson(json.loads(state["schema"]))
        payload = [c for c in schema.names if c not in self.keys]
        first = incoming.groupBy(*self.keys).agg(F.min_by(F.struct(*payload), F.col(seq)).alias("_r")) \
            .select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in payload])
        known = self.spark.read.schema("word bigint, bits bigint").parquet(f"{self.path}/{state['filter']}")
        asked = first.withColumn("_at", _place(self.keys, state["bits"])).join(F.broadcast(known), F.shiftright("_at", 6) == F.col("word"), "left")
        seen = F.coalesce(F.expr("shiftright(bits, cast(_at & 63 as int)) & 1") == 1, F.lit(False))
        asked = materialize(asked.select(*schema.names, _bucket(self.keys, state["buckets"]).alias("_b"), seen.alias("_seen")))
        maybe = asked.where("_seen")
        touched = [str(r["_b"]) for r in maybe.select("_b").distinct().limit(BUCKET_LIMIT + 1).collect()]
        stored = self._read([state["folders"][b] for b in touched if b in state["folders"]], schema)
        new = materialize(asked.where("NOT _seen").drop("_seen")
                          .unionByName(maybe.drop("_seen").join(stored.select(*self.keys), self.keys, "left_anti")))
        buckets = sorted(r["_b"] for r in new.select("_b").distinct().limit(BUCKET_LIMIT + 1).collect())
        if not buckets:
            return []
        old = self._read([state["folders"][str(b)] for b in buckets if str(b) in state["folders"]], schema)
        rows = old.unionByName(new.drop("_b"))
        bits = known.unionByName(_filter_of(new, self.keys, state["bits"])).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        self._write(rows, bits, state, state["version"] + 1)
        return buckets
