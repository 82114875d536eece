"""Chunks of whole rows, and questions about hashes that chunks put to buckets.

An operator over all word windows of a corpus would shuffle one row per
window. Instead the input is landed once as chunks (about ``CHUNK_BYTES`` of
text: whole rows as compressed Arrow data, all columns of any name), in a table
bucketed by chunk: a file a chunk up to ``LOOSE_BYTES`` of text, which moves
nothing, beyond that a file of about ``FILE_BYTES`` of text a bucket. A chunk
sends each distinct hash once, packed by hash bucket; a bucket answers every
chunk in the order asked. Answers join the chunk table without moving it, and
the chunk is worked through again, which gives the same hashes in the same
order. A frequent window costs one entry a chunk.

Only buckets that hold a hash are visited, so a chunk's time doesn't depend on
their number; how many rows it sends does, up to one a hash where there are
more buckets than hashes in a chunk."""

from __future__ import annotations

import uuid
from collections import namedtuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm.worker import tidy
from langmix.session import scratch_path, ship_package

CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20    # text per hash bucket, about
MIN_BUCKETS = 64
MAX_BUCKETS = 1 << 24
FILE_BYTES = 32 << 20     # text per file of the chunk table, about
FILES = (8, 100_000)      # at least and at most (Spark's own bound on buckets)
LOOSE_BYTES = 64 << 30    # text up to which chunks aren't dealt out before they are written

#: the chunk table, the number of hash buckets, the folder of its files and their number
Store = namedtuple("Store", "table buckets path files")


def _slices(batch, place: int):
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + CHUNK_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def dump(batch) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def load(data):
    import pyarrow as pa

    return pa.ipc.open_stream(data.as_buffer() if hasattr(data, "as_buffer") else data).read_next_batch()


def pack(docs: DataFrame, text_col: str) -> Store:
    """The rows as a chunk table (``chunk``, ``data``). It has no entry in the
    catalog any more when this returns; its files go with :func:`drop`."""
    spark = docs.sparkSession
    ship_package(spark)
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _slices(batch, place):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([dump(part)], pa.binary())],
                                                 names=["chunk", "data"])
                chunk += 1

    name, path = f"chunks_{uuid.uuid4().hex}", scratch_path(spark, "chunks")
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    packed = docs.mapInArrow(tidy(run), "chunk bigint, data binary")
    if size > LOOSE_BYTES:
        files = min(FILES[1], max(FILES[0], -(-size // FILE_BYTES)))
        packed = packed.repartition(files, "chunk")
    else:
        files = min(FILES[1], max(FILES[0], int(spark.conf.get("spark.sql.shuffle.partitions"))))
    (packed.write.bucketBy(files, "chunk")
         .option("path", path).option("parquet.block.size", 32 << 20).saveAsTable(name))
    table = spark.table(name).select("chunk", "data")
    spark.sql(f"DROP TABLE {name}")   # the plan keeps files and buckets; external files stay
    buckets = MIN_BUCKETS
    while buckets < MAX_BUCKETS and buckets * BUCKET_BYTES < size:
        buckets *= 2
    return Store(table, buckets, path, files)


def drop(store: Store) -> None:
    """Remove the files of a chunk table that no result depends on any more."""
    spark = store.table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store.path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def occupied(hashes, buckets: int):
    """(buckets, by their top bits, that hold some of the sorted hashes; where each begins, and the end)."""
    import numpy as np

    top = (hashes >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if len(top) else np.zeros(0, np.int64)
    return top[new].tolist(), [*new.tolist(), len(top)]


def spread_answers(hashes, buckets: int, got: dict, field: str):
    """The flags that the buckets answered, in the order of the sorted hashes; false where there is no answer."""
    import numpy as np

    own, at = occupied(hashes, buckets)
    return np.concatenate([*[flags(got[b][field] if b in got else None, at[i + 1] - at[i]) for i, b in enumerate(own)],
                           np.zeros(0, bool)])


def short(hashes, buckets: int):
    """The 32 bits below the bucket's bits."""
    import numpy as np

    return (hashes << np.uint64(buckets.bit_length() - 1) >> np.uint64(32)).astype(np.uint32)


def bits(flags) -> bytes:
    import numpy as np

    return np.packbits(flags).tobytes()


def flags(data: bytes | None, n: int):
    import numpy as np

    if not data:
        return np.zeros(n, bool)
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def with_answers(store: Store, answers: DataFrame, fields: list[str], how: str = "left") -> DataFrame:
    """Chunks with the answers they got, as ``got``: array of structs. Answers
    are dealt as the table's files are: Spark would deal out both sides anew
    for a table of fewer files than ``spark.sql.shuffle.partitions``."""
    per_chunk = answers.repartition(store.files, "chunk").groupBy("chunk").agg(F.collect_list(F.struct(*fields)).alias("got"))
    return store.table.join(per_chunk, "chunk", how)
