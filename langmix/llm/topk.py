"""Exact top-k inner products by multi-resolution segment statistics.

Every vector is cut into segments at several resolutions. With a segment's
mean m and deviation d (over length n), the part of an inner product that
falls into it is at most n (m m' + d d') by Cauchy-Schwarz; summed over the
segments this bounds the whole product from above, that is, the distance of
the two vectors from below.

Candidates are ordered by the one of ``PIVOTS`` sampled vectors that they are
most similar to, and cut into blocks of ``BLOCK``. The ranges of a block's means and deviations
bound every product with it, so a query is shipped to those blocks only that
can still reach its floor: the k-th best of its exact products with a sample of
``SAMPLE`` candidates. Where a query meets a block, a coarse bound of every pair
comes first, then finer ones for pairs that can still reach the query's k-th
best score, then exact products for the survivors. The bounds only skip work:
results are exact. On vectors without any structure every query meets every
block, and one matrix product takes the place of pairs.

Block statistics travel as broadcasts of ``STATS_BYTES`` at most, one after the
other. Each meeting leaves at most k rows per query, and a window with a group
limit keeps the best.

Vectors that are null, hold a null, NaN or infinite component, or have no id
take no part. Shorter vectors count as padded with zeros. Rows repeated under
one id are candidates each; a query id is searched once (its smallest vector),
against all rows with another id. Ties go to the smaller id. Components are
whole numbers in doubles; where products could pass 52 bits, they are computed
in integers of any size, and a score beyond 64 bits counts as 2**63 - 1 (or its
negative). Other columns are ignored; empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langmix.llm.common import land, table
from langmix.llm.worker import tidy
from langmix.session import ship_package

SCALE = 64
SEGMENTS = (1, 4, 16)   # segments of a vector, coarse to fine
BLOCK = 1024            # candidate vectors in a block
QUERY_BLOCK = 512
PIVOTS = 128            # sampled vectors around which candidates are ordered
CLOSE = 0.8             # cosine from which two sampled vectors are one pivot
SAMPLE = 2048           # candidates that give every query its first floor
STATS_BYTES = 32 << 20  # block statistics in one broadcast
QUERY_BLOCK_MOST = 1 << 15   # queries of a block have numbers in 16 bits
FLOOR_BLOCKS = 2048     # query blocks whose floors a task remembers
PAIRS = 1 << 17         # pairs whose vectors are gathered at once
DENSE = 0.1             # above this share of pairs left, one matrix product is cheaper than pairs
SEED = 31
MOST = (1 << 63) - 1      # larger scores count as this
LARGEST = 2.0**1018      # larger scaled components count as this

_BLOCKS = "block bigint, n int, dim int, kind string, ids binary, data binary, stats binary"
_ASKED = "block bigint, q_block bigint, q_n int, q_dim int, q_kind string, q_ids binary, q_data binary, q_floor binary, " \
         "q_bound binary, q_at binary"
_HITS = "query_id bigint, vec_id bigint, score bigint"


def _matrix(vecs, width: int = 0):
    """Arrow lists as rows of whole numbers, padded with zeros."""
    import numpy as np

    lengths = vecs.value_lengths().to_numpy(zero_copy_only=False)
    dim = max(width, int(lengths.max()) if len(vecs) else 0)
    out = np.zeros((len(vecs), dim))
    out[np.arange(dim) < lengths[:, None]] = vecs.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * out), -LARGEST, LARGEST)


def _place(shared):
    """Every vector with the pivot that it is most similar to, and how much, by which similar ones stand together."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        pivots = directions(shared.value[1])
        for batch in batches:
            x = _matrix(batch.column("vec"), pivots.shape[1])
            near = np.nan_to_num(_bounds(x, np.pad(pivots, ((0, 0), (0, x.shape[1] - pivots.shape[1]))))) \
                if len(pivots) else np.zeros((len(x), 1))
            key = near.argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.astype(np.int64)), pa.array(near[np.arange(len(x)), key])],
                                             names=[*batch.schema.names, "key", "lead"])
    return run


def directions(sample):
    """Unit vectors of up to ``PIVOTS`` of the sample, none close to another."""
    import numpy as np

    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((sample * sample).sum(1))
    unit = sample[(length > 0) & np.isfinite(length)] / length[(length > 0) & np.isfinite(length)][:, None]
    out: list[int] = []
    for i in range(len(unit)):
        if len(out) < PIVOTS and (not out or (unit[out] @ unit[i]).max() < CLOSE):
            out.append(i)
    return unit[out]


def _cuts(key, size: int) -> list[int]:
    """Where blocks begin, and the end: after ``size`` rows, or where the pivot changes and half is full."""
    import numpy as np

    out, change = [0], (np.flatnonzero(np.diff(key)) + 1).tolist()
    for at in [*change, len(key)]:
        while at - out[-1] > size:
            out.append(out[-1] + size)
        if at - out[-1] >= size // 2 and at < len(key):
            out.append(at)
    return [*out, len(key)] if len(key) else [0]


def _packed(x) -> tuple[str, bytes]:
    """Whole numbers in the smallest type that holds them."""
    import numpy as np

    most = float(np.abs(x).max()) if x.size else 0.0
    kind = "int16" if most < 2**15 else "int32" if most < 2**31 else "float64"
    return kind, x.astype(kind).tobytes()


def _unpack(n: int, dim: int, kind: str, ids: bytes, data: bytes, width: int):
    import numpy as np

    whole = np.zeros((n, width))
    whole[:, :dim] = np.frombuffer(data, kind).reshape(n, dim)
    return np.frombuffer(ids, np.int64), whole


def _padded(feature, segments: int):
    """(means, deviations) with a column for every segment of the finest level, also where vectors have fewer components."""
    import numpy as np

    own = feature.shape[1] // 2
    out = np.zeros((2, len(feature), segments))
    out[0, :, :own], out[1, :, :own] = feature[:, :own], feature[:, own:]
    return out


def _pack(size: int, with_stats: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in _BLOCKS.split(", ")]
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            cuts = _cuts(batch.column("key").to_numpy(zero_copy_only=False), size)
            for at, end in zip(cuts, cuts[1:]):
                part = slice(at, end)
                order = np.argsort(ids[part], kind="stable")
                x = _matrix(batch.column("vec").slice(at, end - at))[order]
                kind, data = _packed(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([len(order)], pa.int32()), pa.array([x.shape[1]], pa.int32()),
                     pa.array([kind]), pa.array([ids[part][order].astype(np.int64).tobytes()], pa.binary()),
                     pa.array([data], pa.binary()), pa.array([ranges(x).tobytes() if with_stats else None], pa.binary())], names=names)
                block += 1
    return run


def ranges(x):
    """What bounds a block's products: for each finest segment, scaled by the root of its length, the largest and the
    smallest mean and the largest deviation; the number of components, as segments depend on it."""
    import numpy as np

    means, deviations = _padded(features(x, SEGMENTS[-1]), SEGMENTS[-1]) if x.shape[1] else np.zeros((2, len(x), SEGMENTS[-1]))
    return np.concatenate((means.max(0), means.min(0), deviations.max(0), [x.shape[1]]))


def block_bounds(q, stats):
    """Upper bound of the products of each query with anything in each block (rows of :func:`ranges`)."""
    import numpy as np

    out = np.empty((len(q), len(stats)))
    for dim in np.unique(stats[:, -1]):
        own = stats[:, -1] == dim
        cut = q[:, :int(dim)]   # the block's vectors are zero beyond
        if cut.shape[1] < dim:
            cut = np.pad(cut, ((0, 0), (0, int(dim) - cut.shape[1])))
        if not dim:
            out[:, own] = 0
            continue
        means, deviations = _padded(features(cut, SEGMENTS[-1]), SEGMENTS[-1])
        mine = np.concatenate((np.maximum(means, 0), np.minimum(means, 0), deviations), 1)
        out[:, own] = _bounds(mine, stats[own, :-1])
    return out


def features(x, segments: int):
    """[sqrt(n) mean, sqrt(n) deviation] of each segment: the dot product of
    two vectors' features is the upper bound of their inner product."""
    import numpy as np

    parts = [p for p in np.array_split(x, min(segments, x.shape[1]), axis=1) if p.shape[1]]
    roots = [np.sqrt(p.shape[1]) for p in parts]
    with np.errstate(over="ignore", invalid="ignore"):   # huge components have infinite bounds
        return np.stack([r * p.mean(1) for r, p in zip(roots, parts)] + [r * p.std(1) for r, p in zip(roots, parts)], 1)


def _bounds(a, b):
    """Bounds of all pairs of features; infinite where they can't be told."""
    import numpy as np

    with np.errstate(over="ignore", invalid="ignore"):
        out = a @ b.T
    out[np.isnan(out)] = np.inf
    return np.maximum(out, -float(MOST))   # no score counts for less


def _slack(bound) -> float:
    """What rounding may take from a bound."""
    import numpy as np

    finite = np.abs(bound[np.isfinite(bound)])
    return float("inf") if np.isposinf(bound).any() else 0.5 + 1e-9 * float(finite.max() if finite.size else 0)


def _whole(x):
    """The same numbers as integers of any size."""
    import numpy as np

    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def search(q, q_ids, x, x_ids, k: int, floor):
    """Rows (query index, candidate index, score): the k best of each query
    among candidates that can reach ``floor`` (a score known to be reached k
    times elsewhere). Candidates are ordered by id."""
    import numpy as np

    q, x = np.asarray(q, float), np.asarray(x, float)
    if not len(q) or not len(x) or not q.shape[1]:
        empty = np.zeros(0, np.int64)
        if not len(q) or not len(x):
            return empty, empty, empty
        q, x = np.zeros((len(q), 1)), np.zeros((len(x), 1))
    with np.errstate(over="ignore"):
        exact = np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**52
    qf, xf = (q, x) if exact else (_whole(q), _whole(x))

    def products(a, b, r, c):
        out = np.empty(len(r), a.dtype)
        for at in range(0, len(r), PAIRS):
            part = slice(at, at + PAIRS)
            out[part] = np.einsum("ij,ij->i", a[r[part]], b[c[part]]) if a.dtype != object else (a[r[part]] * b[c[part]]).sum(1)
        return out

    levels = [(features(q, s), features(x, s)) for s in SEGMENTS]
    bound = _bounds(*levels[0])
    slack = _slack(bound)
    own = q_ids[:, None] == x_ids[None, :]
    bound[own] = -np.inf
    if len(x) > 2 * k:  # exact scores of the k most promising give a first floor
        first = np.argpartition(-bound, k, axis=1)[:, :k]
        r = np.repeat(np.arange(len(q)), k)
        seen = products(qf, xf, r, first.ravel()).reshape(len(q), k)
        seen = seen if exact else np.array([[float(max(-MOST, min(MOST, v))) for v in row] for row in seen.tolist()])
        seen[np.take_along_axis(own, first, 1)] = -np.inf
        floor = np.maximum(floor, seen.min(1))
    alive = (bound > floor[:, None] - slack) & ~own
    share = alive.mean()
    for a, b in levels[1:]:
        before = share
        if before > DENSE:
            alive &= _bounds(a, b) > floor[:, None] - slack
        else:
            r, c = np.nonzero(alive)
            alive[r, c] = ~(np.maximum(products(a, b, r, c), -float(MOST)) <= floor[r] - slack)
        share = alive.mean()
        if share > DENSE and share > 0.9 * before:
            break   # finer bounds would cost more than they save
    if share > DENSE and exact:
        every = np.where(alive, qf @ xf.T, -np.inf)
        if len(x) > k:
            alive &= every >= np.partition(every, len(x) - k, axis=1)[:, len(x) - k, None]
        r, c = np.nonzero(alive)
        score = every[r, c].astype(np.int64)
    else:
        r, c = np.nonzero(alive)
        score = products(qf, xf, r, c)
        score = score.astype(np.int64) if exact else np.array([min(MOST, max(-MOST, int(v))) for v in score], np.int64)
    order = np.lexsort((c, -score, r))
    r, c, score = r[order], c[order], score[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    best = place < k
    return r[best], c[best], score[best]


def _route(shared, sampled, k: int):
    """For each block that some queries of a batch can gain in: these queries, with their floors."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        (blocks, stats), (some_ids, some) = shared.value, sampled.value
        stats = np.frombuffer(stats, float).reshape(len(blocks), 3 * SEGMENTS[-1] + 1)
        names = [x.split()[0] for x in _ASKED.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                width = max(row["dim"], some.shape[1])
                ids, q = _unpack(row["n"], row["dim"], row["kind"], row["ids"], row["data"], width)
                r, _, score = search(q, ids, np.pad(some, ((0, 0), (0, width - some.shape[1]))), some_ids, k, np.full(len(q), -np.inf))
                floor = np.full(len(q), -np.inf)
                full = np.flatnonzero(np.bincount(r, minlength=len(q)) == k)
                floor[full] = score[np.searchsorted(r, full, "right") - 1]
                bound = block_bounds(q, stats)
                slack = _slack(bound)
                alive = bound > floor[:, None] - slack
                for b in np.flatnonzero(alive.any(0)).tolist():
                    own = alive[:, b]
                    kind, data = _packed(q[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([blocks[b]], pa.int64()), pa.array([row["block"]], pa.int64()),
                         pa.array([int(own.sum())], pa.int32()), pa.array([width], pa.int32()), pa.array([kind]),
                         *[pa.array([x], pa.binary()) for x in (ids[own].tobytes(), data, floor[own].tobytes(),
                                                                (bound[own, b] + slack).tobytes(),
                                                                np.flatnonzero(own).astype(np.int16).tobytes())]], names=names)
    return run


def _meet(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        floors: dict[int, np.ndarray] = {}   # of the query blocks met last, raised by what this task found
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                at = np.frombuffer(row["q_at"], np.int16)
                known = floors.pop(row["q_block"], None)
                if known is None:
                    known = np.full(QUERY_BLOCK_MOST, -np.inf)
                floors[row["q_block"]] = known
                if len(floors) > FLOOR_BLOCKS:
                    del floors[next(iter(floors))]
                known[at] = np.maximum(known[at], np.frombuffer(row["q_floor"], float))
                still = np.flatnonzero(np.frombuffer(row["q_bound"], float) > known[at])
                if not len(still):
                    continue
                width = max(row["dim"], row["q_dim"])
                q_ids, q = _unpack(row["q_n"], row["q_dim"], row["q_kind"], row["q_ids"], row["q_data"], width)
                q_ids, q, at = q_ids[still], q[still], at[still]
                x_ids, x = _unpack(row["n"], row["dim"], row["kind"], row["ids"], row["data"], width)
                r, c, score = search(q, q_ids, x, x_ids, k, known[at])
                full = np.flatnonzero(np.bincount(r, minlength=len(q)) == k)
                known[at[full]] = np.maximum(known[at[full]], score[np.searchsorted(r, full, "right") - 1])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(x_ids[c]), pa.array(score)],
                                                 names=["query_id", "vec_id", "score"])
    return run


def route(src: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(candidate blocks, queries by the block that they are shipped to) of rows (id, vec, query)."""
    import numpy as np

    spark = src.sparkSession
    placed = "id bigint, vec array<double>, key bigint, lead double"

    total = src.count()
    some = [] if not total else src.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) < (SAMPLE << 30) // total + 1) \
        .orderBy(F.xxhash64("id"), "vec").limit(2 * SAMPLE).collect()   # any candidates will do
    width = max((len(r["vec"]) for r in some), default=0)
    sample = np.zeros((len(some), width))
    for i, r in enumerate(some):
        with np.errstate(over="ignore"):
            sample[i, :len(r["vec"])] = np.clip(np.floor(SCALE * np.array(r["vec"], float)), -LARGEST, LARGEST)
    sampled = spark.sparkContext.broadcast((np.array([r["id"] for r in some], np.int64), sample))

    def blocks_of(rows: DataFrame, size: int, with_stats: bool, name: str) -> DataFrame:
        near = rows.mapInArrow(tidy(_place(sampled)), placed).repartitionByRange("key", "lead").sortWithinPartitions("key", "lead")
        return land(near.mapInArrow(tidy(_pack(size, with_stats)), _BLOCKS), name)

    cand = blocks_of(src.select("id", "vec"), BLOCK, True, "topk-candidates")
    asked = blocks_of(src.where("query").groupBy("id").agg(F.min("vec").alias("vec")), QUERY_BLOCK, False, "topk-queries")
    n = cand.count()
    parts = max(1, -(-n * 8 * (3 * SEGMENTS[-1] + 1) // STATS_BYTES))
    routed = []
    for part in range(parts):
        own = cand.where(F.pmod(F.xxhash64("block"), F.lit(parts)) == part).select("block", "stats").collect()
        shared = spark.sparkContext.broadcast(([r["block"] for r in own], b"".join(bytes(r["stats"]) for r in own)))
        routed.append(land(asked.mapInArrow(tidy(_route(shared, sampled, k)), _ASKED), "topk-routed"))
    out = routed[0]
    for more in routed[1:]:
        out = out.union(more)
    return cand, out


def usable(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec, query) of the rows that take part."""
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                          F.col(f"`{vec_col}`").cast("array<double>").alias("vec"), is_query.alias("query")) \
        .where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ok)


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best of every query."""
    ship_package(vectors.sparkSession)
    cand, asked = route(usable(vectors, is_query, id_col, vec_col), k)
    hits = cand.drop("stats").join(asked, "block").drop("block").mapInArrow(tidy(_meet(k)), _HITS)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op7_segment_topk(spark, sf_dir):
    """The 20 highest integer inner products of every query vector."""
    emb = table(spark, sf_dir, "embeddings")
    return top_k(emb, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), 20)


QUERIES = {"op7_segment_topk": op7_segment_topk}
SQL = {"op7_segment_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""}
