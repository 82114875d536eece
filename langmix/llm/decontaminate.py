"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (``MIN_MATCH`` equal words in
a row, found by Karp-Rabin hashes) are tiled: the longest match of words not
yet covered in either text is marked, again and again, down to ``MIN_MATCH``
words; of equally long matches the one that begins first in the document goes
first, then the one that begins first in the item. An item leaks into a
document if the marked share of its words reaches ``COVERAGE``; the tiles'
order doesn't matter, so passages that were reordered are found too.

The longest match is found by halving its length: running hashes tell for any
length in one linear pass whether both texts have a window of it, so texts in
which one word or phrase repeats cost no more than others.

Words are runs of letters and digits, lower-cased; in scripts written without
spaces (Chinese, Japanese, Thai and its neighbours) each letter is a word. An
item shorter than ``MIN_MATCH`` words leaks where all its words stand in a row;
null and empty texts match nothing. Repeated items or documents are treated
each; extra columns pass through; the operator's own columns replace those of
the same names; empty tables give no leaks.

Items travel as one broadcast while their text has at most ``block_bytes``.
Beyond that, seeds are joined in Spark: of every item its rarest seeds, so many
that the others can't cover the asked share; of every chunk of documents each
distinct seed that a filter of fixed size lets through. Chunks then get the
items that they share a seed with, a bounded part at a time."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm import chunks
from langmix.llm.common import land, table, without
from langmix.llm.worker import slices, tidy
from langmix.session import ship_package

MIN_MATCH = 4
COVERAGE = 0.5
BLOCK_BYTES = 16 << 20   # benchmark text in the broadcast, or with one chunk of documents at a time, about
FILTER_BITS = 26         # log2 of the seed filter's bits: 8 MB whatever the benchmark
SKETCH_BITS = 18         # log2 of the counters by which seeds are rare: 2 MB whatever the documents
BASE = 0x9E3779B97F4A7C15

#: Thai, Lao, Myanmar, Khmer; kana; Han with its extensions; halfwidth kana
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff" \
            "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_ASCII_WORD = re.compile(r"[^\W_]+").findall
_WORD = re.compile(rf"[^\W_{_UNSPACED}]+|[^\W_]").findall


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return (_ASCII_WORD if text.isascii() else _WORD)(text.lower())


def rolling(ids, k: int):
    """Karp-Rabin hashes of all windows of k word ids, modulo 2**64."""
    import numpy as np

    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x, h = ids.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(BASE) + x[j:j + n] * x[j:j + n] + x[j:j + n]
    return h ^ (h >> np.uint64(31))


class Running:
    """Hashes of all windows of any length, from the prefix sums of one pass."""

    def __init__(self, ids):
        import numpy as np
        from langmix.llm.words import _powers, mix

        power, self.inverse = _powers(len(ids) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64)) * power[:len(ids)])))

    def of(self, k: int):
        n = max(0, len(self.sums) - k)
        return (self.sums[k:] - self.sums[:n]) * self.inverse[:n]


def _among(h, asked):
    """Which of h are among the asked hashes."""
    import numpy as np

    asked = np.sort(asked)
    return asked[np.minimum(np.searchsorted(asked, h), len(asked) - 1)] == h if len(asked) else np.zeros(len(h), bool)


_DOC_USED, _ITEM_USED = -3, -2   # ids of marked words: equal to none


def _free(item, n: int):
    """Places of the item's windows of n words without a marked one."""
    import numpy as np

    used = np.concatenate(([0], np.cumsum(item == _ITEM_USED)))
    return np.flatnonzero(used[n:] == used[:len(used) - n])


def tile(doc, item, k: int) -> int:
    """Words of the item under tiles. Unknown words of the document are below 0."""
    import numpy as np

    doc, item = doc.copy(), item.copy()
    top = min(len(doc), len(item))
    while top >= k:
        d, p = Running(doc), Running(item)

        def meet(n: int):
            """Document places of the windows of n words that the item has unmarked."""
            return np.flatnonzero(_among(d.of(n), p.of(n)[_free(item, n)]))

        low, high, at = k - 1, top, np.zeros(0, np.int64)   # at: the places for length low
        n = k
        while low < high:   # whether a length is met at all falls once, from lengths that are to those that aren't
            got = meet(n)
            low, high, at = (n, high, got) if len(got) else (low, n - 1, at)
            n = (low + high + 1) // 2 if n != k else high
        if low < k:
            break
        n, h = low, d.of(low)
        theirs = p.of(n)
        while len(at):
            a, free = int(at[0]), _free(item, n)
            b = next((b for b in free[theirs[free] == h[a]].tolist() if (item[b:b + n] == doc[a:a + n]).all()), None)
            if b is None:   # equal hashes of different words
                at = at[1:]
                continue
            doc[a:a + n], item[b:b + n] = _DOC_USED, _ITEM_USED
            at = at[at >= a + n]
            at = at[_among(h[at], theirs[_free(item, n)])]
        top = n - 1
    return int((item == _ITEM_USED).sum())


def islands(ids, at, k: int):
    """The words under windows of k words at the given places; -1 where words between were left out."""
    import numpy as np

    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    kept = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    return np.insert(ids[kept], np.flatnonzero(np.diff(kept) > 1) + 1, -1)


class Seeds:
    """Index of some items: word ids, distinct seed hashes, and for each the (item, place) entries.
    Items shorter than a seed are kept whole: their ids by length and hash."""

    def __init__(self, items: list[tuple], k: int = MIN_MATCH):
        import numpy as np

        self.k, self.vocab = k, {}
        self.items, self.short = [], {}
        for item_id, text in items:
            w = words(text)
            ids = np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int64)
            if len(w) >= k:
                self.items.append((item_id, ids))
            elif len(w):
                self.short.setdefault(len(w), {}).setdefault(tuple(ids.tolist()), []).append(item_id)
        self.short_hashes = {n: np.concatenate([rolling(np.array(i, np.int64), n) for i in whole])
                             for n, whole in self.short.items()}
        hashes = [rolling(ids, k) for _, ids in self.items]
        which = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")   # entries of a seed by item and place
        self.which, self.place = which[order], place[order]
        self.hashes, self.first = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.concatenate((self.first, [len(flat)])))
        self.lengths = np.array([len(ids) for _, ids in self.items], np.int64)

    def seeds_of(self, ids):
        """(places of a document's windows that are seeds, number of each seed)."""
        import numpy as np

        h = rolling(ids, self.k)
        if not len(h) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        at = np.flatnonzero(known[self.k:] - known[:len(h)] == self.k)
        seed = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[seed] == h[at]
        return at[hit], seed[hit]

    def candidates(self, seeds, coverage: float):
        """(item, its seeds among the given) where words under seeds could cover the share."""
        import numpy as np

        n = self.count[seeds]
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[seeds], n)
        seed = np.repeat(seeds, n)
        order = np.lexsort((self.place[row], self.which[row]))
        which, place, seed = self.which[row][order], self.place[row][order], seed[order]
        new = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else np.zeros(0, np.int64)
        step = np.full(len(which), self.k)
        step[:-1] = np.where(which[1:] == which[:-1], np.minimum(self.k, np.diff(place)), self.k)
        under = np.add.reduceat(step, new) if len(new) else new
        ends = np.concatenate((new[1:], [len(which)]))
        for a, b, words_under in zip(new.tolist(), ends.tolist(), under.tolist()):
            if words_under >= coverage * self.lengths[which[a]]:
                yield int(which[a]), np.unique(seed[a:b])

    def whole(self, ids) -> list:
        """Ids of the short items that stand in a text as a whole."""
        import numpy as np

        found = []
        for n, items in self.short.items():
            at = np.flatnonzero(_among(rolling(ids, n), self.short_hashes[n]))
            windows = np.unique(ids[at[:, None] + np.arange(n)], axis=0) if len(at) else np.zeros((0, n), np.int64)
            for seen in map(tuple, windows.tolist()):   # the hashes only propose
                found += items.get(seen, [])
        return found


def leaks(text: str | None, seeds: Seeds, coverage: float = COVERAGE) -> list[tuple[object, float]]:
    """(item id, covered share) of the items that leak into a text."""
    import numpy as np

    w = words(text)
    if not w or not seeds.vocab:
        return []
    ids = np.fromiter(map(seeds.vocab.get, w, [-1] * len(w)), np.int64, len(w))
    out = [(item_id, 1.0) for item_id in seeds.whole(ids)]
    at, seed = seeds.seeds_of(ids)
    for which, own in seeds.candidates(np.unique(seed), coverage):
        item_id, item = seeds.items[which]
        hit = own[np.minimum(np.searchsorted(own, seed), len(own) - 1)] == seed
        share = tile(islands(ids, at[hit], seeds.k), item, seeds.k) / len(item)
        if share >= coverage:
            out.append((item_id, share))
    return out


def _columns(docs: DataFrame, keep: list[str]) -> str:
    return ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep],
                      "leak_items array<bigint>", "leak_coverage double"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", coverage: float = COVERAGE, min_match: int = MIN_MATCH,
               block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """All documents with ``leak_items`` (ids, ascending) and
    ``leak_coverage`` (the largest share, 0 without a leak)."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = without(docs, "leak_items", "leak_coverage")
    keep = docs.columns if keep is None else keep
    used = list(dict.fromkeys([*keep, text_col]))   # the text moves once
    src, text = docs.select(*[F.col(f"`{c}`") for c in used]), used.index(text_col)
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text")) \
        .where("text IS NOT NULL")
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > block_bytes:
        return _join_seeds(src, items, text, len(keep), _columns(docs, keep), coverage, min_match, block_bytes)
    shared = spark.sparkContext.broadcast(sorted(((r["id"], r["text"]) for r in items.collect()),
                                                 key=lambda x: (x[0] is None, x)))
    return src.mapInArrow(tidy(_meet(shared, coverage, min_match, text, len(keep))), _columns(docs, keep))


def _result(columns, names, got):
    import pyarrow as pa

    ids = [sorted({i for i, _ in found if i is not None}) for found in got]
    most = [max([s for _, s in found], default=0.0) for found in got]
    return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int64())), pa.array(most, pa.float64())],
                                      names=[*names, "leak_items", "leak_coverage"])


def _meet(shared, coverage: float, min_match: int, text: int, kept: int):
    def run(batches):
        seeds = Seeds(shared.value, min_match)
        for batch in slices(batches):
            yield _result(batch.columns[:kept], batch.schema.names[:kept],
                          [leaks(x.as_py(), seeds, coverage) for x in batch.column(text)])
    return run


# --- a benchmark of any size: seeds joined in Spark ---------------------------------

def _word_hashes(text: str | None, known: dict):
    """Word ids that are equal in all tasks: 64 bits of a digest."""
    import numpy as np

    if len(known) > 1 << 18:
        known.clear()
    w = words(text)
    for x in set(w).difference(known):
        known[x] = int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little")
    return np.array([known[x] for x in w], np.uint64)


def _seed_hashes(ids, k: int):
    """Windows of k words, each a 64-bit hash that its length is part of."""
    import numpy as np
    from langmix.llm.words import mix

    return mix(rolling(ids, k) ^ np.uint64(k * BASE % 2**64))


def _count_seeds(text: int, k: int):
    """How often the documents' seeds fall on each counter, one row of slices a task."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, counts = {}, np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for data in batch.column("data"):
                for x in chunks.load(data).column(text):
                    h = _seed_hashes(_word_hashes(x.as_py(), known), k)
                    counts += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        parts = np.split(counts, 64)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([x.tolist() for x in parts])],
                                         names=["slice", "counts"])
    return run


def rare_seeds(ids, k: int, coverage: float, counts):
    """The rarest seeds of an item, so many that a text without any of them can't cover the share;
    of an item shorter than a seed its whole."""
    import numpy as np

    if len(ids) < k:
        return _seed_hashes(ids, len(ids))
    h = _seed_hashes(ids, k)
    order = np.argsort(counts[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    low, high = 1, len(h)   # seeds taken; without them the share must be out of reach
    while low < high:
        n = (low + high) // 2
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, order[n:], 1)
        np.add.at(edge, order[n:] + k, -1)
        low, high = (low, n) if (np.cumsum(edge)[:-1] > 0).sum() < coverage * len(ids) else (n + 1, high)
    return np.unique(h[order[:low]])


def _item_seeds(shared, k: int, coverage: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts, known = np.frombuffer(shared.value, np.int64), {}
        for batch in batches:
            got = [rare_seeds(_word_hashes(x.as_py(), known), k, coverage, counts) for x in batch.column("text")]
            n = [len(x) for x in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(np.repeat(np.arange(len(n)), n))),
                 pa.array(np.repeat([min(k, m) for m in batch.column("words").to_pylist()], n).astype(np.int32)),
                 pa.array(np.concatenate([*got, np.zeros(0, np.uint64)]).view(np.int64))], names=["item", "n", "seed"])
    return run


def _chunk_seeds(shared, lengths: list[int], text: int):
    """Each distinct seed of a chunk that the filter lets through."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, bits = {}, np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            for chunk, data in zip(batch.column("chunk"), batch.column("data")):
                own = [_word_hashes(x.as_py(), known) for x in chunks.load(data).column(text)]
                h = np.unique(np.concatenate([_seed_hashes(x, n) for x in own for n in lengths] or [np.zeros(0, np.uint64)]))
                bit = h & np.uint64((1 << FILTER_BITS) - 1)
                h = h[(bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()] * len(h), pa.int64()), pa.array(h.view(np.int64))],
                                                 names=["chunk", "seed"])
    return run


def _tile_chunks(text: int, k: int, coverage: float):
    """The leaks of a chunk's rows among the items that it got."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                rows = chunks.load(batch.column("data")[i])
                seeds = Seeds([(g["id"], g["text"]) for g in batch.column("items")[i].as_py()], k)
                got = [(r, *hit) for r, x in enumerate(rows.column(text)) for hit in leaks(x.as_py(), seeds, coverage)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("chunk")[i].as_py()] * len(got), pa.int64()),
                     pa.array([r for r, *_ in got], pa.int32()), pa.array([x for _, x, _ in got], pa.int64()),
                     pa.array([s for *_, s in got], pa.float64())], names=["chunk", "row", "item", "share"])
    return run


def _rows_with_leaks(kept: int):
    def run(batches):
        for batch in batches:
            for data, got in zip(batch.column("data"), batch.column("got")):
                rows = chunks.load(data)
                found = [[] for _ in range(rows.num_rows)]
                for g in got.as_py() or ():
                    found[g["row"]] = [*[(i, 0.0) for i in g["items"]], (None, g["share"])]
                yield _result(rows.columns[:kept], rows.schema.names[:kept], found)
    return run


def _join_seeds(src: DataFrame, items: DataFrame, text: int, kept: int, schema: str, coverage: float, k: int,
                block_bytes: int) -> DataFrame:
    spark = src.sparkSession
    store = chunks.pack(src, src.columns[text])
    packed = store.table
    counts = packed.mapInArrow(tidy(_count_seeds(text, k)), "slice int, counts array<bigint>") \
        .select("slice", F.posexplode("counts").alias("place", "n")).groupBy("slice", "place").agg(F.sum("n").alias("n"))
    total = bytearray(8 << SKETCH_BITS)   # a row a counter, whatever the documents
    import numpy as np
    view = np.frombuffer(total, np.int64)
    for r in counts.where("n > 0").collect():
        view[r["slice"] * (len(view) // 64) + r["place"]] = r["n"]
    sketch = spark.sparkContext.broadcast(bytes(total))
    items = land(_numbered(items), "benchmark")
    wanted = land(items.mapInArrow(tidy(_item_seeds(sketch, k, coverage)), "item bigint, n int, seed bigint"), "item-seeds")
    lengths = sorted(r["n"] for r in wanted.select("n").distinct().collect())   # k at most
    mask = (1 << FILTER_BITS) - 1
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    for r in wanted.groupBy(F.shiftright(F.col("seed").bitwiseAND(mask), 6).alias("word")) \
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("bits")).collect():
        bits[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    shared = spark.sparkContext.broadcast(bits.tobytes())
    asked = packed.mapInArrow(tidy(_chunk_seeds(shared, lengths, text)), "chunk bigint, seed bigint")
    pairs = land(asked.join(wanted.select("item", "seed"), "seed").select("chunk", "item").distinct()
                 .join(items.select("item", F.octet_length("text").alias("bytes")), "item"), "chunk-items")
    parts = pairs.groupBy("chunk").agg(F.ceil(F.sum(F.col("bytes") + 64) / block_bytes).cast("int").alias("parts"))
    blocks = pairs.join(parts, "chunk").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts"))) \
        .join(items.select("item", "id", "text"), "item").groupBy("chunk", "part") \
        .agg(F.collect_list(F.struct("id", "text")).alias("items")).repartition(store.files, "chunk")
    found = packed.join(blocks, "chunk").select("chunk", "data", "items") \
        .mapInArrow(tidy(_tile_chunks(text, k, coverage)), "chunk bigint, row int, item bigint, share double")
    per_row = found.groupBy("chunk", "row").agg(F.collect_set("item").alias("items"), F.max("share").alias("share"))
    return chunks.with_answers(store, per_row, ["row", "items", "share"]).mapInArrow(tidy(_rows_with_leaks(kept)), schema)


def _numbered(items: DataFrame) -> DataFrame:
    """(item, id, text, words) of the items with words; equal ones are one, numbered by digest."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = pa.array([len(words(x.as_py())) for x in batch.column("text")], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=["id", "text", "words"])

    return items.distinct().mapInArrow(run, "id bigint, text string, words int").where("words > 0") \
        .select(F.xxhash64("id", "text").alias("item"), "id", "text", "words")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaks, with their own columns, whatever their names."""
    own = {"leak_items", "leak_coverage"} & {c.lower() for c in docs.columns}
    if not own:
        return find_leaks(docs, benchmark).where("leak_coverage = 0").drop("leak_items", "leak_coverage")
    named = [f"c{i}" for i in range(len(docs.columns))]   # out of the way of the operator's columns
    text = named[[c.lower() for c in docs.columns].index("text")]
    return find_leaks(docs.toDF(*named), benchmark, text_col=text).where("leak_coverage = 0") \
        .drop("leak_items", "leak_coverage").toDF(*docs.columns)


def op10_string_tiling(spark, sf_dir):
    """Benchmark items that leak into each whole document."""
    got = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return got.select("doc_id", (F.col("leak_coverage") > 0).alias("leaked"),
                      F.round("leak_coverage", 6).alias("coverage"), F.col("leak_items").alias("item_ids"))


QUERIES = {"op10_string_tiling": op10_string_tiling}
SQL: dict[str, str] = {}
