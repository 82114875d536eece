"""Substring dedup by fixed-block anchors.

Every text is cut into reference blocks of ``BLOCK`` words that don't overlap,
and every rolling window of as many words probes the index of blocks. A repeat
of ``MIN_WORDS`` = 2 * BLOCK - 1 words always holds a whole block of the other
text, so windows without a hit can't be part of one. Around the hits, matches
are extended to all windows of ``MIN_WORDS`` words that repeat exactly, and so
to maximal repeats: the union of the windows a smaller document also has.

A word goes if a window of ``MIN_WORDS`` words covers it whose word sequence
also starts in a document with a smaller id. Windows are judged on the input.
Null and empty texts have no words. Null ids count as larger than all others;
documents of one id don't remove each other's words. Other columns pass
through; the operator's columns replace those of the same names. Hashes of 64
bits stand for word sequences in the extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm import chunks
from langmix.llm.common import table, without
from langmix.llm.worker import tidy

BLOCK = 7
MIN_WORDS = 2 * BLOCK - 1
LAST_ID = (1 << 63) - 1


def _parts(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("chunk")[i].as_py(), chunks.load(batch.column("data")[i]), \
                {g["bucket"]: g for g in (batch.column("got")[i].as_py() or ())} if "got" in batch.schema.names else {}


def _anchors(w):
    """Distinct windows of BLOCK words of a chunk, sorted: (all window places,
    their hashes, distinct hashes, which are some reference block, which
    are in several documents)."""
    import numpy as np

    at, h = w.windows(BLOCK)
    order = np.argsort(h, kind="stable")
    hs, doc = h[order], w.doc[at[order]]
    new = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1]))) if len(hs) else np.zeros(0, np.int64)
    block = (at - w.first_word()[w.doc[at]]) % BLOCK == 0
    if not len(new):
        return at, h, hs, np.zeros(0, bool), np.zeros(0, bool)
    several = np.maximum.reduceat(doc, new) != np.minimum.reduceat(doc, new)
    return at, h, hs[new], np.logical_or.reduceat(block[order], new), several


def _ask_anchors(text: int, buckets: int):
    def run(batches):
        import pyarrow as pa
        from langmix.llm.words import Words

        for chunk, rows, _ in _parts(batches):
            _, _, h, block, several = _anchors(Words(rows.column(text)))
            (own, at), key = chunks.occupied(h, buckets), chunks.short(h, buckets)
            parts = [slice(*x) for x in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array([chunk] * len(own), pa.int64()),
                 pa.array([key[p].tobytes() for p in parts], pa.binary()),
                 pa.array([chunks.bits(block[p]) for p in parts], pa.binary()),
                 pa.array([chunks.bits(several[p]) for p in parts], pa.binary())],
                names=["bucket", "chunk", "keys", "block", "several"])
    return run


def _answer_anchors(group):
    """A window is a hit if some document has it as a block and another has it at all."""
    import numpy as np
    import pyarrow as pa

    keys = [np.frombuffer(x.as_py(), np.uint32) for x in group.column("keys")]
    size = [len(x) for x in keys]
    flat = np.concatenate(keys)
    block = np.concatenate([chunks.flags(x.as_py(), n) for x, n in zip(group.column("block"), size)])
    several = np.concatenate([chunks.flags(x.as_py(), n) for x, n in zip(group.column("several"), size)])
    order = np.argsort(flat, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) != 0)))
    n = np.diff(np.concatenate((new, [len(flat)])))
    hit = np.logical_or.reduceat(block[order], new) & ((n > 1) | np.logical_or.reduceat(several[order], new))
    back = np.empty(len(flat), bool)
    back[order] = np.repeat(hit, n)
    parts = np.split(back, np.cumsum(size)[:-1])
    any_hit = [p.any() for p in parts]
    return pa.table({"chunk": pa.array([c for c, a in zip(group.column("chunk").to_pylist(), any_hit) if a], pa.int64()),
                     "bucket": pa.array([group.column("bucket")[0].as_py()] * sum(any_hit), pa.int32()),
                     "answer": pa.array([chunks.bits(p) for p, a in zip(parts, any_hit) if a], pa.binary())})


def _candidates(w, hit):
    """Windows of MIN_WORDS words with a hit among their first BLOCK places."""
    import numpy as np

    at, h = w.windows(MIN_WORDS)
    sums = np.concatenate(([0], np.cumsum(hit)))
    mask = sums[at + BLOCK] > sums[at]
    return at[mask], h[mask]


def _smallest(at, h, w, ids):
    """Distinct hashes, sorted, and the smallest document id of each."""
    import numpy as np

    own = ids[w.doc[at]]
    order = np.lexsort((own, h))
    hs = h[order]
    new = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1]))) if len(hs) else np.zeros(0, np.int64)
    return hs[new], own[order][new]


def _ids(rows, place: int):
    import numpy as np
    import pyarrow as pa

    return rows.column(place).cast(pa.int64()).fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _ask_repeats(text: int, id_place: int, buckets: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from langmix.llm.words import Words, mix

        for chunk, rows, got in _parts(batches):
            if not got:
                continue
            w = Words(rows.column(text))
            at, h, distinct, _, _ = _anchors(w)
            hits = distinct[chunks.spread_answers(distinct, buckets, got, "answer")]
            hit = np.zeros(len(w.hash), bool)
            if len(hits):
                hit[at] = hits[np.minimum(np.searchsorted(hits, h), len(hits) - 1)] == h
            at, h = _candidates(w, hit)
            distinct, smallest = _smallest(at, h, w, _ids(rows, id_place))
            own, cut = chunks.occupied(distinct, buckets)
            parts = [slice(*x) for x in zip(cut, cut[1:])]
            # the hits go along to the chunk's next turn, through a bucket number of their own, drawn from the whole
            # chunk number (its low bits are the same in all partitions)
            past = buckets + int(mix(np.array([chunk], np.uint64))[0]) % buckets
            yield pa.RecordBatch.from_arrays(
                [pa.array([*own, past], pa.int32()), pa.array([chunk] * (len(own) + 1), pa.int64()),
                 pa.array([*[distinct[p].tobytes() for p in parts], chunks.bits(hit)], pa.binary()),
                 pa.array([*[smallest[p].tobytes() for p in parts], None], pa.binary())],
                names=["bucket", "chunk", "keys", "ids"])
    return run


def _answer_repeats(buckets: int):
    def run(group):
        import numpy as np
        import pyarrow as pa

        bucket = group.column("bucket")[0].as_py()
        asked = group.column("chunk")
        if bucket >= buckets:
            return pa.table({"chunk": asked.cast(pa.int64()), "bucket": pa.array([-1] * len(asked), pa.int32()),
                             "answer": group.column("keys").cast(pa.binary())})
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("keys")]
        flat = np.concatenate(keys)
        ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("ids")])
        order = np.argsort(flat, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
        n = np.diff(np.concatenate((new, [len(flat)])))
        first = np.empty(len(flat), np.int64)
        first[order] = np.repeat(np.minimum.reduceat(ids[order], new), n)
        parts = np.split(first < ids, np.cumsum([len(k) for k in keys])[:-1])
        any_hit = [p.any() for p in parts]
        return pa.table({"chunk": pa.array([c for c, a in zip(asked.to_pylist(), any_hit) if a], pa.int64()),
                         "bucket": pa.array([bucket] * sum(any_hit), pa.int32()),
                         "answer": pa.array([chunks.bits(p) for p, a in zip(parts, any_hit) if a], pa.binary())})
    return run


def kept_text(w, gone):
    """Texts of the words that stay, joined by one space, as an Arrow array."""
    import numpy as np
    import pyarrow as pa

    stay = np.flatnonzero(~gone)
    doc = w.doc[stay]
    more = np.concatenate((doc[1:] == doc[:-1], [False])) if len(stay) else np.zeros(0, bool)
    edge = np.zeros(len(w.data) + 2, np.int8)   # a word that isn't its text's last is followed by a separator
    np.add.at(edge, w.starts[stay], 1)
    np.add.at(edge, w.ends[stay] + more, -1)
    take = np.cumsum(edge, dtype=np.int8)[:len(w.data)] > 0
    data = w.data.copy()
    data[w.ends[stay[more]]] = 32
    sums = np.concatenate(([0], np.cumsum(take)))
    return pa.StringArray.from_buffers(len(w.offsets) - 1, pa.py_buffer(sums[w.offsets].astype(np.int32).tobytes()),
                                       pa.py_buffer(data[take].tobytes()))


def _cut(text: int, id_place: int, keep: list[int], buckets: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from langmix.llm.words import Words

        for _, rows, got in _parts(batches):
            w = Words(rows.column(text))
            gone = np.zeros(len(w.hash), bool)
            if -1 in got:
                at, h = _candidates(w, chunks.flags(got[-1]["answer"], len(w.hash)))
                ids = _ids(rows, id_place)
                distinct, smallest = _smallest(at, h, w, ids)
                earlier = chunks.spread_answers(distinct, buckets, got, "answer")
                which = np.searchsorted(distinct, h)
                at = at[earlier[which] | (ids[w.doc[at]] > smallest[which])] if len(at) else at
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + MIN_WORDS, -1)
                gone = np.cumsum(edge)[:-1] > 0
            n = np.bincount(w.doc, minlength=rows.num_rows)
            lost = np.bincount(w.doc[gone], minlength=rows.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(i) for i in keep], pa.array(n, pa.int64()), pa.array(lost, pa.int64()), kept_text(w, gone)],
                names=[*[rows.schema.names[i] for i in keep], "n_words", "n_removed", "kept_text"])
    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) with ``n_words``, ``n_removed`` and
    ``kept_text``, the words that stay, joined by one space."""
    docs = without(docs, "n_words", "n_removed", "kept_text")
    keep = docs.columns if keep is None else keep
    used = list(dict.fromkeys([id_col, text_col, *keep]))
    src = docs.select(*[F.col(f"`{c}`") for c in used])
    text, id_place = used.index(text_col), used.index(id_col)
    store = chunks.pack(src, text_col)
    buckets = store.buckets
    asked = store.table.mapInArrow(tidy(_ask_anchors(text, buckets)), "bucket int, chunk bigint, keys binary, block binary, several binary")
    hits = asked.groupBy("bucket").applyInArrow(_answer_anchors, "chunk bigint, bucket int, answer binary")
    asked = chunks.with_answers(store, hits, ["bucket", "answer"], "inner") \
        .mapInArrow(tidy(_ask_repeats(text, id_place, buckets)), "bucket int, chunk bigint, keys binary, ids binary")
    repeats = asked.groupBy("bucket").applyInArrow(_answer_repeats(buckets), "chunk bigint, bucket int, answer binary")
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return chunks.with_answers(store, repeats, ["bucket", "answer"]) \
        .mapInArrow(tidy(_cut(text, id_place, [used.index(c) for c in keep], buckets)),
                    ", ".join([*fields, "n_words bigint", "n_removed bigint", "kept_text string"]))


def op3_block_anchors(spark, sf_dir):
    """What is left of every whole document without words that repeat an earlier one."""
    got = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUERIES = {"op3_block_anchors": op3_block_anchors}
SQL = {"op3_block_anchors": f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format(text='text')} AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + {MIN_WORDS - 1}) AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS i FROM d)),
m AS (SELECT gram, min(doc_id) AS first_id FROM g GROUP BY gram HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT g.doc_id, g.i FROM g JOIN m USING (gram)
  WHERE m.first_id < g.doc_id), range(0, {MIN_WORDS}) t(j)),
r AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w
    ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' '))
    AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""}
