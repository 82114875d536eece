"""Ranked lexical search by document FP-trees.

Terms are runs of ASCII letters and digits and of all other characters beyond
ASCII, only A-Z lower-cased. Documents become vectors of the items' terms with
their frequencies. A task puts its vectors into FP-trees: the terms of each
vector stand in descending order of document frequency, so documents that
share their frequent terms share a path from the root; a path goes on while
more than ``LEAF`` documents follow it, small neighbours share a leaf, and
equal vectors are one entry. Every node knows, of the documents below, the
largest frequency of each term and the smallest length factor m. What an item
could score with these is a bound on every document below.

The search goes down depth first, children with the largest bounds first, with
the items that still can gain: an item leaves where the bound is below its
floor, the k-th best score so far. Floors start from the k-th best of a seeded
sample (about ``SAMPLE_DOCS`` documents, searched the same way), which no
document of the result can be below. Tasks hand on what they found, and one
ranking by item is the result; scores are exact integers, and equal ones are
ranked by ascending id, null ids last.

Score of a document for an item: over the item's terms, repeats included, the
sum of w * ((10**9 * tf) div (1000 * tf + 8 * m)), with w = floor(1000 *
ln((2 N + 2) / (2 df + 1))) and m = 25 + (75 n N) div L; N documents have a
term, L terms in all, n in this document. Statistics cover all documents.

Items travel in blocks of at most ``BLOCK_BYTES`` of text, one block after the
other. Null and empty texts have no terms: such documents count nowhere, such
items find nothing. Each row of the items is ranked by itself, also where ids
repeat; rows of one document id are documents each. Other columns of both
tables aren't read, whatever their names; empty tables give an empty result."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langmix.llm.common import land, table
from langmix.llm.worker import slices, tidy
from langmix.session import ship_package

TOP = 10
LEAF = 32                # documents of a leaf
DEPTH = 32               # terms of a path, at most
TREE_ENTRIES = 1 << 20   # terms of all vectors of a tree, about
BLOCK_BYTES = 1 << 20    # text of items at once
SAMPLE_DOCS = 20_000
SEED = 61
NULL_ID = 1 << 63        # stands behind every id

#: bytes of terms stay, A-Z as a-z, all others separate
_TERMS = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TERMS).split() if text else []


def impact(tf, m):
    """Whole-number gain of a term, without its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Items:
    """A block of items as vectors of terms, which are numbered as in ``vocab``."""

    def __init__(self, texts: list[str | None], vocab: dict[bytes, int]):
        import numpy as np

        found = [np.unique([vocab[t] for t in terms(x)], return_counts=True) if terms(x) else (np.zeros(0, int),) * 2
                 for x in texts]
        self.length = np.array([len(t) for t, _ in found], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.term = np.concatenate([t for t, _ in found] or [np.zeros(0)]).astype(np.int64)
        self.count = np.concatenate([n for _, n in found] or [np.zeros(0)]).astype(np.int64)

    def places(self, active):
        """(places of the active items' terms, where each item begins among them)."""
        import numpy as np

        n = self.length[active]
        before = np.cumsum(n) - n
        return np.arange(n.sum()) + np.repeat(self.start[active] - before, n), before


class Node:
    """Documents ``low`` to ``high`` of a tree, the largest frequencies of their terms and their smallest m."""

    __slots__ = ("low", "high", "children", "term", "most", "m")

    def __init__(self, low: int, high: int, children: list, term, most, m: int):
        self.low, self.high, self.children, self.term, self.most, self.m = low, high, children, term, most, m


def _largest(term, tf):
    import numpy as np

    order = np.argsort(term, kind="stable")
    term = term[order]
    new = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
    return term[new], np.maximum.reduceat(tf[order], new) if len(new) else tf[:0]


class Tree:
    """FP-tree of vectors (lengths, terms, frequencies, m, ids). Term numbers ascend as document frequency descends."""

    def __init__(self, length, term, tf, m, ids, top: int = TOP):
        import numpy as np

        doc = np.repeat(np.arange(len(length)), length)
        order = np.lexsort((term, doc))
        term, tf = term[order], tf[order]
        start = np.cumsum(length) - length
        equal: dict[bytes, list[int]] = {}
        for i, (a, n) in enumerate(zip(start.tolist(), length.tolist())):
            equal.setdefault(term[a:a + n].tobytes() + tf[a:a + n].tobytes() + int(m[i]).to_bytes(8, "little"), []).append(i)
        first = np.array([own[0] for own in equal.values()], np.int64)
        # of equal vectors only the k smallest ids can be among the k best
        self.ids = [heapq.nsmallest(top, (ids[i] for i in own)) for own in equal.values()]
        depth = np.full((len(first), DEPTH), -1, np.int64)   # a vector that ends stands before those that go on
        for d in range(DEPTH):
            more = length[first] > d
            depth[more, d] = term[start[first[more]] + d]
        by_path = np.lexsort(depth.T[::-1])
        first, depth = first[by_path], depth[by_path]
        self.ids = [self.ids[i] for i in by_path.tolist()]
        self.m, n = m[first], length[first]
        self.at = np.concatenate(([0], np.cumsum(n)))
        place = np.arange(self.at[-1]) + np.repeat(start[first] - self.at[:-1], n)
        self.term, self.tf = term[place], tf[place]
        same = depth[1:] == depth[:-1]
        #: leading terms that each entry shares with the one before
        self.shared = np.concatenate(([0], np.where(same.all(1), DEPTH, same.argmin(1)))) if len(first) else np.zeros(0, int)
        self.root = self._grow(0, len(first))

    def _grow(self, low: int, high: int) -> Node:
        import numpy as np

        if high - low <= LEAF:
            return self._leaf(low, high)
        depth = int(self.shared[low + 1:high].min())   # a path without branches is one step
        if depth >= DEPTH:
            return self._over([self._leaf(a, min(high, a + LEAF)) for a in range(low, high, LEAF)])
        cut = [low, *(low + 1 + np.flatnonzero(self.shared[low + 1:high] == depth)).tolist(), high]
        children, begin = [], low
        for a, b in zip(cut, cut[1:]):   # small neighbours share a leaf
            if b - begin > LEAF and a > begin:
                children.append(self._leaf(begin, a))
                begin = a
            if b - begin > LEAF:
                children.append(self._grow(begin, b))
                begin = b
        if begin < high:
            children.append(self._leaf(begin, high))
        return self._over(children)

    def _leaf(self, low: int, high: int) -> Node:
        part = slice(self.at[low], self.at[high])
        return Node(low, high, [], *_largest(self.term[part], self.tf[part]), int(self.m[low:high].min()) if high > low else 0)

    @staticmethod
    def _over(children: list) -> Node:
        import numpy as np

        if len(children) == 1:
            return children[0]
        term, most = _largest(np.concatenate([c.term for c in children]), np.concatenate([c.most for c in children]))
        return Node(children[0].low, children[-1].high, children, term, most, min(c.m for c in children))


class Search:
    """The best documents of every item so far, over the trees of a task."""

    def __init__(self, items: Items, weight, floors, top: int = TOP):
        import numpy as np

        self.items, self.weight, self.top = items, weight, top
        self.floor = np.maximum(1, np.array(floors, np.int64))   # a score of 0 is no find
        self.best: list[list[tuple[int, int]]] = [[] for _ in floors]   # heaps of (score, -id)
        self.gain = np.zeros(len(weight), np.int64)   # of each term, for the node or document at hand
        self.looked = 0          # documents scored

    def _score(self, term, tf, m: int, places, before):
        """Scores of the active items if each of these terms stood in one document."""
        import numpy as np

        self.gain[term] = self.weight[term] * impact(tf, m)
        got = np.add.reduceat(self.gain[self.items.term[places]] * self.items.count[places], before)
        self.gain[term] = 0
        return got

    def run(self, tree: Tree) -> None:
        import numpy as np

        if len(tree.ids):
            self._visit(tree, tree.root, np.flatnonzero(self.items.length > 0))

    def _visit(self, tree: Tree, node: Node, active) -> None:
        import numpy as np

        if not len(active):
            return
        places, before = self.items.places(active)
        if not node.children:
            for i in range(node.low, node.high):
                part = slice(tree.at[i], tree.at[i + 1])
                self.looked += 1
                score = self._score(tree.term[part], tree.tf[part], int(tree.m[i]), places, before)
                for k in np.flatnonzero(score >= self.floor[active]).tolist():
                    self._found(int(active[k]), int(score[k]), tree.ids[i])
            return
        bounds = [self._score(c.term, c.most, c.m, places, before) for c in node.children]
        for c in sorted(range(len(bounds)), key=lambda c: -int(bounds[c].max())):
            self._visit(tree, node.children[c], active[bounds[c] >= self.floor[active]])

    def _found(self, item: int, score: int, ids: list[int]) -> None:
        heap = self.best[item]
        for x in ids:
            if len(heap) < self.top:
                heapq.heappush(heap, (score, -x))
            elif (score, -x) > heap[0]:
                heapq.heapreplace(heap, (score, -x))
            else:
                break   # ids ascend
        if len(heap) == self.top:
            self.floor[item] = max(self.floor[item], heap[0][0])


# --- Spark ----------------------------------------------------------------------------

_VECTOR = "id bigint, n bigint, terms array<int>, tf array<int>"


def vectors(docs: DataFrame, vocab, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf) of the documents with terms; ``terms`` of the broadcast vocabulary only."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")) \
        .where(F.octet_length("text") > 0)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = vocab.value
        for batch in slices(batches):
            count, term, tf = [], [], []
            for x in batch.column("text"):
                words = terms(x.as_py())
                count.append(len(words))
                ids = [i for i in map(known.get, words) if i is not None]
                t, n = np.unique(np.array(ids, np.int32), return_counts=True)
                term.append(t)
                tf.append(n)
            at = pa.array(np.concatenate(([0], np.cumsum([len(t) for t in term]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count, pa.int64()), *lists],
                                             names=["id", "n", "terms", "tf"])

    return src.mapInArrow(tidy(run), _VECTOR).where("n > 0")


def _find(shared, top: int):
    """The best documents of a task's trees for each item of the block."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        items, weight, rank, documents, total, floors = shared.value
        search, waiting, size = Search(items, weight, floors, top), [], 0

        def grow():
            length, term, tf, n, ids = (np.concatenate(x) for x in zip(*waiting))
            m = 25 + (75 * n * documents) // total
            search.run(Tree(length, rank[term], tf.astype(np.int64), m, ids.tolist(), top))
            waiting.clear()

        for batch in slices(batches, 4096):
            own = batch.column("id").to_pylist()
            length = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            waiting.append((length, *[batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tf")],
                            batch.column("n").to_numpy(zero_copy_only=False),
                            np.array([NULL_ID if i is None else i for i in own], object)))
            size += int(length.sum())
            if size >= TREE_ENTRIES:
                grow()
                size = 0
        if waiting:
            grow()
        got = [(i, -x, s) for i, heap in enumerate(search.best) for s, x in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, *_ in got], pa.int32()), pa.array([None if x == NULL_ID else x for _, x, _ in got], pa.int64()),
             pa.array([s for *_, s in got], pa.int64())], names=["item", "doc_id", "score"])
    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items in blocks, largest bounded part by part: lists of (id, text)."""
    rows = items.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = -(-total // block_bytes)
    for part in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        yield own.orderBy("id", "text").collect()


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item."""
    import numpy as np

    spark = docs.sparkSession
    ship_package(spark)
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in _blocks(items, item_col, item_text, block_bytes):
        words = sorted({t for r in block for t in terms(r["text"])})
        if not words:
            continue
        vocab = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
        stored = land(vectors(docs, vocab, id_col, text_col), "fptree-vectors")
        documents, total = stored.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            return out
        df = np.zeros(len(words), np.int64)
        for r in stored.select(F.explode("terms").alias("t")).groupBy("t").count().collect():   # a row a term of the block
            df[r["t"]] = r["count"]
        order = np.argsort(-df, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df[order]], np.int64)
        own = Items([r["text"] for r in block], {w: int(rank[i]) for i, w in enumerate(words)})

        def find(some: DataFrame, floors: list[int]) -> DataFrame:
            shared = spark.sparkContext.broadcast((own, weight, rank, documents, total, floors))
            return _ranked(some.mapInArrow(tidy(_find(shared, top)), "item int, doc_id bigint, score bigint"), top)

        floors = [0] * len(block)
        if documents > SAMPLE_DOCS:
            some = stored.where(F.pmod(F.xxhash64(F.lit(SEED), "id", "n", "terms"), F.lit(1 << 20)) < (SAMPLE_DOCS << 20) // documents)
            for r in find(some, floors).where(F.col("rank") == top).collect():   # a row an item of the block
                floors[r["item"]] = r["score"]
        names = F.array([F.lit(r["id"]).cast(kind) for r in block]) if len(block) <= 4096 else None
        got = find(stored, floors)
        if names is not None:
            got = got.withColumn("item_id", F.element_at(names, F.col("item") + 1))
        else:
            listed = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(block)], f"item int, item_id {kind}")
            got = got.join(F.broadcast(listed), "item")
        out = out.union(land(got.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "fptree-found"))
    return out


def op12_document_fptree(spark, sf_dir):
    """The 10 best documents of every benchmark item, over all whole documents."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"""regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
QUERIES = {"op12_document_fptree": op12_document_fptree}
SQL = {"op12_document_fptree": f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_SQL_TERMS.format(text="text")} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS big_n, sum(len(t))::BIGINT AS big_l FROM d WHERE len(t) > 0),
i AS (SELECT item, item_id, term, count(*) AS qtf FROM (SELECT row_number() OVER () AS item, item_id,
  unnest({_SQL_TERMS.format(text="text")}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
f AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
s AS (SELECT item, item_id, k, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM f JOIN i USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, k))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {TOP}"""}
