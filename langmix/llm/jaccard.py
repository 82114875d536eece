"""N-gram Jaccard join by signature trees.

A document's set holds its distinct shingles of ``SHINGLE`` words (a to z for
A to Z); a shorter text is one shingle. Two documents link when their sets'
Jaccard similarity is at least ``PERCENT`` percent. The join is exact up to
64-bit hashes of shingles and gives each document the smallest id that links
reach.

1. Documents with equal sets form a class, whose smallest id stands for it.
2. Sets that link share a shingle among the first n - ceil(0.8 n) + 1 of each,
   in any fixed order. Rare shingles come first, by a sketch of fixed size that
   counts all shingles, so common passages don't bring documents together. All
   documents with such a shingle go to the tree of the smallest one among them:
   every pair that can link meets in a tree, and most meet in few.
3. A tree's nodes hold the OR of their members' shingle bitmaps, the smallest
   size, the farthest reach (shingles from the first that leads to the tree on),
   and the most shingles that share a bit. Traversal of two nodes at
   a time drops pairs whose largest possible overlap is too small for their
   sizes. This runs on bitmaps alone first (a quarter byte a shingle) and leaves
   groups of members that could be connected. Groups that several trees found go
   on once, and only now sets are read, from the texts again. The second
   traversal compares by bitmap, then exactly by set, and skips members that are
   already connected.
4. Groups of more than ``SUBTREE`` members are cut into parts of about that size;
   each is joined with itself, together with the group's smallest document. Then
   the group is cut anew, members of its most frequent label apart from the rest,
   and pairs of parts that still differ are walked on bitmaps; sets move only of
   members that could link with one of another label. A tree of more than
   ``TREE`` members is such a group as a whole.

Null and empty texts have no set and link with nothing. Rows without an id
link with nothing and have no component. Rows of one id are one node. Extra
columns pass through; the operator's own replace those of the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm import chunks
from langmix.llm.common import land, table, without
from langmix.llm.worker import tidy
from langmix.session import ship_package

SHINGLE = 5
PERCENT = 80
TREE = 4096
SUBTREE = 512
LEAF = 8
BROADCAST_ROWS = 1 << 20  # large trees in a broadcast, at most; beyond, a shuffle join
SKETCH_BITS = 18
SLICES = 16
MAX_BITMAP = 1 << 17


# --- sets ------------------------------------------------------------------------

def _sets(texts):
    """(document of each distinct shingle, its hash; both sorted)."""
    import numpy as np
    from langmix.llm.words import Words, mix

    w = Words(texts, lower=True)
    at, h = w.windows(SHINGLE)
    doc = w.doc[at]
    first = w.first_word()
    size = np.diff(first)
    for n in range(1, SHINGLE):   # shorter texts: the whole sequence
        few = np.flatnonzero(size == n)
        if len(few):
            g = np.full(len(few), n, np.uint64)
            for j in range(n):
                g = g * np.uint64(0xD1342543DE82EF95) + w.hash[first[few] + j]
            doc, h = np.concatenate((doc, few)), np.concatenate((h, mix(g)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


def _bounds(doc, n: int):
    import numpy as np

    return np.searchsorted(doc, np.arange(n + 1))


_PROFILE = "chunk bigint, row int, doc_id bigint, n bigint, d1 bigint, d2 bigint, slice int, counts binary"


def _profile(text: int, id_place: int):
    """Size and digest of every set, and the partition's share of the sketch."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from langmix.llm.words import mix

        names = [f.split()[0] for f in _PROFILE.split(", ")]
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                rows = chunks.load(batch.column("data")[i])
                doc, h = _sets(rows.column(text))
                sketch += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                at = _bounds(doc, rows.num_rows)
                sums = np.concatenate(([0], np.cumsum(mix(h ^ np.uint64(0x5BD1E995))))).astype(np.uint64)
                other = np.concatenate(([0], np.cumsum(mix(h + np.uint64(0x27D4EB2F))))).astype(np.uint64)
                m = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("chunk")[i].as_py()] * m, pa.int64()), pa.array(range(m), pa.int32()),
                     rows.column(id_place).cast(pa.int64()), pa.array(np.diff(at), pa.int64()),
                     pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)),
                     pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)),
                     pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        parts = np.split(sketch, SLICES)
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(SLICES, t) for t in (pa.int64(), pa.int32(), *[pa.int64()] * 4)],
             pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)
    return run


def _add_slices(group):
    import numpy as np
    import pyarrow as pa

    total = sum(np.frombuffer(x.as_py(), np.int64) for x in group.column("counts"))
    return pa.table({"slice": pa.array([group.column("slice")[0].as_py()], pa.int32()),
                     "counts": pa.array([total.tobytes()], pa.binary())})


# --- meeting places ----------------------------------------------------------------

def _prefixes(texts, rows: list[int], sketch):
    """Rarest shingles of the given rows' sets: (row, hash, place among the row's shingles), by hash."""
    import numpy as np

    doc, h = _sets(texts)
    keep = np.zeros(len(texts) + 1, bool)
    keep[rows] = True
    own = keep[doc]
    doc, h = doc[own], h[own]
    rare = sketch[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((h, rare, doc))
    at = _bounds(doc, len(texts))
    n = np.diff(at)
    need = n - (PERCENT * n + 99) // 100 + 1
    place = np.arange(len(doc)) - at[doc]
    early = place < need[doc]   # doc is sorted, so places are those of the order
    first, place = order[early], place[early]
    by_hash = np.argsort(h[first], kind="stable")
    order = first[by_hash]
    return doc[order], h[order], place[by_hash], (doc, h, at)


def _rows_and_answers(batch, i: int):
    """What a chunk got: its rows that stand for a class, and its buckets' answers."""
    reps, answers = [], {}
    for g in batch.column("got")[i].as_py() or ():
        if g["bucket"] == -1:
            reps.append(g["row"])
        else:
            answers[g["bucket"]] = g
    return reps, answers


def _ids(rows, place: int):
    import numpy as np
    import pyarrow as pa

    return rows.column(place).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(h):
    import numpy as np

    return np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)


def _ask(text: int, id_place: int, buckets: int, shared):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                reps, _ = _rows_and_answers(batch, i)
                rows = chunks.load(batch.column("data")[i])
                doc, h, *_ = _prefixes(rows.column(text), reps, np.frombuffer(shared.value, np.int64))
                new = _runs(h)
                own = _ids(rows, id_place)[doc]
                low = np.minimum.reduceat(own, new) if len(new) else own
                several = np.maximum.reduceat(own, new) != low if len(new) else np.zeros(0, bool)
                key = h[new]
                (some, cut), key = chunks.occupied(key, buckets), chunks.short(key, buckets)
                parts = [slice(*x) for x in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([batch.column("chunk")[i].as_py()] * len(some), pa.int64()),
                     pa.array([key[p].tobytes() for p in parts], pa.binary()),
                     pa.array([low[p].tobytes() for p in parts], pa.binary()),
                     pa.array([chunks.bits(several[p]) for p in parts], pa.binary())],
                    names=["bucket", "chunk", "keys", "ids", "several"])
    return run


def _answer(group):
    """For each shingle that several documents have, the smallest of them."""
    import numpy as np
    import pyarrow as pa

    keys = [np.frombuffer(x.as_py(), np.uint32) for x in group.column("keys")]
    size = [len(x) for x in keys]
    flat = np.concatenate(keys)
    ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("ids")])
    several = np.concatenate([chunks.flags(x.as_py(), n) for x, n in zip(group.column("several"), size)])
    order = np.argsort(flat, kind="stable")
    new = _runs(flat[order])
    n = np.diff(np.concatenate((new, [len(flat)])))
    low = np.minimum.reduceat(ids[order], new)
    shared = (np.maximum.reduceat(ids[order], new) != low) | np.logical_or.reduceat(several[order], new)
    hit, first = np.empty(len(flat), bool), np.empty(len(flat), np.int64)
    hit[order], first[order] = np.repeat(shared, n), np.repeat(low, n)
    cut = np.cumsum(size)[:-1]
    out = [(c, h, f[h]) for c, h, f in zip(group.column("chunk").to_pylist(), np.split(hit, cut), np.split(first, cut))
           if h.any()]
    return pa.table({"chunk": pa.array([c for c, *_ in out], pa.int64()),
                     "bucket": pa.array([group.column("bucket")[0].as_py()] * len(out), pa.int32()),
                     "row": pa.nulls(len(out), pa.int32()),
                     "hits": pa.array([chunks.bits(h) for _, h, _ in out], pa.binary()),
                     "trees": pa.array([f.tobytes() for *_, f in out], pa.binary())})


def width_of(n: int) -> int:
    """Bits for a set of n shingles: two to four times as many, a power of two."""
    return min(MAX_BITMAP, max(64, 1 << (2 * n - 1).bit_length()))


def bitmap(hashes, width: int):
    import numpy as np

    out = np.zeros(width // 64, np.uint64)
    bit = (hashes & np.uint64(width - 1)).astype(np.int64)
    np.bitwise_or.at(out, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


_MEMBER = "tree bigint, doc_id bigint, chunk bigint, row int, n int, reach int, bits binary"


def _members(text: int, id_place: int, buckets: int, shared):
    """Each document once for every tree it goes to, with its bitmap and its
    reach there: shingles from the first that leads to the tree on. Two sets
    have nothing in common before the shingle that brings them together first,
    so no pair of a tree shares more than either's reach."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                reps, got = _rows_and_answers(batch, i)
                if not got:
                    continue
                rows = chunks.load(batch.column("data")[i])
                doc, h, place, (_, set_hash, at) = _prefixes(rows.column(text), reps, np.frombuffer(shared.value, np.int64))
                new = _runs(h)
                own, cut = chunks.occupied(h[new], buckets)
                tree, met = np.zeros(len(new), np.int64), np.zeros(len(new), bool)
                for j, b in enumerate(own):
                    if b in got:
                        hit = chunks.flags(got[b]["hits"], cut[j + 1] - cut[j])
                        tree[cut[j]:cut[j + 1]][hit] = np.frombuffer(got[b]["trees"], np.int64)
                        met[cut[j]:cut[j + 1]] = hit
                length = np.diff(np.concatenate((new, [len(h)])))
                tree, met = np.repeat(tree, length), np.repeat(met, length)
                tree, doc, place = tree[met], doc[met], place[met]
                order = np.lexsort((place, doc, tree))
                pairs, place = np.stack((tree, doc), 1)[order], place[order]
                new = np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1))) if len(pairs) else np.zeros(0, bool)
                pairs, place = pairs[new], place[new]
                ids, n = _ids(rows, id_place), np.diff(at)
                bits = {d: bitmap(set_hash[at[d]:at[d + 1]], width_of(int(n[d]))).tobytes() for d in set(pairs[:, 1].tolist())}
                chunk = batch.column("chunk")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(ids[pairs[:, 1]]), pa.array([chunk] * len(pairs), pa.int64()),
                     pa.array(pairs[:, 1], pa.int32()), pa.array(n[pairs[:, 1]], pa.int32()),
                     pa.array(n[pairs[:, 1]] - place, pa.int32()), pa.array([bits[d] for d in pairs[:, 1].tolist()], pa.binary())],
                    names=["tree", "doc_id", "chunk", "row", "n", "reach", "bits"])
    return run


_ENTRY = ["tree", "p1", "p2", "row", "label", "side"]
_SET = "tree bigint, p1 int, p2 int, doc_id bigint, label bigint, shingles binary, side int"


def _with_sets(text: int, id_place: int):
    """The entries that a chunk got, with the sets of their rows."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = [f.split()[0] for f in _SET.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                got = batch.column("got")[i].as_py()
                rows = chunks.load(batch.column("data")[i])
                own = sorted({g["row"] for g in got})
                place = {r: k for k, r in enumerate(own)}
                doc, h = _sets(rows.column(text).take(pa.array(own, pa.int64())))
                at, ids = _bounds(doc, len(own)), _ids(rows, id_place)
                for first in range(0, len(got), 64):
                    part = got[first:first + 64]
                    sets = [h[at[place[g["row"]]]:at[place[g["row"]] + 1]].tobytes() for g in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g["tree"] for g in part], pa.int64()), pa.array([g["p1"] for g in part], pa.int32()),
                         pa.array([g["p2"] for g in part], pa.int32()), pa.array([int(ids[g["row"]]) for g in part], pa.int64()),
                         pa.array([g["label"] for g in part], pa.int64()), pa.array(sets, pa.binary()),
                         pa.array([g["side"] for g in part], pa.int32())], names=names)
    return run


# --- the trees ----------------------------------------------------------------------

class Side:
    """Levels of nodes above members that are ordered by set size (level 0:
    the members): bitmaps, smallest set, farthest reach, most spare shingles."""

    def __init__(self, bitmaps, n, reach):
        import numpy as np

        spare = n - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        self.levels = [(bitmaps, n, reach, spare)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, most = self.levels[-1]
            cut = np.arange(0, len(b), LEAF)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(low, cut),
                                np.maximum.reduceat(high, cut), np.maximum.reduceat(most, cut)))


def _can_link(a, i, b, j):
    """Whether members below nodes i and j can reach the overlap their sizes ask for."""
    import numpy as np

    bits_a, low_a, reach_a, most_a = (x[i] for x in a)
    bits_b, low_b, reach_b, most_b = (x[j] for x in b)
    overlap = np.bitwise_count(bits_a & bits_b).sum(-1, dtype=np.int64) + np.minimum(most_a, most_b)
    overlap = np.minimum(overlap, np.minimum(reach_a, reach_b))
    # 100 I >= P (A + B - I) at the smallest sizes; the larger set alone asks for P percent of itself
    least, larger = low_a + low_b, np.maximum(low_a, low_b)
    return ((100 + PERCENT) * overlap >= PERCENT * least) & (100 * overlap >= PERCENT * larger)


def overlap(a, b) -> int:
    """Size of the intersection of two sorted arrays."""
    import numpy as np

    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def walk(one: Side, two: Side, done, visit) -> None:
    """Pairs of members that can link, found from the roots down: ``visit``
    gets their places. ``done`` tells for ranges of members on both sides
    whether nothing is left to find between them."""
    import numpy as np

    same = one is two
    stack = [(len(one.levels) - 1, len(two.levels) - 1, np.array([0]), np.array([0]))]
    while stack:
        la, lb, i, j = stack.pop()
        if same:
            i, j = i[i <= j], j[i <= j]
        ok = _can_link(one.levels[la], i, two.levels[lb], j)
        i, j = i[ok], j[ok]
        if la == 0 and lb == 0:
            if len(i):
                visit(i, j)
            continue
        down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
        for x, y in zip(i.tolist(), j.tolist()):
            if done(x * LEAF**la, (x + 1) * LEAF**la, y * LEAF**lb, (y + 1) * LEAF**lb):
                continue
            ca = np.arange(x * LEAF, min((x + 1) * LEAF, len(one.levels[la - 1][0]))) if down_a else np.array([x])
            cb = np.arange(y * LEAF, min((y + 1) * LEAF, len(two.levels[lb - 1][0]))) if down_b else np.array([y])
            stack.append((la - down_a, lb - down_b, np.repeat(ca, len(cb)), np.tile(cb, len(ca))))


def fold(bitmaps):
    """The bitmaps at half the width."""
    half = bitmaps.shape[1] // 2
    return bitmaps[:, :half] | bitmaps[:, half:]


def _meetings(n, reach, bits, left, right):
    """(side, its members, side, its members) to walk: members of one bitmap
    width together, and with those of the next width folded; sets of more
    different sizes can't link. Without ``right``, ``left`` meets itself."""
    import numpy as np

    size = np.array([len(b) for b in bits])

    def sides(own):
        own, out = own[np.argsort(n[own], kind="stable")], {}
        for width in np.unique(size[own]).tolist():   # ascending, as the sizes are
            part = own[size[own] == width]
            maps = np.stack([np.frombuffer(bits[i], np.uint64) for i in part])
            out[width] = Side(maps, n[part], reach[part]), part, maps
        return out

    def folded(side):
        return Side(fold(side[2]), n[side[1]], reach[side[1]]), side[1]

    one = sides(left)
    two = one if right is None else sides(right)
    for width in sorted(one.keys() | two.keys()):
        if width in one and width in two:
            yield *one[width][:2], *two[width][:2]
        if width in one and 2 * width in two:
            yield *one[width][:2], *folded(two[2 * width])
        if one is not two and 2 * width in one and width in two:
            yield *folded(one[2 * width]), *two[width][:2]


def groups_of(n, reach, bits) -> list[list[int]]:
    """Members that sizes, reaches and bitmaps could connect."""
    import numpy as np

    n, reach = np.array(n, np.int64), np.array(reach, np.int64)
    label = np.arange(len(n))
    for a, own_a, b, own_b in _meetings(n, reach, bits, label.copy(), None):
        def done(p, q, r, s):
            x, y = label[own_a[p:q]], label[own_b[r:s]]
            return x.min() == x.max() == y.min() == y.max()

        def visit(i, j):
            for x, y in zip(own_a[i].tolist(), own_b[j].tolist()):
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]

        walk(a, b, done, visit)
    order = np.argsort(label, kind="stable")
    cut = np.flatnonzero(np.diff(label[order])) + 1
    return [g.tolist() for g in np.split(order, cut) if len(g) > 1]


def survivors(n, reach, bits, label, side):
    """Whether sizes, reaches and bitmaps could link a member with one of the
    other side (of its own, if there is one side) that has another label."""
    import numpy as np

    n, reach, label, side = (np.array(x, np.int64) for x in (n, reach, label, side))
    keep = np.zeros(len(n), bool)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for a, own_a, b, own_b in _meetings(n, reach, bits, left, right if len(right) else None):
        def done(p, q, r, s):
            i, j = own_a[p:q], own_b[r:s]
            x, y = label[i], label[j]
            return x.min() == x.max() == y.min() == y.max() or (keep[i].all() and keep[j].all())

        def visit(i, j):
            x, y = own_a[i], own_b[j]
            other = label[x] != label[y]
            keep[x[other]] = True
            keep[y[other]] = True

        walk(a, b, done, visit)
    return keep


def traverse(sets, labels, left: int):
    """Links (i, j) that connect members with different labels, enough to
    connect all that are linked. ``left``: members before it are joined with
    those from it on only; 0 joins all with all."""
    import numpy as np

    labels = np.array(labels)
    order = np.argsort([len(s) for s in sets], kind="stable")
    sides = [order[order < left], order[order >= left]] if left else [order, order]
    if not len(sides[0]) or not len(sides[1]):
        return []
    width = width_of(max(len(s) for s in sets))

    def side(own):
        n = np.array([len(sets[i]) for i in own])
        return Side(np.stack([bitmap(sets[i], width) for i in own]), n, n)

    one = side(sides[0])
    two = side(sides[1]) if left else one
    links = []

    def done(p, q, r, s):
        a, b = labels[sides[0][p:q]], labels[sides[1][r:s]]
        return a.min() == a.max() == b.min() == b.max()

    def visit(i, j):
        a, b = sides[0][i], sides[1][j]
        for x, y in zip(a[a != b].tolist(), b[a != b].tolist()):
            if labels[x] == labels[y]:
                continue
            common = overlap(sets[x], sets[y])
            if 100 * common >= PERCENT * (len(sets[x]) + len(sets[y]) - common):
                links.append((x, y))
                labels[labels == labels[y]] = labels[x]

    walk(one, two, done, visit)
    return links


def _groups(batches, key: int):
    """Contiguous rows with equal first ``key`` columns, across batches."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:key] != now and rows:
                yield rows
                rows = []
            now = row[:key]
            rows.append(row)
    if rows:
        yield rows


_GROUP = "tree bigint, chunk bigint, row int, doc_id bigint, n int, reach int, bits binary"


def _prune(subtree: int):
    """Members of the groups in each tree that could be connected; ``tree`` is
    now a hash of the group's ids, so that equal groups of several trees are
    one, and reaches are whole sets. Only large groups need their bitmaps on."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from langmix.llm.words import mix

        for rows in _groups(batches, 1):
            out = []
            for group in groups_of(*([r[k] for r in rows] for k in (4, 5, 6))) if len(rows) > 1 else ():
                ids = np.array([rows[i][1] for i in group], np.int64).view(np.uint64)
                key = int(mix(np.array([mix(ids).sum() + np.uint64(len(ids))]))[0].view(np.int64))
                out += [(key, rows[i][2], rows[i][3], rows[i][1], rows[i][4], rows[i][4],
                         rows[i][6] if len(group) > subtree else None) for i in group]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 names=[f.split()[0] for f in _GROUP.split(", ")])
    return run


def _survive(batches):
    """Entries of each group of equal (tree, p1, p2) whose sets are needed."""
    import pyarrow as pa

    for rows in _groups(batches, 3):
        keep = survivors(*([r[k] for r in rows] for k in (7, 8, 9, 5, 6)))
        out = [r[:7] for r, k in zip(rows, keep.tolist()) if k]
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             names=["tree", "p1", "p2", "chunk", "row", "label", "side"])


def stars(links: list[tuple[int, int]], ids) -> list[tuple[int, int]]:
    """The same components as links of every member to the smallest id, so
    that labels have one step to go within a group."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in links:
        a, b = find(x), find(y)
        if a != b:
            low, high = (a, b) if ids[a] <= ids[b] else (b, a)
            root[high] = low
    return [(ids[find(x)], ids[x]) for x in list(root) if ids[find(x)] != ids[x]]


def _join(batches):
    """Verified links of each group of equal (tree, p1, p2), as stars."""
    import numpy as np
    import pyarrow as pa

    for rows in _groups(batches, 3):
        rows.sort(key=lambda r: r[6])
        left = sum(r[6] == 0 for r in rows) if rows[-1][6] else 0
        found = traverse([np.frombuffer(r[5], np.uint64) for r in rows], [r[4] for r in rows], left)
        got = stars(found, [r[3] for r in rows])
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()),
                                              pa.array([b for _, b in got], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component: the smallest node reachable) of all nodes with a
    link. Each round moves every node to the smallest label around it, then to
    its label's label, so labels travel twice as far each time."""
    edges = land(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = land(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("node"), "c"),
                  "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")) \
            .agg(F.min("c").alias("near"))
        hop = labels.select(F.col("node").alias("c"), F.col("c").alias("next"))
        moved = labels.join(near, "node").join(hop, "c").select(
            "node", F.least("c", "near", "next").alias("c"), (F.least("near", "next") < F.col("c")).alias("moved"))
        moved = land(moved, "labels")
        labels = moved.select("node", "c")
        if not moved.where("moved").limit(1).count():
            return labels.select("node", F.col("c").alias("component"))


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def links_between(members: DataFrame, with_sets) -> DataFrame:
    """(a, b): enough verified links to connect all that are linked.
    ``with_sets`` adds the sets to (chunk, entry) rows."""
    huge = land(members.groupBy("tree").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > TREE)
                .select("tree"), "huge-trees")   # one in TREE members at most
    listed = F.broadcast(huge) if huge.count() <= BROADCAST_ROWS else huge
    found = _spread(members.join(listed, "tree", "left_anti"), ["tree"]) \
        .mapInArrow(tidy(_prune(SUBTREE)), _GROUP).dropDuplicates(["tree", "chunk", "row"])
    found = land(found.union(members.join(listed, "tree").select(*[f.split()[0] for f in _GROUP.split(", ")])), "groups")
    large = land(found.groupBy("tree").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("head"))
                 .where(F.col("size") > SUBTREE)
                 .select("tree", "head", F.ceil(F.col("size") / SUBTREE).cast("int").alias("parts")), "large-groups")
    listed_large = F.broadcast if large.count() <= BROADCAST_ROWS else lambda df: df
    cut = listed_large(large)
    small = found.join(cut, "tree", "left_anti")
    big = found.join(cut, "tree").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    head = big.where(F.col("doc_id") == F.col("head")) \
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("at <> part")
    entry = ["tree", "chunk", "row", F.col("doc_id").alias("label")]
    first = small.select(*entry, F.lit(0).alias("p1")).union(big.select(*entry, F.col("part").alias("p1"))) \
        .union(head.select(*entry, F.col("at").alias("p1"))).withColumns({"p2": F.lit(0), "side": F.lit(0)})
    links = land(_spread(with_sets(first), ["tree", "p1", "p2"]).mapInArrow(tidy(_join), "a bigint, b bigint"), "links")
    if large.isEmpty():
        return links
    labels = components(links)
    labelled = big.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left") \
        .withColumn("label", F.coalesce("component", "doc_id"))
    labelled = land(labelled.select("tree", "chunk", "row", "doc_id", "n", "reach", "bits", "label"), "labelled")
    # what is left links a member outside the group's most frequent label with another one, and one of the two shares
    # at least (A + B) / 2 x 2 P / (100 + P) shingles of (A + B) / 2, so reaches that far. New parts, of one kind each
    main = labelled.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("size")) \
        .groupBy("tree").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    kinds = labelled.join(listed_large(main), "tree") \
        .withColumn("rest", F.col("label") != F.col("main")) \
        .withColumn("far", (100 + PERCENT) * F.col("reach").cast("long") < 2 * PERCENT * F.col("n").cast("long"))
    counts = kinds.groupBy("tree", "rest", "far").agg(F.ceil(F.count(F.lit(1)) / SUBTREE).cast("int").alias("own"))
    kind = F.when(F.col("rest"), 0).otherwise(2) + F.col("far").cast("int")
    kinds = kinds.join(listed_large(counts), ["tree", "rest", "far"]).withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.col("own")).cast("int") * 4 + kind)
    span = kinds.groupBy("tree", "part", "rest", "far").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                                            F.min("n").alias("least"), F.max("n").alias("most"))
    left, right = (span.select("tree", *[F.col(c).alias(f"{s}_{c}") for c in span.columns[1:]]) for s in "lr")
    pairs = left.where("l_rest").join(right, "tree").where("NOT (l_far AND r_far)") \
        .where("NOT r_rest OR l_part <= r_part") \
        .where(f"100L * l_most >= {PERCENT}L * r_least AND 100L * r_most >= {PERCENT}L * l_least") \
        .where("NOT (l_low = l_high AND r_low = r_high AND l_low = r_low)").select("tree", "l_part", "r_part")
    sides = pairs.select("tree", F.col("l_part").alias("p1"), F.col("r_part").alias("p2"), F.explode(F.array_distinct(F.array(
        F.struct(F.col("l_part").alias("part"), F.lit(0).alias("side")),
        F.struct(F.col("r_part").alias("part"), (F.col("l_part") != F.col("r_part")).cast("int").alias("side"))))).alias("s")) \
        .select("tree", "p1", "p2", "s.part", "s.side")
    again = sides.join(kinds, ["tree", "part"]) \
        .select("tree", "p1", "p2", "chunk", "row", "label", "side", "n", "reach", "bits")
    again = land(_spread(again, ["tree", "p1", "p2"]).mapInArrow(
        tidy(_survive), "tree bigint, p1 int, p2 int, chunk bigint, row int, label bigint, side int"), "survivors")
    again = _spread(with_sets(again.select("tree", "chunk", "row", "label", "p1", "p2", "side")), ["tree", "p1", "p2"])
    return links.union(again.mapInArrow(tidy(_join), "a bigint, b bigint"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", packed=None) -> DataFrame:
    """(chunk, row, doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    used = docs.columns
    text, id_place = used.index(text_col), used.index(id_col)
    store = packed or chunks.pack(docs, text_col)
    table_, buckets = store.table, store.buckets
    profile = land(table_.mapInArrow(tidy(_profile(text, id_place)), _PROFILE), "profile")
    parts = profile.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice") \
        .applyInArrow(_add_slices, "slice int, counts binary").collect()   # 2 MB whatever the input
    sketch = b"".join(bytes(r["counts"]) for r in sorted(parts, key=lambda r: r["slice"])) or bytes(8 << SKETCH_BITS)
    shared = spark.sparkContext.broadcast(sketch)
    rows = profile.where("slice IS NULL").drop("slice", "counts")
    linkable = rows.where("n > 0 AND doc_id IS NOT NULL")
    smallest = linkable.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    rows = land(rows.join(smallest, ["n", "d1", "d2"], "left")
                .select("chunk", "row", "doc_id", "n", F.when(F.col("doc_id").isNotNull(),
                                                              F.coalesce("rep", "doc_id")).alias("rep")), "classes")
    none = F.lit(None).cast("binary")
    reps = rows.where("n > 0 AND doc_id = rep").select("chunk", F.lit(-1).alias("bucket"), "row", none.alias("hits"),
                                                       none.alias("trees"))
    fields = ["bucket", "row", "hits", "trees"]
    asked = chunks.with_answers(store, reps, fields, "inner").mapInArrow(
        tidy(_ask(text, id_place, buckets, shared)), "bucket int, chunk bigint, keys binary, ids binary, several binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "chunk bigint, bucket int, row int, hits binary, trees binary")
    members = land(chunks.with_answers(store, reps.select("chunk", *fields).union(answers.select("chunk", *fields)),
                                       fields, "inner")
                   .mapInArrow(tidy(_members(text, id_place, buckets, shared)), _MEMBER), "members")

    def with_sets(entries: DataFrame) -> DataFrame:
        return chunks.with_answers(store, entries, _ENTRY, "inner").mapInArrow(tidy(_with_sets(text, id_place)), _SET)

    found = components(links_between(members, with_sets))
    if packed is None:
        chunks.drop(store)   # the result comes from what was landed since
    return rows.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "chunk", "row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _attach(columns: list[str]):
    """Rows of the chunks that got an answer, with the answers' columns."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                rows = chunks.load(batch.column("data")[i])
                got = sorted(batch.column("got")[i].as_py(), key=lambda g: g["row"])
                own = rows.take(pa.array([g["row"] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, *[pa.array([g[c] for g in got], pa.int64()) for c in columns]],
                    names=[*rows.schema.names, *columns])
    return run


def _with_rows(packed, found: DataFrame, schema, columns: list[str]) -> DataFrame:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + [f"{c} bigint" for c in columns]
    return chunks.with_answers(packed, found, ["row", *columns], "inner") \
        .mapInArrow(tidy(_attach(columns)), ", ".join(fields))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns with ``n_shingles`` and ``component_id``."""
    docs = without(docs, "n_shingles", "component_id")
    packed = chunks.pack(docs, text_col)
    return _with_rows(packed, classes(docs, id_col, text_col, packed), docs.schema, ["n_shingles", "component_id"])


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, that with the smallest id (of rows with
    one id, the first read); rows without a set or an id all stay."""
    packed = chunks.pack(docs, text_col)
    found = land(classes(docs, id_col, text_col, packed), "components")
    linkable = (F.col("n_shingles") > 0) & F.col("component_id").isNotNull()
    first = found.where(linkable).groupBy("component_id").agg(F.min(F.struct("doc_id", "chunk", "row")).alias("first"))
    kept = first.select("first.chunk", "first.row").union(found.where(~linkable).select("chunk", "row"))
    return _with_rows(packed, kept, docs.schema, [])


def op2_signature_trees(spark, sf_dir):
    """Set size and component of every whole document."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id")


QUERIES = {"op2_signature_trees": op2_signature_trees}
SQL = {"op2_signature_trees": f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reach)
SELECT documents.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach) AS component_id
FROM documents JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY documents.doc_id"""}
