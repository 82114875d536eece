"""Merkle manifest of a dataset with midstates.

A row's leaf is the SHA-256 of its fields, each as byte count, ``:`` and value
(``-`` for null). Per group, leaves ascend by id; every ``FANOUT`` consecutive
nodes become the SHA-256 of their digests as hexadecimal text, level by level
(the last run may have fewer, even one), until one node is left, the subroot;
the subroots, ordered by group (null first, by UTF-8 bytes), make the root the
same way.

A parent keeps a copy of its hash state before each child slot. To fold a
presented leaf up to the root, each parent resumes the state of the child's
slot, takes the replacement and only the siblings to the right; what stands to
the left isn't hashed again.

Leaves are numbered by range partitions, so a group of any size lies in many
tasks. Blocks of ``FANOUT ** LEVELS`` consecutive nodes are worked on one at a
time, their roots are the nodes of the next tier (a handful of tiers for any
size), and every tier is written before the next one is made. On the way down
each block is given the steps above its root, once for all its leaves: the
states of those steps are built once a block, and equal folded values take the
same way up once.

Null ids come first; rows of one id are ordered by leaf, and repeated rows are
leaves each. Null, empty and very long values need nothing special, as leaves
are hashed by Spark's own functions. The result has the operator's columns
only, so columns of other names, whatever they are, don't clash. Without rows
there is no root and no result. ``group_col`` None makes one group."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmix.llm.common import land, table
from langmix.operators.ordering import global_rank, grouped_rank
from langmix.session import ship_package

FANOUT = 2
LEVELS = 9               # of one block: 512 nodes
BROADCAST_GROUPS = 100_000

_STEPS = "array<struct<before: array<string>, after: array<string>>>"


# --- one block --------------------------------------------------------------------

class Block:
    """The tree over some consecutive nodes (digests as hexadecimal bytes): ``rows`` of nodes by level, and for each
    parent the hash states before its child slots. ``levels`` None goes on until one node is left."""

    def __init__(self, digests: list[bytes], fanout: int = FANOUT, levels: int | None = None):
        self.fanout, self.rows, self.states = fanout, [digests], []
        while len(self.states) < levels if levels is not None else len(self.rows[-1]) > 1:
            below, nodes, states = self.rows[-1], [], []
            for first in range(0, len(below), fanout):
                h, before = hashlib.sha256(), []
                for child in below[first:first + fanout]:
                    before.append(h.copy())
                    h.update(child)
                states.append(before)
                nodes.append(h.hexdigest().encode())
            self.rows.append(nodes)
            self.states.append(states)

    def steps(self, place: int) -> list[tuple[list[bytes], list[bytes]]]:
        """(left, right siblings) level by level."""
        out = []
        for row in self.rows[:len(self.states)]:
            first = place - place % self.fanout
            out.append((row[first:place], row[place + 1:first + self.fanout]))
            place //= self.fanout
        return out

    def fold(self, place: int, digest: bytes) -> bytes:
        """The block's root with another digest at a place."""
        for row, states in zip(self.rows, self.states):
            parent, slot = divmod(place, self.fanout)
            h = states[parent][slot].copy()
            h.update(digest)
            for right in row[place + 1:(parent + 1) * self.fanout]:
                h.update(right)
            digest, place = h.hexdigest().encode(), parent
        return digest


class Above:
    """The steps from a block's root to the top, with the state before its slot at each."""

    def __init__(self, steps: list[tuple[list[bytes], list[bytes]]]):
        self.states, self.known = [], {}
        for left, right in steps:
            h = hashlib.sha256()
            for x in left:
                h.update(x)
            self.states.append((h, right))

    def fold(self, digest: bytes) -> bytes:
        if digest not in self.known:
            now = digest
            for state, right in self.states:
                h = state.copy()
                h.update(now)
                for x in right:
                    h.update(x)
                now = h.hexdigest().encode()
            self.known[digest] = now
        return self.known[digest]


def _block(nodes, fanout: int, levels: int) -> tuple[Block, list[int]]:
    """(block, order of its rows by place) of an Arrow table of one block's nodes."""
    order = sorted(range(nodes.num_rows), key=nodes.column("pos").to_pylist().__getitem__)
    digest = nodes.column("digest").to_pylist()
    alone = nodes.column("n")[0].as_py() <= fanout**levels
    return Block([digest[i].encode() for i in order], fanout, None if alone else levels), order


def _steps(above) -> list[tuple[list[bytes], list[bytes]]]:
    return [tuple([x.encode() for x in step[side]] for side in ("before", "after"))
            for step in above.column("steps")[0].as_py()]


def _texts(steps) -> list[dict]:
    return [{"before": [x.decode() for x in left], "after": [x.decode() for x in right]} for left, right in steps]


# --- tiers ------------------------------------------------------------------------

_NODE = "grp string, pos bigint, n bigint, digest string"


def _roots(fanout: int, levels: int):
    """A block's root, a node of the next tier."""
    def run(nodes):
        import pyarrow as pa

        block, order = _block(nodes, fanout, levels)
        size = fanout**levels
        return pa.table({"grp": nodes.column("grp").slice(0, 1),
                         "pos": pa.array([nodes.column("pos")[order[0]].as_py() // size], pa.int64()),
                         "n": pa.array([-(-nodes.column("n")[0].as_py() // size)], pa.int64()),
                         "digest": pa.array([block.rows[-1][0].decode()], pa.string())})
    return run


def _descend(fanout: int, levels: int):
    """The steps from each node of a block to the top."""
    def run(nodes, above):
        import pyarrow as pa

        block, order = _block(nodes, fanout, levels)
        up = _texts(_steps(above))
        kind = pa.list_(pa.struct([("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))
        own = nodes.take(pa.array(order, pa.int64()))
        return pa.table({"grp": own.column("grp"), "pos": own.column("pos"), "digest": own.column("digest"),
                         "subroot": pa.array([above.column("subroot")[0].as_py()] * len(order), pa.string()),
                         "steps": pa.array([_texts(block.steps(p)) + up for p in range(len(order))], kind)})
    return run


def _proofs(fanout: int, levels: int):
    """Per leaf: the siblings on its way to the top, and the root that its presented digest folds to."""
    def run(nodes, above):
        import pyarrow as pa

        block, order = _block(nodes, fanout, levels)
        steps = _steps(above)
        up, rest = Above(steps), [x.decode() for left, right in steps for x in (*left, *right)]
        own = nodes.take(pa.array(order, pa.int64()))
        proof = [[x.decode() for left, right in block.steps(p) for x in (*left, *right)] + rest for p in range(len(order))]
        folded = [up.fold(block.fold(p, x.encode())).decode() for p, x in enumerate(own.column("presented").to_pylist())]
        return pa.table({"id": own.column("id"), "leaf": own.column("digest"),
                         "subroot": pa.array([above.column("subroot")[0].as_py()] * len(order), pa.string()),
                         "proof": pa.array(proof, pa.list_(pa.string())), "folded_root": pa.array(folded, pa.string())})
    return run


def _in_blocks(nodes: DataFrame, size: int):
    return nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long")).groupBy("grp", "block")


class Tree:
    """Tiers of nodes, leaves first: those of the groups, then those of the subroots (group ``""``). Every tier but the
    last has the next one's nodes as roots of its blocks."""

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS):
        ship_package(leaves.sparkSession)
        self.fanout, self.levels, self.size = fanout, levels, fanout**levels
        leaves = land(leaves, "merkle-leaves")
        counts = land(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "merkle-groups")
        groups, most = counts.agg(F.count(F.lit(1)), F.max("n")).first()
        listed = F.broadcast(counts) if groups <= BROADCAST_GROUPS else counts
        ranked = grouped_rank(leaves, ["grp"], ["id", "digest", "presented"], "pos").withColumn("pos", F.col("pos") - 1)
        self.tiers = [land(ranked.join(listed, "grp"), "merkle-0")]
        self._grow(most or 0)
        self.subroots = global_rank(self.tiers[-1].select(F.col("grp").alias("name"), "digest"), ["name"], "pos") \
            .select("name", F.lit("").alias("grp"), (F.col("pos") - 1).alias("pos"), F.lit(groups).alias("n"), "digest")
        self.subroots = land(self.subroots, "merkle-subroots")
        self.turn = len(self.tiers)   # the first tier of the upper tree
        self.tiers.append(self.subroots)
        self._grow(groups)
        top = self.tiers[-1].first()
        self.root = top["digest"] if top else None

    def _grow(self, n: int) -> None:
        while n > 1:
            up = _in_blocks(self.tiers[-1].select("grp", "pos", "n", "digest"), self.size) \
                .applyInArrow(_roots(self.fanout, self.levels), _NODE)
            self.tiers.append(land(up, f"merkle-{len(self.tiers)}"))
            n = -(-n // self.size)

    def _meet(self, nodes: DataFrame, above: DataFrame, work, schema: str) -> DataFrame:
        own = _in_blocks(nodes, self.size)
        return own.cogroup(above.withColumnRenamed("pos", "block").groupBy("grp", "block")).applyInArrow(
            work(self.fanout, self.levels), schema)

    def check(self) -> DataFrame:
        """Per leaf: id, leaf, subroot, root, ``proof`` (the siblings level by level, left to right, from the leaf to
        the root), ``folded_root`` of the presented digest, and ``verified``."""
        above = self.tiers[-1].select("grp", "pos", F.lit(None).cast("string").alias("subroot"),
                                      F.array().cast(_STEPS).alias("steps"))
        for k in range(len(self.tiers) - 2, 0, -1):
            if k == self.turn - 1:   # from the subroots' tree to the groups': a subroot is its group's last tier
                above = self._named(above)
            else:
                found = self._meet(self.tiers[k].select("grp", "pos", "n", "digest"), above, _descend,
                                   f"grp string, pos bigint, digest string, subroot string, steps {_STEPS}")
                above = land(found.select("grp", "pos", "subroot", "steps"), f"merkle-above-{k}")
        if self.turn == 1:
            above = self._named(above)
        leaf = self.tiers[0].select("grp", "pos", "n", "digest", "presented", "id")
        kind = leaf.schema["id"].dataType.simpleString()
        got = self._meet(leaf, above, _proofs,
                         f"id {kind}, leaf string, subroot string, proof array<string>, folded_root string")
        root = F.lit(self.root).cast("string")
        return got.select("id", "leaf", "subroot", root.alias("root"), "proof", "folded_root",
                          (F.col("folded_root") == root).alias("verified"))

    def _named(self, above: DataFrame) -> DataFrame:
        """Steps above each subroot, by the group's name instead of its place."""
        own = self.subroots.select("pos", F.col("name").alias("grp"), F.col("digest").alias("subroot"))
        return above.select("pos", "steps").join(own, "pos").select("grp", F.lit(0).cast("long").alias("pos"), "subroot", "steps")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields: byte count, ``:`` and value, or ``-``."""
    parts = []
    for field in fields:
        x = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tree(docs: DataFrame, fields: list[str], id_col: str, group_col: str | None, changed: dict[str, Column] | None = None,
         fanout: int = FANOUT, levels: int = LEVELS) -> Tree:
    """The manifest of ``docs``. ``changed`` gives other values for fields of the rows as they are presented to
    :meth:`Tree.check`; without it they are presented as they are."""
    own = [F.col(f"`{c}`") for c in fields]
    shown = [(changed or {}).get(c, x) for c, x in zip(fields, own)]
    group = F.lit("-") if group_col is None else F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("-"))
    return Tree(docs.select(F.col(f"`{id_col}`").alias("id"), group.alias("grp"), leaf_digest(own).alias("digest"),
                            leaf_digest(shown).alias("presented")), fanout, levels)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPERED = 7


def op13_merkle_midstates(spark, sf_dir):
    """Leaf, subroot, root, proof and folded root of every whole document; where 7 divides the crc32 of the id, the
    presented row has one character more."""
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    got = tree(docs, FIELDS, "doc_id", "lang", {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return got.check().select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                              F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"), "folded_root", "verified")


def _leaf_sql(n_chars: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({p})::VARCHAR || ':' || {p}, '-')" for p in parts) + ")"


_CRC_SQL = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: ascii(c)::BIGINT)), lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8))"""

QUERIES = {"op13_merkle_midstates": op13_merkle_midstates}
#: crc32 comes from its polynomial; trees and folds are one recursion each, over levels.
SQL = {"op13_merkle_midstates": f"""
WITH RECURSIVE bits(i, c, k) AS (SELECT range, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce('=' || lang, '-') AS grp, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN xor({_CRC_SQL}, 4294967295) % {TAMPERED} = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END AS shown
  FROM documents, crc),
l AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY grp, doc_id, leaf) AS rid,
    row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
t(grp, lvl, pos, n, h) AS (SELECT grp, 0, pos, n, leaf FROM l
  UNION ALL SELECT grp, any_value(lvl) + 1, pos // {FANOUT}, (any_value(n) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos))
  FROM t WHERE n > 1 GROUP BY grp, pos // {FANOUT}),
s AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, n, h) AS (SELECT 0, pos, n, subroot FROM s
  UNION ALL SELECT any_value(lvl) + 1, pos // {FANOUT}, (any_value(n) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos))
  FROM u WHERE n > 1 GROUP BY pos // {FANOUT}),
top AS (SELECT h AS root FROM u WHERE n = 1),
runs AS (SELECT grp, lvl, pos // {FANOUT} AS parent, list(h ORDER BY pos) AS run FROM t WHERE n > 1 GROUP BY ALL),
up_runs AS (SELECT lvl, pos // {FANOUT} AS parent, list(h ORDER BY pos) AS run FROM u WHERE n > 1 GROUP BY ALL),
f(id, grp, lvl, pos, h, proof) AS (SELECT rid, grp, 0, pos, shown, '' FROM l
  UNION ALL SELECT f.id, f.grp, f.lvl + 1, f.pos // {FANOUT},
    sha256(array_to_string(list_concat(run[:f.pos % {FANOUT}], [f.h], run[f.pos % {FANOUT} + 2:]), '')),
    f.proof || array_to_string(list_concat(run[:f.pos % {FANOUT}], run[f.pos % {FANOUT} + 2:]), '')
  FROM f JOIN runs r ON r.grp = f.grp AND r.lvl = f.lvl AND r.parent = f.pos // {FANOUT}),
half AS (SELECT f.id, f.h, f.proof, s.pos, s.subroot FROM f JOIN s USING (grp) QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY f.lvl DESC) = 1),
g(id, lvl, pos, h, proof) AS (SELECT id, 0, pos, h, proof FROM half
  UNION ALL SELECT g.id, g.lvl + 1, g.pos // {FANOUT},
    sha256(array_to_string(list_concat(run[:g.pos % {FANOUT}], [g.h], run[g.pos % {FANOUT} + 2:]), '')),
    g.proof || array_to_string(list_concat(run[:g.pos % {FANOUT}], run[g.pos % {FANOUT} + 2:]), '')
  FROM g JOIN up_runs r ON r.lvl = g.lvl AND r.parent = g.pos // {FANOUT}),
e AS (SELECT id, h, proof FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1),
n AS (SELECT rid AS id, doc_id, leaf FROM l)
SELECT n.doc_id, n.leaf, half.subroot, top.root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = top.root AS verified
FROM n JOIN half USING (id) JOIN e USING (id), top"""}
