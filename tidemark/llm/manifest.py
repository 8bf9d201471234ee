"""Merkle manifest of a dataset: one 3-ary tree per group, a 3-ary tree over the groups' roots, an octopus multiproof.

A leaf is the digest of a row. Leaves lie in order of (group, key); position p of level k has the parent p // 3 of
level k + 1, and a level of more than one node always has a level above. Leaves are dealt to partitions of
`partition` rows each, whatever trees they belong to. A partition's leaves of one tree are neighbours, so the nodes
that it can't derive itself lie beside its own run on every level: at most two to the left and two to the right.
Each partition lists that smallest union of coordinates for all its leaves at once (`missing`), fetches it by one
join, derives the interior nodes that its proofs share, and expands the proof of every leaf from them.

No task ever holds a tree. Trees are built level by level in aligned subtrees of 3**LEVELS leaves, places come from
a range-partitioned order, and all columns that move between stages are keys and digests, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import beside
from ..operators.ordering import global_row_number
from .common import stored

ARITY = 3
LEVELS = 6  # levels that one aligned subtree climbs: 729 leaves
TALLEST = 39  # 3**39 leaves are more than a long counts
TOP = -1  # number of the tree over the groups' roots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = "tree long, level int, place long, digest string"
PROOF = "key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def canonical(column: Column) -> Column:
    """`-` for NULL, else the UTF-8 byte count, `:` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[canonical(c) for c in columns]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _at_level(place: Column, level: Column) -> Column:
    """The node above `place` on a level. Powers of 3 are exact here as doubles and longs up to 3**33."""
    return F.floor(place / F.pow(F.lit(float(ARITY)), level)).cast("long")


def _levels(n: Column) -> Column:
    """Levels of a tree of `n` leaves that have more than one node: those whose runs have siblings and parents."""
    return F.filter(F.sequence(F.lit(0), F.lit(TALLEST)), lambda k: F.pow(F.lit(float(ARITY)), k) < n)


def missing(first: Column, last: Column, n: Column) -> Column:
    """Coordinates (level, place) beside the leaves `first`..`last` of a tree of `n`: the smallest set that completes every run they are in."""

    def beside_run(k: Column) -> Column:
        a, z = _at_level(first, k), _at_level(last, k)
        nodes = _at_level(n - 1, k) + 1
        left = F.filter(F.sequence(a - 2, a), lambda p: (p < a) & (p >= a - F.pmod(a, F.lit(ARITY))))
        right = F.filter(F.sequence(z, z + 2), lambda p: (p > z) & (p < nodes) & (p < z - F.pmod(z, F.lit(ARITY)) + ARITY))
        return F.transform(F.concat(left, right), lambda p: F.struct(k.cast("int").alias("level"), p.alias("place")))

    return F.flatten(F.transform(_levels(n), beside_run))


def build(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """All nodes of the trees of `leaves` (tree, place, n, digest), and one row per tree (tree, digest) with its root.

    Every round climbs `LEVELS` levels by aligned subtrees of at most 3**LEVELS nodes, each one group.
    """

    def climb(nodes: pa.Table) -> pa.Table:
        n = nodes.column("n")[0].as_py()
        at = dict(zip(nodes.column("place").to_pylist(), nodes.column("digest").to_pylist()))
        level, out = nodes.column("level")[0].as_py(), []
        tree, left = nodes.column("tree")[0].as_py(), -(-n // ARITY ** level)
        for k in range(level + 1, level + LEVELS + 1):
            if left == 1:
                break
            left = -(-left // ARITY)
            runs: dict[int, list[str]] = {}
            for place in sorted(at):
                runs.setdefault(place // ARITY, []).append(at[place])
            at = {place: digest(run) for place, run in runs.items()}
            out += [(tree, k, place, d, n) for place, d in at.items()]
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()))], names=["tree", "level", "place", "digest", "n"])

    nodes = leaves.select("tree", F.lit(0).alias("level"), "place", "digest", "n")
    # One number: the leaves of the largest tree.
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels, open_, at = [nodes], nodes.where("n > 1"), 0
    while ARITY**at < largest:
        subtree = F.floor(F.col("place") / ARITY**LEVELS)
        grown = stored(open_.groupBy("tree", subtree.alias("subtree")).applyInArrow(climb, "tree long, level int, place long, digest string, n long"), f"manifest-{name}")
        levels.append(grown)
        at += LEVELS
        # A tree goes on if the last level of this round has more than one node.
        open_ = grown.where((F.col("level") == at) & (F.pow(F.lit(float(ARITY)), F.lit(at)) < F.col("n")))
    every = reduce(DataFrame.unionByName, levels)
    top = F.size(_levels(F.col("n")))
    return every.select("tree", "level", "place", "digest"), every.where(F.col("level") == top).select("tree", "digest", "n")


def ordered(rows: DataFrame, group: str = "group", key: str = "key") -> tuple[DataFrame, DataFrame]:
    """`rows` with `at` (place in the order of group and key, from 0), and per group its `tree` number, `start` and `n`."""
    order = [F.col(group).asc_nulls_first(), F.col(key).asc_nulls_first(), F.col("digest"), F.col("changed")]
    placed = stored(global_row_number(rows, order, "at").withColumn("at", F.col("at") - 1), "manifest-order")
    groups = placed.groupBy(group).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    return placed, stored(global_row_number(groups, [F.col(group).asc_nulls_first()], "tree").withColumn("tree", F.col("tree") - 1), "manifest-groups")


def manifest(
    rows: DataFrame, columns: list[str], key: str, group: str, tampered: Column | None = None, tampered_column: str | None = None, partition: int = 2048
) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes `columns` in order. Trees are those of `group` (NULL is a group of its own, the first) and their leaves
    ascend by `key` (NULL first), then by digest, so that repeated rows have places of their own and equal rows may
    swap them. `tampered` is what stands in `tampered_column` when a proof is checked; NULL means that the row was left
    alone. An empty table gives no rows. Columns that aren't named are ignored, whatever their names.
    """
    of = {c: F.col(f"`{c}`") for c in columns}
    kind = rows.schema[key].dataType.simpleString()
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf([tampered if c == tampered_column else of[c] for c in columns]))
    hashed = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("group"), leaf(list(of.values())).alias("digest"), changed.alias("changed"))
    placed, groups = ordered(hashed)
    total = groups.agg(F.count(F.lit(1)).alias("trees"))

    block = F.floor(F.col("at") / partition).alias("block")
    blocks = F.sequence(F.floor(F.col("start") / partition), F.floor((F.col("start") + F.col("n") - 1) / partition))
    spans = stored(groups.withColumn("block", F.explode(blocks)), "manifest-spans")
    cut = placed.select("*", block)
    same = (F.col("l.block") == F.col("s.block")) & F.col("l.group").eqNullSafe(F.col("s.group"))
    leaves = stored(
        cut.alias("l").join(spans.alias("s"), same).select("l.block", "s.tree", (F.col("at") - F.col("start")).alias("place"), "n", "key", "digest", "changed"),
        "manifest-leaves",
    )
    low, roots = build(leaves, "nodes")
    top_leaves = stored(roots.transform(beside, total).select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("n"), "digest"), "manifest-subroots")
    high, _ = build(top_leaves, "top")
    nodes = low.unionByName(high)

    # Coordinates that each partition misses, in its trees and in the tree of roots.
    a = F.greatest(F.col("start"), F.col("block") * partition) - F.col("start")
    z = F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * partition) - F.col("start") - 1
    own = spans.select("block", "tree", F.explode(missing(a, z, F.col("n"))).alias("c"))
    ends = spans.groupBy("block").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).transform(beside, total)
    above = ends.select("block", F.lit(TOP).cast("long").alias("tree"), F.explode(missing(F.col("lo"), F.col("hi"), F.col("trees"))).alias("c"))
    wanted = stored(own.unionByName(above).select("block", "tree", "c.level", "c.place"), "manifest-wanted")
    fetched = stored(wanted.join(nodes, ["tree", "level", "place"]).select("block", "tree", "level", "place", "digest"), "manifest-fetched")

    mine = leaves.select("block", "tree", "place", "n", "key", "digest", "changed").transform(beside, total)
    return mine.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(_prove(kind), PROOF.format(key=kind))


class _Tree:
    """The part of one tree that a partition knows: fetched nodes, its own leaves and the interiors derived from both."""

    def __init__(self, n: int, known: dict[tuple[int, int], str], leaves: dict[int, str]):
        self.sizes = [n]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // ARITY))
        self.levels = [dict(leaves)]
        for k, size in enumerate(self.sizes[:-1]):
            level = self.levels[k]
            parents = sorted({p // ARITY for p in level})
            for parent in (parents[0], parents[-1]):  # only these can have siblings of other partitions
                for p in self.run(parent, size):
                    if p not in level:
                        level[p] = known[k, p]
            self.levels.append({q: digest([level[p] for p in self.run(q, size)]) for q in parents})
        self.root = self.levels[-1][0]
        self.tails: list[dict[int, str]] = [{} for _ in self.levels]

    @staticmethod
    def run(parent: int, size: int) -> range:
        return range(parent * ARITY, min((parent + 1) * ARITY, size))

    def siblings(self, place: int, level: int = 0) -> str:
        """All siblings from a node up, as the proof lists them; nodes with a common parent share its part."""
        if level == len(self.levels) - 1:
            return ""
        tails, parent = self.tails[level + 1], place // ARITY
        if parent not in tails:
            tails[parent] = self.siblings(parent, level + 1)
        known = self.levels[level]
        return "".join(known[p] for p in self.run(parent, self.sizes[level]) if p != place) + tails[parent]

    def fold(self, place: int, value: str) -> str:
        """The root that follows from a node's value and its siblings."""
        for level, size in zip(self.levels, self.sizes[:-1]):
            value = digest([value if p == place else level[p] for p in self.run(place // ARITY, size)])
            place //= ARITY
        return value


def _prove(kind: str):
    def prove(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        known: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, place, d in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "place", "digest"))):
            known.setdefault(tree, {})[level, place] = d
        columns = {c: leaves.column(c).to_pylist() for c in ("tree", "place", "n", "digest", "changed")}
        own: dict[int, dict[int, str]] = {}
        sizes = dict(zip(columns["tree"], columns["n"]))
        for tree, place, d in zip(columns["tree"], columns["place"], columns["digest"]):
            own.setdefault(tree, {})[place] = d
        trees = {t: _Tree(sizes[t], known.get(t, {}), at) for t, at in own.items()}
        top = _Tree(leaves.column("trees")[0].as_py() if len(leaves) else 1, known.get(TOP, {}), {t: x.root for t, x in trees.items()})
        out = []
        for tree, place, d, changed in zip(columns["tree"], columns["place"], columns["digest"], columns["changed"]):
            mine = trees[tree]
            proof = digest([mine.siblings(place), top.siblings(tree)])
            folded = top.fold(tree, mine.fold(place, changed or d))
            out.append((d, mine.root, top.root, proof, folded, folded == top.root))
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        kinds = [pa.string()] * 5 + [pa.bool_()]
        return pa.table([leaves.column("key").combine_chunks(), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=["key", *names])

    return prove
