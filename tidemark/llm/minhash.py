"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap.

A signature follows BagMinHash: every shingle owns Poisson processes over the units of its weight. Units
lie in dyadic intervals [0,1), [1,2), [2,4), [4,8), ... with one process each, whose rate is the interval's
length; a point falls on a place in the interval (splitting the process in halves, down to one unit) and on one
of the `M` positions. Points within the shingle's count stand, and each position keeps its earliest point. Processes
run only until they pass the latest of these. Two texts agree on a position with probability min / max of
their weights, summed over all shingles.

Texts with one multiset are one node. Nodes that share a band (five positions) are candidates. No bucket is
expanded into pairs: first every node is compared with its bucket's centre, the member that meets most others;
then, in buckets whose members aren't one class by now, the nodes outside the centre's class are compared with the
others by their signatures, block against block inside the tasks, and what may reach the threshold is verified on
the full multisets. A link counts when the weighted Jaccard similarity is at least 0.8; classes are the connected parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, located, stored
from .shingles import mixed, multisets, occurrences

BANDS, ROWS = 25, 5
M = BANDS * ROWS
SIMILARITY = 0.8
# Positions two signatures must share to be verified in the block step: at similarity 0.8 the mean is 100 of
# 125 with a deviation of 4.5, so fewer than 78 have a chance below one in a million.
AGREE = 78
# A second, longer signature of one byte a position settles most of those: mean 411 of 512 at 0.8, deviation 9.
FINE, FINE_AGREE = 512, 371
BLOCK = 1024
_STEP = np.uint64(0xD1342543DE82EF95)


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """n x m 64-bit values; rows without shingles are zero. `count` holds positive integers."""
    best = np.full(n * m, np.inf)
    shells = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))), 0).astype(np.int64)
    # Counts near a power of two: exact, as integers below 2^53 are.
    who = np.repeat(owner, shells + 1)
    shell = np.arange(len(who)) - np.repeat(np.cumsum(shells + 1) - shells - 1, shells + 1)
    weight = np.repeat(count, shells + 1).astype(np.float64)
    low = np.where(shell > 0, 2.0 ** (shell - 1), 0.0)
    rate = np.where(shell > 0, low, 1.0)
    with np.errstate(over="ignore"):
        state = mixed(mixed(np.repeat(shingle, shells + 1) + np.uint64(m)) + shell.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    time = np.zeros(len(who))
    latest = np.full(n, np.inf)
    while len(who):
        with np.errstate(over="ignore"):
            state = state + _STEP
            a = mixed(state)
            b = mixed(a ^ np.uint64(0x5851F42D4C957F2D))
        time = time - np.log1p(-((a >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
        live = time < latest[who]
        who, state, time, rate, low, weight, b = (x[live] for x in (who, state, time, rate, low, weight, b))
        place = low + (b >> np.uint64(32)).astype(np.float64) * 2.0**-32 * rate
        stands = place < weight
        at = who[stands] * m + ((b[stands] & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, at, time[stands])
        latest = best.reshape(n, m).max(axis=1)
    best[np.isinf(best)] = 0.0
    return mixed(best.view(np.uint64)).reshape(n, m)


def _parts(batches: Iterator[pa.RecordBatch], size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Row runs of bounded text size (a longer text alone)."""
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _names(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> list[bytes | None]:
    """A 128-bit name for each multiset, None where it is empty."""
    cuts = np.searchsorted(owner, np.arange(n + 1))
    return [
        xxhash.xxh3_128_digest(shingle[a:b].tobytes() + count[a:b].tobytes()) if b > a else None for a, b in zip(cuts, cuts[1:])
    ]


def sketch(rows: DataFrame) -> DataFrame:
    """(columns before the last, bag, n, sig, bands) of rows whose last column is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            k = part.num_rows
            owner, shingle, count = multisets(part.column(part.num_columns - 1).to_pylist())
            sig = signatures(owner, shingle, count, k)
            with np.errstate(over="ignore"):
                bands = np.zeros((k, BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    bands = mixed(bands + sig[:, r::ROWS][:, :BANDS])
                bands = mixed(bands + np.arange(BANDS, dtype=np.uint64))
            flat = pa.array(bands.view(np.int64).ravel(), pa.int64())
            columns = [
                pa.array(_names(owner, shingle, count, k), pa.binary()),
                pa.array(np.bincount(owner, weights=count, minlength=k).astype(np.int64), pa.int64()),
                _binary(sig.astype(np.uint16)),
                pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * BANDS, pa.int32()), flat),
            ]
            kept = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*part.schema.names[:-1], "bag", "n", "sig", "bands"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return in_small_batches(rows).mapInArrow(run, f"{fields}, bag binary, n long, sig binary, bands array<long>")


def bags(rows: DataFrame) -> DataFrame:
    """(bag, items, fine) of rows (bag, text): the multiset with every occurrence an item of its own, and the long signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = multisets(part.column(1).to_pylist())
            who, item = occurrences(*found)
            fine = _binary(signatures(*found, part.num_rows, FINE).astype(np.uint8))
            cuts = pa.array(np.searchsorted(who, np.arange(part.num_rows + 1)), pa.int32())
            items = pa.ListArray.from_arrays(cuts, pa.array(item.view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), items, fine], ["bag", "items", "fine"])

    return in_small_batches(rows).mapInArrow(run, "bag binary, items array<long>, fine binary")


def verified(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (a, b) whose weighted Jaccard similarity reaches the threshold, with it."""
    one = items.select(F.col("bag").alias("a"), F.col("items").alias("x"))
    two = items.select(F.col("bag").alias("b"), F.col("items").alias("y"))
    both = pairs.join(one, "a").join(two, "b")
    met = F.size(F.array_intersect("x", "y"))
    found = both.select("a", "b", (met / (F.size("x") + F.size("y") - met)).alias("similarity"))
    return found.where(F.col("similarity") >= SIMILARITY)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the least node of its connected part.

    Large-star and small-star rounds; each is an aggregation by node and a join, both free of whole neighbourhoods.
    """
    edges = stored(edges.select("a", "b").where("a != b").distinct(), "cc-edges")

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = both if large else both.where("b < a")
        least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = seen.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    mark = None
    while True:
        edges = stored(star(star(edges, True), False), "cc-edges")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    pairs = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
    return pairs.unionByName(edges.select(F.least("a", "b").alias("node"), F.least("a", "b").alias("label"))).distinct()


def _blocks(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels whose signatures say they may be similar enough.

    Rows: block, nth (number of the band), side, bag, label, n, sig, fine. Rows of one block lie together in their
    partition; a block holds about `BLOCK` rows on each side. A pair is told in the first band it shares only.
    """

    def compare(group: list[tuple]) -> tuple[list[bytes], list[bytes]]:
        sides = [[g for g in group if g[2] == k] for k in (0, 1)]
        if not all(sides):
            return [], []
        sig, fine = ([np.frombuffer(b"".join(g[k] for g in x), dtype=t).reshape(len(x), -1) for x in sides] for k, t in ((6, np.uint16), (7, np.uint8)))
        names = np.array([g[4] for g in sides[1]], dtype=object)
        sizes = np.array([g[5] for g in sides[1]])
        nth, a, b = group[0][1], [], []
        for i, g in enumerate(sides[0]):
            near = (names != g[4]) & (np.minimum(sizes, g[5]) >= SIMILARITY * np.maximum(sizes, g[5]))
            at = np.flatnonzero(near)
            same = sig[1][at] == sig[0][i]
            at, same = at[(good := same.sum(axis=1) >= AGREE)], same[good]
            at = at[same.reshape(len(at), BANDS, ROWS).all(axis=2).argmax(axis=1) == nth]
            at = at[(fine[1][at] == fine[0][i]).sum(axis=1) >= FINE_AGREE]
            for j in at:
                x, y = sorted((g[3], sides[1][j][3]))
                a.append(x)
                b.append(y)
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            a, b = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    x, y = compare(group)
                    a += x
                    b += y
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        a, b = compare(group)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def classes(sketched: DataFrame, text_of: DataFrame) -> DataFrame:
    """(bag, label) for the nodes that have a link. `text_of`: (bag, text) of all rows, read again for those in question."""
    nodes = sketched.where(F.col("bag").isNotNull()).groupBy("bag").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = stored(nodes, "near-nodes")
    keyed = nodes.select("bag", "n", F.posexplode("bands").alias("nth", "band"))
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    links = stored(keyed.join(shared, "band"), "near-links")
    degree = links.groupBy("bag").agg(F.sum("members").alias("degree"), F.first("n").alias("n"))
    degree = stored(degree, "near-degree")
    links = links.drop("n").join(degree, "bag")
    centre = links.groupBy("band").agg(F.max(F.struct("degree", "bag", "n")).alias("c")).select("band", F.col("c.bag").alias("centre"), F.col("c.n").alias("cn"))
    links = stored(links.join(centre, "band"), "near-links")
    close = F.least("n", "cn") >= SIMILARITY * F.greatest("n", "cn")
    stars = links.where((F.col("bag") != F.col("centre")) & close).select(*_pair("bag", "centre")).distinct()
    texts = text_of.join(degree.select("bag"), "bag", "left_semi")
    items = stored(bags(texts.dropDuplicates(["bag"])), "near-items")
    stars = stored(stars, "near-stars")
    edges = stored(verified(stars, items), "near-edges")
    labels = stored(components(edges), "near-labels")
    named = links.join(labels.withColumnRenamed("node", "bag"), "bag", "left").withColumn("label", F.coalesce("label", "bag"))
    named = stored(named.select("band", "nth", "bag", "n", "label", "centre", "members"), "near-named")
    of_centre = named.where("bag = centre").select("band", F.col("label").alias("main"))
    # Buckets of three and more that aren't one class; the centre itself has been compared with all.
    sides = named.join(of_centre, "band").withColumn("apart", F.col("label") != F.col("main"))
    open_ = sides.groupBy("band").agg(F.sum(F.col("apart").cast("int")).alias("outside")).where("outside > 0")
    sides = sides.where("members > 2 and bag != centre").join(open_, "band").join(nodes.select("bag", "sig"), "bag").join(items.select("bag", "fine"), "bag")
    cells = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("bag"), cells(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), cells(n) - 1))
    left = sides.where("apart").withColumns({"i": mine("outside")}).withColumn("j", every("members")).withColumn("side", F.lit(0))
    right = sides.withColumns({"j": mine("members")}).withColumn("i", every("outside")).withColumn("side", F.lit(1))
    both = left.unionByName(right).select(F.xxhash64("band", "i", "j").alias("block"), "nth", "side", "bag", "label", "n", "sig", "fine")
    found = _blocks(both.repartition("block").sortWithinPartitions("block")).distinct()
    found = stored(found.join(stars, ["a", "b"], "left_anti"), "near-pairs")
    more = verified(found, items).select("a", "b")
    return components(edges.select("a", "b").unionByName(more))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, class_id, class_size, kept, `__file`, `__row`.

    Rows are in one class when their word 5-shingle multisets have a weighted Jaccard similarity of at least 0.8,
    directly or over others. The class is named after its row with the smallest id (NULL ids last, then first place),
    which is also the one that stays. Rows without a word (NULL, empty, symbols only) are classes of their own; rows
    repeated in full are one class. Other columns are ignored; an empty table gives an empty result.
    """
    placed = located(docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")))
    rows = stored(sketch(placed.select("id", "__file", "__row", "text")), "near-rows")
    text_of = placed.join(rows.where("bag is not null").select("__file", "__row", "bag"), ["__file", "__row"]).select("bag", "text")
    labels = classes(rows.drop("id", "__file", "__row"), text_of)
    named = rows.select("id", "__file", "__row", "bag").join(labels.withColumnRenamed("node", "bag"), "bag", "left")
    own = F.concat(F.encode(F.col("__file"), "utf-8"), F.encode(F.concat(F.lit("#"), F.col("__row")), "utf-8"))
    named = stored(named.withColumn("label", F.coalesce("label", "bag", own)).drop("bag"), "near-classes")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "__file", "__row")).alias("first")
    heads = named.groupBy("label").agg(first, F.count(F.lit(1)).alias("class_size"))
    is_first = (F.col("__file") == F.col("first.__file")) & (F.col("__row") == F.col("first.__row"))
    return named.join(heads, "label").select("id", F.col("first.id").alias("class_id"), "class_size", is_first.alias("kept"), "__file", "__row")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their own columns."""
    placed = located(docs)
    gone = near_duplicates(placed.drop("__file", "__row"), key, text).where("not kept").select("__file", "__row")
    return placed.join(gone, ["__file", "__row"], "left_anti").select(*docs.columns)
