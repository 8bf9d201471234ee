"""Nearest neighbours by inner product as a block matrix join of int8 product tiles.

Vectors and queries are dealt to blocks by a hash of their row; every (query block, vector block) pair is one tile
and one group of a shuffle, of bounded size. Inside a tile both sides are quantised to int8 with a scale per vector.
The products of the tile's integers (exact in float32) give distances with a proven error bound per pair,

    |x.y - sx sy (qx.qy)|  <=  |x| |ey| + |ex| |y'|      (e: what rounding lost, y': the rounded vector),

so a pair whose upper end lies under the k-th largest lower end of its query can't be among the tile's k nearest.
All others are recomputed in double precision. Tile results are merged by heaps, a bounded number of tiles at a time.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_FOUND = pa.schema([("qblock", pa.int32()), ("vblock", pa.int32()), ("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_DDL = "qblock int, vblock int, query_row long, query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Vectors that take part: not NULL, not zero, without NULL or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else flat
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, length of the vector, of its rounded form, of the error)."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    rounded = q * scale[:, None]
    length = lambda v: np.sqrt((v * v).sum(axis=1))
    return q, scale, length(x), length(rounded), length(x - rounded)


def tile_nearest(qrow: np.ndarray, q: np.ndarray, vrow: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, step: int = 256):
    """(place of the query, vector id, score) of each query's k nearest other rows in the tile, ties to the smaller id."""
    v8, vs, _, v_rounded, v_lost = _quantised(v)
    v8 = v8.astype(np.float32)
    # Sums of up to 2^24 are exact in float32: chunks of components keep them below.
    chunk = (1 << 24) // (127 * 127)
    for at in range(0, len(q), step):
        x = q[at : at + step]
        x8, xs, x_length, _, x_lost = _quantised(x)
        products = np.zeros((len(x), len(v)))
        for c in range(0, x.shape[1], chunk):
            products += x8[:, c : c + chunk].astype(np.float32) @ v8[:, c : c + chunk].T
        near = products * xs[:, None] * vs
        slack = (x_length[:, None] * v_lost + x_lost[:, None] * v_rounded) * (1 + 1e-9) + np.abs(near) * 1e-12
        own = qrow[at : at + step, None] == vrow
        low = np.where(own, -np.inf, near - slack)
        least = np.partition(low, -k, axis=1)[:, -k] if len(v) > k else np.full(len(x), -np.inf)
        row, col = np.nonzero((near + slack >= least[:, None]) & ~own)
        score = np.zeros(len(row))
        for c in range(x.shape[1]):  # component by component, so that the sum's order is fixed
            score += x[row, c] * v[col, c]
        order = np.lexsort((vid[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < k
        yield at + row[top], vid[col[top]], score[top]


def search(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
    vector_block: int = 4096, query_block: int = 1024, fan_in: int = 32,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products over all other rows.

    Vectors that are NULL, zero or hold NULL or non-finite components, and rows without id, take no part. Vectors are
    compared with those of their own length. Rows are told apart by themselves, not by their id: each row that shares an id
    with others, or repeats one in full, is a candidate of all rows but itself, and as a query it has a list of its own (such
    lists stand side by side under one query_id). Ties go to the smaller id; with fewer than k candidates all are given.
    An empty table gives an empty result. Other columns are ignored.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = stored(rows.where(usable(F.col("v")) & F.col("id").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "near-vectors")
    total, queries = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    vblocks, qblocks = max(1, -(-total // vector_block)), max(1, -(-queries // query_block))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where("q").select("row", "id", "v", dealt(qblocks).alias("qblock")).withColumn("vblock", every(vblocks))
    right = rows.select("row", "id", "v", dealt(vblocks).alias("vblock")).withColumn("qblock", every(qblocks))
    size = F.size("v").alias("dims")
    tile = ["qblock", "vblock", "dims"]

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        # Columns by place: row, id, v, qblock, vblock, dims.
        if not one.num_rows or not two.num_rows:
            return _FOUND.empty_table()
        (qrow, qid), (vrow, vid) = ([t.column(n).to_numpy() for n in (0, 1)] for t in (one, two))
        a, b, s = (np.concatenate(x) for x in zip(*tile_nearest(qrow, _matrix(one.column(2)), vrow, vid, _matrix(two.column(2)), k)))
        place = [np.full(len(a), one.column(n)[0].as_py(), dtype=np.int32) for n in (3, 4)]
        return pa.table([*place, qrow[a], qid[a], b, s], schema=_FOUND)

    # Aliased columns: both sides come from one table, and a cogroup must not take them for the same columns.
    sides = [s.select(F.col("row").alias(f"{n}_row"), F.col("id").alias(f"{n}_id"), F.col("v").alias(f"{n}_v"), "qblock", "vblock", size).groupBy(*tile) for n, s in (("q", left), ("c", right))]
    found = sides[0].cogroup(sides[1]).applyInArrow(run, _DDL)

    def merge(part: pa.Table) -> pa.Table:
        heaps: dict[tuple[int, int], dict[int, list]] = {}
        for block, row, query, vec, score in zip(*(part.column(n).to_pylist() for n in ("vblock", "query_row", "query_id", "vec_id", "score"))):
            heaps.setdefault((row, query), {}).setdefault(block, []).append((-score, vec))
        out = [(*q, vec, -low) for q, lists in heaps.items() for low, vec in islice(heapq.merge(*(sorted(x) for x in lists.values())), k)]
        place = [np.full(len(out), part.column(n)[0].as_py(), dtype=np.int32) for n in ("qblock", "group")]
        return pa.table([pa.array(x, f.type) for x, f in zip([*place, *zip(*out)], _FOUND)], schema=_FOUND)

    while True:
        # A group holds at most query_block x fan_in x k rows, whatever the number of vectors.
        grouped = found.withColumn("group", (F.col("vblock") / fan_in).cast("int"))
        found = grouped.groupBy("qblock", "group").applyInArrow(merge, _DDL)
        vblocks = -(-vblocks // fan_in)
        if vblocks <= 1:
            break
    listed = found.groupBy("query_row", "query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))).alias("near"))
    ranked = listed.select("query_id", F.posexplode("near").alias("place", "n"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.low")).alias("score"))
