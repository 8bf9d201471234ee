"""Merkle manifest against a plain tree: nulls, ties, repeats, one-leaf and uneven trees, tampering, empty tables."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, at long, digest string, tree string, key string, block string, group string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, place):
    out = []
    for level in tree[:-1]:
        run = place // 3 * 3
        out.append((place - run, [x for i, x in enumerate(level[run : run + 3]) if i != place - run]))
        place //= 3
    return out


def loop(rows, changed):
    """Leaf, subroot, root, proof, folded root and verdict of every row, by whole trees."""
    of = defaultdict(list)
    for r in rows:
        leaf = h([enc(v) for v in r])
        of[r[1]].append(((r[0] is not None, r[0] or 0), leaf, r))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf for _, leaf, _ in sorted(of[s], key=lambda x: x[:2])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for t, s in enumerate(names):
        for place, (_, leaf, r) in enumerate(sorted(of[s], key=lambda x: x[:2])):
            steps = siblings(trees[s], place) + siblings(top, t)
            text = changed(r)
            value = leaf if text is None else h([enc(v) for v in (*r[:4], text)])
            for i, others in steps:
                value = h([*others[:i], value, *others[i:]])
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], h([x for _, others in steps for x in others]), value, value == top[-1][0]))
    return out


def run(spark, rows, partition):
    frame = spark.createDataFrame([(*r, 1, "d", "t", "k", "b", "g") for r in rows], DOCS)
    tampered = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return frame, manifest.manifest(frame, list(manifest.FIELDS), "doc_id", "source", tampered, "text", partition)


def changed(r):
    return r[4].replace("\n", "") if r[0] is not None and r[0] % 3 == 0 and r[4] is not None else None


@pytest.mark.parametrize("partition", [1, 7, 40, 10_000])
def test_proofs(spark, partition):
    rng = random.Random(3)
    sizes = {None: 1, "a": 82, "b": 3, "c": 27, "é": 4, "Z": 10, "hot": 731 if partition > 1 else 90}
    rows = [(rng.randrange(10**6), s, rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "ü" * rng.randrange(9)])) for s, n in sizes.items() for _ in range(n)]
    rows += [(None, "a", None, None, None), rows[5], rows[5], (rows[9][0], rows[9][1], "de", 1, "other")]
    frame, got = run(spark, rows, partition)
    assert got.columns == ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(loop(rows, changed))


def test_one_row_and_none(spark):
    one = [(7, None, None, None, "x" * 300_000 + "\n")]
    _, got = run(spark, one, 5)
    assert list(map(tuple, got.collect())) == loop(one, changed)
    _, got = run(spark, [], 5)
    assert got.collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_missing_is_the_smallest_union(spark, n):
    """Without any one of the coordinates no proof of the range is whole; with all of them every one is."""
    ranges = [(a, z, n) for a in range(n) for z in range(a, n)]
    got = spark.createDataFrame(ranges, "a long, z long, n long").select("a", "z", manifest.missing(F.col("a"), F.col("z"), F.col("n")).alias("m")).collect()
    tree = levels([str(i) for i in range(n)])
    for r in got:
        own, want = set(range(r.a, r.z + 1)), set()
        for k in range(len(tree) - 1):
            want |= {(k, p) for q in {x // 3 for x in own} for p in range(q * 3, min(q * 3 + 3, len(tree[k]))) if p not in own}
            own = {x // 3 for x in own}
        assert {(m.level, m.place) for m in r.m} == want and len(r.m) == len(want)
