"""Spelling variants against plain loops: accents, long words, ties, chains, split blocks, nulls, repeats, empty tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import variants

DOCS = "doc_id long, text string, word string, n long, block string, near string"


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def loop(rows, each=199):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            crc = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            total[run if crc % each else run[: crc % len(run)] + run[crc % len(run) + 1 :]] += 1
    words = {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if edits(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def made(seed, count):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abeitÉéüÿ") for _ in range(rng.randrange(6, 10))) for _ in range(count)]
    words = []
    for w in base:
        words += [w] * rng.choice([5, 6, 30, 200])
        for _ in range(3):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + "é" + w[i + 1 :], w[:i] + "x" + w[i:]])] * rng.choice([4, 5, 6, 40])
    rng.shuffle(words)
    return [(i, " ".join(words[i * 50 : i * 50 + 50])) for i in range(len(words) // 50 + 1)]


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, "w", 1, "b", "x") for i, t in rows], DOCS)
    return {tuple(r) for r in variants.variants(frame, **options).collect()}


@pytest.mark.parametrize("each", [199, 3])
def test_words_and_forms(spark, each):
    long_ = "a" * 40_000
    rows = made(1, 60) + [(1000, " ".join([long_] * 5 + [long_ + "b"] * 30)), (None, "Orange_ORANGE1orange orange Orange"), (1001, None), (1002, ""), (1002, "× ÷÷÷÷÷÷÷")] * 2
    assert run(spark, rows, each=each) == loop(rows, each)
    assert run(spark, []) == set()


def test_split_blocks(spark):
    words = spark.createDataFrame([(w, n) for w, n in {r[0]: r[3] for r in loop(made(2, 150))}.items()], "word string, n long")
    whole = {tuple(r) for r in variants.near_words(words).collect()}
    assert whole == {tuple(r) for r in variants.near_words(words, most=3, partitions=5).collect()}
    known = {r.word: r.n for r in words.collect()}
    near = {w: [v for v in known if edits(w, v)] for w in known}
    best = {w: min(v, key=lambda x: (-known[x], x)) for w, v in near.items() if v}
    assert whole == {(w, len(near[w]), best[w], known[best[w]]) for w in best} and len(whole) > 100


def test_one_edit_against_loop():
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("abé"), rng.integers(1, 7))) for _ in range(120)], object)
    a = variants._Words(words, np.ones(len(words), np.int64))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    assert variants._one_edit(a, i, a, j).tolist() == [edits(words[x], words[y]) for x, y in zip(i, j)]


def test_chain_of_forms(spark):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb"]
    rows = [(i, " ".join([w] * 5**i * 5)) for i, w in enumerate(words)]
    got = {w: (form, root) for w, form, root, *_ in run(spark, rows, each=10**9)}
    assert got == {w: (words[i + 1] if i < 3 else None, "aaabbb") for i, w in enumerate(words)}
