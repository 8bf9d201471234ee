"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One edit moves the letter counts of a word by a squared distance of 1 (a letter more or less) or 2 (one letter for
another). Words are dealt to blocks by the counts of `GROUPS` letter groups, which together give the length: an
edited word lies in the same block or in one whose counts differ by one letter added, taken or moved. Every block
gets its own words and those of its neighbours, computes squared distances as |a|^2 + |b|^2 - 2ab by one NumPy
product per tile, keeps pairs at most two apart, and compares the letters of those by place.

A block of more than `most` words is split by hash, and its neighbours' words go to every part, so a task holds one
part and a batch of its partners, never a block. Each pair meets in one place, so counts add up without a table of
pairs: a block sends one row per word that found any.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RUN = re.compile("[a-zÀ-ÿ]+")
GROUPS = 5
BITS = 12  # of a group's count in a block's number; larger counts wrap round, which only lets far blocks meet
FREQUENT = "etaoinshrdlucmfwypvbgkqjxz"  # dealt in turn, so that groups are of similar weight
FOUND = "word string, n long, near_n long, near string, n_near long"


def changed(key_crc: int, word: str, each: int) -> str:
    """`word`, without one letter where `each` divides the CRC-32 of `<key>:<word>`, of which `key_crc` is the first part's."""
    h = zlib.crc32(word.encode(), key_crc)
    return word if h % each else word[: (k := h % len(word))] + word[k + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", each: int = 199, held: int = 100_000) -> DataFrame:
    """`word`, `n` over all rows: letter runs in lower case (A-Z only), after `changed`. NULL text has none, a NULL key counts as `null`.

    A task counts up to `held` different words before it sends them on, so very long texts need no more memory.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for k, body in zip(batch.column(0), batch.column(1)):
                key_crc = zlib.crc32(f"{k.as_py()}:".encode())
                # Bytes have no lower case but that of A-Z.
                for word, n in Counter(RUN.findall((body.as_py() or "").encode().lower().decode())).items():
                    total[changed(key_crc, word, each)] += n
                if len(total) >= held:
                    yield send()
        if total:
            yield send()

    pair = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return pair.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(group: int) -> str:
    accented = [chr(c) for c in range(0xC0, 0x100) if c % GROUPS == group]
    return FREQUENT[group::GROUPS] + "".join(accented)


def _block(counts: list[Column]) -> Column:
    """A block's number from its counts."""
    out = F.lit(0).cast("long")
    for g, c in enumerate(counts):
        out = out + F.pmod(c, F.lit(1 << BITS)).cast("long") * F.lit(1 << (BITS * g))
    return out


def _routes(counts: list[Column]) -> Column:
    """Where a word goes: its own block as owner (0) and as partner (1); blocks of which it may be an edit, as partner from outside (2).

    Of two neighbours one goes to the other: the longer to the shorter, and of equal lengths by the order of groups.
    """

    def at(kind: int, less: int | None = None, more: int | None = None) -> Column:
        moved = [c + int(g == more) - int(g == less) for g, c in enumerate(counts)]
        there = F.lit(True) if less is None else counts[less] > 0
        return F.when(there, F.struct(_block(moved).alias("block"), F.lit(kind).alias("kind")))

    routes = [at(0), at(1)]
    for g in range(GROUPS):
        routes += [at(2, g)] + [at(2, g, h) for h in range(g + 1, GROUPS)]
    return F.array_compact(F.array(*routes))


def near_words(words: DataFrame, most: int = 2000, partitions: int | None = None) -> DataFrame:
    """Per word with any near word: word, n_near, and near, near_n: the near word of largest n (ties: smallest in code-point order).

    `words`: one row per word (`word`, `n`), letters of a to z and U+00C0 to U+00FF only.
    """
    counts = [F.length("word") - F.length(F.translate("word", _letters(g), "")) for g in range(GROUPS)]
    routed = words.select("word", "n", F.explode(_routes(counts)).alias("r")).select("word", "n", "r.block", "r.kind")
    blocks = routed.where("kind = 0").groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    blocks = stored(blocks.select("block", F.ceil(F.col("size") / most).cast("int").alias("parts")), "variant-blocks")
    own = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = routed.join(blocks, "block").select("block", "kind", "word", "n", F.explode(F.when(F.col("kind") == 0, own).otherwise(every)).alias("part"))
    spread = dealt.repartition(partitions, "block", "part") if partitions else dealt.repartition("block", "part")
    ordered = spread.sortWithinPartitions("block", "part", "kind").select("block", "part", "kind", "word", "n")
    found = ordered.mapInArrow(_meet, FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n")
    )


class _Words:
    """Words beside their letters by place and their letter counts."""

    def __init__(self, words: np.ndarray, n: np.ndarray):
        # Every letter is one byte in Latin-1.
        self.words, self.n = words, n
        raw = [w.encode("latin-1") for w in words]
        self.lengths = np.array([len(r) for r in raw])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        # Accented letters share 32 columns with the plain ones: an edit still moves the distance by two at most.
        of = np.repeat(np.arange(len(raw)), self.lengths)
        self.counts = np.bincount(of * 32 + self.flat % 32, minlength=len(raw) * 32).reshape(-1, 32).astype(np.float64)
        self.squares = (self.counts**2).sum(axis=1)
        self.n_near = np.zeros(len(raw), np.int64)
        self.best: list = [None] * len(raw)

    def rows(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.flat[self.starts[at][:, None] + np.arange(length)]

    def sent(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.n_near)
        columns = [
            pa.array(self.words[at], pa.string()), pa.array(self.n[at], pa.int64()), pa.array([-self.best[i][0] for i in at], pa.int64()),
            pa.array([self.best[i][1] for i in at], pa.string()), pa.array(self.n_near[at], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["word", "n", "near_n", "near", "n_near"])


def _one_edit(a: _Words, i: np.ndarray, b: _Words, j: np.ndarray) -> np.ndarray:
    """Which pairs (a[i], b[j]) differ by exactly one inserted, deleted or replaced letter."""
    out = np.zeros(len(i), bool)
    size, other = a.lengths[i], b.lengths[j]
    for length in np.unique(np.minimum(size, other)):
        for step in (0, -1, 1):
            pick = np.flatnonzero((np.minimum(size, other) == length) & (size - other == step))
            # Letters by place of some pairs at a time: bounded memory for long words too.
            for some in np.array_split(pick, 1 + len(pick) * int(length) // 4_000_000) if len(pick) else ():
                if step == 0:
                    out[some] = (a.rows(i[some], length) != b.rows(j[some], length)).sum(axis=1) == 1
                    continue
                short, long_ = (a.rows(i[some], length), b.rows(j[some], length + 1)) if step < 0 else (b.rows(j[some], length), a.rows(i[some], length + 1))
                ahead = np.logical_and.accumulate(short == long_[:, :-1], axis=1).sum(axis=1)
                behind = np.logical_and.accumulate((short == long_[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                out[some] = ahead + behind >= length
    return out


def _note(of: _Words, i: np.ndarray, by: _Words, j: np.ndarray) -> None:
    np.add.at(of.n_near, i, 1)
    for x, y in zip(i.tolist(), j.tolist()):
        now = (-int(by.n[y]), by.words[y])
        if of.best[x] is None or now < of.best[x]:
            of.best[x] = now


def compare(own: _Words, other: _Words, inside: bool, tile: int = 1024) -> None:
    """Note near pairs of a block's words and its partners'; `inside`: partners are of the block, so each pair comes twice."""
    for top in range(0, len(own.words), tile):
        left = slice(top, top + tile)
        for start in range(0, len(other.words), tile):
            right = slice(start, start + tile)
            apart = own.squares[left, None] + other.squares[None, right] - 2 * (own.counts[left] @ other.counts[right].T)
            i, j = np.nonzero(apart <= 2)
            i, j = i + top, j + start
            if inside:
                keep = own.words[i] < other.words[j]
                i, j = i[keep], j[keep]
            near = _one_edit(own, i, other, j)
            i, j = i[near], j[near]
            _note(own, i, other, j)
            _note(other, j, own, i)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (block, part, kind): a part's own words first, then their partners, of which one batch is held at a time."""
    held: tuple | None = None
    mine: list[tuple[np.ndarray, np.ndarray]] = []
    own: _Words | None = None
    out: list[pa.RecordBatch] = []

    def gathered(words: _Words | None, least: int = 10_000) -> Iterator[pa.RecordBatch]:
        if words is not None and words.n_near.any():
            out.append(words.sent())
        if sum(map(len, out)) >= least:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            out.clear()

    for batch in batches:
        block, part, kind, word, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        turns = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
        for a, z in zip([0, *turns], [*turns, len(block)]):
            if a == z:
                continue
            if (block[a], part[a]) != held:
                yield from gathered(own)
                held, mine, own = (block[a], part[a]), [], None
            if kind[a] == 0:
                mine.append((word[a:z], n[a:z]))
                continue
            if own is None:
                # Partners of a part that the hash left without words of its own have nobody to meet.
                if not mine:
                    continue
                own = _Words(*(np.concatenate(x) for x in zip(*mine)))
            other = _Words(word[a:z], n[a:z])
            compare(own, other, kind[a] == 1)
            yield from gathered(other)
    yield from gathered(own, 1)


def forms(words: DataFrame, near: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: a word's form is its near word of largest n if that is `times` the word's n or more.

    Forms grow by `times` at each step, so their chains are short; roots double the way they look at in each round.
    """
    known = words.join(near, "word", "left")
    good = F.col("near_n") >= F.col("n") * times
    rows = stored(
        known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")),
        "variant-forms",
    )
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return rows.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = 6, least: int = 5, times: int = 5, each: int = 199) -> DataFrame:
    """Words of all rows of at least `letters` letters and `least` occurrences with their form and root: word, form, root, n, n_near, form_n.

    NULL and empty texts hold no words; repeated rows count each time; an empty table gives no words. Other columns are ignored.
    """
    counted = word_counts(docs, key, text, each).where((F.length("word") >= letters) & (F.col("n") >= least))
    words = stored(counted, "variant-words")
    return forms(words, near_words(words), times)
