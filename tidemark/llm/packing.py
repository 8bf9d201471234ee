"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each task tokenises its documents as they stream by and collects pieces into groups of a bounded
token count; a group is packed on its own, so there is no shuffle and memory doesn't grow with the
table. A document longer than a window gives whole windows first; its rest joins the group.

Within a group the pieces are spread over m windows, m being the least count that could hold them.
Every piece starts as a partial partition of m sums, one of them filled. The two partitions with
the largest spread are merged with opposing imbalances - largest sums onto smallest - until one is left.
If a window then holds more than its capacity, the group is spread again over more windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import in_small_batches

_PIECES = "doc_id {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ENCODERS: dict[tuple[str, str], object] = {}


class Encoder:
    """Ids of texts as the tokenizer file gives them.

    `ranks` names the same vocabulary as ranks; its encoder gives the same ids several times faster and
    takes all texts but those that hold a special token's string, which the tokenizer file treats apart.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


# Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str, ranks: str | None) -> Encoder:
    """One encoder per worker process."""
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = Encoder(path, ranks)
    return _ENCODERS[path, ranks]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of `sizes` in `windows` near-equal parts.

    A partial partition keeps its sums as differences to the smallest one; sums of 0 are implied,
    so a piece of its own costs one entry rather than one per window.
    """
    heap: list[tuple[int, int, list[tuple[int, list]]]] = [(-n, i, [(n, [i])]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, i, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        # a is in falling order and b is turned round: the largest of one meets the smallest of the other.
        gap = windows - len(a) - len(b)
        if gap >= 0:
            merged = a + b
        else:
            meet = -gap
            low = a[len(a) - meet :]
            high = b[len(b) - meet :][::-1]
            merged = a[: len(a) - meet] + b[: len(b) - meet]
            merged += [(x + y, [u, v]) for (x, u), (y, v) in zip(low, high)]
        merged.sort(key=lambda s: -s[0])
        if len(merged) == windows:
            least = merged[-1][0]
            merged = [(x - least, u) for x, u in merged]
        heapq.heappush(heap, (-merged[0][0], i, merged))
    parts = [_flat(u) for _, u in heap[0][2]] if heap else []
    return parts + [[] for _ in range(windows - len(parts))]


def _flat(tree: list) -> list[int]:
    out, stack = [], [tree]
    while stack:
        for x in stack.pop():
            stack.append(x) if isinstance(x, list) else out.append(x)
    return sorted(out)


def spread(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most `capacity` each; one more window whenever a part is too large."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, windows)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return [p for p in parts if p]
        windows += 1


class _Group:
    """Pieces waiting to be packed and the sequences of one task."""

    def __init__(self, capacity: int, pieces: int, longest: int):
        self.capacity, self.most, self.longest = capacity, pieces, longest
        self.waiting: list[tuple] = []
        self.made = TaskContext.get().partitionId() << 36

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start, n = 0, len(ids)
        while n - start >= self.capacity:
            yield doc, start, ids[start : start + self.capacity], n, self._next(), 0
            start += self.capacity
        # The rest in near-equal small pieces, which even windows out.
        k = -(-(n - start) // self.longest)
        cuts = [start + (n - start) * i // k for i in range(k + 1)] if k else []
        self.waiting += [(doc, a, ids[a:b].copy(), n) for a, b in zip(cuts, cuts[1:])]
        if len(self.waiting) >= self.most:
            yield from self.pack()

    def pack(self) -> Iterator[tuple]:
        waiting, self.waiting = self.waiting, []
        if not waiting:
            return
        for part in spread([len(w[2]) for w in waiting], self.capacity):
            at, sequence = 0, self._next()
            for i in part:
                doc, start, ids, n = waiting[i]
                yield doc, start, ids, n, sequence, at
                at += len(ids)

    def _next(self) -> int:
        self.made += 1
        return self.made - 1


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, key: str = "doc_id", text: str = "text",
    capacity: int = 2048, end_id: int = 1, group: int = 600, longest: int = 512,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its text's ids, then `end_id`; NULL and empty text give `end_id` alone. Repeated rows and rows with
    NULL ids are packed one by one. Sequences are gapless from offset 0 and hold at most `capacity` ids. An empty table
    gives no pieces. Other columns are ignored. `group` bounds the pieces packed at once
    (and so a task's memory); `longest` bounds pieces that aren't whole windows.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, todo, out, held = encoder(tokenizer, ranks), _Group(capacity, group, longest), [], 0

        def batch() -> pa.RecordBatch:
            docs_, starts, ids, totals, sequences, offsets = zip(*out)
            columns = [pa.array(docs_, kind), pa.array(starts, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array((i.tobytes() for i in ids), pa.binary())]
            columns += [pa.array(x, pa.int64()) for x in (totals, sequences, offsets)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(body or ""), np.uint32(end_id)).astype("<u4")
                for piece in todo.add(doc, ids):
                    out.append(piece)
                    held += len(piece[2])
                if held > 1_000_000:
                    yield batch()
                    held = 0
        out += todo.pack()
        if out:
            yield batch()

    pair = docs.select(key, docs[text].cast("string").alias("__text"))
    return in_small_batches(pair).mapInArrow(run, _PIECES.format(key=pair.schema[0].dataType.simpleString()))
