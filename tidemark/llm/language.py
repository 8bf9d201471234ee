"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded labelled sample recognises every substring of it. A text
is parsed against a language into longest matches: a phrase grows while the sample holds it and the next one
starts where it stopped. Phrases grow with the logarithm of the sample that they are looked up in, so their number times
that logarithm is what is compared (the entropy estimate of a cross-parsing): samples may be of unlike size. A letter that
a sample lacks costs as much in every language: a phrase of the largest sample and one letter out of all known ones. The
language that needs the fewest phrases so normalised wins.

The automaton is completed into one table (state, letter) -> state with a mark where a phrase ends, so that all
texts of a batch advance together, one letter at a time, by one lookup each. To keep them in step, texts are
parsed in stretches of `STRETCH` letters: a phrase doesn't run over the end of a stretch, for any language alike.
Workers get the sample texts (at most `SAMPLE` letters a language) and build the tables once per process. A language's
table has a column for each letter of its own sample; a script of many letters is sampled in fewer of them (`CELLS`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import in_small_batches

SAMPLE = 24_000  # letters a language, and TOTAL over all of them
TOTAL = 400_000
ROWS = 400
CELLS = 1 << 24  # cells of a language's table, and 1 << 26 over all of them
STRETCH = 512
_MARK = 30  # bits of a table entry below the number of phrases that end with the step
_TABLES: dict[tuple, tuple] = {}


def letters(text: str) -> str:
    """Lower-case letters; every run of other characters is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text) -> list[dict]:
    """Transitions of the least automaton that accepts the substrings of `text`; state 0 is the empty one."""
    step: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step


def _tables(samples: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table, letter codes, each language's column of a code, first state of each language), kept per worker process."""
    if samples not in _TABLES:
        # Codes of letters that no sample has are 0, and so are the columns of letters that a language lacks.
        seen = sorted(set("".join(t for _, t in samples)))
        code = np.zeros(0x110000, dtype=np.uint32)
        code[[ord(c) for c in seen]] = np.arange(1, len(seen) + 1)
        column = np.zeros((len(samples), len(seen) + 1), dtype=np.uint32)
        parts, starts, base = [], [], 0
        for k, (_, text) in enumerate(samples):
            own = sorted(set(text))
            column[k, code[[ord(c) for c in own]]] = np.arange(1, len(own) + 1)
            n = len(own) + 1
            steps = suffix_automaton(column[k, code[[ord(c) for c in text]]].tolist())
            full = np.full((len(steps), n), -1, dtype=np.int64)
            for i, row in enumerate(steps):
                for c, to in row.items():
                    full[i, c] = to
            # No transition: the phrase ends and the letter starts the next one, from the empty state. A letter the
            # sample lacks is a phrase of its own.
            lacks = full[0] < 0
            ends = np.where(full >= 0, 0, 1 + lacks)
            ends[0] = lacks
            to = np.where(full >= 0, full, np.where(lacks, 0, full[0]))
            parts.append(((to * n + base) | (ends << _MARK)).astype(np.uint32).ravel())
            starts.append(base)
            base += full.size
        _TABLES.clear()
        _TABLES[samples] = np.concatenate(parts), code, column, np.array(starts, dtype=np.int64)
    return _TABLES[samples]


def phrases(texts: list[str], samples: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text (rows) against each language (columns), and how many of them are letters that its sample
    lacks; texts as `letters` gives them."""
    table, code, column, starts = _tables(samples)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    codes = code[np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")]
    lanes = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(texts)), lanes)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = at[owner] + nth * STRETCH
    size = np.minimum(lengths[owner] - nth * STRETCH, STRETCH)
    order = np.argsort(-size, kind="stable")
    begin, size, owner = begin[order], size[order], owner[order]
    active = np.searchsorted(-size, -np.arange(STRETCH), side="left") if len(size) else np.zeros(STRETCH, int)
    state = np.repeat(starts.astype(np.uint32)[:, None], len(owner), axis=1)
    ended = np.zeros(state.shape, dtype=np.int32)
    lacking = np.zeros(state.shape, dtype=np.int32)
    for t, n in enumerate(active):
        if not n:
            break
        place = column[:, codes[begin[:n] + t]]
        lacking[:, :n] += place == 0
        got = table[state[:, :n] + place]
        ended[:, :n] += (got >> np.uint32(_MARK)).astype(np.int32)
        state[:, :n] = got & np.uint32((1 << _MARK) - 1)
    # The phrase that the end of a stretch cuts off counts too, unless it is empty.
    ended += state != starts[:, None]
    summed = lambda x: np.array([np.bincount(owner, weights=row, minlength=len(texts)) for row in x]).reshape(len(starts), len(texts)).T
    return summed(ended), summed(lacking)


def normalised(count: np.ndarray, lacking: np.ndarray, samples: tuple[tuple[str, str], ...]) -> np.ndarray:
    """Phrases weighed by the logarithm of the sample they are looked up in; lacking letters cost the same everywhere."""
    weight = np.log(np.array([len(t) + 1 for _, t in samples], dtype=np.float64))
    known = len(set("".join(t for _, t in samples)))
    return (count - lacking) * weight + lacking * (weight.max() + np.log(known + 1))


def _fitting(text: str, cells: int) -> str:
    """The longest beginning of a sample whose table, of up to two states a letter, has at most `cells` cells."""
    low, high = 1, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if 2 * mid * (len(set(text[:mid])) + 1) <= cells else (low, mid - 1)
    return text[:low]


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """Sample letters per language, in order of language: rows where `learn` holds and the language is known.

    The rows are those with the least hashes among the known ones, some `ROWS` a language (a share that follows from the
    language's count, so no more than a few times that leave their tasks), texts of moderate length first. Whole texts
    are taken as long as they fit in `SAMPLE` letters, or the language's share of `TOTAL`; only a first text that is longer by
    itself is cut. Every language is learned, from however few letters.
    """
    known = docs.where(learn & F.col(lang).isNotNull() & (F.length(text) > 0)).select(key, lang, text)
    counts = known.groupBy(lang).count().orderBy(lang).collect()
    if not counts:
        return ()
    most = max(1, min(SAMPLE, TOTAL // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, 4 * ROWS / r[1]))])
    place = F.xxhash64(F.col(key).cast("string"), text)
    near = known.where(F.pmod(place, F.lit(1 << 20)) < F.try_element_at(share, lang) * (1 << 20))
    order = W.partitionBy(lang).orderBy(F.length(text) > SAMPLE // 4, place)
    size = F.length(F.regexp_replace(text, r"\P{L}+", " "))
    # Enough to fill a sample twice over leaves the tasks; texts behind that could only fill its last letters.
    before = F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1))
    numbered = near.withColumns({"__n": F.row_number().over(order), "__before": F.coalesce(before, F.lit(0))})
    rows = numbered.where((F.col("__n") <= ROWS) & (F.col("__before") < 2 * most)).select(lang, F.substring(text, 1, SAMPLE), "__n").collect()
    found = sorted(rows, key=lambda r: (r[0], r[2]))
    taken: dict[str, str] = {}
    for row in found:
        body = letters(row[1])
        if len(taken.get(row[0], "")) + len(body) < most:
            taken[row[0]] = (taken.get(row[0], "") + " " + body).strip()
        elif not taken.get(row[0]):
            taken[row[0]] = body[:most]
    cells = min(CELLS, (1 << 26) // len(counts))
    return tuple(sorted((k, _fitting(v, cells)) for k, v in taken.items() if v))


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with the predicted language and its score, in the columns `out` (columns of these names are replaced).

    `und` with score 0 where the text is NULL or has no letter, or nothing was learned. Else the score is the share
    of normalised phrases the winner saves against the runner-up (1 for the only language); ties go to the first language name.
    Whole texts count. An empty table gives an empty result.
    """
    names = [k for k, _ in samples]
    docs = docs.drop(*out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            texts = [letters(x) if x else "" for x in batch.column(place).to_pylist()]
            # Bounded memory: some millions of letters at a time, longer texts alone.
            langs, scores, some, held = [], [], [], 0

            def judge() -> None:
                count = normalised(*phrases(some, samples), samples) if names else np.zeros((len(some), 0))
                for body, row in zip(some, count):
                    if not body or not names:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    order = np.argsort(row, kind="stable")
                    langs.append(names[order[0]])
                    scores.append(float(1 - row[order[0]] / row[order[1]]) if len(names) > 1 else 1.0)

            for body in texts:
                some.append(body)
                held += len(body)
                if held > 1_000_000:
                    judge()
                    some, held = [], 0
            judge()
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *out])

    return in_small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(out[0], StringType()), StructField(out[1], DoubleType())]))


def held_out(key: str = "doc_id") -> Column:
    """A quarter of the ids, by a hash of the id alone."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
