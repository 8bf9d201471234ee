"""Stages of the corpus pipeline, one by one on rare rows, and a whole run against plain loops."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_dedup_mixing import near_loop, water_loop

import corpus_pipeline
from tidemark.llm.queries import tokenizer_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_stage_without_labels(spark):
    """With nothing to learn from, only documents without a letter go."""
    rows = [(1, "some words", None), (2, None, None), (3, "", None), (4, "12 *** !", None), (5, "1 é", None), (6, "東京", None), (None, "no id", None)]
    frame = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)
    out = corpus_pipeline.known_language(spark, frame, "")
    assert out.columns == frame.columns
    assert {r.doc_id for r in out.collect()} == {1, 5, 6, None}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path, name, stage):
    """No rows give no rows; columns that operators use themselves come through."""
    more = ", id string, kept string, size string, h string, class_id string, __size string"
    rows = [(1, "some words of a text", "en", "s", 20), (2, None, None, None, None), (2, None, None, None, None), (None, "other words", "en", "s", 11)]
    for part in ([], rows):
        path = str(tmp_path / f"{name}{len(part)}")
        spark.createDataFrame([(*r, *"abcdef") for r in part], DOCS + more).write.parquet(path)
        docs = spark.read.parquet(path)
        out = stage(spark, docs, "")
        got = out.collect()
        assert bool(got) == bool(part)
        if name != "packing":
            assert out.columns == docs.columns and {r.class_id for r in got} <= {"e"}


def made(seed=4):
    """Documents of two languages and four sources: plain ones, exact and near copies, rows without letters, nulls, a long one."""
    rng = random.Random(seed)
    words = {"en": [f"{a}{b}th" for a in "pqrst" for b in ("ea", "ou", "ing", "ow")] * 3, "xx": [f"{a}{b}lj" for a in "bdgkm" for b in ("ič", "už", "oš", "eđ")] * 3}
    fresh = lambda lang, n: [rng.choice(words[lang]) + rng.choice("aeiou") + str(rng.randrange(400)) for _ in range(n)]
    rows = []
    for k in range(160):
        lang = "en" if k % 3 else "xx"
        text = fresh(lang, rng.choice([30, 60, 90]))
        rows.append((" ".join(text), lang))
        if k % 8 == 0:
            for _ in range(3):
                near = list(text)
                near[rng.randrange(len(near))] += "x"
                rows.append((" ".join(near), lang))
        if k % 10 == 0:
            rows += [("  \n".join(text), lang), (" ".join(text), lang)]
    rows += [(None, "en"), ("", None), ("12 34 *** 5", "en"), (" ".join(fresh("en", 6000)), "en"), ("x" * 20_000, None)]
    rng.shuffle(rows)
    return [(i * 3, t, lang, rng.choice(["a", "b", "b", "c", None]), len(t or "")) for i, (t, lang) in enumerate(rows)]


def test_run_against_loops(spark, tmp_path, monkeypatch):
    seen = {}

    def kept(df, name, write=corpus_pipeline.stored):
        out = write(df, name)
        seen[name.removeprefix("pipeline-")] = [tuple(r) for r in out.collect()]
        return out

    monkeypatch.setattr(corpus_pipeline, "stored", kept)
    rows = made()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert list(seen) == [n for n, _ in corpus_pipeline.STAGES[:-1]]

    lettered = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    assert Counter(seen["language"]) == Counter(lettered)

    best = {}
    for r in lettered:
        bare = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        best[bare] = min(best.get(bare, r), r, key=lambda x: (-len(x[1]), x[0]))
    assert Counter(seen["exact_dedup"]) == Counter(best.values())

    left = sorted(best.values())
    classes = defaultdict(list)
    for r, head in zip(left, near_loop([(r[0], r[1], r[3]) for r in left])):
        classes[head].append(r)
    assert len(classes) < len(left)
    survivors = set(seen["near_dedup"])
    assert len(seen["near_dedup"]) == len(classes) and all(len(survivors & set(c)) == 1 for c in classes.values())

    size = lambda r: len(r[1].split())
    sizes, taken, times = Counter(), Counter(), Counter(seen["mixing"])
    for r in survivors:
        sizes[r[3]] += size(r)
        taken[r[3]] += size(r) * times[r]
    order = sorted(s for s in sizes if s is not None) + [None]
    want = water_loop(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, 3)
    assert set(times) <= survivors and max(times.values()) <= 3
    for s in sizes:
        # Whole documents only: what is left of a target is less than the shortest document that could still be taken.
        spare = [size(r) for r in survivors if r[3] == s and times[r] == min(times[x] for x in survivors if x[3] == s)]
        assert 0 <= want[s] - taken[s] < max(1, min(spare) + 1) or min(times[r] for r in survivors if r[3] == s) == 3

    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_files()["tokenizer"])
    encode.encode_special_tokens = True
    text = {r[0]: r[1] for r in survivors}
    ids = {d: np.array([*encode.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in text.items()}
    copies = {r[0]: n for r, n in times.items()}
    covered = defaultdict(Counter)
    sequences = defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and bytes(p.ids) == ids[p.doc_id][p.start : p.start + p.length].tobytes()
        covered[p.doc_id].update(range(p.start, p.start + p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert {d: set(c.values()) for d, c in covered.items()} == {d: {n} for d, n in copies.items()}
    assert all(len(c) == len(ids[d]) for d, c in covered.items())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
