"""Extraction, preference pairs, neighbours, quality, packing, licences and language against plain loops."""

import heapq
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import extract, language, licences, neighbours, packing, preference, quality
from tidemark.llm.queries import tokenizer_files

PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body class="home with-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this page better for you, and you can read more of that.</p></div>
<div id="content"><h1>A  title &amp; more</h1><p>First <b>bold</b>er paragraph,
with <a href="x">one link</a> and a long line of words that tells something.<p>Short.<br>Line.
<div class="ad">Buy this now, it is cheap and good, and it will not last for long.</div>
<ul><li>First item of the list, with words.</li><li>Second item of the list, with words.</li></ul>
<!-- <p>not shown</p> --><div style="display: none">Hidden words of the page.</div>
<p>Last words of the article &#8212; with a caf&eacute; and&nbsp;more of it.</p></div>
<aside><p>Other stories that you may like to read today, in many words.</p></aside>
<form><label>Name</label><input name="n"><button>Send this</button></form>
<section class="comments"><article class="comment"><p>I liked this article a lot, and have a long opinion on all of it.</p></article></section>
<footer>&copy; 2020 Site. All rights reserved.</footer></body></html>"""


def test_main_text():
    assert extract.main_text(PAGE).split("\n") == [
        "A title & more", "First bolder paragraph, with one link and a long line of words that tells something.", "Short. Line.",
        "First item of the list, with words.", "Second item of the list, with words.", "Last words of the article — with a café and more of it.",
    ]


@pytest.mark.parametrize("page", [None, "", "   ", "<p></p>", "<script>x", "<!-- x", "<nav><a href=x>Menu</a></nav>"])
def test_pages_without_text(page):
    assert extract.main_text(page) == ""


def test_broken_and_long_pages():
    assert extract.main_text("<article><p>Words that stand in an open paragraph, <b>all bold.") == "Words that stand in an open paragraph, all bold."
    assert extract.main_text("<article><p title='open>Words of it, not many.</p></article>") != ""
    many = "<article>" + "<p>Some words of a paragraph that is here.</p>" * 5000 + "</article>"
    assert extract.main_text(many).count("\n") == 4999
    assert extract.main_text("<div>" * 3000 + "<article><p>Deep words, but words of an article.</p></article>") != ""


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a \">", '<a ">"', "<a '\"", "<b>", "</b>", "<!x", "<span><p>", "<select>", '<div class="', '<a ">"<'])
@pytest.mark.parametrize("tail", ["", "'", ">"])
def test_broken_pages_take_linear_time(unit, tail):
    def seconds(n: int) -> float:
        page, start = unit * (n // len(unit)) + tail, time.process_time()
        extract.main_text(page)
        return time.process_time() - start

    seconds(1000)
    # Four times the page in far less than the sixteen times of a quadratic scan; at 400 KB that one took minutes.
    assert seconds(400_000) < 8 * seconds(100_000) + 2


def plain_tags(page):
    """Tags by trying each `<`: the quoted form first, the first `>` where that one ends nowhere."""
    quoted = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>")
    plain = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
    out, at = [], 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            out.append((at, len(page) if end < 0 else end + 3, False, "", ""))
        elif page[at + 1 : at + 2] in ("!", "?") and page.find(">", at) >= 0:
            out.append((at, page.find(">", at) + 1, False, "", ""))
        elif m := quoted.match(page, at) or plain.match(page, at):
            out.append((at, m.end(), bool(m[1]), m[2].lower(), m[3]))
        else:
            at += 1
            continue
        at = out[-1][1]
    return out


def test_tags_against_plain_search():
    rng = random.Random(7)
    for _ in range(20_000):
        page = "".join(rng.choice(["<", ">", '"', "'", "a", "/", "!", "-", "--", " ", "<!--", "-->", "<a", "?", "="]) for _ in range(rng.randrange(14)))
        tags, found, at = extract.Tags(page), [], 0
        while one := tags.after(at):
            found.append(one)
            at = one[1]
        assert found == plain_tags(page), page


ICONS = "<article><p>First words {} more.</p><p>Second paragraph, with words of its own.</p></article>"


@pytest.mark.parametrize(
    "icon",
    [
        "<svg/>", '<svg class="i"/>', "<svg-icon></svg-icon>", "<svg-icon>", "<title-bar>", "<select-menu>", "<object-view>", "<template-x>", "<style-guide/>",
        "<svg><path d='M0 0'/><g><path d='M1'></path></g></svg>", "<svg><title>Icon</title><style/></svg>", "<svg><title/><a><text>No</text></a></svg>",
        "<svg><foreignObject><p>No</p></foreignObject></svg>", "<object data=x>No", "<object data=x><p>No</p></object>", "<select><option>No</select>",
        "<SELECT><option>No</option></SELECT >", "<template><div><p>No</template>", "<noscript><img src=x><p>No</p></noscript>", "<script>'<svg>'</script>",
    ],
)
def test_icons_and_custom_elements_keep_the_text(icon):
    want = "First words No more." if icon == "<object data=x>No" else "First words more."
    # A custom element is a box of its own, so it may begin a line.
    assert extract.main_text(ICONS.format(icon)).split() == f"{want} Second paragraph, with words of its own.".split()


def test_elements_left_open():
    page = "<article><p>First words of it. {}<p>Second paragraph, with words of its own.</p><p>Third one, and more words.</article>"
    for left in ("<svg><path>", "<select><option>No", "<select><option>No<select><option>No", "<object data=x>"):
        assert extract.main_text(page.format(left)).split("\n") == ["First words of it.", "Second paragraph, with words of its own.", "Third one, and more words."]
    assert extract.main_text("<article><p>Words before it, and not few.</p><textarea>not text<p>not text") == "Words before it, and not few."


SENTENCE = "A sentence of an article that goes on for a while, with commas and with words that tell something of it all."
AROUND = '<nav><a href="/">Home</a></nav>{}<div class="sidebar"><p>Other stories that you may like to read today.</p></div><footer>About us.</footer>'


@pytest.mark.parametrize("names", ["single right-sidebar", "sidebar-left", "search-results", "page has_sidebar comments-open", "footer-widgets top"])
@pytest.mark.parametrize("inner", ["<article><p>{0}</p><p>{0}</p></article>", "<h1>Title</h1><p>{0}</p><p>{0}</p>"])
@pytest.mark.parametrize("outer", ['<html><body class="{}">{}</body></html>', '<html id="top" class="{}"><body>{}</body></html>', '<body><div id="{}">{}</div></body>',
                                   '<body id="top"><header><p>Just a page.</p></header><div class="social"><div class="{}">{}</div></div></body>'])
def test_names_of_the_whole_page(names, inner, outer):
    text = extract.main_text(outer.format(names, AROUND.format(inner.format(SENTENCE)))).split("\n")
    assert [line for line in text if line != "Title"] == [SENTENCE, SENTENCE]


def test_names_of_large_parts():
    part = '<div class="comments">' + f"<p>{SENTENCE}</p>" * 30 + "</div>"
    for own in (f"<article><p>{SENTENCE[::-1]}.</p></article>", f"<p>{SENTENCE[::-1]}.</p>" * 2):
        text = extract.main_text(f'<body class="sidebar-left">{own}{part}</body>')
        assert SENTENCE not in text and SENTENCE[::-1] in text
    deep = '<div class="sidebar">' * 20_000 + f"<p>{SENTENCE}</p>"
    assert extract.main_text(deep) == SENTENCE


def test_pages_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    out = extract.extract(pages)
    assert out.columns == ["page_id", "url", "text"]
    assert Counter(r.text for r in out.collect()) == {extract.main_text(PAGE): 2, "": 1}
    assert extract.extract(pages.limit(0)).count() == 0


def test_pages_without_marks_keep_their_sentences():
    said = [f"The council met on Monday {i} and spoke of the bridge." for i in range(3)]
    lines = "".join(f"<p>{x}</p><p><a href=x>Photo {i}</a></p>" for i, x in enumerate(said))
    for page in (f"<div>{lines}</div>", f'<nav><a href="/">Home</a></nav><div>{lines}</div><footer>About us.</footer>'):
        assert [x for x in extract.main_text(page).split("\n") if not x.startswith("Photo")] == said
    recipe = "<h1>Recipe</h1><ul><li>two eggs</li><li>some flour</li><li>salt</li></ul><p>Mix all and bake for an hour.</p>"
    want = ["Recipe", "two eggs", "some flour", "salt", "Mix all and bake for an hour."]
    assert extract.main_text(recipe).split("\n") == want
    assert extract.main_text('<nav><a href="/">Home</a><a href="/b">News</a></nav>' + recipe + "<footer>© 2020 Site</footer>").split("\n") == want
    assert extract.main_text("<p>Gone</p>") == "Gone"
    assert extract.main_text("<nav>Menu</nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><footer>© 2020</footer>") == ""


@pytest.mark.parametrize("name", ["kommentare", "leser-kommentare", "commentaires", "comentarios", "user-comments", "publicité", "Werbung"])
def test_parts_named_in_the_four_languages(name):
    page = f"<article><p>{SENTENCE}</p></article><div class='{name}'><p>{SENTENCE[::-1]}.</p></div>"
    assert extract.main_text(page) == SENTENCE


def test_a_link_line_of_an_article_stays():
    page = f"<article><p>{SENTENCE}</p><p><a href=x>The whole report</a></p><p>{SENTENCE}</p></article>"
    assert extract.main_text(page).split("\n") == [SENTENCE, "The whole report", SENTENCE]


def cut_cost(terminal, edges, side):
    return sum(-t if s and t < 0 else t if not s and t > 0 else 0 for t, s in zip(terminal, side)) + sum(c for (a, b), c in edges.items() if side[a] != side[b])


def test_minimum_cut_is_least():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 9)
        terminal = [rng.randrange(-9, 10) for _ in range(n)]
        edges = {(a, b): rng.randrange(0, 8) for a in range(n) for b in range(a) if rng.random() < 0.6}
        best = min(cut_cost(terminal, edges, [m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cut_cost(terminal, edges, extract.minimum_cut(terminal, edges)) == best


def preference_loop(rows):
    talks = defaultdict(set)
    for c, t, r, x in rows:
        if c is not None:
            talks[c].add((2**62 if t is None else t, r or "", x or ""))
    talks = {c: sorted(v) for c, v in talks.items()}
    order = sorted(talks, key=lambda c: (talks[c][0][2], talks[c][0][1], c))
    out = []
    for k in range(0, len(order), 2):
        two = order[k : k + 2]
        said = [sum(len(x) for _, r, x in talks[c] if r == "assistant") for c in two]
        chosen, rejected = (two[0], None) if len(two) < 2 else two if said[0] >= said[1] else two[::-1]
        a, b = talks[chosen], talks.get(rejected, [])
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        for side, turns, train in (("prompt", a[:n], False), ("chosen", a[n:], True), ("rejected", b[n:], True)):
            out += [(k // 2, chosen, rejected, side, r, f"<|{r}|>\n{x}\n", train and r == "assistant") for _, r, x in turns]
    return Counter(out)


def test_preference_pairs(spark):
    rng = random.Random(4)
    rows = []
    for c in range(61):
        first = rng.choice(["hello", "hello", f"question {c}"])
        same = rng.choice(["yes", "no"])
        rows += [(c, 0, "user", first), (c, 1, "assistant", same)] + [(c, t, ("user", "assistant")[t % 2], rng.choice(["a", "b", "ccc"])) for t in range(2, rng.randrange(2, 7))]
    rows += [rows[0], (70, None, None, None), (70, 0, "user", "hello"), (None, 0, "user", "nobody"), (71, 0, "user", "hello"), (71, 0, "assistant", "twice")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, side string")
    turns = preference.turns(frame)
    got = preference.formatted(turns, preference.paired(turns)).collect()
    assert Counter((r.pair_id, r.chosen_id, r.rejected_id, r.side, r.role, r.segment, r.loss) for r in got) == preference_loop(rows)
    empty = preference.turns(frame.limit(0))
    assert preference.formatted(empty, preference.paired(empty)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(700)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(60)]
    vectors += [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None] * 8), (2003, [float("nan")] * 16), (2004, [float("inf")] * 16), (2020, [1.0, 2.0]), (2021, [2.0, 1.0])]
    # Repeated in full, without id, far away, and three rows of a query's id: another vector, and the first one twice.
    vectors += [vectors[5], (None, vectors[6][1]), (2040, [1e6] * 16), (40, vectors[9][1]), vectors[40]]
    frame = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, q int")
    got = defaultdict(list)
    for r in neighbours.search(frame, F.col("vec_id") % 20 == 0, k=20, vector_block=100, query_block=16, fan_in=3).collect():
        got[r.query_id].append((r.rank, r.vec_id, round(r.score, 6)))
    good = [(i, np.array(v)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = defaultdict(list)
    for n, (q, x) in enumerate(good):
        if q % 20 == 0:
            others = [(-float(x @ v), i) for m, (i, v) in enumerate(good) if m != n and len(v) == len(x)]
            near = heapq.nsmallest(20, others, key=lambda o: (round(o[0], 9), o[1]))
            want[q] += [(k + 1, i, round(-s, 6)) for k, (s, i) in enumerate(near)]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items() if x}
    assert len(got[40]) == 60
    assert neighbours.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = [" ".join(rng.choice(["alpha", "beta", "naïve", "東京", "x1", "\n"]) for _ in range(rng.choice([0, 1, 20, 300, 5000]))) for _ in range(120)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(500, None, 0), (501, "", 0), (502, "a <|endoftext|> b", 0), (503, "aaa" * 5000, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    slow = Tokenizer.from_file(tokenizer_files()["tokenizer"])
    want = {i: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t, _ in rows}
    pieces = packing.pack(frame, **tokenizer_files()).withColumn("crc", F.crc32("ids")).collect()
    parts, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0 and p.doc_tokens == len(want[p.doc_id]) and p.crc == zlib.crc32(bytes(p.ids))
        parts[p.doc_id].append((p.start, bytes(p.ids)))
        windows[p.sequence_id].append((p.offset, p.length))
    assert {i: b"".join(b for _, b in sorted(v)) for i, v in parts.items()} == {i: v.tobytes() for i, v in want.items()}
    for v in windows.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(map(len, want.values())) > 0.9 * 2048 * len(windows)
    assert packing.pack(frame.limit(0), **tokenizer_files()).count() == 0


def test_packing_repeats_and_null_ids(spark):
    frame = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text")], "doc_id long, text string")
    pieces = packing.pack(frame.coalesce(1), **tokenizer_files()).collect()
    assert Counter(p.doc_id for p in pieces) == {1: 2, None: 1} and len({p.sequence_id for p in pieces}) == 1


def test_differencing_is_even():
    rng = random.Random(8)
    for n, m in ((1, 1), (3, 5), (12, 3), (400, 70)):
        sizes = [rng.randrange(1, 512) for _ in range(n)]
        parts = packing.differencing(sizes, m)
        assert len(parts) == m and sorted(i for p in parts for i in p) == list(range(n))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) < 0.15 * sum(sums) / m
    assert all(sum(sizes[i] for i in p) <= 600 for p in packing.spread(sizes, 600))


LICENCES = [
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Text before.\nReleased under the MIT License.\nText after.", "MIT"),
    ("no mark before\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("// SPDX-License-Identifier: ISC\n", "ISC"), ("released under the mit license! Licensed under CC BY 4.0.", "CC-BY-4.0,MIT"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, "
     "You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy "
     "of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0", "Apache-2.0"),
    ("We were licensed under the Apache License before.", ""), (None, ""), ("", ""), ("x" * 200_000, ""),
]


def test_licences(spark):
    bsd = [licences.SENTENCES[i] + "." for i in (10, 11, 12)]
    cases = [*LICENCES, ("\n".join(bsd), "BSD-2-Clause"), ("\n".join([*bsd, licences.SENTENCES[13] + "."]), "BSD-3-Clause"), ("\n".join(bsd[::-1]), "")]
    mit = " ".join(licences.SENTENCES[i] + e for i, e in ((1, ":"), (2, "."), (3, ".")))
    cases += [(mit.replace(" any person", "\nany person"), "MIT"), ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public "
              "License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "GPL-3.0-or-later")]
    frame = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(cases)], "doc_id long, text string, licences string")
    got = {r.id: r.licences for r in licences.scan(frame).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert licences.scan(frame.limit(0)).count() == 0


# What stands behind a sentence in its licence's header or text, where it isn't a full stop.
BEHIND = {1: ":", 10: ":", 30: ";", 32: " http://www.apache.org/licenses/LICENSE-2.0", 40: ":", 41: ","}


def test_every_rule_in_every_form(spark):
    cases = []
    for name, rules in licences.RULES.items():
        for rule in rules:
            line = " ".join(licences.SENTENCES[i] + BEHIND.get(i, ".") for i in rule)
            if "SPDX" in line:
                line = line.rstrip(".")
            cases += [(line, name), (f"{line}\n", name), (f"/* {line} */", name)]
            for width in (37, 50, 72):
                for mark in ("", "# ", " * ", "// "):
                    cases.append((textwrap.fill(line, width, initial_indent=mark, subsequent_indent=mark, break_long_words=False, break_on_hyphens=False), name))
    cases += [(x.replace(" http://", "\n#\n#    http://").replace("http:", "https:"), n) for x, n in cases if " http://www.apache" in x]
    assert {x for _, x in cases} == set(licences.RULES)
    tags = {x.removesuffix("-only") for x in licences.SENTENCES.values() if x.startswith("SPDX")}
    assert tags == {f"SPDX-License-Identifier: {name}" for name in licences.RULES}
    frame = spark.createDataFrame(list(enumerate(x for x, _ in cases)), "doc_id long, text string")
    got = {r.id: r.licences for r in licences.scan(frame).collect()}
    assert [(x, got[i], want) for i, (x, want) in enumerate(cases) if got[i] != want] == []


def phrases_loop(text, sample):
    n = 0
    for at in range(0, len(text), language.STRETCH):
        part, i = text[at : at + language.STRETCH], 0
        while i < len(part):
            k = 1
            while i + k < len(part) and part[i : i + k + 1] in sample:
                k += 1
            i, n = i + k, n + 1
    return n


def test_cross_parsing_counts_phrases():
    rng = random.Random(9)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = (("one", make("abc ", 300)), ("two", make("abcdé", 200)))
    texts = [make("abcdéz ", n) for n in (0, 1, 5, 511, 512, 513, 1500)]
    got, lacking = language.phrases(texts, samples)
    assert got.tolist() == [[phrases_loop(t, s) for _, s in samples] for t in texts]
    assert lacking.tolist() == [[sum(c not in s for c in t) for _, s in samples] for t in texts]


def test_suffix_automaton_accepts_substrings_only():
    text = "abcbcabab"
    step = language.suffix_automaton(text)

    def accepts(s):
        at = 0
        for c in s:
            at = step[at].get(c)
            if at is None:
                return False
        return True

    subs = {text[i:j] for i in range(10) for j in range(i, 10)}
    assert all(accepts(s) for s in subs) and not any(accepts(s) for s in ("aa", "abcc", "bb", "d"))


def test_language(spark):
    rng = random.Random(10)
    words = {"en": "the of and that with have this from".split(), "de": "der die und nicht mit sich auch über".split(), "ja": "日本 東京 言葉 文章".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(8, 60))), lang, 1.0) for i, lang in enumerate(sorted(words) * 60)]
    rows += [(900, None, "en", 1.0), (901, "", "de", 1.0), (902, "123 *** !", None, 1.0), (903, "the of and that " * 20_000, None, 1.0), (None, "und nicht mit sich auch", "de", 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    samples = language.fit(frame, ~language.held_out())
    assert [k for k, _ in samples] == ["de", "en", "ja"] and all(len(v) <= language.SAMPLE for _, v in samples)
    got = language.predict(frame, samples).collect()
    assert len(got) == len(rows)
    for r in got:
        want = {900: "und", 901: "und", 902: "und", 903: "en"}.get(r.doc_id, r.lang)
        assert r.lang_pred == want and 0 <= r.score <= 1
    assert language.predict(frame.limit(0), samples).count() == 0
    assert language.fit(frame.limit(0), F.lit(True)) == ()
    assert {(r.lang_pred, r.score) for r in language.predict(frame, ()).collect()} == {("und", 0.0)}


def test_samples_of_unlike_size(spark):
    """With English cut to 600 letters, held-out English texts stay right; by raw counts of phrases a part of them is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = tuple((k, v[:600] if k == "en" else v) for k, v in language.fit(docs, ~language.held_out()))
    held = docs.where(language.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").collect()
    texts = [(language.letters(r.text), r.lang) for r in held]
    texts = [x for x in texts if x[0]]
    count, lacking = language.phrases([t for t, _ in texts], samples)
    english = np.array([lang == "en" for _, lang in texts])
    right = lambda c: np.array([samples[i][0] == lang for i, (_, lang) in zip(c.argmin(axis=1), texts)])
    raw, normalised = right(count), right(language.normalised(count, lacking, samples))
    assert normalised.mean() > 0.98 and normalised[english].mean() > max(0.95, raw[english].mean())


def test_many_letters_and_many_languages(spark):
    rng = random.Random(13)
    # Three scripts of 1,500 letters each that share none, and a table for each that stays within its cells.
    script = lambda k: [chr(0x4E00 + 1500 * k + i) for i in range(1500)]
    rows = [(i, "".join(rng.choice(script(i % 3)) for _ in range(400)), f"han{i % 3}") for i in range(120)]
    # Far more languages than the former bound of 200, each with two words of its own.
    rows += [(1000 + i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26 % 26) * 2}{chr(97 + i // 26) * 4} " * 5, f"x{i:03d}") for i in range(300) for _ in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.fit(frame, F.lit(True))
    assert len(samples) == 303
    table, _, column, _ = language._tables(samples)
    assert table.size <= 1 << 26 and column.shape[0] == 303
    han = [r for r in rows if r[2].startswith("han")]
    got = {r.doc_id: r.lang_pred for r in language.predict(frame, samples).collect()}
    assert all(got[i] == lang for i, _, lang in han)
    assert sum(got[i] == lang for i, _, lang in rows) > 0.98 * len(rows)


def quality_rows(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(500):
        good = i % 3 > 0
        words = ["word%d" % rng.randrange(200) + ("" if good else "###") for _ in range(rng.randrange(20, 80))]
        rows.append((i, " ".join(words) + ".", "src%d" % (i % 4), "en", 100 + (300 if good else 0), 7))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(600, None, None, None, None, 7), (601, "", "src1", "en", 0, 7), (1, rows[1][1], "src1", "en", 400, 7), (None, "some words here.", "src1", "en", 16, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, c long")
    return docs, spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = quality_rows(spark)
    got = quality.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    judged = [(r.keep, r.id % 3 > 0) for r in got if r.id is not None and r.id < 500]
    assert sum(a == b for a, b in judged) > 0.97 * len(judged)


def test_quality_without_classes(spark):
    docs, labels = quality_rows(spark)
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.score(docs.limit(0), labels).count() == 0
