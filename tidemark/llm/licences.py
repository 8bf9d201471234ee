"""Licence recognition by sentence rules.

A text is cut into sentences, each sentence is normalised to lower-case letters and digits, and sentences that
are known from licences become identifiers. A licence is found where the text's sequence of identifiers holds
the sentences of one of its rules in their order. Texts are cut twice, with line ends as spaces (wrapped licence texts)
and as ends of sentences (notices on a line of their own); either sequence may match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_if_null

# Sentences of public licence texts and notices, by identifier.
SENTENCES: dict[int, str] = {
    1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    2: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    3: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    10: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    11: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    12: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution",
    13: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission",
    20: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies",
    21: "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS",
    30: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    31: "you may not use this file except in compliance with the License",
    32: "You may obtain a copy of the License at",
    33: "Licensed under the Apache License, Version 2.0",
    34: "This project is licensed under the Apache License, Version 2.0",
    40: "This program is free software",
    41: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    42: "either version 3 of the License, or (at your option) any later version",
    43: "either version 2 of the License, or (at your option) any later version",
    44: "This work is licensed under the GNU General Public License, version 3",
    45: "This work is licensed under the GNU General Public License, version 2",
    50: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    51: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    60: "This is free and unencumbered software released into the public domain",
    70: "Released under the MIT License",
    71: "This project is licensed under the MIT License",
    72: "Licensed under the MIT License",
    80: "Licensed under CC BY 4.0",
    81: "Licensed under CC BY-SA 4.0",
    82: "Licensed under CC BY-NC 4.0",
    83: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    84: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    85: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    86: "This work is licensed under CC0 1.0 Universal",
    **{
        90 + i: f"SPDX-License-Identifier: {name}"
        for i, name in enumerate((
            "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0-or-later", "GPL-3.0-or-later", "MPL-2.0", "Unlicense",
            "GPL-2.0-only", "GPL-3.0-only", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
        ))
    },
}

# Ordered rules: every sentence in its order; others may stand between.
RULES: dict[str, list[tuple[int, ...]]] = {
    "Apache-2.0": [(30, 31, 32), (33,), (34,), (91,)],
    "BSD-2-Clause": [(10, 11, 12), (92,)],
    "BSD-3-Clause": [(10, 11, 12, 13), (93,)],
    "CC-BY-4.0": [(80,), (83,), (102,)],
    "CC-BY-NC-4.0": [(82,), (85,), (104,)],
    "CC-BY-SA-4.0": [(81,), (84,), (103,)],
    "CC0-1.0": [(86,), (101,)],
    "GPL-2.0": [(45,), (99,)],
    "GPL-2.0-or-later": [(40, 41, 43), (95,)],
    "GPL-3.0": [(44,), (100,)],
    "GPL-3.0-or-later": [(40, 41, 42), (96,)],
    "ISC": [(20, 21), (94,)],
    "MIT": [(1, 2, 3), (70,), (71,), (72,), (90,)],
    "MPL-2.0": [(50, 51), (97,)],
    "Unlicense": [(60,), (98,)],
}
# A rule that says more takes the place of one it holds.
WITHIN = {"BSD-2-Clause": "BSD-3-Clause"}

# Marks that don't end a sentence, and places that do without one: (pattern, replacement), before cutting. Lines may be wrapped and begin with marks.
BEFORE = [
    ("SPDX-License-Identifier:", "SPDX-License-Identifier"), (r"\bv\.(\s)", r"v$1"), (r",(\s[^A-Za-z0-9]*)either[^A-Za-z0-9]+version", r".$1either version"),
    (r"\bat(\s[^A-Za-z0-9]*(?:https?://)?(?:www\.)?apache\.org)", r"at.$1"),
]
FLOWING = r"[.!?;:]+(\s|$)"
BY_LINE = r"[.!?;:]+(\s|$)|[\r\n]+"
LINES = r"[\r\n]+"
OTHER = r"[^a-z0-9]+"


def normal(sentence: str) -> str:
    return re.sub(OTHER, " ", sentence.lower()).strip()


def known() -> dict[str, int]:
    return {normal(s): i for i, s in SENTENCES.items()}


def identifiers(text: Column, end: str) -> Column:
    """Identifiers of the known sentences in order, as text like `,33,70,`."""
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    norm = F.transform(F.split(text, end), lambda s: F.trim(F.regexp_replace(F.lower(s), OTHER, " ")))
    hits = F.filter(norm, lambda s: s.isin(list(known())))
    return F.concat(F.lit(","), F.array_join(F.transform(hits, lambda s: F.element_at(table, s).cast("string")), ","), F.lit(","))


def rule_pattern(rule: tuple[int, ...]) -> str:
    return "," + ",(?:[0-9]+,)*".join(map(str, rule)) + ","


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, licences (names in order, separated by commas), sentences (known ones met) per row of `docs`.

    Texts without a known licence, NULL and empty ones have empty licences and 0 sentences. Whole texts are read;
    repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    body = blank_if_null(text)
    for pattern, put in BEFORE:
        body = F.regexp_replace(body, pattern, put)
    flowing, by_line = identifiers(F.regexp_replace(body, LINES, " "), FLOWING), identifiers(body, BY_LINE)
    found = docs.select(F.col(key).alias("id"), flowing.alias("a"), by_line.alias("b"))
    met = lambda name: F.col("a").rlike(_any(name)) | F.col("b").rlike(_any(name))
    names = [F.when(met(n) & ~(met(WITHIN[n]) if n in WITHIN else F.lit(False)), F.lit(n)) for n in sorted(RULES)]
    count = lambda c: F.greatest(F.length(F.regexp_replace(c, "[^,]", "")) - 1, F.lit(0))
    n = F.greatest(F.when(F.col("a") == ",,", 0).otherwise(count("a")), F.when(F.col("b") == ",,", 0).otherwise(count("b")))
    return found.select("id", F.array_join(F.array_compact(F.array(*names)), ",").alias("licences"), n.cast("int").alias("sentences"))


def _any(name: str) -> str:
    return "|".join(rule_pattern(r) for r in RULES[name])
