"""Licences by sentence rules, on DataFrame functions only: known sentences get identifiers, ordered rules match them.

A text is cut into sentences where licences are: at lines without a letter or digit and
after a stop behind a word. Other line feeds only wrap, and what stands before a line
as a comment mark goes with all other marks when a sentence is normalised to lower-case
words. A known sentence counts where its words stand side by side in a sentence, alone
or within a longer one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Known sentences by identifier: fixed wording of public licences and their usual notices.
SENTENCES: dict[int, str] = {
    1: "released under the MIT License",
    2: "licensed under the MIT License",
    3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    4: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    5: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    10: "licensed under the Apache License, Version 2.0",
    11: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    12: "you may not use this file except in compliance with the License",
    13: "You may obtain a copy of the License at",
    14: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    15: "Apache License Version 2.0, January 2004",
    20: "licensed under the GNU General Public License version 3",
    21: "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    22: "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    23: "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    24: "See the GNU General Public License for more details",
    25: "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    26: "licensed under the GNU General Public License version 2",
    27: "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    28: "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    29: "See the GNU Lesser General Public License for more details",
    35: "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    36: "See the GNU Affero General Public License for more details",
    30: "licensed under CC BY-NC 4.0",
    31: "licensed under CC BY 4.0",
    32: "licensed under CC BY-SA 4.0",
    33: "licensed under a Creative Commons Attribution 4.0 International License",
    34: "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    37: "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    38: "licensed under the Creative Commons Attribution 4.0 International License",
    39: "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    40: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    41: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    42: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    43: "may be used to endorse or promote products derived from this software without specific prior written permission",
    44: "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    50: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    51: "If a copy of the MPL was not distributed with this file, You can obtain one at",
    52: "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0",
    60: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    61: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    62: "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    63: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    70: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    71: "This is free and unencumbered software released into the public domain",
    72: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    73: "This software is provided 'as-is', without any express or implied warranty",
    74: "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    75: "This notice may not be removed or altered from any source distribution",
    76: "Distributed under the Boost Software License, Version 1.0",
    77: "has waived all copyright and related or neighboring rights",
    78: "licensed under CC0 1.0",
    80: "SPDX-License-Identifier: MIT",
    81: "SPDX-License-Identifier: Apache-2.0",
    82: "SPDX-License-Identifier: BSD-3-Clause",
    83: "SPDX-License-Identifier: BSD-2-Clause",
    84: "SPDX-License-Identifier: GPL-2.0",
    85: "SPDX-License-Identifier: GPL-3.0",
    86: "SPDX-License-Identifier: MPL-2.0",
    87: "SPDX-License-Identifier: ISC",
}
#: Rule, licence, and the sentences that must come in this order, others between them allowed.
RULES: tuple[tuple[str, str, tuple[int, ...]], ...] = (
    ("mit_text", "MIT", (3, 4, 5)),
    ("mit_notice", "MIT", (1,)),
    ("mit_licensed", "MIT", (2,)),
    ("mit_spdx", "MIT", (80,)),
    ("apache_header", "Apache-2.0", (11, 12, 13, 14)),
    ("apache_notice", "Apache-2.0", (10,)),
    ("apache_text", "Apache-2.0", (15,)),
    ("apache_spdx", "Apache-2.0", (81,)),
    ("gpl3_header", "GPL-3.0-or-later", (21, 23, 24)),
    ("gpl3_notice", "GPL-3.0", (20,)),
    ("gpl3_spdx", "GPL-3.0", (85,)),
    ("gpl2_header", "GPL-2.0-or-later", (22, 23, 24)),
    ("gpl2_only_header", "GPL-2.0", (25, 23, 24)),
    ("gpl2_notice", "GPL-2.0", (26,)),
    ("gpl2_spdx", "GPL-2.0", (84,)),
    ("lgpl21_header", "LGPL-2.1-or-later", (27, 23, 29)),
    ("lgpl3_header", "LGPL-3.0-or-later", (28, 23, 29)),
    ("agpl3_header", "AGPL-3.0-or-later", (35, 23, 36)),
    ("cc_by_nc_notice", "CC-BY-NC-4.0", (30,)),
    ("cc_by_nc_work", "CC-BY-NC-4.0", (34,)),
    ("cc_by_notice", "CC-BY-4.0", (31,)),
    ("cc_by_work", "CC-BY-4.0", (33,)),
    ("cc_by_licensed", "CC-BY-4.0", (38,)),
    ("cc_by_sa_notice", "CC-BY-SA-4.0", (32,)),
    ("cc_by_sa_work", "CC-BY-SA-4.0", (37,)),
    ("cc_by_sa_licensed", "CC-BY-SA-4.0", (39,)),
    ("bsd4_text", "BSD-4-Clause", (40, 41, 42, 44, 43)),
    ("bsd3_text", "BSD-3-Clause", (40, 41, 42, 43)),
    ("bsd2_text", "BSD-2-Clause", (40, 41, 42)),
    ("bsd3_spdx", "BSD-3-Clause", (82,)),
    ("bsd2_spdx", "BSD-2-Clause", (83,)),
    ("mpl_no_secondary", "MPL-2.0-no-copyleft-exception", (50, 51, 52)),
    ("mpl_header", "MPL-2.0", (50, 51)),
    ("mpl_notice", "MPL-2.0", (50,)),
    ("mpl_spdx", "MPL-2.0", (86,)),
    ("isc_text", "ISC", (60, 62)),
    ("isc_older_text", "ISC", (61, 62)),
    ("isc_spdx", "ISC", (87,)),
    ("bsd0_text", "0BSD", (63, 62)),
    ("epl_header", "EPL-2.0", (70,)),
    ("unlicense_text", "Unlicense", (71, 72)),
    ("zlib_text", "Zlib", (73, 74, 75)),
    ("boost_notice", "BSL-1.0", (76,)),
    ("cc0_waiver", "CC0-1.0", (77,)),
    ("cc0_notice", "CC0-1.0", (78,)),
)
#: Every known sentence holds one of these parts of a word, which no line break or comment mark divides; texts and sentences without any are passed over.
HINT = "licens|permi|redistribut|warrant|domain|distribut|copyright|misrepresented|anyone|advertising|derived|mpl"
_BREAK = r"\n(?:[^a-z0-9\n]*\n)+"
_PREFIX = r"(?m)^[^a-z0-9\n]*(?:dnl|rem)[ \t]+"
_STOP = r"""([a-z0-9)"'][a-z0-9)"'][.!?:])[ \t\r\n]+"""
_CUT = "\x01"


def normalised(sentence: str) -> str:
    """Lower-case words with one space between."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _pattern(ids: tuple[int, ...]) -> str:
    """Matches a list like ,3,7, that holds the ids in order."""
    return "(.*,)?".join(f"{',' if i == 0 else ''}{x}," for i, x in enumerate(ids))


def _within(part: tuple[int, ...], whole: tuple[int, ...]) -> bool:
    rest = iter(whole)
    return all(x in rest for x in part)


def _covered_by(rules: tuple[tuple[str, str, tuple[int, ...]], ...]) -> dict[str, list[str]]:
    """For each rule the names of those whose sequence holds its own and more."""
    return {name: [other for other, _, longer in rules if other != name and len(longer) > len(seq) and _within(seq, longer)] for name, _, seq in rules}


def sentences(text: Column) -> Column:
    """Normalised sentences of a text."""
    t = F.regexp_replace(ascii_lower(text), _PREFIX, "")
    t = F.regexp_replace(F.regexp_replace(t, _BREAK, _CUT), _STOP, f"$1{_CUT}")
    return F.transform(F.split(t, _CUT), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def scan_licenses(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known: dict[int, str] = SENTENCES, rules: tuple[tuple[str, str, tuple[int, ...]], ...] = RULES, hint: str = HINT) -> DataFrame:
    """One row for each row of `documents` and rule that it matches: doc_id, rule, license, sentence_ids, n_sentences.

    sentence_ids lists the known sentences of the whole text in order, comma-joined, and
    n_sentences counts them; of known sentences that begin at one word the longest
    counts, and one that comes again in the same sentence counts once. A rule matches if
    its sentences come in its order, with any others between; it isn't reported where a
    rule that holds all its sentences and more matches too. Texts without a match, null
    and empty ones give no row; repeated rows give a row each; other columns are
    ignored. `hint` is a pattern that every known sentence holds
    within a word. Nothing is shuffled.
    """
    words = {i: f" {normalised(s)} " for i, s in known.items()}
    df = documents.where(F.col(text_col).rlike(f"(?i){hint}")).select(F.col(id_col).alias("doc_id"), sentences(F.col(text_col)).alias("s"))
    df = df.select("doc_id", F.transform(F.filter("s", lambda x: x.rlike(hint)), lambda x: F.concat(F.lit(" "), x, F.lit(" "))).alias("s"))

    def found(s: Column) -> Column:
        at = [(i, F.locate(w, s), len(w)) for i, w in words.items()]
        return F.array_sort(F.array_compact(F.array(*(F.when(p > 0, F.struct(p.alias("at"), F.lit(-n).alias("less"), F.lit(i).alias("id"))) for i, p, n in at))))

    df = df.select("doc_id", F.transform("s", found).alias("f"))
    longest = F.transform("f", lambda a: F.filter(a, lambda x, i: (i == 0) | (x["at"] != F.get(a, i - 1)["at"])))
    ids = F.flatten(F.transform(longest, lambda a: F.transform(a, lambda x: x["id"])))
    df = df.select("doc_id", ids.alias("ids")).where(F.size("ids") > 0)
    df = df.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("sentence_ids"), F.size("ids").cast("long").alias("n_sentences"))
    listed = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    pattern = {name: _pattern(seq) for name, _, seq in rules}
    over = _covered_by(rules)

    def hit(name: str) -> Column:
        own = listed.rlike(pattern[name])
        for other in over[name]:
            own = own & ~listed.rlike(pattern[other])
        return own

    hits = F.array_compact(F.array(*(F.when(hit(name), F.struct(F.lit(name).alias("rule"), F.lit(lic).alias("license"))) for name, lic, _ in rules)))
    return df.select("doc_id", "sentence_ids", "n_sentences", F.explode(hits).alias("m")).select("doc_id", "m.rule", "m.license", "sentence_ids", "n_sentences")


def _sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    known = ", ".join(f"({i}, ' {normalised(s)} ')" for i, s in SENTENCES.items())
    rules = ", ".join(f"('{name}', '{lic}', '{_pattern(seq)}')" for name, lic, seq in RULES)
    over = ", ".join(f"('{name}', '{other}')" for name, others in _covered_by(RULES).items() for other in others)
    stop = _STOP.replace("'", "''")
    return f"""
WITH known(id, s) AS (VALUES {known}), rules(rule, license, p) AS (VALUES {rules}), over(rule, other) AS (VALUES {over}),
cut AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(translate(text, '{upper}', '{upper.lower()}'), '{_PREFIX}', '', 'g'), '{_BREAK}', chr(1), 'g'), '{stop}', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
each AS (SELECT r, doc_id, ' ' || trim(regexp_replace(unnest(parts), '[^a-z0-9]+', ' ', 'g')) || ' ' AS part, generate_subscripts(parts, 1) AS pos FROM cut),
placed AS (SELECT r, doc_id, pos, id, instr(part, s) AS place, length(s) AS n FROM each JOIN known ON contains(part, s)),
longest AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY r, pos, place ORDER BY n DESC, id) = 1),
hits AS (SELECT r, doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos, place) AS sentence_ids, count(*) AS n_sentences FROM longest GROUP BY r, doc_id),
matched AS (SELECT r, doc_id, rule, license, sentence_ids, n_sentences FROM hits JOIN rules ON regexp_matches(',' || sentence_ids || ',', p))
SELECT doc_id, rule, license, sentence_ids, n_sentences FROM matched m
WHERE NOT EXISTS (SELECT 1 FROM over JOIN matched o ON o.rule = over.other WHERE over.rule = m.rule AND o.r = m.r)
"""


SQL = _sql()
