"""Licence recognition by sentences: known sentences become identifiers, ordered rules match identifier sequences.

DataFrame functions only.  A text without any of CLUES holds no known sentence and is passed over at once.  Others are
cut at line ends and after '.', '!' or '?' with white space; a sentence with a clue is normalised (lower case, runs of
other characters than a-z and 0-9 as one space) and looked up.  In the text's sequence of identifiers each rule, in
turn, replaces its sequence wherever it stands by the licence's name, so longer rules come first.

A known sentence may be wrapped: within a paragraph its words may stand on several lines, each behind comment signs, and
a URL may follow a blank line.  Lines that make up no known sentence stay apart.  SPDX tags name their licences, each
part of an expression by itself.  The SQL twin reads single lines and knows no SPDX tags; both give the same rows
where a table has neither wrapped notices nor tags.

Defined cases: a null or empty text, or one without clues, has no sentences and no licence; sentences with a clue that
nothing knows are Unknown; repeated statements count each time; repeated rows and ties are rows like any other; an
empty table gives none; other columns are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of which every known sentence holds one.
CLUES = ("license", "licence", "copyright", "rights reserved", "spdx", "public domain", "permission", "warrant", "redistribut", "liab", "free software", "endorse")

#: Sentences of public licence notices, by identifier.
SENTENCES = {
    "Apache2Ref": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "Licensed under the Apache License, Version 2.0 (the License)."),
    "ApacheUse": ("you may not use this file except in compliance with the License.",),
    "ApacheCopy": ("You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "ApacheAsIs": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',),
    "ApacheSee": ("See the License for the specific language governing permissions and limitations under the License.",),
    "MITRef": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "The MIT License (MIT)", "MIT License"),
    "MITGrant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',),
    "MITNotice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "MITNoWarranty": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',),
    "MITLiability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "GPL3Ref": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GPL, version 3."),
    "GPL2Ref": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."),
    "GPLFree": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "GPL2Free": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "GPLNoWarranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "GPLSee": ("See the GNU General Public License for more details.",),
    "GPLReceived": ("You should have received a copy of the GNU General Public License along with this program.", "You should have received a copy of the GNU General Public License along with this program; if not, see <https://www.gnu.org/licenses/>."),
    "LGPL3Ref": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "MPL2Ref": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."),
    "BSDGrant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BSDSource": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "BSDBinary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "BSDEndorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "BSD3Ref": ("Licensed under the BSD 3-Clause License.",),
    "BSD2Ref": ("Licensed under the BSD 2-Clause License.",),
    "ISCGrant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CCBYNCRef": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CCBYRef": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CCBYSARef": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "UnlicenseRef": ("This is free and unencumbered software released into the public domain.",),
    "AllRights": ("All rights reserved.",),
}

#: Licences by sequences of identifiers; the first that stands anywhere is taken first.
RULES = (
    ("MIT", ("MITRef", "Copyright", "MITGrant", "MITNotice", "MITNoWarranty", "MITLiability")),
    ("MIT", ("MITGrant", "MITNotice", "MITNoWarranty", "MITLiability")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("Apache-2.0", ("Apache2Ref", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLNoWarranty", "GPLSee", "GPLReceived")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLNoWarranty", "GPLSee")),
    ("GPL-2.0-or-later", ("GPL2Free", "GPLNoWarranty", "GPLSee", "GPLReceived")),
    ("GPL-2.0-or-later", ("GPL2Free", "GPLNoWarranty", "GPLSee")),
    ("Proprietary", ("Copyright", "AllRights")),
    ("Apache-2.0", ("Apache2Ref",)),
    ("MIT", ("MITRef",)),
    ("GPL-3.0-only", ("GPL3Ref",)),
    ("GPL-2.0-only", ("GPL2Ref",)),
    ("GPL-3.0-or-later", ("GPLFree",)),
    ("GPL-2.0-or-later", ("GPL2Free",)),
    ("LGPL-3.0-only", ("LGPL3Ref",)),
    ("MPL-2.0", ("MPL2Ref",)),
    ("BSD-3-Clause", ("BSD3Ref",)),
    ("BSD-2-Clause", ("BSD2Ref",)),
    ("ISC", ("ISCGrant",)),
    ("CC-BY-NC-4.0", ("CCBYNCRef",)),
    ("CC-BY-4.0", ("CCBYRef",)),
    ("CC-BY-SA-4.0", ("CCBYSARef",)),
    ("Unlicense", ("UnlicenseRef",)),
    ("Proprietary", ("AllRights",)),
)

#: Licences by SPDX tag, as normalised; "+" is read as -or-later.
SPDX = {n: n for n in dict.fromkeys(name for name, _ in RULES) if n != "Proprietary"} | {
    "GPL-3.0": "GPL-3.0-only", "GPL-2.0": "GPL-2.0-only", "LGPL-3.0": "LGPL-3.0-only",
    "LGPL-3.0-or-later": "LGPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1-only": "LGPL-2.1-only", "LGPL-2.1-or-later": "LGPL-2.1-or-later",
}
#: More written forms of known sentences.
MORE = {"ApacheCopy": ("You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",)}

CLUE = "|".join(CLUES)
TAG = "spdx license identifier"
NOTICE = r"^(c )?copyright (c )?[0-9]{4}( |$)"


def normalised(sentence: str) -> str:
    """A sentence as it is looked up."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def sentences_by_text() -> dict[str, str]:
    """Identifier by normalised sentence, each known sentence being cut as texts are."""
    out = {}
    for name, texts in SENTENCES.items():
        for t in texts:
            parts = [p for p in re.split(r"(?<=[.!?])[ \t]+|\n", t) if re.search(CLUE, p.lower())]
            out[normalised(parts[0])] = name
    return out


def _known() -> dict[str, str]:
    """sentences_by_text() with MORE and the SPDX tags."""
    more = {normalised(t): name for name, texts in MORE.items() for t in texts}
    return sentences_by_text() | more | {f"{TAG} {normalised(t)}": _tag_id(name) for t, name in SPDX.items()}


def _tag_id(name: str) -> str:
    return "SPDX" + re.sub("[^A-Za-z0-9]", "", name)


def _wrapped(sentence: str) -> str:
    """Pattern of whole lines that hold a normalised sentence and nothing else."""
    out, *words = sentence.split(" ")
    for w in words:
        line = r"(?:\n[^A-Za-z0-9\n]*+(?:(?:dnl|rem)(?![A-Za-z0-9])[^A-Za-z0-9\n]*+)?+){0,3}+" if w in ("http", "https") else r"(?:(?<![.!?])\n[^A-Za-z0-9\n]*+(?:(?:dnl|rem)[^A-Za-z0-9\n]++)?+)?+"
        out += rf"(?![A-Za-z0-9])[^A-Za-z0-9\n]*+{line}{w}"
    return rf"(?dim)^[^A-Za-z0-9\n]*+(?:(?:dnl|rem)[^A-Za-z0-9\n]++)?+{out}(?![A-Za-z0-9])[^A-Za-z0-9\n]*+$"


def _unwrapped(text: Column) -> Column:
    """Every sentence on lines of its own, the known ones on one."""
    text = F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n\n")
    for s in sorted((s for s in _known() if not s.startswith(TAG)), key=len, reverse=True):
        text = F.regexp_replace(text, _wrapped(s), s)
    return F.regexp_replace(text, r"(?i)(spdx-license-identifier:[^\n]*?[0-9])\+", "$1-or-later")


def _tags(sentence: Column) -> Column:
    """A normalised sentence, or one SPDX tag for each licence of its expression."""
    names = F.split(F.regexp_replace(F.regexp_replace(sentence, f"^(dnl |rem )?{TAG} ", ""), r" with .*?(?= or (?!later)| and |$)", ""), r" (?:or(?! later)|and) ")
    return F.when(sentence.rlike(f"^(dnl |rem )?{TAG} "), F.transform(names, lambda n: F.concat(F.lit(f"{TAG} "), n))).otherwise(F.array(sentence))


def _sequence(text: Column) -> Column:
    """<id><id>... of the sentences with a clue."""
    known = F.create_map(*[F.lit(x) for pair in _known().items() for x in pair])
    clued = F.filter(F.transform(F.split(_unwrapped(text), "\n"), F.lower), lambda s: s.rlike(CLUE))
    plain = F.flatten(F.transform(clued, lambda s: _tags(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))))
    named = F.transform(plain, lambda s: F.coalesce(F.try_element_at(known, s), F.when(s.rlike(NOTICE), F.lit("Copyright")), F.lit("Unknown")))
    return F.array_join(F.transform(named, lambda n: F.concat(F.lit("<"), n, F.lit(">"))), "")


def _licensed(sequence: Column) -> Column:
    """The sequence with each rule's identifiers replaced by [licence]."""
    for name, ids in (*RULES, *((n, (_tag_id(n),)) for n in dict.fromkeys(SPDX.values()))):
        sequence = F.replace(sequence, F.lit("".join(f"<{i}>" for i in ids)), F.lit(f"[{name}]"))
    return sequence


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentences, licenses, n_licenses, n_unmatched): the identifiers in order as <id><id>, the licences in
    order as [a][b], their number, and how many identifiers no rule took."""
    text = F.col(text_col).cast("string")
    sequence = F.when(text.rlike(f"(?i){CLUE}"), _sequence(text)).otherwise(F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(sequence, F.lit("")).alias("sentences"))
    rows = rows.withColumn("matched", F.when(F.col("sentences") == "", F.lit("")).otherwise(_licensed(F.col("sentences"))))
    count = lambda mark: F.length(F.regexp_replace("matched", f"[^{mark}]", "")).cast("long")
    return rows.select(
        "doc_id", "sentences", F.regexp_replace("matched", "<[A-Za-z0-9]+>", "").alias("licenses"),
        count(r"\[").alias("n_licenses"), count("<").alias("n_unmatched"),
    )


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for scan()."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = sentences_by_text()
    matched = "s"
    for name, ids in RULES:
        matched = f"replace({matched}, {quote(''.join(f'<{i}>' for i in ids))}, {quote(f'[{name}]')})"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known.items())
    return f"""
WITH known(t, id) AS (VALUES {values}),
parts AS (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) AS p,
         generate_subscripts(string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)), 1) AS i
  FROM {table}
), plain AS (
  SELECT doc_id, i, trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')) AS t FROM parts WHERE regexp_matches(lower(p), '{CLUE}')
), named AS (
  SELECT doc_id, i, coalesce(id, CASE WHEN regexp_matches(plain.t, '{NOTICE}') THEN 'Copyright' ELSE 'Unknown' END) AS id
  FROM plain LEFT JOIN known ON known.t = plain.t
), seq AS (SELECT doc_id, string_agg('<' || id || '>', '' ORDER BY i) AS s FROM named GROUP BY doc_id),
m AS (SELECT doc_id, s, {matched} AS x FROM (SELECT d.doc_id, coalesce(s, '') AS s FROM {table} d LEFT JOIN seq ON seq.doc_id = d.doc_id))
SELECT doc_id, s AS sentences, regexp_replace(x, '<[A-Za-z0-9]+>', '', 'g') AS licenses,
       length(regexp_replace(x, '[^\\[]', '', 'g'))::BIGINT AS n_licenses, length(regexp_replace(x, '[^<]', '', 'g'))::BIGINT AS n_unmatched FROM m
"""
