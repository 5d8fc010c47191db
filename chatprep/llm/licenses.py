"""License scans by sentence rules, in DataFrame functions only.

A text is normalised (A-Z lowered, everything but a-z and 0-9 as one space) between two kinds of
borders.  Sentences end at ``.``, ``!`` or ``?`` before white space and at lines without a letter
or digit; any other line break may or may not end one.  A known licence sentence is found where it
stands from border to border, with line breaks (and the comment marks after them) read as spaces
inside it.  So a text is recognised wrapped at any width, plain or in ``#``, ``//``, `` * `` and
other comments, and a notice on a line of its own is recognised as well.  Sentences become
identifiers, in order; of sentences that begin at one border the longer known one counts.  A rule
is an ordered list of identifiers; it applies where they stand next to each other among the known
sentences of the document.  All of it is row-local: no shuffle, and a long text costs what its
length says.

A null or empty text has no sentence.  Repeated rows are judged row by row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.native import ascii_lower
from chatprep.operators.common import pin

# Borders, in lowered text.  HARD and SOFT stand twice, so that sentences on both sides find one.
HARD, SOFT = "\u0001", "\u0002"
SENTENCE_END = r"""[.!?]["')\]]*[ \t\r\n]+|\n[^a-z0-9\n]*\n[^a-z0-9]*"""
NOISE = r"[^a-z0-9\x01\x02]+"
# Normalised sentences of public licences and notices.
SENTENCES = {
    "apache2-line": "licensed under the apache license version 2 0",
    "apache2-grant": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-grant-comply": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-line": "released under the mit license",
    "mit-title": "mit license",
    "mit-title-the": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3-line": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liable": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "apache11-credit": "the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation http www apache org",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2-copy-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "bsl-title": "boost software license version 1 0 august 17th 2003",
    "bsl-line": "distributed under the boost software license version 1 0",
    "ccby4-title": "creative commons attribution 4 0 international public license",
    "ccbysa4-title": "creative commons attribution sharealike 4 0 international public license",
    "ccbync4-title": "creative commons attribution noncommercial 4 0 international public license",
    "ccbyncsa4-title": "creative commons attribution noncommercial sharealike 4 0 international public license",
    "ccbynd4-title": "creative commons attribution noderivatives 4 0 international public license",
    "ccby4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccbync4-line": "licensed under cc by nc 4 0",
    "ccby4-line": "licensed under cc by 4 0",
    "ccbysa4-line": "licensed under cc by sa 4 0",
    "cc0-line": "licensed under cc0 1 0",
    "reserved": "all rights reserved",
}
# Ordered rules, (licence, sentences that follow each other).
RULES = [
    ("Apache-2.0", ["apache2-line"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply"]),
    ("Apache-2.0", ["apache2-grant-comply"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("MIT", ["mit-title-the", "mit-grant"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("GPL-3.0-only", ["gpl3-line"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope", "agpl-see"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope", "lgpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope", "lgpl-see"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-asis"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("Apache-1.1", ["bsd-source", "bsd-binary", "apache11-credit"]),
    ("ISC", ["isc-grant", "isc-asis"]),
    ("0BSD", ["0bsd-grant", "isc-asis"]),
    ("Zlib", ["zlib-asis", "zlib-liable", "zlib-grant"]),
    ("Unlicense", ["unlicense-free"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy-http"]),
    ("BSL-1.0", ["bsl-title"]),
    ("BSL-1.0", ["bsl-line"]),
    ("CC-BY-4.0", ["ccby4-title"]),
    ("CC-BY-4.0", ["ccby4-work"]),
    ("CC-BY-SA-4.0", ["ccbysa4-title"]),
    ("CC-BY-SA-4.0", ["ccbysa4-work"]),
    ("CC-BY-NC-4.0", ["ccbync4-title"]),
    ("CC-BY-NC-4.0", ["ccbync4-work"]),
    ("CC-BY-NC-SA-4.0", ["ccbyncsa4-title"]),
    ("CC-BY-ND-4.0", ["ccbynd4-title"]),
    ("CC-BY-NC-4.0", ["ccbync4-line"]),
    ("CC-BY-4.0", ["ccby4-line"]),
    ("CC-BY-SA-4.0", ["ccbysa4-line"]),
    ("CC0-1.0", ["cc0-line"]),
    ("LicenseRef-all-rights-reserved", ["reserved"]),
]
# Licences that files name by an SPDX line; each name is a sentence and a rule.
SPDX = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC 0BSD Zlib Unlicense MPL-2.0 BSL-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()
for _name in SPDX:
    SENTENCES[f"spdx-{_name.lower()}"] = "spdx license identifier " + re.sub("[^a-z0-9]+", " ", _name.lower())
    RULES.append((_name, [f"spdx-{_name.lower()}"]))
# Every known sentence holds one of these, so other texts need not be cut.  Normalising keeps runs
# of letters and digits as they are, so a mark made of those alone stands in the raw text as well.
MARKS = ["licens", "permission", "warrant", "redistribut", "copyright", "reserved", "liable", "unencumbered", "mpl"]


def pattern(sentences: dict[str, str]) -> str:
    """A known sentence from border to border; the longer ones are tried first."""
    ordered = sorted(sentences.values(), key=lambda words: (-len(words), words))
    return rf"[\x01\x02] *({'|'.join(words.replace(' ', '[ \\x02]+') for words in ordered)}) *[\x01\x02]"


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The known sentences of a text, in order, as identifiers."""
    known = F.create_map(*[F.lit(x) for name, words in sentences.items() for x in (words, name)])
    low = F.translate(ascii_lower(text), HARD + SOFT, "  ")
    cut = F.replace(F.regexp_replace(low, SENTENCE_END, f" {HARD}{HARD} "), F.lit("\n"), F.lit(f" {SOFT}{SOFT} "))
    whole = F.concat(F.lit(HARD), F.regexp_replace(cut, NOISE, " "), F.lit(HARD))
    found = F.regexp_extract_all(whole, F.lit(pattern(sentences)), F.lit(1))
    return F.transform(found, lambda x: F.element_at(known, F.regexp_replace(x, r"[ \x02]+", " ")))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: dict[str, str] = SENTENCES,
    rules: list[tuple[str, list[str]]] = RULES,
    marks: list[str] = MARKS,
) -> DataFrame:
    """``doc_id, sentence_ids, licenses`` (sorted arrays of names) of every row."""
    if odd := [m for m in marks if not re.fullmatch("[a-z0-9]+", m)]:
        raise ValueError(f"marks must be of a-z and 0-9 only: {odd}")
    if bare := [n for n, s in sentences.items() if not any(m in s for m in marks)]:
        raise ValueError(f"sentences without a mark: {bare}")
    empty = F.array().cast("array<string>")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    low = pin(rows, low=F.lower("text"))  # lowers more than A-Z, which only marks more texts
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.col("low").contains(mark)
    low = low.withColumn("text", F.when(marked, F.col("text"))).drop("low")
    found = pin(low, ids=F.coalesce(sentence_ids(F.col("text"), sentences), empty))
    line = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    names = [F.when(F.contains(line, F.lit(f",{','.join(ids)},")), F.lit(name)) for name, ids in rules]
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))
    return found.select("doc_id", F.col("ids").alias("sentence_ids"), F.when(F.size("ids") > 0, names).otherwise(empty).alias("licenses"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_sql() -> str:
    """The same scan as ANSI SQL, for the check of ``op3_license_scan``."""
    known = ", ".join(f"('{name}', '{words}')" for name, words in SENTENCES.items())
    rules = ", ".join(f"('{name}', ',{','.join(ids)},')" for name, ids in RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH known(name, words) AS (VALUES {known}), rules(license, ids) AS (VALUES {rules}),
low AS (SELECT doc_id, translate({lower.format("coalesce(text, '')")}, chr(1) || chr(2), '  ') AS t FROM documents),
cut AS (SELECT doc_id, replace(regexp_replace(t, {_quoted(SENTENCE_END)}, ' ' || chr(1) || chr(1) || ' ', 'g'), chr(10), ' ' || chr(2) || chr(2) || ' ') AS t FROM low),
parts AS (SELECT doc_id, regexp_extract_all(chr(1) || regexp_replace(t, {_quoted(NOISE)}, ' ', 'g') || chr(1), {_quoted(pattern(SENTENCES))}, 1) AS p FROM cut),
normal AS (SELECT doc_id, i, regexp_replace(p[i], '[ \\x02]+', ' ', 'g') AS words FROM parts, unnest(range(1, len(p) + 1)) AS r(i)),
found AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY i) AS ids FROM normal JOIN known USING (words) GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
          FROM found JOIN rules ON contains(',' || found.ids || ',', rules.ids) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN found USING (doc_id) LEFT JOIN named USING (doc_id)
"""
