"""License scans by sentence rules, in DataFrame and SQL functions only.

Normalised sentences are looked up in a table of known licence sentences; the identifiers of those found, in order of the
text, are matched against ordered rules, each a sequence of identifiers. Whatever stands between a rule's sentences, known or
not, is passed over. Where one rule extends another, the sentences of each fit of the longer one are taken out before the
shorter one is tried, so both count where both stand. Sentences end at a line's end or, for licences that were wrapped, only at
punctuation and blank lines: the licences of both readings are reported, and the sentences of the reading that knows more of
them. SPDX identifier tags count, too. All of it is one narrow projection: nothing is shuffled, whatever a document's size or
source, and documents without any word of a licence are left early.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Wordings as the licences' published texts have them.

#: Licence: its names in notices.
NAMES = {
    "MIT": ("MIT License", "MIT license (MIT)"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-1.0": ("Eclipse Public License, version 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License v2.0"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Unlicense": ("Unlicense",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "CDDL-1.0": ("Common Development and Distribution License, version 1.0",),
    "EUPL-1.2": ("European Union Public Licence, version 1.2", "EUPL 1.2"),
    "PSF-2.0": ("Python Software Foundation License, version 2",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}

#: Notices that a name stands in.
NOTICES = ("Released under {}.", "Licensed under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.")

#: Identifier: sentence.
SENTENCES = {
    "mit-name": "The MIT License (MIT)",
    "mit-name-2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-grant-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "mit-liability": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "x11-name": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-0": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the License);",
    "apache-header-2": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-origin": "The origin of this software must not be misrepresented;",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl1-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cddl1-terms": "The contents of this file are subject to the terms of the Common Development and Distribution License (the License).",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "wtfpl-copy": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "ofl-terms": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "cc0-waive": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

#: Licence and an ordered sequence of identifiers that shows it; notices of NAMES and SPDX tags show theirs.
RULES = (
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-name", "mit-grant")),
    ("MIT", ("mit-name-2", "mit-grant")),
    ("MIT-0", ("mit-grant-0", "mit-warranty")),
    ("X11", ("mit-grant", "mit-condition", "mit-warranty", "x11-name")),
    ("X11", ("mit-grant", "mit-condition", "x11-name")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("isc-grant-0", "isc-warranty")),
    ("Apache-2.0", ("apache-header", "apache-header-2")),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Zlib", ("zlib-as-is", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-origin", "zlib-altered", "zlib-notice")),
    ("Unlicense", ("unlicense",)),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-form",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("CDDL-1.0", ("cddl1-terms",)),
    ("BSL-1.0", ("boost-grant",)),
    ("WTFPL", ("wtfpl-copy",)),
    ("OFL-1.1", ("ofl-terms",)),
    ("CC0-1.0", ("cc0-waive",)),
)

#: Of every known sentence a part that its text holds as it stands, lower-cased.
MARKERS = ("licen", "permission", "permitted", "software", "redistribut", "warranty", "copyright", "acknowledgement", "this file", "this notice", "released under", "distributed under", "altered source")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(sentence: str) -> str:
    """What the SQL below does: A-Z lower-cased, all runs but letters and digits one blank."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


def notices() -> dict[str, str]:
    """Sentence, normalised: identifier of the notice, for every name in every notice, with and without an article."""
    return {normalise(n.format(article + name)): f"{licence.lower()}-notice" for licence, names in NAMES.items() for name in names for n in NOTICES for article in ("", "the ", "a ")}


def rules() -> list[tuple[str, tuple[str, ...]]]:
    return [*RULES, *((licence, (f"{licence.lower()}-notice",)) for licence in NAMES)]


def spdx() -> dict[str, str]:
    """Identifier as a tag may spell it, lower-cased: licence."""
    names = list(dict.fromkeys(licence for licence, _ in rules()))
    old = {re.sub("-only$", "", x).lower(): x for x in names if x.endswith("-only")}
    return {x.lower(): x for x in names} | old | {f"{k}+": re.sub("-only$", "-or-later", v) for k, v in old.items()}


def extends(longer: tuple[str, ...], shorter: tuple[str, ...]) -> bool:
    """Whether the longer sequence holds the shorter one in order, with more."""
    rest = iter(longer)
    return len(longer) > len(shorter) and all(x in rest for x in shorter)


def pattern(ids: tuple[str, ...]) -> str:
    """A regular expression for identifiers that each stand between two commas of their own; what stands between them is a group each."""
    return "(.*?)".join("," + re.escape(x) + "," for x in ids).replace("\\-", "-")


def pieces(sentence: str) -> list[str]:
    """What the unwrapped reading below makes of a sentence, normalised."""
    flat = re.sub(r"([.;:!?])[ \t\r\n]+|[ \t\r\n]+", lambda m: (m[1] or "") + " ", re.sub(r"\n[ \t\r]*\n", ":\n", sentence))
    return [normalise(x) for x in re.sub("([.;:!?]) ", "\\1\n", flat).split("\n")]


def cut_sentences() -> dict[str, list[str]]:
    """Identifier: pieces, of the known sentences that no reading leaves whole."""
    return {k: found for k, s in SENTENCES.items() if len(found := pieces(s)) > 1}


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fits(readings: tuple[str, ...]) -> dict[str, str]:
    """Licence: a test of its rules on columns in which each identifier stands between two commas of its own."""
    found: dict[str, list[str]] = {}
    every = rules()
    for licence, ids in every:
        # fits of longer rules of other licences are taken out, longest first; what stood between their sentences stays
        longer = sorted((other for name, other in every if name != licence and extends(other, ids)), key=lambda x: (-len(x), x))
        for r in readings:
            for other in longer:
                r = f"regexp_replace({r}, {_text(pattern(other))}, '{''.join(f'${i + 1}' for i in range(len(other) - 1))}')"
            test = f"contains({r}, ',{ids[0]},')" if len(ids) == 1 else f"rlike({r}, {_text(pattern(ids))})"
            found.setdefault(licence, []).append(test)
    return {licence: " OR ".join(found[licence]) for licence in sorted(found)}


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses) of each row: the identifiers in order, and the licences, by name, joined by commas.

    Null and empty texts have none (empty strings). Rows of one doc_id, or of a null one, are scanned each for itself; other
    columns are not read. A sentence that repeats counts as often as it comes, the licence once. A known sentence that the
    reading cuts into pieces counts once, where all its pieces stand in order.
    """
    whole = {normalise(s): k for k, s in SENTENCES.items()} | notices()
    cut = sorted(cut_sentences().items(), key=lambda x: -len(x[1]))
    parts: dict[str, str] = {}  # sentences may share pieces: each has one identifier
    for said in (s for _, found in cut for s in found):
        parts.setdefault(said, whole.get(said, f"piece-{len(parts)}.0"))
    known = ", ".join(f"'{s}', '{k}'" for s, k in (parts | whole).items())
    found = "filter(transform(split({0}, '\\n'), s -> element_at(known, trim(regexp_replace(s, '[^a-z0-9]+', ' ')))), x -> x IS NOT NULL)"
    joined = "concat(',', array_join({0}, ',,'), ',')"
    for k, found_ in cut:
        joined = f"replace({joined}, '{''.join(f',{parts[x]},' for x in found_)}', ',{k},')"
    reading = f"regexp_replace({joined.format(found)}, ',[a-z0-9-]+[.][0-9],', '')"  # pieces that make no sentence go
    tags = ", ".join(f"'{k}', '{v}'" for k, v in spdx().items())
    tagged = f"filter(transform(flatten(transform(regexp_extract_all(t, 'spdx-license-identifier:[ \\\\t]*([a-z0-9.+() -]+)', 1), x -> split(x, '[ ()]+'))), x -> element_at(map({tags}), x)), x -> x IS NOT NULL)"
    rows = docs.selectExpr("doc_id", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t", f"map({known}) AS known")
    rows = rows.selectExpr("doc_id", "known", f"CASE WHEN rlike(t, '{'|'.join(MARKERS)}') THEN t ELSE '' END AS t")
    rows = rows.selectExpr("doc_id", "known", f"{tagged} AS tags", r"regexp_replace(t, '([.;:!?])[ \t\r]+', '$1\n') AS lines", r"regexp_replace(regexp_replace(t, '\n[ \t\r]*\n', ':\n'), '([.;:!?])[ \t\r\n]+|[ \t\r\n]+', '$1 ') AS flat")
    rows = rows.selectExpr("doc_id", "known", "tags", "lines", r"regexp_replace(flat, '([.;:!?]) ', '$1\n') AS flat")
    rows = rows.selectExpr("doc_id", "tags", f"{reading.format('lines')} AS a", f"{reading.format('flat')} AS b")
    rows = rows.selectExpr("doc_id", "tags", "a", "b", "filter(split(a, ','), x -> x <> '') AS of_a", "filter(split(b, ','), x -> x <> '') AS of_b")
    rows = rows.selectExpr("doc_id", "tags", "a", "b", "CASE WHEN size(of_a) >= size(of_b) THEN of_a ELSE of_b END AS ids")
    named = ", ".join(f"CASE WHEN {test} OR array_contains(tags, '{licence}') THEN '{licence}' END" for licence, test in _fits(("a", "b")).items())
    licenses = f"CASE WHEN size(ids) > 0 OR size(tags) > 0 THEN array_join(array({named}), ',') ELSE '' END"
    return rows.selectExpr("doc_id", "CAST(size(ids) AS BIGINT) AS n_sentences", "array_join(ids, ',') AS sentence_ids", f"{licenses} AS licenses")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The notices that the tables' documents hold, stated by hand and independent of the tables above: one line or sentence each.
OP8_SQL = r"""
WITH known(said, id, license) AS (VALUES
  ('released under the mit license', 'mit-notice', 'MIT'), ('licensed under the mit license', 'mit-notice', 'MIT'),
  ('licensed under the apache license version 2 0', 'apache-2.0-notice', 'Apache-2.0'),
  ('this work is licensed under the gnu general public license version 3', 'gpl-3.0-only-notice', 'GPL-3.0-only'),
  ('licensed under cc by nc 4 0', 'cc-by-nc-4.0-notice', 'CC-BY-NC-4.0'), ('licensed under cc by 4 0', 'cc-by-4.0-notice', 'CC-BY-4.0'),
  ('licensed under cc by sa 4 0', 'cc-by-sa-4.0-notice', 'CC-BY-SA-4.0'), ('released under cc0 1 0', 'cc0-1.0-notice', 'CC0-1.0')),
t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
v AS (SELECT doc_id, 1 AS reading, string_split(regexp_replace(t, '([.;:!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM t
      UNION ALL SELECT doc_id, 2, string_split(regexp_replace(regexp_replace(regexp_replace(t, '\n[ \t\r]*\n', ':' || chr(10), 'g'), '([.;:!?])[ \t\r\n]+|[ \t\r\n]+', '\1 ', 'g'), '([.;:!?]) ', '\1' || chr(10), 'g'), chr(10)) FROM t),
s AS (SELECT doc_id, reading, generate_subscripts(parts, 1) AS i, trim(regexp_replace(unnest(parts), '[^a-z0-9]+', ' ', 'g')) AS said FROM v),
f AS (SELECT doc_id, reading, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM s JOIN known USING (said) GROUP BY doc_id, reading),
best AS (SELECT doc_id, arg_max(n, n * 10 - reading) AS n, arg_max(ids, n * 10 - reading) AS ids FROM f GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM s JOIN known USING (said) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN l USING (doc_id)
"""
