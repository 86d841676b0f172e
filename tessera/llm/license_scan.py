"""Licence scan by sentence rules, in DataFrame operations only.

Texts are cut into sentences, at line ends too but not where a known sentence is
wrapped over lines, with or without comment marks; each is normalised (lower case, letters and
digits only; the owner's name in BSD sentences is any) and looked up in a table of known licence sentences, which gives
its identifier. The identifiers of a document, in order, with a mark for
unknown sentences between them, are matched against ordered rules from left to
right: at each identifier the rules are tried in their order, and the first
whose identifiers follow each other, with at most ``GAP`` unknown sentences
between two of them, gives its licence and consumes them. A rule that another
one begins with stands after it, so a three-clause text is not two-clause too.

Only documents with one of a few anchor words are cut up; the words are derived
from the table so that every known sentence has one. One pass over the text,
without a shuffle.

Defined results: null or empty texts have no licences; a known sentence outside
any complete rule is counted and listed but gives no licence; every row gives a
row, repeated rows and null doc_ids too; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 2

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header-1": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-2.0/header-2": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0/header-3": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit/notice": "Released under the MIT License.",
    "mit/notice-2": "Licensed under the MIT License.",
    "mit/grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit/condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd/source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd/binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd/endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl/grant-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl/grant-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl/hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0/notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0/work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0/work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0/work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense/domain": "This is free and unencumbered software released into the public domain.",
    "unlicense/anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "apache-2.0/header-4": "See the License for the specific language governing permissions and limitations under the License.",
    "mit/warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit/liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit/style": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT.",
    "mit-0/grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "json/good": "The Software shall be used for Good, not Evil.",
    "0bsd/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc/warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd/advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd/disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd/style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "gpl/only-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl/details": "See the GNU General Public License for more details.",
    "gpl/copy": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl/grant-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl/grant-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl/hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl/details": "See the GNU Lesser General Public License for more details.",
    "agpl/grant-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl/details": "See the GNU Affero General Public License for more details.",
    "mpl-2.0/copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-1.1/notice": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
    "epl-1.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib/warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib/liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib/grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib/origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "zlib/altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib/notice": "This notice may not be removed or altered from any source distribution.",
    "bsl-1.0/notice": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-1.0/dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-1.0/copy": "You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    "cc-by-nd-4.0/work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0/work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0/work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-3.0/work": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "cc-by-sa-3.0/work": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "ofl-1.1/notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "gfdl-1.3/grant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation.",
    "perl/notice": "This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming language system itself.",
    "ms-pl/notice": "This source code is subject to terms and conditions of the Microsoft Public License.",
}
# The ordered sentences that make up each licence, by SPDX identifier; the first rule that matches counts.
RULES = (
    ("Apache-2.0", ("apache-2.0/notice",)),
    ("Apache-2.0", ("apache-2.0/header-1", "apache-2.0/header-2", "apache-2.0/header-3", "apache-2.0/header-4")),
    ("Apache-2.0", ("apache-2.0/header-1", "apache-2.0/header-2", "apache-2.0/header-3")),
    ("JSON", ("mit/grant", "mit/condition", "json/good")),
    ("MIT", ("mit/grant", "mit/condition", "mit/warranty", "mit/liability")),
    ("MIT", ("mit/grant", "mit/condition")),
    ("MIT-0", ("mit-0/grant",)),
    ("MIT", ("mit/notice",)),
    ("MIT", ("mit/notice-2",)),
    ("MIT", ("mit/style",)),
    ("ISC", ("isc/grant",)),
    ("0BSD", ("0bsd/grant",)),
    ("BSD-4-Clause", ("bsd/grant", "bsd/source", "bsd/binary", "bsd/advertise", "bsd/endorse")),
    ("BSD-3-Clause", ("bsd/grant", "bsd/source", "bsd/binary", "bsd/endorse")),
    ("BSD-2-Clause", ("bsd/grant", "bsd/source", "bsd/binary")),
    ("BSD-3-Clause", ("bsd/style",)),
    ("GPL-3.0-only", ("gpl-3.0/notice",)),
    ("GPL-2.0-only", ("gpl/only-2",)),
    ("GPL-2.0-or-later", ("gpl/grant-2", "gpl/hope")),
    ("GPL-3.0-or-later", ("gpl/grant-3", "gpl/hope")),
    ("LGPL-2.1-or-later", ("lgpl/grant-2.1", "lgpl/hope")),
    ("LGPL-3.0-or-later", ("lgpl/grant-3", "gpl/hope")),
    ("AGPL-3.0-or-later", ("agpl/grant-3", "gpl/hope")),
    ("MPL-2.0", ("mpl-2.0/notice", "mpl-2.0/copy")),
    ("MPL-2.0", ("mpl-2.0/notice",)),
    ("MPL-1.1", ("mpl-1.1/notice",)),
    ("EPL-1.0", ("epl-1.0/notice",)),
    ("EPL-2.0", ("epl-2.0/notice",)),
    ("Zlib", ("zlib/warranty", "zlib/liability", "zlib/grant", "zlib/origin", "zlib/altered", "zlib/notice")),
    ("BSL-1.0", ("bsl-1.0/notice",)),
    ("CC0-1.0", ("cc0-1.0/dedication",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0/notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0/work",)),
    ("CC-BY-4.0", ("cc-by-4.0/notice",)),
    ("CC-BY-4.0", ("cc-by-4.0/work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0/notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0/work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4.0/work",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4.0/work",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4.0/work",)),
    ("CC-BY-3.0", ("cc-by-3.0/work",)),
    ("CC-BY-SA-3.0", ("cc-by-sa-3.0/work",)),
    ("OFL-1.1", ("ofl-1.1/notice",)),
    ("GFDL-1.3-or-later", ("gfdl-1.3/grant",)),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", ("perl/notice",)),
    ("MS-PL", ("ms-pl/notice",)),
    ("Unlicense", ("unlicense/domain", "unlicense/anyone")),
    ("Unlicense", ("unlicense/domain",)),
)

#: Where a sentence ends: a line's end, or a mark with white space or the end behind it.
BOUNDARY = r"\n|[.!?;:]+(?:[\x20\t\r]+|$)"


#: Tags name a licence by itself; so do sentences made of them.
SENTENCES |= {f"spdx/{name}": f"SPDX license identifier {name}" for name, _ in RULES if " " not in name}
RULES += tuple((name, (f"spdx/{name}",)) for name in dict.fromkeys(name for name, _ in RULES) if " " not in name)


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def pieces(text: str) -> list[str]:
    """The normalised sentences of a known text; those of one or two words tell nothing and go."""
    return [n for n in map(normalised, re.split(BOUNDARY, text)) if n.count(" ") >= 2]


def known() -> dict[str, str]:
    """Normalised sentence -> identifier. A sentence with inner marks is known by its pieces, numbered."""
    out = {}
    for name, sentence in SENTENCES.items():
        parts = pieces(sentence)
        for k, part in enumerate(parts):
            out.setdefault(part, name if len(parts) == 1 else f"{name}#{k + 1}")
    return out


def sequences() -> list[tuple[str, list[str]]]:
    """The identifiers of each rule in order, of pieces where sentences have several."""
    ids = known()
    return [(licence, [ids[p] for s in rule for p in pieces(SENTENCES[s])]) for licence, rule in RULES]


def anchors() -> list[str]:
    """A few words, one of them in every known sentence: the longest that cover most, in turn."""
    left = {s: set(s.split()) for s in known()}
    out = []
    while left:
        words = {w for words in left.values() for w in words if len(w) >= 7} or {w for words in left.values() for w in words}
        best = max(sorted(words), key=lambda w: (sum(w in x for x in left.values()), len(w)))
        out.append(best)
        left = {s: w for s, w in left.items() if best not in w}
    return out


def _pattern(sequence: list[str]) -> str:
    return ("(?:<->){0," + str(GAP) + "}").join("<" + re.sub(r"([.+*?^$()\[\]{}|\\])", r"\\\1", i) + ">" for i in sequence)


#: Marks the end of a sentence in a text that is cut up; it is white space in the text itself.
_END = "\x01"
#: The owner's name, which stands in one sentence of BSD texts, with what follows it.
_OWNER = r"(?s)neither[ \n]the[ \n]names?[ \n]of[ \n].{1,160}?[ \n\x01]nor[ \n]the[ \n]names[ \n]of"


def cut(low: Column) -> Column:
    """The normalised sentences of lower-case text in order, of those that are wrapped over lines as one.

    Each step is linear: words are put one character apart, that is a blank or a
    line's end, or _END at the end of a sentence or at empty lines, but for those
    before an address, which notices set off. From a line's begin a known
    sentence is tried, longer ones first, whose words are one character apart
    and which ends with a line; else the line is a sentence.
    """
    text = F.regexp_replace(F.translate(low, _END, " "), r"spdx-license-identifier:[ \t]*", "spdx license identifier ")
    text = F.regexp_replace(text, r"(?<![.!?;:])[.!?;:]++(?=\s|\z)", _END)
    text = F.regexp_replace(text, r"[^a-z0-9\n\x01]+", " ")
    text = F.trim(F.regexp_replace(text, r" ?([\n\x01]) ?", "$1"))
    text = F.regexp_replace(F.regexp_replace(text, r"\n{2,}+(?!https?(?:[ \n\x01]|\z))", _END), r"\n+", "\n")
    text = F.regexp_replace(text, _OWNER, "neither the name of the copyright holder nor the names of")
    wrapped = "|".join(s.replace(" ", r"[ \n]") for s in sorted(known(), key=lambda s: (-len(s), s)))
    lines = F.regexp_extract_all(text, F.lit(rf"(?:{wrapped})(?=[\n\x01]|\z)|[^\n\x01]+"), F.lit(0))
    return F.transform(lines, lambda s: F.trim(F.translate(s, "\n", " ")))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known (known sentences), sequence (their identifiers in order) and licenses, sorted and joined."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(text)
    ids = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    candidate = F.lit(False)
    for word in anchors():
        candidate = candidate | F.contains(low, F.lit(word))
    marked = F.transform(F.filter(cut(low), lambda s: s != ""), lambda s: F.coalesce(F.try_element_at(ids, s), F.lit("-")))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(candidate, marked).otherwise(F.array().cast("array<string>")).alias("marks"))
    found = found.select("doc_id", F.filter("marks", lambda m: m != "-").alias("ids"), F.concat(F.lit("<"), F.array_join("marks", "><"), F.lit(">")).alias("line"))

    # alternatives of a pattern are tried in order and what one matches is consumed
    matches = F.regexp_extract_all("line", F.lit("|".join(_pattern(q) for _, q in sequences())), F.lit(0))
    licence = F.create_map(*[F.lit(x) for q, name in {"".join(f"<{i}>" for i in q): name for name, q in sequences()[::-1]}.items() for x in (q, name)])
    licences = F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.element_at(licence, F.replace(m, F.lit("<->"), F.lit(""))))))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sequence"), F.array_join(F.when(F.size("ids") > 0, licences).otherwise(F.array().cast("array<string>")), ",").alias("licenses"))
