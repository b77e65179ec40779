"""Licence scan by sentence rules.

1. Paragraphs. Comment marks at line starts go, and a line of ``WRAP`` characters or more is joined with the next one, so
   wrapped notices are whole sentences again; a shorter line or an empty one ends its sentence.
2. Sentences. A text is lower-cased (A-Z) and cut there, at ``. ! ? ; :`` before white space and at list numbers; each
   sentence is reduced to its letters a-z and digits with single spaces.
3. Slots. Names in an endorsement clause, the many ways to say "licensed under" and the rest of a copyright line are
   replaced by fixed words, so that one catalogue sentence stands for all of them.
4. Identifiers. Known sentences map to identifiers, in order. Unknown ones are kept in the sequence as ``<?>``, so a rule
   matches sentences that follow each other only; neutral ones (copyright lines, disclaimers) are left out of it.
5. Rules. Ordered rules match runs of identifiers, earlier rules first, and each match uses its identifiers up.

Everything is a projection of built-in functions, so no row moves. Null and empty texts have no sentences and no licences.
Rows are independent; repeated rows give repeated results, and further columns are ignored. A text is handled whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, with an identifier each.
_TEXTS = (
    ("apache2-ref", "Licensed under the Apache License, Version 2.0."),
    ("apache2-ref", "Licensed under the Apache License 2.0."),
    ("apache2-ref", "Licensed under Apache-2.0."),
    ("apache2-ref", "SPDX-License-Identifier: Apache-2.0"),
    ("apache2-long", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache2-use", "you may not use this file except in compliance with the License."),
    ("apache2-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-copy", "You may obtain a copy of the License at"),
    ("apache2-url", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-url", "https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-asis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache2-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit-title", "MIT License"),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-title", "The MIT License"),
    ("mit-ref", "Licensed under the MIT license."),
    ("mit-ref", "Licensed under MIT."),
    ("mit-ref", "SPDX-License-Identifier: MIT"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit0-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-asis", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-ref", "Licensed under the ISC license."),
    ("isc-ref", "SPDX-License-Identifier: ISC"),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc-asis", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("isc-liability", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("gpl3-ref", "Licensed under the GNU General Public License, version 3."),
    ("gpl3-ref", "Licensed under the GNU General Public License v3.0."),
    ("gpl3-ref", "Licensed under the GNU GPL v3."),
    ("gpl3-ref", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl3-ref", "SPDX-License-Identifier: GPL-3.0"),
    ("gpl2-ref", "Licensed under the GNU General Public License, version 2."),
    ("gpl2-ref", "Licensed under the GNU General Public License v2.0."),
    ("gpl2-ref", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl2-ref", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl3plus-ref", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl2plus-ref", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("lgpl21-ref", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl3-ref", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("agpl3-ref", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("agpl3-ref", "Licensed under the GNU Affero General Public License, version 3."),
    ("gpl-free", "This program is free software:"),
    ("gpl-free", "This library is free software;"),
    ("gpl-free", "This file is free software;"),
    ("gpl3-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"),
    ("either2-later", "either version 2 of the License, or (at your option) any later version."),
    ("gpl2-later-one", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("lgpl21-later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"),
    ("either21-later", "either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl3-later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl3-later", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-useful", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("gpl-useful", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("gpl-warranty", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-more", "See the GNU General Public License for more details."),
    ("gpl-more", "See the GNU Lesser General Public License for more details."),
    ("gpl-more", "See the GNU Affero General Public License for more details."),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program."),
    ("ccbync4-ref", "Licensed under CC BY-NC 4.0."),
    ("ccbync4-ref", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("ccbysa4-ref", "Licensed under CC BY-SA 4.0."),
    ("ccbysa4-ref", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ccby4-ref", "Licensed under CC BY 4.0."),
    ("ccby4-ref", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("ccbyncsa4-ref", "Licensed under CC BY-NC-SA 4.0."),
    ("ccbynd4-ref", "Licensed under CC BY-ND 4.0."),
    ("cc0-ref", "Licensed under CC0 1.0."),
    ("cc0-ref", "SPDX-License-Identifier: CC0-1.0"),
    ("cc0-ref", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("cc0-ref", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("bsd-intro", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-asis", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("bsd3-ref", "Licensed under the BSD 3-Clause License."),
    ("bsd3-ref", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd2-ref", "Licensed under the BSD 2-Clause License."),
    ("bsd2-ref", "SPDX-License-Identifier: BSD-2-Clause"),
    ("mpl2-ref", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl2-tag", "SPDX-License-Identifier: MPL-2.0"),
    ("epl2-ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl2-ref", "SPDX-License-Identifier: EPL-2.0"),
    ("unlicense-free", "This is free and unencumbered software released into the public domain."),
    ("unlicense-grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib-asis", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-liability", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost-ref", "Distributed under the Boost Software License, Version 1.0."),
    ("boost-grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("wtfpl", "You just DO WHAT THE FUCK YOU WANT TO."),
    ("reserved", "All rights reserved."),
    ("copyright", "Copyright"),
)
#: Identifiers that stand in no rule and interrupt none.
NEUTRAL = ("reserved", "copyright", "bsd-asis", "isc-asis", "isc-liability", "gpl-useful", "gpl-warranty", "gpl-more", "gpl-copy", "apache2-see", "apache2-url", "mpl2-copy")
# Rules in order of precedence, each a run of identifiers.
RULES = (
    ("BSD-3-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-intro", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT-0", ("mit0-grant", "mit-asis", "mit-liability")),
    ("MIT-0", ("mit0-grant",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Apache-2.0", ("apache2-long", "apache2-use", "apache2-copy", "apache2-asis")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later", "either2-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later-one")),
    ("LGPL-2.1-or-later", ("gpl-free", "lgpl21-later", "either21-later")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl3-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-later")),
    ("Unlicense", ("unlicense-free", "unlicense-grant")),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-asis", "zlib-liability", "zlib-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-ref",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("Apache-2.0", ("apache2-long",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-title",)),
    ("ISC", ("isc-ref",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("GPL-3.0-or-later", ("gpl3plus-ref",)),
    ("GPL-2.0-or-later", ("gpl2plus-ref",)),
    ("LGPL-2.1-or-later", ("lgpl21-ref",)),
    ("LGPL-3.0-or-later", ("lgpl3-ref",)),
    ("AGPL-3.0-or-later", ("agpl3-ref",)),
    ("CC-BY-NC-4.0", ("ccbync4-ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4-ref",)),
    ("CC-BY-4.0", ("ccby4-ref",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4-ref",)),
    ("CC-BY-ND-4.0", ("ccbynd4-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("MPL-2.0", ("mpl2-tag",)),
    ("EPL-2.0", ("epl2-ref",)),
    ("WTFPL", ("wtfpl",)),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WRAP = 40
#: Steps from a lower-cased text, without ``|`` and with a line feed around it, to sentences between bars: pattern and replacement. The
#: empty one joins wrapped lines. Every pattern takes linear time, on very long lines too.
STEPS = (
    ("[\\r\\f\\x0B]+", " "),
    ("\\n[ \\t]*(/\\*+|\\*+/|\\*+|//+|#+|--+|;+|%+|<!--+|rem )[ \\t]*", "\n"),
    ("spdx-license-identifier:", "spdx license identifier "),
    ("[(]c[)] ", "c "),
    ("v\\. ([0-9])", "v $1"),
    ("\\n[ \\t]*([(]?([0-9]{1,2}|[a-z]|i{1,3}|iv|vi{0,3})[.)]|[-*+])[ \\t]+", "|"),
    (" [(]([0-9]{1,2}|[a-z])[)] ", "|"),
    ("\\n[ \\t]+", "\n"),
    ("", ""),
    ("[.!?;:][ \\t\\n]+|\\n+", "|"),
    ("[^a-z0-9|]+", " "),
    (" ?[|][| ]*", "||"),
    ("[|]((portions )?copyright( c)? [0-9][^|]*|(portions )?copyright( c)? [^|]* [12][0-9]{3}( [^|]*)?)[|]", "|copyright|"),
    ("[|]((this|the) [a-z ]{1,40} (is|are) )?((dual )?licensed|released|distributed|available|made available|published|provided) under (the terms of )?(the )?", "|under "),
    ("neither the names? of [^|]+ nor the names of (its|their|any|other) contributors", "neither the name of x nor the names of its contributors"),
)


def _sentences(text: str) -> list[str]:
    """The steps in Python, for the catalogue alone."""
    text = "\n" + text.lower().replace("|", " ") + "\n"
    for pattern, by in STEPS:
        if not pattern:
            lines = text.split("\n")
            text = "".join(x + (" " if len(x) >= WRAP else "\n") for x in lines)
            continue
        text = re.sub(pattern, lambda m, by=by: re.sub("[$]([0-9])", lambda g: m.group(int(g.group(1))) or "", by), text)
    return [s.strip() for s in text.split("|") if s.strip()]


def _catalogue() -> tuple[tuple[str, str], ...]:
    found = [(i, _sentences(t)) for i, t in _TEXTS]
    several = [i for i, s in found if len(s) != 1]
    if several:
        raise ValueError(f"more than one sentence: {several}")
    return tuple(dict.fromkeys((i, s[0]) for i, s in found))


#: Identifier and normalised sentence.
SENTENCES = _catalogue()


def sentences_of(text: Column) -> Column:
    """The normalised sentences of a text."""
    marked = F.translate(F.concat(F.lit("\n"), F.translate(F.coalesce(text, F.lit("")), "|", " "), F.lit("\n")), UPPER, LOWER)
    for pattern, by in STEPS:
        if pattern:
            marked = F.regexp_replace(marked, pattern, by)
        else:
            marked = F.array_join(F.transform(F.split(marked, "\n"), lambda x: F.concat(x, F.when(F.length(x) >= WRAP, " ").otherwise("\n"))), "")
    return F.filter(F.transform(F.split(marked, "[|]"), lambda s: F.trim(s)), lambda s: s != "")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_known, sentence_ids, licenses, n_licenses, n_unmatched) per row of (doc_id, text).

    ``sentence_ids`` holds the known identifiers, neutral ones too; ``n_unmatched`` counts those that no rule has used.
    """
    sentences = sentences_of(F.col("text"))
    known = F.array(*[F.lit(s) for _, s in SENTENCES])
    names = F.array(*[F.lit(f"<{i}>") for i, _ in SENTENCES])
    kept = F.array(*[F.lit("" if i in NEUTRAL else f"<{i}>") for i, _ in SENTENCES])
    rows = docs.select("doc_id", sentences.alias("sentences"))
    rows = rows.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.transform("sentences", lambda s: F.array_position(known, s).cast("int")).alias("at"))
    found = F.filter("at", lambda k: k > 0)
    rows = rows.withColumns({"found": found, "sentence_ids": F.array_join(F.transform(found, lambda k: F.element_at(names, k)), ""),
        "sequence": F.array_join(F.transform("at", lambda k: F.when(k > 0, F.try_element_at(kept, F.greatest(k, F.lit(1)))).otherwise("<?>")), "")})
    left = F.col("sequence")
    for name, run in RULES:
        left = F.replace(left, F.lit("".join(f"<{i}>" for i in run)), F.lit(f"[{name}]"))
    rows = rows.withColumn("left", left)
    licenses = F.regexp_extract_all("left", F.lit("\\[([^\\]]+)\\]"), F.lit(1))
    rows = rows.select("doc_id", "n_sentences", F.size("found").cast("long").alias("n_known"), "sentence_ids", licenses.alias("list"), F.regexp_count(F.col("left"), F.lit("<[a-z0-9]")).cast("long").alias("n_unmatched"))
    return rows.select("doc_id", "n_sentences", "n_known", "sentence_ids", F.array_join("list", ",").alias("licenses"), F.size("list").cast("long").alias("n_licenses"), "n_unmatched")


def scan_sql(table: str = "documents") -> str:
    """The rows of scan() for DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(quoted(s) for _, s in SENTENCES)
    names = ", ".join(quoted(f"<{i}>") for i, _ in SENTENCES)
    kept = ", ".join(quoted("" if i in NEUTRAL else f"<{i}>") for i, _ in SENTENCES)
    marked = f"translate(concat(chr(10), translate(coalesce(text, ''), '|', ' '), chr(10)), '{UPPER}', '{LOWER}')"
    for pattern, by in STEPS:
        if not pattern:
            marked = f"array_to_string(list_transform(string_split({marked}, chr(10)), lambda x: x || CASE WHEN length(x) >= {WRAP} THEN ' ' ELSE chr(10) END), '')"
            continue
        marked = f"regexp_replace({marked}, {quoted(pattern)}, {quoted(by.replace('$', chr(92)))}, 'g')"
    left = "sequence"
    for name, run in RULES:
        left = f"replace({left}, '{''.join(f'<{i}>' for i in run)}', '[{name}]')"
    return f"""
WITH cut AS (SELECT doc_id, list_filter(list_transform(string_split({marked}, '|'), lambda s: trim(s)), lambda s: s <> '') AS sentences FROM {table}),
placed AS (SELECT doc_id, len(sentences) AS n_sentences, list_transform(sentences, lambda s: coalesce(list_position([{known}], s), 0)) AS places FROM cut),
known AS (SELECT *, list_filter(places, lambda k: k > 0) AS found FROM placed),
named AS (SELECT *, coalesce(array_to_string(list_transform(found, lambda k: ([{names}])[k]), ''), '') AS sentence_ids,
  coalesce(array_to_string(list_transform(places, lambda k: CASE WHEN k > 0 THEN ([{kept}])[k] ELSE '<?>' END), ''), '') AS sequence FROM known),
matched AS (SELECT *, {left} AS leftover FROM named)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(len(found) AS BIGINT) AS n_known, sentence_ids,
  coalesce(array_to_string(regexp_extract_all(leftover, '\\[([^\\]]+)\\]', 1), ','), '') AS licenses,
  CAST(len(regexp_extract_all(leftover, '\\[([^\\]]+)\\]', 1)) AS BIGINT) AS n_licenses,
  CAST(len(regexp_extract_all(leftover, '<[a-z0-9]')) AS BIGINT) AS n_unmatched
FROM matched"""
