"""Licence scans by canonical digest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of public licences and the notices that stand for them.
LICENSES = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "ISC": """Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
""",
    "Zlib": """Copyright (c) <year> <copyright holders>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution.
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity
of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
""",
}
#: Titles that may stand before these texts; each text is known without one, too.
TITLES = {
    "MIT": ("MIT License", "The MIT License (MIT)", "The MIT License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Digests of long texts: whole, without the title lines, and without the appendix after the terms.
DIGESTS = {
    "Apache-2.0": (
        "330aaa238225222ce4f6fa14ebf239c2",
        "c7c008f261d3b42d7dbfba1462ad6be6",
        "f00410e3dc708ef038f29c5b29c6707e",
        "95ffdd44acb4e07a5d969d6ec0d3ea54",
    ),
    "BSD-3-Clause": (
        "ddcd765ed0a3236bf96e15f76c36983a",
    ),
    "CC0-1.0": (
        "93a180096f6cfcf2c0dd24f75c2eec48",
        "fa8a03d1b9df2c6dbd261e2159fa72bd",
    ),
    "GPL-1.0": (
        "9a6d41337fa0145d93e534071bfae3f8",
        "78f3b35da3d393ee93ecfeb7d20907e6",
        "32e53ed618299a15d7bfc0a6709615dc",
        "5bfcbf681773451045e98548301ab37d",
    ),
    "GPL-2.0": (
        "8e4925da11f68cc625b11b0a628fdcc5",
        "42f2f51f3e726d001525877e3528c3d0",
        "0c1449134afe37647200b4c97852f53b",
        "51c7be0fdd02df3fb5f31db2247bf095",
    ),
    "GPL-3.0": (
        "b79359b5e391fd47146ff34ae3db7ec0",
        "444f95dc767ede978b60cfb20fbd0bca",
        "70ec10b9874c45fcd6727ddbd51f2ffa",
        "b585be0cf2ff3e9362303bb637995e26",
    ),
    "LGPL-2.0": (
        "74cf7fcef3b29a39165a795b2cad3a3a",
        "c396ba2f94537628797123bc12cd2d6e",
        "a34861e6f66450057d08c3192f8b454b",
        "6c4299486b1aa80b8198a9d060cf4b5d",
    ),
    "LGPL-2.1": (
        "f998bc436710cfece156aaa84fd26dd4",
        "3054b3781b1af43f906dc753acad15ee",
        "9c45cf1b455f75a34b2035910ad1dc79",
        "831e292c78b816e1a9fdba07c006b1b4",
    ),
    "LGPL-3.0": (
        "b31b7335bc37919e8cdd79154e04d88d",
        "1b8dd7a9c66d7a25c54515f3aa622e66",
    ),
    "MPL-1.1": (
        "a708f02208e9c42d3644490185833425",
        "fcbba8d400e8d696995d440fc8bfd8c9",
    ),
    "MPL-2.0": (
        "35fb4d2625087f7fd780039aa7b4ebb2",
        "ed7a5832ec2a13d7b56623858b7734f2",
    ),
}
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
}

#: Ids whose "SPDX-License-Identifier:" line is a notice; the GNU ones with -only and -or-later as well.
SPDX = (
    "MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Apache-2.0", "MPL-1.1", "MPL-2.0", "CC0-1.0",
    "CC-BY-4.0", "CC-BY-NC-4.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0",
)
for _id in SPDX:
    _ends = ("", "-only", "-or-later") if "GPL" in _id else ("",)
    _lines = tuple(f"SPDX-License-Identifier: {_id}{end}" for end in _ends)
    NOTICES[_id] = tuple(dict.fromkeys((*NOTICES.get(_id, ()), *_lines)))

# Spellings that count as the same word.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "authorisation": "authorization",
    "authorised": "authorized",
    "favour": "favor",
    "fulfil": "fulfill",
    "judgement": "judgment",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "noncommercial": "non commercial",
    "organisation": "organization",
    "recognise": "recognize",
    "sublicence": "sublicense",
    "whilst": "while",
    "https": "http",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only says whose the text is, after any comment marks.
OWNER_LINE = r"^[ \t\r#*/;-]*((copyright[ \t]*(\(c\)|©|:|[0-9]|by )|\(c\)[ \t]|©|all rights reserved).*)$"
#: What stands between words: all but letters and digits.
BETWEEN = r"[^\p{L}\p{N}]+"


def canonical_line(line: Column) -> Column:
    """A line in lower case without punctuation, usual spelling; empty for an owner line."""
    line = F.translate(line, UPPER, LOWER)
    line = F.trim(F.regexp_replace(F.regexp_replace(line, OWNER_LINE, ""), BETWEEN, " "))
    words = F.split(line, " ")
    usual = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(usual[w], w)), " ")


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text that have a word, in order."""
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda line: line != "")


def text_forms(license_id: str, text: str) -> list[str]:
    """A text with each of its titles and without; numbered conditions also with bullets."""
    titles = TITLES.get(license_id, ())
    first, _, rest = text.partition("\n")
    body = rest if first in titles else text
    bodies = [body, re.sub(r"(?m)^[0-9]\. ", "* ", body)] if license_id.startswith("BSD") else [body]
    forms = [f"{title}\n{b}" for b in bodies for title in ("", *titles)]
    return forms if titles else [text]


def known_digests(
    spark: SparkSession,
    licenses: dict[str, str],
    notices: dict[str, tuple[str, ...]],
    digests: dict[str, tuple[str, ...]] = DIGESTS,
) -> DataFrame:
    """``license_id, form, digest`` of each known text, form "text" or "notice"."""
    rows = [(k, "text", t, None) for k, text in licenses.items() for t in text_forms(k, text)]
    rows += [(k, "notice", t, None) for k, many in notices.items() for t in many]
    rows += [(k, "text", None, d) for k, many in digests.items() for d in many]
    fields = ("license_id", "form", "text", "known")
    structs = [
        F.struct(*[F.lit(x).cast("string").alias(f) for x, f in zip(row, fields, strict=True)]) for row in rows
    ]
    table = spark.range(1).select(F.inline(F.array(*structs)))
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    return table.select("license_id", "form", F.coalesce("known", F.md5(whole)).alias("digest"))


def scan_licenses(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    licenses: dict[str, str] = LICENSES,
    notices: dict[str, tuple[str, ...]] = NOTICES,
    digests: dict[str, tuple[str, ...]] = DIGESTS,
) -> DataFrame:
    """Known licences that each document is, or names in a line of its own.

    A text's canonical form has its lines without those that only name an owner, in lower
    case (A-Z), punctuation and white space as single spaces, and usual spellings.  The
    digest of the whole text is joined to the known digests; so is that of every line, as
    a notice is mostly one line of a longer text.  The known digests are a table as long
    as the three dictionaries and are broadcast.

    Returns a row for each row of ``docs``: ``doc_id``, ``license_id`` (the licence or notice
    that the whole text is, else null), ``notices`` (ids named by lines, distinct, sorted,
    joined by commas, else empty) and ``n_notices`` (lines that name one).  A null or empty
    text matches nothing, nor does a row without an id.  Rows that share an id share what
    their texts say.  Other columns don't matter; an empty table gives no row.

    Lines are compared before anything is shuffled: only matches are grouped by document.
    """
    known = known_digests(docs.sparkSession, licenses, notices, digests)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    lines = rows.where("doc_id is not null").select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    whole = F.struct(F.lit(True).alias("whole"), F.array_join("lines", " ").alias("line"))
    each = F.transform("lines", lambda line: F.struct(F.lit(False).alias("whole"), line.alias("line")))
    units = lines.select("doc_id", F.explode(F.concat(F.array(whole), each)).alias("unit"))
    units = units.select("doc_id", "unit.whole", F.md5("unit.line").alias("digest"))
    found = units.join(F.broadcast(known), "digest").where("whole or form = 'notice'")
    found = found.groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notices"),
        F.count_if(~F.col("whole")).alias("n_notices"),
    )
    return rows.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", "license_id", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
    )
