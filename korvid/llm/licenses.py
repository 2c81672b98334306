"""License scans by canonical digest. DataFrame operations only.

A text's canonical form is its words: lower case, without copyright lines and punctuation, with
equivalent spellings made one. Texts, and each of their lines, are looked up whole by the SHA-256
of that form in a table of known licences and notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import numbered_columns, place_of

#: Known digests that may be broadcast; a longer list is joined by a shuffle.
BROADCAST_KNOWN = 100_000

#: Pairs of equivalent words, the second being canonical.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("licencing", "licensing"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("organisation", "organization"),
    ("recognised", "recognized"),
    ("modernised", "modernized"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("merchantibility", "merchantability"),
    ("https", "http"),
)

#: A line that only names a holder or reserves rights.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(copyright[^\p{L}\p{N}\n]*((\(c\)|©)|[0-9]{4})|\(c\)[^\p{L}\p{N}\n]*[0-9]{4}|©|all rights reserved)[^\n]*$"
NOT_A_WORD = r"[^\p{L}\p{N}]+"

WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate "
    "any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at "
    "large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
    "perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
#: Licence texts and notices that stand as a whole text or as a line of their own.
TEXTS = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY,
    ),
    ("ISC", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + ISC_WARRANTY),
    ("0BSD", ISC_GRANT + ". " + ISC_WARRANTY),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    ("BSD-2-Clause", BSD_CONDITIONS + BSD_WARRANTY),
    ("BSD-3-Clause", BSD_CONDITIONS + BSD_ENDORSEMENT + BSD_WARRANTY),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE + " For more information, please refer to <https://unlicense.org>"),
    ("Unlicense", UNLICENSE + " For more information, please refer to <https://unlicense.org/>"),
)
#: Title lines that files of these licences begin with.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "Zlib": ("zlib License", "The zlib License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "Unlicense": ("The Unlicense",),
}
#: Notices of one line.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
KNOWN = (*TEXTS, *((name, f"{title}\n{text}") for name, text in TEXTS for title in TITLES[name]), *NOTICES)


def canonical(text: Column) -> Column:
    """The words of the text, two blanks between them and one at either end, so that each word has its own."""
    words = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " "), NOT_A_WORD, "  ")
    words = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    for other, word in SPELLINGS:
        words = F.replace(words, F.lit(f" {other} "), F.lit(f" {word} "))
    return words


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(docs: DataFrame, known=KNOWN) -> DataFrame:
    rows = docs.sparkSession.createDataFrame(list(known), "license string, text string").where(canonical(F.col("text")) != "  ")
    return rows.groupBy(digest(F.col("text")).alias("known")).agg(F.min("license").alias("license"))


def _telling(docs: DataFrame, known) -> Column:
    """A condition on a text `line` that holds if it is any of the known ones: it has the longest word of one of them."""
    rows = docs.sparkSession.createDataFrame(list(known), "license string, text string")
    words = F.split(F.trim(canonical(F.col("text"))), "  ")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    found = {r[0] for r in rows.select(longest).distinct().collect() if r[0]}
    found |= {other for other, word in SPELLINGS if word in found}
    return F.lower("line").rlike("|".join(sorted(found)) if found else "(?!)")


def scan(docs: DataFrame, known=KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license, notices) for every row of docs.

    digest is that of the whole text, license the known licence it is (null if none), notices
    the sorted licences that lines of it name, '' if none; both are those of the row's own text,
    whatever its id, null and repeated ids included. If known lists a text twice, the first
    licence by name counts; known texts without a word match nothing. A null text counts as empty;
    texts without a word have the digest of none and match nothing. An empty table gives none;
    other columns are not read.
    """
    own = numbered_columns(docs)
    text = F.col(f"c{place_of(docs, text_col)}")
    rows = own.select(F.col(f"c{place_of(docs, id_col)}").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    table = known_digests(docs, known)
    telling = F.lit(True)
    if len(known) <= BROADCAST_KNOWN:
        table, telling = F.broadcast(table), _telling(docs, known)
    whole = rows.select("doc_id", "hash", digest(F.col("text")).alias("digest"))
    whole = whole.join(table, F.col("digest") == F.col("known"), "left").select("doc_id", "hash", "digest", "license")
    lines = rows.select("doc_id", "hash", F.explode(F.split("text", "\n", -1)).alias("line")).where(telling)
    named = lines.select("doc_id", "hash", digest(F.col("line")).alias("digest")).join(table, F.col("digest") == F.col("known"))
    # Rows of one id and one text have the same notices.
    named = named.groupBy(F.col("doc_id").alias("id"), F.col("hash").alias("own")).agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("own"))
    return whole.join(named, same, "left").select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def oracle() -> str:
    """SQL for scan() on documents."""

    def form(x: str) -> str:
        copyright_line = COPYRIGHT_LINE.replace("'", "''")
        words = f"concat(' ', trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{copyright_line}', ' ', 'g'), '{NOT_A_WORD}', '  ', 'g')), ' ')"
        for other, word in SPELLINGS:
            words = f"replace({words}, ' {other} ', ' {word} ')"
        return f"sha256({words})"

    values = ", ".join("('%s', '%s')" % (a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH known AS (
  SELECT {form('text')} AS digest, min(license) AS license FROM (VALUES {values}) AS k(license, text) GROUP BY 1
), rows AS (
  SELECT row_number() OVER () AS n, doc_id, text FROM documents
), whole AS (
  SELECT n, doc_id, {form('text')} AS digest FROM rows
), named AS (
  SELECT n, string_agg(license, ',' ORDER BY license) AS notices
  FROM (SELECT DISTINCT n, license
        FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM rows) l
        JOIN known ON {form('line')} = known.digest)
  GROUP BY n
)
SELECT whole.doc_id, whole.digest, known.license, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON whole.digest = known.digest LEFT JOIN named ON whole.n = named.n
"""
