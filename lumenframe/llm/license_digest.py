"""Licence scan by canonical digest: whole texts are normalised and hash-joined to the digests of known licences.

Normalising: lower case; lines that only state a copyright, date or placeholder go; equivalent spellings become one; anything but letters, digits and
line structure becomes a single space. A text whose digest is known is that licence.

Defined cases: null, empty or blank texts have a null digest and no licence; ties can't occur, for each digest has one licence; repeated rows each get their own
result. The known digests are a table of the licences given, some 30 rows (the README lists them), and so are broadcast.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

#: Equivalent spellings, the second is the canonical one.
SPELLINGS = (
    ("acknowledgment", "acknowledgement"),
    ("analog", "analogue"),
    ("artifact", "artefact"),
    ("authorization", "authorisation"),
    ("authorized", "authorised"),
    ("center", "centre"),
    ("favor", "favour"),
    ("fulfillment", "fulfilment"),
    ("license", "licence"),
    ("licensed", "licenced"),
    ("licenses", "licences"),
    ("modernize", "modernise"),
    ("non-commercial", "noncommercial"),
    ("organization", "organisation"),
    ("per cent", "percent"),
    ("recognize", "recognise"),
    ("sub-licence", "sublicence"),
    ("sublicense", "sublicence"),
    ("utilize", "utilise"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

#: Notices and texts of public licences, by a short name.
LICENSES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
}

#: Title lines under which the texts above are also found.
TITLES = {"mit": ("MIT License", "The MIT License", "The MIT License (MIT)"), "isc": ("ISC License", "The ISC License"), "0bsd": ("BSD Zero Clause License", "Zero-Clause BSD"), "zlib": ("zlib License", "The zlib License"), "unlicense": ("The Unlicense",)}
#: Canonical digests of whole texts, with their title lines, as Debian ships them in /usr/share/common-licenses.
DIGESTS = {
    "apache-2.0": "a25108bb2a7592eb614f54132dc9be69971c066b3dd2f4b95667a32b7ac6023a",
    "artistic-1.0-perl": "fbc334165194bdb8cae46748e156fb862b599ccd7e42ed7fcaf26f2ee748f6d4",
    "cc0-1.0": "400db3ed80e146737970d3ff856f201f0206119c2851164504a236a6893f845a",
    "gfdl-1.2": "ec41757a603550a39b6a0b221eb419e045761356ace6399fe33c5004b3dd2f75",
    "gfdl-1.3": "41e106d5833c8c0bfe43ee86605cc5676050dee29a56f06232ded63b727ccfa0",
    "gpl-1.0": "3008aba6a825fea7063f6ec6d7d37d1712edfe54cd951eac67d70a8dd7acb5e8",
    "gpl-2.0": "957b110b50ace3ac63aabb7ba5b42c3b0eed42a0b490d375fad9c16e0ae78380",
    "gpl-3.0": "27ae8f7bea7f1e9c70cdd8514363667331ffed8c83a6f1a44d89226d9956e0f6",
    "lgpl-2.0": "396f24f7a4206c92995544d0fa61f3d81286253b26caded52aeba4d355b3a416",
    "lgpl-2.1": "2e86d487cab5a3fe7ae507ac02a75ae8683fd9f1123054ec1391e6107e31a0d1",
    "lgpl-3.0": "7d6e51c6bb80fc7a025c16e64157adf9c280c58dee4c4b2bf73e596166a2a08f",
    "mpl-1.1": "8cc6d1beb23fe20fdf2b3de8bbacaa59f05b06fcbcfa10af4c6c81d94392d322",
    "mpl-2.0": "ca224562002813cbe8f65139977ba57727787b33c498229d87d3ae11c4b05197",
}

COPYRIGHT_LINE = r"(?m)^[\x20\x09-\x0D]*(?:copyright|\(c\)|©)[^\n]*$"
OWN = ["canonical_digest", "license_id"]


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}-]+", " ")
    spelled = out
    for a, b in SPELLINGS:
        if a != b:
            spelled = F.regexp_replace(spelled, rf"\b{a}\b", b)
    # one look for any of the spellings spares most texts the replacements
    out = F.when(out.rlike(rf"\b(?:{'|'.join(a for a, b in SPELLINGS if a != b)})\b"), spelled).otherwise(out)
    return F.trim(F.regexp_replace(out, r"[-\x20]+", " "))


def known(spark: SparkSession, licenses: dict[str, str] = LICENSES) -> DataFrame:
    bodies = [(k, v) for k, v in licenses.items()] + [(k, f"{x}\n\n{v}") for k, v in licenses.items() if v == LICENSES.get(k) for x in TITLES.get(k, ())]
    rows = spark.createDataFrame(bodies, "license_id string, body string").select("license_id", F.sha2(canonical(F.col("body")), 256).alias("__digest"))
    if licenses is not LICENSES:
        return rows
    return rows.union(spark.createDataFrame(list(DIGESTS.items()), rows.schema))


def license_scan(df: DataFrame, text: str = "text", licenses: dict[str, str] = LICENSES) -> DataFrame:
    """df with canonical_digest and license_id of whole texts; null where the text is no known licence."""
    own = without(df, OWN)
    norm = df.select(canonical(F.col(f"`{text}`")).alias("__norm"), F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("__row"))
    hashed = norm.select("__row", F.when(F.length("__norm") > 0, F.sha2("__norm", 256)).alias("canonical_digest"))
    return hashed.join(F.broadcast(known(df.sparkSession, licenses)), F.col("canonical_digest") == F.col("__digest"), "left").select("__row.*", "canonical_digest", "license_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    whole = license_scan(docs.select("doc_id", "text")).drop("text")
    # a licence statement inside a document is a text of its own: its line
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.lower("line").rlike("licen[cs]e|copyright|permission|public domain|warranty"))
    stated = license_scan(lines, text="line").filter("license_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set("license_id")).alias("ids"))
    stated = stated.select("doc_id", F.array_join("ids", ",").alias("line_licenses"))
    return whole.join(stated, "doc_id", "left").select("doc_id", "canonical_digest", "license_id", "line_licenses")


def _sql_canonical(x: str) -> str:
    out = rf"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', '', 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}-]+', ' ', 'g')"
    for a, b in SPELLINGS:
        if a != b:
            out = rf"regexp_replace({out}, '\b{a}\b', '{b}', 'g')"
    return rf"trim(regexp_replace({out}, '[-\x20]+', ' ', 'g'), ' ')"


SQL = rf"""
WITH k AS (SELECT license_id, sha256({_sql_canonical("body")}) AS digest FROM (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in LICENSES.items())}) AS v(license_id, body)),
w AS (SELECT doc_id, {_sql_canonical("text")} AS n FROM documents),
h AS (SELECT doc_id, CASE WHEN length(n) > 0 THEN sha256(n) END AS canonical_digest FROM w),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(lower(line), 'licen[cs]e|copyright|permission|public domain|warranty')),
s AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses FROM l JOIN k ON sha256({_sql_canonical("line")}) = k.digest GROUP BY doc_id)
SELECT h.doc_id, canonical_digest, license_id, line_licenses FROM h LEFT JOIN k ON canonical_digest = digest LEFT JOIN s ON s.doc_id = h.doc_id
"""
