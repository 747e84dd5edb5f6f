"""License scans: canonical digests of whole texts, looked up among digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import documents, text_or_empty
from workload.registry import query

# Licence texts and names as their stewards publish them.
FULL_TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
NAMES = {
    "MIT": ["MIT License"], "ISC": ["ISC License"], "0BSD": ["Zero-Clause BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "CC0-1.0": ["CC0 1.0"], "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC-BY-ND-4.0": ["CC BY-ND 4.0"], "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
}
NOTICES = [
    "{0}", "The {0}", "Licensed under {0}", "Licensed under the {0}", "Released under {0}", "Released under the {0}",
    "This work is licensed under {0}", "This work is licensed under the {0}",
    "This project is licensed under {0}", "This project is licensed under the {0}",
    "Distributed under {0}", "Distributed under the {0}", "SPDX-License-Identifier: {1}",
]
# Spellings that count as the same, after case and punctuation are gone.
SPELLINGS = {
    "licence": "license", "sub license": "sublicense", "non commercial": "noncommercial", "non infringement": "noninfringement",
    "per cent": "percent", "copyright owner": "copyright holder", "merchantibility": "merchantability",
    "acknowledgement": "acknowledgment", "organisation": "organization", "authoris": "authoriz", "recognis": "recogniz",
    "utilis": "utiliz", "whilst": "while", "wilful": "willful", "favour": "favor", "https": "http",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©(]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|\[|<)|\(c\)|©|all rights reserved)[^\n]*$"
NOISE = r"[^\p{L}\p{N}\n]+"


def known_licenses() -> list[tuple[str, str]]:
    """(licence id, text): the full texts and the usual one-line notices, made by rule."""
    lines = [(key, form.format(name, key)) for key, names in NAMES.items() for name in names for form in NOTICES]
    return [*FULL_TEXTS.items(), *dict.fromkeys(lines)]


def canonical_lines(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, equivalent spellings made one; line breaks stay."""
    out = F.translate(text, UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, NOISE, " ")
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def as_one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def license_table(spark: SparkSession) -> DataFrame:
    """Digest and id of each known text; its size is fixed by this module."""
    rows = spark.createDataFrame(known_licenses(), "license string, body string")
    return rows.select(
        F.sha2(as_one_line(canonical_lines(F.col("body"))), 256).alias("digest"), "license",
    ).groupBy("digest").agg(F.min("license").alias("license"))


def license_units(docs: DataFrame) -> DataFrame:
    """The texts looked up: the whole document, its paragraphs (parted by empty lines) and its lines.

    Columns: row_no, doc_id, kind, digest.  A paragraph or line without letters or digits is left out.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"),
        canonical_lines(text_or_empty()).alias("body"),
    )
    whole = F.array(F.struct(F.lit("whole").alias("kind"), F.col("body").alias("unit")))
    paragraphs = F.transform(F.split("body", r"\n *(?:\n *)+"), lambda x: F.struct(F.lit("paragraph").alias("kind"), x.alias("unit")))
    lines = F.transform(F.split("body", "\n"), lambda x: F.struct(F.lit("line").alias("kind"), x.alias("unit")))
    units = rows.select("row_no", "doc_id", F.explode(F.concat(whole, paragraphs, lines)).alias("u"))
    units = units.select("row_no", "doc_id", "u.kind", as_one_line(F.col("u.unit")).alias("unit")).filter("unit != '' or kind = 'whole'")
    return units.select("row_no", "doc_id", "kind", F.sha2("unit", 256).alias("digest"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document and the known licences that it is, or holds as paragraphs or lines of their own.

    Columns: doc_id, whole_license (null if the text as a whole is none), licenses (ids
    found in any unit, sorted, comma-joined; empty if none), n_lines (lines that are a
    known text), canonical_sha256 (of the whole canonical text).  Null counts as empty,
    an empty text has the digest of the empty string and no licence.  Repeated rows and
    ids stay rows of their own; an empty table gives no rows; columns other than
    ``doc_id`` and ``text`` are not read.
    """
    known = F.broadcast(license_table(docs.sparkSession))
    found = license_units(docs).join(known, "digest", "left").groupBy("row_no").agg(
        F.max(F.when(F.col("kind") == "whole", F.col("license"))).alias("whole_license"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.count(F.when(F.col("kind") == "line", F.col("license"))).alias("n_lines"),
        F.max(F.when(F.col("kind") == "whole", F.col("digest"))).alias("canonical_sha256"),
        F.max("doc_id").alias("doc_id"),
    )
    return found.select("doc_id", "whole_license", "licenses", "n_lines", "canonical_sha256")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(column: str) -> str:
    out = f"translate({column}, '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    out = f"regexp_replace({out}, {_quoted(NOISE)}, ' ', 'g')"
    for old, new in SPELLINGS.items():
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _one_line_sql(column: str) -> str:
    return f"trim(regexp_replace({column}, '[ \\n]+', ' ', 'g'))"


OP10_SQL = f"""
WITH known AS (
  SELECT sha256({_one_line_sql(_canonical_sql("body"))}) AS digest, min(license) AS license
  FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in known_licenses())}) v(license, body) GROUP BY 1),
docs AS (SELECT doc_id, row_number() OVER () AS row_no, {_canonical_sql("coalesce(text, '')")} AS body FROM documents),
units AS (
  SELECT row_no, 'whole' AS kind, body AS unit FROM docs
  UNION ALL SELECT row_no, 'paragraph', unnest(regexp_split_to_array(body, '\\n *(?:\\n *)+')) FROM docs
  UNION ALL SELECT row_no, 'line', unnest(string_split(body, chr(10))) FROM docs),
found AS (
  SELECT row_no, kind, license FROM (SELECT row_no, kind, {_one_line_sql("unit")} AS unit FROM units) u
  JOIN known ON sha256(u.unit) = known.digest WHERE u.unit != '')
SELECT d.doc_id, max(f.license) FILTER (f.kind = 'whole') AS whole_license,
       coalesce(string_agg(DISTINCT f.license, ',' ORDER BY f.license), '') AS licenses,
       count(f.license) FILTER (f.kind = 'line') AS n_lines,
       sha256({_one_line_sql("any_value(d.body)")}) AS canonical_sha256
FROM docs d LEFT JOIN found f ON f.row_no = d.row_no GROUP BY d.row_no, d.doc_id
"""


@query("op10_license_scan", OP10_SQL)
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(documents(spark, folder))
