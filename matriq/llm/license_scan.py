"""License scans by canonical digest: normalise a whole text, then hash-join with the digests of known licences.

DataFrame functions only.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq.llm.common import ATTACH_ROWS, ascii_lower, attach, materialize, read, small

# The published wording of licences and of the notices that name one.
_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_NO_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
KNOWN = [
    ("MIT", "MIT License\n" + _GRANT_MIT),
    ("MIT", _GRANT_MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "ISC License\n" + _GRANT_ISC + " " + _NO_WARRANTY_ISC),
    ("ISC", _GRANT_ISC + " " + _NO_WARRANTY_ISC),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: {0} Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. {1} Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. {3}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {4} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_THIRD = (
    "{2} Neither the name of the {5} nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. "
)
#: Usual headings of the short licences; the long ones have theirs in the text.
HEADINGS = {
    "MIT": ["", "MIT", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT License (Expat)", "Expat License"],
    "ISC": ["", "ISC", "ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)"],
    "BSD-2-Clause": ["", "BSD-2-Clause", "BSD License", "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["", "BSD-3-Clause", "BSD License", "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"],
}
_FSF = r"51 Franklin Street, Fifth Floor, Boston, MA\s+02110-1301\s+USA"
_FSF_BEFORE = "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"


@cache
def whole_licenses() -> list[tuple[str, str]]:
    """(license, text) of whole licences: the short ones under each usual heading, the long ones with and without the part after their terms.

    Each long text stands as its publisher wraps it and in one line after its copyright line: lines that begin with "copyright" are not in the canonical form.
    """
    short = [("MIT", _GRANT_MIT)]
    short += [("ISC", g + " " + _NO_WARRANTY_ISC) for g in (_GRANT_ISC, _GRANT_ISC.replace("and/or", "and"))]
    for marks in (("1.", "2.", "3."), ("*", "*", "*")):
        for who in ("HOLDER", "HOLDERS", "OWNER"):
            short.append(("BSD-2-Clause", _BSD.format(*marks, "", who)))
            short += [("BSD-3-Clause", _BSD.format(*marks, _BSD_THIRD.format(*marks, "", "", name), who)) for name in ("copyright holder", "copyright holders", "copyright owner", "author")]
    out = [(name, f"{heading}\n{rights}\n{text}") for name, text in short for heading in HEADINGS[name] for rights in ("", "All rights reserved.")]
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text()
        end = re.search(r"(?m)^ *END OF TERMS AND CONDITIONS$", text)
        for t in [text, *([text[: end.end()], text[: end.start()]] if end else [])]:
            for u in dict.fromkeys((t, re.sub(_FSF, _FSF_BEFORE, t))):
                owner = re.search(r"(?im)^ *copyright \(c\).*\n", u[:500])
                first = owner.end() if owner else 0
                out += [(path.stem, u), (path.stem, u[:first] + " ".join(u[first:].split()))]
    return out


#: Spellings that count as the same word; a string that texts with any of them have, a pattern and what replaces it, in turn.
SPELLINGS = [
    ("licen", r"\blicen[cs](e|es|ed|ing|ee|or)\b", r"licens$1"),
    ("licen", r"\bsub-?licen[cs](e|es|ed|ing)\b", r"sublicens$1"),
    ("infringement", r"\bnon-?infringement\b", "noninfringement"),
    ("v", r"\bver(?:sion|\.)? ?(?=[0-9])|\bv\.? ?(?=[0-9])", "version "),
    ("organis", r"\borganis(e|es|ed|ing|ation|ations)\b", r"organiz$1"),
    ("merchantibility", r"\bmerchantibility\b", "merchantability"),
    ("http", r"\bhttps?://", ""),
]
COPYRIGHT_LINE = r"(?m)^[^\na-z0-9]*(?:copyright\b|\(c\)|©)[^\n]*(?:\n|$)"
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Every text of KNOWN has one of these stems; the SQL, which knows KNOWN alone, reads no other lines.
STEMS = r"(?i)licen[cs]e|permission"


def canonical_lines(df: DataFrame, text_col: str) -> DataFrame:
    """df with _lines, the text's lines in lower case, no copyright lines, one spelling, runs of spaces and punctuation as one space; no empty ones.

    A column each step, so that none is worked out twice, and a pattern is only tried on texts that have what it needs.
    """
    t = F.col("_line_text")
    out = df.withColumn("_line_text", ascii_lower(F.coalesce(F.col(text_col), F.lit(""))))
    marked = t.contains("copyright") | t.contains("(c)") | t.contains("©")
    out = out.withColumn("_line_text", F.when(marked, F.regexp_replace(t, COPYRIGHT_LINE, "")).otherwise(t))
    for has, pattern, to in SPELLINGS:
        out = out.withColumn("_line_text", F.when(t.contains(has), F.regexp_replace(t, pattern, to)).otherwise(t))
    out = out.withColumn("_line_text", F.regexp_replace(t, PUNCTUATION.replace("[^", r"[^\n"), " "))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return out.withColumn("_lines", lines).drop("_line_text")


def canonical(lines: Column) -> Column:
    """The canonical form of the whole text: its canonical lines as one."""
    return F.array_join(lines, " ")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the known texts (KNOWN and the whole licences if not given), one row a digest; the first name wins."""
    rows = [(i, name, text) for i, (name, text) in enumerate([*KNOWN, *whole_licenses()] if known is None else known)]
    df = spark.createDataFrame(rows, "i int, license string, text string")
    df = canonical_lines(df, "text").select("i", "license", F.unhex(F.sha2(canonical(F.col("_lines")), 256)).alias("digest"))
    return df.groupBy("digest").agg(F.min_by("license", "i").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, license (of the whole text, or null), n_license_lines, line_licenses (sorted names), digest.

    The whole canonical text is looked up by its SHA-256 among known (digest, license), and so is each
    line of it that is not empty. Null counts as empty; what is empty once canonical matches nothing
    unless known holds the digest of "". Repeated rows each keep their row; those that repeat an id
    pool their lines. No documents: no rows. Extra columns are ignored.
    """
    rows = canonical_lines(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_t")
    every = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), canonical(F.col("_lines")).alias("s"))),
        F.transform("_lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("s"))),
    )
    each = rows.select("_id", F.explode_outer(every).alias("_e")).select("_id", F.col("_e.whole").alias("_whole"), F.unhex(F.sha2(F.col("_e.s"), 256)).alias("_digest"))
    names = materialize(known.select(F.col("digest").alias("_digest"), F.col("license").alias("_license")))
    each = each if small(names, ATTACH_ROWS) else materialize(each)
    met = materialize(attach(each, names, "_digest", ["_license"], "_id").where("_whole OR _license IS NOT NULL"))
    found = met.where("NOT _whole").groupBy(F.col("_id").alias("_of")).agg(F.count("*").alias("_n"), F.array_sort(F.collect_set("_license")).alias("_names"))
    out = met.where("_whole")
    out = out.join(found, out["_id"].eqNullSafe(found["_of"]), "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_license").alias("license"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("n_license_lines"),
        F.coalesce("_names", F.array().cast("array<string>")).alias("line_licenses"),
        F.col("_digest").alias("digest"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(read(spark, sf_dir, "documents"), known_digests(spark))
    return out.select("doc_id", "license", "n_license_lines", F.array_join("line_licenses", ",").alias("line_licenses"), F.lower(F.hex("digest")).alias("canonical_sha256"))


def _sql_canonical(text: str) -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    t = f"regexp_replace(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {quoted(COPYRIGHT_LINE)}, '', 'g')"
    for _, pattern, to in SPELLINGS:
        pattern = pattern.replace("(?=[0-9])", "([0-9])")
        to = "version \\1\\2" if "version" in to else to.replace("$1", "\\1")
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return f"trim(regexp_replace({t}, {quoted(PUNCTUATION)}, ' ', 'g'))"


_VALUES = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(KNOWN))
SQL = f"""
WITH known(i, license, text) AS (VALUES {_VALUES}),
k AS (SELECT sha256({_sql_canonical('text')}) AS digest, arg_min(license, i) AS license FROM known GROUP BY 1),
w AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE regexp_matches(text, '{STEMS}')),
f AS (SELECT doc_id, count(*) AS n, list_sort(list(DISTINCT license)) AS names
      FROM (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM l WHERE regexp_matches(line, '{STEMS}')) JOIN k USING (digest) GROUP BY doc_id)
SELECT w.doc_id, k.license, coalesce(f.n, 0)::BIGINT AS n_license_lines, coalesce(array_to_string(f.names, ','), '') AS line_licenses, w.digest AS canonical_sha256
FROM w LEFT JOIN k USING (digest) LEFT JOIN f USING (doc_id)
"""
