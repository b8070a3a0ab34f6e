"""Licence scans: canonical digests of entire texts, hash-joined to known ones.

``canonical`` brings a text to lower case, drops its copyright lines and a title line, writes equivalent spellings
one way and turns everything but letters and digits into single spaces. Two texts with one digest
are the same licence. ``scan`` looks up every whole document, and every entire line that speaks of
a licence, among known notices. DataFrame functions only.

Defined cases: a null text is an empty text, whose digest is no licence; repeated rows each get
their row; a document may hold several notices (sorted, distinct, joined by commas); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import cut

# Pattern and replacement, applied in this order to the lower-cased text.
# All are understood alike by Java and RE2.
# Line ends stand twice in it, so that a rule can take the one before and the one behind its line.
# The first three drop copyright notices: a line with a year, a line that starts like a notice, and of a
# line that runs on only the notice itself, up to its full stop.
REWRITES = (
    (r"(^|\n)[^\n]{0,100}(copyright|\(c\)|©)[^\n]{0,60}[0-9]{4}[^\n]{0,120}(\n|$)", "\n"),
    (r"(^|\n)[^\n\p{L}\p{N}]{0,20}copyright[ \t]*(\(c\)|©)[^\n]{0,120}(\n|$)", "\n"),
    (r"(copyright|\(c\)|©)[^\n.]{0,60}[0-9]{4}[^\n.]{0,100}\.", " "),
    (r"(^|\n)[^\n\p{L}\p{N}]*all rights reserved[^\n\p{L}\p{N}]*(\n|$)", "\n"),
    (r"^\s*[^\n]{0,50}licen[sc]e[^\n]{0,20}\n", "\n"),
    (r"[^\p{L}\p{N}]+", " "),
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon (commercial|infringement|exclusive)", "non$1"),
    (r"\bcopy right", "copyright"),
    (r"\b(favour|behaviour|honour|colour)", "$1"),
    (r"\bauthors or copyright holders\b", "copyright holders"),
    (r"\bhttps\b", "http"),
)

# The rules before this one drop lines.
LINE_RULES = 5

# Known licence texts, without their copyright lines.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution.""",
}

# The three-clause text has one clause more.
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace(
    "THIS SOFTWARE IS PROVIDED",
    """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED""",
    1,
)

# Sha-256 of the canonical form of longer texts, as their publishers set them.
DIGESTS = {
    "Apache-2.0": "b07988e5bc6ec9ad4dcd4a9bb1965b6c282f4dee11ef190b6296d973c5eac787",
    "Artistic-1.0": "4eaaa9e33aeef0af0ff83ab5edac0ad421a1da9cc861c564630460107b4b772c",
    "BSD-3-Clause": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "ee4f004efcecdf9d9069648b3868636b6aed9a7d8fa7a8319d5d5b4ac94ae44d",
    "GFDL-1.2": "b8fc1476fcb02a8c859046708b4843944af8ef9ae2f634b9f46b5a633388f9f3",
    "GFDL-1.3": "e907f46bdc7f3e8e6160d770fd1642b01fb33d2f98ef7b09c8988fbe26f79fae",
    "GPL-1.0": "9132a605811c9f9a51621da0e0708f46e408e3507a3c1a9d16a5f48291082b8c",
    "GPL-2.0": "29507662ad31f55a5ac02f26a5d8cca21add440b2dff4a9ce97e458a0ca43f7f",
    "GPL-3.0": "8394e8f7a40729568e1c7744bb8ecb1d4c6369aed25abec058ca5b360e3ac0f4",
    "LGPL-2.0": "f17ebefdba4ae01060494f3396c1bc854578b6eaafaa6fe8abcf7a94e7fc2a6e",
    "LGPL-2.1": "50866b22e296e073a398813dc84c4c9dec94ed1ee7d617c063eb6851a562b9d4",
    "LGPL-3.0": "e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765",
    "MPL-1.1": "230fe947d78b8bad1873e0f0e7c86da0d2b4fbb6c2a1b64292044310b8de3ad2",
    "MPL-2.0": "1624e7d4b3bfc7f29cd0fe25fcccb8c9803fe1bd3a0ab3655dfb199abb585817",
}

# How notices name a licence. A notice is a phrase and a name.
PHRASES = (
    "licensed under",
    "this work is licensed under",
    "this file is licensed under",
    "released under",
    "distributed under",
    "available under",
    "spdx license identifier",
)
NAMES = {
    "MIT": ("mit", "mit license"),
    "Apache-2.0": ("apache 2 0", "apache license 2 0", "apache license version 2 0"),
    "GPL-2.0": ("gpl 2 0", "gnu general public license version 2", "gnu gpl v2"),
    "GPL-3.0": ("gpl 3 0", "gnu general public license version 3", "gnu gpl v3"),
    "LGPL-3.0": ("lgpl 3 0", "gnu lesser general public license version 3"),
    "BSD-2-Clause": ("bsd 2 clause", "bsd 2 clause license"),
    "BSD-3-Clause": ("bsd 3 clause", "bsd 3 clause license"),
    "ISC": ("isc", "isc license"),
    "MPL-2.0": ("mpl 2 0", "mozilla public license version 2 0"),
    "CC0-1.0": ("cc0 1 0", "creative commons zero 1 0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0"),
}
RESERVED = {"all rights reserved": "all-rights-reserved"}
# A line is looked up if it holds one of these.
SIGNS = r"licen[sc]e|released under|distributed under|available under|rights reserved"


def canonical(text: Column) -> Column:
    """The canonical form of a whole text."""
    out = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit("\n\n"))
    for pattern, new in REWRITES:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def plain(text: Column) -> Column:
    """The canonical form of a notice line: as ``canonical``, but no line is dropped."""
    out = F.lower(text)
    for pattern, new in REWRITES[LINE_RULES:]:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def digest(form: Column) -> Column:
    return F.sha2(form, 256)


def known_texts(spark: SparkSession) -> DataFrame:
    """``digest, license`` of the known licence texts."""
    rows = spark.createDataFrame(list(TEXTS.items()), "license string, text string")
    longer = spark.createDataFrame([(d, k) for k, d in DIGESTS.items()], "digest string, license string")
    return rows.select(digest(canonical(F.col("text"))).alias("digest"), "license").unionByName(longer)


def notices() -> list[tuple[str, str]]:
    """Known notices in canonical form and their licence, by rule: phrase, optional article, name."""
    made = {
        f"{phrase} {article}{name}": license_
        for license_, names in NAMES.items()
        for name in names
        for phrase in PHRASES
        for article in ("", "the ")
    }
    return sorted((made | RESERVED).items())


def known_notices(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(notices(), "form string, license string")
    return rows.select(digest(F.col("form")).alias("digest"), "license")


def scan(docs: DataFrame, texts: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, license, notices`` of every row of ``docs``.

    ``texts`` and ``lines`` (``digest, license``) may be any size: Spark broadcasts them only if
    they are small. Lines are joined apart and only where a line shows a sign of a licence; a row
    keeps its place through a number of its own, so repeated ids stay apart.
    """
    spark = docs.sparkSession
    texts = known_texts(spark) if texts is None else texts
    lines = known_notices(spark) if lines is None else lines
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = F.filter(
        F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.lower(line).rlike(SIGNS)
    )
    rows = rows.select(
        "doc_id",
        digest(canonical(F.col("text"))).alias("digest"),
        F.transform(marked, lambda line: digest(plain(line))).alias("lines"),
    )
    # stored once, so that the texts are read and normalised once
    whole = cut(rows).join(texts.select("digest", "license"), "digest", "left")
    other = whole.where(F.size("lines") == 0).select(
        "doc_id", "digest", "license", F.lit("").alias("notices")
    )
    numbered = whole.where(F.size("lines") > 0).withColumn("row", F.monotonically_increasing_id())
    named = (
        numbered.select("doc_id", "digest", "license", "row", F.explode("lines").alias("line"))
        .join(lines.select(F.col("digest").alias("line"), F.col("license").alias("notice")), "line", "left")
        .groupBy("doc_id", "digest", "license", "row")
        .agg(F.array_join(F.sort_array(F.collect_set("notice")), ",").alias("notices"))
    )
    return other.unionByName(named.drop("row"))


def _sql_form(column: str, rewrites: tuple) -> str:
    out = f"lower({column})" if rewrites != REWRITES else f"replace(lower({column}), chr(10), chr(10) || chr(10))"
    for pattern, new in rewrites:
        out = f"regexp_replace({out}, '{pattern}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return f"trim({out})"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in TEXTS.items())}) v(license, text)),
kt AS (SELECT sha256({_sql_form("text", REWRITES)}) AS digest, license FROM t
       UNION ALL SELECT * FROM (VALUES {", ".join(f"('{d}', '{k}')" for k, d in DIGESTS.items())}) v(digest, license)),
kn AS (SELECT * FROM (VALUES {", ".join(f"({_literal(f)}, {_literal(n)})" for f, n in notices())}) v(form, license)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT r, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) x
  JOIN kn ON kn.form = {_sql_form("line", REWRITES[LINE_RULES:])}
  WHERE regexp_matches(lower(line), '{SIGNS}') GROUP BY r),
g AS (SELECT r, doc_id, sha256({_sql_form("text", REWRITES)}) AS digest FROM d)
SELECT doc_id, g.digest, kt.license, coalesce(notices, '') AS notices
FROM g LEFT JOIN kt ON kt.digest = g.digest LEFT JOIN l ON l.r = g.r
"""
