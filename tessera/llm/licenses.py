"""License scans: canonical digests of entire texts, and of their lines, looked up among known licences.

Canonical form of a line: A-Z lowered, the copyright sign and "(c)" read as "copyright", equivalent spellings
made one, and every run of ASCII characters other than a-z and 0-9 made one space. Copyright lines (those that
start with "copyright" or "all rights reserved") and empty lines are left out of an entire text, whose other
lines are joined by a space. A digest is the MD5 of the canonical form.

Everything is built-in functions. Entire texts are hash-joined to the table of known digests, whatever its size, and
Spark broadcasts it if it's small. Digests of lines are intersected with those of the known notices, as constants of
the one pass over the texts, while there are at most `constants` of them; beyond that lines are exploded and joined
with the notices' table. Both ways give the same rows.

Defined results: null and empty texts have the digest of an empty text and no licence; repeated rows are each
scanned; of licences with one digest the first by name holds; known rows with a null text or licence are left out; an
empty table gives no rows; columns besides id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import quoted, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPELLINGS = (("©", " copyright "), ("(c)", " copyright "), ("licence", "license"), ("licencing", "licensing"), ("favour", "favor"), ("sub-license", "sublicense"), ("noninfringement", "non-infringement"))
PUNCTUATION = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"
SKIPPED = ("copyright", "all rights reserved")

# Public licence texts and notices, with their SPDX identifiers.
LICENSES = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
)


def canonical_line(line: Column) -> Column:
    """Lowered, spellings made one, punctuation made single spaces, ends trimmed."""
    out = F.translate(line, UPPER, LOWER)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), canonical_line)


def canonical_text(lines: Column) -> Column:
    """Of a text's canonical lines, those that count, joined by a space."""
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~F.greatest(*[x.startswith(s) for s in SKIPPED])), " ")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None, constants: int = 10_000) -> DataFrame:
    """One row for each document: doc_id, digest, license (of the entire text, or null), notices (the licences
    that a line names, ascending, or null). known: rows (license, text, whole), whole telling texts from notices."""
    spark = docs.sparkSession
    if known is None:
        known = spark.createDataFrame([(i, t, True) for i, t in LICENSES] + [(i, t, False) for i, t in NOTICES], "license string, text string, whole boolean")
    canonical = known.where("license is not null and text is not null").select("license", "whole", F.md5(canonical_text(_lines(F.col("text")))).alias("known_digest"))
    marked = written(canonical.groupBy("whole", "known_digest").agg(F.min("license").alias("license")), "known-licenses")
    whole, notices = marked.where("whole").drop("whole"), marked.where("not whole").drop("whole")
    lines = docs.select(quoted(id_col).cast("long").alias("doc_id"), _lines(quoted(text_col)).alias("lines"))
    digest, digests = F.md5(canonical_text(F.col("lines"))).alias("digest"), F.transform(F.col("lines"), lambda x: F.md5(x))
    named = notices.limit(constants + 1).collect()  # bounded by the parameter
    if len(named) <= constants:
        scanned = lines.select("doc_id", digest, _among(digests, {r["known_digest"]: r["license"] for r in named}).alias("names"))
    else:
        scanned = _joined(lines.select("doc_id", digest, F.array_distinct(digests).alias("digests")), notices)
    found = scanned.withColumn("notices", F.nullif(F.array_join("names", ","), F.lit("")))
    return found.join(whole, found["digest"] == whole["known_digest"], "left").select("doc_id", "digest", "license", "notices")


def _among(digests: Column, names: dict[str, str]) -> Column:
    """The licences of a row's digests, ascending, looked up in a constant map."""
    if not names:
        return F.lit(None).cast("array<string>")
    held = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    met = F.array_intersect(digests, F.array(*[F.lit(d) for d in sorted(names)]))
    return F.array_sort(F.array_distinct(F.transform(met, lambda d: held[d])))


def _joined(rows: DataFrame, notices: DataFrame) -> DataFrame:
    """rows(doc_id, digest, digests) -> doc_id, digest, names, by a join of the exploded digests."""
    table = written(rows.withColumn("row", F.monotonically_increasing_id()), "line-digests")
    met = table.select("row", F.explode("digests").alias("known_digest")).join(notices, "known_digest")
    names = met.groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("names"))
    return table.drop("digests").join(names, "row", "left")
