"""Licence scans: canonical digests of whole texts, joined to those of known licences and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Standard licence texts and notices, without their copyright lines.
_AS_IS = "THE SOFTWARE IS PROVIDED “AS IS” AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS “AS IS” AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED “AS IS”, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}{_BSD_THIRD}{_BSD_TAIL}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
# Canonical digests and lengths of the full texts of standard licences, made by ``digest_rows``; to be made anew when ``canonical`` changes.
DIGESTS = (
    ("Apache-2.0", "ac805199b183a7f863c92a8097596e7efb74dafdde4b0fd9ac80a098b0626299", 9801),
    ("Artistic-1.0-Perl", "0ecc5f2bb1619d7f534b973d4f7e7e273fd28db4a64d1a15500263f487ef1e05", 5791),
    ("CC0-1.0", "adf75bc38a3fbbdcbadda90b262623acbb176db40d4de0538e4bddaa4c7f8d2a", 6683),
    ("GFDL-1.2", "6b425c0a67e6b748551b88317924ea086929a4b21a9b0791f8352babd645e0c4", 19561),
    ("GFDL-1.3", "0c685cf165fa86b4c5015825605f7d19acc3e75a02447922f5168df8a410f422", 21992),
    ("GPL-1.0", "8006d6938e45108c7c95d49b6d84aa0a345eedc8566395dd2bc121b8e6ba4ae9", 11740),
    ("GPL-2.0", "5ca608bb2eb79eb10b1a80b55bb0a99df497ce228143b9d233b5df274e85643a", 17086),
    ("GPL-3.0", "cabccb86e314285bd22384eff6a86b75c37bea20224092b87b3ae4e63a2c437d", 33361),
    ("LGPL-2.0", "ec44c766883b869bef6a328cf51aafbe256ee10744ba67af3472eda9d0446def", 24089),
    ("LGPL-2.1", "5ef8b7ba71d31fa31954beed6b9d500255758be9aaae1903502fe0f4c080e8d9", 25176),
    ("LGPL-3.0", "828c3944cde1fc14c68737c9be14d8d0f4f13ab980f8a72364a0e64f72965525", 7086),
    ("MPL-1.1", "509a1897231e372560289dcfd5bd17feeb10e60a812325f2987e72e90d5fba2b", 22286),
    ("MPL-2.0", "fc6db10715dd3f8d6886221817f28e3572f579a7a350ecd43e7cdc6607bf6ba7", 14234),
)
#: Equivalent spellings, as words.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("judgement", "judgment"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"))
# Patterns of what is dropped, for texts in lower case: lines of copyright (behind comment marks too), a title line above an empty line, and list markers.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:[#*/;!>-]+[ \t]*)*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|[<\[{])|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
TITLE = r"^\s*(?:the[ \t]+)?[a-z0-9 .,\"'()/-]{0,60}licen[cs]e[a-z0-9 .,\"'()/-]{0,30}\r?\n[ \t]*\r?\n"
MARKER = r"(?m)^[ \t]*(?:[0-9]{1,2}[.)]|\([0-9a-z]\)|[*•-])[ \t]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of known texts that may be broadcast as digests.
MAX_KNOWN = 100_000
#: A part of some word of every known text; units without any are not made canonical.
HINTS = ("licen", "permi", "released", "redistribution")


def canonical(text: Column) -> Column:
    """A-Z lower-cased; copyright and title lines and list markers dropped; all but letters a-z and digits to single blanks; spellings unified."""
    out = F.translate(text, UPPER, LOWER)
    marked = F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("(c)")) | F.contains(out, F.lit("©")) | F.contains(out, F.lit("all rights reserved"))
    out = F.when(marked, F.regexp_replace(out, COPYRIGHT_LINE, "")).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(out, TITLE, ""), MARKER, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, "[^a-z0-9]+", " ")), F.lit(" "))
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(out)


def digest_rows(spark: SparkSession, known) -> DataFrame:
    """(license, digest, size) of (license, text) pairs: how ``DIGESTS`` was made from the texts that their publishers give."""
    listed = spark.createDataFrame([tuple(x) for x in known], "license string, text string").withColumn("canonical", canonical(F.col("text")))
    return listed.groupBy(F.sha2("canonical", 256).alias("digest"), F.length("canonical").alias("size")).agg(F.min("license").alias("license")).select("license", "digest", "size")


def known_digests(spark: SparkSession, known=KNOWN, digests=()) -> DataFrame:
    """(license, digest, size): one row for each different canonical text, given as a text or as its digest."""
    if len(known) + len(digests) > MAX_KNOWN:
        raise ValueError("too many known texts to broadcast")
    if bare := [name for name, text in known if not any(h in text.lower() for h in HINTS)]:
        raise ValueError(f"no hint in the texts of {bare}")
    ready = spark.createDataFrame([tuple(x) for x in digests], "license string, digest string, size int")
    return digest_rows(spark, known).unionAll(ready).dropDuplicates(["digest"])


def scan(docs: DataFrame, known=KNOWN, digests=DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, license, digest): every whole text that is a known licence or notice, of ``known`` texts or of ``digests`` of such.

    A document is looked up as a whole (unit 0) and each of its lines by itself (unit = the line's number, from 1), so a notice
    within other text is found as well. Only units as long, in canonical form, as some known text are digested. The
    digests of known texts, whose number is checked, are broadcast: the scan has no shuffle.

    Case, punctuation, copyright and title lines, list markers and the ``SPELLINGS`` do not matter. A document of one line is only unit 0; a
    licence of several lines inside a longer document is not looked for. Null and empty texts match nothing. Texts of any length are handled
    whole. Repeated rows are returned each; ids may be null. Other columns, whatever their names, are ignored. No rows: no rows.
    """
    digests = known_digests(docs.sparkSession, known, digests)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where(text.isNotNull())
    lines = F.split("text", "\n", -1)
    units = rows.select("doc_id", F.posexplode(F.concat(F.array("text"), F.when(F.contains("text", F.lit("\n")), lines).otherwise(F.array().cast("array<string>")))).alias("unit", "part"))
    lower = F.translate(F.col("part"), UPPER, LOWER)
    likely = F.lit(False)
    for hint in HINTS:
        likely = likely | F.contains(lower, F.lit(hint))
    found = units.where(likely).select("doc_id", F.col("unit").cast("long").alias("unit"), canonical(F.col("part")).alias("canonical"))
    found = found.withColumn("size", F.length("canonical")).withColumn("digest", F.sha2("canonical", 256))
    return found.join(F.broadcast(digests), ["digest", "size"]).select("doc_id", "unit", "license", "digest")
