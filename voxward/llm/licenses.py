"""License scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: lower case, no copyright lines, one
spelling of words that licences spell in several ways, words apart by single
spaces without punctuation. Texts with equal forms have equal digests, so a hash
join with the digests of the known licences finds them. Looked up are the whole
text and each of its lines, as a notice stands on a line of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxward.llm.license_digests import DIGESTS
from voxward.llm.tables import small_side, stored

#: Spellings that count as equal (fixed values, after public matching guidelines).
SPELLINGS = {
    "licence": "license", "sub-license": "sublicense", "sub license": "sublicense", "non-commercial": "noncommercial",
    "acknowledgement": "acknowledgment", "organisation": "organization", "authorisation": "authorization",
    "copyright owner": "copyright holder", "favour": "favor", "fulfil ": "fulfill ", "judgement": "judgment",
    "per cent": "percent", "programme": "program", "utilisation": "utilization", "whilst": "while", "https": "http",
    "merchantibility": "merchantability", r"\bv\. ?(\d)": "version $1",
}
#: What follows the word copyright in terms, unlike the name of a holder: a wrapped line of terms may start with it.
_TERMS = (
    "holders?|owners?|notices?|licen[sc]e|licen[sc]es|licen[sc]ed|licensors?|laws?|acts?|and|or|in|to|of|is|are|as|for|on|under|that|this|which|with|from"
    "|interests?|rights?|statements?|protections?|treaty|treaties|patents?|trademarks?|status|works?|claims?|infringements?|disclaimers?|has|have"
    "|permissions?|information|management|legislation|liability|ownership|date|year|terms?|must|may|shall|will|can|be|not|does|if|but|where|when"
)
#: A line that starts so says whose the copyright is, and nothing of the terms: a sign, a year, a gap to fill in or a holder follows.
#: A bare (c) is a list mark unless a year or the word follows.
COPYRIGHT = (
    r"(?m)^[^\w\n]*(?:©|\(c\)[^\w\n]*(?:copyright\b|©|\d{4}|<year)|copyright[^\w\n]*(?:\(c\)|©|\d{4}\b|[<\[{])"
    rf"|copyright(?:[ \t]*:[ \t]*|[ \t]+)(?!(?:{_TERMS})\b)\w).*$|all\s+rights\s+reserved\.?"
)
#: Every known text must hold one of these words, so that only such lines are brought to canonical form.
HINT = "licen[sc]e|permission|redistribut|public domain"

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
    " permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    " Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT"
    " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
    " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN"
    " THE SOFTWARE."
)
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL"
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
    " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN"
    " AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
    " PERFORMANCE OF THIS SOFTWARE."
)
#: Known texts and notices with their public identifiers (fixed values); pass a table of more as ``known``.
LICENSES = (
    ("MIT", f"MIT License\nCopyright (c) <year> <holders>\n{_GRANT}"),
    ("MIT", _GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", f"ISC License\nCopyright <year> <holder>\n{_USE}, provided that the above copyright notice and this permission notice appear in all copies.\n{_AS_IS}"),
    ("ISC", "Released under the ISC License."),
    ("0BSD", f"{_USE}.\n{_AS_IS}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
    " software without specific prior written permission.",
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT"
    " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT"
    " HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT"
    " LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY"
    " THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF"
    " THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _bsd(n: int, head: str, numbered: bool) -> str:
    clauses = (f"{k}. {clause}" if numbered else f"* {clause}" for k, clause in enumerate(_BSD_CLAUSES[:n], 1))
    return "\n".join([head, "Copyright (c) <year> <holders>", _BSD_HEAD, *clauses, _BSD_END])


#: Whole texts besides LICENSES, with the headings and clause marks they come with (fixed values).
TEXTS = (
    *(("MIT", f"{head}\nCopyright (c) <year> <holders>\n{_GRANT}") for head in ("The MIT License", "The MIT License (MIT)", "MIT License (MIT)")),
    *(
        (f"BSD-{n}-Clause", _bsd(n, head, numbered))
        for n in (2, 3)
        for head in ("", f"BSD {n}-Clause License", f"The {n}-Clause BSD License", "BSD License")
        for numbered in (False, True)
    ),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    form = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, " "), r"\s+", " ")
    for other, one in SPELLINGS.items():
        form = F.regexp_replace(form, other, one)
    return F.trim(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """``license, text`` of LICENSES and TEXTS."""
    return spark.createDataFrame(list(LICENSES + TEXTS), "license string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_notices, licenses, whole_license`` per row of ``docs``.

    ``whole_license`` is the licence that the whole text is, or null;
    ``n_notices`` counts lines that are a known notice or licence; ``licenses`` lists
    all licences found, sorted, apart by commas, empty if none. Null and empty
    texts have none. Without ``known`` the licences are those of LICENSES, TEXTS and DIGESTS. Rows that repeat a ``doc_id`` each have what was found in any
    of them; rows with a null ``doc_id`` share what was found in those. A digest known
    under two names gives the smaller one.
    """
    docs = docs.select("doc_id", "text")
    more = docs.sparkSession.createDataFrame(list(DIGESTS) if known is None else [], "license string, digest string")
    known = known if known is not None else known_licenses(docs.sparkSession)
    if not known.where(~F.lower("text").rlike(HINT)).isEmpty():
        raise ValueError(f"every known text must match {HINT}")
    both = known.select("license", digest(F.col("text")).alias("digest")).union(more)
    digests = stored(both.groupBy("digest").agg(F.min("license").alias("license")), "licenses")
    with_hint = docs.where(F.lower("text").rlike(HINT))
    lines = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(HINT))
    units = with_hint.select(
        "doc_id",
        F.explode(
            F.array_append(
                F.transform(lines, lambda x: F.struct(x.alias("text"), F.lit(False).alias("whole"))),
                F.struct(F.col("text"), F.lit(True).alias("whole")),
            )
        ).alias("unit"),
    ).select("doc_id", "unit.whole", digest(F.col("unit.text")).alias("digest"))
    found = (
        units.join(small_side(digests), "digest")
        .groupBy("doc_id")
        .agg(
            F.count_if(~F.col("whole")).alias("n_notices"),
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
            F.min(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
        )
        .withColumnRenamed("doc_id", "_doc")
    )
    joined = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return joined.select(
        "doc_id", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("licenses", F.lit("")).alias("licenses"), "whole_license"
    )
