"""License scans by canonical digest lookup, in DataFrame functions only.

A text's canonical form has lower case letters, one spelling of each word that
licences spell in several ways, no copyright lines, no punctuation, and single
spaces. Its SHA-256 is looked up among the digests of known licences by a hash
join; the known texts go through the same functions. Single lines are looked up
too, so that a notice inside a text is found.

Known texts are a fixed list, whose size bounds the broadcast side: KNOWN, which
the SQL has too, and those of FULL and of license_digests, which the SQL lacks.

Defined results: null text has the digest of the empty text, no licence and no
notice. Very long texts are one string each. Equal rows get equal results. An
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_digests import DIGESTS

#: Patterns, in order, and what replaces them, on lower-cased text. They mean the same in Java's and RE2's regular expressions.
REWRITES = (
    (r"(?m)^[\s#/*;%-]*(copyright\s*(\(c\)|©|[0-9]{4}|by\b)|\(c\)\s*(copyright|[0-9]{4})|©|all rights reserved).*$", ""),
    (r"https?://(www\.)?", ""),
    (r"\blicence", "license"),
    (r"\bsub[ -]licens", "sublicens"),
    (r"\bnon[ -]", "non"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bfulfil\b", "fulfill"),
    (r"\bversion\b", "v"),
    (r"\bv[. ]*([0-9])", "v$1"),
    (r"&", " and "),
    (r"[^a-z0-9\n\x{80}-\x{10FFFF}]+", " "),
    (r" *\n *", "\n"),
)

#: Public licence texts and notices, by SPDX identifier.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
)


_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ITEMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_BSD_NAMES = tuple(f"Neither the name of {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." for x in ("the copyright holder", "the copyright holders", "the author"))
_BSD_TAILS = tuple(f"""THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {x} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""" for x in ("HOLDER", "HOLDERS", "OWNER"))
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def _full() -> tuple[tuple[str, str], ...]:
    """Short whole texts with and without a title, BSD's with and without numbers before its conditions."""
    mit, isc = KNOWN[0][1], KNOWN[1][1]
    bodies = {"MIT": [mit], "ISC": [isc, isc.replace("and/or", "and")], "BSD-2-Clause": [], "BSD-3-Clause": [], "Unlicense": [_UNLICENSE, _UNLICENSE + " For more information, please refer to <https://unlicense.org>", _UNLICENSE + " For more information, please refer to <https://unlicense.org/>"]}
    for name, lasts in (("BSD-2-Clause", [()]), ("BSD-3-Clause", [(x,) for x in _BSD_NAMES])):
        for last in lasts:
            for tail in _BSD_TAILS:
                items = _BSD_ITEMS + last
                bodies[name] += ["\n".join([_BSD_HEAD, *items, tail]), "\n".join([_BSD_HEAD, *[f"{k}. {x}" for k, x in enumerate(items, 1)], tail])]
    titles = {
        "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT"),
        "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
        "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "BSD License", "Simplified BSD License"),
        "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "BSD License", "New BSD License", "Modified BSD License"),
        "Unlicense": ("The Unlicense", "Unlicense"),
    }
    return tuple((name, f"{title}\n{body}") for name in bodies for body in bodies[name] for title in ("", *titles[name]))


FULL = _full()


def canonical_lines(text: Column) -> Column:
    """The canonical form with line ends kept."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, new in REWRITES:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(new))
    return F.trim(out)


def canonical(lines: Column) -> Column:
    """The canonical form of a whole text from its canonical lines."""
    return F.trim(F.regexp_replace(lines, F.lit(r"[ \n]+"), F.lit(" ")))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN + FULL, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """digest, license of the known texts and digests; of equal forms the first identifier by code point."""
    texts = spark.createDataFrame(list(known), "license string, known_text string")
    found = texts.select(F.sha2(canonical(canonical_lines(F.col("known_text"))), 256).alias("digest"), "license")
    if digests:
        found = found.union(spark.createDataFrame(list(digests), "license string, digest string").select("digest", "license"))
    return found.groupBy("digest").agg(F.min("license").alias("license"))


def scanned(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_digest, license (of the whole text, or null), notices (identifiers of the lines that are known, joined by commas, or null)."""
    forms = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    whole = forms.select("id", F.sha2(canonical(F.col("lines")), 256).alias("text_digest"))
    lines = forms.select("id", F.explode(F.array_distinct(F.split("lines", "\n"))).alias("line")).where("line <> ''")
    found = lines.select("id", F.sha2("line", 256).alias("digest")).join(F.broadcast(known), "digest").groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    named = whole.join(F.broadcast(known), whole["text_digest"] == known["digest"], "left").select("id", "text_digest", "license")
    return named.join(found, "id", "left")


def sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The same scan in DuckDB's SQL over `documents`."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def lines(x: str) -> str:
        out = f"lower(coalesce({x}, ''))"
        for pattern, new in REWRITES:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(new.replace('$1', chr(92) + '1'))}, 'g')"
        return f"trim({out}, ' ')"

    whole = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'), ' ')"
    rows = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known)
    return f"""
with texts(license, known_text) as (values {rows}),
known as (select sha256({whole(lines('known_text'))}) as digest, min(license) as license from texts group by 1),
forms as (select doc_id, {lines('text')} as l from documents),
found as (
  select doc_id, string_agg(distinct license, ',' order by license) as notices
  from (select doc_id, unnest(string_split(l, chr(10))) as line from forms) join known on sha256(line) = digest where line <> '' group by doc_id
)
select f.doc_id, sha256({whole('l')}) as text_digest, k.license, n.notices
from forms f left join known k on k.digest = sha256({whole('l')}) left join found n on n.doc_id = f.doc_id"""
