"""Licence texts by canonical digest.

A text is brought to a canonical form (case, copyright lines, punctuation, white space
and equivalent spellings) and hashed; whole texts are joined to the digests of known
licences. All of it is DataFrame functions, and the table of known digests is as long
as the list of licences.
"""

from __future__ import annotations

import textwrap

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Public licence texts and the usual one-line notices, by identifier.
KNOWN = {
    "MIT": f"MIT License\nCopyright (c) holder\n{_PERMIT}\n{_AS_IS}",
    "MIT (no title)": f"{_PERMIT}\n{_AS_IS}",
    "ISC": f"ISC License\n{_ISC.format(', provided that the above copyright notice and this permission notice appear in all copies.')}\n{_ISC_END}",
    "0BSD": f"BSD Zero Clause License\n{_ISC.format('.')}\n{_ISC_END}",
    "BSD-2-Clause": f"BSD 2-Clause License\n{_BSD}\n{_BSD_END}",
    "BSD-3-Clause": f"BSD 3-Clause License\n{_BSD} {_BSD_3}\n{_BSD_END}",
    "notice Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice MIT": "Released under the MIT License.",
    "notice GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
#: Further texts, which the SQL doesn't have.
MORE = {
    "MIT-0": f"MIT No Attribution\n{_PERMIT.partition(', subject to the following')[0]}.\n{_AS_IS}",
    "Zlib": _ZLIB,
    "BSL-1.0": f"Boost Software License - Version 1.0 - August 17th, 2003\n{_BOOST}",
    "Unlicense": f"{_UNLICENSE}\n{_AS_IS.replace('AUTHORS OR COPYRIGHT HOLDERS', 'AUTHORS')}\nFor more information, please refer to <https://unlicense.org/>",
}
#: Digests of the form() of long texts, taken from Debian's common-licenses; "short" is without the appendix.
FORMS = {
    "Apache-2.0": "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
    "Apache-2.0 short": "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40",
    "Artistic-1.0-Perl": "c9bcba9e70d36ab628a0944e717aa88f7b65f5755a9f3061c584801892429806",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-1.0 short": "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-2.0 short": "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
    "GPL-3.0": "f6eaf8069e6992495ee63002d3cf837d745ad9c33d0c2129f4dd67750ebe0094",
    "GPL-3.0 short": "7e1ec759902e79fd98df32aeafb56e0fcc9348cebf7b52c7a875052ac012ad4a",
    "LGPL-2.0": "9645df35bc8e107839fb024e61e6728ee32745a72194667211f31f7bad57b7d8",
    "LGPL-2.0 short": "5b76795361ffca92776bfb6f87f31cc8c230526d08f639d965de248bd171ca59",
    "LGPL-2.1": "a5875b4abd0df481e41a66665de9bea2d629872285f8f890c7ff03f4f87cb0ef",
    "LGPL-2.1 short": "e8fff5aab68f3784c88bdf6c7d677d555dbfc3274d7e0a03da4870604bf989ed",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "9c38a92c43b96c05d7c74eae14658e08f767c6c8865f2bf2143a1fb58853f1f0",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}

#: Spellings that mean the same, after case and punctuation are gone; applied in this order.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("organisation", "organization"), ("modelled", "modeled"), ("favour", "favor"), ("fulfil", "fulfill"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("acknowledgement", "acknowledgment"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form; null stays null.

    Lines that state a copyright or that all rights are reserved (also behind the marks of a
    comment, which count as punctuation) are left out, but not
    lines of a licence that begin with 'copyright notice', 'copyright holder' or an item (c); letters
    A-Z become small; what is neither a letter, a digit nor beyond ASCII becomes one
    space; equivalent spellings of whole words are made alike.
    """
    t = F.translate(text, _UPPER, _LOWER)
    t = F.regexp_replace(t, "(^|\n)[ \t/*#;%!<-]*(copyright(?!\\s+(notices?|holders?|owners?|licen[sc]es?|laws?|statements?|interests?|and|or|in|to|is)\\b)|\\(c\\)(?![ \t]+(you|the|an?|any|all|if|in|to|for|each|such|every|this|that|it|no|must|may|under|prominently|cause|accompany)\\b)|©|all rights reserved)[^\n]*", "\n")
    t = F.regexp_replace(t, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F‘’“”–— ]+", " ")
    t = F.concat(F.lit(" "), F.trim(t), F.lit(" "))
    for a, b in SPELLINGS * 2:  # of two in a row, the second has lost the space before it
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


#: What differs between copies of one licence, in the canonical form.
_SAME = (
    (r"^(the )?(mit no attribution|zlib license|boost software license version 1 0( august 17th 2003)?|mit license( mit)?|mit|expat license|isc license( iscl?)?|(bsd zero clause|zero clause bsd|bsd 0 clause) license( 0bsd)?|((bsd 2 clause|2 clause bsd)( simplified)?|simplified bsd) license|((bsd 3 clause|3 clause bsd)( new or revised| new| revised)?|new bsd|revised bsd|modified bsd|bsd) license) ", ""),
    (r"\b[123] (?=redistributions |neither the name)", ""),
    (r"neither the names? of .{1,200}? nor the names of (its|their) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"this software is provided by .{1,200}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    (r"in no event shall .{1,200}? be liable for any direct indirect", "in no event shall the copyright holder or contributors be liable for any direct indirect"),
)


def form(canonical_text: Column) -> Column:
    """A canonical form without a licence's title, numbers of its conditions and names of holders."""
    for a, b in _SAME:
        canonical_text = F.regexp_replace(canonical_text, a, b)
    return canonical_text


def known_digests(spark, of=lambda t: t) -> DataFrame:
    """license_id, digest, one row for each digest; `of` is applied to the canonical forms."""
    rows = spark.createDataFrame(sorted((KNOWN | MORE).items()), "license_id string, text string")
    return rows.select("license_id", F.sha2(of(canonical(F.col("text"))), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def known_forms(spark) -> DataFrame:
    """license_id, digest of form(), one row for each digest."""
    rows = [(k.removesuffix(" short"), d) for k, d in FORMS.items()]
    return known_digests(spark, form).select("license_id", "digest").union(spark.createDataFrame(rows, "license_id string, digest string")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, digest of its canonical form, license_id or null.

    A null text has a null digest and no licence; an empty one has the digest of the
    empty form. Repeated rows are reported alike; other columns are ignored. Texts of
    any length are hashed whole. `known` (digest, license_id) may be of any size: Spark
    broadcasts it only under its size threshold. Without it, a text that is no known
    licence as it stands is also compared by its form().
    """
    forms = known_forms(docs.sparkSession) if known is None else None
    known = known_digests(docs.sparkSession) if known is None else known
    known = known.select(F.col("digest").alias("known_digest"), "license_id")
    mine = docs.select(docs["doc_id"], canonical(docs["text"]).alias("t"))
    mine = mine.select("doc_id", F.sha2("t", 256).alias("digest"), *([F.sha2(form(F.col("t")), 256).alias("form")] if forms else []))
    found = mine.join(known, F.col("digest") == F.col("known_digest"), "left")
    if forms:
        forms = forms.select(F.col("digest").alias("known_form"), F.col("license_id").alias("form_id"))
        found = found.join(forms, F.col("form") == F.col("known_form"), "left").withColumn("license_id", F.coalesce("license_id", "form_id"))
    return found.select("doc_id", "digest", "license_id")


def _sql_canonical(t: str) -> str:
    t = f"translate({t}, '{_UPPER}', '{_LOWER}')"
    t = rf"regexp_replace({t}, '(^|\n)[ \t/*#;%!<-]*(copyright|\(c\)|©|all rights reserved)[^\n]*', chr(10), 'g')"
    t = rf"' ' || trim(regexp_replace({t}, '[\x00-\x2F\x3A-\x60\x7B-\x7F‘’“”–—\x{{A0}}]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS * 2:
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"trim({t})"


def oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(KNOWN.items()))
    return textwrap.dedent(f"""
        WITH known AS (SELECT min(license_id) AS license_id, digest FROM (SELECT license_id, sha256({_sql_canonical('text')}) AS digest FROM (VALUES {values}) AS k(license_id, text)) GROUP BY digest),
         mine AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents)
        SELECT doc_id, mine.digest, license_id FROM mine LEFT JOIN known ON mine.digest = known.digest
        """)
