"""Licence texts found by canonical digest, in DataFrame functions only.

A text is brought to a canonical form: lower case, without copyright lines, with
punctuation as spaces and equivalent spellings made one. The digest of the entire
form is joined to the digests of known licences, and so are single lines, which
may be notices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm.common import SENT_ROWS, durable, packed, whole_text
from cargolens.llm.quality import barrier

# Licence texts and notices, by identifier.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """zlib License

Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Copyright <year> <owner>

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = (
    ("MIT", MIT),
    ("MIT", MIT.removeprefix("MIT License\n\n")),
    ("ISC", ISC),
    ("ISC", ISC.removeprefix("ISC License\n\n")),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_NAMES + BSD_TAIL),
    ("Zlib", ZLIB),
    ("Zlib", ZLIB.removeprefix("zlib License\n\n")),
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)
#: File in license_texts, identifier, lines of its title (blank ones don't count).
FILES = (
    ("Apache-2.0", "Apache-2.0", 3), ("Artistic", "Artistic-1.0-Perl", 1), ("BSD", "BSD-3-Clause", 0), ("CC0-1.0", "CC0-1.0", 2),
    ("GFDL-1.2", "GFDL-1.2", 2), ("GFDL-1.3", "GFDL-1.3", 2), ("GPL-1", "GPL-1.0", 2), ("GPL-2", "GPL-2.0", 2), ("GPL-3", "GPL-3.0", 2),
    ("LGPL-2", "LGPL-2.0", 2), ("LGPL-2.1", "LGPL-2.1", 2), ("LGPL-3", "LGPL-3.0", 2), ("MPL-1.1", "MPL-1.1", 2), ("MPL-2.0", "MPL-2.0", 1),
    ("Unlicense", "Unlicense", 0), ("BSL-1.0", "BSL-1.0", 1), ("0BSD", "0BSD", 0),
)
#: Usual titles of texts that are printed with more than one or without any.
TITLES = {
    "MIT": ("The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"),
    "Zlib": ("The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero-Clause License"),
}
#: Identifiers that a line of the form "SPDX-License-Identifier: X" may name.
SPDX = (
    "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-1.1", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "BSL-1.0", "0BSD", "Artistic-2.0", "EPL-2.0",
)
#: what comes after the terms of the Apache License and the GPL: how to apply them
TERMS_END = "END OF TERMS AND CONDITIONS"


def entire_texts() -> Iterator[tuple[str, str]]:
    """(license_id, text) of whole licences: with and without title, and with and without what follows their terms."""
    bare = {"MIT": MIT.removeprefix("MIT License\n\n"), "ISC": ISC.removeprefix("ISC License\n\n"), "BSD-2-Clause": BSD_HEAD + BSD_TAIL, "BSD-3-Clause": BSD_HEAD + BSD_NAMES + BSD_TAIL, "Zlib": ZLIB.removeprefix("zlib License\n\n")}
    yield from ((i, f"{title}\n\n{text}") for i, text in bare.items() for title in TITLES[i])
    for file, name, n_title in FILES:
        text = (Path(__file__).parent / "license_texts" / f"{file}.txt").read_text(encoding="utf-8")
        lines = text.strip("\n\f ").split("\n")
        at = [k for k, line in enumerate(lines) if line.strip()][n_title]
        for form in (text, "\n".join(lines[at:]), *(f"{title}\n\n{text}" for title in TITLES.get(name, ()))):
            yield name, form
            if TERMS_END in form:
                yield name, form[: form.index(TERMS_END) + len(TERMS_END)]
                yield name, form[: form.index(TERMS_END)]


#: The known set: short texts, whole licences and identifier lines.
LICENSES = (*KNOWN, *entire_texts(), *((i, f"SPDX-License-Identifier: {i}") for i in SPDX))
#: Words that licences spell in more than one way, and the form that counts.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "sub licence": "sublicense", "sublicence": "sublicense", "acknowledgement": "acknowledgment",
    "favour": "favor", "honour": "honor", "organisation": "organization", "authorised": "authorized", "merchantibility": "merchantability", "non infringement": "noninfringement", "per cent": "percent", "https": "http",
}
#: A copyright statement on a line of its own: the mark and then a year, another mark, "by" or a placeholder; or the reservation alone.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n(©]*(?:(?:copyright\b|\(c\)|©)[ \t:,]*(?:\d{4}|\(c\)|©|by\b|[<\[{]|yyyy\b|year\b)[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
#: only \n ends a line, whatever else Java takes for one
UNIX_LINES = "(?md)"

VARIANT = r"\b(?:" + "|".join(SPELLINGS) + r")\b"


def one_spelling(text: Column) -> Column:
    for word, instead in SPELLINGS.items():
        text = F.regexp_replace(text, rf"\b{word}\b", instead)
    return text


def canonical(text: Column) -> Column:
    """Column expression in three steps, lines kept; see canonical_rows for whole tables.

    Lower case, no copyright lines, single spaces for all but letters, digits
    and line ends, one spelling for equivalent words.
    """
    low = F.regexp_replace(F.lower(text), UNIX_LINES + COPYRIGHT_LINE, "")
    return one_spelling(F.regexp_replace(low, r"[^\p{L}\p{N}\n]+", " "))


def entire(form: Column) -> Column:
    """A canonical form as one line."""
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] | DataFrame = LICENSES) -> DataFrame:
    """Written table (license_digest, license_id, n_chars of the canonical form) of known texts: at most as many rows as `known`, a sequence or table of (license_id, text). Of texts with one form the smallest identifier counts; null and empty texts are left out."""
    if isinstance(known, DataFrame):
        texts = known.select(F.col("license_id").cast("string").alias("license_id"), F.col("text").cast("string").alias("text"))
    else:
        rows = F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in known)).cast("array<struct<license_id:string,text:string>>")
        texts = spark.range(1).select(F.inline(rows))
    forms = texts.select(entire(canonical(F.col("text"))).alias("form"), "license_id").where("form <> ''")
    return durable(forms.groupBy(F.sha2("form", 256).alias("license_digest")).agg(F.min("license_id").alias("license_id"), F.min(F.length("form")).alias("n_chars")), "known")


def license_matches(docs: DataFrame, *, text_col: str = "text", carry: Sequence[str] | None = None, known: Sequence[tuple[str, str]] | DataFrame = LICENSES) -> DataFrame:
    """Columns row, text_digest (SHA-256 of the canonical form), license_id (of the known text that the entire text equals, or null), notice_ids (sorted distinct licences of lines that equal a known text; no such line: empty) and n_notices (such lines, repeats too).

    Null text is empty and matches nothing, nor does a text of copyright lines
    and punctuation alone. Repeated rows match each. A text of any length is
    digested whole; of its lines those are digested that are as long as some known
    form, since others equal none. An empty table of docs gives an empty one, an
    empty known set no matches.
    """
    digests = known_digests(docs.sparkSession, known)
    few = digests.count() <= SENT_ROWS
    sizes = sorted(r["n_chars"] for r in digests.select("n_chars").distinct().collect())  # fewer than known texts, or than characters of the longest
    made = packed(docs, carry, text=text_col).select("row", whole_text().alias("text"))
    low = F.lower(F.col("text"))
    bare = F.when(low.rlike(r"copyright|\(c\)|©|all rights reserved"), F.regexp_replace(low, UNIX_LINES + COPYRIGHT_LINE, "")).otherwise(low)
    forms = barrier(made, ["row"], form=F.regexp_replace(bare, r"[^\p{L}\p{N}\n]+", " "))
    forms = barrier(forms, ["row"], form=F.when(F.col("form").rlike(VARIANT), one_spelling(F.col("form"))).otherwise(F.col("form")))
    lines = F.filter(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(sizes))
    units = forms.select("row", F.sha2(entire(F.col("form")), 256).alias("text_digest"), F.transform(lines, lambda x: F.sha2(x, 256)).alias("lines"))
    units = durable(units.withColumn("uid", F.monotonically_increasing_id()), "digests")

    sent = F.broadcast(digests) if few else digests
    hits = units.select("uid", F.explode("lines").alias("license_digest")).join(sent, "license_digest")
    notices = hits.groupBy("uid").agg(F.array_sort(F.collect_set("license_id")).alias("notice_ids"), F.count(F.lit(1)).alias("n_notices"))
    found = units.select("row", "uid", "text_digest").join(sent.select(F.col("license_digest").alias("text_digest"), "license_id"), "text_digest", "left").join(notices, "uid", "left")
    none = F.array().cast("array<string>")
    return found.select("row", "text_digest", "license_id", F.coalesce("notice_ids", none).alias("notice_ids"), F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"))
