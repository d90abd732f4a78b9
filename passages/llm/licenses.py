"""Known licence texts in documents, by canonical digest.

A text is made canonical (case, copyright lines, punctuation, white space, spellings that mean the
same) and hashed; the digest is joined to those of the known licences. Three kinds of texts
are looked up: whole documents, their paragraphs (parted by blank lines) and their lines.

Everything runs in built-in functions. The table of known licences is broadcast after a
check of its size; a larger one is joined by a shuffle of digests, in which Spark splits hot ones.

Cases: null and empty texts, and texts of copyright lines or punctuation alone, have no digest and match nothing;
licences with one canonical text count under the smallest name; equal rows are counted apart only if their
doc_ids differ; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LICENSES = 10_000

# Patterns and spellings of the canonical form.
#: Words after "copyright" in the body of a licence; any other word names a holder.
BODY_WORDS = (
    "act and are as assignment attribution claim claims disclaimer disclaimers for holder holders in information"
    " infringement interest interests is law laws licence licences license licenses line lines may notice notices of"
    " on or owner owners ownership permission permissions protection right rights shall statement statements status"
    " subsists terms that to treaty under which will"
).split()


def _other_word(words: list[str], inside: bool = False) -> str:
    """A pattern of every word but these, without look-ahead (which the SQL engine lacks)."""
    heads = sorted({w[0] for w in words if w})
    ways = [h + _other_word([w[1:] for w in words if w[:1] == h], True) for h in heads]
    ways.append(rf"(?:[^\P{{L}}{''.join(heads)}]|\p{{N}})[\p{{L}}\p{{N}}]*")
    return f"(?:{'|'.join(ways)}){'?' if inside and '' not in words else ''}"


#: A notice: a sign, or "copyright" with a sign, a year, a blank to fill in or a holder.
#: Lines of a body that a wrap has put "copyright" or an item "(c)" at the head of are none.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:©[^\n]*|\(c\)[^\p{L}\p{N}\n]*(?:\p{N}{4}|[<\[{])[^\n]*"
    r"|(?:\(c\)[^\p{L}\p{N}\n]*)?copyright(?:[ \t]*(?:\(c\)|©|[:<\[{])[^\n]*|[^\p{L}\p{N}\n]*\p{N}{4}[^\n]*"
    rf"|[ \t]+(?:by[ \t][^\n]*|{_other_word(BODY_WORDS)}(?:[^\p{{L}}\p{{N}}\n][^\n]*)?))"
    r"|all rights reserved[^\p{L}\n]*)$"
)
NOT_A_WORD = r"[^\p{L}\p{N}]+"
BLANK_LINE = r"\n[ \t\r\x0B\f]*\n"
SPELLINGS = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("while", "whilst"),
    ("https", "http"),
)

# Names of licences, and phrases that put a work under one.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "MIT": ("MIT License", "MIT"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "Unlicense": ("Unlicense",),
}
PHRASES = (
    "{0}",
    "Licensed under {0}",
    "Licensed under the {0}",
    "Released under {0}",
    "Released under the {0}",
    "Distributed under the {0}",
    "This work is licensed under {0}",
    "This work is licensed under the {0}",
    "This work is licensed under a {0}",
    "This project is licensed under the {0}",
)
#: Paragraphs of fewer words are headings.
LEAST_PARAGRAPH = 8
END_OF_TERMS = re.compile(r"END OF TERMS AND CONDITIONS.*", re.S)
# Short whole texts, and notices that stand at the head of files. Longer whole texts lie in license_texts.
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "BSD-2-Clause": """BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """BSD 3-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


def whole_texts() -> dict[str, str]:
    """The files of license_texts, by license_id."""
    files = resources.files("passages.llm").joinpath("license_texts").iterdir()
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(files, key=lambda f: f.name) if f.name.endswith(".txt")}


def known_licenses() -> list[tuple[str, str]]:
    """(license_id, text) of the built-in table: every phrase with every name, the texts with and
    without title and appendix, and those of their paragraphs that no other licence has."""
    short = [(k, phrase.format(name)) for k, names in NAMES.items() for name in names for phrase in PHRASES]
    texts = [*TEXTS.items(), *whole_texts().items()]
    forms, holders = [], {}
    for license_id, text in texts:
        for form in dict.fromkeys((text, END_OF_TERMS.sub("", text), END_OF_TERMS.sub("END OF TERMS AND CONDITIONS", text))):
            title, _, rest = form.strip().partition("\n\n")
            forms.append((license_id, form))
            if rest and len(title.split()) < LEAST_PARAGRAPH + 4:
                forms.append((license_id, rest))
        for paragraph in re.split(BLANK_LINE, text):
            words = " ".join(re.findall(r"\w+", paragraph.lower()))
            if len(words.split()) >= LEAST_PARAGRAPH:
                holders.setdefault(words, {})[license_id] = paragraph
    alone = [pair for of in holders.values() if len(of) == 1 for pair in of.items()]
    return list(dict.fromkeys(short + forms + alone))


def words_of(line: Column) -> Column:
    """The words of a line, apart by one space; of a copyright line none."""
    marked = F.lit(False)
    for mark in ("copyright", "(c)", "©", "all rights reserved"):
        marked = marked | F.contains(line, F.lit(mark))
    plain = F.when(marked, F.regexp_replace(line, COPYRIGHT_LINE, "")).otherwise(line)
    return F.trim(F.regexp_replace(plain, NOT_A_WORD, " "))


def joined(text: Column) -> Column:
    """The words of a text of lines."""
    lines = F.transform(F.split(F.lower(text), "\n"), words_of)
    return F.array_join(F.filter(lines, lambda w: w != ""), " ")


def digest(words: Column) -> Column:
    """Of words in the spelling that all copies share; null for none."""
    for found, meant in SPELLINGS:
        words = F.replace(words, F.lit(found), F.lit(meant))
    return F.when(words != "", F.sha2(words, 256))


def license_digests(known: DataFrame) -> DataFrame:
    """One row per canonical text of known(license_id, text)."""
    found = known.select(digest(joined(F.col("text"))).alias("digest"), "license_id").where("digest is not null")
    return found.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, part (text, paragraph or line), license_id and n, how often the part occurs."""
    spark: SparkSession = docs.sparkSession
    if known is None:
        known = spark.createDataFrame(known_licenses(), "license_id string, text string")
    digests = license_digests(known)
    if digests.limit(BROADCAST_LICENSES + 1).count() <= BROADCAST_LICENSES:
        digests = F.broadcast(digests)
    # Every line is made canonical once; whole texts are their lines put together. A text without a
    # blank line is its own only paragraph.
    text = F.col("text").cast("string")
    one = F.coalesce(~F.rlike(text, F.lit(BLANK_LINE)), F.lit(True))
    lines = F.transform(F.split(F.lower(text), "\n"), words_of)
    paragraphs = F.when(~one, F.transform(F.split(text, BLANK_LINE), joined)).otherwise(F.array().cast("array<string>"))
    units = docs.where(text.isNotNull()).select("doc_id", lines.alias("lines"), paragraphs.alias("paragraphs"), one.alias("one"))
    whole = F.array_join(F.filter("lines", lambda w: w != ""), " ")

    def unit(words: Column, *parts: str) -> Column:
        return F.struct(F.array(*map(F.lit, parts)).alias("parts"), words.alias("words"))

    first = F.when(F.col("one"), unit(whole, "text", "paragraph")).otherwise(unit(whole, "text"))
    every = F.concat(
        F.array(first),
        F.transform("paragraphs", lambda w: unit(w, "paragraph")),
        F.transform("lines", lambda w: unit(w, "line")),
    )
    found = units.select("doc_id", F.explode(every).alias("u")).select(
        "doc_id", "u.parts", digest(F.col("u.words")).alias("digest")
    )
    matched = found.where("digest is not null").join(digests, "digest")
    parts = matched.select("doc_id", F.explode("parts").alias("part"), "license_id")
    return parts.groupBy("doc_id", "part", "license_id").agg(F.count(F.lit(1)).alias("n"))
