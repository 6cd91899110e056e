"""Licence scans by sentence rules.

A text is cut into sentences, each normalised (ASCII lower case, every run of
other characters than a-z and 0-9 one space). A sentence ends at a sentence
mark or a blank line; a line break inside it counts as a space, so a notice is
found however it is wrapped, and behind comment signs. A sentence that is not
known as a whole is looked up line by line instead: a licence line under lines
without marks is a sentence too. A normalised sentence that is known maps to
its identifier; the identifiers of a document, in text order, are matched
against ordered rules, most specific first: a rule is a sequence of
identifiers, and a match takes those sentences out, so that a shorter rule
can't claim them again. Sentences that are not known do not break a sequence.

All of it is done inside the row with SQL expressions: no shuffle.

Cases: null and empty texts have no sentence and no licence; sentences that
name a licence but are not known count as ``n_unknown``; repeated rows are
scanned alike, one result each; ties: of two rules that match the same
sentences the one that stands first takes them; extra columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from navlens.llm.common import ascii_lower, let

# Known licence sentences, normalised, and their identifiers.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache2",
    "you may not use this file except in compliance with the license": "apache2comply",
    "you may obtain a copy of the license at": "apache2copy",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mitgrant",
    "the above copyright notice and this permission notice shall be included in all copies": "mitnotice",
    "the software is provided as is without warranty of any kind": "asis",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "this work is licensed under the gnu general public license version 2": "gpl2",
    "this program is free software you can redistribute it and or modify it": "gplfree",
    "this program is distributed in the hope that it will be useful": "gpluseful",
    "licensed under the gnu lesser general public license version 3": "lgpl3",
    "licensed under cc by nc 4 0": "ccbync4",
    "licensed under cc by 4 0": "ccby4",
    "licensed under cc by sa 4 0": "ccbysa4",
    "redistribution and use in source and binary forms are permitted": "bsdgrant",
    "neither the name of the copyright holder may be used to endorse products": "bsdnoendorse",
    "this software is provided by the copyright holders as is": "bsdasis",
    "licensed under the mozilla public license version 2 0": "mpl2",
    "all rights reserved": "reserved",
    "spdx license identifier apache 2 0": "apache2",
    "spdx license identifier mit": "mit",
    "spdx license identifier gpl 3 0 only": "gpl3",
}
# The sentences of the notices that these licences ask to be put into files, as they are published.
NOTICES: dict[str, list[str]] = {
    "apache2header": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
                      ' compliance with the License'],
    "apache2copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                    "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2asis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is'
                    ' distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "apache2see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mitgrant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated'
                 ' documentation files (the "Software"), to deal in the Software without restriction, including without'
                 ' limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of'
                 ' the Software, and to permit persons to whom the Software is furnished to do so, subject to the following'
                 ' conditions'],
    "mitnotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial"
                  " portions of the Software"],
    "asis": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO'
             ' THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "mitliable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,"
                  " WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
                  " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "bsdgrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
                 " the following conditions are met"],
    "bsdsource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the"
                  " following disclaimer"],
    "bsdbinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
                  " following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsdnoendorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
                     " promote products derived from this software without specific prior written permission"],
    "bsdasis": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED'
                ' WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A'
                ' PARTICULAR PURPOSE ARE DISCLAIMED'],
    "bsdliable": ["IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
                  " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE"
                  " GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY"
                  " THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)"
                  " ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"],
    "gpl3later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
                  " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
                  " option) any later version"],
    "gpl2later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General"
                  " Public License as published by the Free Software Foundation; either version 2 of the License, or (at your"
                  " option) any later version"],
    "gpluseful": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
                  " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gplsee": ["See the GNU General Public License for more details"],
    "gplcopy": ["You should have received a copy of the GNU General Public License along with this program"],
    "lgpl21later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
                    " General Public License as published by the Free Software Foundation; either version 2.1 of the License,"
                    " or (at your option) any later version"],
    "mpl2form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],  # "v. 2.0": a mark
    "mpl2copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at"
                 " https://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at"
                 " http://mozilla.org/MPL/2.0/"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
            " granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}


def _normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _known() -> dict[str, str]:
    """All known sentences, normalised. Where a notice has a blank line but no mark, its text on one line has none."""
    out = SENTENCES | {_normal(s): i for i, ss in NOTICES.items() for s in ss}
    for url in NOTICES["apache2copy"]:
        out[_normal(f"{url} {NOTICES['apache2asis'][0]}")] = "apache2copyasis"
    out[_normal(f"{NOTICES['mitgrant'][0]} {NOTICES['mitnotice'][0]}")] = "mitgrantnotice"
    out[_normal(f"{NOTICES['bsdgrant'][0]}: 1")] = "bsdgrant"
    return out


# Ordered rules (identifiers in order -> licence); a longer, more specific rule stands first.
RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("apache2header", "apache2copy", "apache2asis", "apache2see"), "Apache-2.0"),
    (("apache2header", "apache2copyasis", "apache2see"), "Apache-2.0"),
    (("apache2header",), "Apache-2.0"),
    (("apache2", "apache2comply", "apache2copy"), "Apache-2.0"),
    (("bsdgrant", "bsdsource", "bsdbinary", "bsdnoendorse", "bsdasis", "bsdliable"), "BSD-3-Clause"),
    (("bsdgrant", "bsdsource", "bsdbinary", "bsdnoendorse"), "BSD-3-Clause"),
    (("bsdgrant", "bsdsource", "bsdbinary", "bsdasis", "bsdliable"), "BSD-2-Clause"),
    (("bsdgrant", "bsdsource", "bsdbinary"), "BSD-2-Clause"),
    (("bsdgrant", "bsdnoendorse", "bsdasis"), "BSD-3-Clause"),
    (("mitgrantnotice", "asis", "mitliable"), "MIT"),
    (("mitgrantnotice",), "MIT"),
    (("mitgrant", "mitnotice", "asis", "mitliable"), "MIT"),
    (("mitgrant", "mitnotice", "asis"), "MIT"),
    (("gpl3later", "gpluseful", "gplsee", "gplcopy"), "GPL-3.0-or-later"),
    (("gpl3later",), "GPL-3.0-or-later"),
    (("gpl2later", "gpluseful", "gplsee", "gplcopy"), "GPL-2.0-or-later"),
    (("gpl2later",), "GPL-2.0-or-later"),
    (("lgpl21later",), "LGPL-2.1-or-later"),
    (("mpl2form", "mpl2copy"), "MPL-2.0"),
    (("mpl2form",), "MPL-2.0"),
    (("isc",), "ISC"),
    (("unlicense",), "Unlicense"),
    (("gplfree", "gpluseful", "gpl3"), "GPL-3.0"),
    (("bsdgrant", "bsdasis"), "BSD-2-Clause"),
    (("apache2",), "Apache-2.0"),
    (("mit",), "MIT"),
    (("mitgrant",), "MIT"),
    (("gpl3",), "GPL-3.0"),
    (("gpl2",), "GPL-2.0"),
    (("lgpl3",), "LGPL-3.0"),
    (("ccbync4",), "CC-BY-NC-4.0"),
    (("ccbysa4",), "CC-BY-SA-4.0"),
    (("ccby4",), "CC-BY-4.0"),
    (("mpl2",), "MPL-2.0"),
    (("bsdgrant",), "BSD"),
    (("reserved",), "Proprietary"),
)
KNOWN = _known()
# Fixed value: words that make an unknown sentence worth a look.
LICENCE_WORDS = r"(^| )(licen[sc]ed?|copyright|warranty|redistribut[a-z]*|spdx)( |$)"


def sentences(text: Column, known: Collection[str]) -> Column:
    """Normalised sentences of a text, in order, empty ones left out; unknown ones of several lines as their lines."""
    marked = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[.!?]+([\x20\x09-\x0D]+|\z)", "\n\n")
    plain = F.regexp_replace(marked, r"[^a-z0-9\n]+", " ")
    blocks = F.filter(F.transform(F.split(plain, r"\n *\n[ \n]*"), lambda s: F.btrim(s, F.lit(" \n"))), lambda s: s != "")

    def pieces(block: Column) -> Column:
        whole = F.regexp_replace(block, r" *\n *", " ")
        return F.when(~block.contains("\n") | whole.isin(list(known)), F.array(whole)).otherwise(F.split(block, r" *\n *"))

    return F.flatten(F.transform(blocks, pieces))


def scan_licenses(docs: DataFrame, known: dict[str, str] | None = None,
                  rules: Sequence[tuple[Sequence[str], str]] = RULES) -> DataFrame:
    """doc_id, n_sentences, n_known, n_unknown, sentence_ids, licenses, license of every row.

    ``sentence_ids``: known identifiers in text order, each in ``<>``;
    ``licenses``: the licences found, in rule order, joined by commas;
    ``license``: the first of them, null if none.
    """
    known = KNOWN if known is None else known
    names = F.create_map(*[F.lit(x) for item in known.items() for x in item])

    def scanned(text: Column) -> Column:
        return let(sentences(text, known), lambda all_: F.struct(
            F.size(all_).alias("n"), F.filter(all_, lambda s: s.rlike(LICENCE_WORDS) | s.isin(list(known))).alias("hits")))

    out = docs.select("doc_id", scanned(F.col("text")).alias("s"))
    out = out.select(
        "doc_id", F.col("s.n").alias("n_sentences"), F.col("s.hits").alias("hits"),
        F.transform("s.hits", lambda s: names[s]).alias("ids"))
    out = out.withColumn("ids", F.filter("ids", lambda i: i.isNotNull())).select(
        "doc_id", "n_sentences", F.size("ids").alias("n_known"),
        (F.size("hits") - F.size("ids")).alias("n_unknown"),
        F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("sentence_ids"))
    # the rules in order, folded over the text of identifiers; a match is taken out and leaves a break
    steps = F.array(*[F.struct(F.lit("".join(f"<{i}>" for i in ids)).alias("seq"), F.lit(licence).alias("licence"))
                      for ids, licence in rules])
    start = F.struct(F.col("sentence_ids").alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["seq"])
        return F.struct(F.replace(state["rest"], rule["seq"], F.lit("|")).alias("rest"),
                        F.when(hit, F.array_union(state["found"], F.array(rule["licence"])))
                        .otherwise(state["found"]).alias("found"))

    found = F.when(F.col("n_known") > 0, F.aggregate(steps, start, step, lambda s: s["found"])) \
        .otherwise(F.array().cast("array<string>"))
    out = out.withColumn("found", found)
    return out.select("doc_id", "n_sentences", "n_known", "n_unknown", "sentence_ids",
                      F.array_join("found", ",").alias("licenses"), F.get("found", F.lit(0)).alias("license"))
