"""Real notices, wrapped in every way, are recognised by their sentences."""
import textwrap

import pytest

from navlens.llm import licenses as L

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MIT = "\n\n".join(". ".join(L.NOTICES[i][0] for i in part) + end for part, end in (
    (["mitgrant"], ":"), (["mitnotice"], "."), (["asis", "mitliable"], ".")))
BSD = (L.NOTICES["bsdgrant"][0] + ":\n\n1. " + L.NOTICES["bsdsource"][0] + ".\n\n2. " + L.NOTICES["bsdbinary"][0] + ".\n\n")
BSD3 = BSD + "3. " + L.NOTICES["bsdnoendorse"][0] + ".\n\n" + L.NOTICES["bsdasis"][0] + ". " + L.NOTICES["bsdliable"][0] + "."
BSD2 = BSD + L.NOTICES["bsdasis"][0] + ". " + L.NOTICES["bsdliable"][0] + "."
GPL3 = "\n\n".join([L.NOTICES["gpl3later"][0] + ".", L.NOTICES["gpluseful"][0] + ".  " + L.NOTICES["gplsee"][0] + ".",
                    L.NOTICES["gplcopy"][0] + ".  If not, see <https://www.gnu.org/licenses/>."])
GPL2 = GPL3.replace(L.NOTICES["gpl3later"][0], L.NOTICES["gpl2later"][0])
MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
       " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")
NOTICES = {"Apache-2.0": APACHE, "MIT": MIT, "BSD-3-Clause": BSD3, "BSD-2-Clause": BSD2, "GPL-3.0-or-later": GPL3,
           "GPL-2.0-or-later": GPL2, "MPL-2.0": MPL, "ISC": L.NOTICES["isc"][0] + ".",
           "LGPL-2.1-or-later": L.NOTICES["lgpl21later"][0] + "."}


def shapes(text):
    parts = text.split("\n\n")
    wrapped = "\n\n".join(textwrap.fill(p, 60) for p in parts)
    yield "as published", text
    yield "wrapped", wrapped
    yield "one line", " ".join(text.split())
    yield "comment", "\n".join(("# " + line).rstrip() for line in wrapped.split("\n"))
    yield "block comment", "/*\n" + "\n".join(" * " + line for line in wrapped.split("\n")) + "\n */\ncode();"
    yield "between other text", "Copyright 2024 Somebody\n\n" + wrapped + "\n\nSome words. More of them"


def test_notices(spark, make_docs):
    cases = [(licence, shape, text) for licence, notice in NOTICES.items() for shape, text in shapes(notice)]
    got = {r.doc_id: r for r in L.scan_licenses(make_docs([t for _, _, t in cases])).collect()}
    wrong = [(licence, shape, got[i].sentence_ids, got[i].licenses) for i, (licence, shape, _) in enumerate(cases)
             if got[i].licenses != licence]
    assert not wrong


@pytest.mark.parametrize("text,licence", [
    ("a line without a mark\nReleased under the MIT License.\nand more", "MIT"),
    ("words here Released under the MIT License.", None), ("SPDX-License-Identifier: MIT", "MIT"),
    ("Licensed under\nCC BY-NC 4.0.", "CC-BY-NC-4.0"), ("", None)])
def test_lines_and_sentences(spark, make_docs, text, licence):
    assert L.scan_licenses(make_docs([text])).first().license == licence


def test_every_known_sentence_is_one_sentence(spark, make_docs):
    known = list(L.KNOWN)
    got = {r.doc_id: r for r in L.scan_licenses(make_docs(known)).collect()}
    assert [got[i].sentence_ids for i in range(len(known))] == [f"<{L.KNOWN[s]}>" for s in known]
