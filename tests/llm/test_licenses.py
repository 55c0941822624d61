import re

from groundcover.llm import licenses as l

MIT = f"Copyright (c) 2020 A. Person\n\n{l.SENTENCES['mit.permission']}\n\n{l.SENTENCES['mit.notice']}\n\n{l.SENTENCES['mit.warranty']}\n"


def wrapped(text, width=70):
    lines, line = [], ""
    for word in text.split(" "):
        if len(line) + len(word) > width and (word[:1].islower() or word[:1] in '("') and line[-1:] in "abcdefghijklmnopqrstuvwxyz,":
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return "\n".join([*lines, line])


def brute(text):
    """Sentences, their identifiers, and the first rule that fits at each place."""
    for pattern in l.WRAPPED:
        text = re.sub(pattern, r"\1 \2", text or "")
    found = [s for s in (l.normal(x) for x in re.split(l.BREAK, text)) if s]
    known = l.known_sentences()
    ids = [known.get(s, "-") for s in found]
    out, at = [], 0
    while at < len(ids):
        for name, rule in l.RULES:
            if ids[at : at + len(rule)] == rule:
                out.append(name)
                at += len(rule)
                break
        else:
            at += 1
    unknown = any(i == "-" and re.search(l.MENTION, s) for i, s in zip(ids, found))
    return len(found), out, unknown


def test_against_brute_force(spark, make_docs):
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [
        MIT, wrapped(MIT.split("\n\n")[1]), "Released under the MIT License.\nReleased under the MIT License!", "LICENSED UNDER CC BY-NC 4.0",
        "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
        "Some licence nobody knows.", "# SPDX-License-Identifier: MPL-2.0\ncode", "é Licensed under the MIT", None, "", *real,
    ]
    rows = list(enumerate(texts))
    for row in l.scan(make_docs(rows)).collect():
        assert (row["n_sentences"], row["licenses"], row["unknown"]) == brute(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_whole_licences_win_over_parts(make_docs):
    bsd = " ".join(l.SENTENCES[f"bsd.{part}"] for part in ("grant", "source", "binary"))
    got = [r["licenses"] for r in l.scan(make_docs([(1, MIT), (2, bsd), (3, wrapped(l.SENTENCES["mit.permission"]))])).collect()]
    assert got == [["MIT"], ["BSD-2-Clause"], ["MIT"]]


def test_odd_documents(odd_docs, no_docs):
    rows = l.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r["licenses"] for r in rows)
    assert l.scan(no_docs).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_canonical_texts(make_docs):
    texts = {
        "// SPDX-License-Identifier: MIT\ncode": ["MIT"], "/* SPDX-License-Identifier: GPL-3.0-or-later */": ["GPL-3.0-or-later"],
        "# spdx-license-identifier: apache-2.0": ["Apache-2.0"], "# SPDX-License-Identifier: Nobody-1.0": [],
        APACHE: ["Apache-2.0"], GPL: ["GPL-3.0-or-later"], BSD: ["BSD-2-Clause"], BSD + NAMES: ["BSD-3-Clause"],
        BSD.replace("1. ", "").replace("2. ", "") + NAMES.replace("3. ", ""): ["BSD-3-Clause"],
        GPL.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2"): ["GPL-2.0-or-later"],
    }
    rows = {r["doc_id"]: r for r in l.scan(make_docs(list(enumerate(texts)))).collect()}
    assert [rows[i]["licenses"] for i in range(len(texts))] == list(texts.values())
    assert rows[3]["unknown"] and not rows[0]["unknown"] and not rows[4]["unknown"]
    assert " gpl.free  gpl.warranty " in rows[5]["sequence"]


def test_no_known_sentence_is_cut(make_docs):
    known = [*l.SENTENCES.values(), *(grant.format(n) for names in l.NAMES.values() for n in names for grant in l.GRANTS)]
    for row in l.scan(make_docs(list(enumerate(known)))).collect():
        assert row["n_sentences"] == 1 and "-" not in row["sequence"].split(), known[row["doc_id"]]
