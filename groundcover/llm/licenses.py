"""License scans by sentence rules.

A text is cut into sentences, sentences are normalised (lower-case words only), and known licence sentences are
replaced by identifiers, others by `-`. Ordered rules then match runs of identifiers: at each place the first rule
that fits wins, so whole licence texts come before single sentences. Everything is a column expression; nothing is
shuffled. A sentence that speaks of a licence without being known is reported as `unknown`.

Defined cases: NULL and empty texts have no sentences and no licences; licences are listed in the order of their
places, repeats included; texts that differ only in case, punctuation or white space match alike.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover.llm.common import free_name

# Names by which a licence is granted.
NAMES = {
    "MIT": ["MIT License", "MIT Licence", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPL-2.0-only"],
    "GPL-2.0-or-later": ["GPL-2.0-or-later"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0", "GPL-3.0-only"],
    "GPL-3.0-or-later": ["GPL-3.0-or-later"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}
GRANTS = [
    "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}",
    "This work is licensed under {}", "This work is licensed under the {}", "This project is licensed under the {}",
    "This software is licensed under the {}", "This file is licensed under the {}", "SPDX-License-Identifier: {}",
]
# Sentences of licence texts.
SENTENCES = {
    "mit.permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache.header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache.use": "You may not use this file except in compliance with the License.",
    "apache.copy": "You may obtain a copy of the License at",
    "apache.url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache.warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache.see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl2.free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl.warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
}
# Ordered rules, longer ones first; single grants follow from NAMES.
RULES = [
    ("MIT", ["mit.permission", "mit.notice", "mit.warranty"]),
    ("MIT", ["mit.permission", "mit.notice"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.names"]),
    ("BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("Apache-2.0", ["apache.header", "apache.copy"]),
    ("Apache-2.0", ["apache.header"]),
    ("Apache-2.0", ["grant.Apache-2.0", "apache.use", "apache.copy"]),
    ("Apache-2.0", ["grant.Apache-2.0", "apache.use"]),
    ("GPL-3.0-or-later", ["gpl.free", "gpl.warranty"]),
    ("GPL-3.0-or-later", ["gpl.free"]),
    ("GPL-2.0-or-later", ["gpl2.free", "gpl.warranty"]),
    ("GPL-2.0-or-later", ["gpl2.free"]),
    ("MIT", ["mit.permission"]),
    *[(name, [f"grant.{name}"]) for name in NAMES],
]

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # on lower-cased text
BREAK = r"[.!?:][ \t\r\n]+|\n+"
WRAPPED = (
    r'([a-z,;])\r?\n[ \t]*([a-z("])', r'([A-Z,])\r?\n[ \t]*([A-Z("])',  # lines of one sentence
    r"(warranty of)\r?\n[ \t]*(MERCHANTABILITY)",
    # BREAK would cut known sentences at these colons; a list number is no sentence.
    r"((?i:SPDX-License-Identifier)):[ \t]+([A-Za-z0-9(])", r"((?i:free software)):[ \t\r\n]+((?i:you can redistribute))",
    r"(^|\n)[ \t]*\(?[0-9]{1,2}[.)][ \t]+([A-Z])",
)
MENTION = r"(^| )(licen[cs]e[ds]?|copyright|warranty)( |$)"


def normal(sentence: str) -> str:
    """Python's side of `normalised`, for the tables above."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in sentence)
    return " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in lowered).split())


def known_sentences() -> dict[str, str]:
    """Identifier of each normalised sentence."""
    known = {normal(text): name for name, text in SENTENCES.items()}
    for licence, names in NAMES.items():
        for name in names:
            for grant in GRANTS:
                known.setdefault(normal(grant.format(name)), f"grant.{licence}")
    return known


def normalised(sentence: Column) -> Column:
    lowered = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, NOT_WORD, " "))


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, empty ones left out."""
    joined = F.coalesce(text, F.lit(""))
    for pattern in WRAPPED:
        joined = F.regexp_replace(joined, pattern, "$1 $2")
    return F.filter(F.transform(F.split(joined, BREAK), normalised), lambda s: s != "")


def _map(pairs: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*map(F.lit, pairs.values())))


def rule_pattern() -> str:
    """The rules as alternatives over identifiers between blanks, in their order."""
    runs = [" " + "  ".join(ids) + " " for _, ids in RULES]
    return "|".join(run.replace(".", "[.]") for run in runs)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sequence, licenses, unknown) of every row.

    `sequence` has the identifiers of known sentences between blanks, `-` for others.
    """
    found = free_name(docs, "found")
    known = known_sentences()
    mention = F.exists(found, lambda s: s.rlike(MENTION) & ~s.isin(list(known)))

    def identified(s):  # the set test spares most sentences the search through the map
        name = F.when(s.isin(list(known)), F.element_at(_map(known), s)).otherwise("-")
        return F.concat(F.lit(" "), name, F.lit(" "))

    by_run: dict[str, str] = {}
    for licence, ids in RULES:
        by_run.setdefault(" " + "  ".join(ids) + " ", licence)
    runs = F.regexp_extract_all("sequence", F.lit(rule_pattern()), F.lit(0))
    table = docs.select("doc_id", sentences(F.col("text")).alias(found))
    rows = table.select(
        "doc_id",
        F.size(found).cast("long").alias("n_sentences"),
        F.array_join(F.transform(found, identified), "").alias("sequence"),
        mention.alias("unknown"),
    )
    return rows.select("doc_id", "n_sentences", "sequence", F.transform(runs, lambda r: F.element_at(_map(by_run), r)).alias("licenses"), "unknown")
