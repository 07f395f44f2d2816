"""Licence scans by sentence rules; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import whole_text

# The names under which public licences are granted, by their public short identifiers.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License", "Apache Software License 2.0"],
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "MIT-0": ["MIT No Attribution License"],
    "ISC": ["ISC License"],
    "0BSD": ["BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License", "2-clause BSD license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-clause BSD license"],
    "BSD-4-Clause": ["BSD 4-Clause License", "Original BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL v2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL v3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL v3", "AGPLv3", "AGPL-3.0"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-1.0": ["Eclipse Public License v1.0", "Eclipse Public License, version 1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License v2.0", "Eclipse Public License, version 2.0", "Eclipse Public License 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License, version 1.0", "CDDL 1.0"],
    "CDDL-1.1": ["Common Development and Distribution License, version 1.1", "CDDL 1.1"],
    "EUPL-1.2": ["European Union Public Licence, version 1.2", "EUPL 1.2", "EUPL v1.2"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "WTFPL": ["Do What The Fuck You Want To Public License", "WTFPL"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, version 2.0"],
    "AFL-3.0": ["Academic Free License version 3.0", "Academic Free License 3.0"],
    "OSL-3.0": ["Open Software License version 3.0", "Open Software License 3.0"],
    "MS-PL": ["Microsoft Public License"],
    "PostgreSQL": ["PostgreSQL License"],
    "Python-2.0": ["Python Software Foundation License", "Python License 2.0"],
    "NCSA": ["University of Illinois/NCSA Open Source License", "NCSA License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
    "SSPL-1.0": ["Server Side Public License, version 1", "Server Side Public License 1.0"],
    "BUSL-1.1": ["Business Source License 1.1"],
    "Elastic-2.0": ["Elastic License 2.0"],
    "ODbL-1.0": ["Open Database License 1.0", "Open Data Commons Open Database License v1.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
# How a notice begins that names a licence, and the tag before a short identifier.
FRAMES = ["licensed under", "released under", "distributed under", "available under", "provided under", "published under", "subject to"]
TAG = "SPDX-License-Identifier"

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-title": "Apache License Version 2.0, January 2004",
    "mit-title": "The MIT License (MIT)",
    "grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "grant-subject": "and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-include": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-and-grant": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "isc-include": "provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-permit": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "either-2": "either version 2 of the License, or (at your option) any later version",
    "either-21": "either version 2.1 of the License, or (at your option) any later version",
    "either-3": "either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl11-subject": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "epl1-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "epl2-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cddl-subject": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "wtfpl-just": "You just DO WHAT THE FUCK YOU WANT TO",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',
    "ofl-font": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "cc0-waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "rights": "All rights reserved",
}

# The identifiers, in this order and next to each other among the recognised sentences, that show a licence.
RULES = [
    ("Apache-2.0", ["apache-comply", "apache-copy", "apache-url"]),
    ("Apache-2.0", ["apache-title"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["grant", "grant-subject", "mit-include"]),
    ("MIT-0", ["grant", "mit-as-is"]),
    ("ISC", ["isc-grant", "isc-include"]),
    ("ISC", ["isc-and-grant", "isc-include"]),
    ("0BSD", ["isc-grant", "mit-as-is"]),
    ("BSD-4-Clause", ["bsd-permit", "bsd-source", "bsd-binary", "bsd-advert"]),
    ("BSD-3-Clause", ["bsd-permit", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-permit", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gpl-terms", "either-2"]),
    ("GPL-3.0-or-later", ["gpl-terms", "either-3"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "either-21"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "either-3"]),
    ("AGPL-3.0-or-later", ["agpl-terms", "either-3"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("AGPL-3.0", ["agpl3-title"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("MPL-1.1", ["mpl11-subject"]),
    ("EPL-1.0", ["epl1-made"]),
    ("EPL-2.0", ["epl2-made"]),
    ("CDDL-1.0", ["cddl-subject"]),
    ("Unlicense", ["unlicense-free"]),
    ("Unlicense", ["unlicense-anyone"]),
    ("WTFPL", ["wtfpl-just"]),
    ("Zlib", ["zlib-grant", "zlib-origin"]),
    ("BSL-1.0", ["boost-grant"]),
    ("OFL-1.1", ["ofl-font"]),
    ("CC0-1.0", ["cc0-waived"]),
    ("proprietary", ["rights"]),
]
#: A line without letters or digits (blank, or a mark of a comment alone) parts two paragraphs; no sentence goes over it.
PARAGRAPH = r"\n[^A-Za-z0-9\n]*\n[^A-Za-z0-9]*"
BREAK = "\x01"


def known_sentences() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """(sentences by form, rules): those above, notices that name a licence, and tags with a short identifier (also with
    "only" or "or later" for the GNU licences). The form of a sentence is its letters and digits in lower case."""
    forms = {plain(s): name for name, s in SENTENCES.items()}
    rules = list(RULES)
    for licence, names in NAMES.items():
        for name in names:
            for frame in FRAMES:
                for article in ("", "the ", "terms of the ", "the terms of the "):
                    forms.setdefault(plain(f"{frame} {article}{name}"), f"{licence}-notice".lower())
        for end in ["", "-only", "-or-later"] if "GPL" in licence else [""]:
            forms.setdefault(plain(f"{TAG}: {licence}{end}"), f"{licence}{end}-tag".lower())
            rules.append((licence + end, [f"{licence}{end}-tag".lower()]))
        rules.append((licence, [f"{licence}-notice".lower()]))
    return forms, rules


def plain(sentence: str) -> str:
    """The normal form, as ``normal`` has it."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence).lower().split())


def normal(text: Column) -> Column:
    """Letters and digits in lower case, all else one space, but paragraphs parted by a mark of their own."""
    parted = F.regexp_replace(text, PARAGRAPH, f" {BREAK} ")
    return F.lower(F.regexp_replace(parted, f"[^A-Za-z0-9{BREAK}]+", " "))


def pattern_of(forms: list[str]) -> str:
    """A regular expression that finds the longest of ``forms`` at a place: they share their first words, so that each
    word of a text is held against the words that can come next only."""

    def of(tails: list[tuple[str, ...]]) -> str:
        after: dict[str, list[tuple[str, ...]]] = {}
        for tail in sorted(tails):
            if tail:
                after.setdefault(tail[0], []).append(tail[1:])
        choices = [f"{word}\\b{of(rest)}" for word, rest in after.items()]
        if not choices:
            return ""
        return f"(?: (?:{'|'.join(choices)})){'?' if () in tails else ''}"

    tails = [tuple(f.split(" ")) for f in forms]
    return "\\b" + of(tails).removeprefix("(?: ")[:-1]


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row per row of ``docs``: (id, sentence_ids, licences, n_sentences).

    The whole text is put into its normal form (see ``normal``: line ends and marks of comments go), and known
    sentences are recognised in it wherever their forms stand at word boundaries, from left to right, the longest at
    a place, without overlap and within a paragraph; nothing depends on a text's or a sentence's length. sentence_ids
    lists their identifiers in order, with commas. licences lists, once each and in the order of the rules, the
    licences of all rules whose identifiers stand in sentence_ids next to each other. ``sentences`` (by identifier) and
    ``rules`` stand in for the known ones. A null or empty text has none: empty strings and 0. Repeated rows are
    scanned alike; other columns are not looked at; an empty table gives an empty result. No row is moved: there is
    no shuffle.
    """
    known, known_rules = known_sentences()
    if sentences is not None:
        known = {plain(s): name for name, s in sentences.items()}
    rules = known_rules if rules is None else rules
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    hits = F.regexp_extract_all(normal(whole_text(text_col)), F.lit(pattern_of(list(known))), F.lit(0))
    found = docs.select(F.col(id_col), F.transform(hits, lambda s: F.element_at(names, s)).alias("__ids"))
    joined = F.concat(F.lit(","), F.array_join("__ids", ","), F.lit(","))
    shown = F.array(*[F.when(F.contains(joined, F.lit(f",{','.join(ids)},")), F.lit(name)) for name, ids in rules])
    licences = F.array_join(F.array_distinct(F.filter(shown, lambda x: x.isNotNull())), ",")
    return found.select(
        F.col(id_col),
        F.array_join("__ids", ",").alias("sentence_ids"),
        F.when(F.size("__ids") > 0, licences).otherwise("").alias("licences"),
        F.size("__ids").cast("long").alias("n_sentences"),
    )
