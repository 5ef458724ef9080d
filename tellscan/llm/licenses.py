"""Operator 6: licences recognised by sentence. DataFrame functions only.

A text is cut into sentences, each is normalised and looked up among the known licence sentences, and the sequence of
identifiers found is matched against ordered rules; between two sentences that a rule asks for, there may be any that
aren't known, and up to GAP that are. Sentences are cut twice: at sentence ends and line breaks, for notices on lines of
their own, and at sentence ends and blank lines, for hard-wrapped licence texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellscan.llm.linededup import let

#: Sentences as the licences have them, each with its identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-regents": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "gpl1-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl2-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-version": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl11-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "epl2-provided": "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\").",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-affirmer": "For these and/or other purposes and motivations, and without any expectation of additional consideration or compensation, the person associating CC0 with a Work (the \"Affirmer\"), to the extent that he or she is an owner of Copyright and Related Rights in the Work, voluntarily elects to apply CC0 to the Work and publicly distribute the Work under its terms, with knowledge of his or her Copyright and Related Rights in the Work and the meaning and intended legal effect of CC0 on those rights.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "artistic-intent": "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications.",
    "gfdl-grant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;",
    "gfdl12-grant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation;",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
#: Licence and the identifiers that must follow each other, most demanding rule first. The first that
#: matches names the document's licence; licenses lists all that match.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-regents"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-header", "apache-copy", "apache-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("LGPL-2.0-or-later", ["lgpl2-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-3.0-only", ["lgpl3-version"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-1.0-or-later", ["gpl1-free"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("MPL-1.1", ["mpl11-notice"]),
    ("EPL-2.0", ["epl2-provided"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0-affirmer"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Artistic-1.0", ["artistic-intent"]),
    ("GFDL-1.3-or-later", ["gfdl-grant"]),
    ("GFDL-1.2-or-later", ["gfdl12-grant"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
]
BY_LINE = r"[.!?:;]+(?:[\x09-\x0D ]+|$)|[\x0A\x0D]+"
BY_BLANK_LINE = r"[.!?:;]+(?:[\x09-\x0D ]+|$)|\x0D?\x0A[\x09 ]*\x0D?\x0A"
#: Known sentences that may stand between two of a rule.
GAP = 2
NOISE = r"[^a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(sentence: str) -> str:
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(out.split())


def _parts(sentence: str) -> list[str]:
    """The normalised pieces of a sentence that is cut at an inner ; or : too."""
    return [p for p in (_plain(x) for x in re.split(BY_LINE, sentence)) if p]


def _pieces() -> dict[str, str]:
    """Normalised piece -> identifier; a piece that several sentences have is known by the first."""
    found: dict[str, str] = {}
    for name, sentence in SENTENCES.items():
        parts = _parts(sentence)
        for k, p in enumerate(parts):
            found.setdefault(p, name if len(parts) == 1 else f"{name}.{k + 1}")
    return found


PIECES = _pieces()


def _expanded() -> list[tuple[str, str]]:
    """(licence, pattern of the identifiers of its pieces) of each rule."""
    gap = rf"\|(?:[^|]+\|){{0,{GAP}}}"
    return [(licence, r"\|" + gap.join(re.escape(PIECES[p]) for n in names for p in _parts(SENTENCES[n])) + r"\|") for licence, names in RULES]


PATTERNS = _expanded()
LENGTHS = sorted({len(p) for p in PIECES})


def _ids(text: Column, cut: str) -> Column:
    """|id|id|...| of the known sentences in a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in PIECES.items() for x in pair])
    plain = F.transform(F.split(text, cut), lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), NOISE, " ")))
    found = F.filter(F.transform(F.filter(plain, lambda s: F.length(s).isin(LENGTHS)), lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())
    return F.concat(F.lit("|"), F.array_join(found, "|"), F.lit("|"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, license, licenses for every row of docs (columns doc_id and text).

    sentence_ids are the identifiers found when cut by line, in order and joined by blanks; license is that of the
    first rule that matches either cut and null where none does, licenses all of them, in rule order. A null text has
    none. Rows repeat as they stand; an empty table gives an empty result. Where two rules match, the one that stands
    first in RULES names the document, wherever in the text it matched.
    """

    def matched(seqs: Column) -> Column:
        hits = [F.when(F.regexp_like(seqs[0], F.lit(p)) | F.regexp_like(seqs[1], F.lit(p)), F.lit(name)) for name, p in PATTERNS]
        some = (F.length(seqs[0]) > 2) | (F.length(seqs[1]) > 2)
        return F.when(some, F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))).otherwise(F.array().cast("array<string>"))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", let(F.array(_ids(text, BY_LINE), _ids(text, BY_BLANK_LINE)), lambda s: F.struct(F.trim(F.translate(s[0], "|", " ")).alias("ids"), matched(s).alias("hits"))).alias("r"))
    return out.select("doc_id", F.col("r.ids").alias("sentence_ids"), F.get("r.hits", F.lit(0)).alias("license"), F.array_join("r.hits", " ").alias("licenses"))


def oracle_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in PIECES.items()) + "}"
    ids = lambda cut: f"'|' || coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), {quoted(cut)}), lambda s: {known}[trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '{NOISE}', ' ', 'g'))]), lambda i: i IS NOT NULL), '|'), '') || '|'"
    hits = ", ".join(f"CASE WHEN regexp_matches(a, {quoted(p)}) OR regexp_matches(b, {quoted(p)}) THEN {quoted(n)} END" for n, p in PATTERNS)
    return f"""
WITH s AS (SELECT doc_id, {ids(BY_LINE)} AS a, {ids(BY_BLANK_LINE)} AS b FROM documents),
h AS (SELECT doc_id, a, list_filter([{hits}], lambda x: x IS NOT NULL) AS h FROM s),
u AS (SELECT doc_id, a, list_filter(h, lambda x, i: list_position(h, x) = i) AS h FROM h)
SELECT doc_id, trim(translate(a, '|', ' ')) AS sentence_ids, h[1] AS license, coalesce(array_to_string(h, ' '), '') AS licenses FROM u
"""
