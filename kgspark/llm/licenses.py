"""Licence scans by sentence recognition and sequence rules (operator 2), in DataFrame functions only.

A text is normalised (lower case, one space between words, sentence ends kept as a word of their own) and every known
licence sentence in it is found, wherever it stands; the identifiers in order of appearance are matched against ordered
rules, and what a rule has matched is consumed before the next one looks. All of it happens inside a row: no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, in their normalised form, by identifier.
SENTENCES = {
    "Apache2Short": "licensed under the apache license version 2.0",
    "Apache2You": "you may not use this file except in compliance with the license",
    "Apache2Copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "MITShort": "released under the mit license",
    "MITUnder": "licensed under the mit license",
    "MITGrant": "to deal in the software without restriction including without limitation the rights to use copy "
    "modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
    "software is furnished to do so subject to the following conditions",
    "MITNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the software",
    "GPL3Work": "this work is licensed under the gnu general public license version 3",
    "GPLOrLater": "either version 3 of the license or at your option any later version",
    "GPLRedistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as "
    "published by the free software foundation",
    "BSDRedistribute": "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met",
    "CCBYNC4": "licensed under cc by nc 4.0",
    "CCBYSA4": "licensed under cc by sa 4.0",
    "CCBY4": "licensed under cc by 4.0",
    "AllRights": "all rights reserved",
}

# Ordered rules, licence name and the sequence of identifiers that it takes.
RULES = (
    ("Apache-2.0", ("Apache2Short", "Apache2You", "Apache2Copy")),
    ("Apache-2.0", ("Apache2Short",)),
    ("MIT", ("MITGrant", "MITNotice")),
    ("MIT", ("MITShort",)),
    ("MIT", ("MITUnder",)),
    ("GPL-3.0-or-later", ("GPLRedistribute", "GPLOrLater")),
    ("GPL-3.0", ("GPL3Work",)),
    ("BSD", ("AllRights", "BSDRedistribute")),
    ("BSD", ("BSDRedistribute",)),
    ("CC-BY-NC-4.0", ("CCBYNC4",)),
    ("CC-BY-SA-4.0", ("CCBYSA4",)),
    ("CC-BY-4.0", ("CCBY4",)),
    ("all-rights-reserved", ("AllRights",)),
)

# Every known sentence holds one of these words; texts and sentences without them are passed over.
ANCHORS = ("licen", "redistribut", "reserved", "copies")

SENTENCE_END = r"([.!?;:])[ \t\r\n]+|\n[ \t\r]*\n"
MARK = chr(1)


# More known sentences by identifier; " / " is a place where a sentence may end.
_GNU = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
_CC = "licensed under {} creative commons attribution {}4.0 international license"
_CC_PARTS = {"NC": "noncommercial ", "SA": "sharealike ", "NCSA": "noncommercial sharealike ", "ND": "noderivatives ",
             "NCND": "noncommercial noderivatives "}
_PERMISSION = "permission to use copy modify {} distribute this software for any purpose with or without fee is hereby granted"
_APPEAR = " provided that the above copyright notice and this permission notice appear in all copies"
NOTICES = (
    *(
        ("Apache2Copy", f"you may obtain a copy of the license at / {scheme} www.apache.org licenses license 2.0{kind}")
        for scheme in ("http", "https")
        for kind in ("", ".html", ".txt")
    ),
    ("LGPLRedistribute", _GNU.format("lesser ")),
    ("LGPLRedistribute", _GNU.format("library ")),
    ("AGPLRedistribute", _GNU.format("affero ")),
    ("GNU2OrLater", _LATER.format("2")),
    ("GNU21OrLater", _LATER.format("2.1")),
    ("GPL2Only", _GNU.format("").replace("license as", "license version 2 as")),
    ("GPL3Only", _GNU.format("").replace("license as", "license version 3 as")),
    ("GPL2Work", "this work is licensed under the gnu general public license version 2"),
    ("MITDistributed", "distributed under the mit license"),
    ("GPL2Named", "gnu general public license v2.0"),
    ("GPL3Named", "gnu general public license v3.0"),
    ("GPL2Named", "gnu general public license v2"),
    ("GPL3Named", "gnu general public license v3"),
    ("MPL2", "subject to the terms of the mozilla public license v / 2.0"),
    ("EPL2", "under the terms of the eclipse public license 2.0"),
    ("EPL2", "under the terms of the eclipse public license v / 2.0"),
    ("EPL2", "under the terms of the eclipse public license v2.0"),
    ("Boost1", "distributed under the boost software license version 1.0"),
    ("Boost1", "obtaining a copy of the software and accompanying documentation covered by this license"),
    *(("ISC", _PERMISSION.format(how) + _APPEAR) for how in ("and or", "and")),
    *(("BSD0", _PERMISSION.format(how)) for how in ("and or", "and")),
    ("Zlib", "and to alter it and redistribute it freely subject to the following restrictions"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("CC0", "has waived all copyright and related or neighboring rights to"),
    ("CC0", "licensed under cc0 1.0"),
    *((f"CCBY{k}4", _CC.format(article, text)) for k, text in {"": "", **_CC_PARTS}.items() for article in ("a", "the")),
    ("CCBYNCSA4", "licensed under cc by nc sa 4.0"),
    ("CCBYND4", "licensed under cc by nd 4.0"),
    ("CCBYNCND4", "licensed under cc by nc nd 4.0"),
)

# Rules for these; they come after ``RULES``.
NOTICE_RULES = (
    ("LGPL-3.0-or-later", ("LGPLRedistribute", "GPLOrLater")),
    ("LGPL-2.1-or-later", ("LGPLRedistribute", "GNU21OrLater")),
    ("LGPL-2.0-or-later", ("LGPLRedistribute", "GNU2OrLater")),
    ("AGPL-3.0-or-later", ("AGPLRedistribute", "GPLOrLater")),
    ("GPL-2.0-or-later", ("GPLRedistribute", "GNU2OrLater")),
    ("GPL-2.0", ("GPL2Only",)),
    ("GPL-2.0", ("GPL2Work",)),
    ("GPL-3.0", ("GPL3Only",)),
    ("MIT", ("MITDistributed",)),
    ("GPL-2.0", ("GPL2Named",)),
    ("GPL-3.0", ("GPL3Named",)),
    ("MPL-2.0", ("MPL2",)),
    ("EPL-2.0", ("EPL2",)),
    ("BSL-1.0", ("Boost1",)),
    ("ISC", ("ISC",)),
    ("0BSD", ("BSD0",)),
    ("Zlib", ("Zlib",)),
    ("Unlicense", ("Unlicense",)),
    ("CC0-1.0", ("CC0",)),
    ("CC-BY-NC-SA-4.0", ("CCBYNCSA4",)),
    ("CC-BY-ND-4.0", ("CCBYND4",)),
    ("CC-BY-NC-ND-4.0", ("CCBYNCND4",)),
)
NOTICE_ANCHORS = (*ANCHORS, "unencumbered", "waived", "hereby granted")

# Short identifiers of package headers and the licence each names.
SPDX = {
    "Apache-2.0": "Apache-2.0", "MIT": "MIT", "ISC": "ISC", "0BSD": "0BSD", "Zlib": "Zlib", "Unlicense": "Unlicense",
    "BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD", "BSL-1.0": "BSL-1.0", "MPL-2.0": "MPL-2.0", "EPL-2.0": "EPL-2.0",
    "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0+": "GPL-2.0-or-later", "GPL-2.0-or-later": "GPL-2.0-or-later",
    "GPL-3.0": "GPL-3.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0+": "GPL-3.0-or-later", "GPL-3.0-or-later": "GPL-3.0-or-later",
    "LGPL-2.1": "LGPL-2.1", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1+": "LGPL-2.1-or-later",
    "LGPL-2.1-or-later": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0", "LGPL-3.0-only": "LGPL-3.0",
    "LGPL-3.0+": "LGPL-3.0-or-later", "LGPL-3.0-or-later": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0",
    "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0-or-later", "CC0-1.0": "CC0-1.0", "CC-BY-4.0": "CC-BY-4.0",
    "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC-BY-ND-4.0": "CC-BY-ND-4.0",
    "CC-BY-NC-SA-4.0": "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0": "CC-BY-NC-ND-4.0",
}
_SPDX_WORDS = {key: re.sub("[^a-z0-9.+]+", " ", key.lower()) for key in SPDX}

KNOWN = sorted(
    [
        *((text, name) for name, text in (*SENTENCES.items(), *NOTICES)),
        *((f"spdx license identifier / {words}", f"Spdx:{key}") for key, words in _SPDX_WORDS.items()),
    ],
    key=lambda known: (-len(known[0]), known),
)
ALL_RULES = (*RULES, *NOTICE_RULES, *((name, (f"Spdx:{key}",)) for key, name in SPDX.items()))


def _anchored(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(w.replace(" ", r"\W+") for w in NOTICE_ANCHORS))


def normalised(text: Column) -> Column:
    """Words with one space between them; a slash stands for each end of a sentence."""
    marked = F.regexp_replace(text, SENTENCE_END, f"$1{MARK}")
    words = F.regexp_replace(F.lower(marked), f"[^a-z0-9.+{MARK}]+", " ")
    words = F.regexp_replace(words, rf"\.+( |{MARK}|$)", "$1")
    return F.trim(F.regexp_replace(words, f" *{MARK}[ {MARK}]*", " / "))


def _names() -> dict[str, str]:
    return {t.replace(" /", ""): name for t, name in KNOWN}


def sentence_ids(text: Column) -> Column:
    """Identifiers of all known sentences in a normalised text by position; the longest of those that begin together."""
    found = "|".join(re.escape(t).replace(r"\ ", " ").replace(" / ", "(?: /)? ") for t, _ in KNOWN)
    names = F.create_map(*(F.lit(x) for pair in _names().items() for x in pair))
    matches = F.regexp_extract_all(text, F.lit(f"(?<![^ ])(?:{found})(?![^ ])"), F.lit(0))
    return F.transform(matches, lambda m: names[F.replace(m, F.lit(" /"), F.lit(""))])


def _sequence(ids: tuple[str, ...]) -> str:
    return "," + ",,".join(ids) + ","


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, sentence_ids, licenses`` of the documents with at least one known licence sentence.

    Both lists are joined by commas: identifiers in order of appearance, licences in order of the rules, once for each
    rule that matched. Sentences end at ``. ! ? ; :`` before white space or at an empty line; a known sentence may be a
    part of one, and goes across an end only where the notice does. Null and empty texts have no sentences and give no
    row; repeated rows give repeated rows; other columns play no part. The whole text counts.
    """
    ids = sentence_ids(normalised(F.col("text")))
    rules = F.array(
        *(F.struct(F.lit(n).alias("name"), F.lit(_sequence(s)).alias("sequence")) for n, s in ALL_RULES)
    )
    start = F.struct(F.col("sequence").alias("rest"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["sequence"])
        rest = F.replace(state["rest"], rule["sequence"], F.lit("|"))
        return F.struct(
            rest.alias("rest"),
            F.when(hit, F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"),
        )

    known = (
        docs.where(F.col("text").isNotNull() & _anchored(F.col("text")))
        .select("doc_id", ids.alias("ids"))
        .where(F.size("ids") > 0)
    )
    # Two commas stand between identifiers, so that neighbouring matches do not share one.
    sequenced = known.select("doc_id", "ids", F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")).alias("sequence"))
    return sequenced.select(
        "doc_id",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.aggregate(rules, start, apply)["found"], ",").alias("licenses"),
    )


def check_sql() -> str:
    """The same scan in DuckDB. Its patterns look neither back nor ahead: each space is doubled, so that a sentence can
    take one on either side and leave its neighbour the other."""
    spaced = [(re.escape(t).replace(r"\ ", "  ").replace("  /  ", "(?:  /)?  "), name) for t, name in KNOWN]
    names = ", ".join(f"'{t}': '{name}'" for t, name in _names().items())
    steps, last = [], "c0"
    for i, (name, ids) in enumerate(ALL_RULES):
        seq = _sequence(ids)
        steps.append(
            f"c{i + 1} AS (SELECT doc_id, sentence_ids, replace(rest, '{seq}', '|') AS rest, "
            f"CASE WHEN contains(rest, '{seq}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})"
        )
        last = f"c{i + 1}"
    return f"""
    WITH marked AS (
        SELECT doc_id, regexp_replace(text, '{SENTENCE_END}', '\\1' || chr(1), 'g') AS t FROM documents
        WHERE regexp_matches(text, '(?i)licen|redistribut|reserved|copies|unencumbered|waived|hereby[^a-z0-9]+granted')
    ), words AS (
        SELECT doc_id, regexp_replace(regexp_replace(lower(t), '[^a-z0-9.+\\x01]+', ' ', 'g'), '\\.+( |\\x01|$)', '\\1', 'g') AS t
        FROM marked
    ), plain AS (
        SELECT doc_id, trim(regexp_replace(t, ' *\\x01[ \\x01]*', ' / ', 'g')) AS t FROM words
    ), matched AS (
        SELECT doc_id, regexp_extract_all(' ' || replace(t, ' ', '  ') || ' ', ' (?:{"|".join(t for t, _ in spaced)}) ') AS m
        FROM plain
    ), named AS (
        SELECT doc_id, list_transform(m, lambda x: MAP {{{names}}}[replace(replace(trim(x), '  ', ' '), ' /', '')]) AS ids FROM matched
    ), c0 AS (
        SELECT doc_id, array_to_string(ids, ',') AS sentence_ids,
               ',' || array_to_string(ids, ',,') || ',' AS rest, CAST([] AS VARCHAR[]) AS found
        FROM named WHERE len(ids) > 0
    ), {", ".join(steps)}
    SELECT doc_id, sentence_ids, array_to_string(found, ',') AS licenses FROM {last}
    """
