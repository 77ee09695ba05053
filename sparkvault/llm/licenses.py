"""License recognition by sentence rules (operator 10); DataFrame functions only.

A text's sentences are normalised and looked up among known licence sentences.
A document then is a sequence of sentence identifiers, and every licence is an
ordered rule: identifiers that stand one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licences by SPDX identifier, each with the names that references use for it, normalised.
NAMES = {
    "MIT": ["mit license", "mit licence", "mit", "mit license mit", "expat license"],
    "Apache-2.0": [
        "apache license version 2 0", "apache 2 0 license", "apache license 2 0", "apache 2 0", "apache license v2 0", "apache license v 2 0", "apache software license version 2 0",
    ],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu gpl version 2", "gpl version 2", "gnu gpl v2", "gpl v2", "gplv2", "gpl 2 0"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gnu general public license version 2 or any later version", "gpl version 2 or later", "gpl v2 or later", "gplv2 or later"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu gpl version 3", "gpl version 3", "gnu gpl v3", "gpl v3", "gplv3", "gpl 3 0"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gnu general public license version 3 or any later version", "gpl version 3 or later", "gpl v3 or later", "gplv3 or later"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "lgpl version 2 1", "lgpl v2 1", "lgpl 2 1"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgpl version 3", "lgpl v3", "lgplv3", "lgpl 3 0"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "agpl version 3", "agpl v3", "agplv3", "agpl 3 0"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0", "mpl version 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0"],
    "ISC": ["isc license", "isc licence"],
    "Zlib": ["zlib license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "Unlicense": ["unlicense"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause simplified license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause"],
    "BSD": ["bsd license", "bsd licence", "bsd style license"],
    "CC0-1.0": ["cc0 1 0", "cc0", "cc0 1 0 universal license", "creative commons cc0 1 0 universal license"],
    "CC-BY-4.0": ["cc by 4 0", "cc by 4 0 license", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license cc by 4 0"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "cc by sa 4 0 license", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "cc by nc 4 0 license", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "cc by nd 4 0 license", "creative commons attribution noderivatives 4 0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "cc by nc sa 4 0 license", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "cc by nc nd 4 0 license", "creative commons attribution noncommercial noderivatives 4 0 international license"],
}
# Sentence identifiers and the normalised sentences they stand for.
SENTENCES = {
    "mit-title": ["the mit license", "mit license", "the mit license mit"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do "
        "so subject to the following conditions",
    ],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement",
    ],
    "mit-liability": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "apache-2-title": ["apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"],
    "apache-2-file": ["you may not use this file except in compliance with the license"],
    "apache-2-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache-2-basis": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
    ],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ],
    "bsd-names": [
        f"neither the name of the {holder} nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission" for holder in ("copyright holder", "author", "university", "organization")
    ],
    "bsd-warranty": [
        f"this software is provided by the {by} as is and any express or implied warranties including but not limited to the implied "
        "warranties of merchantability and fitness for a particular purpose are disclaimed"
        for by in ("copyright holders and contributors", "author and contributors", "author", "regents and contributors")
    ],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies",
    ],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-warranty": [
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness",
    ],
    "mpl-2-form": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl-2-copy": [f"if a copy of the mpl was not distributed with this file you can obtain one at {site} mozilla org mpl 2 0" for site in ("http", "https")],
    "mpl-2-title": ["mozilla public license version 2 0", "mozilla public license 2 0"],
    "gpl-2-title": ["gnu general public license version 2 june 1991"],
    "gpl-3-title": ["gnu general public license version 3 29 june 2007"],
    "lgpl-21-title": ["gnu lesser general public license version 2 1 february 1999"],
    "lgpl-3-title": ["gnu lesser general public license version 3 29 june 2007"],
    "agpl-3-title": ["gnu affero general public license version 3 19 november 2007"],
    **{
        name: [
            f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license as "
            f"published by the free software foundation either version {version} of the license or at your option any later version"
            for what in ("program", "library", "software", "file")
        ]
        for name, kind, version in (
            ("gpl-free", "", "3"), ("gpl-2-free", "", "2"), ("lgpl-21-free", "lesser ", "2 1"), ("lgpl-3-free", "lesser ", "3"), ("agpl-free", "affero ", "3"),
        )
    },
    "gpl-hope": [
        f"this {what} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose" for what in ("program", "library", "software", "file")
    ],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "unlicense-anyone": [
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
    ],
    "cc0-ref": ["this work is dedicated to the public domain"],
    "rights": ["all rights reserved"],
}
# Licence rules, each an ordered sequence of sentence identifiers.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-2-title"]),
    ("Apache-2.0", ["apache-2-ref", "apache-2-file", "apache-2-copy"]),
    ("Apache-2.0", ["apache-2-file", "apache-2-copy", "apache-2-basis"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("MPL-2.0", ["mpl-2-title"]),
    ("MPL-2.0", ["mpl-2-form", "mpl-2-copy"]),
    ("GPL-2.0", ["gpl-2-title"]),
    ("GPL-3.0", ["gpl-3-title"]),
    ("LGPL-2.1", ["lgpl-21-title"]),
    ("LGPL-3.0", ["lgpl-3-title"]),
    ("AGPL-3.0", ["agpl-3-title"]),
    ("GPL-2.0-or-later", ["gpl-2-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl-21-free", "gpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl-3-free", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("all-rights-reserved", ["rights"]),
]

#: How a reference begins, normalised: "this library is released under the", "licensed under the terms of the".
REFERENCE = (
    r"^(?:(?:this|the|our|all) (?:[a-z0-9]+ ){1,4}(?:is|are) )?(?:dual |re)?(?:licensed|released|distributed|published|provided|available|made available|offered) "
    r"under (?:the )?(?:terms of )?(?:the )?"
)


#: The first words of a reference.
STARTS = ["this", "the", "our", "all", "dual", "licensed", "relicensed", "released", "distributed", "published", "provided", "available", "made", "offered"]


def _reference_id(spdx: str) -> str:
    """The identifier of a licence's references: its SPDX identifier in lower case, without -only and .0."""
    return spdx.lower().removesuffix("-only").removesuffix(".0") + "-ref"


def _with_references() -> None:
    """Add each licence's references, its SPDX tag, and the rules of both."""
    for spdx, names in NAMES.items():
        tag = "spdx license identifier " + " ".join(spdx.lower().replace(".", " ").replace("-", " ").split())
        known = SENTENCES.setdefault(_reference_id(spdx), [])
        known += [f"under {n}{end}" for n in names for end in ("", " the license")]
        SENTENCES[_reference_id(spdx).removesuffix("-ref") + "-spdx"] = [tag]
        RULES.extend((spdx, [_reference_id(spdx).removesuffix("-ref") + end]) for end in ("-ref", "-spdx"))


_with_references()

#: A sentence ends at ., ! or ? before white space or the end of the text.
SENTENCE_END = r"[.!?]+(?:[ \t\r\x0B\f\n]|$)"
#: It can also end at a line end, or at ; or :, but wrapped sentences go on there, over empty lines too.
PIECE_END = r"\n|[;:][ \t\r\x0B\f]"


def keyed(sentence: Column) -> Column:
    """A normalised sentence as it is looked up: the beginnings of references are all ``under``."""
    return F.regexp_replace(sentence, REFERENCE, "under ")


def sentence_table(spark: SparkSession) -> DataFrame:
    """(sentence, sentence_id): the known sentences; a fixed list bounds it."""
    return spark.createDataFrame([(s, i) for i, known in SENTENCES.items() for s in known], "sentence string, sentence_id string")


def normalised(sentence: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


#: Where a reference may end within its piece: " - see the LICENSE file", "(see LICENSE)", ", a free licence"; not before "or later".
ASIDE = r"(?:[ \t][-\u2013\u2014][ \t]|[(,;])(?!\s*\(?(?:or|and|either)(?![a-z0-9]))"


def marked(piece: Column) -> Column:
    """A normalised piece in which asides begin with a bar."""
    bars = F.regexp_replace(F.translate(F.lower(piece), "|", " "), ASIDE, " | ")
    return F.trim(F.regexp_replace(bars, "[^a-z0-9|]+", " "))


def without_bars(words: Column) -> Column:
    return F.trim(F.regexp_replace(words, "[ |]+", " "))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """(key, n_sentences, sentence_ids array<string>, licenses array<string>) of every row.

    n_sentences counts the pieces between sentence and line ends, ; and :. A
    known sentence is one piece or several that follow each other without a
    sentence's end between them; of those that begin at a piece the longest
    counts, and the search goes on behind it. A reference may also be followed
    by an aside: after a dash, a bracket, a comma or a semicolon.

    sentence_ids are the known sentences in the order of the text, unknown
    sentences between them left out; licenses the distinct names of the rules
    whose sequence they contain, sorted. Null and empty texts have no
    sentence; repeated rows stay; an empty table gives an empty table.

    Everything happens within the row, so no text is shuffled. Only pieces
    that begin with a known first word begin a search; it ends once there are
    more letters than a known sentence has. Pieces of any length are read.
    """
    known = [s for group in SENTENCES.values() for s in group]
    longest = max(map(len, known)) + 200  # and the beginning of a reference
    first = "|".join(sorted({s.split()[0] for s in known} - {"under"} | set(STARTS)))
    may_be = lambda s: s.rlike(rf"(?i)^[^a-z0-9]*(?:{first})(?![a-z0-9])")
    of = F.create_map(*(F.lit(x) for i, group in SENTENCES.items() for s in group for x in (s, i)))

    most = max(len(s.split()) for s in known) + 10  # every piece has a word
    pieces = lambda unit: F.filter(F.split(unit, PIECE_END), lambda s: s.rlike("[A-Za-z0-9]"))
    rows = docs.select(F.col(key).alias("key"), F.transform(F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE_END), pieces).alias("u"))
    count = F.aggregate("u", F.lit(0).cast("long"), lambda n, u: n + F.size(u))
    rows = rows.select("key", count.alias("n_sentences"), F.filter("u", lambda u: F.exists(u, may_be)).alias("u"))

    def longest_from(unit: Column, i: Column) -> Column:
        """(i, stop, id) of the longest known sentence that begins at piece i of the unit."""

        def grow(state: Column, piece: Column) -> Column:
            words = F.when(F.length(state["words"]) <= longest, F.concat_ws(" ", F.nullif(state["words"], F.lit("")), marked(piece)))
            parts = F.split(words, r"\|")
            before = lambda n: keyed(without_bars(F.array_join(F.slice(parts, F.lit(1), n), " ")))
            # The aside begins in this piece: one that began before does not take in what follows.
            cut = F.transform(F.sequence(F.size(F.split(state["words"], r"\|")), F.size(parts)), lambda n: F.try_element_at(of, before(n)))
            aside = F.when(words.isNotNull() & F.contains(words, F.lit("|")) & keyed(words).startswith("under "), F.try_element_at(F.array_compact(cut), F.lit(-1)))
            found, at = F.coalesce(F.try_element_at(of, keyed(without_bars(words))), aside), state["at"] + 1
            stop = F.when(found.isNotNull(), at).otherwise(state["stop"])
            return F.struct(words.alias("words"), at.alias("at"), stop.alias("stop"), F.coalesce(found, state["id"]).alias("id"))

        none = F.lit(None).cast("string")
        start = F.struct(F.lit("").alias("words"), i.alias("at"), i.alias("stop"), none.alias("id"))
        best = F.aggregate(F.slice(unit, i, F.lit(most)), start, grow)
        return F.struct(i.alias("i"), best["stop"].alias("stop"), best["id"].alias("id"))

    def of_unit(unit: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(unit)), lambda i: may_be(F.get(unit, i - 1)))
        hits = F.filter(F.transform(begins, lambda i: longest_from(unit, i)), lambda h: h["id"].isNotNull())
        start = F.struct(F.lit(0).alias("stop"), F.array().cast("array<string>").alias("ids"))
        step = lambda state, h: F.when(h["i"] >= state["stop"], F.struct(h["stop"].alias("stop"), F.concat(state["ids"], F.array(h["id"])).alias("ids"))).otherwise(state)
        return F.aggregate(hits, start, step)["ids"]

    rows = rows.select("key", "n_sentences", F.flatten(F.transform("u", of_unit)).alias("sentence_ids"))
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" "))
    matched = [F.when(F.contains(line, F.lit(" " + " ".join(sequence) + " ")), F.lit(name)) for name, sequence in rules]
    licenses = F.array_sort(F.array_distinct(F.array_compact(F.array(*matched))))
    return rows.select(F.col("key").alias(key), "n_sentences", "sentence_ids", licenses.alias("licenses"))
