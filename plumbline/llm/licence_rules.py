"""License recognition by sentence rules.

A text is cut into sentences, sentences are normalised, and those that are known licence
sentences become identifiers. Ordered rules, longer ones first, are then sought in the
sequence of identifiers; the identifiers that a rule explains are not used again. Known
sentences that no rule explains are reported as such.

Licence texts are found both where one sentence spans several lines and where every line
stands for itself: a text is read by paragraphs and by lines, and both readings count.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences (lower case, words and digits only, "licence" spelled
# "license") and their identifiers.
SENTENCES: list[tuple[str, str]] = [
    ("mit-name", "released under the mit license"),
    ("mit-name", "licensed under the mit license"),
    ("mit-name", "the mit license"),
    ("mit-name", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
                  " associated documentation files the software to deal in the software without restriction including"
                  " without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
                  " copies of the software and to permit persons to whom the software is furnished to do so subject to"
                  " the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or"
                   " substantial portions of the software"),
    ("as-is-short", "the software is provided as is without warranty of any kind express or implied including but not"
                    " limited to the warranties of merchantability fitness for a particular purpose and"
                    " noninfringement"),
    ("no-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other"
                     " liability whether in an action of contract tort or otherwise arising from out of or in"
                     " connection with the software or the use or other dealings in the software"),
    ("apache2-name", "licensed under the apache license version 2 0"),
    ("apache2-name", "apache license version 2 0"),
    ("apache2-grant", "licensed under the apache license version 2 0 the license you may not use this file except in"
                      " compliance with the license"),
    # Semicolons and colons end sentences, so headers that have them inside are known by their parts.
    ("apache2-grant-a", "licensed under the apache license version 2 0 the license"),
    ("apache2-grant-b", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at"),
    ("apache2-basis", "unless required by applicable law or agreed to in writing software distributed under the"
                      " license is distributed on an as is basis without warranties or conditions of any kind either"
                      " express or implied"),
    ("gpl3-name", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-name", "licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu"
                 " general public license as published by the free software foundation either version 3 of the license"
                 " or at your option any later version"),
    ("gpl-free-a", "this program is free software"),
    ("gpl2-free-b", "you can redistribute it and or modify it under the terms of the gnu general public license as"
                    " published by the free software foundation either version 2 of the license or at your option any"
                    " later version"),
    ("gpl3-free-b", "you can redistribute it and or modify it under the terms of the gnu general public license as"
                    " published by the free software foundation either version 3 of the license or at your option any"
                    " later version"),
    ("gpl-terms", "you can redistribute it and or modify it under the terms of the gnu general public license as"
                  " published by the free software foundation"),
    ("gpl2-later", "either version 2 of the license or at your option any later version"),
    ("gpl3-later", "either version 3 of the license or at your option any later version"),
    ("gpl-hope-a", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-hope-b", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even"
                 " the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted"
                  " provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and"
                   " the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions"
                   " and the following disclaimer in the documentation and or other materials provided with the"
                   " distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"
                    " or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee is"
                  " hereby granted provided that the above copyright notice and this permission notice appear in all"
                  " copies"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is"
                  " hereby granted provided that the above copyright notice and this permission notice appear in all"
                  " copies"),
    ("cc-by-nc-4", "licensed under cc by nc 4 0"),
    ("cc-by-nc-4", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-4", "licensed under cc by 4 0"),
    ("cc-by-4", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("all-rights", "all rights reserved"),
]
# The ways in which the two paragraphs of a GPL header are cut.
GPL_FREE: list[tuple[str, list[str]]] = [
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-or-later", ["gpl-free-a", "gpl3-free-b"]),
    ("GPL-3.0-or-later", ["gpl-free-a", "gpl-terms", "gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl-free-a", "gpl2-free-b"]),
    ("GPL-2.0-or-later", ["gpl-free-a", "gpl-terms", "gpl2-later"]),
]
GPL_HOPE: list[list[str]] = [["gpl-hope"], ["gpl-hope-a", "gpl-hope-b"], []]
# Licence and its identifiers in order. Earlier rules take identifiers first.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-notice", "as-is-short", "no-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-short"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache2-grant", "apache2-copy", "apache2-basis"]),
    ("Apache-2.0", ["apache2-grant", "apache2-basis"]),
    ("Apache-2.0", ["apache2-grant-a", "apache2-grant-b", "apache2-copy", "apache2-basis"]),
    ("Apache-2.0", ["apache2-grant-a", "apache2-grant-b", "apache2-basis"]),
    *[(name, free + hope) for hope in GPL_HOPE for name, free in GPL_FREE],
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-name"]),
    ("Apache-2.0", ["apache2-grant"]),
    ("Apache-2.0", ["apache2-grant-a", "apache2-grant-b", "apache2-copy"]),
    ("Apache-2.0", ["apache2-grant-a", "apache2-grant-b"]),
    ("Apache-2.0", ["apache2-grant-a"]),
    ("Apache-2.0", ["apache2-name"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
]

# Comment marks at the start of lines; a version's full stop does not end a sentence.
COMMENT = "(?m)^[ \\t]*(?:/\\*+|\\*+/?|//+|#+|;+|--+)"
PARAGRAPH = "\\n[ \\t\\r]*\\n"
SENTENCE_END = "[.!?:;]+(?:[ \\t\\r\\n]+|$)|[\\x01]"
LINE = "\\n"


def _normalised(sentence: Column) -> Column:
    words = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    return F.regexp_replace(words, "licence", "license")


def _sentences(text: Column, unit: str) -> Column:
    """Normalised sentences of a text whose units (lines or paragraphs) end sentences."""
    return F.transform(F.split(F.regexp_replace(text, unit, "\x01"), SENTENCE_END), _normalised)


def _identifiers(sentences: Column) -> Column:
    known = F.create_map(*[F.lit(x) for ident, sentence in _distinct() for x in (sentence, ident)])
    lengths = sorted({len(s) for _, s in _distinct()})
    # Only sentences of a known length are looked up.
    likely = F.filter(sentences, lambda s: F.length(s).isin(lengths))
    return F.filter(F.transform(likely, lambda s: F.element_at(known, s)), lambda i: i.isNotNull())


def _distinct() -> list[tuple[str, str]]:
    seen: dict[str, str] = {}
    for ident, sentence in SENTENCES:
        seen.setdefault(sentence, ident)
    return [(ident, sentence) for sentence, ident in seen.items()]


def _joined(idents: Column) -> Column:
    """`|a|` for each identifier, one after the other."""
    return F.array_join(F.transform(idents, lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "")


def rule_text(idents: list[str]) -> str:
    return "".join(f"|{i}|" for i in idents)


def _match(sequence: Column) -> Column:
    """Struct of the licences found, in rule order, and the sequence that is left."""
    rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(rule_text(ids)).alias("rule")) for name, ids in RULES])
    start = F.struct(F.array().cast("array<string>").alias("found"), sequence.alias("left"))
    return F.aggregate(rules, start, lambda acc, r: F.struct(
        F.when(F.contains(acc["left"], r["rule"]), F.array_append(acc["found"], r["licence"]))
        .otherwise(acc["found"]).alias("found"),
        F.replace(acc["left"], r["rule"], F.lit("#")).alias("left"),
    ))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, `licences`, `sentences`, `unmatched` for every row, one row each, nothing shuffled.

    `licences` is a sorted array without repeats. `sentences` has the identifiers by
    paragraphs, then by lines, as `|id||id|...` with a slash between; `unmatched` counts the
    identifiers that no rule explains, in the reading that leaves fewer of those that know any. A null or empty
    text has none. Repeated rows and ids are judged each; other columns are not read.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), COMMENT, "")
    # Generators keep each step's arrays from being computed once per use.
    clean = docs.select(F.col(id_col).alias("id"), F.explode(F.array(text)).alias("text"))
    read = clean.select("id", F.inline(F.array(F.struct(
        _joined(_identifiers(_sentences(F.col("text"), PARAGRAPH))).alias("by_paragraph"),
        _joined(_identifiers(_sentences(F.col("text"), LINE))).alias("by_line"),
    ))))
    matched = read.select("id", "by_paragraph", "by_line", F.inline(F.array(F.struct(
        _match(F.col("by_paragraph")).alias("p"), _match(F.col("by_line")).alias("q"),
    ))))

    def left(s: Column) -> Column:
        return F.regexp_count(s, F.lit("\\|[^|]+\\|"))

    return matched.select(
        "id", F.array_sort(F.array_union("p.found", "q.found")).alias("licences"),
        F.concat_ws("/", "by_paragraph", "by_line").alias("sentences"),
        F.when(F.col("by_line") == "", left(F.col("p.left"))).when(F.col("by_paragraph") == "", left(F.col("q.left")))
        .otherwise(F.least(left(F.col("p.left")), left(F.col("q.left")))).cast("long").alias("unmatched"),
    )
