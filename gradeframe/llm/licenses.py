"""Licence scans: known licence sentences get identifiers, ordered rules are matched against a text's identifiers.

A text is cut into sentences (at line ends, and after . ! ? or ; before a blank), a sentence is normalised to its
lower-case letters and digits, and looked up in a map of known sentences. Lines that end without . ! ? ; or : go on in
the next, up to a line without letters and digits: such a wrapped sentence is looked up as a whole first, and line by
line if it is not known. The identifiers found, in order, are matched against rules: a rule holds if its identifiers stand next to each other among those found. Everything is a DataFrame
expression on the document's own row: no shuffle, no Python.

Null and empty texts have no sentences. A licence named several times counts once; licences come in the order of the
rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Normalised sentences by which public licences are named or granted, and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep-notice",
    "the software is provided as is without warranty of any kind": "as-is",
    "licensed under the apache license version 2 0": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "licensed under the gnu general public license version 3": "gpl-3-notice",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-terms",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "all rights reserved": "reserved",
}
# The same as the public texts and headers have them in full.
SENTENCES |= {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-keep-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "licensed under the apache license version 2 0 the license": "apache-2-notice",
    "apache license version 2 0 january 2004": "apache-2-notice",
    "apache license version 2 0 january 2004 http www apache org licenses": "apache-2-notice",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "gnu general public license version 3 29 june 2007": "gpl-3-notice",
    "gnu general public license version 2 june 1991": "gpl-2-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-notice",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-terms",
}
_SUBJECTS = ["", *(f"this {x} is " for x in ("project", "file", "software", "work", "code", "program", "package", "library"))]
_NAMES = {
    "the mit license": "mit-notice",
    "the apache license version 2 0": "apache-2-notice",
    "the apache license 2 0": "apache-2-notice",
    "the gnu general public license version 3": "gpl-3-notice",
    "the gnu general public license v3 0": "gpl-3-notice",
    "cc by 4 0": "cc-by-4-notice",
    "cc by sa 4 0": "cc-by-sa-4-notice",
    "cc by nc 4 0": "cc-by-nc-4-notice",
}
SENTENCES |= {
    f"{subject}{verb} under {terms}{name}": i
    for subject in _SUBJECTS
    for verb in ("licensed", "released", "distributed")
    for terms in ("", "the terms of ")
    for name, i in _NAMES.items()
}
#: Every known sentence has one of these, so that others need not be looked up.
_SIGNS = "(?i)licen|permission|software|redistribution|rights|cc"
# ends of sentences over several lines; every line end without a sign before it and a blank line after it is a wrap
_ENDS = r"(?<=[.!?;:])[ \t\r]*\n|\n(?:[^A-Za-z0-9\n]*\n)+"
# Licence, kind, and the identifiers that name it, in order. Several rules may name one licence.
RULES = [
    ("MIT", "permissive", ["mit-notice"]),
    ("MIT", "permissive", ["mit-grant", "mit-keep-notice", "as-is"]),
    ("Apache-2.0", "permissive", ["apache-2-notice"]),
    ("Apache-2.0", "permissive", ["apache-compliance", "apache-copy"]),
    ("BSD", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0", "copyleft", ["gpl-3-notice"]),
    ("GPL", "copyleft", ["gpl-free", "gpl-terms"]),
    ("GPL", "copyleft", ["gpl-2-notice"]),
    ("CC-BY-4.0", "permissive", ["cc-by-4-notice"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa-4-notice"]),
    ("CC-BY-NC-4.0", "restricted", ["cc-by-nc-4-notice"]),
    ("Proprietary", "restricted", ["reserved"]),
]


def _lines(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"([.!?;])[ \t\r]+", "$1\n")


def _normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def sentences(text: str) -> Column:
    """Normalised sentences in order; those without a letter or digit are left out."""
    return F.filter(F.transform(F.split(_lines(text), "\n"), _normal), lambda s: s != "")


def identifiers(text: str, known: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences, in order: of wrapped ones as a whole, or else of their lines."""
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))

    def of_lines(wrapped: Column) -> Column:
        found = F.transform(F.split(wrapped, "\n"), lambda s: F.try_element_at(table, _normal(s)))
        return F.filter(found, lambda i: i.isNotNull())

    def of_wrapped(wrapped: Column) -> Column:
        whole = F.filter(F.array(F.try_element_at(table, _normal(wrapped))), lambda i: i.isNotNull())
        return F.when((F.size(whole) > 0) | ~wrapped.contains("\n"), whole).otherwise(of_lines(wrapped))

    wrapped = F.filter(F.split(_lines(text), _ENDS), lambda s: s.rlike(_SIGNS))
    return F.flatten(F.transform(wrapped, of_wrapped))


def licences(ids: Column, rules=RULES) -> Column:
    """(licence, kind) structs of the rules that hold, each licence once."""
    line = F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|"))
    hits = [
        F.when(
            line.contains("|" + "|".join(sequence) + "|"), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))
        )
        for name, kind, sequence in rules
    ]
    return F.array_distinct(F.filter(F.array(*hits), lambda h: h.isNotNull()))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: sentences, identifiers in order, licences, and the strictest kind."""
    rows = docs.select(
        "doc_id", F.size(sentences("text")).cast("long").alias("n_sentences"), identifiers("text").alias("ids")
    )
    rows = rows.withColumn("found", licences(F.col("ids")))
    kinds = F.col("found.kind")
    strictest = F.when(F.array_contains(kinds, "restricted"), "restricted")
    strictest = strictest.when(F.array_contains(kinds, "copyleft"), "copyleft")
    return rows.select(
        "doc_id",
        "n_sentences",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.col("found.name"), ",").alias("licences"),
        strictest.when(F.size("found") > 0, "permissive").otherwise("none").alias("kind"),
    )
