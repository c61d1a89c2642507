"""License scans by sentence rules.

A text is normalised, with line and sentence ends marked; the known license sentences that stand in it from one mark
to another become identifiers, and the sequence of identifiers is matched against ordered rules. Everything happens
inside a row with built-in functions: no shuffle, and repeated or missing ids don't matter.

The SQL twin still reads a text twice, by line and with lines joined, and takes the reading that knows more sentences.
Its rows are the same where no notice is wrapped over lines in a way that it can't read, as in the given tables.

A sentence may have one blank, ``{}``, for up to ``BLANK_CHARS`` characters of names; the text's own words fill it.

Cases: a null or empty text has no sentence and no license; very long texts are scanned whole; equal sentences
match each time they stand there; an empty table gives an empty table; input columns named like the outputs are
replaced, and no other name is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wordings of well-known public licenses' sentences, normalised (lower case, runs of other characters
# than a-z, 0-9 and inner dots are one space).
SENTENCES: list[tuple[str, str]] = [
    ("mit-name", "released under the mit license"),
    ("mit-name", "licensed under the mit license"),
    ("mit-name", "this project is licensed under the mit license"),
    ("mit-name", "spdx license identifier mit"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-name", "licensed under the apache license version 2.0"),
    ("apache-name", "released under the apache license version 2.0"),
    ("apache-name", "spdx license identifier apache 2.0"),
    ("apache-notice", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at http www.apache.org licenses license 2.0"),
    ("gpl3-name", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-name", "licensed under the gnu general public license version 3"),
    ("gpl3-name", "spdx license identifier gpl 3.0 only"),
    ("gpl2-name", "this work is licensed under the gnu general public license version 2"),
    ("gpl2-name", "licensed under the gnu general public license version 2"),
    ("gpl2-name", "spdx license identifier gpl 2.0 only"),
    ("gpl3-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-names", "the name of {} may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-names", "neither the name {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mit-apache-name", "spdx license identifier mit or apache 2.0"),
    ("mit-apache-name", "spdx license identifier apache 2.0 or mit"),
    ("mit-apache-name", "licensed under either of apache license version 2.0 or mit license at your option"),
    ("gpl3-later-name", "spdx license identifier gpl 3.0 or later"),
    ("gpl2-later-name", "spdx license identifier gpl 2.0 or later"),
    ("agpl3-name", "spdx license identifier agpl 3.0 only"),
    ("agpl3-name", "licensed under the gnu affero general public license version 3"),
    ("agpl3-later-name", "spdx license identifier agpl 3.0 or later"),
    ("agpl3-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl21-name", "spdx license identifier lgpl 2.1 only"),
    ("lgpl21-later-name", "spdx license identifier lgpl 2.1 or later"),
    ("lgpl21-later", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("lgpl3-name", "spdx license identifier lgpl 3.0 only"),
    ("lgpl3-later-name", "spdx license identifier lgpl 3.0 or later"),
    ("lgpl3-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("epl2-notice", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0"),
    ("epl2-name", "spdx license identifier epl 2.0"),
    ("mpl-name", "spdx license identifier mpl 2.0"),
    ("bsd3-name", "spdx license identifier bsd 3 clause"),
    ("bsd2-name", "spdx license identifier bsd 2 clause"),
    ("isc-name", "spdx license identifier isc"),
    ("zlib-name", "spdx license identifier zlib"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense-name", "spdx license identifier unlicense"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0-name", "spdx license identifier cc0 1.0"),
    ("cc0-name", "licensed under cc0 1.0"),
    ("cc0-name", "this work is licensed under cc0 1.0"),
    ("cc0-notice", "to the extent possible under law {} has waived all copyright and related or neighboring rights to this work"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("reserved", "all rights reserved"),
]
for _kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
    for _version in ("2.0", "2.5", "3.0", "4.0"):
        for _lead in ("licensed under cc", "this work is licensed under cc", "licensed under creative commons"):
            SENTENCES.append((f"cc-{_kind.replace(' ', '-')}-{_version}", f"{_lead} {_kind} {_version}"))

# licenses' names in prose, and how a sentence leads to them and ends after them.
NAMES: dict[str, tuple[str, ...]] = {
    "mit-name": ("mit license", "expat license"),
    "apache-name": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license"),
    "gpl3-name": ("gnu general public license version 3", "gnu general public license v3.0", "gnu gplv3"),
    "gpl2-name": ("gnu general public license version 2", "gnu general public license v2.0", "gnu gplv2"),
    "agpl3-name": ("gnu affero general public license version 3", "gnu affero general public license v3.0"),
    "lgpl3-name": ("gnu lesser general public license version 3", "gnu lesser general public license v3.0"),
    "lgpl21-name": ("gnu lesser general public license version 2.1", "gnu lesser general public license v2.1"),
    "bsd3-name": ("bsd 3 clause license", "3 clause bsd license"),
    "bsd2-name": ("bsd 2 clause license", "2 clause bsd license"),
    "isc-name": ("isc license",),
    "zlib-name": ("zlib license",),
    "mpl-name": ("mozilla public license version 2.0", "mozilla public license 2.0"),
    "epl2-name": ("eclipse public license 2.0", "eclipse public license version 2.0"),
    "boost-name": ("boost software license version 1.0", "boost software license 1.0"),
    "unlicense-name": ("unlicense",),
}
LEADS = ("licensed under the", "released under the", "distributed under the", "available under the", "this project is licensed under the", "this work is licensed under the", "this software is licensed under the")
ENDS = ("", " see the license file", " see the license file for details", " see license for details")
SENTENCES += [(_id, f"{_lead} {_name}{_end}") for _id, _names in NAMES.items() for _name in _names for _lead in LEADS for _end in ENDS if (_id, f"{_lead} {_name}{_end}") not in SENTENCES]
_CC_KINDS = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
_CC_SCOPES = {"4.0": "international", "3.0": "unported", "2.5": "generic", "2.0": "generic"}
SENTENCES += [
    (f"cc-{_kind}-{_version}", f"{_lead} {_article} creative commons {_words} {_version} {_scope} license")
    for _kind, _words in _CC_KINDS.items() for _version, _scope in _CC_SCOPES.items() for _lead in ("licensed under", "this work is licensed under") for _article in ("a", "the")
]
SENTENCES += [
    ("apache-notice", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("boost-name", "spdx license identifier bsl 1.0"),
    *((f"{_id}-name", f"spdx license identifier {_old}") for _id, _old in (("gpl2", "gpl 2.0"), ("gpl3", "gpl 3.0"), ("lgpl21", "lgpl 2.1"), ("lgpl3", "lgpl 3.0"), ("agpl3", "agpl 3.0"))),
]
#: Identifiers of which an SPDX expression may name two, beside MIT or Apache-2.0.
_CHOICES = {"gpl-2.0-only": "GPL-2.0-only", "gpl-2.0-or-later": "GPL-2.0-or-later", "gpl-3.0-only": "GPL-3.0-only", "gpl-3.0-or-later": "GPL-3.0-or-later", "bsd-3-clause": "BSD-3-Clause", "bsd-2-clause": "BSD-2-Clause", "isc": "ISC", "zlib": "Zlib", "mpl-2.0": "MPL-2.0", "unlicense": "Unlicense", "bsl-1.0": "BSL-1.0"}
EITHER = [(f"{_first}-or-{_id}", f"{_name} OR {_other}", f"{_first} or {_id.replace('-', ' ')}", f"{_id.replace('-', ' ')} or {_first}".replace("  ", " ")) for _first, _name in (("mit", "MIT"), ("apache 2.0", "Apache-2.0")) for _id, _other in _CHOICES.items()]
SENTENCES += [(_id.replace(" ", "-"), f"spdx license identifier {_order}") for _id, _, *_orders in EITHER for _order in _orders]

# License, permissive or not, and the identifiers that must follow each other. The order decides which
# rule names the text's license; a rule that another one contains comes after it.
RULES: list[tuple[str, bool, tuple[str, ...]]] = [
    ("AGPL-3.0-or-later", False, ("agpl3-later",)),
    ("AGPL-3.0-or-later", False, ("agpl3-later-name",)),
    ("AGPL-3.0-only", False, ("agpl3-name",)),
    ("GPL-3.0-or-later", False, ("gpl3-later", "gpl-hope")),
    ("GPL-3.0-or-later", False, ("gpl3-later",)),
    ("GPL-2.0-or-later", False, ("gpl2-later", "gpl-hope")),
    ("GPL-2.0-or-later", False, ("gpl2-later",)),
    ("GPL-3.0-or-later", False, ("gpl3-later-name",)),
    ("GPL-2.0-or-later", False, ("gpl2-later-name",)),
    ("GPL-3.0-only", False, ("gpl3-name",)),
    ("GPL-2.0-only", False, ("gpl2-name",)),
    ("LGPL-3.0-or-later", False, ("lgpl3-later",)),
    ("LGPL-3.0-or-later", False, ("lgpl3-later-name",)),
    ("LGPL-3.0-only", False, ("lgpl3-name",)),
    ("LGPL-2.1-or-later", False, ("lgpl21-later",)),
    ("LGPL-2.1-or-later", False, ("lgpl21-later-name",)),
    ("LGPL-2.1-only", False, ("lgpl21-name",)),
    ("EPL-2.0", False, ("epl2-notice",)),
    ("EPL-2.0", False, ("epl2-name",)),
    ("MPL-2.0", False, ("mpl-notice",)),
    ("MPL-2.0", False, ("mpl-name",)),
    ("MIT OR Apache-2.0", True, ("mit-apache-name",)),
    ("Apache-2.0", True, ("apache-notice", "apache-copy")),
    ("Apache-2.0", True, ("apache-notice",)),
    ("Apache-2.0", True, ("apache-name",)),
    ("BSD-3-Clause", True, ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", True, ("bsd3-name",)),
    ("BSD-2-Clause", True, ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", True, ("bsd2-name",)),
    ("MIT", True, ("mit-grant", "mit-notice", "as-is")),
    ("MIT", True, ("mit-grant", "mit-notice")),
    ("MIT", True, ("mit-name",)),
    ("ISC", True, ("isc-grant",)),
    ("ISC", True, ("isc-name",)),
    ("Zlib", True, ("zlib-as-is", "zlib-grant")),
    ("Zlib", True, ("zlib-grant",)),
    ("Zlib", True, ("zlib-name",)),
    ("CC0-1.0", True, ("cc0-notice",)),
    ("CC0-1.0", True, ("cc0-name",)),
    ("Unlicense", True, ("unlicense",)),
    ("Unlicense", True, ("unlicense-name",)),
]
for _kind in ("by-nc-nd", "by-nc-sa", "by-nc", "by-nd", "by-sa", "by"):
    for _version in ("4.0", "3.0", "2.5", "2.0"):
        RULES.append((f"CC-{_kind.upper()}-{_version}", _kind == "by", (f"cc-{_kind}-{_version}",)))
RULES.append(("BSL-1.0", True, ("boost-name",)))
RULES += [(_name, True, (_id.replace(" ", "-"),)) for _id, _name, *_ in EITHER]  # a reader may choose the permissive one

#: The SQL twin's two readings: at stops before white space or the text's end, or at a colon or semicolon that ends its line.
SENTENCE_END = "[.!?]+(?:[ \t\r\n]+|$)|[:;][ \t\r]*\n|:[ \t]+[(]?[0-9][.)][ \t]+"
#: A plus after a version stands for later ones.
PLUS = "([0-9])[+]"
LINE_OR_SENTENCE_END = "\n|" + SENTENCE_END

BLANK = "{}"
BLANK_CHARS = 200
#: Each known sentence holds one of these, so texts without any need no normalisation.
MARKS = ("license", "gplv", "permission", "software", "warranty", "redistribution", "reserved", "waived", "cc0")


def _normalised(text: Column) -> Column:
    """Lower-case words one space apart, and one line feed where lines or sentences end. Inner dots stay, as in a version's number."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), PLUS, "$1 or later "), ":[ \t\r\n]+[(]?[0-9][.)][ \t\r\n]", "\n")  # a list's first number ends a sentence
    out = F.regexp_replace(out, "[.!?](?:[ \t\r\n]|\\z)", "\n")
    out = F.regexp_replace(out, "[.](?![a-z0-9])", " ")
    out = F.regexp_replace(out, "[^a-z0-9.\n]+", " ")
    return F.concat(F.lit("\n"), F.regexp_replace(out, " ?\n[ \n]*", "\n"), F.lit("\n"))


def _identifiers(text: Column) -> Column:
    """Known sentences from mark to mark, whatever marks stand between their words; of those that begin at one place the longest."""
    table = F.create_map(*[F.lit(x) for pair in dict((s, i) for i, s in SENTENCES).items() for x in pair])
    known = sorted({s for _, s in SENTENCES}, key=lambda s: (-len(s), s))
    blank = f"[a-z0-9. \n]{{1,{BLANK_CHARS}}}?"
    one_of = "|".join(s.replace(".", "[.]").replace(" ", "[ \n]").replace(BLANK, blank) for s in known)
    found = F.regexp_extract_all(_normalised(text), F.lit(f"(?<=\n)[ .]?({one_of})(?= ?\n)"), 1)
    has = text.rlike(f"(?i){'|'.join(MARKS)}")
    return F.when(has, F.transform(found, lambda s: table[unfilled(F.translate(s, "\n", " "))])).otherwise(F.array().cast("array<string>"))


def blanks() -> list[tuple[str, str]]:
    """What stands before and after the blank of each sentence that has one."""
    return [tuple(s.split(BLANK)) for _, s in SENTENCES if BLANK in s]


def unfilled(sentence: Column) -> Column:
    """The sentence with a blank in place of names, if it is one of those that have one."""
    for before, after in blanks():
        fits = sentence.startswith(before) & sentence.endswith(after) & F.length(sentence).between(len(before) + len(after) + 1, len(before) + len(after) + BLANK_CHARS)
        sentence = F.when(fits, F.lit(before + BLANK + after)).otherwise(sentence)
    return sentence


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """df with license_sentences (identifiers in order, comma-joined), licenses (every rule's name that matches, in
    rule order, comma-joined), license (the first of them, else null) and permissive (null without a license).

    A known sentence begins and ends at a line's, a sentence's or the text's begin and end, and may be wrapped over
    any lines between; each place counts once.
    """
    out = df.withColumn("license_sentences", F.array_join(_identifiers(F.col(text)), ","))
    padded = F.concat(F.lit(","), F.col("license_sentences"), F.lit(","))
    fits = [(name, free, F.contains(padded, F.lit("," + ",".join(seq) + ","))) for name, free, seq in RULES]
    out = out.withColumn("licenses", F.when(F.col("license_sentences") == "", "").otherwise(F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, _, c in fits]))), ",")))
    first = lambda pick: reduce(lambda tail, r: F.when(r[2], F.lit(pick(r))).otherwise(tail), reversed(fits), F.lit(None))
    return out.withColumn("license", first(lambda r: r[0]).cast("string")).withColumn("permissive", first(lambda r: r[1]).cast("boolean"))
