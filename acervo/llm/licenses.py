"""Licence scan by sentence rules.

A text is cut into sentences: line breaks inside a paragraph are spaces, comment marks and
list bullets before a line go, and a sentence ends at a blank line or at . ! ? ; : before
white space.  Each sentence is normalised (ASCII lower case, anything but letters and
digits becomes one space) and looked up among known licence sentences; one that is none is
tried without its first line (a heading) and line by line, as headings need no full stop.
The identifiers found, in text order, are matched against ordered rules.  Of the rules of
one family, which are alternatives of one licence, only the first that matches counts.

Everything is a Column expression over one row, so a scan needs no shuffle.

Defined results: null or empty text has no identifiers and no licences; repeated rows
give repeated results; an empty table gives an empty result; other columns pass through,
and an added column whose name is taken ends in an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import free

# Sentences of well-known licences as normalised text, by identifier.
SENTENCES = {
    "MITname": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this software is released under the mit license", "distributed under the mit license", "mit license", "the mit license", "the mit license mit", "spdx license identifier mit"],
    "MITgrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MITnotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"],
    "MIT0grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"],
    "AsIs": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "Apache2": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this work is licensed under the apache license version 2 0", "apache license version 2 0", "apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses", "apache license 2 0", "released under the apache license 2 0", "spdx license identifier apache 2 0"],
    "ApacheComply": ["you may not use this file except in compliance with the license"],
    "ApacheBasis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "ApacheTerms": ["terms and conditions for use reproduction and distribution", "terms and conditions for use reproduction and distribution 1"],
    "ApacheGrant": ["subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"],
    "BSDgrant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use of this software in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSDsource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSDbinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSDendorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission", "the names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSDadvert": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "BSDasis": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "BSDname3": ["bsd 3 clause license", "licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "BSDname2": ["bsd 2 clause license", "licensed under the bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "GPL2": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "gnu general public license version 2", "gnu general public license version 2 june 1991", "spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0"],
    "GPL3": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "gnu general public license version 3", "gnu general public license version 3 29 june 2007", "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0"],
    "GPLterms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "GPL2any": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "spdx license identifier gpl 2 0 or later"],
    "GPLany": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "spdx license identifier gpl 3 0 or later"],
    "Either2": ["either version 2 of the license or at your option any later version", "either version 2 of the license or"],
    "Either21": ["either version 2 1 of the license or at your option any later version", "either version 2 1 of the license or"],
    "GPLlater": ["or at your option any later version", "either version 3 of the license or at your option any later version"],
    "GPLfree": ["this program is free software", "this library is free software"],
    "GPLhope": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "LGPLterms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "LGPL21": ["gnu lesser general public license version 2 1 february 1999", "licensed under the gnu lesser general public license version 2 1", "spdx license identifier lgpl 2 1 only", "spdx license identifier lgpl 2 1 or later"],
    "LGPL3": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3 29 june 2007", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "spdx license identifier lgpl 3 0 only", "spdx license identifier lgpl 3 0 or later"],
    "AGPL3": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3", "gnu affero general public license version 3 19 november 2007", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "spdx license identifier agpl 3 0 only", "spdx license identifier agpl 3 0 or later"],
    "MPL2": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "MPLcopy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "EPL1": ["eclipse public license v 1 0", "eclipse public license v1 0", "spdx license identifier epl 1 0"],
    "EPL2": ["eclipse public license v 2 0", "eclipse public license v2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "spdx license identifier epl 2 0"],
    "CCBY4": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "this work is licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4 0 international public license", "spdx license identifier cc by 4 0"],
    "CCBYSA4": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "this work is licensed under the creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international public license", "spdx license identifier cc by sa 4 0"],
    "CCBYNC4": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "this work is licensed under the creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 international public license", "spdx license identifier cc by nc 4 0"],
    "CCBYND4": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives 4 0 international public license", "spdx license identifier cc by nd 4 0"],
    "CC0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "released under cc0 1 0", "cc0 1 0 universal", "creative commons legal code cc0 1 0 universal", "spdx license identifier cc0 1 0"],
    "ISCgrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "spdx license identifier isc"],
    "ZeroGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "ISCasis": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "Zlib": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "spdx license identifier zlib"],
    "ZlibOrigin": ["the origin of this software must not be misrepresented"],
    "Boost": ["boost software license version 1 0 august 17th 2003", "distributed under the boost software license version 1 0", "spdx license identifier bsl 1 0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "spdx license identifier unlicense"],
    "Rights": ["all rights reserved"],
}
#: Ordered rules (family, licence, pattern over ",Id,Id,"): other identifiers may stand between those of a rule.
RULES = [
    ("mit", "MIT", ",MITgrant,(.*,)?MITnotice,"),
    ("mit", "MIT", ",MITname,"),
    ("mit", "MIT-0", ",MIT0grant,"),
    ("mit", "MIT-partial", ",MITgrant,"),
    ("apache", "Apache-2.0", ",Apache2,|,ApacheTerms,(.*,)?ApacheGrant,"),
    ("bsd", "BSD-4-Clause", ",BSDgrant,(.*,)?BSDsource,(.*,)?BSDbinary,(.*,)?BSDadvert,(.*,)?BSDendorse,"),
    ("bsd", "BSD-3-Clause", ",BSDgrant,(.*,)?BSDsource,(.*,)?BSDbinary,(.*,)?BSDendorse,"),
    ("bsd", "BSD-3-Clause", ",BSDname3,"),
    ("bsd", "BSD-2-Clause", ",BSDgrant,(.*,)?BSDsource,(.*,)?BSDbinary,"),
    ("bsd", "BSD-2-Clause", ",BSDname2,"),
    ("bsd", "BSD-1-Clause", ",BSDgrant,(.*,)?BSDsource,"),
    ("gpl3", "GPL-3.0-or-later", ",GPLany,"),
    ("gpl3", "GPL-3.0-or-later", ",GPLterms,GPLlater,"),
    ("gpl3", "GPL-3.0-or-later", ",GPL3,GPLlater,"),
    ("gpl3", "GPL-3.0-only", ",GPL3,"),
    ("gpl2", "GPL-2.0-or-later", ",GPL2any,|,GPLterms,Either2,"),
    ("gpl2", "GPL-2.0-or-later", ",GPL2,GPLlater,"),
    ("gpl2", "GPL-2.0-only", ",GPL2,"),
    ("lgpl21", "LGPL-2.1-or-later", ",LGPLterms,Either21,"),
    ("lgpl21", "LGPL-2.1", ",LGPL21,"),
    ("lgpl3", "LGPL-3.0-or-later", ",LGPLterms,GPLlater,"),
    ("lgpl3", "LGPL-3.0-only", ",LGPL3,"),
    ("agpl", "AGPL-3.0-only", ",AGPL3,"),
    ("mpl", "MPL-2.0", ",MPL2,"),
    ("epl1", "EPL-1.0", ",EPL1,"),
    ("epl2", "EPL-2.0", ",EPL2,"),
    ("ccbync", "CC-BY-NC-4.0", ",CCBYNC4,"),
    ("ccbysa", "CC-BY-SA-4.0", ",CCBYSA4,"),
    ("ccbynd", "CC-BY-ND-4.0", ",CCBYND4,"),
    ("ccby", "CC-BY-4.0", ",CCBY4,"),
    ("cc0", "CC0-1.0", ",CC0,"),
    ("isc", "ISC", ",ISCgrant,"),
    ("isc", "0BSD", ",ZeroGrant,"),
    ("zlib", "Zlib", ",Zlib,"),
    ("boost", "BSL-1.0", ",Boost,"),
    ("unlicense", "Unlicense", ",Unlicense,"),
    ("reserved", "All-Rights-Reserved", ",Rights,"),
]
#: Each known sentence has one of these, so a text without any of them has none.
HINTS = ["licen", "grant", "permission", "copyright", "software", "redistribut", "apache", "contributor", "conditions", "domain", "rights", "cc0", "version", "warrant", "advertis", "mpl"]
#: What may stand before the words of a line: comment marks, quotes and bullets.
MARKS = r"(^|\n)[ \t]*(?:(?:#+|//+|/\*+|\*+/?|--+|;+|%+|>+|<!--|\.\.|dnl|REM|[0-9a-z][.)]|\([0-9a-z]\)|[-+])[ \t]+)*"
ENDS = r"([.!?;:])[ \t\n]+|\n[ \t]*\n[ \t\n]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " "))


def chunks(text: Column) -> Column:
    """The sentences as they stand, over line breaks, without marks before their lines."""
    # every line ends in a space, so a mark that stands alone is followed by one too
    bare = F.regexp_replace(F.regexp_replace(F.concat(text, F.lit("\n")), "\r\n?|\n", " \n"), MARKS, "$1")
    return F.split(F.regexp_replace(bare, ENDS, "$1\f"), "\f")


def sentence_ids(text: Column) -> Column:
    known = {s: i for i, all_of in SENTENCES.items() for s in all_of}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # only sentences of a known length are looked up
    lengths = F.array(*[F.lit(n) for n in sorted({len(s) for s in known})])

    def found(s):
        plain = _plain(s)
        return F.filter(F.transform(F.filter(F.array(plain), lambda x: F.array_contains(lengths, F.length(x))), lambda x: F.element_at(table, x)), lambda i: i.isNotNull())

    def of(chunk):
        lines = F.split(chunk, "\n")
        whole, body = found(chunk), found(F.regexp_replace(chunk, "^[^\n]*\n", ""))
        each = F.flatten(F.transform(lines, found))
        return F.when(~chunk.contains("\n"), whole).when(F.size(whole) > 0, whole).when(F.size(body) > 0, F.concat(found(F.element_at(lines, 1)), body)).otherwise(each)

    hinted = text.rlike("(?i)" + "|".join(HINTS))
    return F.when(hinted, F.flatten(F.transform(chunks(text), of))).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    line = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    families = dict.fromkeys(f for f, _, _ in RULES)
    found = [F.coalesce(*[F.when(line.rlike(p), F.lit(name)) for f, name, p in RULES if f == family], F.lit(None).cast("string")) for family in families]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def scan(docs: DataFrame, *, text_col="text") -> DataFrame:
    """docs with sentence_ids and licences (arrays of strings)."""
    ids, named = free(docs, "sentence_ids", "licences")
    found = docs.withColumn(ids, sentence_ids(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return found.withColumn(named, licences(F.col(ids)))


def digest(found: DataFrame, *, id_col="doc_id") -> DataFrame:
    return found.select(id_col, F.size("sentence_ids").cast("long").alias("n_ids"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.size("licences").cast("long").alias("n_licences"), F.array_join("licences", ",").alias("licences"))


def oracle() -> str:
    """The same digest as DuckDB SQL over documents."""
    known = [(s, i) for i, all_of in SENTENCES.items() for s in all_of]
    table = ", ".join(f"('{s}', '{i}')" for s, i in known)
    families = dict.fromkeys(f for f, _, _ in RULES)
    cases = ", ".join("CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{name}'" for f, name, p in RULES if f == family) + " END" for family in families)
    plain = lambda x: f"trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH known(sentence, id) AS (VALUES {table}),
chunk AS (SELECT row, generate_subscripts(s, 1) AS pos, unnest(s) AS chunk FROM (
  SELECT row, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, '') || chr(10), '\r\n?|\n', ' ' || chr(10), 'g'), '{MARKS}', '\1', 'g'), '{ENDS}', '\1' || chr(12), 'g'), chr(12)) AS s
  FROM (SELECT row_number() OVER () AS row, text FROM documents))),
form AS (SELECT row, pos, 0 AS line, {plain('chunk')} AS sentence, chunk LIKE '%' || chr(10) || '%' AS more FROM chunk
  UNION ALL SELECT row, pos, -1, {plain("regexp_replace(chunk, '^[^\n]*\n', '')")}, true FROM chunk WHERE chunk LIKE '%' || chr(10) || '%'
  UNION ALL SELECT row, pos, line, {plain('l')}, true FROM (SELECT row, pos, generate_subscripts(l, 1) AS line, unnest(l) AS l FROM (SELECT row, pos, string_split(chunk, chr(10)) AS l FROM chunk WHERE chunk LIKE '%' || chr(10) || '%'))),
met AS (SELECT row, pos, line, id, count(*) FILTER (line = 0) OVER c AS whole, count(*) FILTER (line = -1) OVER c AS body FROM form JOIN known USING (sentence) WINDOW c AS (PARTITION BY row, pos)),
found AS (SELECT row, pos, CASE WHEN line = -1 THEN 2 ELSE line END AS line, id FROM met WHERE CASE WHEN whole > 0 THEN line = 0 WHEN body > 0 THEN line IN (-1, 1) ELSE true END),
numbered AS (SELECT row_number() OVER () AS row, doc_id FROM documents),
joined AS (SELECT d.doc_id, count(f.id) AS n_ids, coalesce(string_agg(f.id, ',' ORDER BY f.pos, f.line), '') AS sentence_ids FROM numbered d LEFT JOIN found f USING (row) GROUP BY d.row, d.doc_id),
ruled AS (SELECT doc_id, n_ids, sentence_ids, [x for x in [{cases}] if x IS NOT NULL] AS l FROM (SELECT *, ',' || sentence_ids || ',' AS line FROM joined))
SELECT doc_id, n_ids, sentence_ids, len(l)::BIGINT AS n_licences, array_to_string(l, ',') AS licences FROM ruled
"""
